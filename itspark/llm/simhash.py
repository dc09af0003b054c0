"""SimHash near-duplicates through Gray-order indexes.

A fingerprint is the majority of the bits of the hashes of a text's shingles. Distinct fingerprints are
entered once in each of several tables, their bits turned so that the table's key, some blocks of bits, stands
in front, and range-sorted by table and Gray rank: neighbours in that order share long runs of bits. The sorted list is cut into chunks
and leaves, each described by a mask of the bits that all below it share, and their pattern. Two nodes whose
patterns differ in more than ``max_bits`` of the bits that both share are passed over with everything below;
only the leaves that are left are compared fingerprint by fingerprint. The top nodes are the keys' values:
nodes of one table whose keys differ are passed over at once. Two fingerprints that differ in at most
``max_bits`` bits agree on all but so many of their blocks, so with a table for each choice of that many blocks
no link is lost. Keys get longer with the number of fingerprints (see ``tables``), so that a value holds about
a chunk of unrelated ones at any size, and comparisons grow with the entries and not with their square.

A large group of near copies shares its key's value, so it is cut into chunks of bounded size; pairs of
chunks are compared in tasks of their own, and each gives links between the groups found inside the chunks,
not between all members.

Cases: a null or empty text has fingerprint zero and is linked like any other; copies and repeated rows share
a fingerprint, so they are one entry of the index; rows without an id take part and never name a component
that has an id; an empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itspark.llm.common import brief_shuffles, discard, shuffle_partitions, staged, text_key, text_of
from itspark.llm.components import components
from itspark.llm.grams import mixed, shingle_hashes
from itspark.llm.similar import similar

CHUNK = 512
LEAF = 16
#: Of each byte value, its bits from the lowest.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


@dataclass(frozen=True)
class Plan:
    """What fingerprints are made of, and when two are linked."""

    width: int  # words in a shingle
    words: int  # 64-bit words in a fingerprint
    max_bits: int
    similarity: tuple[int, int] | None = None  # over, under: links are texts this similar, not fingerprints this near


#: All links at 4 or fewer of 64 bits.
EXACT = Plan(4, 1, 4)
#: Five-word shingle sets with a similarity of 0.8 or more. The fingerprints are an estimate (at 0.8 about half of
#: the pairs differ in more than 58 of 384 bits, and 16 in 100 agree on none of 24 blocks), so they only
#: suggest pairs; ``similar`` compares these and finds the others.
SIMILAR = Plan(5, 6, 58, (4, 5))

#: Bits of a fingerprint's word: the word, the first bit from the top, the number of bits.
Piece = tuple[int, int, int]


def _cut(words: int, parts: int) -> list[Piece]:
    """Each word in so many blocks, the longer ones first."""
    each, more = divmod(64, parts)
    return [(word, at * each + min(at, more), each + (at < more)) for word in range(words) for at in range(parts)]


def tables(plan: Plan, n: int) -> list[tuple[Piece, ...]]:
    """The keys, each some blocks of one word, under which n distinct fingerprints are entered.

    Keys are the shortest that have a value for each ``CHUNK`` fingerprints. If fingerprints decide, a word in m
    blocks has a key for each m - max_bits of them: 5 tables to 2 million fingerprints, 15 to 500 million, 35 to
    60,000 million, 70 beyond. If they only suggest pairs, a key is one block: 24 tables, with longer keys fewer.
    """
    needed = np.log2(max(n, 1) / CHUNK)
    if plan.similarity is not None:
        parts = next((p for p in (4, 3) if 64 // p >= needed), 2)
        return [(block,) for block in _cut(plan.words, parts)]
    parts = next((m for m in range(plan.max_bits + 1, plan.max_bits + 4) if (m - plan.max_bits) * (64 // m) >= needed), plan.max_bits + 4)
    return list(combinations(_cut(1, parts), parts - plan.max_bits))


def in_front(x: np.ndarray, key: tuple[Piece, ...]) -> np.ndarray:
    """Words with the key's bits first, then those after its last block, then the others."""
    last = key[-1][1] + key[-1][2]
    edges = [(0, 0), *((at, at + n) for _, at, n in key), (64, 64)]
    gaps = [(a, b - a) for (_, a), (b, _) in zip(edges, edges[1:]) if b > a]
    out = np.zeros_like(x)
    for at, n in [*((at, n) for _, at, n in key), *sorted(gaps, key=lambda g: (g[0] < last, g[0]))]:
        # Blocks are shorter than a word, since there are several.
        out = (out << np.uint64(n)) | ((x << np.uint64(at)) >> np.uint64(64 - n))
    return out


def majority(hashes: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints, one row of ``words`` longs for each text, from the hashes of all of them in a row.

    Words after the first take their bits from the hash mixed again. Votes are counted by byte value first.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes) * 256
    out = np.zeros((len(sizes), words), np.uint64)
    for word in range(words):
        bits = hashes if word == 0 else mixed(hashes + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64))
        for byte in range(8):
            values = ((bits >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
            votes = np.bincount(owner + values, minlength=256 * len(sizes)).reshape(-1, 256) @ _BITS
            won = (2 * votes > sizes[:, None]).astype(np.uint8)
            out[:, word] |= np.packbits(won, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, content key, and the fingerprint as bytes, most significant first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, keys, hashes, sizes):
            made = majority(np.array(hashes, np.uint64), np.array(sizes, np.int64), plan.words)
            raw = made.astype(">u8").tobytes()
            step = 8 * plan.words
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())], names=["doc_id", "key", "fingerprint"]
            )

        for batch in batches:
            ids, keys, hashes, sizes = [], [], [], []
            for doc_id, key, text in zip(batch.column("doc_id"), batch.column("key"), batch.column("text").cast(pa.binary())):
                of = shingle_hashes(text.as_py(), plan.width)
                ids.append(doc_id.as_py())
                keys.append(key.as_py())
                hashes.extend(of)
                sizes.append(len(of))
                if len(hashes) > 200_000 or len(ids) >= 500:
                    yield flush(ids, keys, hashes, sizes)
                    ids, keys, hashes, sizes = [], [], [], []
            if ids:
                yield flush(ids, keys, hashes, sizes)

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), text_of().alias("text")).mapInArrow(work, "doc_id long, key binary, fingerprint binary")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a word in the Gray code's order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def _as_words(column: pa.Array, words: int) -> np.ndarray:
    """Bytes of fingerprints as rows of longs."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def entries(nodes: DataFrame, plan: Plan, keys: list[tuple[Piece, ...]]) -> DataFrame:
    """An entry of each fingerprint in each table (``block``): Gray rank of the turned word, node, fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _as_words(batch.column("fingerprint"), plan.words)
            for block, key in enumerate(keys):
                x = prints[:, key[0][0]]
                # The sign bit is turned so that signed order is the order of ranks.
                rank = (gray_rank(in_front(x, key)) ^ np.uint64(1 << 63)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), block, np.int32)), pa.array(rank), batch.column("node"), batch.column("fingerprint")],
                    names=["block", "rank", "node", "fingerprint"],
                )

    return nodes.select("node", "fingerprint").mapInArrow(work, "block int, rank long, node long, fingerprint binary")


def _far(a_pattern, a_mask, b_pattern, b_mask) -> np.ndarray:
    """Bits that two nodes share and in which they differ: no pair below differs in fewer."""
    return np.bitwise_count((a_pattern ^ b_pattern) & a_mask & b_mask).sum(axis=1)


def _nodes(prints: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and mask of the bits that all fingerprints of a stretch share."""
    every, some = np.bitwise_and.reduceat(prints, starts, axis=0), np.bitwise_or.reduceat(prints, starts, axis=0)
    mask = ~(every ^ some)
    return every & mask, mask


def linked(prints: np.ndarray, leaves: np.ndarray, left: np.ndarray, right: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked places below given pairs of leaves; ``leaves`` are their starts, with the end at last."""
    pattern, mask = _nodes(prints, leaves[:-1])
    found_a, found_b = [], []
    for at in range(0, len(left), 4096):
        a, b = left[at : at + 4096], right[at : at + 4096]
        near = _far(pattern[a], mask[a], pattern[b], mask[b]) <= max_bits
        a, b = a[near], b[near]
        i = leaves[a][:, None, None] + np.arange(LEAF)[None, :, None]
        j = leaves[b][:, None, None] + np.arange(LEAF)[None, None, :]
        i, j = np.broadcast_arrays(i, j)
        real = (i < leaves[a + 1][:, None, None]) & (j < leaves[b + 1][:, None, None]) & (i < j)
        i, j = i[real], j[real]
        near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1) <= max_bits
        found_a.append(i[near])
        found_b.append(j[near])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each place is connected with."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def _pairs_within(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i <= j of leaves inside each chunk, given its first leaf and how many there are."""
    a, b = [], []
    for size in np.unique(count):
        i, j = np.triu_indices(size)
        at = first[count == size][:, None]
        a.append((at + i).ravel())
        b.append((at + j).ravel())
    return np.concatenate(a), np.concatenate(b)


CHUNKS = "u long, v long, block int, value long, chunk string, nodes array<long>, prints binary, roots array<long>, pattern array<long>, mask array<long>"


def chunks(ordered: DataFrame, plan: Plan, keys: list[tuple[Piece, ...]]) -> DataFrame:
    """Links found inside chunks (u, v), and the chunks whose key's value may have others."""
    lengths = np.array([sum(n for *_, n in key) for key in keys])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            block, rank, node = (batch.column(i).to_numpy() for i in range(3))
            prints = _as_words(batch.column("fingerprint"), plan.words)
            value = (rank.view(np.uint64) >> (64 - lengths[block]).astype(np.uint64)).astype(np.int64)
            new = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(value, prepend=-1) != 0))
            size = np.diff(np.append(new, len(node)))
            # Cut groups into chunks, and chunks into leaves.
            pieces = -(-size // CHUNK)
            starts = np.concatenate([s + CHUNK * np.arange(p) for s, p in zip(new.tolist(), pieces.tolist())])
            ends = np.append(starts[1:], len(node))
            alone = np.repeat((pieces == 1) & (new > 0) & (new + size < len(node)), pieces)
            count = -(-(ends - starts) // LEAF)
            first = np.cumsum(count) - count
            leaves = np.append(np.concatenate([s + LEAF * np.arange(c) for s, c in zip(starts.tolist(), count.tolist())]), len(node))
            many = ends - starts > 1
            a, b = _pairs_within(first[many], count[many]) if many.any() else (np.zeros(0, np.int64),) * 2
            root = roots(len(node), *linked(prints, leaves, a, b, plan.max_bits))
            below = np.flatnonzero(root != np.arange(len(node)))
            if len(below):
                yield _rows({"u": pa.array(node[below]), "v": pa.array(node[root[below]])}, len(below))
            open_ones = np.flatnonzero(~alone)
            if not len(open_ones):
                continue
            pattern, mask = _nodes(prints, starts)
            for k in open_ones.tolist():
                at, end = starts[k], ends[k]
                yield _rows(
                    {
                        "block": pa.array([block[at]], pa.int32()),
                        "value": pa.array([value[at]], pa.int64()),
                        "chunk": pa.array([f"{part}-{number}-{k}"]),
                        "nodes": pa.array([node[at:end]], pa.list_(pa.int64())),
                        "prints": pa.array([prints[at:end].astype(">u8").tobytes()], pa.binary()),
                        "roots": pa.array([node[root[at:end]]], pa.list_(pa.int64())),
                        "pattern": pa.array([pattern[k].view(np.int64)], pa.list_(pa.int64())),
                        "mask": pa.array([mask[k].view(np.int64)], pa.list_(pa.int64())),
                    },
                    1,
                )

    return ordered.mapInArrow(work, CHUNKS)


_TYPES = {"u": pa.int64(), "v": pa.int64(), "block": pa.int32(), "value": pa.int64(), "chunk": pa.string(), "prints": pa.binary()}


def _rows(given: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    names = ["u", "v", "block", "value", "chunk", "nodes", "prints", "roots", "pattern", "mask"]
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, _TYPES.get(c, pa.list_(pa.int64()))) for c in names], names=names)


def across(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Links between chunks of one value of a key, as links between the groups found inside them."""
    a = pieces.select(*[F.col(c).alias(f"a_{c}") for c in ("block", "value", "chunk", "roots", "prints", "pattern", "mask")])
    b = pieces.select(*[F.col(c).alias(f"b_{c}") for c in ("block", "value", "chunk", "roots", "prints", "pattern", "mask")])
    shared = F.zip_with("a_mask", "b_mask", lambda x, y: x.bitwiseAND(y))
    differ = F.zip_with(F.zip_with("a_pattern", "b_pattern", lambda x, y: x.bitwiseXOR(y)), shared, lambda x, m: F.bit_count(x.bitwiseAND(m)))
    pairs = a.join(b, (F.col("a_block") == F.col("b_block")) & (F.col("a_value") == F.col("b_value")) & (F.col("a_chunk") < F.col("b_chunk")))
    pairs = pairs.filter(F.aggregate(differ, F.lit(0), lambda s, x: s + x) <= plan.max_bits).select("a_roots", "a_prints", "b_roots", "b_prints")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                root_a, root_b = (batch.column(c)[row].values.to_numpy() for c in ("a_roots", "b_roots"))
                prints = np.concatenate([np.frombuffer(batch.column(c)[row].as_py(), ">u8").astype(np.uint64) for c in ("a_prints", "b_prints")])
                prints = prints.reshape(-1, plan.words)
                cut = len(root_a)
                leaves = np.concatenate([np.arange(0, cut, LEAF), np.arange(cut, len(prints), LEAF), [len(prints)]])
                n_a = -(-cut // LEAF)
                left, right = (x.ravel() for x in np.meshgrid(np.arange(n_a), np.arange(n_a, len(leaves) - 1), indexing="ij"))
                i, j = linked(prints, leaves, left, right, plan.max_bits)
                found = np.unique(np.stack([root_a[i], root_b[j - cut]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return pairs.mapInArrow(work, "u long, v long")


def links(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Edges between nodes that connect exactly the fingerprints that links connect."""
    keys = tables(plan, nodes.count())
    rows = staged(entries(nodes, plan, keys), "entries")
    ordered = rows.repartitionByRange(shuffle_partitions(nodes.sparkSession), "block", "rank").sortWithinPartitions("block", "rank")
    cut = staged(chunks(ordered, plan, keys), "chunks")
    discard(rows)
    found = across(cut.filter("chunk is not null"), plan)
    edges = staged(cut.filter("u is not null").select("u", "v").unionAll(found), "links")
    discard(cut)
    return edges


def groups(docs: DataFrame, plan: Plan = EXACT) -> DataFrame:
    """doc_id, key, fingerprint, root (the group's node), component_id: the smallest id in the group."""
    prints = staged(fingerprints(docs, plan), "fingerprints")
    # Texts with one fingerprint are one node, unless the texts themselves are compared.
    by = "fingerprint" if plan.similarity is None else "key"
    nodes = prints.groupBy(by).agg(F.min("doc_id").alias("label"), *([] if plan.similarity is None else [F.first("fingerprint").alias("fingerprint")]))
    nodes = staged(nodes.withColumn("node", F.xxhash64(by)), "nodes")
    edges = links(nodes, plan)
    if plan.similarity is not None:
        with brief_shuffles(docs.sparkSession):
            edges = similar(docs, edges, plan.width, plan.similarity)
    member = staged(components(edges).join(nodes.select("node", "label"), "node"), "members")
    lowest = staged(member.groupBy("root").agg(F.min("label").alias("lowest")), "lowest")
    named = staged(member.join(lowest, "root").select("node", "root", "lowest"), "named")
    known = nodes.join(named, "node", "left").select(
        by, F.coalesce("root", "node").alias("root"), F.coalesce("lowest", "label").alias("component_id")
    )
    return prints.join(staged(known, "known"), by).select("doc_id", "key", "fingerprint", "root", "component_id")


def keep_one(docs: DataFrame, plan: Plan = SIMILAR) -> DataFrame:
    """Of each group the row with the smallest id, of equal rows any one; all columns as they were."""
    first = groups(docs, plan).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("w"))
    winners = first.select(F.col("w.none").alias("_none"), F.coalesce("w.doc_id", F.lit(0)).alias("_id"), F.col("w.key").alias("_key"))
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), text_key().alias("_key")
    )
    # Rows with equal id and text are together already; among them one stays.
    equal = Window.partitionBy("_none", "_id", "_key").orderBy(F.lit(1))
    kept = rows.join(staged(winners, "winners"), ["_none", "_id", "_key"]).withColumn("_n", F.row_number().over(equal)).filter("_n = 1")
    return kept.select("row.*")
