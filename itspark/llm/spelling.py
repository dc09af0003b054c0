"""Words that are spelling variants of more frequent ones, found by K-d trees over letter counts.

A word is a point: how often it has each letter (letters beyond a-z share some of the dimensions). One edit
moves the point by at most two in L1 distance, by one if the length changes. For every length there is a K-d
tree; its upper nodes are fitted on a bounded sample of the words and route all of them to cells, a cell's
words are cut into leaves, and the order of a leaf's words is that of a K-d tree of their own. A range search
runs from each leaf over the trees of its own and the next length: the box of the leaf passes over every node
that it is too far from, and so do the boxes of its parts and of parts of parts inside two leaves that meet.
Words that are left are compared letter by letter. Counts are written in unary, in a machine word, where
the distance from a box or a point is a count of bits.

Equal counts cannot be split by boxes: anagrams stay together, in as many leaves as they need, and pairs of
leaves are compared in rows of bounded size that Spark deals out. Of pairs only those that are near leave a
task. The nodes that are sent are bounded by ``MAX_CELLS``; with more words cells get larger, and no word or
pair is left out.

A word's form is the near word that is most frequent, if it is at least ten times as frequent; so numbers
grow tenfold along a chain of forms, and five rounds of doubling reach the end of every chain.

Cases: a null or empty text has no words; repeated rows count each; a null id is written as nothing where ids
are hashed; long runs of letters are words like others; an empty table gives no rows. Only the id and the
text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itspark.llm.common import discard, shuffle_partitions, staged, text_of

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 7, 2
TIMES = 10
#: One run in so many loses a letter before it is counted; 0 leaves all as they are.
DROP = 31
#: Letters are told apart, and counted, so far.
DIMENSIONS, LEVELS = 32, 2
BITS = DIMENSIONS * LEVELS
#: Words that the upper nodes are fitted on, words in a cell as far as the nodes go, cells of all trees together.
SAMPLE, CELL, MAX_CELLS = 1 << 17, 1 << 15, 1 << 17
#: Words in a leaf, and in its parts, and parts in a part of these.
LEAF, PART = 1 << 13, 16
HELD = 300_000
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(doc_id: int | None, text: str, drop: int = DROP, least: int = LEAST_LENGTH) -> Counter:
    """The runs of letters of a text, A-Z lower-cased, some of them with a letter missing, and how often each is
    there. A run of a document always loses the same letter."""
    out: Counter = Counter()
    name = "" if doc_id is None else str(doc_id)
    # A run shorter than a word cannot become one, since runs only lose letters.
    for run, n in Counter(re.findall(rf"{RUN[:-1]}{{{least},}}", text.translate(_LOWER))).items():
        h = zlib.crc32(f"{name}:{run}".encode()) if drop else 1
        if drop and h % drop == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, drop: int = DROP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.update(words_of(doc_id, text.as_py(), drop, least_length))
                if len(held) > HELD:
                    yield flush()
        yield flush()

    found = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def letters(text: str, length: int) -> np.ndarray:
    """Code points of words of one length that stand in a row, a row each."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, length)


def points(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words as bits of a 64-bit word: bit ``t`` of a letter is set if it is there more than
    ``t`` times. So the number of bits in which two words differ is the L1 distance of their counts, but that
    counts of more than ``LEVELS`` are taken as that many."""
    plain = (codes >= 97) & (codes <= 122)
    dimension = np.where(plain, codes - np.uint32(97), 26 + codes % np.uint32(DIMENSIONS - 26)).astype(np.int64)
    at = np.arange(len(codes))[:, None] * DIMENSIONS + dimension
    counts = np.bincount(at.ravel(), minlength=len(codes) * DIMENSIONS).reshape(-1, DIMENSIONS)
    bits = (counts[:, :, None] > np.arange(LEVELS)).reshape(len(codes), BITS)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def as_bits(of: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(of).view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")


def split(bits: np.ndarray) -> int | None:
    """The bit that halves the points as evenly as any can: a letter, and how often it is on the left at most."""
    apart = np.abs(2 * bits.sum(axis=0, dtype=np.int64) - len(bits))
    best = int(np.argmin(apart))
    return best if apart[best] < len(bits) else None


Tree = list[tuple[int, int, int]]  # bit, left and right node; a cell: -1, its number, -1


def fit_tree(bits: np.ndarray, cells: int) -> Tree:
    """Split the points until there are ``cells`` cells, as far as they differ."""
    nodes: Tree = []
    number = 0

    def grow(own: np.ndarray, cells: int) -> int:
        nonlocal number
        at = len(nodes)
        nodes.append((-1, -1, -1))
        cut = split(own) if cells > 1 and len(own) > 1 else None
        if cut is None:
            nodes[at] = (-1, number, -1)
            number += 1
        else:
            right = own[:, cut] == 1
            nodes[at] = (cut, grow(own[~right], (cells + 1) // 2), grow(own[right], cells // 2))
        return at

    grow(bits, cells)
    return nodes


def route(tree: Tree, bits: np.ndarray) -> np.ndarray:
    """Cell of each point."""
    nodes = np.array(tree, np.int64)
    at = np.zeros(len(bits), np.int64)
    while True:
        bit, left, right = nodes[at].T
        if (bit < 0).all():
            return left
        at = np.where(bit < 0, at, np.where(bits[np.arange(len(bits)), np.maximum(bit, 0)] == 1, right, left))


def cells_near(tree: Tree, every: np.ndarray, some: np.ndarray, radius: int) -> list[int]:
    """Cells that may hold a point at most ``radius`` from the box of points with these bits in all or in some.

    A split costs one where all points of the box are on its other side; no bit is split twice on a way.
    """
    found, todo = [], [(0, 0)]
    while todo:
        at, far = todo.pop()
        bit, left, right = tree[at]
        if bit < 0:
            found.append(left)
            continue
        for child, apart in ((left, int(every[bit])), (right, 1 - int(some[bit]))):
            if far + apart <= radius:
                todo.append((child, far + apart))
    return found


def kd_order(bits: np.ndarray) -> np.ndarray:
    """Places of the points in the order of the leaves of a K-d tree over them."""
    out, todo = [], [np.arange(len(bits))]
    while todo:
        own = todo.pop()
        cut = split(bits[own]) if len(own) > PART else None
        if cut is None:
            out.append(own)
        else:
            right = bits[own, cut] == 1
            todo += [own[right], own[~right]]
    return np.concatenate(out)


def fit_trees(words: DataFrame) -> dict[int, Tree]:
    """A tree for each length, its cells in proportion to the words of that length, fitted on a sample."""
    sizes = {r.length: r.n for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    cell = max(CELL, -(-total // MAX_CELLS))
    # Words whose hash is in the lowest part; the limit only bounds what chance may add.
    part = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    sample = words.select("word").filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < part).limit(2 * SAMPLE)
    by: dict[int, list[str]] = {length: [] for length in sizes}
    for word in sample.toArrow().column("word").to_pylist():
        by[len(word)].append(word)
    return {length: fit_tree(as_bits(points(letters("".join(own), length))), -(-sizes[length] // cell)) for length, own in by.items()}


ENTRIES = "length int, cell long, word string, n long"
LEAVES = "length int, cell long, text string, n array<long>, points binary"


def leaves(words: DataFrame, sent) -> DataFrame:
    """All words by length and cell, in leaves of at most ``LEAF`` words, each in the order of a K-d tree of its own."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in batches:
            own = batch.column("word").to_pylist()
            length = np.fromiter(map(len, own), np.int64, len(own))
            cell = np.zeros(len(own), np.int64)
            for size in np.unique(length).tolist():
                here = np.flatnonzero(length == size)
                cell[here] = route(trees[size], as_bits(points(letters("".join(own[k] for k in here.tolist()), size))))
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(cell), batch.column("word"), batch.column("n")], names=["length", "cell", "word", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words_, n = None, [], []

        def leaf() -> pa.RecordBatch:
            length, cell = at
            of = points(letters("".join(words_), length))
            order = kd_order(as_bits(of)).tolist()
            values = [length, cell, "".join(words_[k] for k in order), [n[k] for k in order], of[order].tobytes()]
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["length", "cell", "text", "n", "points"])

        for batch in batches:
            for length, cell, word, count in zip(*(batch.column(c).to_pylist() for c in ("length", "cell", "word", "n"))):
                if words_ and ((length, cell) != at or len(words_) >= LEAF):
                    yield leaf()
                    words_, n = [], []
                at = length, cell
                words_.append(word)
                n.append(count)
        if words_:
            yield leaf()

    entries = words.mapInArrow(enter, ENTRIES)
    ordered = entries.repartitionByRange(shuffle_partitions(words.sparkSession), "length", "cell", "word").sortWithinPartitions("length", "cell", "word")
    return staged(ordered.mapInArrow(cut, LEAVES), "leaves")


def probes(leaf_rows: DataFrame, sent) -> DataFrame:
    """Each leaf once for every cell of its own and the next length that it must be compared with."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                length, cell = batch.column("length")[row].as_py(), batch.column("cell")[row].as_py()
                bits = as_bits(np.frombuffer(batch.column("points")[row].as_py(), np.uint64))
                every, some = bits.all(axis=0), bits.any(axis=0)
                to = [(length, c) for c in cells_near(trees[length], every, some, 2) if c >= cell]  # two cells meet once
                to += [(length + 1, c) for c in cells_near(trees[length + 1], every, some, 1)] if length + 1 in trees else []
                own = batch.slice(row, 1)
                for other, found in to:
                    columns = [pa.array([other], pa.int32()), pa.array([found], pa.int64()), *(own.column(c) for c in ("length", "cell", "text", "n", "points"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["to_length", "to_cell", "from_length", "from_cell", "from_text", "from_n", "from_points"])

    schema = "to_length int, to_cell long, from_length int, from_cell long, from_text string, from_n array<long>, from_points binary"
    return leaf_rows.mapInArrow(work, schema)


def _boxes(every: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits that all, and that some, of each ``PART`` neighbours have."""
    starts = np.arange(0, len(every), PART)
    return np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)


def candidates(a: np.ndarray, b: np.ndarray, radius: int, half: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points at most ``radius`` apart, from the boxes of parts of parts downwards; with ``half``, of a
    leaf and itself, each pair once."""
    levels = [[(of, of)] for of in (a, b)]
    for own in levels:
        own += [_boxes(*own[0])]
        own += [_boxes(*own[1])]

    def near(level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (a_every, a_some), (b_every, b_some) = (own[level] for own in levels)
        far = np.bitwise_count(a_every[i] & ~b_some[j]) + np.bitwise_count(b_every[j] & ~a_some[i])
        kept = far <= radius
        return i[kept], j[kept]

    top = np.indices((len(levels[0][2][0]), len(levels[1][2][0]))).reshape(2, -1)
    i, j = near(2, top[0], top[1])
    x = (i[:, None, None] * PART + np.arange(PART)[:, None] + np.zeros(PART, np.int64)).ravel()
    y = (j[:, None, None] * PART + np.zeros((PART, 1), np.int64) + np.arange(PART)).ravel()
    real = (x < len(levels[0][1][0])) & (y < len(levels[1][1][0]))
    i, j = near(1, x[real], y[real])
    if half:
        i, j = i[i <= j], j[i <= j]
    # Points part by part; the last part is filled up with a point again.
    own, other = (np.pad(of, (0, -len(of) % PART), mode="edge").reshape(-1, PART) for of in (a, b))
    for at in range(0, len(i), 512):
        p, q = i[at : at + 512], j[at : at + 512]
        far = np.bitwise_count(own[p][:, :, None] ^ other[q][:, None, :])
        found = np.flatnonzero(far.ravel() <= radius)
        pair, at_pair = np.divmod(found, PART * PART)
        x, y = p[pair] * PART + at_pair // PART, q[pair] * PART + at_pair % PART
        real = (x < len(a)) & (y < len(b)) & ((x < y) if half else True)
        yield x[real], y[real]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of words row by row whether exactly one letter is replaced, or one is added to ``a``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    more = np.zeros((len(a), 1), bool)
    begin = np.argmin(np.hstack([a == b[:, :-1], more]), axis=1)
    end = np.argmin(np.hstack([(a == b[:, 1:])[:, ::-1], more]), axis=1)
    return begin + end >= a.shape[1]


NEAR = "u string, u_n long, v string, v_n long"


def near_words(words: DataFrame) -> DataFrame:
    """Each pair of words (word, n) that differ by one edit, once."""
    sent = words.sparkSession.sparkContext.broadcast(fit_trees(words))
    rows = leaves(words, sent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row] for c in batch.schema.names}
                same = r["from_length"].as_py() == r["length"].as_py()
                (a, a_text), (b, b_text) = (
                    (np.frombuffer(r[f"{side}points"].as_py(), np.uint64), letters(r[f"{side}text"].as_py(), r[f"{side}length"].as_py())) for side in ("from_", "")
                )
                itself = same and r["from_text"].as_py() == r["text"].as_py()
                for i, j in candidates(a, b, 2 if same else 1, itself):
                    good = one_edit(a_text[i], b_text[j])
                    i, j = i[good], j[good]
                    if len(i):
                        columns = [pa.array(_words(a_text[i])), r["from_n"].values.take(pa.array(i)), pa.array(_words(b_text[j])), r["n"].values.take(pa.array(j))]
                        yield pa.RecordBatch.from_arrays(columns, names=["u", "u_n", "v", "v_n"])

    asked = staged(probes(rows, sent), "probes")
    # Two leaves of a cell meet once.
    once = (F.col("from_length") != F.col("length")) | (F.col("from_cell") != F.col("cell")) | (F.col("from_text") <= F.col("text"))
    met = asked.join(rows, (F.col("to_length") == F.col("length")) & (F.col("to_cell") == F.col("cell")) & once)
    found = staged(met.drop("to_length", "to_cell").mapInArrow(work, NEAR), "near")
    discard(asked, rows)
    return found


def _words(codes: np.ndarray) -> list[str]:
    text, length = codes.tobytes().decode("utf-32-le"), codes.shape[1]
    return [text[at : at + length] for at in range(0, len(text), length)]


def variants(docs: DataFrame, drop: int = 0, times: int = TIMES, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n.

    The form is the near word of largest n (of equal ones the first by code points) if that is at least
    ``times`` the word's own; the root is the last of the forms that follow from the word, or itself.
    ``drop`` makes test data: one run in so many loses a letter.
    """
    words = staged(word_counts(docs, drop, least_length, least_count), "words")
    pairs = near_words(words)
    both = pairs.unionAll(pairs.select("v", "v_n", "u", "u_n"))
    best = both.groupBy(F.col("u").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("v_n")).alias("order"), F.col("v").alias("form"))).alias("best")
    )
    joined = words.join(best, "word", "left").withColumn("near_n", -F.col("best.order"))
    enough = F.col("near_n") >= times * F.col("n")
    formed = staged(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")),
        "formed",
    )
    up = formed.filter("form is not null").select("word", F.col("form").alias("up"))
    # Forms grow tenfold, so 2**5 steps are more than 64 bits can count.
    for _ in range(5):
        next_ = up.select(F.col("word").alias("up"), F.col("up").alias("further"))
        up = staged(up.join(next_, "up", "left").select("word", F.coalesce("further", "up").alias("up")), "up")
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")
