"""Line dedup: drop lines that many documents share, or all but their first occurrence.

Every document gives one row per distinct line key: a 128-bit hash and the positions of the line. The rows
are range-partitioned and sorted by (hash, document), so a line that a third of all documents have spreads
over many tasks. Each task streams its range, holding back at most ``min_docs`` rows: a run of a hash inside
the range is judged at once, and the two runs at its ends, which may go on in a neighbour, are judged from
their counts afterwards. What comes back per text is a compressed bitmap of the lines to drop, not text.

Cases: a null or empty text is one empty line; lines without a key (white space only) are never counted nor
dropped; a document with the same line twice counts once; repeated rows and documents with equal ids are
documents of their own, and equal texts get equal bitmaps; an empty table gives no rows. The only columns
read are the id and the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itspark.llm.common import discard, shuffle_partitions, staged, text_key, text_of

MIN_DOCS = 10
MIN_CHARS = 1
OCCURRENCES = "h1 long, h2 long, doc_id long, key binary, positions array<int>"
JUDGED = "kind string, h1 long, h2 long, n long, doc_id long, key binary, positions array<int>"


def line_positions(text: bytes, min_chars: int = MIN_CHARS) -> dict[bytes, list[int]]:
    """Line key to the positions of its lines. The key is stripped of white space and A-Z lower-cased."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip().lower()
        if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
            found.setdefault(key, []).append(i)
    return found


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document and distinct line key."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, rows, counts, positions = [], [], [], []
        for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            for key, at in line_positions(text, min_chars).items():
                digests.append(hashlib.blake2b(key, digest_size=16).digest())
                rows.append(row)
                counts.append(len(at))
                positions.extend(at)
        halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        taken = batch.select(["doc_id", "key"]).take(pa.array(rows, pa.int64()))
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32), pa.array(positions, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), *taken.columns, lists], names=["h1", "h2", "doc_id", "key", "positions"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                yield of_batch(batch.slice(start, 500))

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), text_of().alias("text")).mapInArrow(work, OCCURRENCES)


def judge(sorted_rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Stream sorted ranges. Kinds of rows: ``drop`` is in a run of ``min_docs`` rows or more; ``first`` is
    the first row of such a run; ``edge`` and ``edge first`` are in a run at an end of the range, where
    ``edge first`` carries the run's count in ``n`` and ``edge`` is a row that is not judged yet.
    """

    judged_names = ["kind", "h1", "h2", "n", "doc_id", "key", "positions"]

    def marked(rows: pa.RecordBatch, kind: str, n: int) -> pa.RecordBatch:
        size = rows.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * size, pa.string()), *rows.columns[:2], pa.array([n] * size, pa.int64()), *rows.columns[2:]], names=judged_names
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, count, held, first, at_start = None, 0, [], None, True

        def ended(at_end: bool) -> Iterator[pa.RecordBatch]:
            """The run is over: judge it, or leave it to its neighbours."""
            if run is None:
                return
            if at_start or at_end:
                yield marked(first, "edge first", count)
                for rows in held:
                    yield marked(rows, "edge", 0)
            elif count >= min_docs:
                yield marked(first, "first", count)

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = (batch.column(i).to_numpy() for i in range(2))
            starts = np.concatenate([[0], np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1])
            sizes = np.diff(np.append(starts, batch.num_rows))
            last = len(starts) - 1
            for j in range(len(starts)):
                at, size = int(starts[j]), int(sizes[j])
                if 0 < j < last and size < min_docs:
                    # a small run inside the batch has all its rows here
                    if run is not None:
                        yield from ended(False)
                        run, at_start = None, False
                    continue
                this = (int(h1[at]), int(h2[at]))
                if this != run:
                    yield from ended(False)
                    at_start = run is None and at_start
                    run, count, held, first = this, 0, [], batch.slice(at, 1)
                rows = batch.slice(at, size)
                count += size
                if count < min_docs:
                    held.append(rows)
                else:
                    for before in [*held, rows]:
                        yield marked(before, "drop", 0)
                    held = []
        yield from ended(True)

    return sorted_rows.mapInArrow(work, JUDGED)


def drop_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Which lines go: ``(key, dropped)`` per text, and ``(first_id, first_key, firsts)``.

    ``dropped`` is a zlib-compressed bitmap, most significant bit first, of lines that ``min_docs`` documents
    or more have; lines beyond its end stay. ``firsts`` lists, for the document that has it, the position
    of the first occurrence of each such line.
    """
    rows = staged(occurrences(docs, min_chars), "lines")
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "key")
    judged = staged(judge(ranged, min_docs), "judged")
    discard(rows)
    edges = judged.filter("kind = 'edge first'").groupBy("h1", "h2").agg(
        F.sum("n").alias("total"), F.min(F.struct("doc_id", "key", "positions")).alias("first")
    ).filter(F.col("total") >= min_docs)
    gone = judged.filter("kind = 'drop'").select("key", "positions").unionAll(
        judged.filter("kind = 'edge'").join(edges, ["h1", "h2"]).select("key", "positions")
    )
    firsts = judged.filter("kind = 'first'").select("doc_id", "key", "positions").unionAll(edges.select("first.*"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for lists in batch.column("lists").to_pylist():
                at = np.fromiter((i for one in lists for i in one), np.int64)
                bits = np.zeros(int(at.max()) + 1, np.uint8)
                bits[at] = 1
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(maps, pa.binary())], names=["key", "dropped"])

    # Copies of a text bring the same lists of positions, which meet in a set before the shuffle.
    bitmaps = gone.groupBy("key").agg(F.collect_set("positions").alias("lists")).mapInArrow(pack, "key binary, dropped binary")
    first_of = firsts.groupBy(F.col("doc_id").alias("first_id"), F.col("key").alias("first_key")).agg(F.collect_list(F.get("positions", F.lit(0))).alias("firsts"))
    return bitmaps, first_of


def kept_lines(text: bytes, dropped: bytes | None, firsts: list[int] | None = None) -> tuple[int, int, bytes]:
    """Number of lines, number of those dropped, and the rest joined again."""
    lines = text.split(b"\n")
    if dropped is None:
        return len(lines), 0, text
    keep = np.ones(len(lines), bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), np.uint8))[: len(lines)]
    keep[: len(bits)] = bits == 0
    if firsts:
        keep[firsts] = True
    return len(lines), int((~keep).sum()), b"\n".join([line for line, k in zip(lines, keep) if k])


def apply_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, body: bool = True) -> DataFrame:
    """The documents as ``row`` with ``n_lines``, ``n_dropped``, ``kept_sha256`` and, if asked for, ``kept_text``.

    Without ``keep_first`` the shared lines go everywhere; with it their first occurrence by id and position stays.
    """
    bitmaps, firsts = drop_bitmaps(docs, min_docs, min_chars)
    rows = docs.select(F.struct("*").alias("row"), text_key().alias("_key"), text_of().alias("_text"), F.col("doc_id").cast("long").alias("_id"))
    if not body:
        rows = rows.withColumn("row", F.struct("row.doc_id"))
    joined = rows.join(bitmaps, F.col("_key") == F.col("key"), "left").drop("key")
    if keep_first:
        joined = joined.join(firsts, F.col("_id").eqNullSafe(F.col("first_id")) & (F.col("_key") == F.col("first_key")), "left")
    else:
        joined = joined.withColumn("firsts", F.lit(None).cast("array<int>"))
    joined = joined.select("row", "_text", "dropped", "firsts")
    schema = T.StructType([joined.schema["row"]])
    for name, kind in (("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())):
        schema = schema.add(name, kind)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts, maps, firsts = (part.column(c).cast(t).to_pylist() for c, t in (("_text", pa.binary()), ("dropped", pa.binary()), ("firsts", pa.list_(pa.int32()))))
                made = [kept_lines(*x) for x in zip(texts, maps, firsts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        pa.array([m[0] for m in made], pa.int64()),
                        pa.array([m[1] for m in made], pa.int64()),
                        pa.array([hashlib.sha256(m[2]).hexdigest() for m in made], pa.string()),
                        pa.array([m[2].decode() if body else None for m in made], pa.string()),
                    ],
                    names=["row", "n_lines", "n_dropped", "kept_sha256", "kept_text"],
                )

    return joined.mapInArrow(render, schema)
