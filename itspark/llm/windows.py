"""Removal of runs of words that occur more than once, behind a count-min prefilter.

Each partition counts the anchors of its windows (the 18 words in a window with the smallest hash) in a
sketch of two rows of cells; the partitions' sketches are added. A window's count is at most that of its
anchor, and that at most the smaller of its two cells, so a window whose cells are below two is single. The
second pass groups exactly only windows that the sketch could not rule out, so collisions cost work and
never change the result.

The sketch grows with the number of anchors, and its cells are dealt into ranges: every task counts its anchors
by range, the partitions' counts of a range are added, and the anchors go to the ranges, once. The merged counts
of a range stand before its anchors, in as many tasks as a range with a very frequent anchor takes. Work and
memory of a task stay the same whatever the number of anchors, and nothing is sent to all tasks.

Cases: a null text has no words; texts shorter than a window lose nothing; equal rows are each other's
repeats; windows never go over the end of a document; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itspark.llm.common import discard, staged
from itspark.llm.grams import mixed
from itspark.llm.repeats import Units, without_repeats

LENGTH = 35
SIZE = 18
ROWS = 2
#: Cells of a row in a range, cells of a row for each anchor, and (row, cell) pairs that a task holds before it
#: hands their counts on.
RANGE, SPARE, HELD = 1 << 18, 6, 4_000_000


def cells_of(core: np.ndarray, row: int) -> np.ndarray:
    return (mixed(core.view(np.uint64) + np.uint64(row) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(RANGE - 1)).astype(np.int64)


def sketches(anchors: DataFrame) -> DataFrame:
    """Each task's counts, up to two, of the cells that it has anchors in: range, number of cells, cells and counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            at, cell, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((cell, at))
            at, cell, n = at[order], cell[order], n[order]
            new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
            at, cell, n = at[new], cell[new], np.minimum(np.add.reduceat(n, new), 2)
            for a, b in zip(starts := np.flatnonzero(np.diff(at, prepend=-1)).tolist(), [*starts[1:], len(at)]):
                packed = zlib.compress(cell[a:b].astype(np.int32).tobytes() + n[a:b].astype(np.uint8).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([at[a]]), pa.array([b - a]), pa.array([packed], pa.binary())], names=["at", "n", "cells"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            core, at = batch.column("core").to_numpy(), batch.column("at").to_numpy()
            copies = np.minimum(batch.column("copies").to_numpy(), 2)
            for row in range(ROWS):
                held.append((at, row * RANGE + cells_of(core, row), copies))
            size += ROWS * len(core)
            if size > HELD:
                yield from rows()
                held, size = [], 0
        if held:
            yield from rows()

    return anchors.select("core", "copies", "at").mapInArrow(work, "at long, n long, cells binary")


def estimated_repeated(anchors: DataFrame) -> DataFrame:
    """Anchors whose count the merged sketch puts at two or more. An anchor has its cells of all rows in one range."""
    names, types = anchors.columns, dict(anchors.dtypes)
    ranges = 1 + SPARE * anchors.count() // RANGE
    placed = anchors.withColumn("at", F.pmod(F.xxhash64("core"), F.lit(ranges).cast("long")))
    counts = staged(sketches(placed), "cell-counts")
    # A range with far more anchors than cells holds a very frequent one.
    ways = staged(placed.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / RANGE).cast("int").alias("ways")), "ways")
    salt = F.pmod(F.xxhash64("key", "place"), F.col("ways")).cast("int").alias("salt")
    none = F.lit(None)
    some = placed.join(ways, "at").select("at", salt, F.lit(1).alias("after"), none.cast("long").alias("n"), none.cast("binary").alias("cells"), *names)
    each = F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("salt")
    made = counts.join(ways, "at").select("at", each, F.lit(0).alias("after"), "n", "cells", *[none.cast(types[c]).alias(c) for c in names])
    both = made.unionByName(some).repartition("at", "salt").sortWithinPartitions("at", "salt", "after")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, counted = None, np.zeros(ROWS * RANGE, np.uint8)
        for batch in batches:
            at, salt = batch.column("at").to_numpy(), batch.column("salt").to_numpy()
            cuts = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(salt, prepend=-1) != 0)).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if (at[a], salt[a]) != here:
                    here = (at[a], salt[a])
                    counted[:] = 0
                part = batch.slice(a, b - a)
                given = part.filter(part.column("cells").is_valid())
                for n, packed in zip(given.column("n").to_pylist(), given.column("cells").to_pylist()):
                    raw = zlib.decompress(packed)
                    cell, more = np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.uint8, n, 4 * n)
                    counted[cell] = np.minimum(counted[cell] + more, 2)
                own = part.filter(part.column("cells").is_null())
                core = own.column("core").to_numpy()
                least = np.minimum.reduce([counted[row * RANGE + cells_of(core, row)] for row in range(ROWS)])
                yield own.filter(pa.array(least >= 2)).select(names)

    kept = staged(both.mapInArrow(work, anchors.schema), "estimated")
    discard(counts, ways)
    return kept


def remove_repeated_windows(docs: DataFrame, length: int = LENGTH, size: int = SIZE, body: bool = False) -> DataFrame:
    """Every word inside a window of ``length`` words that starts anywhere else too goes, all copies alike."""
    width = length - size + 1
    return without_repeats(docs, Units(True, length, size, (width, *((5,) if width > 5 else ()), 1)), estimated_repeated, body)
