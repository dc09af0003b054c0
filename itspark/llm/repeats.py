"""Windows that occur more than once in a corpus, found by refining buckets.

A sequence is a text's bytes or words. Every window of ``length`` units has an anchor, a stretch of units
that equal windows choose at the same place (see ``grams.anchors``), so the windows that chose one anchor are
one bucket of starts in a row: those at most ``width`` units before it. A bucket is refined with two keys:
its *core*, the units that all of its windows share, and its *hull*, the units from the first window's start
to the last one's end. A core that occurs once ends the bucket: none of its windows is repeated. A hull that
occurs again means that all are. What is between is split into smaller buckets of starts, down to single
windows, where core and hull are the window itself. One of several equal hulls goes on as a witness, so that
a window is never counted as single because its copies were settled above.

Core and hull are 64- and 128-bit digests of the units themselves; a core's only decides whether to look on.
Texts stay bucketed by content key; rows of a few numbers move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itspark.llm import grams
from itspark.llm.common import Texts, discard, staged, text_key

NODES = "core long, hull binary, key binary, copies long, anchor long, lo long, hi long, seen boolean"
ANCHORS = "core long, key binary, copies long, place long"


@dataclass(frozen=True)
class Units:
    """How a text is a sequence: bytes, or words between white space."""

    words: bool
    length: int  # of a window
    size: int  # of an anchor
    grids: tuple[int, ...]  # starts in a bucket on each level; the first takes all windows of an anchor, the last one

    def split(self, text: bytes) -> Sequence:
        return text.split() if self.words else text

    def join(self, part) -> bytes:
        return b" ".join(part) if self.words else part

    def codes(self, text: bytes) -> np.ndarray:
        """A 64-bit code for each unit."""
        raw = np.frombuffer(text, np.uint8)
        codes = grams.BYTE_CODES[raw]
        if not self.words:
            return codes
        inside = ((raw != 32) & ((raw < 9) | (raw > 13))).astype(np.int8)
        edges = np.diff(inside, prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        return grams.stretch_hashes(grams.running(codes), starts, ends) | np.uint64(1)


def _pack(anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """An anchor and its windows in one long; windows start at most 255 units before it."""
    return (anchor << 16) | ((anchor - lo) << 8) | (anchor - hi)


def anchor_rows(texts: DataFrame, units: Units) -> DataFrame:
    """Core, content key and place of every anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                cores, places, counts = [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    core, anchor, lo, hi = grams.anchors(units.codes(text), units.length, units.size)
                    cores.append(core.view(np.int64))
                    places.append(_pack(anchor, lo, hi))
                    counts.append(len(core))
                rows = pa.array(np.repeat(np.arange(part.num_rows), counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cores)), part.column("key").take(rows), part.column("copies").take(rows), pa.array(np.concatenate(places))],
                    names=["core", "key", "copies", "place"],
                )

    return texts.mapInArrow(work, ANCHORS)


def split_buckets(texts: DataFrame, nodes: DataFrame, units: Units, grid: int) -> DataFrame:
    """Buckets of ``grid`` starts below the given ones (key, list of anchor, lo, hi, seen)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "hull", "key", "copies", "anchor", "lo", "hi", "seen"]
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for row in range(batch.num_rows):
                text = batch.column("text")[row].cast(pa.binary()).as_py()
                key, copies = batch.column("key")[row].as_py(), batch.column("copies")[row].as_py()
                sequence = units.split(text)
                for node in batch.column("nodes")[row].as_py():
                    anchor = node["anchor"]
                    for block in range((anchor - node["hi"]) // grid, (anchor - node["lo"]) // grid + 1):
                        hi, lo = min(node["hi"], anchor - block * grid), max(node["lo"], anchor - (block + 1) * grid + 1)
                        hull = hashlib.blake2b(units.join(sequence[lo : hi + units.length]), digest_size=16).digest()
                        first = anchor - block * grid
                        core = hashlib.blake2b(units.join(sequence[first : first - grid + 1 + units.length]), digest_size=8).digest()
                        for name, value in zip(names, (int.from_bytes(core, "little", signed=True), hull, key, copies, anchor, lo, hi, node["seen"])):
                            out[name].append(value)
                if len(out["lo"]) > 20_000:
                    yield batch_of(out)
                    out = {n: [] for n in names}
            yield batch_of(out)

    kinds = {"core": pa.int64(), "hull": pa.binary(), "key": pa.binary(), "copies": pa.int64(), "anchor": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "seen": pa.bool_()}

    def batch_of(out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[n]) for n, v in out.items()], names=list(out))

    return texts.join(nodes, "key").select("key", "copies", "text", "nodes").mapInArrow(work, NODES)


def settle(nodes: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Starts of repeated windows (key, lo, hi), and the buckets that must be split.

    The given staged buckets are deleted when they are settled.
    """
    hulls = staged(nodes.groupBy("core", "hull").agg(F.sum("copies").alias("n"), F.min(F.struct("key", "lo")).alias("witness")), "hulls")
    used = [nodes, hulls]
    if last:
        verdict = hulls.filter("n >= 2").select("core", "hull", F.lit(True).alias("repeated"), F.lit(False).alias("open"), "witness")
    else:
        cores = staged(hulls.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds >= 2"), "cores")
        used.append(cores)
        verdict = hulls.join(cores, "core", "left").select("core", "hull", (F.col("n") >= 2).alias("repeated"), F.col("kinds").isNotNull().alias("open"), "witness")
        verdict = verdict.filter("repeated or open")
    verdict = staged(verdict, "verdict")
    used.append(verdict)
    joined = nodes.join(verdict, ["core", "hull"])
    # Of copies of a text everything goes anyway, and a witness was settled on an earlier level.
    open_ = F.col("open") & (~F.col("repeated") | ((F.col("witness.key") == F.col("key")) & (F.col("witness.lo") == F.col("lo"))))
    judged = staged(
        joined.select("key", "anchor", "lo", "hi", (F.col("repeated") & ~F.col("seen") & (F.col("copies") == 1)).alias("out"), open_.alias("open"), (F.col("seen") | F.col("repeated")).alias("seen")).filter("out or open"),
        "judged",
    )
    discard(*used)
    out = judged.filter("out").select("key", "lo", "hi")
    return out, None if last else judged.filter("open").select("key", "anchor", "lo", "hi", "seen")


def by_text(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("key").agg(F.collect_list(F.struct("anchor", "lo", "hi", "seen")).alias("nodes"))


def repeated_starts(texts: Texts, units: Units, repeated: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key and the list of (lo, hi) starts of repeated windows, for texts that one row has.

    ``repeated`` keeps of the anchors at least those whose core occurs again.
    """
    place = F.col("place")
    anchor = F.shiftright(place, 16)
    anchors = staged(anchor_rows(texts.table(), units), "anchors")
    nodes = repeated(anchors).select(
        "key",
        anchor.alias("anchor"),
        (anchor - F.shiftright(place, 8).bitwiseAND(255)).alias("lo"),
        (anchor - place.bitwiseAND(255)).alias("hi"),
        F.lit(False).alias("seen"),
    )
    found = None
    for grid in units.grids:
        rows = staged(split_buckets(texts.table(), by_text(nodes), units, grid), "buckets")
        if found is None:
            discard(anchors)
        out, nodes = settle(rows, grid == units.grids[-1])
        found = out if found is None else found.unionAll(out)
    return found.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))


def covered(n: int, length: int, starts: list[tuple[int, int]], all_of_it: bool) -> list[tuple[int, int]]:
    """Maximal runs of units inside the windows with the given starts."""
    if all_of_it:
        return [(0, n)] if n >= length else []
    runs: list[list[int]] = []
    for lo, hi in sorted(starts):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + length)
        else:
            runs.append([lo, hi + length])
    return [(a, b) for a, b in runs]


def without_repeats(docs: DataFrame, units: Units, repeated: Callable[[DataFrame], DataFrame], body: bool = False) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, spans (start, end of removed runs), kept_sha256 and, if asked for,
    kept_text: bytes are left as bytes, words are joined by one space."""
    docs = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                sequence = units.split(batch.column("text")[row].cast(pa.binary()).as_py())
                given = [(s["lo"], s["hi"]) for s in batch.column("starts")[row].as_py() or ()]
                runs = covered(len(sequence), units.length, given, batch.column("copies")[row].as_py() > 1)
                edges = [0, *(x for run in runs for x in run), len(sequence)]
                kept = units.join(_kept(sequence, edges, units.words))
                rows.append((len(sequence), sum(b - a for a, b in runs), len(runs), [x for run in runs for x in run], hashlib.sha256(kept).hexdigest(), kept if body else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.binary())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", "n_units", "n_removed", "n_spans", "spans", "kept_sha256", "kept_text"])

    schema = "key binary, n_units long, n_removed long, n_spans long, spans array<long>, kept_sha256 string, kept_text binary"
    with Texts(docs) as texts:
        starts = repeated_starts(texts, units, repeated)
        joined = texts.table().join(starts, "key", "left").select("key", "copies", "text", "starts")
        result = staged(joined.mapInArrow(work, schema), "without-repeats")
    return docs.select("doc_id", text_key().alias("key")).join(result, "key").drop("key")


def _kept(sequence: Sequence, edges: list[int], words: bool):
    """The units between removed runs, in order."""
    parts = [sequence[a:b] for a, b in zip(edges[::2], edges[1::2])]
    return [w for p in parts for w in p] if words else b"".join(parts)
