"""Documents packed into sequences of at most ``capacity`` tokens, best two fit.

A document is its token ids and an end mark. One that is longer than a sequence is cut into full pieces, what
is left over standing in the first one. Only the lengths matter to the packing, and there are no more than
``capacity`` of them, so the plan is made from the number of pieces of each length: a bin is filled greedily
with the longest pieces that still fit, then its shortest piece gives way to the two unpacked ones that fill
the gap best, if they fill it more tightly. A bin is filled alike as often as the pieces last, so a plan is a
list of patterns and how often each is used. A pattern ends when some length of it runs short, after which
that length is left fewer times than fit into a bin; so there are at most ``capacity * (1 + ln(capacity))``
patterns of at most ``sqrt(2 * capacity)`` lengths each, whatever the number of documents.

Pieces are numbered within their length by the task that cut them and the sum of the tasks before it; the
number tells the pattern, the sequence and the place in it. No text crosses the network, and no row is
sorted: one narrow join by task and length, and a lookup in the plan.

Cases: a null or empty text is the end mark alone; copies and repeated rows are packed each; a null id is
kept; an empty table gives no rows; long texts are cut, never shortened. Only the id and the text are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itspark.llm.common import staged, text_of

CAPACITY = 2048
END = 0
#: Stretches in doubt whose ids a task keeps, and the longest that it keeps.
KEPT, KEPT_LENGTH = 200_000, 48
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, part int, nth long"


#: How byte-level tokenizers of this kind part a text, and the characters that Unicode has always put where it does now.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD = r"[^\t\n\r\x20-\x7e\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]|<\||\S{1000}|\s{1000}"
CUT = r"(?<=[!-~])(?=[ \n])"


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file as byte strings, if it is byte-level BPE whose merges are in the order of
    their ids, so that merging by rank makes the same tokens."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, split = made["model"], made["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and made["normalizer"] is None
    if model.get("type") != "BPE" or not plain or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    joined = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ids = [model["vocab"][m.replace(" ", "")] for m in joined]
    if ids != sorted(ids):
        return None
    # Bytes that are not printable Latin-1 characters are written as the characters from U+0100 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    written = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"] for t in made["added_tokens"]}
    return {bytes(map(written.__getitem__, token)): n for token, n in model["vocab"].items() if token not in special}


def encoder(path: str):
    """Ids of a text as the library gives them; made once in a task.

    The library takes most of its time to part a text. Merging by rank parts and merges alike wherever no
    character's class is in doubt, so it gets these texts. Others are cut before white space that follows a
    printable ASCII character: a part always ends there, so the ids are those of the stretches in a row, and
    the library itself encodes the stretches in doubt. Those are also the ones with long runs, or with what
    may be a special token.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def whole(text: str) -> list[int]:
        return model.encode(text, add_special_tokens=False).ids

    ranks = byte_ranks(path)
    if ranks is None:
        return whole
    import tiktoken

    merge = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    odd, cut = re.compile(ODD), re.compile(CUT)
    known: dict[str, list[int]] = {}

    def ids(text: str) -> list[int]:
        if not odd.search(text):
            return merge(text)
        out: list[int] = []
        for doubt, stretches in groupby(cut.split(text), lambda x: bool(odd.search(x))):
            if not doubt:
                out += merge("".join(stretches))
                continue
            for stretch in stretches:
                own = known.get(stretch)
                if own is None:
                    own = whole(stretch)
                    if len(stretch) <= KEPT_LENGTH:
                        if len(known) > KEPT:
                            known.clear()
                        known[stretch] = own
                out += own
        return out

    return ids


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, body: bool = False) -> DataFrame:
    """A row for each piece: where it starts in its document's ids, its length, the checksum of its ids, the ids
    if asked for, the task that cut it, and how many of its length that task has cut before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(path)
        cut = np.zeros(capacity + 1, np.int64)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64())
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encode(text.as_py()), end], np.uint32)
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    own = ids[a:b]
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(own.astype("<u4").tobytes()), own.astype(np.int32) if body else None, part, int(cut[b - a])))
                    cut[b - a] += 1
                held += len(ids)
                if len(rows) >= 10_000 or body and held > 1_000_000:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(work, PIECES)


def fill(left: np.ndarray) -> tuple[dict[int, int], int]:
    """The next bin (length: pieces of it) and how often it is filled alike. ``left[n]`` counts pieces of length n."""
    capacity = len(left) - 1
    sizes = np.flatnonzero(left)
    took: dict[int, int] = {}
    gap = capacity
    at = len(sizes)
    while gap and (at := int(np.searchsorted(sizes[:at], gap, side="right"))):
        size = int(sizes[at - 1])
        took[size] = min(int(left[size]), gap // size)
        gap -= took[size] * size
        at -= 1
    bin_ = dict(took)
    least = min(took)
    if gap and sum(took.values()) > 1:
        spare = left.copy()
        for size, n in took.items():
            spare[size] -= n
        room = gap + least
        # The longest unpacked piece of at most each length.
        longest = np.maximum.accumulate(np.where(spare[: room + 1] > 0, np.arange(room + 1), 0))
        a = np.flatnonzero(spare[: room + 1])
        b = longest[np.minimum(room - a, a)]
        again = (b == a) & (spare[a] < 2)
        b = np.where(again, longest[np.maximum(a - 1, 0)], b)
        total = np.where(b > 0, a + b, 0)
        if len(a) and total.max() > least:
            best = len(a) - 1 - int(np.argmax(total[::-1]))
            bin_[least] -= 1
            for size in (int(a[best]), int(b[best])):
                bin_[size] = bin_.get(size, 0) + 1
            bin_ = {s: n for s, n in bin_.items() if n}
    times = min(int(left[s]) // max(bin_.get(s, 0), took.get(s, 0)) for s in {*bin_, *took})
    return bin_, times


@dataclass(frozen=True)
class Plan:
    """Of each length, sorted by the first number of its pieces: that number, how often the pattern is used, its
    first sequence, and the place of the first piece of this length in it."""

    slots: dict[int, np.ndarray]
    n_sequences: int


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns until nothing is left, from the number of pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    used = np.zeros(capacity + 1, np.int64)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    while left.any():
        bin_, times = fill(left)
        offset = 0
        for size in sorted(bin_, reverse=True):
            slots.setdefault(size, []).append((int(used[size]), times, sequence, offset))
            used[size] += times * bin_[size]
            left[size] -= times * bin_[size]
            offset += size * bin_[size]
        sequence += times
    return Plan({size: np.array(rows, np.int64) for size, rows in slots.items()}, sequence)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, body: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for: one row per piece."""
    cut = staged(pieces(docs, path, capacity, end, body), "pieces")
    by_task = staged(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "by-task")
    # At most ``capacity`` rows.
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity).slots)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    numbered = cut.join(staged(by_task.select("part", "length", before.alias("before")), "before"), ["part", "length"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("before") + F.col("nth")).alias("nth"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sent.value
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                rows = slots[int(length[own[0]])]
                first, times, begin, place = rows[np.searchsorted(rows[:, 0], nth[own], side="right") - 1].T
                sequence[own] = begin + (nth[own] - first) % times
                offset[own] = place + (nth[own] - first) // times * length[own]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset), batch.column("ids")], names=[c.split()[0] for c in PACKED.split(", ")])

    packed = numbered.mapInArrow(work, PACKED)
    return packed if body else packed.drop("ids")


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>"


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces packed with their ids; a sequence is at most ``capacity`` ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"))
