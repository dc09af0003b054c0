"""How far each source of a language departs from the others and from the whole, term by term.

Terms that enough documents of a language have are kept and numbered in order by minimal acyclic transducers
(``transducer``), one for each stretch of the sorted terms. Texts are then streamed through them: a term's
path gives its ordinal, and only ordinals are counted from there on. They also break ties, since their order
is that of the terms. Shares are whole billionths of a group's kept terms, all arithmetic is on integers.

Transducers are sent to all tasks while they are smaller than ``SEND_BYTES``. Beyond that the terms of the
texts are dealt to the transducers instead, counted by task first, and a transducer that gets much of them is
repeated over several tasks. Both ways count the same.

For each term the counts of all sources come together, so that one pass gives every task's share of the sums
between sources and its own largest departures from the whole. A list per term is as long as the language has
sources; the result has the square of that.

Cases: a null text, language or source is empty; a group without kept terms has every term at count zero; a
language without kept terms has pairs of value 0 and no terms; repeated rows and null ids count as documents;
an empty table gives no rows. Only the text and the two labels are read. Exact up to 9 * 10**15 terms a group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itspark.llm.common import discard, staged, text_of
from itspark.llm.transducer import Transducer

MIN_DOCUMENTS = 3
TOP = 200
#: Terms, and their bytes, in one transducer.
SHARD_TERMS, SHARD_BYTES = 1 << 17, 1 << 23
#: Transducers are sent to all tasks up to this size together.
SEND_BYTES = 64 << 20
#: What a task holds before it hands it on: different terms, or different numbers.
HELD_TERMS, HELD_NUMBERS = 300_000, 2_000_000
PIECE_TERMS = 50_000

#: Bytes of terms: letters, A-Z as a-z, and every byte of a character beyond ASCII. The rest parts them.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def read(docs: DataFrame) -> DataFrame:
    """lang, source, text, null as empty."""
    label = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")}
    return docs.select(label["lang"], label["source"], text_of().alias("text"))


def _arrow(columns: dict[str, tuple[list | np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], names=list(columns))


def kept_terms(texts: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term (bytes) of terms that at least ``least`` documents of the language have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, terms in seen.items():
                yield _arrow({"lang": ([lang] * len(terms), pa.string()), "term": (list(terms), pa.binary()), "n": (list(terms.values()), pa.int64())})
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                seen[lang].update(set(text.as_py().translate(_TERM_BYTES).split(b" ")) - {b""})
                if sum(map(len, seen.values())) > HELD_TERMS:
                    yield from flush()
        yield from flush()

    found = texts.select("lang", "text").mapInArrow(work, "lang string, term binary, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


BUILT = "lang string, part int, number int, nth long, term binary, made binary, n long"


def build(kept: DataFrame) -> DataFrame:
    """Rows of two kinds: each term with the transducer it is in and its place there, and each transducer."""
    spark = kept.sparkSession
    parts = max(1, -(-kept.count() // SHARD_TERMS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, lang, size = TaskContext.get().partitionId(), 0, None, 0
        terms: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            labels = {"lang": ([lang] * len(terms), pa.string()), "part": ([part] * len(terms), pa.int32()), "number": ([number] * len(terms), pa.int32())}
            none = [None] * len(terms)
            yield _arrow({**labels, "nth": (np.arange(len(terms)), pa.int64()), "term": (terms, pa.binary()), "made": (none, pa.binary()), "n": (none, pa.int64())})
            made = Transducer.of(terms).to_bytes()
            one = {k: (v[:1], t) for k, (v, t) in labels.items()}
            yield _arrow({**one, "nth": ([None], pa.int64()), "term": (terms[:1], pa.binary()), "made": ([made], pa.binary()), "n": ([len(terms)], pa.int64())})

        for batch in batches:
            for own, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
                if terms and (own != lang or len(terms) >= SHARD_TERMS or size >= SHARD_BYTES):
                    yield from flush()
                    terms, size, number = [], 0, number + 1
                lang = own
                terms.append(term)
                size += len(term)
        if terms:
            yield from flush()

    ordered = kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    return staged(ordered.mapInArrow(work, BUILT), "terms")


def numbered(built: DataFrame) -> DataFrame:
    """lang, part, number, first term, n, made, base: each transducer with the ordinal of its first term."""
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part", "number")) - F.col("n")
    bases = built.filter("made is not null").select("lang", "part", "number", "n", before.alias("base"))
    made = built.filter("made is not null").select("lang", "part", "number", F.col("term").alias("first"), "made")
    return staged(made.join(bases, ["lang", "part", "number"]), "transducers")


COUNTS = "lang string, source string, ordinal long, n long"


class _Tally:
    """Counts of ordinals by language and source, summed while few enough to hold."""

    def __init__(self):
        self.codes: dict[tuple[str, str], int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, group: np.ndarray, ordinal: np.ndarray, n: np.ndarray) -> None:
        self.held.append((group, ordinal, n))
        self.size += len(group)
        if self.size > HELD_NUMBERS:
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        group, ordinal, n = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ordinal, group))
        group, ordinal, n = group[order], ordinal[order], n[order]
        new = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(ordinal, prepend=-1) != 0))
        self.held = [(group[new], ordinal[new], np.add.reduceat(n, new) if len(new) else n)]
        self.size = len(new)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        labels = list(self.codes)
        for group, ordinal, n in self.held:
            for at in range(0, len(group), 200_000):
                own = group[at : at + 200_000]
                langs, sources = (pa.array([x[k] for x in labels], pa.string()).take(pa.array(own)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([langs, sources, pa.array(ordinal[at : at + 200_000]), pa.array(n[at : at + 200_000])], names=["lang", "source", "ordinal", "n"])
        self.held, self.size = [], 0


def prefixes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each stretch as a number, in the order of the stretches but for ties."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        byte = np.where(starts + k < ends, text[np.minimum(starts + k, len(text) - 1)], 0).astype(np.uint64)
        out = out << np.uint64(8) | byte
    return out


def _streamed(texts: DataFrame, shards: DataFrame) -> DataFrame:
    """Counts by task, with all transducers at hand."""
    rows = shards.select("lang", "first", "base", "made").orderBy("lang", "base").collect()
    sent = texts.sparkSession.sparkContext.broadcast([(r.lang, bytes(r["first"]), r.base, bytes(r.made)) for r in rows])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, list] = defaultdict(list)
        begins: dict[str, list[int]] = defaultdict(list)
        for lang, first, base, made in sent.value:
            of[lang].append((base, Transducer.from_bytes(made)))
            begins[lang].append(int.from_bytes(first[:8].ljust(8, b"\0"), "big"))
        firsts = defaultdict(lambda: np.zeros(0, np.uint64), {lang: np.array(own, np.uint64) for lang, own in begins.items()})
        tally = _Tally()

        def count(lang: str, sources: list[str], parts: list[bytes]) -> None:
            text = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
            inside = (text != 32).astype(np.int8)
            edges = np.diff(inside, prepend=0)
            starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            upto = np.cumsum([len(p) + 1 for p in parts])
            codes = np.array([tally.codes.setdefault((lang, s), len(tally.codes)) for s in sources])
            group = codes[np.searchsorted(upto, starts, side="right")]
            own = of[lang]
            begin = prefixes(text, starts, ends) if len(own) > 1 else np.zeros(len(starts), np.uint64)
            lo = np.maximum(np.searchsorted(firsts[lang], begin, side="left") - 1, 0)
            hi = np.maximum(np.searchsorted(firsts[lang], begin, side="right") - 1, 0)
            for k, (base, made) in enumerate(own):
                here = np.flatnonzero((lo <= k) & (k <= hi)) if len(own) > 1 else slice(None)
                found = made.ordinals(text, starts[here], ends[here])
                hit = found >= 0
                # Ordinals are below 2**42.
                keys, n = np.unique(group[here][hit] << 42 | base + found[hit], return_counts=True)
                tally.add(keys >> 42, keys & ((1 << 42) - 1), n)

        for batch in batches:
            by: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
            held: Counter = Counter()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())):
                part = text.as_py().translate(_TERM_BYTES)
                by[lang][0].append(source)
                by[lang][1].append(part)
                held[lang] += len(part)
                if held[lang] > 1 << 22:
                    count(lang, *by.pop(lang))
                    held[lang] = 0
            for lang, (sources, parts) in by.items():
                count(lang, sources, parts)
            if tally.size > HELD_NUMBERS // 2:
                yield from tally.rows()
        yield from tally.rows()

    return texts.mapInArrow(work, COUNTS)


DEALT = "lang string, part int, number int, task int, nth long, source string, terms binary, counts array<long>"


def _dealt(texts: DataFrame, shards: DataFrame) -> DataFrame:
    """Counts by transducer, to which the terms of the texts are dealt."""
    rows = shards.select("lang", "part", "number", "first").orderBy("lang", "first").collect()
    sent = texts.sparkSession.sparkContext.broadcast([(r.lang, r.part, r.number, bytes(r["first"])) for r in rows])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        first: dict[str, list[bytes]] = defaultdict(list)
        names: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for lang, part, number, term in sent.value:
            first[lang].append(term)
            names[lang].append((part, number))
        seen: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal nth
            for (lang, source), terms in seen.items():
                to: dict[tuple[int, int], list] = defaultdict(list)
                for term, n in terms.items():
                    at = bisect_right(first[lang], term) - 1
                    if at >= 0:
                        to[names[lang][at]].append((term, n))
                for (part, number), found in to.items():
                    for at in range(0, len(found), PIECE_TERMS):
                        own = found[at : at + PIECE_TERMS]
                        yield _arrow(
                            {
                                "lang": ([lang], pa.string()), "part": ([part], pa.int32()), "number": ([number], pa.int32()), "task": ([task], pa.int32()), "nth": ([nth], pa.int64()),
                                "source": ([source], pa.string()), "terms": ([b" ".join(t for t, _ in own)], pa.binary()), "counts": ([[n for _, n in own]], pa.list_(pa.int64())),
                            }
                        )
                        nth += 1
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())):
                seen[lang, source].update(text.as_py().translate(_TERM_BYTES).split())
                if sum(map(len, seen.values())) > HELD_TERMS:
                    yield from flush()
        yield from flush()

    pieces = staged(texts.mapInArrow(deal, DEALT), "dealt")
    name = ["lang", "part", "number"]
    # A transducer with more than its share of the pieces stands in several tasks.
    ways = staged(pieces.groupBy(*name).agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("ways")), "ways")
    salt = F.pmod(F.xxhash64("task", "nth"), F.col("ways")).cast("int")
    some = pieces.join(ways, name).select(*name, salt.alias("salt"), F.lit(1).alias("after"), "source", "terms", "counts", F.lit(0).cast("long").alias("base"))
    each = F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("salt")
    made = shards.join(ways, name).select(*name, each, F.lit(0).alias("after"), F.lit(None).cast("string").alias("source"), F.col("made").alias("terms"), F.lit(None).cast("array<long>").alias("counts"), "base")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, own, base = _Tally(), None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if not row["after"]:
                    own, base = Transducer.from_bytes(row["terms"]), row["base"]
                    continue
                text = np.frombuffer(row["terms"] + b" ", np.uint8)
                ends = np.flatnonzero(text == 32)
                found = own.ordinals(text, np.append(0, ends[:-1] + 1), ends)
                hit = found >= 0
                code = tally.codes.setdefault((row["lang"], row["source"]), len(tally.codes))
                tally.add(np.full(int(hit.sum()), code), base + found[hit], np.array(row["counts"], np.int64)[hit])
            if tally.size > HELD_NUMBERS // 2:
                yield from tally.rows()
        yield from tally.rows()

    both = made.unionByName(some).repartition(*name, "salt").sortWithinPartitions(*name, "salt", "after")
    return both.mapInArrow(work, COUNTS)


def recounted(texts: DataFrame, shards: DataFrame) -> DataFrame:
    """lang, ordinal, counts (source, n): what each source has of each kept term."""
    size = shards.agg(F.coalesce(F.sum(F.octet_length("made")), F.lit(0))).first()[0]
    by_task = _streamed(texts, shards) if size <= SEND_BYTES else _dealt(texts, shards)
    summed = by_task.repartition("lang", "ordinal").groupBy("lang", "ordinal", "source").agg(F.sum("n").alias("n"))
    return staged(summed.groupBy("lang", "ordinal").agg(F.collect_list(F.struct("source", "n")).alias("counts")), "recounted")


def billionths(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(10**9 * count / total) without a product that leaves 64 bits, three digits at a time."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(4):
        digit = rest // total
        out = out * 1000 + digit
        rest = (rest - digit * total) * 1000
    return out


DEPARTURES = "lang string, source string, other string, ordinal long, share long, value long"


def departures(vectors: DataFrame, sizes: dict[str, tuple[int, dict[str, int]]], top: int) -> DataFrame:
    """By task: sums between sources (other set), and the largest departures from the whole (ordinal set).

    ``sizes`` has of each language how many terms are kept, and of each source how often it has any of them.
    That is one number for each source, and the result has a row for each two.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(sizes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sent.value
        names = {lang: sorted(of) for lang, (_, of) in langs.items()}
        codes = {lang: {s: k for k, s in enumerate(own)} for lang, own in names.items()}
        totals = {lang: np.array([of[s] for s in names[lang]], np.int64) + v for lang, (v, of) in langs.items()}
        sums = {lang: np.zeros((len(own), len(own)), np.int64) for lang, own in names.items()}
        best: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}
        empty = (np.zeros(0, np.int64),) * 3

        def block(lang: str, ordinals: np.ndarray, counts: np.ndarray) -> None:
            share = 1 + billionths(counts + 1, totals[lang])
            for b in range(counts.shape[1]):
                apart = share - share[:, b : b + 1]
                sums[lang][:, b] += (apart * apart // share[:, b : b + 1]).sum(axis=0)
            whole = 1 + billionths(counts.sum(axis=1) + 1, totals[lang].sum() - (len(totals[lang]) - 1) * langs[lang][0])
            apart = share - whole[:, None]
            value = apart * apart // whole[:, None]
            for a in range(counts.shape[1]):
                own = np.flatnonzero((counts[:, a] > 0) & (apart[:, a] > 0))
                found = tuple(np.concatenate(x) for x in zip(best.get((lang, a), empty), (value[own, a], ordinals[own], whole[own])))
                order = np.lexsort((found[1], -found[0]))[:top]
                best[lang, a] = tuple(x[order] for x in found)

        for batch in batches:
            by: dict[str, list[int]] = defaultdict(list)
            for row, lang in enumerate(batch.column("lang").to_pylist()):
                by[lang].append(row)
            for lang, rows in by.items():
                step = max(1, (1 << 20) // len(names[lang]))
                for at in range(0, len(rows), step):
                    own = rows[at : at + step]
                    counts = np.zeros((len(own), len(names[lang])), np.int64)
                    for k, row in enumerate(own):
                        of = batch.column("counts")[row].values
                        counts[k, [codes[lang][s] for s in of.field("source").to_pylist()]] = of.field("n").to_numpy()
                    block(lang, batch.column("ordinal").to_numpy()[own], counts)
        for lang, of in sums.items():
            own = names[lang]
            a, b = (x.ravel().tolist() for x in np.indices(of.shape))
            yield _arrow({"lang": ([lang] * len(a), pa.string()), "source": ([own[k] for k in a], pa.string()), "other": ([own[k] for k in b], pa.string()), "ordinal": ([None] * len(a), pa.int64()), "share": ([None] * len(a), pa.int64()), "value": (of.ravel(), pa.int64())})
        for (lang, a), (value, ordinal, whole) in best.items():
            yield _arrow({"lang": ([lang] * len(value), pa.string()), "source": ([names[lang][a]] * len(value), pa.string()), "other": ([None] * len(value), pa.string()), "ordinal": (ordinal, pa.int64()), "share": (whole, pa.int64()), "value": (value, pa.int64())})

    return vectors.mapInArrow(work, DEPARTURES)


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its distance to each other one
    (``pair``), and the ``top`` terms that it has more of than the language as a whole (``term``)."""
    texts = read(docs)
    kept = staged(kept_terms(texts, least), "kept")
    built = build(kept)
    shards = numbered(built)
    vectors = recounted(texts, shards)
    groups = staged(texts.select("lang", "source").distinct(), "groups")
    had = vectors.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    sizes: dict[str, tuple[int, dict[str, int]]] = {}
    terms = {r.lang: r.n for r in shards.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    for r in groups.join(had, ["lang", "source"], "left").collect():
        sizes.setdefault(r.lang, (terms.get(r.lang, 0), {}))[1][r.source] = r.n or 0
    found = staged(departures(vectors, {k: v for k, v in sizes.items() if v[0]}, top), "departures")
    discard(vectors, kept)

    others = groups.withColumnRenamed("source", "other")
    sums = found.filter("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = groups.join(others, "lang").filter("source != other").join(sums, ["lang", "source", "other"], "left")
    order = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "item")))
    first = found.filter("ordinal is not null").withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "ordinal"))).filter(F.col("rank") <= top)
    places = built.filter("made is null").join(shards.select("lang", "part", "number", "base"), ["lang", "part", "number"])
    named = first.join(places.select("lang", (F.col("base") + F.col("nth")).alias("ordinal"), F.decode("term", "UTF-8").alias("item")), ["lang", "ordinal"])
    return pairs.unionAll(named.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
