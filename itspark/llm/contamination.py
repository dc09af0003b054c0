"""Benchmark decontamination with a positional inverted index of the corpus.

The index is made of segments, each of some whole documents: for every test term that occurs in the segment,
the sorted list of its places. A place is the document's number in the segment and the word's number in the
document in one long. Segments are rows of a staged table, about ``SEGMENT_WORDS`` words each (more only for
a longer document), so building and searching need no shuffle and a lost task costs its segments.

A phrase is found by intersecting the lists of its words, moved back by their offsets, from the rarest word
(in the whole corpus) to the commonest; the search ends as soon as nothing is left. A proximity match is a
place of the rarest word with every other word within a given distance. The corpus is indexed once, for all words
whose hash is a test word's; the hashes are a bitmap of one size. The test set is cut into blocks of about
``BLOCK_WINDOWS`` windows that are searched for one after the other, so what is sent to the tasks is bounded
whatever the test set's size. A window is sent and found once, however many items have it: matches carry its key,
and the items join them afterwards.

Cases: a null or empty text has no words, is never hit and never contaminated; items without words have no
windows; repeated items and equal windows of several items each count; repeated documents are judged each;
null ids are kept as null; empty tables give zero counts or no rows. Only ids and texts are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itspark.llm.common import discard, staged, text_key, text_of

WINDOW = 13
MIN_SHARE = 20  # contaminated where at least one word in so many is hit
SEGMENT_WORDS = 1 << 19
BLOCK_WINDOWS = 50_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEGMENTS = "doc_id array<long>, key array<binary>, n_words array<int>, term array<string>, n array<int>, places array<long>"
LOW = 32
#: Hash values of words; the bitmap of those that test words have goes to all tasks.
SLOTS = 1 << 23

#: Bytes that belong to words, after A-Z became a-z: digits, a-z, and every byte of a character beyond ASCII.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANKED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in _LOWER)


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words of ASCII letters, digits and any characters beyond ASCII."""
    return text.translate(_BLANKED).split()


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase): every ``window`` consecutive words, or all of a shorter item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, windows = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = [w.decode() for w in words_of(text)]
                for at in range(max(1, len(words) - window + 1) if words else 0):
                    items.append(item)
                    windows.append(" ".join(words[at : at + window]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.string())], names=["item_id", "phrase"])

    return benchmark.select(F.col("item_id").cast("string"), text_of().alias("text")).mapInArrow(work, "item_id string, phrase string")


def slots_of(words: DataFrame) -> np.ndarray:
    """Bitmap of the hash values that the words (column ``word``) have; ``SLOTS`` bits whatever their number."""
    slots = words.select((F.crc32(F.col("word").cast("binary")) % SLOTS).cast("int").alias("slot")).distinct()
    bits = np.zeros(SLOTS, bool)
    bits[slots.toArrow().column("slot").to_numpy()] = True
    return np.packbits(bits)


def build_index(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """Segments of the corpus with the places of all words whose hash is in the bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(slots)

    class Segment:
        def __init__(self):
            self.ids, self.keys, self.counts, self.found, self.at = [], [], [], [], []
            self.codes: dict[bytes, int] = {}
            self.names: list[bytes] = []
            self.held = 0

        def add(self, doc_id, key: bytes, words: list[bytes], bits: np.ndarray) -> None:
            for word in set(words).difference(self.codes):
                slot = zlib.crc32(word) % SLOTS
                if bits[slot >> 3] >> (7 - (slot & 7)) & 1:
                    self.codes[word] = len(self.names)
                    self.names.append(word)
                else:
                    self.codes[word] = -1
            hits = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
            places = np.flatnonzero(hits >= 0)
            self.found.append(hits[places])
            self.at.append(places + (len(self.ids) << LOW))
            self.ids.append(doc_id)
            self.keys.append(key)
            self.counts.append(len(words))
            self.held += len(words)

        def batch(self) -> pa.RecordBatch:
            codes, places = np.concatenate(self.found), np.concatenate(self.at)
            order = np.argsort(codes, kind="stable")
            codes, places = codes[order], places[order]
            firsts = np.flatnonzero(np.diff(codes, prepend=-1))
            sizes = np.diff(np.append(firsts, len(codes)))
            values = [self.ids, self.keys, self.counts, [self.names[c].decode() for c in codes[firsts]], sizes.tolist(), places]
            types = [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["doc_id", "key", "n_words", "term", "n", "places"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, segment = sent.value, Segment()
        for batch in batches:
            for doc_id, key, text in zip(batch.column("doc_id"), batch.column("key"), batch.column("text").cast(pa.binary())):
                segment.add(doc_id.as_py(), key.as_py(), words_of(text.as_py()), bits)
                if segment.held >= SEGMENT_WORDS:
                    yield segment.batch()
                    segment = Segment()
        if segment.ids:
            yield segment.batch()

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), text_of().alias("text")).mapInArrow(work, SEGMENTS)


def term_counts(index: DataFrame) -> DataFrame:
    """term, n: how often each indexed word occurs in the corpus."""
    terms = index.select(F.explode(F.arrays_zip("term", "n")).alias("t"))
    return terms.groupBy("t.term").agg(F.sum("t.n").alias("n"))


def rarest_first(words: list[str], counts: dict[str, int]) -> list[tuple[int, str]]:
    """(offset, word) of a phrase, the rarest word in the corpus first."""
    return sorted(enumerate(words), key=lambda x: (counts.get(x[1], 0), x[0]))


def phrase_places(lists: dict[str, np.ndarray], ordered: list[tuple[int, str]]) -> np.ndarray:
    """Places where the words stand in a row."""
    left = None
    for offset, word in ordered:
        places = lists.get(word)
        if places is None:
            return np.zeros(0, np.int64)
        moved = places - offset
        left = moved if left is None else left[_within(moved, left)]
        if not len(left):
            break
    return left


def near_places(lists: dict[str, np.ndarray], ordered: list[tuple[int, str]], distance: int) -> np.ndarray:
    """Places of the rarest word that have each other word at most ``distance`` words away in the same document."""
    left = None
    for word in dict.fromkeys(w for _, w in ordered):
        places = lists.get(word)
        if places is None:
            return np.zeros(0, np.int64)
        if left is None:
            left = places
            continue
        after = np.minimum(np.searchsorted(places, left), len(places) - 1)
        before = np.maximum(after - 1, 0)
        # Places in different documents are 2**32 apart less a text's words, which are far fewer than that.
        close = np.minimum(np.abs(places[after] - left), np.abs(places[before] - left)) <= distance
        left = left[close]
        if not len(left):
            break
    return left


def _within(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted


def search(index: DataFrame, phrases: list[tuple[bytes, str]], counts: dict[str, int], distance: int | None = None) -> DataFrame:
    """Matches of a block of (key, phrase): id and content key of the document, the word and length of the phrase
    (1 for a proximity match, at its rarest word) and the phrase's key."""
    sent = index.sparkSession.sparkContext.broadcast((phrases, counts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, rank = sent.value
        ordered = [(rarest_first(phrase.split(" "), rank), key) for key, phrase in queries]
        for batch in batches:
            for row in range(batch.num_rows):
                terms, sizes = (batch.column(c)[row].as_py() for c in ("term", "n"))
                places = batch.column("places")[row].values.to_numpy()
                ends = np.cumsum(sizes)
                lists = {t: places[e - n : e] for t, n, e in zip(terms, sizes, ends)}
                at, lengths, keys = [], [], []
                for words, key in ordered:
                    found = phrase_places(lists, words) if distance is None else near_places(lists, words, distance)
                    at.extend(found.tolist())
                    lengths.extend([len(words) if distance is None else 1] * len(found))
                    keys.extend([key] * len(found))
                owners = pa.array([p >> LOW for p in at], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c)[row].values.take(owners) for c in ("doc_id", "key")),
                        pa.array([p & ((1 << LOW) - 1) for p in at], pa.int32()),
                        pa.array(lengths, pa.int32()),
                        pa.array(keys, pa.binary()),
                    ],
                    names=["doc_id", "key", "word", "length", "phrase"],
                )

    return index.mapInArrow(work, "doc_id long, key binary, word int, length int, phrase binary")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, distance: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, key, n_words), all matches of the test set's windows in them (doc_id, key, word,
    length, phrase), and the items of each window (phrase, item_id), each pair once.

    Matches name a document by its id and content key: rows that agree in both have the same matches. They name
    a window by the 16-byte key of its words.
    """
    windows = test_windows(benchmark, window).distinct().withColumnRenamed("phrase", "words")
    windows = staged(windows.select("item_id", "words", F.unhex(F.md5("words")).alias("phrase")), "windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    words = F.explode(F.split("words", " ")).alias("word")
    index = staged(build_index(docs, slots_of(windows.select(words))), "index")
    listed = staged(index.select(F.explode(F.arrays_zip("doc_id", "key", "n_words")).alias("d")).select("d.*"), "listed")
    numbers = staged(term_counts(index), "terms")
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        of_block = numbered.filter(F.col("block") == block).select("phrase", "words").distinct()
        phrases = [(bytes(r.phrase), r.words) for r in of_block.collect()]
        # No more rows than the block's windows have words.
        counts = {r.term: r.n for r in numbers.join(of_block.select(words.alias("term")).distinct(), "term", "left_semi").collect()}
        more = staged(search(index, phrases, counts, distance), "matches")
        found = more if found is None else found.unionAll(more)
    discard(index, numbers)
    return listed, found, windows.select("phrase", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = MIN_SHARE) -> DataFrame:
    """doc_id, key (of the text), n_words, n_hit, n_items, items, contaminated: one row per document.

    A word is hit if it lies inside an occurrence of a window. Contaminated: some word is hit, and at least
    one in ``min_share``.
    """
    docs = docs.select("doc_id", "text")
    listed, found, owners = matches(docs, benchmark, window)
    document = [F.col("doc_id").alias("_id"), F.col("key").alias("_key")]
    # Occurrences of one document, in order: a word counts once, from where the one before it ended.
    spans = found.groupBy(*document).agg(F.array_sort(F.collect_set(F.struct("word", (F.col("word") + F.col("length")).alias("end")))).alias("spans"))
    pairs = found.select(*document, "phrase").distinct().join(owners, "phrase").select("_id", "_key", "item_id").distinct()
    items = pairs.groupBy("_id", "_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    n_hit = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'upto', 0), "
        "(a, s) -> named_struct('n', a.n + greatest(s.end - greatest(s.word, a.upto), 0), 'upto', greatest(a.upto, s.end)), a -> a.n)"
    )
    same = F.col("s._id").eqNullSafe(F.col("i._id")) & (F.col("s._key") == F.col("i._key"))
    both = spans.alias("s").join(items.alias("i"), same, "left")
    hits = staged(both.select("s._id", "s._key", n_hit.alias("n_hit"), "items"), "hits")
    joined = listed.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    n_words, hit = F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "key", n_words.alias("n_words"), hit.alias("n_hit"),
        F.size(F.coalesce("items", F.array())).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((hit > 0) & (min_share * hit >= n_words)).alias("contaminated"),
    )
