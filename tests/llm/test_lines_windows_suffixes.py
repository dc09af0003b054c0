"""Line, window and byte-string dedup against brute force."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from itspark.llm import common, grams, lines, suffixes, windows
from tests.conftest import rows


def sha(data):
    return hashlib.sha256(data).hexdigest()


def text_bytes(text):
    return (text or "").encode()


def lines_by_hand(data, min_docs, min_chars=1, keep_first=False):
    seen = Counter()
    for _, text, _ in data:
        keys = {x.strip().lower() for x in text_bytes(text).split(b"\n")}
        seen.update(k for k in keys if len(k.decode()) >= min_chars)
    first = {}
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is not None, data[i][0] or 0, hashlib.md5(text_bytes(data[i][1])).digest()))
    for i in order:
        for at, x in enumerate(text_bytes(data[i][1]).split(b"\n")):
            first.setdefault(x.strip().lower(), (data[i][0], data[i][1], at))
    out = []
    for doc_id, text, _ in data:
        kept, n = [], text_bytes(text).split(b"\n")
        for at, x in enumerate(n):
            key = x.strip().lower()
            if seen[key] < min_docs or (keep_first and first[key] == (doc_id, text, at)):
                kept.append(x)
        out.append((doc_id, len(n), len(n) - len(kept), sha(b"\n".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs,keep_first", [(10, False), (2, False), (1, True), (3, True)])
def test_lines(docs, docs_rows, min_docs, keep_first):
    got = lines.apply_bitmaps(docs, min_docs, keep_first=keep_first, body=False).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert rows(got) == lines_by_hand(docs_rows, min_docs, keep_first=keep_first)


def test_lines_keep_the_row_and_min_chars(spark, docs, docs_rows):
    got = lines.apply_bitmaps(docs, 2, min_chars=14)
    assert set(docs.columns) == {f.name for f in got.schema["row"].dataType}
    assert rows(got.select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")) == lines_by_hand(docs_rows, 2, 14)
    assert rows(got.select(F.sha2("kept_text", 256))) == rows(got.select("kept_sha256"))


def test_a_line_in_every_range(spark):
    """A line of all documents spans ranges, and those at the ends are judged by their sums."""
    data = [(i, f"hot\nown {i}\npair {i // 2}\nnine {i // 9}", None) for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = lines.apply_bitmaps(df, 9, body=False).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert rows(got) == lines_by_hand(data, 9)


def repeats_by_hand(data, length, split, join):
    sequences = [split(text_bytes(t)) for _, t, _ in data]
    seen = Counter(join(s[p : p + length]) for s in sequences for p in range(len(s) - length + 1))
    out = []
    for (doc_id, _, _), s in zip(data, sequences):
        gone = np.zeros(len(s) + 1, bool)
        for p in range(len(s) - length + 1):
            if seen[join(s[p : p + length])] > 1:
                gone[p : p + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out.append((doc_id, len(s), int(gone.sum()), spans, sha(join([x for x, g in zip(s, gone) if not g]))))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_units", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("length,size", [(200, 64), (40, 30), (24, 9)])
def test_byte_strings(docs, docs_rows, length, size):
    got = suffixes.remove_repeated_bytes(docs, length, size)
    assert rows(got, *COLUMNS) == repeats_by_hand(docs_rows, length, lambda t: t, bytes)


@pytest.mark.parametrize("length,size", [(35, 18), (6, 3)])
def test_word_windows(docs, docs_rows, length, size):
    got = windows.remove_repeated_windows(docs, length, size)
    assert rows(got, *COLUMNS) == repeats_by_hand(docs_rows, length, bytes.split, b" ".join)


@pytest.mark.parametrize("cells,held", [(64, 40), (1 << 12, 4_000_000), (8, 1)])
def test_sketch_by_ranges_loses_nothing(monkeypatch, docs, docs_rows, cells, held):
    monkeypatch.setattr(windows, "RANGE", cells)
    monkeypatch.setattr(windows, "HELD", held)
    got = windows.remove_repeated_windows(docs, 12, 7)
    assert rows(got, *COLUMNS) == repeats_by_hand(docs_rows, 12, bytes.split, b" ".join)


def test_texts_are_gone_in_the_end(spark, docs):
    """Also if the work fails; and there are no more buckets than Spark takes."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ZeroDivisionError):
        with common.Texts(docs) as texts:
            assert texts.table().count() > 0 and os.path.isdir(texts.path)
            1 / 0
    assert not os.path.isdir(texts.path) and not spark.catalog.tableExists(texts.name)
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, "MAX_BUCKETS", 7)
            with common.Texts(docs.coalesce(1).limit(0)) as texts:
                assert "Num Buckets" in str(spark.sql(f"DESCRIBE EXTENDED {texts.name}").filter("col_name = 'Num Buckets' and data_type = '7'").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_brief_shuffles_end_with_the_block(spark):
    before = spark.conf.get(common.BRIEF, "false")
    with pytest.raises(ZeroDivisionError):
        with common.brief_shuffles(spark):
            made = common.staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "brief")
            assert spark.conf.get(common.BRIEF) == "true" and made.join(made.select("k"), "k").count() == 7
            1 / 0
    assert spark.conf.get(common.BRIEF) == before and made.count() == 7


def test_removed_spans_and_text(docs, docs_rows):
    got = windows.remove_repeated_windows(docs, body=True).collect()
    for r in got:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed
        assert sha(bytes(r.kept_text)) == r.kept_sha256 and len(r.kept_text.split()) == r.n_units - r.n_removed


@pytest.mark.parametrize("run", [lambda d: lines.apply_bitmaps(d), suffixes.remove_repeated_bytes, windows.remove_repeated_windows])
def test_empty_tables(no_docs, run):
    assert run(no_docs).count() == 0


def test_anchors_of_equal_windows_agree():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 3000, dtype=np.uint8))
    text += text[500:900] + b"a" * 150
    core, anchor, lo, hi = grams.anchors(grams.BYTE_CODES[np.frombuffer(text, np.uint8)], 50, 20)
    of = {p: a for a, x, y in zip(anchor.tolist(), lo.tolist(), hi.tolist()) for p in range(x, y + 1)}
    assert sorted(of) == list(range(len(text) - 49)) and all(p <= a <= p + 30 for p, a in of.items())
    by_window = {}
    for p, a in of.items():
        assert by_window.setdefault(text[p : p + 50], a - p) == a - p
    assert len({text[a : a + 20] for a in anchor.tolist()}) == len(set(core.tolist()))


def test_long_sequences_in_pieces(monkeypatch):
    codes = grams.BYTE_CODES[np.random.default_rng(4).integers(0, 256, 2000)]
    whole = grams.anchors(codes, 60, 20)
    monkeypatch.setattr(grams, "POSITION_BITS", 9)
    parts = grams.anchors(codes, 60, 20)

    def starts(found):
        return {p: a for a, x, y in zip(*(v.tolist() for v in found[1:])) for p in range(x, y + 1)}

    assert starts(whole).keys() == starts(parts).keys()
