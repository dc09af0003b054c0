"""Source audit, best-two-fit packing and spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from itspark.llm import audit, packing, spelling
from itspark.llm.transducer import Transducer
from tests.conftest import rows
from tests.llm.conftest import frame

LABELS = "doc_id long, text string, source string, lang string"


# ---------------------------------------------------------------- audit


def test_transducer_numbers_terms_in_order():
    rng = random.Random(2)
    for letters in ("ab", "abc", "aäöé日"):
        for size in (0, 1, 5, 80):
            terms = sorted({"".join(rng.choices(letters, k=rng.randint(1, 8))).encode() for _ in range(size)})
            made = Transducer.from_bytes(Transducer.of(terms).to_bytes())
            asked = terms + ["".join(rng.choices(letters + "z", k=rng.randint(0, 9))).encode() for _ in range(60)]
            text = np.frombuffer(b"".join(asked) + b" ", np.uint8)
            ends = np.cumsum([len(t) for t in asked])
            starts = ends - [len(t) for t in asked]
            assert made.ordinals(text, starts, ends).tolist() == [terms.index(t) if t in terms else -1 for t in asked]


def test_transducer_is_minimal():
    """Twelve endings shared by all beginnings take the states of one."""
    ends = [f"{a}{b}" for a in "abc" for b in "wxyz"]
    terms = sorted((p + e).encode() for p in ("k", "l", "mn") for e in ends)
    edges = (Transducer.of(terms).keys >= 0).sum()
    assert edges == 4 + 3 + 4  # k l m; n; a b c; w x y z


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def audit_by_hand(docs):
    docs = [(text or "", source or "", lang or "") for _, text, source, lang in docs]
    out = []
    for lang in {d[2] for d in docs}:
        own = [(TERM.findall(lower(t)), s) for t, s, where in docs if where == lang]
        seen = Counter(w for words, _ in own for w in set(words))
        kept = sorted((w for w, n in seen.items() if n >= 3), key=str.encode)
        counts = {s: Counter(w for words, x in own if x == s for w in words if seen[w] >= 3) for s in {s for _, s in own}}
        whole = sum(counts.values(), Counter())

        def share(of):
            total = sum(of.values()) + len(kept)
            return {w: 1 + 10**9 * (of[w] + 1) // total for w in kept}

        p = {s: share(c) for s, c in counts.items()}
        q = share(whole)
        for s in counts:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in counts if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found, 1) if part == "pair" or k <= 200]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def labelled(docs_rows):
    langs = ["en", "de", None, ""]
    more = [(200, None, "alone", "xx"), (201, "1 2 3", "other", "xx"), (202, "ÄÖ Été été", "a", "fr"), (203, "Été ZZ zz", "b", "fr"), (204, "été zz", None, "fr"), (205, "zz " + "word" * 9000, "", "fr")]
    return [(d, t, s, langs[k % 4]) for k, (d, t, s) in enumerate(docs_rows)] + more


@pytest.mark.parametrize("send,terms,held", [(64 << 20, 1 << 17, 2_000_000), (64 << 20, 3, 50), (0, 3, 50)])
def test_audit(monkeypatch, spark, labelled, send, terms, held):
    monkeypatch.setattr(audit, "SEND_BYTES", send)
    monkeypatch.setattr(audit, "SHARD_TERMS", terms)
    monkeypatch.setattr(audit, "HELD_NUMBERS", held)
    monkeypatch.setattr(audit, "HELD_TERMS", held)
    got = audit.audit(frame(spark, labelled, LABELS).repartition(3))
    assert rows(got, "lang", "source", "part", "item", "value", "rank") == audit_by_hand(labelled)


def test_audit_of_nothing(spark):
    assert audit.audit(frame(spark, [], LABELS)).count() == 0
    bare = audit.audit(frame(spark, [(1, None, "a", "en"), (2, "x", "b", "en"), (None, "x", "b", "en")], LABELS))
    assert rows(bare) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_billionths_of_large_counts():
    n, total = np.array([1, 9 * 10**14, 9 * 10**15 - 1]), np.array([9 * 10**15] * 3)
    assert audit.billionths(n, total).tolist() == [10**9 * int(a) // int(b) for a, b in zip(n, total)]


# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_encoder_is_the_library(tokenizer):
    path, model = tokenizer
    encode = packing.encoder(path)
    rng = random.Random(1)
    some = ["a", "b c", " ", "  ", "\n", "é x", " x", "'s 'll", "<|endoftext|>", "1 a", "ß", " ", "　a", "日本 a", "don't", ".", "\t", "\r\n", "\x1c", "\x85", "½", "²", "–", "😀", "ʼ", "a" * 1001, " " * 1001, "​", "Ⅷ", "٣"]
    for text in ("".join(rng.choices(some, k=rng.randint(0, 12))) for _ in range(1500)):
        assert list(encode(text)) == model.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_are_used_as_they_are():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.byte_ranks(path) is None
    assert packing.encoder(path)("Some Words.") == Tokenizer.from_file(path).encode("Some Words.", add_special_tokens=False).ids


def two_fit_by_hand(sizes, capacity):
    """One bin at a time from the list of all pieces."""
    left, bins = sorted(sizes), []
    while left:
        own = []
        while fits := [s for s in left if s <= capacity - sum(own)]:
            own.append(fits[-1])
            left.remove(fits[-1])
        if len(own) > 1 and sum(own) < capacity:
            room = capacity - sum(own) + min(own)
            pairs = [(a + b, a, b) for b, a in itertools.combinations(left, 2) if min(own) < a + b <= room]
            if pairs:
                _, a, b = max(pairs)
                left.remove(a)
                left.remove(b)
                left.append(min(own))
                left.sort()
                own.remove(min(own))
                own += [a, b]
        bins.append(sorted(own, reverse=True))
    return bins


def test_plan_fills_bins_one_by_one():
    rng = random.Random(4)
    replaced = 0
    for _ in range(150):
        capacity = rng.choice([10, 17, 40])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        made = packing.plan(Counter(sizes), capacity)
        bins = defaultdict(list)
        for size, n in Counter(sizes).items():
            for nth in range(n):
                first, times, sequence, offset = made.slots[size][np.searchsorted(made.slots[size][:, 0], nth, side="right") - 1].tolist()
                bins[sequence + (nth - first) % times].append((offset + (nth - first) // times * size, size))
        got = []
        for own in bins.values():
            own.sort()
            assert [o for o, _ in own] == list(itertools.accumulate([s for _, s in own[:-1]], initial=0))
            got.append([s for _, s in own])
        wanted = two_fit_by_hand(sizes, capacity)
        assert sorted(got) == sorted(wanted) and made.n_sequences == len(wanted)
        replaced += any(len(b) > 2 for b in wanted)
    assert replaced


def test_pack(spark, docs, docs_rows, no_docs, tokenizer):
    path, model = tokenizer
    capacity = 64
    packed = packing.pack(docs, path, capacity, body=True)
    expected = []
    for doc_id, text, _ in docs_rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        expected += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert rows(packed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(expected, key=repr)
    bins = defaultdict(list)
    ids = {}
    for r in packed.collect():
        bins[r.sequence_id].append((r.offset, r.length))
        ids[r.sequence_id, r.offset] = r.ids
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == list(itertools.accumulate([n for _, n in own[:-1]], initial=0)) and sum(own[-1]) <= capacity
    assert len(bins) <= 1.02 * sum(n for *_, n, _ in expected) / capacity + 1
    for r in packing.sequences(packed).collect():
        assert r.ids == [x for o, _ in bins[r.sequence_id] for x in ids[r.sequence_id, o]]
    assert packing.pack(no_docs, path).count() == 0


# ---------------------------------------------------------------- spelling


def spelling_by_hand(docs, drop, least=7):
    counts = Counter()
    for doc_id, text, _ in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least and k >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))

    form, found = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        found[w] = len(others)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], found[w], n.get(form[w])))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def misspelt(docs_rows):
    """Frequent words with rarer variants of every kind, chains of them, anagrams and long words."""
    rng = random.Random(8)
    letters = "abcdefghéÀx"
    words = ["".join(rng.choices(letters, k=rng.randint(7, 10))) for _ in range(40)]
    words += ["".join(rng.sample("abcdefghij", 9)) for _ in range(150)]
    text = []
    for k, w in enumerate(words):
        text += [w] * (2 + 1500 * (k % 13 == 0))
        if k % 13 == 0:
            at = rng.randrange(len(w))
            first = w[:at] + "q" + w[at + 1 :]
            text += [first] * 130 + [first[:3] + "z" + first[3:]] * 12 + [w[1:]] * 20 + [w[::-1]] * 3
            text += [first[:3] + "z" + first[3:] + "k"] * 1
    text += ["W" * 300, "w" * 299, "w" * 300, "w" * 299, "w" * 301]
    rng.shuffle(text)
    return docs_rows + [(1000 + k, "; ".join(text[at : at + 100]), "s") for k, at in enumerate(range(0, len(text), 100))]


@pytest.mark.parametrize("cell,leaf,part,drop", [(1 << 15, 1 << 13, 16, 31), (4, 3, 2, 31), (40, 8, 2, 5)])
def test_variants(monkeypatch, spark, misspelt, cell, leaf, part, drop):
    for name, value in (("CELL", cell), ("LEAF", leaf), ("PART", part)):
        monkeypatch.setattr(spelling, name, value)
    got = rows(spelling.variants(frame(spark, misspelt).repartition(3), drop=drop))
    assert got == spelling_by_hand(misspelt, drop)
    assert any(form is not None and root != form for _, form, root, *_ in got)


def test_variants_of_nothing(spark, no_docs):
    assert spelling.variants(no_docs).count() == 0
    assert spelling.variants(frame(spark, [(1, None, "a"), (2, "", "a"), (3, "short words", None)])).count() == 0


def test_words_without_dropping():
    assert spelling.words_of(None, "Éclairs éclairs ABCDEFG abcdefg", drop=0) == Counter({"Éclairs": 1, "éclairs": 1, "abcdefg": 2})
