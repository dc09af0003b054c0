"""Mixing, decontamination, token counts, near-duplicates, chat, archives and quality rules against brute force."""

import gzip
import hashlib
import itertools
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from itspark.llm import chat, components, contamination, mixing, rules, simhash, tokens, warc
from tests.conftest import rows
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- mixing


def targets_by_hand(size_of, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, held = {}, set()
    left = share * sum(size_of.values())
    while True:
        free = [s for s in order if s not in held]
        rate = (left - sum(most * size_of[s] for s in held)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if most * size_of[s] <= weight[s] * rate}
        if not above:
            return {s: float(most * size_of[s]) if s in held else weight[s] * rate for s in order}
        held |= above


def test_mix(spark, docs, docs_rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(docs_rows)
    size_of = Counter()
    for _, text, source in docs_rows:
        size_of[source] += len(WORD.findall(text or ""))
    goal = targets_by_hand(size_of)
    taken = Counter()
    for r in got:
        assert (r.source_size, r.target) == (size_of[r.source], pytest.approx(goal[r.source]))
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    again = mixing.mix(docs.repartition(7)).select("doc_id", "size", "taken")
    assert rows(again) == rows(mixing.mix(docs).select("doc_id", "size", "taken"))


def test_mix_without_words_or_rows(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    empty = frame(spark, [(1, None, "a"), (2, "", None)])
    assert [(r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0.0, 0), (0.0, 0)]


# ---------------------------------------------------------------- decontamination


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contamination_by_hand(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        for at in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[at : at + 13])].add(str(item))
    out = []
    for doc_id, text, _ in docs:
        w, hit, found = item_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                if tuple(w[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
                    found |= windows[tuple(w[at : at + size])]
        out.append((doc_id, len(w), len(hit), len(found), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(docs_rows):
    texts = [docs_rows[k][1].upper() for k in (0, 9, 20)]
    short = [" ".join(item_words(docs_rows[k][1])[2:7]) for k in (5, 30)]
    return [*enumerate(texts + short), (50, texts[0]), (50, texts[0]), (60, None), (61, ""), (62, "nowhere to be found"), (None, texts[1]), (7, "Ärger ö")]


@pytest.mark.parametrize("block,segment", [(50_000, 1 << 19), (20, 300)])
def test_contamination(monkeypatch, spark, docs, docs_rows, items, block, segment):
    monkeypatch.setattr(contamination, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(contamination, "SEGMENT_WORDS", segment)
    items = [x for x in items if x[0] is not None]
    got = contamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == contamination_by_hand(docs_rows, items)


def test_contamination_of_nothing(spark, docs, no_docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contamination(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert {(r.n_hit, r.contaminated) for r in contamination.contamination(docs, none).collect()} == {(0, False)}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare a b c"), (2, "a x x x x rare b c"), (3, "c b rare a rare"), (4, "rare b"), (5, "a b c")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b c rare")], "item_id long, text string")
    _, found, owners = contamination.matches(docs, item, distance=3)
    # "a" is the rarest word of the item here: 5 words from "rare" in the second text, at most 3 in the others.
    assert rows(found.join(owners, "phrase"), "doc_id", "word", "length", "item_id") == [(1, 1, 1, "1"), (3, 3, 1, "1")]


def test_a_window_of_very_many_items_is_searched_for_once(spark):
    shared = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"x {shared} y"), (2, f"{shared} {shared}"), (None, shared), (4, "w1 w2")], "doc_id long, text string")
    items = spark.range(30_000).select(F.col("id").alias("item_id"), F.lit(shared).alias("text"))
    _, found, owners = contamination.matches(docs, items)
    assert found.count() == 4 and owners.count() == 30_000
    got = rows(contamination.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "contaminated"))
    assert got == sorted([(1, 15, 13, 30_000, True), (2, 26, 26, 30_000, True), (None, 13, 13, 30_000, True), (4, 2, 0, 0, False)], key=repr)


@pytest.mark.parametrize("slots", [1, 8, 1 << 23])
def test_words_that_share_a_hash_do_no_harm(monkeypatch, spark, docs, docs_rows, items, slots):
    monkeypatch.setattr(contamination, "SLOTS", slots)
    items = [x for x in items if x[0] is not None]
    got = contamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == contamination_by_hand(docs_rows, items)


def test_the_corpus_is_read_once_whatever_the_blocks(monkeypatch, spark, docs, items):
    monkeypatch.setattr(contamination, "BLOCK_WINDOWS", 2)
    built, build = [], contamination.build_index
    monkeypatch.setattr(contamination, "build_index", lambda *a: built.append(1) or build(*a))
    contamination.matches(docs, spark.createDataFrame([x for x in items if x[0] is not None][:3], "item_id long, text string"))
    assert built == [1]


# ---------------------------------------------------------------- tokens


def test_token_counts(spark, docs, docs_rows, no_docs, tmp_path):
    import public_tokenizers
    import sentencepiece

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = sorted(((i, len((t or "").encode()), n, n > 100) for (i, t, _), n in ((r, len(model.encode(r[1] or ""))) for r in docs_rows)), key=repr)
    assert tokens.token_counts(no_docs, path, cache).count() == 0
    assert rows(tokens.token_counts(docs, path, cache, limit=100)) == expected
    stored = spark.read.parquet(cache)
    distinct = len({t or "" for _, t, _ in docs_rows})
    assert stored.count() == distinct
    # what is stored is believed, and only misses are encoded
    more = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(900, "quite new"), (901, "quite new")], "doc_id long, text string"))
    tokens.encode_misses(more, path, cache)
    assert spark.read.parquet(cache).count() == distinct + 1
    # another tokenizer finds nothing stored
    other = public_tokenizers.path("byte_bpe_50k.json")
    tokens.encode_misses(docs, other, cache)
    assert spark.read.parquet(cache).count() == 2 * distinct + 1


# ---------------------------------------------------------------- near-duplicates


def print_by_hand(text, width=4):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    votes = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        votes.update(k for k in range(64) if h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(grams))


def groups_by_hand(prints, max_bits):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= max_bits:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_groups(docs, docs_rows):
    prints = [print_by_hand(t) for _, t, _ in docs_rows]
    root = groups_by_hand(prints, 4)
    lowest = {}
    for (doc_id, _, _), r in zip(docs_rows, root):
        lowest[r] = min((x for x in (lowest.get(r), doc_id) if x is not None), default=None)
    expected = sorted(((d, f"{p:016x}", lowest[r]) for (d, _, _), p, r in zip(docs_rows, prints, root)), key=repr)
    got = simhash.groups(docs).select("doc_id", F.lower(F.hex("fingerprint")), "component_id")
    assert rows(got) == expected


def test_large_groups_are_cut_and_complete(monkeypatch, spark):
    """Fingerprints around a few centres, in chunks much smaller than the groups."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "LEAF", 4)
    rng = random.Random(2)
    prints = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(60):
            prints.add(at)
            for k in rng.sample(range(64), 3):
                at ^= 1 << k
            if rng.random() < 0.3:
                at = rng.choice(sorted(prints))
    prints = sorted(prints)
    nodes = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in enumerate(prints)], "node long, fingerprint binary")
    got = dict(rows(components.components(simhash.links(nodes, simhash.EXACT))))
    assert [got.get(i, i) for i in range(len(prints))] == groups_by_hand(prints, 4)


@pytest.mark.parametrize("n", [1, 10**7, 10**10, 10**12])
def test_keys_of_any_length_lose_no_link(monkeypatch, docs, docs_rows, n):
    """Keys as they are for n fingerprints: groups are the same."""
    real = simhash.tables
    monkeypatch.setattr(simhash, "tables", lambda plan, _: real(plan, n))
    root = groups_by_hand([print_by_hand(t) for _, t, _ in docs_rows], 4)
    expected = Counter(root).values()
    assert sorted(Counter(r.root for r in simhash.groups(docs).select("root").collect()).values()) == sorted(expected)


def test_keys_follow_the_number_of_fingerprints():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    counts = []
    for n in (10**6, 10**8, 10**10, 10**12):
        keys = simhash.tables(simhash.EXACT, n)
        shared = np.zeros(len(a), bool)
        for key in keys:
            bits = sum(size for *_, size in key)
            x, y = (simhash.in_front(v, key) for v in (a, b))
            assert len(np.unique(x)) == len(np.unique(a)) and (np.bitwise_count(x) == np.bitwise_count(a)).all()
            shared |= x >> np.uint64(64 - bits) == y >> np.uint64(64 - bits)
        assert shared.all()
        # Unrelated fingerprints that each is compared with.
        counts.append(sum(n / 2 ** sum(size for *_, size in key) for key in keys))
    assert max(counts[:3]) < 70 * simhash.CHUNK
    assert [len(simhash.tables(simhash.SIMILAR, n)) for n in (1, 10**8, 10**12)] == [24, 18, 12]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 200), (300, 400), (7, 7), (1000, 40)] + [(500, 501 + k) for k in range(30)]
    random.Random(1).shuffle(chain)
    got = dict(rows(components.components(spark.createDataFrame(chain, "u long, v long"))))
    assert got == {**{k: 0 for k in (*range(41), 1000)}, **{k: 100 for k in (100, 200, 300, 400)}, **{k: 500 for k in range(500, 531)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(docs, no_docs, docs_rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    copies = [d for d, t in texts if t == docs_rows[3][1]]
    assert copies == [3]
    near = [d for d, t in texts if d is not None and (d == 9 or 120 <= d < 126)]
    assert near == [9]
    assert len([t for _, t in texts if not (t or "").split()]) == 1
    assert simhash.keep_one(no_docs).count() == 0 and simhash.groups(no_docs).count() == 0


def test_majority_of_long_fingerprints():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2)
    got = simhash.majority(hashes, np.array([20, 0, 30]), 2)
    for k, part in ((0, hashes[:20]), (2, hashes[20:])):
        bits = [sum(int(h) >> b & 1 for h in part) * 2 > len(part) for b in range(64)]
        assert int(got[k, 0]) == sum(1 << b for b in range(64) if bits[b])
    assert got[1].tolist() == [0, 0] and got[0, 1] != got[0, 0]


# ---------------------------------------------------------------- chat


def cheapest(roles, costs=chat.Costs()):
    """Smallest cost over all choices of roles and merges, inserting as few turns as are needed."""
    legal_next = {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}

    def gap(a, b):
        """Turns missing between two that follow each other, or None."""
        if b in legal_next[a]:
            return 0
        return 1 if b in {c for x in legal_next[a] for c in legal_next[x]} else None

    best = None
    for chosen in itertools.product(("system", "user", "assistant"), repeat=len(roles)):
        cost, last = 0, ""
        for given, role in zip(roles, chosen):
            cost += 0 if given == role else costs.relabel if given in ("system", "user", "assistant") else costs.name
            ways = [costs.merge] if role == last else []
            missing = gap(last, role)
            if missing is not None:
                ways.append(missing * costs.insert)
            if not ways:
                cost = None
                break
            cost, last = cost + min(ways), role
        if cost is not None:
            cost += costs.insert * {"": 0, "system": 2, "user": 1, "assistant": 0}[last]
            best = cost if best is None else min(best, cost)
    return best


def conversations():
    rng = random.Random(8)
    names = ["system", "user", "assistant", "user", "assistant", None, "bot"]
    data = [(c, t, rng.choice(names), rng.choice([None, "", f"text {c} {t}"])) for c in range(40) for t in range(rng.randint(1, 6))]
    data += [(100, t, rng.choice(names[1:5]), f"t{t}") for t in range(300)] + [(None, 1, "user", "a"), (None, 1, "user", "a"), (None, None, "assistant", "b")]
    rng.shuffle(data)
    return data


def test_chat_repair(spark):
    data = conversations()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("clash"))
    got = chat.repair(df).collect()
    assert len(got) == len(data)
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r.turn, r.role))
    for conv, turns in by.items():
        turns.sort(key=order)
        closing = sum(2 * len(t.inserted_after) for t in turns)
        total = sum(t.cost for t in turns) + closing
        if len(turns) <= 6:
            assert total == cheapest([t.role for t in turns]), conv
        said = []
        for t in turns:
            said += [*t.inserted_before] if t.merged else [*t.inserted_before, t.new_role]
            said += t.inserted_after
        body = said[1:] if said[0] == "system" else said
        assert body == ["user", "assistant"] * (len(body) // 2) and len(body) % 2 == 0
        text = "".join(t.rendered for t in turns)
        assert re.findall(r"<\|(\w+)\|>\n", text.replace("<|end|>\n", "")) == said and text.count("<|end|>") == len(said)


def test_a_conversation_over_all_ranges_costs_the_least(spark):
    data = [r for r in conversations() if r[0] == 100]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = chat.repair(df).collect()
    reached, _ = chat.forward([r[2] for r in sorted(data, key=lambda r: r[1])], chat.from_state(0), chat.Costs(), {})
    least = min(c + e for c, e in zip(reached, chat.closing(chat.Costs())))
    assert sum(r.cost + 2 * len(r.inserted_after) for r in got) == least
    assert chat.repair(spark.createDataFrame([], df.schema)).count() == 0


# ---------------------------------------------------------------- archives


def test_archives(spark, tmp_path):
    long = "<p>same</p>" * 20
    pages = [(k, f"http://x/{k} a?q=ü", long) for k in (9, 4, 7)] + [(1, None, None), (2, "http://y", ""), (3, "http://y", "short"), (5, "http://y", "short")]
    pages += [(None, "http://n", long), (-6, "http://m", "\r\n\r\nWARC/1.1\r\n ü €\n" * 10), (2**62, "http://b", long), (4, "http://again", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(2)
    for version in (1, 2):
        warc.to_arc(df.filter(F.coalesce("page_id", F.lit(0)) % 2 == version - 1), str(tmp_path / f"arc{version}"), version)
    warc.convert(spark, [str(tmp_path / "arc1"), str(tmp_path / "arc2")], str(tmp_path / "warc"))
    got = warc.read_warc(spark, str(tmp_path / "warc"))
    expected = []
    for page, url, html in pages:
        raw = (html or "").encode()
        revisit = html == long and page != 4
        expected.append((page, url, "revisit" if revisit else "response", 4 if revisit else None, hashlib.sha256(raw).hexdigest(), len(raw), None if revisit else html or ""))
    columns = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", F.col("payload").cast("string"))
    assert rows(got, *columns) == sorted(expected, key=repr)
    assert {r.date for r in got.select("date").collect()} == {"2024-01-01T00:00:00Z"}


@pytest.mark.parametrize("zipped", [True, False])
def test_archives_with_a_member_for_each_record(spark, tmp_path, zipped):
    pack = gzip.compress if zipped else bytes
    records = [warc.arc_record(1, k, f"http://a/{k}", "x" * k).removeprefix(warc.version_block(1) + "\n").encode() + b"\n" for k in range(5)]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc.gz").write_bytes(b"".join(map(pack, [warc.version_block(1).encode() + b"\n", *records])))
    warc.convert(spark, [str(tmp_path / "arc")], str(tmp_path / "once"))
    (tmp_path / "warc").mkdir()
    made = [warc._unzipped(f.read_bytes()) for f in (tmp_path / "once").glob("part-*")]
    # Cut before every record and zipped again, one member each.
    again = [b"WARC/1.1\r\n" + r for data in made for r in data.split(b"WARC/1.1\r\n")[1:]]
    (tmp_path / "warc" / "a.warc.gz").write_bytes(b"".join(map(pack, again)))
    got = warc.read_warc(spark, str(tmp_path / "warc"))
    assert rows(got, "page_id", "url", F.col("payload").cast("string")) == [(k, f"http://a/{k}", "x" * k) for k in range(5)]
    with pytest.raises(ValueError, match="inside a gzip member"):
        warc._unzipped(gzip.compress(b"abc" * 99)[:-9])


def test_archives_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.to_arc(df, str(tmp_path / "arc"), 1)
    warc.convert(spark, [str(tmp_path / "arc")], str(tmp_path / "warc"))
    assert warc.read_warc(spark, str(tmp_path / "warc")).count() == 0


def test_arc_headers():
    old = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain 69\n1 0 X\nURL IP-address Archive-date Content-type Archive-length\n\n\n\n"
    body = b"HTTP/1.0 200 OK\n\nhi\n"
    one = b"\nhttp://a/ 1.2.3.4 19970102030405 text/html %d\n%s\n" % (len(body), body)
    start = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain "
    block = b"1 0 X\nURL IP-address Archive-date Content-type Archive-length\n"
    data = start + b"%d\n" % len(block) + block + one + one
    assert [(r["URL"], r["Archive-date"], r["body"]) for r in warc.parse_arc(data)] == [(b"http://a/", b"19970102030405", body)] * 2
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.parse_arc(data[:-9]))
    with pytest.raises(ValueError, match="fields"):
        list(warc.parse_arc(start + b"%d\n" % len(block) + block + b"\nhttp://a/ 1.2.3.4 19970102030405 text/html 200 - 3\nabc\n"))
    assert old and warc._iso("19970102") == "1997-01-02T00:00:00Z"
    spaces = start + b"%d\n" % len(block) + block + b"\nhttp://a/b c 1.2.3.4 19970102030405 text/html 3\nabc\n"
    assert [r["URL"] for r in warc.parse_arc(spaces)] == [b"http://a/b c"]


def arc_file(version, records):
    """An archive as crawlers wrote it: (url, date, type, body)."""
    out = [warc.version_block(version).encode() + b"\n"]
    for url, date, kind, body in records:
        more = b"" if version == 1 else b" 200 - - 0 old.arc"
        out.append(b"%s 1.2.3.4 %s %s%s %d\n%s\n" % (url, date, kind, more, len(body), body))
    return out


IMAGE = b"HTTP/1.0 200 OK\r\nContent-Type: image/gif\r\n\r\nGIF89a" + bytes(range(256)) * 3


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("member_each", [True, False])
def test_archives_as_crawlers_wrote_them(spark, tmp_path, monkeypatch, version, member_each):
    """Bare line feeds, images, names looked up, no declared length, one payload at two dates and in two files."""
    monkeypatch.setattr(warc, "HELD_BYTES", 500)
    monkeypatch.setattr(warc, "STEP", 100)
    page = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n" + b"<p>same</p>" * 20
    dns = b"20050101000000\na.org.\t3600\tIN\tA\t1.2.3.4\n" + b"x" * 200
    first = [(b"http://a/img", b"20050102000000", b"image/gif", IMAGE), (b"http://a/", b"20050103000000", b"text/html", page), (b"dns:a.org", b"20050101000000", b"text/dns", dns)]
    second = [
        (b"http://a/", b"20040103000000", b"text/html", page), (b"http://b/ c", b"20060103000000", b"text/html", page.replace(b"\n", b"\r\n", 3)),
        (b"dns:a.org", b"20050101000000", b"text/dns", dns), (b"http://e/", b"20050101", b"text/html", b"HTTP/1.0 404 Not Found\r\n"), (b"http://f/", b"20050101", b"no-type", b""),
    ]
    (tmp_path / "arc").mkdir()
    for name, records in (("one.arc.gz", first), ("two.arc.gz", second)):
        parts = arc_file(version, records)
        (tmp_path / "arc" / name).write_bytes(b"".join(map(gzip.compress, parts)) if member_each else gzip.compress(b"".join(parts)))
    warc.convert(spark, [str(tmp_path / "arc")], str(tmp_path / "warc"))
    made = [r for f in (tmp_path / "warc").glob("part-*") for r in warc.parse_warc(f.read_bytes() if f.suffix != ".gz" else warc._unzipped(f.read_bytes()))]
    ids = [f["warc-record-id"] for f, _ in made]
    assert len(made) == len(set(ids)) == 8
    kinds = {(f["warc-target-uri"], f["warc-date"]): (f["warc-type"], f["content-type"]) for f, _ in made}
    response = "application/http; msgtype=response"
    assert kinds == {
        ("http://a/img", "2005-01-02T00:00:00Z"): ("response", response), ("http://a/", "2004-01-03T00:00:00Z"): ("response", response),
        ("http://a/", "2005-01-03T00:00:00Z"): ("revisit", response), ("http://b/ c", "2006-01-03T00:00:00Z"): ("revisit", response),
        ("dns:a.org", "2005-01-01T00:00:00Z"): ("resource", "text/dns"), ("http://e/", "2005-01-01T00:00:00Z"): ("response", response),
        ("http://f/", "2005-01-01T00:00:00Z"): ("resource", "no-type"),
    }
    origin = next(f["warc-record-id"] for f, _ in made if f["warc-date"].startswith("2004"))
    assert {f["warc-refers-to"] for f, _ in made if f["warc-type"] == "revisit"} == {origin}
    assert next(b for f, b in made if f["warc-target-uri"] == "http://a/img") == IMAGE
    got = warc.read_warc(spark, str(tmp_path / "warc"))
    body = page.split(b"\n\n")[1]
    expected = [("http://a/img", "response", IMAGE[IMAGE.index(b"GIF") :]), ("http://a/", "response", body), ("http://a/", "revisit", body), ("http://b/ c", "revisit", body)]
    expected += [("dns:a.org", "resource", dns)] * 2 + [("http://e/", "response", b""), ("http://f/", "resource", b"")]
    wanted = [(u, k, None, hashlib.sha256(p).hexdigest(), len(p), None if k == "revisit" else p) for u, k, p in expected]
    assert sorted(((r.url, r.record_type, r.page_id, r.payload_digest, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in got.collect()), key=repr) == sorted(wanted, key=repr)


def test_warc_files_of_others(spark, tmp_path):
    """Records of other types are passed over, other digests are not judged, a damaged payload is an error."""
    (tmp_path / "in").mkdir()

    def record(kind, block, **fields):
        lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    whole = record("warcinfo", b"software: x\r\n") + record("request", b"GET / HTTP/1.0\r\n\r\n", WARC_Target_URI="http://a/")
    whole += record("response", b"HTTP/1.0 200 OK\r\n\r\nhi", WARC_Target_URI="http://a/", WARC_Payload_Digest="sha1:ABC", WARC_Record_ID="<urn:uuid:1>")
    whole += record("revisit", b"HTTP/1.0 200 OK\r\nContent-Length: 7\r\n\r\n", WARC_Target_URI="http://b/", WARC_Payload_Digest="sha1:DEF", WARC_Refers_To="<urn:uuid:9>")
    (tmp_path / "in" / "a.warc").write_bytes(whole)
    got = warc.read_warc(spark, str(tmp_path / "in"))
    assert rows(got, "url", "record_type", "payload_digest", "payload_bytes", "refers_to") == [("http://a/", "response", hashlib.sha256(b"hi").hexdigest(), 2, None), ("http://b/", "revisit", "DEF", 7, None)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc").write_bytes(record("response", b"HTTP/1.0 200 OK\r\n\r\nhi", WARC_Target_URI="http://a/", WARC_Payload_Digest="sha256:00"))
    with pytest.raises(Exception, match="does not fit"):
        warc.read_warc(spark, str(tmp_path / "bad"))


# ---------------------------------------------------------------- quality rules


def statistics_by_hand(text):
    w = WORD.findall(text or "")
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_verdicts(docs, docs_rows, no_docs):
    scored = rules.score(docs)
    got = rows(scored, "row.doc_id", *[f"_{c}" for c in rules.STATS], "_base_failed")
    expected = []
    for doc_id, text, _ in docs_rows:
        s = statistics_by_hand(text)
        expected.append((doc_id, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert got == sorted(expected, key=repr)
    assert scored.select("row.*").columns == docs.columns
    assert scored.filter("_kept and _base_failed").count() == 0
    assert rules.score(no_docs).count() == 0


def test_statistics_of_symbols_and_letters(spark):
    texts = ["ab |c d| | 12 é# 日本", None, "", "ÄÖ 1,2 x-y\tz", "|", "a1 b22 333"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(rules.score(df), "row.doc_id", "_n_symbol_words", "_n_bare_words", "_n_plain", "_n_digits")
    expected = []
    for k, text in enumerate(texts):
        w = WORD.findall(text or "")
        letter = re.compile(r"[A-Za-z\u0080-\U0010FFFF]")
        expected.append((k, sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w), sum(not letter.search(x) for x in w), sum(len(letter.findall(x)) for x in w), sum(c in "0123456789" for c in text or "")))
    assert got == expected


def more_by_hand(text):
    """The other counts, in the order of MORE."""
    w = WORD.findall(text or "")
    lines = [x.strip(rules.SPACE) for x in (text or "").split("\n") if WORD.search(x)]
    letter, chars = re.compile(r"[A-Za-z\u0080-\U0010FFFF]"), "".join(w)
    return (
        len(lines), sum(x[-1] in ".!?\"')" for x in lines), sum(unicodedata.category(c) == "Lu" for c in chars), len(re.findall(r"[!?]{2,}", text or "")),
        sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w), sum(not letter.search(x) for x in w), sum(c not in rules.NOT_LETTERS for c in chars),
        sum(c in "0123456789" for c in chars),
    )


def test_all_statistics_on_odd_texts(spark):
    """White space, control characters, marks side by side, characters of two and four bytes, at every place of a word."""
    rng = random.Random(11)
    chars = [*" \t\n\x0b\r", " ", "\n", *"aBé日😀É", *"#|17.!!?\"'", *"\x00\x1f\x7f"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += [" ".join(rng.choice("ab#") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", " \n ", "x\n" * 500, "a b c a b c", "a b a b a b c"]
    scored = rules.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), body=False)
    assert scored.select("row.*").columns == ["doc_id"]
    got = rows(scored, "row.doc_id", *[f"_{c}" for c in rules.STATS + rules.MORE])
    assert got == sorted(((k, *statistics_by_hand(x), *more_by_hand(x)) for k, x in enumerate(texts)), key=repr)


def test_triples_that_share_upper_bits_are_compared_by_words(spark):
    """Of 300,000 different triples some share 33 bits of their hash; only the one that is planted twice counts."""
    words = [str(k) for k in random.Random(2).sample(range(10**7), 300_000)]
    words[200_000:200_003] = words[:3]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    shared = df.selectExpr("split(text, ' ') as w").selectExpr("explode(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]) & -2147483648L)) as h")
    assert shared.count() - shared.distinct().count() > 1
    assert rows(rules.score(df), "_n_words", "_n_repeat_words") == [(300_000, 6)]


def test_words_are_not_evaluated_one_by_one_more_than_needed(spark, docs, capsys):
    """Lambdas over words or characters are what the rules' CPU time goes to: one hashes triples, one finds neighbours."""
    rules.with_statistics(docs.select(F.struct("*").alias("row")), F.col("row.text")).explain()
    plan = capsys.readouterr().out
    assert not any(slow in plan for slow in ("RLIKE", "translate(", "array_sort(", "replace("))
    assert plan.count("xxhash64(") == 1 and plan.count("shiftrightunsigned(") == 1


def fit_by_hand(patterns):
    """Expectation-maximisation over a Counter of vote tuples, with the values of production."""
    n_rules = len(rules.RULES)
    belief = {p: 0.1 if min(p) == -1 else 0.9 for p in patterns}
    before = None
    for _ in range(40):
        good = sum(n * belief[p] for p, n in patterns.items())
        bad = sum(patterns.values()) - good
        prior = (good + rules.TRUST * rules.SHARE) / (good + bad + rules.TRUST)
        ratio = {}
        for r in range(n_rules):
            for v in (-1, 1):
                seen = [sum(n * (belief[p] if k else 1 - belief[p]) for p, n in patterns.items() if p[r] == v) for k in (1, 0)]
                right = rules.ACCURACY if v == 1 else 1 - rules.ACCURACY
                ratio[r, v] = np.log((seen[0] + rules.TRUST * right) / (good + rules.TRUST)) - np.log((seen[1] + rules.TRUST * (1 - right)) / (bad + rules.TRUST))
        belief = {p: 1 / (1 + np.exp(-np.log(prior / (1 - prior)) - sum(ratio[r, v] for r, v in enumerate(p) if v))) for p in patterns}
        now = [prior, *ratio.values()]
        if before and max(abs(a - b) for a, b in zip(now, before)) < 1e-3:
            break
        before = now
    return belief, ratio, prior


def vote_rows(spark, data):
    names = [f"_vote_{r[0]}" for r in rules.RULES]
    return spark.createDataFrame(data, "good boolean, " + ", ".join(f"{n} tinyint" for n in names)), names


def test_expectation_maximisation(spark):
    """Votes drawn from known classes, with the values of production: the posterior finds the classes, a rule that is
    right in 60 of 100 is outvoted, and plain Python comes to the same."""
    rng = random.Random(3)
    data = []
    for i in range(4000):
        good = rng.random() < 0.8
        votes = [(1 if good else -1) * (1 if rng.random() < (0.95 if k else 0.6) else -1) for k in range(len(rules.RULES))]
        data.append((good, *(v if rng.random() < 0.7 else 0 for v in votes)))
    df, names = vote_rows(spark, data)
    model = rules.fit(df)
    right = df.filter((model.posterior() >= 0.5) == F.col("good")).count()
    assert right / len(data) > 0.97 and abs(model.prior - 0.8) < 0.04
    assert abs(model.log_ratio[names[0]][-1]) < min(abs(model.log_ratio[n][-1]) for n in names[1:])
    # Its bad vote alone does not take a document away.
    alone = df.filter(f"{names[0]} = -1 and {' and '.join(f'{n} >= 0' for n in names[1:])} and {' + '.join(names[1:])} >= 3")
    assert alone.count() > 100 and alone.filter(model.posterior() < rules.THRESHOLD).count() == 0
    belief, ratio, prior = fit_by_hand(Counter(tuple(d[1:]) for d in data))
    assert abs(prior - model.prior) < 1e-6
    assert all(abs(ratio[k, v] - model.log_ratio[n][v]) < 1e-6 for k, n in enumerate(names) for v in (-1, 1))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_verdicts_on_the_driver_tables(spark, sf):
    """Every document's verdict is that of plain Python over the same votes, and no longer that of any bad vote."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    names = [f"_vote_{r[0]}" for r in rules.RULES]
    scored = rules.score(docs).select("_base_failed", "_kept", *names).collect()
    belief, _, _ = fit_by_hand(Counter(tuple(r[n] for n in names) for r in scored))
    votes = [tuple(r[n] for n in names) for r in scored]
    assert [r._kept for r in scored] == [not r._base_failed and belief[v] >= rules.THRESHOLD for r, v in zip(scored, votes)]
    if sf == "sf0.1":
        assert sum(r._kept != (not r._base_failed and min(v) >= 0) for r, v in zip(scored, votes)) > 10


def test_posterior_agrees_with_labels(spark):
    """Held-out labels: most documents with bad quality go, those with good quality stay."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    scored = rules.score(docs).filter("not _base_failed").groupBy("row.quality", "_kept").count().collect()
    n = {(r.quality, r._kept): r["count"] for r in scored}
    assert n.get((1, True), 0) >= 0.98 * sum(v for (q, _), v in n.items() if q == 1)
    assert n.get((0, False), 0) >= 0.9 * sum(v for (q, _), v in n.items() if q == 0)
