"""The corpus pipeline over the smallest driver tables, each stage against brute force."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from checks.compare import compare, open_duck
from itspark.llm import rules, simhash, sql
from tests.conftest import rows
from tests.llm.conftest import frame
from tests.llm.test_lines_windows_suffixes import lines_by_hand
from tests.llm.test_other_operators import WORD, contamination_by_hand, targets_by_hand

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first stage and after each, as dictionaries by id."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out, columns = [{r.doc_id: r.asDict() for r in docs.collect()}], docs.columns
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, SF_DIR).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        got = docs.collect()
        out.append({r.doc_id: r.asDict() for r in got})
        assert len(out[-1]) == len(got)
    return out


def test_quality_drops_what_the_rules_reject(spark, stages):
    scored = rules.score(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    assert set(stages[1]) == {r.doc_id for r in scored.filter("_kept").select("row.doc_id").collect()}
    assert all(len(WORD.findall(r["text"])) >= 50 for r in stages[1].values())
    assert all(r == stages[0][i] for i, r in stages[1].items())


def test_shared_lines_go(stages):
    before, after = stages[1], stages[2]
    assert before.keys() == after.keys()
    expected = {d: (n - dropped, sha) for d, n, dropped, sha in lines_by_hand([(i, r["text"], None) for i, r in before.items()], 10)}
    got = lines_by_hand([(i, r["text"], None) for i, r in after.items()], 10**9)
    assert {d: sha for d, _, _, sha in got} == {d: sha for d, (_, sha) in expected.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar_pairs(docs, at_least):
    sets, holders = {i: shingles(r["text"]) for i, r in docs.items()}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    together = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[:k])
    return {p for p, n in together.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= at_least}


def test_near_copies_go_and_one_stays(stages):
    before, after = stages[2], stages[3]
    assert all(r == before[i] for i, r in after.items())
    # A group's smallest id stays.
    assert after.keys() == set(components_by_hand(before, similar_pairs(before, 0.8)).values())


def components_by_hand(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_recall_of_near_copies(spark):
    """Groups are what the pairs with a similarity of 0.8 or more connect, no more and no less."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.groups(docs, simhash.SIMILAR).select("doc_id", "component_id").collect()}
    texts = {r.doc_id: r.asDict() for r in docs.collect()}
    pairs = similar_pairs(texts, 0.8)
    assert len(pairs) > 20 and got == components_by_hand(texts, pairs)


def test_near_copies_are_exactly_the_similar_ones(spark):
    """Links are the pairs with a similarity of 0.8 or more: all of 0.8 to 0.85, none of 0.7 to 0.8."""
    rng, texts = random.Random(11), {}
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(124)]
        texts[5 * k], other = " ".join(words), list(words)
        # 120 shingles, of which each new word at the end changes one.
        for n, cut in enumerate((12, 13, 16, 18), 1):
            if n < 3 and k % 2 or n >= 3 and not k % 2:
                texts[5 * k + n] = " ".join(other[:-cut] + [f"v{rng.randrange(10**6)}" for _ in range(cut)])
    docs = frame(spark, [(i, t, "s") for i, t in texts.items()])
    root = {r.doc_id: r.root for r in simhash.groups(docs, simhash.SIMILAR).select("doc_id", "root").collect()}
    by_id = {i: {"text": t} for i, t in texts.items()}
    wanted, band = similar_pairs(by_id, 0.8), similar_pairs(by_id, 0.7)
    assert len(wanted) > 50 and len(band - wanted) > 50 and not wanted & similar_pairs(by_id, 0.85)
    assert all(root[a] == root[b] for a, b in wanted)
    assert not any(root[a] == root[b] for a, b in band - wanted)


def test_contaminated_documents_go(spark, stages):
    items = rows(spark.read.parquet(f"{SF_DIR}/benchmark.parquet"), "item_id", "text")
    found = contamination_by_hand([(i, r["text"], None) for i, r in stages[3].items()], items)
    assert set(stages[4]) == {d for d, *_, bad in found if not bad}


def test_mix_of_what_is_left(stages):
    size_of, taken = Counter(), Counter()
    for r in stages[4].values():
        size_of[r["source"]] += len(WORD.findall(r["text"]))
    goal = targets_by_hand(size_of)
    assert stages[5].keys() == stages[4].keys()
    for r in stages[5].values():
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(goal[r["source"]])
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_awkward_documents_pass_through(spark, docs_rows):
    docs = frame(spark, docs_rows).withColumn("n_chars", F.char_length("text").cast("long"))
    given = Counter(docs.collect())
    for name, function in corpus_pipeline.STAGES[:-1]:
        made = function(spark, docs, SF_DIR)
        got = made.collect()
        assert made.columns == docs.columns
        if name == "line_dedup":
            # Every row stays, repeated ones and those without an id too; only the text and its length change.
            assert Counter((r.doc_id, r.source, r.copies) for r in got) == Counter((r.doc_id, r.source, r.copies) for r in given.elements())
            assert all((r.text is None) == (r.n_chars is None) and r.n_chars in (None, len(r.text or "")) for r in got)
        else:
            assert not Counter(got) - given
        if name == "near_dedup":
            # Rows by place, since ids are null or repeat.
            before = dict(enumerate({"text": r.text} for r in given.elements()))
            assert len(got) == len(set(components_by_hand(before, similar_pairs(before, 0.8)).values()))
            assert not similar_pairs(dict(enumerate({"text": r.text} for r in got)), 0.8)
    assert corpus_pipeline.mixing_to_weights(spark, docs, SF_DIR).count() == given.total()
    none = frame(spark, []).withColumn("n_chars", F.lit(0).cast("long"))
    for _, function in corpus_pipeline.STAGES:
        none = function(spark, none, SF_DIR)
    assert none.count() == 0


@pytest.mark.parametrize("name", sorted(sql.STATEMENTS))
def test_queries_against_sql(spark, name):
    assert compare(spark, open_duck(SF_DIR), driver.queries()[name], sql.STATEMENTS[name], SF_DIR) == ""
