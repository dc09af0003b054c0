import csv
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from itspark.operators import dedup
from itspark.plans import cohort, outcomes, study
from itspark.sources import delimited, schemas, spine, stage
from tests.conftest import rows

WEEK = "WEEKS_BEFORE_AFTER"


def test_read_delimited_dialects(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿id,n,t,extra\n000123,1,a,9\n000124,NA,NA,9\n000125,x,,9\n000126,4,"",9\n', encoding="utf-8")
    null_blank = delimited.read_delimited(spark, str(path), "id string, n int, t string")
    assert rows(null_blank) == [("000123", 1, "a"), ("000124", None, None), ("000125", None, None), ("000126", 4, None)]
    text_blank = delimited.read_delimited(spark, str(path), "id string, n int, t string", blank_is_null=False)
    assert rows(text_blank) == [("000123", 1, "a"), ("000124", None, None), ("000125", None, ""), ("000126", 4, "")]
    assert delimited.read_delimited(spark, str(path)).dtypes == [(c, "string") for c in ("id", "n", "t", "extra")]


def test_written_text_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1, None), ('q"t', None, 2.5), (None, 3, 0.1)], "s string, i int, d double")
    delimited.write_delimited(df, str(tmp_path / "many"))
    delimited.write_result(df, str(tmp_path / "one"))
    for name in ("many", "one"):
        back = delimited.read_delimited(spark, str(tmp_path / name), "s string, i int, d double")
        assert rows(back) == rows(df)
    assert len([f for f in os.listdir(tmp_path / "one") if f.endswith(".csv")]) == 1


class Session:
    """A session that names a shared folder, or none."""

    def __init__(self, shared, master="local[2]"):
        self.conf, self.sparkContext = self, self
        self.shared, self.set_to, self.master = shared, None, master

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.shared or default

    def getCheckpointDir(self):
        return self.set_to

    def setCheckpointDir(self, folder):
        self.set_to = folder


def test_stage_uses_the_folder_of_the_session():
    assert stage.stage_root(Session("hdfs://shared/x")) == "hdfs://shared/x"
    unset = Session(None)
    local = stage.stage_root(unset)
    assert os.path.isdir(local) and stage.stage_root(unset) == local
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage.stage_root(Session(None, master="spark://host:7077"))


def test_write_stage_keeps_types(spark, tmp_path):
    path = stage.new_stage_path(spark, "t")
    assert path != stage.new_stage_path(spark, "t") and os.path.dirname(path) == stage.stage_root(spark)
    df = spark.createDataFrame([("000123", 1, None)], "id string, n int, d date")
    back = stage.write_stage(df, str(tmp_path / "t"))
    assert back.schema == df.schema and rows(back) == rows(df)


def test_period_spine(spark):
    got = {r.period: r for r in spine.period_spine(spark, origin="2015-08-10", start=25).collect()}
    assert len(got) == 207
    assert [str(got[p].week_start) for p in (1, 2, 207)] == ["2015-08-10", "2015-08-17", "2019-07-22"]
    assert (got[25].time_truncated, got[26].time_truncated, got[207].time_truncated) == (None, 1, 182)
    assert (got[104].trend_weeks, got[105].trend_weeks, got[207].trend_weeks) == (0, 1, 103)


# ---------------------------------------------------------------- a small study, and the same by hand


def make_files(folder):
    """Five files with copies, conflicts, unknown codes, blanks and ids that only agree in their last six."""
    rng = random.Random(11)
    births, keys = [], []
    for i in range(2600):
        exposed = rng.random() < 0.5
        key = [f"ZZ{rng.choice('AB')}{rng.randrange(100000):06d}", rng.randrange(0, 106), "EXPOSED" if exposed else "UNEXPOSED"]
        row = key + [
            rng.choice([1] * 30 + [2]), rng.choice([1] * 30 + [2]), rng.choice([1, 2] * 20 + [9, 0]), rng.choice([3] * 30 + [4]),
            7, 3000 + i, rng.choice([1, 2, 4] * 8 + [9, 3]), 1, rng.choice([0, 1, 2, 15] * 8 + [16, 99, "NA"]),
            rng.choice([0, 1, 2] * 8 + [9]), rng.choice([0, 1] * 10 + [9, ""]), 2, "NA", rng.choice(["<20", "20-34", "35+"]), rng.randrange(1, 6),
        ]
        births.append(row)
        keys.append(key)
        if rng.random() < 0.03:
            births.append(list(row))
        if rng.random() < 0.03:
            births.append(row[:8] + [1] + row[9:])
    write(folder / "births.csv", [*schemas.key_columns(), *schemas.BIRTH_COLUMNS], births)

    def about(share, answer):
        out = []
        for k in keys:
            if rng.random() < share:
                out.append(k + answer())
                if rng.random() < 0.05:
                    out.append(k + answer())
                if rng.random() < 0.05:
                    out.append(list(out[-1]))
        return out

    counts = [WEEK, "EPISODES_WITHIN_26_WEEKS", "EPISODES_WITHIN_52_WEEKS"]
    for name in ("children", "mothers"):
        data = about(0.6, lambda: [a := rng.choice([0, 0, 1, 2]), a + rng.choice([0, 1])])
        write(folder / f"{name}.csv", [*schemas.key_columns(), *counts[1:]], data)
    answers = lambda: [rng.choice(["Y", "N", "N", "Unknown/Invalid", "", "NA"]), rng.choice(["Y", "N", "Unknown/Invalid"]), rng.choice(["Breast", "Formula", "Unknown/Invalid"])]
    columns = [*schemas.key_columns(), "smoker_pc", "second_hand_smoke", "feed_2016"]
    write(folder / "first_visit.csv", columns, about(0.8, answers))
    tick = lambda: rng.choice(["Y", "N", "NA"])
    write(folder / "six_week_visit.csv", [*columns, "sleep_pr", "sleep_su", "sleep_si"], about(0.8, lambda: answers() + [tick(), tick(), tick()]))
    return {name: str(folder / f"{name}.csv") for name in study.INPUTS}


def write(path, header, data):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *data])


def read(path, blank_is_null=True):
    with open(path, newline="") as f:
        return [
            {k: None if v == "NA" or (v == "" and blank_is_null) else v for k, v in r.items()} for r in csv.DictReader(f)
        ]


def unique(records, key):
    """Distinct records whose key belongs to one of them only."""
    groups = defaultdict(set)
    for r in records:
        groups[key(r)].add(tuple(r.items()))
    return {k: dict(next(iter(v))) for k, v in groups.items() if len(v) == 1}


def by_hand(paths):
    num = lambda v: None if v is None else int(v)
    kept = []
    for r in read(paths["births"]):
        w = int(r[WEEK])
        t = (w - 106) * -1 if r["COHORT_IDENTIFIER"] == "UNEXPOSED" else w + 105
        alive = r["num_of_births_this_pregnancy"] == "1" and r["outcome_of_pregnancy_baby_1"] == "1" and r["condition_on_discharge"] == "3"
        if w > 0 and 1 < t < 209 and alive:
            kept.append({**r, "t": t - 1})
    full = lambda r: (r["MOTHERID"], r[WEEK], r["COHORT_IDENTIFIER"])
    cut = lambda r: (r["MOTHERID"][-6:], r[WEEK], r["COHORT_IDENTIFIER"])
    people = []
    for r in unique(kept, full).values():
        c = {
            "feed": num(r["FEED_ON_DISCHARGE_BABY1"]), "tpp": num(r["TOTAL_PREVIOUS_PREGNANCIES"]),
            "book": num(r["BOOKING_SMOKING_HISTORY"]), "smoke": num(r["SMOKER_DURING_PREGNANCY"]), "sex": num(r["sex_baby_1"]),
        }
        for name, codes in (("feed", (9, 3)), ("tpp", (99,)), ("book", (9,)), ("smoke", (9,)), ("sex", (9, 0))):
            c[name] = None if c[name] in codes else c[name]
        c["tpp"] = None if c["tpp"] is not None and c["tpp"] > 15 else c["tpp"]
        if None not in c.values():
            people.append({**c, "key": cut(r), "t": r["t"]})
    sources = {
        name: unique([{**r, "MOTHERID": r["MOTHERID"][-6:]} for r in read(paths[name], name != "first_visit")], cut)
        for name in study.INPUTS[1:]
    }
    clean = lambda v: None if v == "Unknown/Invalid" else v
    for p in people:
        for who, name in (("child", "children"), ("mother", "mothers")):
            r = sources[name].get(p["key"], {})
            for weeks in (26, 52):
                p[f"{who}{weeks}"] = int(r.get(f"EPISODES_WITHIN_{weeks}_WEEKS", 0))
        for visit, name in (("fv", "first_visit"), ("68", "six_week_visit")):
            r = sources[name].get(p["key"], {})
            for short, column in (("pc", "smoker_pc"), ("sh", "second_hand_smoke"), ("feed", "feed_2016")):
                p[f"{short}_{visit}"] = clean(r.get(column))
        r = sources["six_week_visit"].get(p["key"], {})
        ticks = {s: int(r.get(f"sleep_{s}") == "Y") for s in ("pr", "su", "si")}
        total = sum(ticks.values())
        p["supine"] = None if total == 0 else int(total == 1 and ticks["su"] == 1)
    return people


def panel_by_hand(people):
    yes = lambda c, v="Y": (lambda p: None if p[c] is None else int(p[c] == v))
    series = {
        "child_admissions_26w": (lambda p: p["child26"], 26, 0), "child_admissions_52w": (lambda p: p["child52"], 52, 0),
        "mother_admissions_26w": (lambda p: p["mother26"], 26, 0), "mother_admissions_52w": (lambda p: p["mother52"], 52, 0),
        "carer_smokes_fv": (yes("pc_fv"), 1, 0), "carer_smokes_68": (yes("pc_68"), 1, 25),
        "second_hand_smoke_fv": (yes("sh_fv"), 1, 0), "second_hand_smoke_68": (yes("sh_68"), 1, 0),
        "second_hand_smoke_68_truncated": (yes("sh_68"), 1, 25),
        "smoker_at_booking": (lambda p: int(p["book"] == 1), 1, 0), "smoked_in_pregnancy": (lambda p: p["smoke"], 1, 0),
        "breastfed_fv": (yes("feed_fv", "Breast"), 1, 0), "breastfed_68": (yes("feed_68", "Breast"), 1, 0),
        "supine_sleep_68": (lambda p: p["supine"], 1, 0),
    }
    out = {}
    for name, (value, horizon, start) in series.items():
        weeks = defaultdict(list)
        for p in people:
            if p["t"] > start and value(p) is not None:
                weeks[p["t"]].append(value(p))
        out.update({(name, t): (len(v) * horizon, float(sum(v))) for t, v in weeks.items()})
    return out


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    paths = make_files(folder)
    return paths, str(folder / "out"), study.run_study(spark, paths, str(folder / "out"))


def test_study_panel_is_the_one_by_hand(done):
    paths, _, tables = done
    people = by_hand(paths)
    assert tables["linked"].count() == tables["cohort"].count() == len(people) > 1000
    got = {(r.series, r.period): (r.denominator, r.numerator) for r in tables["panel"].collect()}
    assert got == panel_by_hand(people)


def test_blank_first_visit_answers_stay_answers(done):
    _, _, tables = done
    linked = tables["linked"]
    assert linked.filter("smoke_pc_fv = ''").count() > 0 and linked.filter("smoke_pc_68 = ''").count() == 0


def test_study_results(done, spark):
    _, out, tables = done
    assert tables["coefficients"].select("series", "model").distinct().count() == sum(len(o.models) for o in outcomes.OUTCOMES) == 31
    assert tables["effects"].count() == 28
    links = {(r.source, r.status): r.n for r in tables["links"].collect()}
    assert all(links[s, "matched"] > 0 and links[s, "conflict"] > 0 and links[s, "absent"] > 0 for s in ("admissions_child", "six_week_visit"))
    written = os.listdir(f"{out}/results")
    assert {"records_by_raw_week", "codes", "answers", "answers_missing_by_week", "answers_incomplete", "ratios", "panel_summary"} <= set(written)
    n = tables["linked"].count()
    assert {(r.variable, r.n) for r in tables["answers"].groupBy("variable").agg(F.sum("n").alias("n")).collect()} == {(a, n) for a in study.ANSWERS}
    gaps = {r.variable: (r.n_rows, r.n_incomplete) for r in tables["answers_incomplete"].collect()}
    assert gaps == {a: (n, tables["linked"].filter(F.col(a).isNull()).count()) for a in study.ANSWERS}
    births = delimited.read_delimited(spark, done[0]["births"])
    assert tables["records_by_raw_week"].agg(F.sum("n")).first()[0] == births.count()
    assert tables["panel_summary"].filter("variable = 'rate'").count() == len(outcomes.OUTCOMES)
    stated = {r.variable: r for r in tables["previous_pregnancies"].collect()}
    most = tables["clean"].agg(F.max("stated_previous_pregnancies"), F.max("total_previous_pregnancies")).first()
    assert [stated[c].max for c in ("stated_previous_pregnancies", "total_previous_pregnancies")] == list(most) and most[1] <= 15
    assert tables["explained"].count() == tables["residual_summary"].count() == 31
    assert tables["explained"].filter("n_obs > 0 and r2_nagelkerke >= r2_cox_snell").count() == 31
    assert set(written) == set(tables) - {"clean", "cohort", "linked", "panel"} and len(written) > 25
    back = delimited.read_delimited(spark, f"{out}/results/effects", "series string, post_week int, effect double")
    assert rows(back) == rows(tables["effects"], "series", "post_week", "effect")
    answered = tables["smoke_pc_68_by_simd_quintile"]
    assert answered.agg(F.sum("n")).first()[0] == tables["linked"].count()


def test_models_are_fitted_once_and_text_is_read_once(done):
    """Returned tables are read from what was written: no fit and no scan of text is left in their plans."""
    _, out, tables = done
    for name, table in tables.items():
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "FileScan csv" not in plan and "Scan text" not in plan, name
        assert "Exchange" not in plan, name


def test_stages_in_passing_are_gone(done):
    _, out, _ = done
    assert {f for f in os.listdir(out) if not f.startswith("_")} == {"clean", "cohort", "linked", "panel", "cohort_reports", "linked_reports", "analysis", "results"}
    assert {f.removesuffix(".json") for f in os.listdir(f"{out}/_manifest") if not f.startswith(".")} == {"clean", "cohort", "linked", "panel", "cohort_reports", "linked_reports", "analysis"}


def test_an_ended_study_goes_on(spark, tmp_path, done, monkeypatch):
    """Killed while models are fitted: the second run reads no text, and makes only what was not finished."""
    paths, _, whole = done
    out = str(tmp_path / "out")
    fit = outcomes.fit_ladder

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(outcomes, "fit_ladder", killed)
    with pytest.raises(KeyboardInterrupt):
        study.run_study(spark, paths, out)
    assert {"births", "axis", "categories", "linked"} <= set(os.listdir(out)) and "fit" not in os.listdir(f"{out}/_manifest")
    monkeypatch.setattr(outcomes, "fit_ladder", fit)
    made = []
    write = stage.write_stage

    def counted(df, path, mode="errorifexists"):
        made.append(path.removeprefix(out + "/").split("/")[0])
        return write(df, path, mode)

    monkeypatch.setattr(stage, "write_stage", counted)
    with monkeypatch.context() as m:
        m.setattr(delimited, "read_delimited", killed)
        again = study.run_study(spark, paths, out)
    assert {"fit", "analysis"} <= set(made) and not {"births", "axis", "clean", "cohort", "linked", "panel", "cohort_reports", "linked_reports"} & set(made)
    for name in ("panel", "effects", "links"):
        assert rows(again[name]) == rows(whole[name])
    # Nothing is left to do a third time, until an input changes.
    made.clear()
    study.run_study(spark, paths, out)
    assert not set(made)
    changed = dict(paths, children=str(tmp_path / "children.csv"))
    with open(paths["children"]) as f, open(changed["children"], "w") as g:
        g.write("".join(f.readlines()[:-5]))
    study.run_study(spark, changed, out)
    assert {"linked", "panel", "analysis"} <= set(made) and not {"births", "clean", "cohort"} & set(made)


def test_ids_left_whole(spark, tmp_path, done):
    paths, _, _ = done
    tables = study.run_study(spark, paths, str(tmp_path / "whole"), trim=None, spread=4)
    assert tables["cohort"].filter(F.length("mother_id") > 6).count() > 0
    assert tables["trimmed_key_conflicts"].first().keys_conflicted == 0
    assert tables["links"].filter("status = 'matched' and n > 0").count() == 4


def test_delimited_text_as_other_programs_write_it(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(b'id,t,n\n1,"say ""hi"", ok",5\n2,"back\\",7\n3, Y ,8\n4,"\t in quotes ",9\n5,"a, b",\n')
    schema = "id int, t string, n int"
    texts = {1: 'say "hi", ok', 2: "back\\", 3: "Y", 4: "in quotes", 5: "a, b"}
    got = {r.id: (r.t, r.n) for r in delimited.read_delimited(spark, str(path), schema).collect()}
    assert got == {i: (t, {1: 5, 2: 7, 3: 8, 4: 9}.get(i)) for i, t in texts.items()}
    kept = {r.id: r.t for r in delimited.read_delimited(spark, str(path), schema, blank_is_null=False).collect()}
    assert kept == texts | {3: " Y ", 4: "\t in quotes "}
    broken = tmp_path / "lines.csv"
    broken.write_bytes(b'id,t\n1,"two\nlines"\n2,one\n')
    assert rows(delimited.read_delimited(spark, str(broken), "id int, t string", multi_line=True)) == [(1, "two\nlines"), (2, "one")]


@pytest.fixture
def small_splits(spark):
    """Byte ranges of a few lines."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_breaks_inside_quotes_over_many_ranges(spark, tmp_path, small_splits):
    """Records that go over several byte ranges, quotes at their borders, files that end inside a range."""
    rng = random.Random(12)
    expected = []
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv", "c.csv"):
        own = []
        for i in range(300):
            bits = rng.choices(["x", ",", '"', "\n", "\n\n", "é" * 9, "line\nof, \"text\"", "y" * 40], k=rng.randint(0, 12))
            own.append((str(i), "".join(bits), rng.choice(["", "NA", "z", '"', "\n" * 300])))
        with open(tmp_path / "in" / name, "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerows([("id", "t", "u"), *own])
        expected += own
    df = delimited.read_delimited(spark, str(tmp_path / "in"), multi_line=True, blank_is_null=False)
    assert df.rdd.getNumPartitions() > 3
    wanted = sorted(((i, t or "", None if u == "NA" else u) for i, t, u in expected), key=repr)
    assert rows(df) == [(i, None if t == "NA" else t, u) for i, t, u in wanted]
    plain = spark.read.options(header=True, quote='"', escape='"', multiLine=True, nullValue="NA", emptyValue="").csv(str(tmp_path / "in"))
    assert df.count() == plain.count() == 900


def test_a_quote_that_is_never_closed_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "MAX_LINES", 50)
    path = tmp_path / "open.csv"
    path.write_text('id,t\n1,"open\n' + "2,b\n" * 80)
    with pytest.raises(Exception, match="not closed"):
        delimited.read_delimited(spark, str(path), multi_line=True).collect()


def test_written_text_is_standard(spark, tmp_path):
    data = [(1, 'say "hi", ok'), (2, "back\\"), (3, None), (4, "plain")]
    delimited.write_result(spark.createDataFrame(data, "id int, t string"), str(tmp_path / "out"))
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    with open(part, newline="") as f:
        assert [(int(r["id"]), None if r["t"] == "NA" else r["t"]) for r in csv.DictReader(f)] == data


def test_trim_before_and_after(spark):
    columns = [*schemas.key_columns(), *schemas.BIRTH_COLUMNS]
    common = {c: 1 for c in schemas.BIRTH_COLUMNS} | {"condition_on_discharge": 3, "MOTHER_AGE_GRPS": "20"}
    people = [("A000001", 5), ("B000001", 5), ("A000002", 5)]
    data = [tuple({**common, "MOTHERID": i, WEEK: w, "COHORT_IDENTIFIER": "E", "BIRTHWEIGHT_BABY_1": n}[c] for c in columns) for n, (i, w) in enumerate(people)]
    births = spark.createDataFrame(data, schemas.birth_schema())
    after = cohort.clean_records(births)
    assert sorted(r.mother_id for r in after.collect()) == ["000001", "000001", "000002"]
    assert dedup.conflict_report(after, schemas.KEYS).first().keys_conflicted == 1
    assert [r.mother_id for r in cohort.clean_records(births, trim="before").collect()] == ["000002"]
    with pytest.raises(ValueError):
        cohort.clean_records(births, trim="never")
