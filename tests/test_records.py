"""Sources and sinks, and checks on small plans."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.operators import checks, sampling, specs, texts
from waymill.sources import records
from waymill.streaming import rollouts


def test_csv_import(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('﻿uid,days,flag,names,rule\na,3,True,"[\'x, y\', ""z""]",secret\nb,x,False,none,s2\nc,,,[],"two\nlines"\n', encoding="utf-8")
    public, hidden = records.import_tasks(spark, str(p), ["rule"], ints=["days"], flags=["flag"], lists=["names"])
    assert [tuple(r) for r in public.orderBy("uid").collect()] == [("a", 3, True, ["x, y", "z"]), ("b", None, False, None), ("c", None, None, [])]
    assert [tuple(r) for r in hidden.orderBy("uid").collect()] == [("a", "secret"), ("b", "s2"), ("c", "two\nlines")]


def test_records_and_fan_out(spark, tmp_path):
    for name, doc in {"2": {"a": 1, "b": None, "c": [5, 6]}, "10": {"a": 2, "b": "x", "c": []}, "note": {"a": 3}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    df = records.read_records(spark, str(tmp_path), T.StructType.fromDDL("a int, b string, c array<int>"))
    out = records.fan_out(df, ["a"], ["b"], ["c"])
    assert sorted(map(tuple, out["a"].collect())) == [(2, 1), (10, 2)]
    assert out["b"].collect()[0].slot == 10 and sorted(map(tuple, out["c"].collect())) == [(2, 0, 5), (2, 1, 6)]


def test_rows_for_trainers(spark):
    df = spark.createDataFrame([("s", [("user", "hi")], None)], "id string, messages array<struct<role:string,content:string>>, assistant_loss_mask array<int>")
    r = records.sft_rows(df, ["messages"]).first()
    assert json.loads(r.messages) == [{"role": "user", "content": "hi"}] and r.assistant_loss_mask == []
    pub = spark.createDataFrame([("a", "q1"), ("b", "q2"), ("b", "q3")], "uid string, query string")
    rows, rejects = records.prompt_rows(pub, spark.createDataFrame([("a", "s1")], "uid string, scenario_id string"), "sys", ["hard_logic"])
    assert [(r.uid, [m.role for m in r.messages], r.scenario_id) for r in rows.collect()] == [("a", ["system", "user"], "s1")]
    assert rejects.count() == 2
    with pytest.raises(ValueError):
        records.prompt_rows(pub.withColumn("hard_logic", F.lit(1)), pub, "sys", ["hard_logic"])
    s = spark.createDataFrame([(i, i % 3 == 0, i % 2 == 0, "t") for i in range(30)], "id int, repaired boolean, had_invalid boolean, text string")
    assert {(r["kind"], r["count"]) for r in records.preview(s, "id", 4).groupBy("kind").count().collect()} == {("repaired", 4), ("had_invalid", 4), ("clean", 4)}


def test_ingest_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, None)], "id int, text string").write.json(str(src))
    for _ in range(2):
        q = rollouts.ingest(spark.readStream.schema("id int, text string").json(str(src)), F.when(F.col("text").isNull(), "no_text"), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"), {"availableNow": True})
        q.awaitTermination(120)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [1]
    assert [(r.id, r.fault) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [(2, "no_text")]


ACT = "plan_id int, day int, pos int, activity_type string, candidate_id string, start_time string, end_time string, unit_price double, amount double"
ENT = "candidate_id string, entity_type string, city string, origin_city string, destination_city string, open_time string, close_time string"


def frames(spark, *acts):
    ents = [("go", "transport", None, "S", "H", None, None), ("back", "transport", None, "H", "S", None, None), ("park", "attraction", "H", None, None, "08:00", "18:00"), ("inn", "hotel", "H", None, None, None, None), ("bar", "restaurant", "H", None, None, "20:00", "02:00")]
    return spark.createDataFrame([(1, *a) for a in acts], ACT), spark.createDataFrame(ents, ENT)


def status(df):
    return [(r.status, r.score) for r in df.collect()]


def test_plan_checks(spark):
    trip = [(1, 0, "train", "go", "08:00", "09:00", 1.0, 1.0), (1, 1, "attraction", "park", "10:00", "12:00", 1.0, 1.0), (1, 2, "accommodation", "inn", "20:00", "24:00", 1.0, 1.0), (2, 0, "breakfast", "inn", "07:00", "08:00", 0.0, 0.0), (2, 1, "train", "back", "18:00", "19:00", 1.0, 1.0)]
    plans = spark.createDataFrame([(1, "S", "H", 2)], "plan_id int, origin string, destination string, days int")
    a, e = frames(spark, *trip)
    assert status(checks.trip_coverage(plans, a, e)) == [("pass", 1.0)]
    assert status(checks.opening_hours(a, e)) == [("pass", 1.0)]
    assert status(checks.meal_commonsense(a, e)) == [("pass", 1.0)]
    a, e = frames(spark, trip[1], (1, 3, "dinner", "bar", "17:00", "18:00", 1.0, 1.0), (2, 3, "attraction", "park", "17:30", "18:30", 1.0, 1.0))
    assert status(checks.opening_hours(a, e)) == [("fail", round(2 / 3, 8))]  # hours over midnight always fit
    a, e = frames(spark, (1, 0, "breakfast", "inn", "07:00", "08:00", 5.0, 5.0))
    assert status(checks.meal_commonsense(a, e)) == [("fail", 0.0)]
    a, e = frames(spark, (1, 0, "attraction", "ghost", "07:00", "08:00", 5.0, 5.0))
    assert status(checks.opening_hours(a, e)) == [("unverifiable", None)]
    assert checks.opening_hours(a.limit(0), e).count() == 0


def test_blockers_in_order(spark):
    rows = [(1, "opening_hours", "unverifiable", None), (1, "entity_grounding", "fail", 0.0), (1, "plan_structure", "fail", 0.0), (1, "chronology", "unverifiable", None)]
    got = {r.check_id: (r.status, r.blocked_by) for r in checks.resolve_blockers(spark.createDataFrame(rows, "plan_id int, check_id string, status string, score double")).collect()}
    assert got["opening_hours"] == ("blocked", "entity_grounding") and got["chronology"] == ("unverifiable", None)


def test_numbers_clauses_and_ranks(spark):
    forms = {(r.value, r.form) for r in texts.number_forms(spark.range(200).union(spark.range(5)), "id").collect()}
    assert {(2, "两"), (10, "十"), (12, "十二"), (20, "二十"), (35, "三十五"), (105, "一百零五"), (2, "2")} <= forms
    df = spark.createDataFrame([("去杭州，预算五百元；住一晚。",), ("无",), (None,)], "q string")
    assert [r[0] for r in df.select(specs.source_clause(F.col("q"), ["预算", "五百元"])).collect()] == ["预算五百元", None, None]
    ranked = sampling.global_rank(spark.range(1000).withColumn("h", F.sha2(F.col("id").cast("string"), 256)), "h").collect()
    assert [r.rank for r in sorted(ranked, key=lambda r: r.h)] == list(range(1, 1001))
