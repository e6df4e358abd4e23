"""Fixed expectations for the shared operators."""

from pyspark.sql import functions as F

from waymill.functions import columns as C
from waymill.operators import comparisons, rollouts, runs, sampling, spatial, texts


def one(spark, col, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in row.items())).select(col).first()[0]


def test_clock_and_hours(spark):
    assert one(spark, C.clock_minutes(F.col("a")), a="23:50") == 1430
    assert one(spark, C.clock_minutes(F.col("a")), a="24:00") is None
    assert one(spark, C.clock_minutes(F.col("a"), True), a="24:00") == 1440
    assert one(spark, C.is_open(F.col("a"), F.col("b"), F.col("c")), a="22:00", b="02:00", c="01:30") is True
    assert one(spark, C.is_open(F.col("a"), F.col("b"), F.col("c")), a="08:00", b="18:00", c="19:00") is False
    assert one(spark, C.is_open(F.col("a"), F.col("b"), F.col("c")), a="closed", b="18:00", c="10:00") is False


def test_numbers_and_names(spark):
    assert one(spark, C.to_number(F.col("a")), a="about 12.5 km") == 12.5
    assert one(spark, C.to_number_strict(F.col("a")), a="about 12.5 km") is None
    assert one(spark, C.to_number(F.col("a")), a="NaN") is None
    assert one(spark, C.normalize_question(F.col("a")), a="请安排 上海→杭州，2 天！") == "请安排上海杭州2天"


def test_distribution(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "v double")
    r = runs.nearest_rank(df, "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (r["min"], r["mean"], r["p50"], r["p90"], r["max"]) == (1, 3, 3, 5, 5)


def test_runs(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("aaaab")], "k int, i int, t string")
    assert {(r.t, r.longest_run) for r in runs.longest_runs(df, "k", ["i"], "t").collect()} == {("a", 4), ("b", 1)}


def groups(spark, rows):
    return spark.createDataFrame([(g, i, r, v, o) for g, vals in rows.items() for i, (r, v, o) in enumerate(vals)], "g string, rollout int, reward double, reward_valid boolean, overflow boolean")


def test_group_outcomes(spark):
    fine = lambda *r: [(float(x), True, False) for x in r]
    rows = {"zero": fine(*[-1] * 8), "usable": fine(*[0] * 7, 0.25), "invalid": [(0.0, False, False), *fine(*[1] * 7)], "over": [(0.0, False, True), *fine(*[1] * 7)], "short": fine(1, 1)}
    got = {r.g: r.outcome for r in rollouts.classify(groups(spark, rows), ["g"]).collect()}
    assert got == {"zero": "zero_variance", "usable": "usable", "invalid": "invalid", "over": "length_exceeded", "short": "invalid"}


def test_streak(spark):
    names = ["zero_variance"] * 9 + ["usable"] + ["invalid"] + ["zero_variance"] * 10
    df = spark.createDataFrame([("run", i, x) for i, x in enumerate(names)], "run string, i int, outcome string")
    got = [r.streak for r in runs.streaks(df, "run", ["i"], "outcome", "zero_variance", "usable").orderBy("i").collect()]
    assert got[8] == 9 and got[9] == 0 and got[10] == 0 and got[-1] == 10


def test_quotas(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(10)], "id int, s string")
    split = sampling.stratified_split(df, ["s"], "id", 2, "seed").collect()
    assert sum(r.split == "holdout" for r in split) == 2 and len(split) == 10
    assert sorted(split) == sorted(sampling.stratified_split(df.orderBy(F.desc("id")), ["s"], "id", 2, "seed").collect())


def test_nearby_equals_all_pairs(spark):
    rows = [(i, 0, 30 + (i * 37 % 100) / 500, 120 + (i * 61 % 100) / 500) for i in range(120)]
    df = spark.createDataFrame(rows, "place_id int, city int, lat double, lon double")
    got = {(r.anchor_id, r.place_id) for r in spatial.within(df, df, 3.0).collect()}
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    want = df.crossJoin(b).filter("place_id <> b_place_id").filter(C.haversine_km(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")) <= 3.0)
    assert got == {(r.place_id, r.b_place_id) for r in want.collect()}


def test_logic_shape(spark):
    rows = [("要有早餐和泳池", ["早餐", "泳池"]), ("要有早餐或泳池", ["早餐", "泳池"]), ("早餐泳池都要", ["早餐", "泳池"]), ("要有早餐", ["早餐", "泳池"]), ("要有早餐", ["早餐"])]
    df = spark.createDataFrame(rows, "text string, o array<string>")
    got = df.select(texts.logic_shape(F.col("text"), F.col("o"), "and").alias("a"), texts.logic_shape(F.col("text"), F.col("o"), "or").alias("b")).collect()
    assert [tuple(r) for r in got] == [("ok", "changed"), ("changed", "ok"), ("ok", "changed"), ("missing", "missing"), ("ok", "ok")]
    groups = spark.createDataFrame([("早餐和泳池，或者健身房", [["早餐", "泳池"], ["健身房"]]), ("早餐和健身房", [["早餐"], ["健身房"]])], "text string, g array<array<string>>")
    assert [r[0] for r in groups.select(texts.any_of_kept(F.col("text"), F.col("g"))).collect()] == [True, False]


def test_patch_clauses(spark):
    rows = [("去杭州，住便宜酒店，坐地铁。", [("m", 6, 8)], {"m": "人均三百"}), ("住便宜酒店坐地铁。", [("m", 1, 3), ("n", 6, 8)], {"m": "普通"}), ("住便宜酒店。", [("m", 0, 3), ("n", 2, 5)], {"m": "x", "n": "y"}), ("无", [], {})]
    df = spark.createDataFrame(rows, "text string, m array<struct<id string, start int, end int>>, c map<string, string>")
    got = [tuple(r.r) for r in df.select(texts.patch_clauses(F.col("text"), F.col("m"), F.col("c")).alias("r")).collect()]
    assert got == [("去杭州，人均三百，坐地铁。", False), ("住普通酒店坐地铁。", False), ("住便宜酒店。", True), ("无", False)]


def test_alternatives_skip_runs_of_planned_places(spark):
    places = spark.createDataFrame([(i, "hotel", 0, float(p)) for i, p in enumerate([10, 10, 20, 30, 30, 40])] + [(9, "hotel", 0, None)], "candidate_id long, entity_type string, city int, price double")
    items = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (2, 3), (2, 5), (3, 2), (3, 9)], "plan_id long, candidate_id long")
    limits = spark.createDataFrame([(3, "hotel", 25.0), (3, "hotel", 90.0)], "plan_id long, entity_type string, max_price double")
    got = {(r.plan_id, r.candidate_id): r.alternative_id for r in comparisons.comparable_alternatives(items, places, limits).collect()}
    assert got == {(1, 0): 4, (1, 2): 4, (1, 3): 5}


def test_table_fingerprint_is_of_the_rows_alone(spark):
    from waymill.plans import registry
    from waymill.sources.records import table_fingerprint

    own = registry.queries()["s10_table_fingerprint"](spark, "/root/testdata/sf0.001").first()
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    again = table_fingerprint(rows.orderBy(F.rand(3)).repartition(7)).first()
    changed = table_fingerprint(rows.withColumn("l_tax", F.when((F.col("l_orderkey") == rows.first().l_orderkey) & (F.col("l_linenumber") == rows.first().l_linenumber), 9.0).otherwise(F.col("l_tax")))).first()
    twice = table_fingerprint(rows.union(rows.limit(1))).first()
    assert own == again and own != changed and own.n == changed.n and twice != own


def test_numerals():
    from waymill.operators.texts import numeral

    want = {0: "零", 2: "二", 10: "十", 11: "十一", 20: "二十", 99: "九十九", 100: "一百", 101: "一百零一", 110: "一百一十", 1005: "一千零五", 1050: "一千零五十", 10000: "一万", 10010: "一万零一十", 120000: "十二万", 1020304: "一百零二万零三百零四"}
    assert {n: numeral(n) for n in want} == want


def test_field_of_a_payload_alone_is_rewritten(spark):
    from waymill.operators import submissions

    rows = spark.createDataFrame([('{"k": 6, "n": 66, "s": "6 \\"k\\"", "o": {"k": 6}, "b": true}', "id_x"), ('{"n": 6}', "id_x"), ('{"k": "6"}', None)], "p string, v string")
    got = [r[0] for r in rows.select(submissions.with_field("p", "k", F.col("v"))).collect()]
    assert got == ['{"k":"id_x","n":66,"s":"6 \\"k\\"","o":{"k":6},"b":true}', '{"n": 6}', '{"k": "6"}']


def test_near_duplicates_against_all_pairs(spark):
    import random

    from waymill.operators import similarity

    r, texts = random.Random(3), []
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    for _ in range(25):
        base = " ".join(r.choice(words) for _ in range(30))
        texts.append(base)
        for edits in (1, 2, 4, 6):
            w = base.split()
            for _ in range(edits):
                w[r.randrange(30)] = r.choice(words)
            texts.append(" ".join(w))
    texts += [None, "", texts[0], "short"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    one = {t: i for i, t in reversed(list(enumerate(texts))) if t is not None}
    want = {}
    for t, i in one.items():
        for u, j in one.items():
            if i < j and (x := similarity.ratio(t, u, 0.8)) >= 0.8:
                want[i, j] = x
    for chunk in (256, 3):
        got = {x.id: x for x in similarity.near_duplicates(frame, "id", "text", chunk=chunk).collect()}
        assert set(got) == set(one.values())
        found = sum(x.n_links for x in got.values()) / 2
        assert 0.9 * len(want) <= found <= len(want) and len(want) > 100
        assert all(x.best is None or x.best <= max(v for p, v in want.items() if x.id in p) + 1e-9 for x in got.values())
