"""Renewed scores, exports, responses, scenarios, lexicons, batches, evidence, lengths and gates on small frames with odd rows."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymill.operators import batches, evidence, exports, gates, lengths, lexicons, overlays, rescoring, responses
from waymill.plans.audit_queries import specs_and_checks

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_renewed_scores_equal_a_full_rescoring(spark):
    """A random edit of the specs (changed, added and removed constraints): stored and renewed rows are those of scoring all."""
    facts, before, _, checks = specs_and_checks(lambda t: spark.read.parquet(f"{SF}/{t}.parquet"))
    h = F.pmod(F.xxhash64("plan_id"), F.lit(100))
    after = before.withColumn("amount", F.when((h == 3) & (F.col("kind") == "total_budget"), F.col("amount") / 3).otherwise(F.col("amount")))
    after = after.filter(~((h == 4) & (F.col("kind") == "room_type"))).unionByName(before.filter((h == 5) & (F.col("kind") == "activity_count")).withColumns({"constraint_id": F.lit(77), "amount": F.lit(1.0)}))
    after = after.repartition(3)  # order does not matter
    own = rescoring.check_specs(before, facts, checks)
    got = rescoring.rescore(own, rescoring.score_plans(own), before, after, facts, checks)
    full = rescoring.check_specs(after, facts, checks)
    assert rows(got.rows.select(*full.columns)) == rows(full)
    scores = rescoring.score_plans(full)
    assert rows(got.scores) == rows(scores)
    touched = {r.plan_id for r in got.report.collect()}
    assert touched == {r.plan_id for r in before.filter(h.isin(3, 4, 5)).select("plan_id").distinct().collect()} and touched
    was = {r.plan_id: r for r in rescoring.score_plans(own).collect()}
    now = {r.plan_id: r for r in scores.collect()}
    for r in got.report.collect():
        a, b = was[r.plan_id].accepted, now[r.plan_id].accepted
        assert r.outcome == ("kept" if a and b else "lost" if a else "gained" if b else "rejected") and (r.before, r.after) == (was[r.plan_id].reward, now[r.plan_id].reward)


def test_scores_of_odd_check_rows(spark):
    df = spark.createDataFrame(
        [(1, "goal", "hard", "pass", 1.0), (1, "goal", "soft", "fail", 0.0), (2, "goal", "hard", "unverifiable", None), (3, "admission", "hard", "fail", 0.5), (3, "goal", "soft", "blocked", None), (4, "goal", "soft", "not_applicable", None), (5, "validity", "hard", "blocked", None)],
        "plan_id long, dimension string, hardness string, status string, score double",
    )
    got = {r.plan_id: r for r in rescoring.score_plans(df).collect()}
    assert [got[k].reward for k in range(1, 6)] == [0.5, -1.0, round(-1 + 0.5 / 3, 8), 1.0, -1.0]
    assert [got[k].reward_type for k in range(1, 6)] == ["feasible", "unverifiable", "failed", "strict_valid", "failed"] and got[4].accepted and not got[1].accepted
    assert rescoring.score_plans(df.limit(0)).collect() == []


def small_export(spark):
    plans = spark.createDataFrame([(1, 5, "A", "B"), (2, 1, "A", "B"), (3, 1, "A", "B"), (4, 9, "A", None)], "plan_id long, people int, start_city string, target_city string")
    acts = [
        (1, 2, 1, "train", "08:00", "09:00", 10.0, 50.0, 5, None, None, 1, None), (1, 1, 2, "accommodation", "21:00", "24:30", 9.0, 9.0, 1, 0, 2, 2, 7), (1, 1, 1, "lunch", "11:00", "12:00", None, None, 5, None, None, 2, None),
        (3, 1, 1, "lunch", "11:00", "12:00", 1.0, 1.0, 1, None, None, 9, None), (4, 1, 1, "attraction", "11:00", "12:00", 1.0, 1.0, 1, None, None, 2, 8),
    ]
    activities = spark.createDataFrame(acts, "plan_id long, day int, pos int, activity_type string, start_time string, end_time string, unit_price double, amount double, quantity int, rooms int, room_type int, candidate_id long, route_id long")
    entities = spark.createDataFrame([(1, "T", "a", "b", "G1"), (2, "H", None, None, None)], "candidate_id long, name string, origin string, destination string, source_id string")
    seg = "struct<start:string,end:string,mode:string,start_time:string,end_time:string,cost:double,distance:double>"
    routes = spark.createDataFrame([(7, "taxi", [("s", "e", "walk", "1", "2", 0.0, 0.1), ("s", "e", None, "1", "2", 12.5, 4.0)]), (8, "metro", [("s", "e", None, "1", "2", None, 1.0)])], f"route_id long, mode string, segments array<{seg}>")
    return exports.export_plans(plans, activities, entities, routes)


def test_nested_export(spark):
    out, problems = small_export(spark)
    got = {r.plan_id: json.loads(r.plan) for r in out.collect()}
    assert set(got) == {1, 2} and got[2] == {"people_number": 1, "start_city": "A", "target_city": "B", "itinerary": []}
    days = got[1]["itinerary"]
    assert [d["day"] for d in days] == [1, 2] and [a["type"] for a in days[0]["activities"]] == ["lunch", "accommodation"]
    lunch, stay = days[0]["activities"]
    assert lunch["price"] == 0 and lunch["transports"] == [] and lunch["position"] == "H" and "rooms" not in lunch
    assert [(x["mode"], x["cost"], x.get("cars")) for x in stay["transports"]] == [("walk", 0.0, None), ("taxi", 25.0, 2)] and stay["rooms"] == 0
    assert days[1]["activities"][0]["TrainID"] == "G1" and days[1]["activities"][0]["start"] == "a" and "position" not in days[1]["activities"][0]
    assert rows(problems) == [(3, 1, "no_entity"), (4, 1, "incomplete_route")]


def test_schema_rules(spark):
    out, _ = small_export(spark)
    bad = [(9, "nope"), (8, '{"people_number":"5","start_city":"x","itinerary":[{"day":0,"activities":{}},5]}'), (7, None), (6, '{"people_number":1.5,"start_city":null,"target_city":"B","itinerary":[]}')]
    got = rows(exports.schema_failures(out.unionByName(spark.createDataFrame(bad, "plan_id long, plan string"))))
    assert got == sorted(
        [(1, "activity.end_time", "pattern", 1), (1, "activity.rooms", "too_small", 1), (6, "plan.people_number", "wrong_type", 1), (6, "plan.start_city", "missing", 1), (7, "plan", "not_json", 1), (8, "day.activities", "wrong_type", 1)]
        + [(8, "day.activities", "missing", 1), (8, "day.day", "missing", 1), (8, "day.day", "too_small", 1), (8, "plan.people_number", "wrong_type", 1), (8, "plan.target_city", "missing", 1), (9, "plan", "not_json", 1)],
        key=repr,
    )


def test_compact_responses_keep_types(spark):
    one = {"items": [{"place_id": "p", "entity_type": "restaurant", "price": 12.50, "cuisine": {"k": [1]}, "open_time": None, "recommended_food": " , a、b", "latitude": 1}, {"transport_id": "t", "cost": 3, "latitude": 2}, {"transport_id": 5, "entity_type": "hotel"}, 5], "page": {"returned": 2, "x": 1}}
    given = [
        ("search_restaurants", one), ("search_hotels", {"items": None}), ("inspect_place", {"item": {"place_id": 7, "entity_type": "attraction", "recommended_min_hours": 1, "hotel_type": "x"}}), ("inspect_place", {"item": None}),
        ("get_route", {"route": {"route_id": "r", "segments": [{"start_time": "1", "end_time": "2"}, {"start_time": "3", "end_time": "4"}]}}), ("get_route", {"route": {"route_id": "r", "segments": []}}), ("save_candidate", {"status": "ok", "candidate": {"note": None, "evidence": {"price": 3, "x": 1}}}),
        ("list_candidates", {"items": [{"name": 'a"b'}, 3]}), ("submit_plan", {"status": "ok", "reward": 1}), ("other", {"a": 1}), ("submit_plan", [1]),
    ]
    df = spark.createDataFrame([(k, t, json.dumps(r)) for k, (t, r) in enumerate(given)] + [(99, "get_route", "nope"), (98, "get_route", None)], "k int, tool string, response string")
    got = {r.k: r.c and json.loads(r.c) for r in df.select("k", responses.compact_response(F.col("tool"), F.col("response")).alias("c")).collect()}
    assert got[0] == {"tool": "search_restaurants", "items": [{"place_id": "p", "entity_type": "restaurant", "price": 12.5, "cuisine": {"k": [1]}, "open_time": None, "recommended_food_hint": "a"}, {"transport_id": "t", "cost": 3}, {"entity_type": "hotel"}], "page": {"returned": 2}}
    assert got[1] == {"tool": "search_hotels", "items": [], "page": {}} and got[2]["item"] == {"place_id": 7, "entity_type": "attraction", "recommended_min_hours": 1} and got[3] == {"tool": "inspect_place"}
    assert got[4]["route"] == {"route_id": "r", "start_time": "1", "end_time": "4"} and got[5]["route"] == {"route_id": "r"} and got[6]["candidate"] == {"note": None, "price": 3}
    assert got[7] == {"tool": "list_candidates", "items": [{"name": 'a"b'}]} and got[8] == {"tool": "submit_plan", "status": "ok"} and got[9] == {"a": 1}
    assert got[10] is None and got[99] is None and got[98] is None


def test_scenario_is_laid_over_before_filter_and_order(spark):
    places = spark.createDataFrame([(1, "x", 10.0, 2, "a"), (2, "x", 20.0, 2, "b"), (3, "x", None, 2, "c"), (4, "x", 40.0, 1, "d"), (5, "y", 5.0, 1, "e")], "place_id long, city string, price double, room_type int, name string")
    given = [(1, "field_override", "price", "99.5", 1), (1, "field_override", "price", "30", 2), (2, "unavailable", None, None, 1), (3, "field_override", "price", "15", 1), (4, "field_override", "room_type", "no number", 1), (4, "field_override", "absent", "1", 1), (5, "field_override", "name", None, 1), (5, "note", "price", "1", 9), (9, "cancelled", None, None, 1)]
    effects = spark.createDataFrame(given, "place_id long, kind string, field string, after string, ord int")
    got = {r.place_id: tuple(r)[1:] for r in overlays.apply_scenario(places, effects).collect()}
    assert got == {1: ("x", 30.0, 2, "a"), 3: ("x", 15.0, 2, "c"), 4: ("x", 40.0, None, "d"), 5: ("y", 5.0, 1, None)}
    found = [(r.place_id, r["rank"], r.page) for r in overlays.search_scenario(places, effects, ["city"], low=10, high=35, page=1).orderBy("rank").collect()]
    assert found == [(3, 1, 0), (1, 2, 1)]
    assert rows(overlays.apply_scenario(places, effects.limit(0))) == rows(places)
    two = overlays.apply_scenario(places.withColumn("slot", F.explode(F.array(F.lit(1), F.lit(2)))), effects.withColumn("slot", F.lit(1)), ["slot", "place_id"])
    assert two.filter("slot = 2").count() == 5 and two.filter("slot = 1").count() == 4


def test_task_pages(spark):
    r = random.Random(3)
    made = [(k, r.choice(["hotel", "attraction"]), r.choice(["x", "y"]), f"name {r.choice('abc')}{k}", r.choice(["c", "d"]), r.randint(1, 3), r.choice([None, 5.0, 7.0, 9.0])) for k in range(120)]
    places = spark.createDataFrame(made, "place_id long, kind string, city string, name string, category string, room_type int, price double")
    asked = [(k, p[0], v, {"facet": r.choice(["c", "d"]), "room_type": str(r.randint(1, 3)), "named": f"name {r.choice('abc')}"}.get(v)) for k in range(300) for p in [r.choice(made)] for v in [r.choice(["plain", "price", "facet", "room_type", "named", "odd"])]] + [(999, 5000, "plain", None), (998, 3, None, None)]
    got = {x.task_id: x for x in overlays.task_page_index(spark.createDataFrame(asked, "task_id long, place_id long, variant string, value string"), places, page=4, step=2.0).collect()}
    by = {p[0]: p for p in made}
    for task, place, variant, value in asked:
        if place not in by:
            assert got[task]["rank"] is None
            continue
        p = by[place]
        fits = {"facet": lambda q: q[4] == value, "room_type": lambda q: str(q[5]) == value, "named": lambda q: value in q[3]}.get(variant)
        fits = fits if fits and fits(p) else None
        own = [q for q in made if q[1:3] == p[1:3] and (not fits or fits(q))]
        own.sort(key=lambda q: (q[6] is None, q[6] or 0, q[0]) if variant == "price" else q[0])
        rank = own.index(p) + 1
        assert (got[task]["rank"], got[task].page, got[task].variant) == (rank, (rank - 1) // 4, variant)


@pytest.mark.parametrize("most", [16 << 20, 700])
def test_names_of_a_lexicon(spark, most):
    r = random.Random(5)
    names = ["".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(60)] + ["", None, "é", "aa", "aaa"]
    texts = [(k, "".join(r.choice("abcd é") for _ in range(30))) for k in range(50)] + [(50, None), (51, ""), (52, "aaaa"), (52, "aaaa")]
    got = rows(lexicons.find_names(spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(n,) for n in names], "name string"), ["k"], "t", most_bytes=most))
    want = sorted(((k, n, sum(t.startswith(n, i) for i in range(len(t)))) for k, t in texts if t for n in set(filter(None, names)) if n in t), key=repr)
    assert got == want
    assert lexicons.find_names(spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([], "name string"), ["k"], "t").collect() == []


def test_city_guard(spark):
    tasks = spark.createDataFrame([(1, "from Rom to Ulm", "from Rom to Ulm by Bonn", ["Rom", "Ulm"]), (2, "Rom", "none", ["Rom"]), (3, "Rom", "Rom", None), (4, None, None, ["Rom"])], "task_id long, canonical string, query string, cities array<string>")
    got = rows(lexicons.city_guard(tasks, spark.createDataFrame([("Rom",), ("Ulm",), ("Bonn",)], "name string")).select("task_id", "introduced", "removed", "ok"))
    assert got == [(1, ["Bonn"], [], False), (2, [], ["Rom"], False), (3, [], [], True), (4, [], ["Rom"], False)]


def test_catalogue_requirements(spark):
    c = spark.createDataFrame([(1, 1, "entity_category", "attraction", ["park", "zoo"], None), (1, 2, "entity_attribute", "accommodation", ["", "spa", "pool"], None), (1, 3, "room_type", "accommodation", None, 2), (2, 1, "entity_category", "restaurant", ["park"], None), (2, 2, "total_budget", "trip", None, None)], "task_id long, ord int, kind string, scope string, values array<string>, room_type int")
    e = spark.createDataFrame([(1, 1, "attraction", "zoo", None, None), (1, 2, "attraction", "museum", None, None), (1, 3, "hotel", None, "pool and spa", 2), (1, 4, "hotel", None, "plain", 2), (1, 5, "hotel", None, None, 3), (2, 6, "attraction", "park", None, None), (3, 7, "restaurant", "park", None, None)], "task_id long, entity_id long, entity_type string, category string, hotel_type string, room_type int")
    got = {r.entity_id: r.facet for r in lexicons.catalogue_requirements(c, e).collect()}
    assert got == {1: "zoo", 2: None, 3: "spa", 4: "beds:2", 5: None, 6: None, 7: None}


def one_by_one(given, seen):
    out = {}
    for i, keys in given:
        hit = sorted(k for k in keys.items() if k[1] is not None and k in seen)
        out[i] = not hit
        if not hit:
            seen |= {k for k in keys.items() if k[1] is not None}
    return out


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_admission_equals_going_through_rows_one_by_one(spark, bits):
    r, seen, held, every = random.Random(7), set(), None, []
    for batch in range(3):
        given = [(100 * batch + k, {"a": r.choice([None, *"pqrstuvwxyz"]) and f"{r.randrange(40)}", "b": f"{r.randrange(60)}", "c": r.choice([None, f"{r.randrange(30)}"]), "d": f"{r.randrange(200)}"}) for k in range(40)] + [(100 * batch + 99, {"a": None, "b": None, "c": None, "d": None})]
        every += given
        df = spark.createDataFrame([(i, *(k[c] for c in "abcd")) for i, k in given], "id long, a string, b string, c string, d string").repartition(3)
        got = batches.admit(df, {c: F.col(c) for c in "abcd"}, "id", F.lit(0), batch, held, bits)
        held = got.seen
        want = one_by_one(given, seen)
        assert {x.id: x.accepted for x in got.verdicts.collect()} == want
        assert all(x.reason is None if x.accepted else x.reason.split(":")[0] in ("earlier", "batch") for x in got.verdicts.collect())
        if batch == 2:
            again = batches.admit(df, {c: F.col(c) for c in "abcd"}, "id", F.lit(0), 3, held, bits)
            fine = {x.id for x in again.verdicts.filter("accepted").collect()}
            assert fine == {299} and again.seen.count() == held.count()  # a row without keys collides with nothing
    whole = spark.createDataFrame([(i, *(k[c] for c in "abcd")) for i, k in every], "id long, a string, b string, c string, d string")
    one = batches.admit(whole, {c: F.col(c) for c in "abcd"}, "id", F.lit(0), 0)
    assert {x.id: x.accepted for x in one.verdicts.collect()} == one_by_one(every, set())
    assert batches.admit(whole.limit(0), {"a": F.col("a")}, "id", F.lit(0), 0).verdicts.collect() == []


def test_evidence_paths_equal_brute_force(spark):
    r = random.Random(9)
    wants = ["near_poi", "lower_total_cost", "lower_lodging_share", "other"]
    tasks = [(t, r.choice(["see Foo", "see Bar 附近", "", None]), r.choice([0, 5, 9, 20, None]), r.choice([None, [], r.sample(wants, 2)]), r.choice([None, [("total_budget", "trip")], [("total_budget", "day")]])) for t in range(80)]
    caps = [(t, k, r.randrange(6), r.choice([1, 4, 8, None])) for t in range(82) for k in (*evidence.KINDS, "odd") for _ in range(r.randrange(3))]
    ents = [(0, "Foo", "hotel"), (1, "Bar", "restaurant"), (2, "", "hotel"), (3, None, None), (4, "Foo", "attraction")]
    got = rows(evidence.select_paths(spark.createDataFrame(tasks, "task_id long, query string, steps_left int, preferences array<string>, constraints array<struct<kind:string,scope:string>>"), spark.createDataFrame(caps, "task_id long, kind string, candidate_id long, steps int"), spark.createDataFrame(ents, "candidate_id long, name string, entity_type string")))
    by, want = {e[0]: e for e in ents}, []
    for t, query, left, prefs, cons in tasks:
        prefs, own = prefs or [], {}
        for _, k, c, s in sorted((x for x in caps if x[0] == t), key=lambda x: (x[2], x[3] is not None, x[3] or 0)):
            own.setdefault(k, (c, s))
        types = {"attraction", "restaurant", "hotel"} if "lower_total_cost" in prefs or ("total_budget", "trip") in (cons or []) else {"hotel"} if "lower_lodging_share" in prefs else set()
        for k in sorted(own, key=lambda k: (evidence.KINDS.index(k) if k in evidence.KINDS else -1)):
            c, s = own[k]
            e = by.get(c, (c, None, None))
            called = {"opening_verification": bool(e[1]) and e[1] in (query or ""), "nearby_discovery": "near_poi" in prefs or "附近" in (query or ""), "candidate_comparison": e[2] in types}.get(k, False)
            fits = called and s is not None and left is not None and s <= left
            left = left - s if fits else left
            want.append((t, k, c, "not_called_for" if not called else "selected" if fits else "over_budget"))
    assert got == sorted(want, key=repr) and {w[3] for w in want} == {"not_called_for", "selected", "over_budget"}


def test_lengths_and_quarantine(spark):
    r = random.Random(2)
    made = [(s, f"m{s % 2}" if s else None, r.choice(["user", "assistant", "system"]), r.choice([None, "", "a b  c", "x " * r.randint(1, 30)]), r.choice([None, True, False])) for s in range(40) for _ in range(r.randint(1, 6))]
    df = spark.createDataFrame(made, "sample_id long, mode string, role string, content string, supervised boolean")
    a = lengths.audit_lengths(df, limit=40, overhead=1)
    seq, loss, masked = Counter(), Counter(), Counter()
    for s, _, role, content, on in made:
        n = len((content or "").split()) + 1
        seq[s] += n
        loss[s] += n if role == "assistant" and on else 0
        masked[s] += role == "assistant" and not on
    long = {s for s in seq if seq[s] > 40}
    assert {x.sample_id for x in a.quarantine.collect()} == long and {x.sample_id: (x.sequence_tokens, x.loss_tokens, x.masked_turns) for x in a.kept.collect()} == {s: (seq[s], loss[s], masked[s]) for s in seq if s not in long} and long
    total = a.totals.filter("mode is null").first()
    assert (total.samples, total.over_limit, total.sequence_tokens, total.loss_tokens, total.masked_turns, total.loss_ratio) == (40, len(long), sum(seq.values()), sum(loss.values()), sum(masked.values()), round(sum(loss.values()) / sum(seq.values()), 6))
    spread = a.distributions.filter("mode is null and metric = 'sequence_tokens'").first()
    order = sorted(seq.values())
    assert (spread.n, spread["min"], spread["max"], spread.p50, spread.p90) == (40, order[0], order[-1], order[round(39 * 0.5)], order[round(39 * 0.9)])
    assert a.totals.filter("mode = 'none'").first().samples == 1
    by_udf = lengths.audit_lengths(df, lengths.tokenizer(lambda: lambda texts: [len(t.split()) for t in texts]), limit=40, overhead=1)
    assert rows(by_udf.totals) == rows(a.totals)
    assert lengths.audit_lengths(df.limit(0)).totals.collect() == []


def test_gates(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 3, True), ("b", 5, None)], "k string, x int, ok boolean")
    own = [gates.Gate("g", "all_ok", F.bool_and("ok")), gates.Gate("g", "most", F.max("x"), "le", 4), gates.Gate("h", "rows", F.count("*"), "eq", 2, hard=False)]
    got = {(r.k, r.gate): r.passed for r in gates.gate_table(df, own, ["k"]).collect()}
    assert got == {("a", "all_ok"): True, ("a", "most"): True, ("a", "rows"): True, ("a", "accepted"): True, ("b", "all_ok"): False, ("b", "most"): False, ("b", "rows"): False, ("b", "accepted"): False}
    assert {(r.gate, r.passed) for r in gates.gate_table(df.filter("k = 'a'"), [gates.Gate("h", "rows", F.count("*"), "eq", 9, hard=False)]).collect()} == {("rows", False), ("accepted", True)}
    assert [r.passed for r in gates.gate_table(df.limit(0), own[:2]).collect()] == [False, False, False]


def test_required_keys_come_first(spark):
    """Order of keys in tools and in arguments, and unknown tools, in rows that are fine otherwise."""
    from waymill.operators import rows as rows_

    tool = lambda props, required: json.dumps({"name": "find", "parameters": {"properties": {p: {} for p in props}, "required": required}})
    good = tool("abc", ["a", "b"])
    body = '{"response_version": "r3", "valid_action": %s, "remaining_steps": 3, "tool_result": {}}'

    def row(k, tools, name, args, mode="react", mask=(True, True)):
        said = lambda n, a: ("assistant", "x", None, [(n, a)])
        messages = [("system", "s", None, []), ("user", "q", None, []), said(name, args), ("tool", body % str(mask[0]).lower(), None, []), said("find", '{"a": 1, "b": 2}')]
        return (k, "v3", "delta", "r3", mode, "text", False, list(mask), tools, messages)

    given = [
        row(0, [good], "find", '{"a": 1, "b": 2, "c": 3}'), row(1, [good], "find", '{"b": 1, "a": 2}'), row(2, [good], "find", '{"a": 1}'), row(3, [good], "other", '{"a": 1}'), row(4, [good], "other", "{}", "react_recovery", (False, True)),
        row(5, [tool("bac", ["a", "b"])], "find", '{"a": 1, "b": 2}'), row(6, ["search"], "other", "{}"), row(7, [tool("abc", [])], "find", "{}"),
    ]
    df = spark.createDataFrame(given, f"k int, format_version string, tool_response_mode string, response_version string, supervision_mode string, user_content_format string, enable_thinking boolean, loss_mask array<boolean>, tools array<string>, messages {rows_.MESSAGES}")
    got = {r.k: r.fault for r in rows_.first_fault(df).collect()}
    assert got == {0: None, 1: "arguments_order", 2: "arguments_order", 3: "unknown_tool", 4: None, 5: "tools_order", 6: None, 7: None}


def test_base_checks_are_no_rules_to_mine(spark):
    from waymill.operators import specs

    df = spark.createDataFrame([("result=(day_count(plan)==3)",), ("result = (people_count(plan) == 2)",), ("result=(other(plan)==2)",), ("total_cost<=5",)], "r string")
    assert [x.f for x in df.select(specs.mine_constraints(F.col("r"))["form"].alias("f")).collect()] == ["base_check", "base_check", "quarantine", "total_budget"]


def test_report_operators(spark):
    from waymill.operators import reports

    texts = [("价格更低，移除", True), ("标价高于它，移除", True), ("价格更低", False), ("移除", False), (None, False)]
    got = spark.createDataFrame(texts, "t string, w boolean").select("w", reports.price_comparison(F.col("t")).alias("g")).collect()
    assert all(r.g == r.w for r in got)
    times = [("00:00", True), ("21:00", True), ("09:00", True), ("08:00", False), ("24:00", False), ("9:00", False), ("09:30", False), (None, False)]
    assert all(r.g == r.w for r in spark.createDataFrame(times, "t string, w boolean").select("w", reports.is_coarse(F.col("t")).alias("g")).collect())
    steps = [(1, k, *x) for k, x in enumerate([("save_candidate", 5, None, None, None, None), ("list_candidates", None, None, None, None, None), ("remove_candidate", 5, None, None, None, "价格更低，移除"), ("remove_candidate", 6, None, None, None, "x"), ("search_nearby", None, None, 7, None, None), ("search_intercity_transport", None, None, None, None, None)])]
    found = rows(reports.action_violations(spark.createDataFrame(steps, "task_id int, step int, tool string, entity_id int, at_time string, radius int, top_k int, content string")))
    assert found == [(1, v, 1) for v in ("coarse_time", "radius", "removed_unreviewed", "removed_unsaved", "removed_without_price", "top_k")]
    whole = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "i int, h string")
    parts = whole.filter("i < 3").withColumn("part", F.lit("train")).unionByName(whole.filter("i > 1").withColumn("part", F.lit("test")))
    table = {r.gate: r.passed for r in reports.split_gates(whole, parts, "i", "h").collect()}
    assert table == {"repeated_id": True, "repeated_hash": True, "id_in_two_parts": False, "hash_in_two_parts": False, "in_no_part": True, "not_in_the_whole": True, "accepted": False}
    assert {r.gate: r.passed for r in reports.split_gates(whole, parts.filter("part = 'test' or i = 1"), "i", "h").collect()}["accepted"]
