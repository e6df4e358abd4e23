"""Task specifications: validation, hashes, mining from rule text, rendering, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of constraint with the operators each allows, and the scopes.
KINDS = {
    "activity_count": ["eq", "gte", "lte"],
    "category_budget": ["lte"],
    "entity_attribute": ["contains", "not_contains"],
    "entity_category": ["contains", "not_contains"],
    "exclude_entity": ["exclude", "not_contains"],
    "include_entity": ["contains", "include"],
    "room_count": ["eq", "gte", "lte"],
    "room_type": ["eq", "gte", "lte"],
    "time_window": ["gte", "lte"],
    "total_budget": ["lte"],
    "transport_mode": ["contains", "eq", "exclude", "include", "not_in"],
}
SCOPES = ("accommodation", "attraction", "day", "innercity_route", "intercity_transport", "itinerary", "restaurant", "trip")
VALUE_FIELD = {"activity_count": "count", "category_budget": "amount", "room_count": "count", "room_type": "room_type", "total_budget": "amount"}
LIST_FIELD = {"entity_attribute": "values", "entity_category": "values", "exclude_entity": "names", "include_entity": "names", "transport_mode": "modes"}


def lookup(table: dict, key: Column) -> Column:
    one = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), one(v))])[key]


def constraint_error(kind: Column, operator: Column, value: Column, scope: Column, hardness: Column) -> Column:
    """The first fault of a constraint, else null. value is JSON text."""
    number = F.get_json_object(value, "$.amount")
    for field in ("count", "room_type"):
        number = F.when(lookup(VALUE_FIELD, kind) == field, F.get_json_object(value, f"$.{field}")).otherwise(number)
    positive = F.coalesce(number.try_cast("double") > 0, F.lit(False))
    strings = F.from_json(F.get_json_object(value, "$.modes"), "array<string>")
    for field in ("values", "names"):
        strings = F.when(lookup(LIST_FIELD, kind) == field, F.from_json(F.get_json_object(value, f"$.{field}"), "array<string>")).otherwise(strings)
    groups = F.coalesce(F.from_json(F.get_json_object(value, "$.any_of"), "array<array<string>>"), F.array(strings))
    named = F.coalesce((F.size(groups) > 0) & F.forall(groups, lambda g: F.coalesce((F.size(g) > 0) & F.forall(g, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), F.lit(False))), F.lit(False))
    timed = F.get_json_object(value, "$.time").rlike(r"^([01]\d|2[0-3]):[0-5]\d$") & F.get_json_object(value, "$.leg").isin("outbound", "return") & F.get_json_object(value, "$.field").isin("start_time", "end_time")
    shaped = F.when(lookup(VALUE_FIELD, kind).isNotNull(), positive).when(lookup(LIST_FIELD, kind).isNotNull(), named).otherwise(F.coalesce(timed, F.lit(False)))
    ops = lookup(KINDS, kind)
    return (
        F.when(ops.isNull(), "unknown_kind").when(~F.coalesce(F.array_contains(ops, operator), F.lit(False)), "operator_not_allowed").when(~F.coalesce(scope.isin(*SCOPES), F.lit(False)), "unknown_scope")
        .when(~F.coalesce(hardness.isin("hard", "soft"), F.lit(False)), "unknown_hardness").when(~shaped, "bad_value")
    )


def validate_constraints(specs: DataFrame) -> DataFrame:
    """(spec_id, pos, constraint_id, error) of every constraint; error is null if it is fine. specs: spec_id, constraints, an
    array of (id, kind, operator, value, scope, hardness). An id used before in its spec is an error."""
    one = specs.select("spec_id", F.posexplode("constraints").alias("pos", "c"), F.transform("constraints", lambda c: c["id"]).alias("ids"))
    fault = constraint_error(F.col("c.kind"), F.col("c.operator"), F.col("c.value"), F.col("c.scope"), F.col("c.hardness"))
    again = F.array_position("ids", F.col("c.id")) <= F.col("pos")
    return one.select("spec_id", "pos", F.col("c.id").alias("constraint_id"), F.coalesce(fault, F.when(again, "repeated_id")).alias("error"))


def semantic_hash(*parts: Column) -> Column:
    """A hash of sets of texts that does not depend on their order."""
    return F.sha2(F.concat_ws("|", *[F.array_join(F.array_sort(F.transform(p, lambda x: F.sha2(x, 256))), ",") for p in parts]), 256)


def materialize(constraints: DataFrame, mentions: DataFrame) -> DataFrame:
    """(spec_id, n, n_missing, n_extra, status): every constraint must have a mention and the other way round."""
    a, b = constraints.select("spec_id", "constraint_id").distinct().withColumn("a", F.lit(1)), mentions.select("spec_id", "constraint_id").distinct().withColumn("b", F.lit(1))
    g = a.join(b, ["spec_id", "constraint_id"], "full").groupBy("spec_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("b").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col("a").isNull(), 1)).alias("n_extra"))
    return g.withColumn("status", F.when((F.col("n_missing") == 0) & (F.col("n_extra") == 0), "complete").otherwise("incomplete"))


# The forms of rule text that can be mined, asked in this order.
RULES = [
    ("per_person_budget", r"total_cost\s*<=\s*people_number\s*\*\s*(\d+(?:\.\d+)?)"),
    ("total_budget", r"total_cost\s*<=\s*(\d+(?:\.\d+)?)"),
    ("food_budget", r"food_cost\s*/\s*food_count\s*/\s*people_count\(plan\)\s*<=\s*(\d+(?:\.\d+)?)"),
    ("hotel_budget", r"hotel_cost\s*/\s*people_count\(plan\)\s*/\s*\(day_count\(plan\)-1\)\s*<=\s*(\d+(?:\.\d+)?)"),
    ("time_window", r"result\s*=\s*\((go_start_time|go_end_time|return_start_time|back_end_time)\s*(<=|>=)\s*['\"](\d{2}:\d{2})['\"]\)"),
]
#: Rule text that says again what a task's own fields say; no constraint comes of it.
BASE_CHECK = r"result\s*=\s*\((?:day_count|people_count)\(plan\)\s*==\s*\d+\)"
#: Kind, scope and basis of what each form says.
MEANS = {"per_person_budget": ("total_budget", "trip", "per_person"), "total_budget": ("total_budget", "trip", None), "food_budget": ("category_budget", "restaurant", "per_person_per_activity"), "hotel_budget": ("category_budget", "accommodation", "per_person_per_night"), "time_window": ("time_window", "intercity_transport", None)}


def mine_constraints(rule: Column) -> Column:
    """A struct of form, kind, scope, operator, value, basis, leg and field from a rule text; form is base_check for a check of
    days or people, quarantine if no form fits, and the rest is null then."""
    pattern = dict(RULES)["time_window"]
    part = lambda i: F.regexp_extract(rule, pattern, i)
    null = F.lit(None).cast("string")
    out = F.struct(F.when(rule.rlike(BASE_CHECK), "base_check").otherwise("quarantine").alias("form"), *[null.alias(n) for n in ("kind", "scope", "operator", "value", "basis", "leg", "field")])
    for form, pat in reversed(RULES):
        kind, scope, basis = MEANS[form]
        timed = form == "time_window"
        own = {
            "form": F.lit(form), "kind": F.lit(kind), "scope": F.lit(scope), "operator": F.when(part(2) == ">=", "gte").otherwise("lte") if timed else F.lit("lte"), "value": F.regexp_extract(rule, pat, 3 if timed else 1), "basis": F.lit(basis).cast("string"),
            "leg": F.when(part(1).startswith("go_"), "outbound").otherwise("return") if timed else null, "field": F.when(F.contains(part(1), F.lit("start_time")), "start_time").otherwise("end_time") if timed else null,
        }
        out = F.when(rule.rlike(pat), F.struct(*[v.alias(k) for k, v in own.items()])).otherwise(out)
    return out


def source_clause(text: Column, values: list[str], separators: str = "，。；") -> Column:
    """The clause around the first place of the longest value that the text holds; null if it holds none."""
    at, seps = F.lit(None).cast("string"), f"[{separators}]"
    for v in sorted(values, key=len):
        p = F.position(F.lit(v), text)
        before, after = F.split(F.substr(text, F.lit(1), p - 1), seps), F.split(F.substr(text, p), seps)
        at = F.when(p > 0, F.trim(F.concat(F.element_at(before, -1), F.element_at(after, 1)))).otherwise(at)
    return at


def render(clauses: DataFrame, templates: DataFrame, joiner: str = "; ") -> DataFrame:
    """(spec_id, query): a style's opening, the clauses in their order, and its closing. clauses: spec_id, style, ord, clause;
    templates: style, opening, closing, a small table."""
    g = clauses.groupBy("spec_id", "style").agg(F.array_sort(F.collect_list(F.struct("ord", "clause"))).alias("a"))
    body = F.array_join(F.transform("a", lambda x: x["clause"]), joiner)
    return g.join(F.broadcast(templates), "style").select("spec_id", F.concat("opening", body, "closing").alias("query"))
