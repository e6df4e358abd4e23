"""Validation of fine-tuning rows: the first fault of each row, in one order of rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role: string, content: string, reasoning: string, calls: array<struct<name: string, arguments: string>>>>"


@dataclass(frozen=True)
class Protocol:
    """What a set of rows is written in: names of versions and modes."""

    versions: tuple[str, ...] = ("v1", "v2", "v3")
    current: str = "v3"
    action_only: tuple[str, ...] = ("v1", "v2")  # versions that know no other mode
    user_text: tuple[str, ...] = ("v2", "v3")  # versions whose second message is plain text
    responses: tuple[str, ...] = ("r1", "r2", "r3")
    current_responses: tuple[str, ...] = ("r2", "r3")
    modes: tuple[str, ...] = ("action_only", "react", "react_recovery", "action_selective")
    user_format: str = "text"


def _json(content: Column, sign: str) -> Column:
    """Whether a text is a JSON object ({) or array ([)."""
    return F.coalesce(F.trim(content).startswith(sign) & F.get_json_object(content, "$").isNotNull(), F.lit(False))


def _message_fault(m: Column, mode: Column, response_mode: Column, response_version: Column) -> Column:
    has = lambda key: F.get_json_object(m["content"], f"$.{key}").isNotNull()
    keys = F.coalesce(F.json_object_keys(m["content"]), F.array().cast("array<string>"))
    calls = F.coalesce(m["calls"], F.array().cast("array<struct<name:string,arguments:string>>"))
    assistant = (
        F.when(m["content"].isNull(), "content_no_text").when((mode == "action_only") & (m["content"] != ""), "content_not_empty")
        .when(F.size(calls) != 1, "not_one_call").when(~_json(F.get(calls, F.lit(0))["arguments"], "{"), "arguments_no_object")
    )
    needed = F.array(*map(F.lit, ("response_version", "valid_action", "remaining_steps", "tool_result")))
    delta = (
        F.when(F.size(F.array_except(needed, keys)) > 0, "delta_incomplete").when(~F.get_json_object(m["content"], "$.response_version").eqNullSafe(response_version), "response_versions_mixed")
        .when(F.arrays_overlap(keys, F.array(*map(F.lit, ("reward", "info", "observation")))), "delta_leaks")
    )
    snapshot = F.when(has("info.reward_detail") | ~F.coalesce(F.get_json_object(m["content"], "$.reward").try_cast("double") == 0, F.lit(False)), "snapshot_leaks")
    tool = F.when(~_json(m["content"], "{"), "tool_content_no_json").when(response_mode == "delta", delta).otherwise(snapshot)
    return F.when(m["reasoning"].isNotNull(), "reasoning").when(m["role"] == "assistant", assistant).when(m["role"] == "tool", tool)


def _first(keys: Column, required: Column) -> Column:
    """Whether the required keys come first, in their order."""
    return (F.size(required) == 0) | F.coalesce(F.slice(keys, 1, F.greatest(F.size(required), F.lit(1))) == required, F.lit(False))


def _required(tool: Column) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(tool, "$.parameters.required"), "array<string>"), F.array().cast("array<string>"))


def first_fault(rows: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """rows with fault: the code of the first rule that a row breaks, null if it breaks none.

    Columns: format_version, tool_response_mode, response_version, supervision_mode, user_content_format (strings),
    enable_thinking (boolean), loss_mask (array<boolean>), tools (array), messages (see MESSAGES). Where tools are JSON objects
    (name, parameters with properties and required), rows of the current version must have required keys first, in their order,
    in the tools' properties and in the arguments of calls, and call no unknown tool but in masked turns of recovery rows.
    """
    p = protocol
    c = F.col
    version, current = c("format_version"), c("format_version") == p.current
    mode = F.when(version.isin(*p.action_only), "action_only").otherwise(c("supervision_mode"))
    m = c("messages")
    role = lambda i: F.get(m, i)["role"]
    n = F.size(m)
    said = F.filter(m, lambda x: x["role"] == "assistant")
    user = F.get(m, F.lit(1))["content"]
    mask = c("loss_mask")
    is_not = lambda x: ~F.coalesce(x, F.lit(False))
    by_message = F.get(F.array_compact(F.transform(m, lambda x: _message_fault(x, mode, c("tool_response_mode"), c("response_version")))), F.lit(0))
    turns = F.sequence(F.lit(2), n - 1)
    alternates = F.forall(turns, lambda i: F.get(m, i)["role"] == F.when(i % 2 == 0, "assistant").otherwise("tool"))
    steps = F.filter(turns, lambda i: (i % 2 == 0) & (i + 1 < n))
    disagrees = F.exists(steps, lambda i: ~F.get(mask, F.floor((i - 2) / 2).cast("int")).eqNullSafe(F.coalesce(F.get_json_object(F.get(m, i + 1)["content"], "$.valid_action") == "true", F.lit(False))))
    schemas = F.filter(c("tools").cast("array<string>"), lambda t: _json(t, "{"))
    tools_disorder = F.exists(schemas, lambda t: ~_first(F.coalesce(F.json_object_keys(F.get_json_object(t, "$.parameters.properties")), F.array().cast("array<string>")), _required(t)))

    def call_fault(x: Column, i: Column) -> Column:
        call = F.get(x["calls"], F.lit(0))
        tool = F.get(F.filter(schemas, lambda t: F.get_json_object(t, "$.name") == call["name"]), F.lit(0))
        keys = F.coalesce(F.json_object_keys(call["arguments"]), F.array().cast("array<string>"))
        excused = mode.isin("react_recovery", "action_selective") & F.get(mask, i).eqNullSafe(F.lit(False))
        return F.when(tool.isNull(), F.when(~F.coalesce(excused, F.lit(False)), "unknown_tool")).when(~_first(keys, _required(tool)), "arguments_order")

    by_call = F.when(current & (F.size(schemas) > 0), F.get(F.array_compact(F.transform(said, call_fault)), F.lit(0)))
    rules = [
        ("version", is_not(version.isin(*p.versions))), ("no_messages", m.isNull() | c("tools").isNull()), ("thinking", is_not(c("enable_thinking") == F.lit(False))),
        ("response_mode", is_not(c("tool_response_mode").isin("delta", "snapshot"))), ("response_version", is_not(c("response_version").isin(*p.responses))),
        ("protocols_mixed", current & is_not(c("response_version").isin(*p.current_responses))), ("supervision_mode", is_not(mode.isin(*p.modes))),
        ("message_no_object", F.exists(m, lambda x: x.isNull())), ("no_system", (n < 3) | is_not(role(F.lit(0)) == "system")), ("boundaries", is_not((role(F.lit(1)) == "user") & (role(n - 1) == "assistant"))),
        ("user_format", version.isin(*p.user_text) & is_not(c("user_content_format") == p.user_format)), ("user_empty", version.isin(*p.user_text) & is_not(F.trim(user) != "")),
        ("user_json", version.isin(*p.user_text) & (_json(user, "{") | _json(user, "["))),
        ("mask", current & (mask.isNull() | (F.size(mask) != F.size(said)) | F.exists(mask, lambda x: x.isNull()))), ("mask_terminal", current & is_not(F.get(mask, F.size(mask) - 1))),
        ("mask_clean", current & mode.isin("action_only", "react") & F.exists(mask, lambda x: ~x)), ("tools_order", current & tools_disorder), (by_message, by_message.isNotNull()), (by_call, by_call.isNotNull()), ("alternation", is_not(alternates)),
        ("nothing_visible", mode.isin("react", "react_recovery") & ~F.exists(said, lambda x: F.trim(x["content"]) != "")),
        ("mask_disagrees", current & (mode != "action_selective") & disagrees),
    ]
    out = F.lit(None).cast("string")
    for code, broken in reversed(rules):
        out = F.when(broken, F.lit(code) if isinstance(code, str) else code).otherwise(out)
    return rows.withColumn("fault", out)
