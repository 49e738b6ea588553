"""Typed settings, tool-call texts and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that read as "no output", and as true.
BLANK_OUTPUTS = ("", "None", "null", "N/A")
TRUE_WORDS = ("true", "1", "yes")


def typed_value(value: Column, data_type: Column) -> Column:
    """Struct with one typed field per supported type; an empty value is null in all of them."""
    v = F.when(value != "", value)
    return F.struct(
        F.when(data_type == "int", v.try_cast("bigint")).alias("int_value"),
        F.when(data_type == "float", v.try_cast("double")).alias("float_value"),
        F.when(data_type == "bool", F.lower(v).isin(*TRUE_WORDS)).alias("bool_value"),
        F.when(data_type == "list", F.from_json(v, "array<string>")).alias("list_value"),
        F.when(~data_type.isin("int", "float", "bool", "list"), v).alias("string_value"),
    )


def dotted_tool_name(tool: Column, parent: Column) -> Column:
    return F.concat_ws(".", F.when(parent != "", parent), tool)


def is_blank_output(output: Column) -> Column:
    return F.coalesce(F.trim(output).isin(*BLANK_OUTPUTS), F.lit(True))


def response_size(output: Column) -> Column:
    return F.when(is_blank_output(output), F.lit("None")).otherwise(
        F.concat(F.length(output).cast("string"), F.lit(" chars")))


def params_text(params: Column) -> Column:
    return F.array_join(
        F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def has_params(params: Column) -> Column:
    return F.coalesce(F.size(params) > 0, F.lit(False))


def tool_usage_text(call: Column) -> Column:
    """``tool with [k=v] -> output`` for one call."""
    out = F.when(is_blank_output(call["output_summary"]), F.lit("[]")).otherwise(call["output_summary"])
    given = F.when(has_params(call["input_params"]),
                   F.concat(F.lit(" with ["), params_text(call["input_params"]), F.lit("]")))
    return F.concat(call["tool_name"], F.coalesce(given, F.lit("")), F.lit(" -> "), out)


def tool_usage_summary(calls: Column) -> Column:
    return F.array_join(F.transform(calls, tool_usage_text), ", ")


def _entry_text(call: Column) -> Column:
    base = F.concat(params_text(call["input_params"]), F.lit(" (response: "),
                    response_size(call["output_summary"]), F.lit(")"))
    err = F.when(call["error"] != "", F.concat(F.lit(" [error: "), call["error"], F.lit("]")))
    return F.concat(base, F.coalesce(err, F.lit("")))


def simple_tool_summary(calls: Column) -> Column:
    """Per tool, in order of first use: which inputs worked, failed or came back empty."""
    with_params = F.filter(calls, lambda c: has_params(c["input_params"]))

    def one_tool(name: Column) -> Column:
        mine = F.filter(with_params, lambda c: c["tool_name"] == name)

        def entries(keep) -> Column:
            return F.array_join(F.transform(F.filter(mine, keep), _entry_text), ", ")

        ok = entries(lambda c: ~is_blank_output(c["output_summary"]) & c["success"])
        bad = entries(lambda c: ~is_blank_output(c["output_summary"]) & ~c["success"])
        empty = entries(lambda c: is_blank_output(c["output_summary"]))
        nothing = F.lit("")
        return F.concat(
            name,
            F.when(ok != "", F.concat(F.lit(" with ["), ok, F.lit("]"))).otherwise(nothing),
            F.when(bad != "", F.concat(F.when(ok != "", F.lit("; failed")).otherwise(nothing),
                                       F.lit(" with ["), bad, F.lit("]"))).otherwise(nothing),
            F.when(empty != "", F.concat(
                F.when((ok != "") | (bad != ""), F.lit("; returned empty")).otherwise(F.lit(" returned empty")),
                F.lit(" for ["), empty, F.lit("]"))).otherwise(nothing),
        )

    names = F.array_distinct(F.transform(with_params, lambda c: c["tool_name"]))
    return F.array_join(F.transform(names, one_tool), ", ")


def keep_sample(row_id: Column, rate: float) -> Column:
    """True for a fixed share of the ids: the same rows on every run and every retry."""
    bucket = F.conv(F.substring(F.md5(row_id.cast("string")), 1, 8), 16, 10).cast("bigint")
    return bucket % 1_000_000 < int(rate * 1_000_000)
