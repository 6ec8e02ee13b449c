"""Tool calls of conversations: linked to their results, ordered, checked, serialised.

Calls and results meet by conversation and call id in a hash join. A call may need
the results of others; levels of the topological order are peeled off in rounds, each
a join on the ids, so a conversation of any number of calls needs no list. Arguments are
checked against the schema of their tool: JSON object, required and known names, types. The
record of a call is canonical JSON: no blanks, names sorted, absent values left out.

``problem`` names the first that applies: ``no id``, ``duplicate id``, ``unknown tool``,
``bad arguments``, ``missing need``, ``cycle``; else it is null. A call without a result has a null
``result``. Results without a call are not in the output. Of several results
of a call the one of the least turn counts, then the least text. Null arguments are bad ones.
Calls without a conversation have no id either, and are linked with nothing. Empty tables give an empty
result. Extra columns of calls and results are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialize

# Of each tool: the arguments with their JSON type and whether they are required.
Schemas = dict[str, dict[str, tuple[str, bool]]]
JSON_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",)}


def arguments_fit(arguments: Column, schema: dict[str, tuple[str, bool]]) -> Column:
    """Whether a JSON text is an object that fits the schema."""
    parsed = F.try_parse_json(arguments)
    names = F.json_object_keys(arguments)
    fits = names.isNotNull() & (F.size(F.array_except(names, F.array(*map(F.lit, schema)))) == 0)
    for name, (kind, required) in schema.items():
        value = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        right = F.lit(False)
        for prefix in JSON_TYPES[kind]:
            right = right | value.startswith(prefix)
        fits = fits & F.when(F.array_contains(names, name), F.coalesce(right, F.lit(False))).otherwise(not required)
    return F.coalesce(fits, F.lit(False))


def topological_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id`` and ``level``: 0 for calls that need none, else one more than
    the highest level they need; null for those in or behind a cycle.

    ``needs`` (conv_id, call_id, need) holds ids of ``calls`` only; no id is null. One round per level.
    """
    keys = ["conv_id", "call_id"]
    left, edges, level, done = calls.select(*keys).distinct(), needs.distinct(), 0, None
    while True:
        waiting = edges.select(*keys).distinct()
        ready = materialize(left.join(waiting, keys, "left_anti"), "ready")
        if not ready.limit(1).count():
            break
        numbered = ready.withColumn("level", F.lit(level))
        done = numbered if done is None else done.unionByName(numbered)
        left = materialize(left.join(ready, keys, "left_anti"), "left")
        met = ready.withColumnRenamed("call_id", "need")
        edges = materialize(edges.join(met, ["conv_id", "need"], "left_anti").select(*keys, "need"), "needs")
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call: ``conv_id``, ``call_id``, ``turn``, ``level``, ``problem`` and ``record``.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON) and needs (array of call
    ids). ``results``: conv_id, call_id, turn and content.
    """
    keys = ["conv_id", "call_id"]
    calls = calls.select(*keys, "turn", "name", "arguments", "needs")
    known = calls.groupBy(*keys).agg(F.count("*").alias("same")).dropna(subset=keys)
    asked = calls.dropna(subset=keys).select(*keys, F.explode("needs").alias("need")).distinct()
    ids = known.select("conv_id", F.col("call_id").alias("need"))
    missing = asked.join(ids, ["conv_id", "need"], "left_anti").select(*keys).distinct().withColumn("missing", F.lit(True))
    levels = topological_levels(known, asked.join(ids, ["conv_id", "need"], "left_semi"))
    first = F.min(F.struct("turn", "content")).alias("first")
    answers = results.where(F.col("call_id").isNotNull()).groupBy(*keys).agg(first)
    answers = answers.select(*keys, F.col("first.content").alias("result"))
    linked = calls.join(known, keys, "left").join(answers.hint("shuffle_hash"), keys, "left").join(missing, keys, "left").join(levels, keys, "left")
    fits = F.lit(False)
    for tool, schema in schemas.items():
        fits = F.when(F.col("name") == tool, arguments_fit(F.col("arguments"), schema)).otherwise(fits)
    problem = (
        F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "no id")
        .when(F.col("same") > 1, "duplicate id")
        .when(~F.coalesce(F.col("name").isin(*schemas), F.lit(False)), "unknown tool")
        .when(~fits, "bad arguments")
        .when(F.col("missing"), "missing need")
        .when(F.col("level").isNull(), "cycle")
    )
    # A variant keeps the names of an object sorted.
    whole = F.struct(
        F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", "result"
    )
    record = F.to_json(whole)
    return linked.select(*keys, "turn", "level", problem.alias("problem"), record.alias("record"))
