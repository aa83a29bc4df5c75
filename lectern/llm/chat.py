"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

* Calls and results are hash-joined by (conversation, call id). Of several results for one call the earliest turn wins.
* A call whose arguments name other calls of its conversation ({"$ref": call id} anywhere in them) comes after those. A
  conversation's references are put in order in one pass, conversation after conversation in each task, each held while it is
  ordered. Those of more than LONG references, which a task shouldn't hold, take rounds of joins over all tasks: chains of
  calls that name one other call each are walked by pointer doubling, and what is left takes one round for each link of the
  longest chain of calls that name several. The calls of a circle never become ready and come last, flagged ``cyclic``.
  References to unknown calls are ignored and counted.
* Arguments are validated against the schema of the named tool: an object, required members present, no unknown members,
  types string, integer, number, boolean, object, array. A {"$ref": ...} stands for any type.
* Canonical JSON: members sorted by code point, no blanks, text unescaped but for what JSON demands; a surrogate without its
  partner, which no UTF-8 text can hold, stays an escape. It fails on no input: arguments that are no JSON object, or are
  nested deeper than Python's parser goes (some 10,000 levels), become null with ``valid`` false and an error.

Every call is a row. Calls that repeat an id are each validated and written; they share the id's result and its level, which
follows all that any of them refers to, and stand in order of turn. Calls without an id or conversation are kept, unlinked.
Texts are held one at a time, whatever their length. Extra columns are ignored, whatever their names; an empty table gives an
empty table.
"""
from __future__ import annotations

import json
import re
from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, maybe_broadcast, measured, partitions

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def encodable(text: str) -> str:
    """The text with surrogates that lack their partner as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return encodable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def references(value) -> list[str]:
    """The call ids that a value names, in order, once each."""
    found, todo = {}, [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if set(x) == {"$ref"} and isinstance(x["$ref"], str):
                found[x["$ref"]] = None
            else:
                todo += list(x.values())[::-1]
        elif isinstance(x, list):
            todo += x[::-1]
    return list(found)


def problem(value, schema: dict | None) -> str | None:
    """What is wrong with the arguments; schema: {member: {"type": name, "required": bool}}."""
    if not isinstance(value, dict):
        return "arguments are no object"
    if schema is None:
        return "unknown tool"
    for name in sorted(schema):
        if schema[name].get("required") and name not in value:
            return f"missing {name}"
    for name in sorted(value):
        if name not in schema:
            return f"unexpected {name}"
        x, kind = value[name], schema[name]["type"]
        if isinstance(x, dict) and set(x) == {"$ref"}:
            continue
        if not isinstance(x, KINDS[kind]) or isinstance(x, bool) and kind != "boolean":
            return f"{name} is no {kind}"
    return None


def check_arguments(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls(name, arguments) with canonical_arguments, refs, error."""

    @F.pandas_udf("canonical string, refs array<string>, error string")
    def check(names: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        rows = []
        for name, text in zip(names, arguments, strict=True):
            try:
                value = json.loads(text)
                out = canonical(value) if isinstance(value, dict) else None
            except (TypeError, ValueError, RecursionError):
                value = out = None
            said = problem(value, schemas.get(name))
            rows.append((out, [encodable(x) for x in references(value)], said and encodable(said)))
        return pd.DataFrame(rows, columns=["canonical", "refs", "error"])

    return calls.withColumn("_c", check("name", "arguments")).select(
        "*", F.col("_c.canonical").alias("canonical_arguments"), F.col("_c.refs").alias("refs"), F.col("_c.error").alias("error")).drop("_c")


#: References of a conversation that a task may hold.
LONG = 100_000


def levels_of(refs: dict[str, set[str]]) -> dict[str, int]:
    """The level of each call in {call: calls it names}: one above the highest it names, 0 for calls that name none; those that lead
    into circles are missing."""
    users: dict[str, list[str]] = defaultdict(list)
    waiting = {call: len(deps) for call, deps in refs.items()}
    for call, deps in refs.items():
        for dep in deps:
            users[dep].append(call)
    level = dict.fromkeys((dep for dep in users if dep not in refs), 0)
    ready = list(level)
    for call in ready:
        for user in users.get(call, ()):
            level[user] = max(level.get(user, 0), level[call] + 1)
            waiting[user] -= 1
            if not waiting[user]:
                ready.append(user)
    return {call: level[call] for call in ready}


def _order(batches):
    """Task: references sorted by conversation -> levels of the calls that have some."""
    conversation, refs = None, {}

    def ordered() -> pd.DataFrame:
        found = [(conversation, call, n) for call, n in levels_of(refs).items() if call in refs]
        return pd.DataFrame(found, columns=["conv_id", "call_id", "level"])

    for pdf in batches:
        done = []
        for conv, call, dep in zip(pdf["conv_id"], pdf["call_id"], pdf["dep"], strict=True):
            if conv != conversation:
                done.append(ordered())
                conversation, refs = conv, {}
            refs.setdefault(call, set()).add(dep)
        if done:
            yield pd.concat(done)
    yield ordered()


def levels(calls: DataFrame, long: int | None = None) -> DataFrame:
    """calls(conv_id, call_id, refs) -> (conv_id, call_id, level) of each id, behind what any of its calls refers to; circles are
    missing."""
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key).distinct()
    edges = calls.select(*key, F.explode("refs").alias("dep")).distinct()
    known = nodes.select("conv_id", F.col("call_id").alias("dep"))
    edges, seen = measured(edges.join(known, ["conv_id", "dep"], "left_semi"), "references")
    first = nodes.join(edges.select(*key), key, "left_anti").withColumn("level", F.lit(0))
    if not seen["rows"]:
        return first
    sizes, seen = measured(edges.groupBy("conv_id").agg(F.count("*").alias("_n")).where(F.col("_n") > (LONG if long is None else long)), "long")
    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in key)
    short = edges if not seen["rows"] else edges.join(maybe_broadcast(sizes, seen["rows"]), "conv_id", "left_anti")
    found = short.repartition("conv_id").sortWithinPartitions("conv_id").mapInPandas(_order, f"{kinds}, level int")
    found = first.unionByName(found)
    if seen["rows"]:
        held = lambda df: df.join(maybe_broadcast(sizes, seen["rows"]), "conv_id", "left_semi")
        far = _levels_by_rounds(durable(held(nodes), "calls"), durable(held(edges), "references"))
        found = found.unionByName(far.join(first.select(*key), key, "left_anti"))
    return durable(found, "level")


def _levels_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``levels`` of conversations of any size."""
    key = ["conv_id", "call_id"]
    degrees = durable(edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("dep").alias("dep")), "degrees")
    # Calls with one reference: ``dep`` jumps twice as far each round, until it is a call with none or several.
    ends = F.when(F.col("m") == 1, F.lit("going")).when(F.col("m") > 1, F.lit("several")).otherwise(F.lit("none"))
    jumps = degrees.where("n = 1").select(*key, "dep").join(degrees.select("conv_id", F.col("call_id").alias("dep"), F.col("n").alias("m")), ["conv_id", "dep"], "left")
    jumps = durable(jumps.select(*key, "dep", F.lit(1).alias("far"), ends.alias("end")), "jumps")
    going, chains = jumps.where("end = 'going'"), [jumps.where("end <> 'going'")]
    while not going.isEmpty():
        ahead = reduce(DataFrame.unionByName, [*chains, going]).select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("next"), F.col("far").alias("more"), F.col("end").alias("at"))
        moved = durable(going.join(ahead, ["conv_id", "dep"]).select(*key, F.col("next").alias("dep"), (F.col("far") + F.col("more")).alias("far"), F.col("at").alias("end")), "jumps")
        arrived = moved.where("end <> 'going'")
        if arrived.isEmpty():  # the rest runs into circles
            break
        chains.append(arrived)
        going = moved.where("end = 'going'")
    chains = durable(reduce(DataFrame.unionByName, chains), "chains")
    done = durable(nodes.join(degrees, key, "left_anti").withColumn("level", F.lit(0)), "level")
    # References between calls with several, each through the chain between them.
    hops = chains.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("end"), "far")
    several = edges.join(degrees.where("n > 1").select(*key), key, "left_semi").join(hops, ["conv_id", "dep"], "left")
    edges = durable(several.select(*key, F.coalesce("end", "dep").alias("dep"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.lit(0).alias("level")), "references")
    all_, fresh = [done], done
    while not edges.isEmpty():
        ready = fresh.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("_at"))
        edges = durable(edges.join(ready, ["conv_id", "dep"], "left").select(
            *key, F.when(F.col("_at").isNull(), F.col("dep")).alias("dep"), "far", F.coalesce(F.col("_at") + F.col("far"), "level").alias("level")), "references")
        state = durable(edges.groupBy(*key).agg(F.count("dep").alias("open"), F.max("level").alias("level")), "waiting")
        fresh = durable(state.where("open = 0").select(*key, "level"), "level")
        if fresh.isEmpty():
            break
        all_.append(fresh)
        edges = durable(edges.join(state.where("open > 0").select(*key), key, "left_semi"), "references")
    done = reduce(DataFrame.unionByName, [*all_, chains.where("end = 'none'").select(*key, F.col("far").alias("level"))])
    several = reduce(DataFrame.unionByName, all_).select("conv_id", F.col("call_id").alias("dep"), "level")
    behind = chains.where("end = 'several'").join(several, ["conv_id", "dep"]).select(*key, (F.col("level") + F.col("far")).alias("level"))
    return durable(done.unionByName(behind), "level")


def positions(placed: DataFrame) -> DataFrame:
    """``placed`` with the position of each call in its conversation: the table is sorted over all tasks, and a call's place
    is that in its task behind the counts of the conversation in the tasks before, so that no conversation is in one task."""
    order = [F.col("level").asc_nulls_last(), F.col("turn").asc(), F.col("call_id").asc()]
    ties = F.xxhash64("name", "arguments")
    dealt = placed.repartitionByRange(partitions(placed.sparkSession), F.col("conv_id").asc(), *order, ties).withColumn("_p", F.spark_partition_id())
    dealt = durable(dealt, "placed")
    counts = dealt.groupBy("conv_id", "_p").agg(F.count("*").alias("_n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = base.select(F.col("conv_id").alias("_conv"), F.col("_p").alias("_part"), "_base")
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id", "_p").orderBy(*order)) - 1)
    out = ranked.join(base, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_p") == F.col("_part")))
    return out.withColumn("position", (F.col("_base") + F.col("_k")).cast("long")).drop("_p", "_k", "_conv", "_part", "_base")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls(conv_id, call_id, turn, name, arguments), results(conv_id, call_id, turn, content) -> per call: conv_id, call_id,
    position (in its conversation, from 0), level, cyclic, linked, valid, error, message (canonical JSON)."""
    base = calls.select("conv_id", "call_id", "turn", "name", "arguments")
    named = base.where("conv_id is not null and call_id is not null")
    loose = base.where("conv_id is null or call_id is null")
    checked = durable(check_arguments(named, schemas), "calls")
    first = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min_by("content", F.struct("turn", "content")).alias("_content"), F.lit(True).alias("_hit"))
    linked = checked.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    placed = linked.join(levels(checked), ["conv_id", "call_id"], "left").unionByName(check_arguments(loose, schemas), allowMissingColumns=True)
    out = positions(placed)

    @F.pandas_udf("string")
    def message(call_id: pd.Series, name: pd.Series, arguments: pd.Series, content: pd.Series, hit: pd.Series) -> pd.Series:
        none = lambda x: None if x is None or x != x else x
        rows = []
        for i, n, a, c, h in zip(call_id, name, arguments, content, hit, strict=True):
            call = {"id": none(i), "name": none(n), "arguments": json.loads(a) if none(a) else None}
            rows.append(canonical({"call": call, "result": none(c)} if none(h) else {"call": call}))
        return pd.Series(rows, dtype=object)

    return out.select(
        "conv_id", "call_id", "position", F.col("level").cast("long").alias("level"),
        (F.col("level").isNull() & F.col("call_id").isNotNull()).alias("cyclic"), F.coalesce("_hit", F.lit(False)).alias("linked"),
        F.col("error").isNull().alias("valid"), "error",
        message("call_id", "name", "canonical_arguments", "_content", "_hit").alias("message"))


def unlinked_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that answer no call of their conversation."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
