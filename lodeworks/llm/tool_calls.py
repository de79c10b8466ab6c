"""Tool calls in chats: linked to their results, put in topological order, validated and written as canonical JSON.

Calls and results are joined by (conversation, identifier) in a shuffled hash join; of several with the same
identifier the earliest counts (a null turn before all), and the others are numbered. A call's level is one more than
the highest level of the calls it depends on. Conversations of up to EDGES dependencies are levelled each in a task;
in longer ones, calls that wait for one other are followed through by doubling, so rounds are about the logarithm of
the longest chain of such, and no conversation of any length is gathered anywhere. Calls in a circle, or that depend
on one, have no level. Arguments are checked against their tool's schema, and messages are written with sorted keys
and without white space. Rows are dealt out by ranges of (conversation, level, turn, identifier), in which they are
sorted, so a conversation of any length has its order without a task that holds it.
"""

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KEY = ["conv_id", "call_id"]
#: Dependencies of a conversation up to which one task levels it.
EDGES = 20_000
_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
    "number": lambda v: not isinstance(v, bool) and isinstance(v, int | float),
}


def canonical(value) -> str:
    """JSON with sorted keys, no white space, whole numbers without a fraction; lone surrogates, which no text can hold,
    as escapes."""

    def plain(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("not a JSON number")
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return escaped(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def escaped(s: str) -> str:
    """A text whose lone surrogates are written as escapes."""
    return s if s.isascii() else re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", s)


def violations(value, schema: dict, at: str = "$") -> Iterator[str]:
    """What of a schema a value breaks: type, enum, required, properties, additionalProperties, items, minimum,
    maximum, minLength, maxLength, minItems, maxItems, pattern."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        yield f"{at}: not {' or '.join(kinds)}"
        return
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):  # true is not 1, but 1.0 is
        yield f"{at}: not in enum"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        yield from (f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value)
        for k in sorted(value):
            if k in own:
                yield from violations(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}.{k}: unknown"
    elif isinstance(value, list):
        for i, v in enumerate(value if "items" in schema else []):
            yield from violations(v, schema["items"], f"{at}[{i}]")
    size = len(value) if isinstance(value, str | list) else None
    low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
    if size is not None and size < schema.get(low, 0):
        yield f"{at}: too short"
    if size is not None and size > schema.get(high, size):
        yield f"{at}: too long"
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        yield f"{at}: no match"
    if _TYPES["number"](value) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        yield f"{at}: out of range"


def checked(schema, at: str = "$") -> None:
    """Raises ValueError for a schema that names an unknown type or is none."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: not a schema")
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in _TYPES:
            raise ValueError(f"{at}: unknown type {kind!r}")
    for name, own in schema.get("properties", {}).items():
        checked(own, f"{at}.{name}")
    if "items" in schema:
        checked(schema["items"], f"{at}[]")


def in_task(edges: list[tuple]) -> dict:
    """Call -> level, of the calls of one conversation that depend on others. edges: (call, needs)."""
    waits, after, level = defaultdict(int), defaultdict(list), {}
    for call, needs in edges:
        waits[call] += 1
        after[needs].append(call)
    done = [x for x in after if x not in waits]
    level = dict.fromkeys(done, 0)
    while done:
        x = done.pop()
        for call in after[x]:
            level[call] = max(level.get(call, 0), level[x] + 1)
            waits[call] -= 1
            if not waits[call]:
                done.append(call)
    return {call: level[call] for call, n in waits.items() if not n}


def _levels_of_short(needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that need others, a conversation in a row."""
    kinds = {f.name: f.dataType.simpleString() for f in needs.schema.fields}
    grouped = needs.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "needs")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv, call, n) for conv, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for call, n in in_task([(e["call_id"], e["needs"]) for e in edges]).items()]
            kinds_of = (batch.schema.field(0).type, batch.schema.field(1).type.value_type.field(0).type, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), kinds_of, strict=True)], [*KEY, "level"])

    return grouped.mapInArrow(run, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, level int")


def _levels_of_long(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level), in rounds. calls: conv_id, call_id. A call is open while it waits for another. One
    that waits for a single open call u has the level max(own, level(u) + gap), and two such steps in a row are one
    such step: in each round, all steps double. Then what is settled is passed on."""
    start = calls.join(needs.select(*KEY).distinct(), KEY, "left_anti").withColumn("level", F.lit(0))
    done = settled = written(start, "tools-level")
    # An edge: the call's level is at least level(needs) + gap; own: what settled calls demand of it.
    edges = written(needs.withColumn("gap", F.lit(1)), "tools-edges")
    own = written(calls.withColumn("own", F.lit(0)), "tools-own")
    while True:
        met = edges.join(settled.select("conv_id", F.col("call_id").alias("needs"), "level"), ["conv_id", "needs"], "left")
        met = written(met, "tools-met")
        asked = met.where("level is not null").select(*KEY, (F.col("level") + F.col("gap")).alias("own"))
        own = written(own.unionByName(asked).groupBy(*KEY).agg(F.max("own").alias("own")), "tools-own")
        edges = written(met.where("level is null").select(*KEY, "needs", "gap"), "tools-edges")
        closed = own.join(edges.select(*KEY).distinct(), KEY, "left_anti").join(done, KEY, "left_anti")
        settled = written(closed.select(*KEY, F.col("own").alias("level")), "tools-level")
        if settled.isEmpty():
            return done  # every open call waits for another open one: circles, and what depends on them
        done = written(done.unionByName(settled), "tools-done")
        # Calls that wait for one other: single(call) = max(own, needs + gap).
        single = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("needs").alias("then"), F.max("gap").alias("more")).where("n = 1").join(own, KEY)
        single = single.select("conv_id", F.col("call_id").alias("needs"), "then", "more", F.col("own").alias("least"))
        jumped = edges.join(single, ["conv_id", "needs"], "left")
        jumped = written(jumped, "tools-jumped")
        moved = jumped.where("then is not null")
        own = written(own.unionByName(moved.select(*KEY, (F.col("least") + F.col("gap")).alias("own"))).groupBy(*KEY).agg(F.max("own").alias("own")), "tools-own")
        to = jumped.select(*KEY, F.coalesce("then", "needs").alias("needs"), (F.col("gap") + F.coalesce("more", F.lit(0))).alias("gap"))
        edges = written(to.groupBy(*KEY, "needs").agg(F.max("gap").alias("gap")), "tools-edges")


def levels(calls: DataFrame, needs: DataFrame, edges: int = EDGES) -> DataFrame:
    """(conv_id, call_id, level). needs: conv_id, call_id, needs (a call_id); ones that name no call don't count."""
    needs = written(needs.join(calls.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi").distinct(), "tools-needs")
    sizes = needs.groupBy("conv_id").agg(F.count("*").alias("n"))
    long = written(sizes.where(F.col("n") > edges).select("conv_id"), "tools-long")
    free = calls.select(*KEY).join(long, "conv_id", "left_anti").join(needs.select(*KEY), KEY, "left_anti").withColumn("level", F.lit(0))
    out = free.unionByName(_levels_of_short(needs.join(long, "conv_id", "left_anti")))
    if long.isEmpty():
        return out
    return out.unionByName(_levels_of_long(calls.select(*KEY).join(long, "conv_id", "left_semi"), needs.join(long, "conv_id", "left_semi")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row a call or lone result, in topological order: conv_id, call_id, call_turn, result_turn, level, n_calls,
    n_results, status, errors, message, position (in the conversation, from 1: by level, rows without one last, then
    turn, then identifier).

    calls: conv_id, call_id, turn, name, arguments (JSON text), needs (array of call ids or null).
    results: conv_id, call_id, turn, content. status: ok, invalid (arguments break the schema, or are no JSON, or no tool has the name),
    pending (no result), early (the result comes before the call), orphan (no call). message: the canonical JSON of
    call and result, texts whole.

    Rows without a conversation or an identifier are left out of the join and count as pending or orphan each; null
    arguments are JSON's null, null contents too; of calls that agree in turn, too, the one of the smaller name and
    arguments counts. Empty tables give what the other table gives alone. Other columns are not read. A schema that
    names an unknown type is an error at once. Texts are read and written whole, however long; lone surrogates in
    arguments are written as escapes; arguments that are nested deeper than Python's parser goes are no JSON.
    """
    for name, schema in schemas.items():
        checked(schema, name)
    named = lambda df: df.where("conv_id is not null and call_id is not null")
    first = lambda df, cols: named(df).groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("turn", *cols)).alias("x")).select(*KEY, "n", "x.*")
    one_call = written(first(calls, ["name", "arguments", "needs"]), "tools-calls")
    one_result = first(results, ["content"])
    level = levels(one_call, one_call.select(*KEY, F.explode("needs").alias("needs")))
    call = one_call.join(level.hint("shuffle_hash"), KEY, "left").select(*KEY, F.col("turn").alias("call_turn"), "name", "arguments", "level", F.col("n").alias("n_calls"))
    result = one_result.select(*KEY, F.col("turn").alias("result_turn"), "content", F.col("n").alias("n_results"))
    both = call.join(result.hint("shuffle_hash"), KEY, "full_outer")
    lone = calls.where("conv_id is null or call_id is null").select(*KEY, F.col("turn").alias("call_turn"), "name", "arguments", F.lit(1).cast("long").alias("n_calls"))
    lone_results = results.where("conv_id is null or call_id is null").select(*KEY, F.col("turn").alias("result_turn"), "content", F.lit(1).cast("long").alias("n_results"))
    both = both.unionByName(lone, True).unionByName(lone_results, True).fillna(0, ["n_calls", "n_results"])
    order = [F.asc("conv_id"), F.col("level").asc_nulls_last(), F.coalesce("call_turn", "result_turn").asc(), F.asc("call_id")]
    both = written(both, "tools-both").repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, nth = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            status, errors, message, places = [], [], [], []
            for r in batch.to_pylist():
                wrong, arguments = [], "null"
                if r["n_calls"]:
                    try:
                        given = json.loads(r["arguments"] or "null")
                        arguments = canonical(given)
                        wrong = list(map(escaped, violations(given, schemas[r["name"]]))) if r["name"] in schemas else ["no such tool"]
                    except (ValueError, RecursionError):
                        arguments, wrong = "null", ["no JSON"]
                state = "orphan" if not r["n_calls"] else "invalid" if wrong else "pending" if not r["n_results"] else "early" if (r["result_turn"] or 0) < (r["call_turn"] or 0) else "ok"
                # Keys in order; the arguments are the text that was checked, so nesting goes no deeper here.
                own = [f'"call":{{"arguments":{arguments},"name":{canonical(r["name"])}}}'] if r["n_calls"] else []
                own += [f'"id":{canonical(r["call_id"])}'] + ([f'"result":{canonical(r["content"])}'] if r["n_results"] else [])
                conv, nth = r["conv_id"], nth + 1 if r["conv_id"] == conv else 1
                for to, v in zip((status, errors, message, places), (state, wrong, "{" + ",".join(own) + "}", nth), strict=True):
                    to.append(v)
            made = [pa.array(v, t) for v, t in ((status, pa.string()), (errors, pa.list_(pa.string())), (message, pa.string()), ([part] * len(status), pa.int64()), (places, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in OUT), *made], [*OUT, "status", "errors", "message", "part", "nth"])

    OUT = ["conv_id", "call_id", "call_turn", "result_turn", "level", "n_calls", "n_results"]
    judged = both.mapInArrow(judge, ", ".join(f"{c} {kinds[c]}" for c in OUT) + ", status string, errors array<string>, message string, part long, nth long")
    judged = written(judged, "tools-judged")
    # A part may go on with the conversation that the one before it ends with: at most one conversation a part.
    pieces = judged.groupBy("conv_id", "part").agg(F.max("nth").alias("rows"))
    several = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("long"))
    ahead = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("rows")
    known = pieces.join(several, F.col("conv_id").eqNullSafe(F.col("long")), "left_semi").select(F.col("conv_id").alias("of"), F.col("part").alias("at"), ahead.alias("ahead"))
    placed = judged.join(F.broadcast(known), (F.col("part") == F.col("at")) & F.col("conv_id").eqNullSafe(F.col("of")), "left")  # two rows a part at most
    return placed.select(*OUT, "status", "errors", "message", (F.col("nth") + F.coalesce("ahead", F.lit(0))).alias("position"))
