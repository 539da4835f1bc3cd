"""Tool-call linking for chat corpora: join by identifier, order, validate, serialise. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import discard, stored

#: field -> (type as schema_of_variant names it, required), per tool.
Schemas = dict[str, dict[str, tuple[str, bool]]]


def chains(need: DataFrame) -> DataFrame:
    """node, up, dist of nodes that wait for one other only: the first node up the chain that waits for none or for
    several, and how many steps away it is. Pointers double, so a chain of any length takes its logarithm of rounds.

    On or behind a cycle of such nodes `up` stays inside it: what still moves after more steps than there are nodes.
    need: node, need (how many it waits for), on (one of them)."""
    hops = stored(need.where("need = 1").select("node", F.col("on").alias("up"), F.lit(1).cast("bigint").alias("dist")))
    n, reach = hops.count(), 1
    while reach <= n:
        jump = hops.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("d2"))
        far = stored(hops.join(jump, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), F.col("up2").isNotNull().alias("moved")))
        discard(hops)
        hops, reach = far, 2 * reach
        if far.where("moved").limit(1).count() == 0:
            break
    return hops.select("node", "up", "dist")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level: 0 for nodes that wait for none, else one more than the highest level they wait for.

    edges: node, on (distinct, both in nodes). Chains of single dependencies are contracted first (`chains`). Over the
    nodes that wait for several, rounds then follow their depth until none gets a level any more; a round reads the
    edges still open, which are written anew once half of them are answered. Nothing is gathered by conversation.
    Nodes on or behind a cycle have no row.
    """
    need = stored(edges.groupBy("node").agg(F.count("*").alias("need"), F.min("on").alias("on")))
    hops = chains(need)
    roots = stored(nodes.select("node").join(need, "node", "left_anti").select("node", F.lit(0).cast("bigint").alias("level")))
    many = need.where("need > 1").select("node", "need")
    up = hops.select(F.col("node").alias("on"), "up", "dist")
    far = edges.join(many, "node", "left_semi").join(up, "on", "left")
    open_ = stored(far.select("node", F.coalesce("up", "on").alias("on"), (1 + F.coalesce("dist", F.lit(0))).alias("step")))
    left, fronts, fresh, met = open_.count(), [roots], [], None
    answered, front = 0, roots
    while left:
        # (node, how many of its dependencies have a level, the highest they lead to)
        new = open_.join(front.withColumnRenamed("node", "on"), "on").groupBy("node").agg(F.count("*").alias("n"), F.max(F.col("level") + F.col("step")).alias("level"))
        new = new if met is None else met.unionByName(new).groupBy("node").agg(F.sum("n").alias("n"), F.max("level").alias("level"))
        new = stored(new.join(many, "node").withColumn("ready", F.col("n") == F.col("need")))
        met = new.where("not ready").select("node", "n", "level")
        front = stored(new.where("ready").select("node", "level", "need"))
        edges_done = front.agg(F.sum("need")).first()[0]
        if edges_done is None:
            break
        front = front.select("node", "level")
        fronts.append(front), fresh.append(front)
        answered += edges_done
        if 2 * answered >= left:  # edges of nodes with a level are answered
            gone = reduce(DataFrame.unionByName, fresh).select("node")
            open_, left, answered, fresh = stored(open_.join(gone, "node", "left_anti")), left - answered, 0, []
    known = stored(reduce(DataFrame.unionByName, fronts))
    behind = hops.join(known.withColumnRenamed("node", "up"), "up").select("node", (F.col("level") + F.col("dist")).alias("level"))
    return known.unionByName(behind)


def _errors(name: Column, args: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments of one call, in the order of the tool's schema."""
    out = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("unknown_tool")))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            got = F.schema_of_variant(F.try_variant_get(args, F.lit(f"$.{field}"), "variant"))
            checks.append(F.when(got.isNull() | (got == "VOID"), F.lit(f"missing:{field}") if required else F.lit(None)).when(got != kind, F.lit(f"type:{field}")))
        out = out.when(name == tool, F.array_compact(F.array(*checks)))
    return F.when(args.isNull(), F.array(F.lit("invalid_json"))).otherwise(out)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, call_id, name, turn, level, has_result, valid, errors, canonical: one row per call.

    calls: conv_id, call_id, name, arguments (JSON text), after (ids waited for), turn. results: conv_id, call_id,
    turn, content. Ids name calls within a conversation: calls, results and dependencies meet by (conv_id, call_id),
    rows of a null conv_id as one conversation. Of several rows with one id in a conversation the earliest counts.
    (level, turn, call_id) orders a conversation topologically; a call on or behind a cycle has level null. Results
    without a call are rows with the error orphan_result. Calls without an id are rows of their own with missing_id;
    results without an id are left out. Unknown dependencies are reported and not waited for. canonical is JSON with
    sorted keys and no spaces; null fields stay. Empty tables give no rows; other columns are ignored.
    """
    node = lambda id_: F.struct(F.col("conv_id").alias("c"), F.col(id_).alias("i"))
    picked = F.struct("turn", "name", "arguments", "after")
    one = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(picked).alias("c"))
    one = stored(one.select(node("call_id").alias("node"), "conv_id", "call_id", "c.*"))
    waits = one.select("node", "conv_id", F.explode("after").alias("on")).where("on is not null").select("node", node("on").alias("on")).distinct()
    known = one.select(F.col("node").alias("on"))
    missing = waits.join(known, "on", "left_anti").groupBy("node").agg(F.lit(True).alias("unknown"))
    level = levels(one, stored(waits.join(known, "on", "left_semi").select("node", "on")))
    got = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    got = got.select(node("call_id").alias("node"), "r")
    none = lambda k: F.lit(None).cast(k)
    no_id = calls.where("call_id is null").select(
        "conv_id", none("string").alias("call_id"), "turn", "name", "arguments", F.lit(0).cast("bigint").alias("level"), none("boolean").alias("unknown"),
        none(got.schema["r"].dataType).alias("r"), F.lit(True).alias("is_call"),
    )
    linked = one.drop("conv_id", "call_id").join(level, "node", "left").join(missing, "node", "left").withColumn("is_call", F.lit(True)).join(got, "node", "full_outer")
    linked = linked.withColumns({"conv_id": F.col("node.c"), "call_id": F.col("node.i").cast("string")})
    rows = linked.select(no_id.columns).unionByName(no_id).withColumn("args", F.try_parse_json("arguments"))
    call = F.col("is_call").isNotNull()
    flag = lambda cond, name: F.when(cond, F.lit(name))
    errors = F.concat(
        F.when(call, _errors(F.col("name"), F.col("args"), schemas)).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(
            flag(call & F.col("call_id").isNull(), "missing_id"), flag(call & F.col("r").isNull(), "missing_result"),
            flag(F.col("unknown"), "unknown_dependency"), flag(call & F.col("level").isNull(), "cyclic"), flag(~call, "orphan_result"),
        )),
    )
    record = F.struct(F.col("args").alias("arguments"), F.col("conv_id").alias("conv"), F.col("call_id").alias("id"), "name", F.col("r.content").alias("result"))
    return rows.withColumn("e", errors).select(
        "conv_id", "call_id", "name", "turn", "level", F.col("r").isNotNull().alias("has_result"), (F.size("e") == 0).alias("valid"),
        F.array_join("e", ",").alias("errors"), F.to_json(record, {"ignoreNullFields": "false"}).alias("canonical"),
    )
