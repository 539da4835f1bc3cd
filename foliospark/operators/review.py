"""Review of proposed actions: the log of each action folded through its states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: state|event -> next state. Fixed values.
TRANSITIONS = {
    "draft|submit": "in_review", "draft|save_edit": "draft", "draft|cancel": "cancelled", "in_review|approve": "approved", "in_review|reject": "rejected", "in_review|save_edit": "in_review",
    "in_review|cancel": "cancelled", "approved|execute": "executed", "approved|save_edit": "approved", "approved|cancel": "cancelled",
}
ADMIN, LIFETIME = "user0", 604_800


def _step(h: Column, e: Column, lifetime: int) -> Column:
    """The state after one event: an event that its rule refuses changes nothing but the count of refusals."""
    d, table = e["decision"], F.create_map(*[F.lit(x) for kv in TRANSITIONS.items() for x in kv])
    to = F.try_element_at(table, F.concat(h["state"], F.lit("|"), d))
    own = e["actor"] == e["drafter"]
    age = F.unix_timestamp(e["ts"]) - F.unix_timestamp(h["approved_at"])
    # whoever drafted may not judge; others may not change; what runs must be what was approved, and lately
    ok = F.when(d.isin("approve", "reject"), ~own).when(d == "execute", (h["approved_hash"] == e["content_hash"]) & (age <= lifetime)).otherwise(own | (e["actor"] == ADMIN))
    ok = F.coalesce(ok & to.isNotNull(), F.lit(False))
    changed = (d == "save_edit") & (h["state"] == "approved") & (h["approved_hash"] != e["content_hash"])
    approves = ok & (d == "approve")
    return F.struct(
        F.when(ok & changed, "in_review").when(ok, to).otherwise(h["state"]).alias("state"),
        F.when(approves, e["content_hash"]).when(ok & changed, None).otherwise(h["approved_hash"]).alias("approved_hash"),
        F.when(approves, e["ts"]).when(ok & changed, None).otherwise(h["approved_at"]).alias("approved_at"),
        F.when(ok & (d == "execute"), e["seq"]).otherwise(h["executed"]).alias("executed"),
        (h["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"),
    )


def fold_actions(events: DataFrame, lifetime: int = LIFETIME) -> DataFrame:
    """action_id, state, refused, ran of each action; events: action_id, seq, ts, actor, drafter, decision, content_hash,
    idempotency_key. Of the actions of one idempotency key only the first to execute runs; the others stay approved."""
    one = F.struct("seq", "ts", "actor", "drafter", "decision", "content_hash")
    log = events.groupBy("action_id").agg(F.array_sort(F.collect_list(one)).alias("log"), F.min("idempotency_key").alias("key"))
    start = F.struct(F.lit("draft").alias("state"), F.lit(None).cast("string").alias("approved_hash"), F.lit(None).cast(events.schema["ts"].dataType).alias("approved_at"), F.lit(None).cast("bigint").alias("executed"), F.lit(0).alias("refused"))
    done = log.select("action_id", "key", F.aggregate("log", start, lambda h, e: _step(h, e, lifetime)).alias("h"))
    first = F.min("h.executed").over(Window.partitionBy("key"))
    ran = F.col("h.executed") == first
    return done.select("action_id", F.when(F.col("h.executed").isNotNull() & ~ran, "approved").otherwise(F.col("h.state")).alias("state"), F.col("h.refused").cast("bigint").alias("refused"), F.coalesce(ran, F.lit(False)).alias("ran"))
