"""Alert lifecycle from an append-only action table, and the views over alerts.

The lifecycle needs no per-alert list: an escalation is accepted only at the
alert's current tier, so an alert has at most two accepted escalations, the
first action eligible at tier 1 and the first later one eligible at tier 2.
Both are plain minimum aggregates, so an alert with any number of actions is
combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import thresholds as T

TOP_TIER = 3
# Agency by tier.
AGENCIES = {2: "State Disaster Management Authority (SDMA)", 3: "National Disaster Management Authority (NDMA Central)"}
LOCAL_AGENCY = "Tier 1 Local Response"
#: Actions of one partition, about; several sorts of them are held at the same time.
PART_ACTIONS = 200_000


def _agency(tier: Column) -> Column:
    return F.when(tier == 2, AGENCIES[2]).when(tier == 3, AGENCIES[3]).otherwise(LOCAL_AGENCY)


def _parted(actions: DataFrame) -> DataFrame:
    """All actions of an alert in one partition, of partitions that follow the number of actions.

    The steps on an alert then need no further shuffle, and what a task sorts doesn't grow with
    the table: actions are narrow and compress well, so partitions merged by their size hold millions.
    """
    return actions.repartition(max(1, -(-actions.count() // PART_ACTIONS)), "alert_id")


def resolve_actions(actions: DataFrame) -> DataFrame:
    """Add current ``tier`` before each action and ``accepted``."""
    ordered = _parted(actions).withColumn("_o", F.struct("at", "seq"))
    asks = F.col("action") == "ESCALATE"
    caller = F.col("caller_tier")
    first = ordered.groupBy("alert_id").agg(
        F.min(F.when(asks & (caller.isNull() | (caller == 1)), F.col("_o"))).alias("_t1"))
    marked = ordered.join(first, "alert_id")
    second = marked.filter(F.col("_o") > F.col("_t1")).groupBy("alert_id").agg(
        F.min(F.when(asks & (caller.isNull() | (caller == 2)), F.col("_o"))).alias("_t2"))
    marked = marked.join(second, "alert_id", "left")
    after = [F.coalesce(F.col("_o") > F.col(t), F.lit(False)).cast("int") for t in ("_t1", "_t2")]
    at = [F.coalesce(F.col("_o") == F.col(t), F.lit(False)) for t in ("_t1", "_t2")]
    return marked.withColumns({"tier": F.lit(1) + after[0] + after[1], "accepted": ~asks | at[0] | at[1]}
                              ).drop("_o", "_t1", "_t2")


def fold_alerts(actions: DataFrame) -> DataFrame:
    """Current state per alert: status, tiers, agency, resolution and the number of history entries."""
    done = resolve_actions(actions).filter("accepted")
    status = (F.when(F.col("action") == "ACKNOWLEDGE", "ACKNOWLEDGED").when(F.col("action") == "ESCALATE", "ESCALATED")
              .otherwise("RESOLVED"))
    order = F.struct("at", "seq")
    resolved = F.when(F.col("action") == "RESOLVE", order)
    extra = {c: F.col(c) if c in actions.columns else F.lit(None).cast("string") for c in ("reason", "actor")}
    out = done.groupBy("alert_id").agg(
        F.max_by(status, order).alias("status"),
        (F.lit(1) + F.count_if(F.col("action") == "ESCALATE")).cast("int").alias("current_tier"),
        F.count(F.lit(1)).alias("history_entries"), F.max("at").alias("updated_at"),
        F.max_by("tier", resolved).alias("resolved_tier"), F.max_by("at", resolved).alias("resolved_at"),
        F.max_by(extra["actor"], resolved).alias("resolved_by"),
        F.max_by(extra["reason"], resolved).alias("resolution_note"))
    return out.withColumns({"previous_tier": (F.col("current_tier") - 1).cast("int"),
                            "assigned_agency": _agency(F.col("current_tier"))})


def alert_history(actions: DataFrame) -> DataFrame:
    """One row per accepted action: from_tier, to_tier, action, who and when."""
    to_tier = F.col("tier") + (F.col("action") == "ESCALATE").cast("int")
    keep = [c for c in ("actor", "role", "reason") if c in actions.columns]
    return resolve_actions(actions).filter("accepted").select(
        "alert_id", "seq", "at", "action", F.col("tier").alias("from_tier"), to_tier.alias("to_tier"), *keep)


def rejected_actions(actions: DataFrame) -> DataFrame:
    """Escalations that were refused, with the reason."""
    return resolve_actions(actions).filter("not accepted").select(
        "alert_id", "seq", "caller_tier", "tier",
        F.when(F.col("tier") >= TOP_TIER, "at_top_tier").otherwise("caller_tier_mismatch").alias("reject_reason"))


def new_alerts(predictions: DataFrame) -> DataFrame:
    """Tier-1 alerts for predictions at or above the alert threshold."""
    return predictions.filter(F.col("risk_score") >= T.TIER1_RISK).select(
        F.concat(F.lit("ALT_"), F.col("event_id").cast("string")).alias("alert_id"), "event_id", "classification",
        "risk_score", F.lower("risk_level").alias("severity"), F.lit("NEW").alias("status"),
        F.lit(1).alias("current_tier"), F.lit(0).alias("previous_tier"), F.lit(LOCAL_AGENCY).alias("assigned_agency"))


def alerts_view(alerts: DataFrame, tier: int | None = None, status: str | None = None, severity: str | None = None,
                region: str | None = None, include_resolved: bool = True) -> DataFrame:
    """Alert list with the service's filters; 'all' (and 'all india' for regions) means no filter."""
    out = alerts
    state = (status or "all").upper()
    if not include_resolved and state != "RESOLVED":
        out = out.filter("status <> 'RESOLVED'")
    if tier:
        out = out.filter(F.col("current_tier") <= tier)
    if state == "UNRESOLVED":
        out = out.filter("status <> 'RESOLVED'")
    elif state == "ESCALATED":
        out = out.filter((F.col("status") == "ESCALATED") | (F.col("current_tier") > 1))
    elif state != "ALL":
        out = out.filter(F.col("status") == state)
    if severity and severity.lower() != "all":
        out = out.filter(F.col("severity") == severity.lower())
    if region and region.lower() not in ("all", "all india"):
        out = out.filter(F.lower("region").contains(region.lower()))
    return out


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Critical, high, unresolved, resolved and open alerts per tier (one row)."""
    open_ = F.col("status") != "RESOLVED"
    return alerts.agg(
        F.count_if(open_ & (F.col("severity") == "critical")).alias("critical"),
        F.count_if(open_ & (F.col("severity") == "high")).alias("high"),
        F.count_if(open_).alias("unresolved"), F.count_if(~open_).alias("resolved"),
        *[F.count_if(open_ & (F.col("current_tier") == t)).alias(f"open_tier{t}") for t in (1, 2, 3)])


def tier_queue(alerts: DataFrame, tier: int) -> DataFrame:
    """Open alerts of the tier; all open alerts when the tier has none."""
    open_ = alerts.filter("status <> 'RESOLVED'")
    own = open_.filter(F.col("current_tier") == tier).agg(F.count(F.lit(1)).alias("n")).scalar()
    return open_.filter((F.col("current_tier") == tier) | (own == 0))


def route_alerts(alerts: DataFrame, users: DataFrame, salts: int = 16) -> DataFrame:
    """(user_id, alert): central users see every alert, others those of their region.

    An equi-join on an audience key; the central key is salted because it
    matches all alerts.
    """
    audience = F.array(F.struct(F.lit("region").alias("kind"), F.col("region").alias("area"), F.lit(0).alias("salt")),
                       F.struct(F.lit("central").alias("kind"), F.lit("").alias("area"),
                                F.pmod(F.xxhash64("alert_id"), F.lit(salts)).cast("int").alias("salt")))
    sent = alerts.withColumn("_a", F.explode(audience)).select("*", "_a.kind", "_a.area", "_a.salt").drop("_a")
    central = F.col("role") == "Central Government"
    seats = users.select("user_id", F.when(central, "central").otherwise("region").alias("kind"),
                         F.when(central, "").otherwise(F.col("region")).alias("area"),
                         F.explode(F.when(central, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
                         .alias("salt"))
    return seats.join(sent, ["kind", "area", "salt"]).drop("kind", "area", "salt")
