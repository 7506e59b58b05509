"""Expiring credit lots: reconciling an observation, reminders, and the order in which lots are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators.quota import sample_freshness
from tallymill.operators.status import worst

#: Qualities from best to worst; most scopes and lots of an overview.
QUALITIES = ("authoritative", "derived", "estimated", "partial", "conflict", "unknown")
SCOPES, LOTS = 32, 256
TERMINAL = ("used", "expired")
#: Seconds before expiry at which the default profile reminds.
LEADS = (604_800, 86_400, 43_200, 21_600, 3_600)


def reconcile(current: DataFrame, observed: DataFrame, complete: bool = True, last_sequence: int = 0) -> DataFrame:
    """Changes between an inventory and an observation, numbered: observed lots by id first, then missing ones by id."""
    fields = ("scope_id", "quantity", "state", "expires_at_ms")
    old = current.select("lot_id", *[F.col(c).alias(f"old_{c}") for c in fields], F.lit(True).alias("was"))
    new = observed.select("lot_id", *fields, F.lit(True).alias("seen"))
    both = old.join(new, "lot_id", "full")
    changed = [~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in ("quantity", "state", "expires_at_ms")]
    n = sum((c.cast("int") for c in changed), F.lit(0))
    met = F.when(n == 0, None).when((n == 1) & changed[0], "quantity_changed").when((n == 1) & changed[1], F.when(F.col("old_state") == "ambiguous", "reappeared").otherwise("state_changed")).when((n == 1) & changed[2], "expiry_changed").otherwise("corrected")
    missing = F.when(F.lit(not complete), None).when(F.col("old_state").isin(*TERMINAL), "retired_terminal").when(F.col("old_state") == "ambiguous", None).otherwise("disappeared_ambiguous")
    kind = F.when(F.col("was").isNull(), "awarded").when(F.col("seen").isNull(), missing).otherwise(met)
    out = both.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn("scope_id", F.coalesce("scope_id", "old_scope_id"))
    order = Window.partitionBy("scope_id").orderBy(F.col("seen").isNull(), "lot_id")
    return out.select("scope_id", (F.row_number().over(order) + last_sequence).cast("bigint").alias("sequence"), "lot_id", "kind")


def schedule(lots: DataFrame, leads: tuple[int, ...] = LEADS, channels: tuple[str, ...] = ("in_app",)) -> DataFrame:
    """Reminders of available lots with a known expiry, one for each lead and channel."""
    each = lots.filter((F.col("state") == "available") & F.col("expires_at_ms").isNotNull())
    leads_, channels_ = F.array(*[F.lit(v).cast("bigint") for v in leads]), F.array(*map(F.lit, channels))
    out = each.select("scope_id", "lot_id", "expires_at_ms", F.explode(leads_).alias("lead_seconds")).select("*", F.explode(channels_).alias("channel"))
    return out.withColumn("due_at_ms", F.col("expires_at_ms") - F.col("lead_seconds") * 1000)


def due(reminders: DataFrame, now_ms: int, receipts: DataFrame | None = None) -> DataFrame:
    """The most urgent due reminder of each lot and channel, unless one as urgent has been delivered."""
    on = reminders.filter((F.col("due_at_ms") <= now_ms) & (F.col("expires_at_ms") > now_ms))
    out = on.groupBy("scope_id", "lot_id", "channel").agg(F.min("lead_seconds").alias("lead_seconds"), F.min("expires_at_ms").alias("expires_at_ms"))
    if receipts is not None:
        least = receipts.groupBy("lot_id", "channel").agg(F.min("lead_seconds").alias("done"))
        out = out.join(least, ["lot_id", "channel"], "left").filter(F.col("done").isNull() | (F.col("lead_seconds") < F.col("done"))).drop("done")
    return out


#: Kinds of lots in the order in which they are used.
KINDS = ("banked_rate_limit_reset", "usage_credit", "temporary_usage", "unknown")


def first_expired_first(lots: DataFrame, size: int = 256, scope: str | None = None) -> DataFrame:
    """Lots (of a scope) in the order of use: by expiry, unknown ones last, then by kind and id."""
    rank = [F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))] if "kind" in lots.columns else []
    rows = lots if scope is None else lots.filter(F.col("scope_id") == scope)
    return rows.orderBy(F.asc_nulls_last("expires_at_ms"), *rank, "lot_id").limit(size)


def observation_status(states: DataFrame, observations: DataFrame, changes: DataFrame) -> DataFrame:
    """(scope_id, status) of observations (scope_id, observation_id, observed_at_ms) against the state of their scopes.

    Older than the state: stale; the state's own observation again: duplicate, or conflict where it would change
    something; else changed or freshness_only, by whether there are changes (scope_id).
    """
    n = changes.groupBy("scope_id").agg(F.count("*").alias("n"))
    rows = observations.join(states, "scope_id", "left").join(n, "scope_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    same = F.coalesce(F.col("observation_id") == F.col("last_observation_id"), F.lit(False))
    old = F.coalesce(F.col("observed_at_ms") < F.col("last_observed_at_ms"), F.lit(False))
    status = F.when(old, "stale").when(same & (F.col("n") == 0), "duplicate").when(same, "conflict").when(F.col("n") > 0, "changed").otherwise("freshness_only")
    return rows.select("scope_id", status.alias("status"))


def process_due(pending: DataFrame, receipts: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(deliveries, counts by scope) of the pending reminders that are due: expired ones go, the most urgent of each lot revision and channel is delivered.

    One as urgent or more that was delivered before (receipts) suppresses it.
    """
    key = (*_LOT, "lot_revision", "channel")
    on = pending.filter(F.col("due_at_ms") <= now_ms)
    dead = F.col("expires_at_ms") <= now_ms
    best = on.filter(~dead).groupBy(*key).agg(F.min(F.struct("lead_seconds", "expires_at_ms", "due_at_ms")).alias("m"))
    done = receipts.groupBy(*key).agg(F.min("lead_seconds").alias("done"))
    judged = best.select(*key, "m.*").join(done, list(key), "left").withColumn("sent", F.col("done").isNull() | (F.col("lead_seconds") < F.col("done")))
    deliveries = judged.filter("sent").drop("done", "sent")
    gone = on.groupBy("scope_id").agg(F.count("*").alias("taken"), F.count_if(dead).alias("expired"))
    sent = judged.groupBy("scope_id").agg(F.count_if("sent").alias("delivered"), F.count_if(~F.col("sent")).alias("suppressed"))
    return deliveries, gone.join(sent, "scope_id", "left").fillna(0)


def unacknowledged(deliveries: DataFrame, acknowledged: DataFrame) -> DataFrame:
    return deliveries.join(acknowledged.select("delivery_id").distinct(), "delivery_id", "left_anti")


def change_page(changes: DataFrame, revisions: DataFrame, scope: str, size: int = 256, before: int | None = None) -> DataFrame:
    """Changes of a scope, newest first, with the lot's quantity before and after."""
    rows = changes.filter(F.col("scope_id") == scope)
    page = (rows if before is None else rows.filter(F.col("sequence") < before)).orderBy(F.desc("sequence")).limit(min(size, 256))
    of = lambda side: revisions.select(*_LOT, F.col("lot_revision").alias(f"{side}_revision"), F.col("quantity").alias(f"{side}_quantity"))
    return page.join(of("before"), [*_LOT, "before_revision"], "left").join(of("after"), [*_LOT, "after_revision"], "left").orderBy(F.desc("sequence"))


def overview(lots: DataFrame, scopes: DataFrame) -> DataFrame:
    """Lots, nearest expiry and the state of each scope, by id, at most 32 scopes; a scope without lots has zeros."""
    per = lots.groupBy("scope_id").agg(F.count("*").alias("lots"), F.count_if(F.col("state") == "available").alias("available"), F.min("expires_at_ms").alias("nearest_ms"))
    return scopes.orderBy("scope_id").limit(32).join(per, "scope_id", "left").fillna(0, ["lots", "available"]).orderBy("scope_id")


def overview_status(lots: DataFrame, states: DataFrame, now_ms: int) -> DataFrame:
    """One row for an overview of at most 32 scopes: lots, data_through_ms, the worst freshness and quality, warnings, and whether it holds more than 256 lots.

    states has scope_id, observed_at_ms, fresh_until_ms, stale_after_ms, quality; without any the overview is unavailable,
    of unknown quality, and warns that there is no inventory.
    """
    shown = states.orderBy("scope_id").limit(SCOPES)
    n = lots.join(F.broadcast(shown.select("scope_id")), "scope_id", "left_semi").agg(F.count("*").alias("lots"))
    told = shown.withColumn("freshness", sample_freshness(F.lit(now_ms))).agg(
        F.count("*").alias("scopes"), F.min("observed_at_ms").alias("data_through_ms"), F.coalesce(worst(F.col("freshness")), F.lit("unavailable")).alias("freshness"),
        F.coalesce(worst(F.col("quality"), QUALITIES), F.lit("unknown")).alias("quality"), F.bool_or(F.col("freshness").isin("stale", "unavailable")).alias("old"),
    )
    warnings = F.concat_ws(",", F.when(F.col("scopes") == 0, "inventory_absent"), F.when(F.col("old"), "inventory_stale"))
    return told.join(n).select("scopes", "lots", "data_through_ms", "freshness", "quality", warnings.alias("warnings"), (F.col("lots") > LOTS).alias("over"))  # one row by one row


def nearest(lots: DataFrame) -> DataFrame:
    """Next expiry of each scope, with the lot."""
    rows = lots.filter((F.col("state") == "available") & F.col("expires_at_ms").isNotNull())
    return rows.groupBy("scope_id").agg(F.min(F.struct("expires_at_ms", "lot_id")).alias("m"), F.count("*").alias("lots")).select("scope_id", "m.expires_at_ms", "m.lot_id", "lots")


def profiles(scopes: DataFrame, overrides: DataFrame, default: list[int]) -> DataFrame:
    """(scope_id, leads, inherited): the leads of each scope's own profile, or those of the global one."""
    own = overrides.select("scope_id", "leads")
    everyone = F.array(*[F.lit(v).cast("bigint") for v in default])
    return scopes.select("scope_id").join(own, "scope_id", "left").select("scope_id", F.coalesce("leads", everyone).alias("leads"), F.col("leads").isNull().alias("inherited"))


def replace_profile(lots: DataFrame, known: DataFrame, delivered: DataFrame) -> DataFrame:
    """Due rows of every scope by its profile (`profiles`), without those that a delivery as urgent has taken."""
    each = lots.filter((F.col("state") == "available") & F.col("expires_at_ms").isNotNull()).join(known.select("scope_id", "leads"), "scope_id")
    rows = each.select("scope_id", "lot_id", "expires_at_ms", F.explode("leads").alias("lead_seconds")).withColumn("channel", F.lit("in_app"))
    return rebuild_due(rows.withColumn("due_at_ms", F.col("expires_at_ms") - F.col("lead_seconds") * 1000), delivered)


_LOT = ("scope_id", "lot_id")


def removable_changes(changes: DataFrame) -> DataFrame:
    """Changes with a newer one of the same lot, the oldest first."""
    newest = F.max("sequence").over(Window.partitionBy(*_LOT))
    return changes.withColumn("newest", newest).filter("sequence < newest").drop("newest")


def orphan_revisions(revisions: DataFrame, current: DataFrame, changes: DataFrame, reminders: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Lot revisions that no current lot, change, reminder or delivery names; all have scope_id, lot_id, lot_revision, changes have before_revision and after_revision."""
    key = (*_LOT, "lot_revision")
    named = [changes.select(*_LOT, F.col(c).alias("lot_revision")) for c in ("before_revision", "after_revision")]
    used = named[0].unionByName(named[1])
    for rows in (current, reminders, deliveries):
        used = used.unionByName(rows.select(*key))
    return revisions.join(used, [*key], "left_anti")


def removable_deliveries(deliveries: DataFrame, acknowledged: DataFrame, current: DataFrame) -> DataFrame:
    """Acknowledged deliveries of lot revisions that are no longer current."""
    return deliveries.join(acknowledged, "delivery_id", "left_semi").join(current, [*_LOT, "lot_revision"], "left_anti")


def rehydrated(changes: DataFrame, revisions: DataFrame, current: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed lots whose latest change retired them for good, as ambiguous lots with their last revision; current lots stay out."""
    last = changes.groupBy(*_LOT).agg(F.max(F.struct("sequence", "kind", "before_revision", "after_revision")).alias("m")).select(*_LOT, "m.*")
    retired = last.filter((F.col("kind") == "retired_terminal") & F.col("after_revision").isNull()).select(*_LOT, F.col("before_revision").alias("lot_revision"))
    wanted = retired.join(observed, [*_LOT], "left_semi").join(current, [*_LOT], "left_anti")
    return wanted.join(revisions, [*_LOT, "lot_revision"]).withColumn("state", F.lit("ambiguous"))


def rebuild_due(scheduled: DataFrame, delivered: DataFrame) -> DataFrame:
    """Scheduled reminders, but for those of a lot and channel of which one as urgent or more has been delivered."""
    key = [c for c in (*_LOT, "lot_revision", "channel") if c in scheduled.columns]
    least = delivered.groupBy(*key).agg(F.min("lead_seconds").alias("delivered_lead"))
    out = scheduled.join(least, key, "left")
    return out.filter(F.col("delivered_lead").isNull() | (F.col("lead_seconds") < F.col("delivered_lead"))).drop("delivered_lead")
