"""Rate-limit snapshots of a provider (JSON) to quota windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WINDOW = "struct<usedPercent:bigint,windowDurationMins:bigint,resetsAt:bigint>"
#: Names of limits that stay as they are, and parts per million in a percent.
PLAIN_NAME, PPM = r"^[A-Za-z0-9._-]+$", 10_000


def quota_windows(snapshots: DataFrame, longest_name: int = 80) -> DataFrame:
    """(account_id, observed_at_ms, window_id, used_ppm, duration_seconds, advertised_resets_at_ms) of each slot of each snapshot.

    Takes account_id, limit_id, observed_at_ms, snapshot. A snapshot with one invalid slot gives no row; names of
    limits that are long or hold other signs become a hash.
    """
    s = F.from_json("snapshot", f"primary {_WINDOW}, secondary {_WINDOW}")
    plain = F.col("limit_id").rlike(PLAIN_NAME) & (F.octet_length("limit_id") <= longest_name)
    rows = snapshots.withColumns({"s": s, "limit": F.when(plain, F.col("limit_id")).otherwise(F.concat(F.lit("limit_"), F.sha2("limit_id", 256)))})
    slot = lambda n: F.struct(F.lit(n).alias("slot"), F.col(f"s.{n}").alias("w"))
    rows = rows.withColumn("slots", F.filter(F.array(slot("primary"), slot("secondary")), lambda x: x["w"].isNotNull()))
    valid = lambda w: F.coalesce(w["usedPercent"].between(0, 100), F.lit(False)) & F.coalesce(w["windowDurationMins"] > 0, F.lit(True)) & F.coalesce(w["resetsAt"] > 0, F.lit(True))
    each = rows.filter(F.forall("slots", lambda x: valid(x["w"]))).select("account_id", "observed_at_ms", "limit", F.explode("slots").alias("x")).select("account_id", "observed_at_ms", "limit", "x.slot", "x.w.*")
    minutes = F.col("windowDurationMins")
    return each.select(
        "account_id",
        "observed_at_ms",
        F.concat_ws(".", "limit", "slot", F.coalesce(minutes.cast("string"), F.lit("unknown"))).alias("window_id"),
        (F.col("usedPercent") * PPM).alias("used_ppm"),
        (minutes * 60).alias("duration_seconds"),
        (F.col("resetsAt") * 1000).alias("advertised_resets_at_ms"),
    )


#: States of a credit by its status.
CREDIT_STATES = {"available": "available", "redeeming": "activation_pending", "redeemed": "activated"}
CREDIT = "struct<availableCount:bigint,credits:array<struct<id:string,resetType:string,status:string,grantedAt:bigint,expiresAt:bigint>>>"


def credit_lots(summaries: DataFrame) -> DataFrame:
    """Benefit lots of each summary of reset credits: one for each detail, and one for what is available beyond the details.

    Left out whole: summaries with a negative count, with one id twice, or with more details available than told.
    """
    s = F.from_json("summary", CREDIT)
    details = F.coalesce(F.col("s.credits"), F.array().cast("array<struct<id:string,resetType:string,status:string,grantedAt:bigint,expiresAt:bigint>>"))
    rows = summaries.withColumn("s", s).withColumn("details", details)
    rows = rows.withColumn("rest", F.col("s.availableCount") - F.size(F.filter("details", lambda c: c["status"] == "available")))
    rows = rows.filter((F.col("rest") >= 0) & (F.size(F.array_distinct(F.transform("details", lambda c: c["id"]))) == F.size("details")))
    lot = lambda kind, *parts: F.sha2(F.concat_ws("|", F.lit(f"tallymill.lot.{kind}"), *parts), 256).alias("lot_id")
    each = rows.select("account_id", "observed_at_ms", F.explode("details").alias("c"))
    known = F.col("c.resetType") == "codexRateLimits"
    state = F.coalesce(F.create_map(*[F.lit(x) for p in CREDIT_STATES.items() for x in p])[F.col("c.status")], F.lit("ambiguous"))
    sure = known & F.col("c.status").isin(*CREDIT_STATES)
    detailed = each.select("account_id", "observed_at_ms", lot("detail", F.col("account_id"), F.col("c.id")), F.when(known, "banked_rate_limit_reset").otherwise("unknown").alias("kind"), F.lit(1).cast("bigint").alias("quantity"), state.alias("state"), (F.col("c.grantedAt") * 1000).alias("granted_at_ms"), (F.col("c.expiresAt") * 1000).alias("expires_at_ms"), F.when(sure, "high").otherwise("low").alias("confidence"), F.lit("provider_detail").alias("detail_kind"))
    none = F.lit(None).cast("bigint")
    whole = rows.filter("rest > 0").select("account_id", "observed_at_ms", lot("rest", F.col("account_id")), F.lit("banked_rate_limit_reset").alias("kind"), F.col("rest").alias("quantity"), F.lit("available").alias("state"), none.alias("granted_at_ms"), none.alias("expires_at_ms"), F.lit("medium").alias("confidence"), F.lit("provider_aggregate").alias("detail_kind"))
    return detailed.unionByName(whole)
