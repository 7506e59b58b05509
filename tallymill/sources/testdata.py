"""Usage tables derived from the synthetic tables: the stand-in for canonical usage events, samples, lots and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.identity import event_id, fingerprint
from tallymill.functions.measures import ACTIVITIES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_event(spark: SparkSession, sf_dir: str, identity: bool = False) -> DataFrame:
    """Canonical usage events by the fixed projection of `events`; identity adds fingerprint and event_id."""
    raw = read(spark, sf_dir, "events")
    k, b = F.col("k"), F.col("b")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    base = raw.select(
        F.col("event_id").alias("source_offset"), "user_id", "event_type", micros.alias("us"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.round(F.col("value") * 1000).cast("bigint").alias("b")
    )
    null_if = lambda n, x: F.when(k % n == 0, None).otherwise(x)
    part = lambda n: F.floor(b / n).cast("bigint")
    inputs = null_if(11, b)
    names = {"click": "gpt-5.6", "view": "gpt-5.4-mini", "purchase": "gpt-5.5", "signup": "gpt-5-nano", "error": "unpriced-model"}
    acts = {"click": "read", "purchase": "edit_write", "view": "search", "signup": "web", "error": "terminal"}
    model = F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("event_type")]
    out = base.select(
        "source_offset",
        F.when(F.col("user_id") % 3 == 0, "local").otherwise("codex").alias("provider_id"),
        F.concat(F.lit("profile_"), F.col("user_id") % 4).alias("profile_id"),
        F.concat(F.lit("session_"), F.col("user_id")).alias("session_id"),
        F.floor(F.col("us") / 1_000_000).cast("bigint").alias("timestamp_seconds"),
        (F.pmod("us", F.lit(1_000_000)) * 1000).cast("bigint").alias("timestamp_nanos"),
        model.alias("model"),
        F.when(k % 10 == 0, None).otherwise(F.concat(F.lit("proj_"), k % 7)).alias("project_alias"),
        inputs.alias("input_tokens"),
        null_if(13, part(3)).alias("cached_tokens"),
        part(5).alias("output_tokens"),
        null_if(17, part(20)).alias("reasoning_tokens"),
        null_if(19, b + part(5) + part(20)).alias("total_tokens"),
        F.when(k % 4 == 0, "standard").when(k % 4 == 1, "priority").when(k % 4 == 3, "flex").alias("service_tier"),
        F.when(inputs.isNull(), "unavailable").when(inputs > 272_000, "yes").otherwise("no").alias("long_context"),
        (k % 23 == 0).cast("bigint").alias("fallback_model"),
        F.when(k % 5 == 0, b * 7).alias("reported_cost_usd_micros"),
        *[F.lit(0).cast("bigint").alias(f"activity_{a}") if a not in acts.values() else (F.col("event_type") == next(e for e, v in acts.items() if v == a)).cast("bigint").alias(f"activity_{a}") for a in ACTIVITIES],
    )
    return out.withColumn("fingerprint", fingerprint()).withColumn("event_id", event_id(F.col("fingerprint"))) if identity else out


def quota_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one window for each profile and event type, in order of event time."""
    raw = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    used = (F.col("k") * 7919 % 1_000_001).cast("bigint")
    return raw.select(
        F.concat(F.lit("profile_"), F.col("user_id") % 4).alias("scope_id"),
        F.col("event_type").alias("window_id"),
        F.col("event_id").alias("observation_id"),
        ms.alias("observed_at_ms"),
        used.alias("used_ppm"),
        (F.lit(1_000_000) - used).alias("remaining_ppm"),
        F.when(F.col("k") % 29 == 0, None).otherwise((F.lit(1000) + F.col("k") % 3).cast("bigint")).alias("capacity_units"),
        (F.floor(ms / 86_400_000).cast("bigint") * 86_400_000 + 86_400_000).alias("advertised_resets_at_ms"),
        F.when(F.col("k") % 31 == 0, "manual_or_banked").when(F.col("k") % 37 == 0, "explicit_provider").otherwise("none").alias("reset_evidence"),
        F.when(F.col("k") % 6 == 0, "low").when(F.col("k") % 47 == 0, "unknown").otherwise("high").alias("confidence"),
        F.when(F.col("k") % 41 == 0, "conflict").when(F.col("k") % 43 == 0, "unknown").when(F.col("k") % 5 == 0, "partial").otherwise("authoritative").alias("quality"),
        F.when(F.col("event_type") == "view", "rolling").otherwise("fixed").alias("semantics"),
        F.when(F.col("k") % 23 != 0, F.concat(F.lit("e"), F.floor(ms / 432_000_000).cast("string"))).alias("provider_epoch_id"),
        F.when(F.col("event_id") % 9 < 6, "tokens").otherwise("requests").alias("unit_id"),
        F.when(F.col("event_id") % 8 != 0, F.floor(used / 100).cast("bigint")).alias("used_units"),
        F.when(F.col("k") % 3 == 0, ms - 1000 * F.col("k")).alias("reset_occurred_at_ms"),
        (ms + 600_000).alias("fresh_until_ms"),
        (ms + 3_600_000).alias("stale_after_ms"),
    )


def benefit_lots(spark: SparkSession, sf_dir: str, observed: bool) -> DataFrame:
    """Lots of credit from `orders`: the current inventory, or a later observation of it."""
    raw = read(spark, sf_dir, "orders")
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    lots = raw.select(
        key.cast("bigint").alias("lot_id"),
        F.concat(F.lit("scope_"), F.col("o_custkey") % 8).alias("scope_id"),
        (cents % 1000 + (F.when(key % 5 == 0, 1).otherwise(0) if observed else F.lit(0))).cast("bigint").alias("quantity"),
        (F.when(key % 7 == 0, F.lit("used" if observed else "available")).when(key % 11 == 0, "expired").when(key % 13 == 0, "ambiguous").otherwise("available")).alias("state"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000 + 86_400_000 * (key % 40)).cast("bigint").alias("expires_at_ms"),
    )
    lots = lots.withColumn("expires_at_ms", F.when(F.col("lot_id") % 9 == 0, None).otherwise(F.col("expires_at_ms")))
    return lots.filter(F.col("lot_id") % 3 != 0) if observed else lots.filter(F.col("lot_id") % 4 != 1)




#: Directories and file names that the synthetic commits touch.
PATHS = ("src/main.rs", "tests/unit_test.py", "docs/guide.md", "Cargo.lock", "db/migrations/001.sql", "assets/logo.png", "build.gradle", "notes", "vendor/lib.c", "web/app.ts")


def git_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed paths of commits from `lineitem`: one repository for each five suppliers."""
    raw = read(spark, sf_dir, "lineitem")
    return raw.select(
        (F.col("l_suppkey") % 5).cast("bigint").alias("repository_id"),
        F.col("l_orderkey").cast("bigint").alias("commit_id"),
        F.element_at(F.array(*map(F.lit, PATHS)), (F.col("l_partkey") % len(PATHS) + 1).cast("int")).alias("path"),
        F.col("l_quantity").cast("bigint").alias("added"),
        F.floor(F.col("l_quantity") / 2).cast("bigint").alias("removed"),
        (F.col("l_orderkey") % 17 == 0).alias("is_merge"),
        F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000).cast("bigint").alias("day_index"),
    )


def git_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text of log records for each thousand orders of a repository, from `lineitem`: an order is a commit, a line a path."""
    raw = read(spark, sf_dir, "lineitem")
    key, n = F.col("l_orderkey").cast("bigint"), F.col("l_partkey") % len(PATHS)
    odd = F.when(F.col("l_linenumber") == 4, "\t7\tx\x1e:y").otherwise("")  # a name that looks like other tokens
    path = F.concat(F.element_at(F.array(*map(F.lit, PATHS)), (n + 1).cast("int")), odd)
    renamed, module, binary = F.col("l_linenumber") == 2, n == 7, n == 5
    mode = F.when(module, F.lit(":160000 160000 aa bb ")).otherwise(F.lit(":100644 100644 aa bb "))
    nul = F.lit("\0")
    entry = F.when(renamed, F.concat(mode, F.lit("R090"), nul, F.lit("old/"), path, nul, path, nul)).otherwise(F.concat(mode, F.lit("M"), nul, path, nul))
    lines = F.when(binary, F.lit("-\t-\t")).otherwise(F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("\t"), F.floor(F.col("l_quantity") / 2).cast("string"), F.lit("\t")))
    count = F.when(renamed, F.concat(lines, nul, F.lit("old/"), path, nul, path, nul)).otherwise(F.concat(lines, path, nul))
    rows = raw.select(key.alias("k"), "l_linenumber", entry.alias("entry"), count.alias("count"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("at"))
    per = rows.groupBy("k").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("l_linenumber", "entry", "count"))).alias("e"))
    author = lambda m: F.concat(F.lit("dev"), (F.col("k") % m).cast("string"), F.lit("@x"))
    merge = F.col("k") % 17 == 0
    body = F.when(merge, "").otherwise(F.concat(F.array_join(F.transform("e", lambda x: x["entry"]), ""), F.array_join(F.transform("e", lambda x: x["count"]), "")))
    parent = F.sha2((F.col("k") - 1).cast("string"), 256)
    record = F.concat(F.lit("\x1e"), F.sha2(F.col("k").cast("string"), 256), nul, F.col("at").cast("string"), nul, author(3), nul, author(4), nul, F.when(merge, F.concat_ws(" ", parent, parent)).when(F.col("k") % 100 == 1, "").otherwise(parent), nul, body)
    of = per.select((F.col("k") % 5).alias("repository_id"), F.floor(F.col("k") / 1000).alias("part"), "k", record.alias("record"))
    joined = of.groupBy("repository_id", "part").agg(F.array_sort(F.collect_list(F.struct("k", "record"))).alias("r"))
    return joined.select("repository_id", "part", F.array_join(F.transform("r", lambda x: x["record"]), "").alias("log"))


def git_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repositories of the synthetic commits: one truncated, one to be rebuilt, one partial, one seen long ago."""
    ids = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).cast("bigint").alias("repository_id")).distinct()
    r = F.col("repository_id")
    return ids.select("repository_id", F.when(r == 3, "partial").otherwise("complete").alias("quality"), (r == 2).alias("truncated"), (r == 4).alias("rebuild_required"), F.when(r == 1, "stale").otherwise("fresh").alias("git_freshness"))


def git_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities of repositories from `supplier`, each with a project's salted key; repository 4 has some without."""
    raw = read(spark, sf_dir, "supplier")
    r = (F.col("s_suppkey") % 5).cast("bigint")
    project = F.concat(F.lit("proj_"), (r % 3).cast("string"))
    key = F.sha2(F.concat_ws("|", F.lit("tallymill.project.salt"), project), 256)
    return raw.select(F.format_string("a%05d", F.col("s_suppkey")).alias("association_id"), r.alias("repository_id"), F.when((r != 4) | (F.col("s_suppkey") % 2 == 0), key).alias("project_key"), (F.col("s_suppkey") % 7 * 1000).cast("bigint").alias("last_activity_at_ms"))


def git_refs(spark: SparkSession, sf_dir: str, now: bool) -> DataFrame:
    """Branches of repositories from `part` (100 each): before, and now, when some have moved, gone or come."""
    raw = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"))
    repo = F.floor(F.col("k") / 10).cast("bigint")
    moved = (repo % 4 == 1) & (F.col("k") % 2 == 0) | (repo % 4 == 2)
    tip = F.when(moved, 2).otherwise(1) if now else F.lit(1)
    rows = raw.select(repo.alias("repository_id"), F.concat(F.lit("refs/heads/b"), F.col("k") % 10).alias("ref"), F.concat_ws("-", F.lit("o"), F.col("k"), tip).alias("object_id"), (repo % 8 == 5).alias("shallow"), "k")
    gone = (F.col("repository_id") % 16 == 3) & (F.col("k") % 10 == 4) if now else (F.col("repository_id") % 8 == 0) & (F.col("k") % 10 == 9)
    return rows.filter(~gone).drop("k")


def turn_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session observations from `conversations`, with every kind of lineage.

    s: the conversation, a root. f: each third one's fork, whose turns differ from turn 3 on (and, for each fifth fork,
    that skips turn 1 of a parent without it). h: a fork of each second fork, equal to it. c: chains of 50 conversations.
    d: repeats of the conversation by sessions that share their name with one of another profile. x: two sessions that
    name each other. Some turns declare a conflict, some sessions one of their relation.
    """
    raw = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    c, t = F.col("conv_id"), F.col("turn")
    name = lambda kind, of=c: F.concat(F.lit(kind), of.cast("string"))
    none = F.lit(None).cast("string")

    def session(kind: str, where, parent, text, of=c) -> DataFrame:
        return raw.filter(where).select(name(kind, of).alias("session_id"), parent.alias("parent_session_id"), text.alias("said"), "conv_id", "turn", F.lit(kind).alias("kind"))

    changed = F.when(t >= 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    every = [
        session("s", (c % 15 != 0) | (t != 1), none, F.col("text")),
        session("f", c % 3 == 0, name("s"), changed),
        session("h", c % 6 == 0, name("f"), changed),
        session("c", c >= 0, F.when(c % 50 != 0, name("c", c - 1)), F.lit("same")),
        session("d", c >= 0, name("s"), F.col("text"), F.floor(c / 2)),
        session("x", c % 40 == 7, name("y"), F.col("text")),
        session("y", c % 40 == 7, name("x"), F.col("text")),
    ]
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)
    group = F.when(F.col("kind") == "c", F.floor(c / 50)).otherwise(c)
    out = rows.select(
        F.when(group % 8 < 4, "codex").otherwise("local").alias("provider_id"),
        F.concat(F.lit("profile_"), group % 4).alias("profile_id"),
        "session_id",
        "parent_session_id",
        t.alias("ordinal"),
        F.sha2("said", 256).alias("signature"),
        (t % 5 != 4).alias("strong"),
        F.concat(F.lit("file_"), "kind").alias("file_key"),
        F.lit(0).alias("generation"),
        (c * 100 + t).alias("source_offset"),
        F.sha2(F.concat_ws("|", "said", t.cast("string")), 256).alias("fingerprint"),
        ((c % 31 == 0) & (t == 2) & (F.col("kind") == "s")).alias("declared_conflict"),
        ((c % 29 == 0) & (F.col("kind") == "f")).alias("relation_conflict"),
    )
    return out


def prior_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an earlier revision: every third observation's, some never projected, and some that are seen no more."""
    seen = turn_observations(spark, sf_dir).filter("source_offset % 3 = 0").select("fingerprint", "source_offset").groupBy("fingerprint").agg(F.min("source_offset").alias("source_offset"))
    gone = read(spark, sf_dir, "conversations").select(F.sha2(F.concat_ws("|", F.lit("gone"), "conv_id"), 256).alias("fingerprint"), (F.col("conv_id") * 100).alias("source_offset")).distinct()
    return seen.unionByName(gone).withColumn("projected", F.col("source_offset") % 5 != 0)


def benefit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of lots from `events`: a lot for each user, an error retires it, revisions are numbered by event."""
    raw = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "retired_terminal").otherwise("state_changed")
    after = F.when(F.col("event_type") != "error", F.col("event_id") + 1)
    return raw.select(F.concat(F.lit("scope_"), F.col("user_id") % 8).alias("scope_id"), F.col("user_id").alias("lot_id"), F.col("event_id").alias("sequence"), kind.alias("kind"), F.col("event_id").alias("before_revision"), after.alias("after_revision"))


def reset_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of reset credits as JSON from `orders`: details of an account's orders of one day, more available than told for some."""
    raw = read(spark, sf_dir, "orders")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    key = F.col("o_orderkey").cast("bigint")
    status = F.when(key % 4 == 0, "redeemed").when(key % 4 == 1, "redeeming").when(key % 17 == 0, "other").otherwise("available")
    credit = F.struct(key.cast("string").alias("id"), F.when(key % 13 == 0, "other").otherwise("codexRateLimits").alias("resetType"), status.alias("status"), at.alias("grantedAt"), F.when(key % 3 != 0, at + 86_400).alias("expiresAt"))
    per = raw.groupBy(F.concat(F.lit("account_"), F.col("o_custkey") % 16).alias("account_id"), F.floor(at / 2_592_000).alias("day")).agg(F.collect_list(credit).alias("credits"), F.count_if(status == "available").alias("told"))
    summary = F.struct((F.col("told") + F.col("day") % 3).alias("availableCount"), F.col("credits"))
    return per.select("account_id", (F.col("day") * 2_592_000_000).alias("observed_at_ms"), F.to_json(summary).alias("summary"))


def quota_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider snapshots as JSON from `events`: two slots, some without a second one, some out of range."""
    raw = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    slot = lambda used, minutes, resets: F.struct(used.alias("usedPercent"), minutes.alias("windowDurationMins"), resets.alias("resetsAt"))
    k, none = F.col("k"), F.lit(None).cast("bigint")
    first = slot(k % 103, F.when(k % 4 != 0, F.lit(300).cast("bigint")), F.when(k % 5 != 0, F.floor(ms / 1000).cast("bigint") + 600))
    second = F.when(k % 3 != 0, slot(k % 100, F.lit(10080).cast("bigint"), none))
    return raw.select(F.concat(F.lit("account_"), F.col("user_id") % 4).alias("account_id"), F.col("event_type").alias("limit_id"), ms.alias("observed_at_ms"), F.to_json(F.struct(first.alias("primary"), second.alias("secondary"))).alias("snapshot"))
