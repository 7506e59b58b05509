"""Code output of repositories: path categories, commit lines, days kept, range sums and cost per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.sources import git_log

DAYS = 400
#: Parts that the changes of one repository are spread over where failed ones are left out.
PARTS = 64
#: What places a path in a category, tried in this order.
CATEGORIES = ("vendor_generated", "schema_migration", "test", "docs_spec", "config_build", "asset", "product_code", "other")
COMPONENTS = {
    "vendor_generated": ("vendor", "third_party", "node_modules", "generated", "dist", "target", ".cache"),
    "schema_migration": ("migrations", "migration", "schema", "schemas"),
    "test": ("test", "tests", "spec", "specs", "__tests__", "fixtures"),
    "docs_spec": ("doc", "docs", "documentation"),
    "config_build": (".github", ".gitlab", ".circleci", "ci", "config", "configs"),
}
FILES = {
    "vendor_generated": ("cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "composer.lock", "poetry.lock", "uv.lock"),
    "docs_spec": ("readme", "readme.md", "changelog", "changelog.md", "specification.md"),
    "config_build": ("cargo.toml", "package.json", "dockerfile", "makefile", "cmakelists.txt", "justfile", "build.rs", "rust-toolchain.toml"),
    "product_code": ("meson.build", "build.gradle", "build.gradle.kts"),
}
EXTENSIONS = {
    "docs_spec": (
        "md", "mdx", "adoc", "asciidoc", "rst",
    ),
    "config_build": (
        "toml", "yaml", "yml", "json", "json5", "ini", "cfg", "conf", "xml",
    ),
    "asset": (
        "png", "jpg", "jpeg", "gif", "webp", "ico", "svg", "woff", "woff2", "ttf", "otf", "mp3", "wav",
        "ogg", "mp4", "webm", "zip", "7z", "rar", "pdf",
    ),
    "product_code": (
        "rs", "c", "h", "cc", "cpp", "cxx", "hpp", "cs", "go", "java", "kt", "kts", "swift", "m", "mm", "py",
        "pyi", "rb", "php", "js", "jsx", "ts", "tsx", "vue", "svelte", "scala", "sh", "ps1", "sql", "proto",
        "graphql", "gql", "slint", "html", "css", "scss", "sass", "less", "lua", "zig", "ex", "exs", "erl",
        "hrl", "fs", "fsx", "vb",
    ),
}
NAMES = {"vendor_generated": r"\.min\.js$|\.min\.css$|\.map$", "schema_migration": r"^migration|^schema\.|_migration\.sql$", "test": r"\.test\.|_test\.|\.spec\.|_spec\."}


def category(path: Column) -> Column:
    """Category of a relative path; null for absolute paths, drives, null bytes and dot components."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.filter(F.split(low, "/"), lambda p: p != "")
    file = F.element_at(parts, -1)
    ext = F.regexp_extract(file, r"\.([^.]+)$", 1)
    out = F.lit("other")
    for name in CATEGORIES[-2::-1]:
        hit = F.lit(False)
        if name in COMPONENTS:
            hit = hit | F.arrays_overlap(parts, F.array(*map(F.lit, COMPONENTS[name])))
        if name in FILES:
            hit = hit | file.isin(*FILES[name])
        if name in EXTENSIONS:
            hit = hit | ext.isin(*EXTENSIONS[name])
        if name in NAMES:
            hit = hit | file.rlike(NAMES[name])
        out = F.when(hit, name).otherwise(out)
    bad = (F.length(path) == 0) | path.rlike(r"^[/\\]|^[A-Za-z]:") | path.contains("\0") | F.exists(F.split(low, "/"), lambda p: p.isin(".", "..")) | (F.size(parts) == 0)
    return F.when(~bad, out)


def day_categories(changes: DataFrame) -> DataFrame:
    """Lines of each repository, day and category; merges bring none."""
    rows = changes.filter(~F.col("is_merge")).withColumn("category", category(F.col("path")))
    return rows.groupBy("repository_id", "day_index", "category").agg(F.sum("added").cast("bigint").alias("added"), F.sum("removed").cast("bigint").alias("removed"))


def days(changes: DataFrame) -> DataFrame:
    """Commits, merges and lines of the newest 400 days of each repository; `truncated` where it has more."""
    lines = lambda c: F.sum(F.when(F.col("is_merge"), 0).otherwise(F.col(c))).cast("bigint").alias(c)
    per = changes.groupBy("repository_id", "day_index", "commit_id").agg(F.max("is_merge").alias("is_merge"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    day = per.groupBy("repository_id", "day_index").agg(F.count("*").alias("commits"), F.count_if("is_merge").alias("merge_commits"), lines("added"), lines("removed"))
    rank = F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("day_index")))
    more = day.groupBy("repository_id").agg((F.count("*") > DAYS).alias("truncated"))
    return day.withColumn("n", rank).filter(F.col("n") <= DAYS).drop("n").join(more, "repository_id")


def range_categories(by_day: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """Lines of each repository and category in a range of days, with zeros for categories that are absent."""
    sums = by_day.filter(F.col("day_index").between(first_day, last_day)).groupBy("repository_id", "category").agg(F.sum("added").cast("bigint").alias("added"), F.sum("removed").cast("bigint").alias("removed"))
    every = by_day.select("repository_id").distinct().select("repository_id", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    return every.join(sums, ["repository_id", "category"], "left").fillna(0)


def efficiency(cost: Column, lines: Column) -> Column:
    """Micro-dollars for 100 added product lines, half up; null without cost or lines."""
    return F.when((lines > 0) & cost.isNotNull(), F.floor((cost.cast("decimal(30,0)") * 100 + F.floor(lines / 2)) / lines)).cast("bigint")


def unavailable_reason(lines: Column, cost: str = "cost") -> Column:
    """Why a repository has no efficiency: the first that holds; null where it has one.

    Columns range_complete, quality, project_key, git_freshness, forced_reason, usage_quality_complete, usage_freshness,
    and the struct `cost` (amount, availability, conflict_events).
    """
    old = lambda c: F.col(c).isin("stale", "unavailable")
    poor = ~F.col(f"{cost}.availability").isin("complete", "zero") | (F.col(f"{cost}.conflict_events") != 0)
    return (
        F.when(~F.col("range_complete"), "git_range_incomplete")
        .when(F.col("quality") != "complete", "git_quality_incomplete")
        .when(F.col("project_key").isNull(), "association_unavailable")
        .when(lines == 0, "zero_product_code_lines")
        .when(old("git_freshness"), "git_stale")
        .when(F.col("forced_reason").isNotNull(), F.col("forced_reason"))
        .when(F.col(cost).isNull(), "project_not_in_usage_snapshot")
        .when(~F.col("usage_quality_complete"), "usage_quality_incomplete")
        .when(old("usage_freshness"), "usage_stale")
        .when(poor, "usage_cost_unavailable")
    )


def parse_log(logs: DataFrame, authors: list[str]) -> DataFrame:
    """(repository_id, commit, day_index, parents, selected, path, kind, added, removed, error) of `log`, as `sources.git_log` reads it.

    A commit is selected by either author. Merges have no paths: one row with a null path stands for a commit without any.
    The day is that of UTC, before 1970 too. A text that breaks the protocol is one row with `error` alone.
    """
    return git_log.changes(logs, authors)


def sound(changes: DataFrame) -> DataFrame:
    """The changes of repositories of which no text is in error: a scan that failed in part is not published.

    Few repositories may hold all changes, so each one's are spread over PARTS parts, and a failed one is told to each.
    """
    part = F.pmod(F.xxhash64(*changes.columns), F.lit(PARTS)).cast("int")
    failed = changes.filter(F.col("error").isNotNull()).select("repository_id").distinct().select("repository_id", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    return changes.filter(F.col("error").isNull()).withColumn("__part", part).join(failed, ["repository_id", "__part"], "left_anti").select(*[c for c in changes.columns if c != "error"])


def commits(changes: DataFrame) -> DataFrame:
    """Lines, binary files, submodule changes and paths of each commit (columns as parse_log has them); merges bring no lines."""
    lines = lambda c: F.coalesce(F.sum(F.when((F.col("kind") == "text") & (F.col("parents") < 2), F.col(c))), F.lit(0)).cast("bigint").alias(c)
    of = lambda k: F.count_if(F.col("kind") == k).alias({"binary": "binary_files", "submodule": "submodule_changes"}[k])
    return changes.groupBy("repository_id", "commit", "day_index", "parents").agg(lines("added"), lines("removed"), of("binary"), of("submodule"), F.count("path").alias("changed_paths"))


def refresh_kinds(before: DataFrame, now: DataFrame, ancestry: DataFrame) -> DataFrame:
    """(repository_id, refresh): unchanged where all refs are the same, append where every old one is an ancestor of the new one of its name, else rebuild.

    before and now have (repository_id, ref, object_id), now also `shallow`; ancestry has the pairs (old_id, new_id) that hold.
    """
    old = before.select("repository_id", "ref", F.col("object_id").alias("old_id"))
    both = old.join(now.select("repository_id", "ref", F.col("object_id").alias("new_id"), "shallow"), ["repository_id", "ref"], "full")
    both = both.join(ancestry.select("old_id", "new_id", F.lit(True).alias("reaches")), ["old_id", "new_id"], "left")
    same = F.coalesce(F.col("old_id") == F.col("new_id"), F.lit(False))
    kept = F.col("old_id").isNull() | same | F.coalesce("reaches", F.lit(False))
    per = both.groupBy("repository_id").agg(F.bool_and(same).alias("same"), F.bool_and(kept).alias("kept"), F.coalesce(F.bool_or("shallow"), F.lit(False)).alias("shallow"), F.count("old_id").alias("known"))
    return per.select("repository_id", F.when(F.col("known") == 0, "rebuild").when(F.col("same"), "unchanged").when(F.col("kept") & ~F.col("shallow"), "append").otherwise("rebuild").alias("refresh"))


def published(active: DataFrame, scanned: DataFrame, kinds: DataFrame) -> DataFrame:
    """Day categories after a refresh: rebuilt from the scan, summed with what was appended, or left as they are."""
    had = active.join(kinds.filter("refresh <> 'rebuild'").select("repository_id"), "repository_id", "left_semi")
    got = scanned.join(kinds.filter("refresh <> 'unchanged'").select("repository_id"), "repository_id", "left_semi")
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("added", "removed")]
    return had.unionByName(got).groupBy("repository_id", "day_index", "category").agg(*sums)


def day_range(start_seconds: int, end_seconds: int) -> tuple[int, int]:
    """First day and the day after the last of a range of whole days of UTC."""
    if start_seconds % 86_400 or end_seconds % 86_400 or start_seconds >= end_seconds:
        raise ValueError("the range must be of whole days of UTC")
    return start_seconds // 86_400, end_seconds // 86_400


def range_totals(by_day: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """Commits, merges and lines of each repository in a range of days; zeros where it has none."""
    inside = F.col("day_index").between(first_day, last_day)
    return by_day.groupBy("repository_id").agg(*[F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).cast("bigint").alias(c) for c in ("commits", "merge_commits", "added", "removed")])


def associations(rows: DataFrame) -> DataFrame:
    """(repository_id, association_id, project_key, associated): the latest association; a project only if all rows name one and the same."""
    one = (F.count("*") == F.count("project_key")) & (F.count_distinct("project_key") == 1)
    latest = F.min(F.struct((-F.col("last_activity_at_ms")).alias("at"), "association_id"))["association_id"]
    return rows.groupBy("repository_id").agg(latest.alias("association_id"), F.when(one, F.min("project_key")).alias("project_key"), one.alias("associated"))


def project_key(salt: str, project: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(f"tallymill.project.{salt}"), project), 256)


def project_matches(keys: DataFrame, projects: DataFrame, salt: str) -> DataFrame:
    """The keys with the project whose salted fingerprint each is; null for those of none."""
    return keys.join(projects.withColumn("project_key", project_key(salt, F.col("project"))), "project_key", "left")


def captures(repositories: DataFrame, by_day: DataFrame, linked: DataFrame, first_day: int) -> DataFrame:
    """Repositories with project, effective quality, and whether the range from first_day on is complete.

    A range is complete unless the repository is unavailable, or its days are truncated and the range starts before them.
    """
    since = by_day.groupBy("repository_id").agg(F.min("day_index").alias("retained_from"))
    rows = repositories.join(since, "repository_id", "left").join(linked, "repository_id", "left")
    there = F.col("quality") != "unavailable"
    complete = there & (~F.col("truncated") | F.coalesce(F.lit(first_day) >= F.col("retained_from"), F.lit(False)))
    partial = F.col("rebuild_required") | (there & ~F.coalesce("associated", F.lit(False)))
    return rows.withColumns({"range_complete": complete, "quality": F.when(partial, "partial").otherwise(F.col("quality"))})


def repository_page(repositories: DataFrame, size: int, after: int | None = None) -> DataFrame:
    """Repositories by id with `has_more`, whether others follow the page."""
    rows = (repositories if after is None else repositories.filter(F.col("repository_id") > after)).orderBy("repository_id").limit(size + 1)
    n = F.row_number().over(Window.orderBy("repository_id"))  # at most size + 1 rows
    return rows.withColumns({"n": n, "has_more": F.lead("repository_id", size).over(Window.orderBy("repository_id")).isNotNull()}).withColumn("has_more", F.max("has_more").over(Window.partitionBy())).filter(F.col("n") <= size).drop("n")


def project_code(repositories: DataFrame) -> DataFrame:
    """Code totals and one efficiency for each project of several repositories (sorted by repository_id).

    Columns project, repository_id, commits, added, removed, range_complete, quality, freshness, reason, cost, dataset,
    product_lines. The first reason of a repository rules; so does a difference of cost or dataset, as evidence mismatch.
    """
    reason = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("repository_id")))
    at = F.min(F.when(F.col("reason").isNotNull(), F.col("repository_id")))
    sound = F.col("reason").isNull()
    first = F.first(F.when(sound, F.struct("cost", "dataset")), True).over(Window.partitionBy("project").orderBy("repository_id"))
    rows = repositories.withColumn("odd", F.coalesce(sound & (F.struct("cost", "dataset") != first), F.lit(False)))
    per = rows.groupBy("project").agg(
        F.count("*").alias("repositories"), *[F.sum(c).cast("bigint").alias(c) for c in ("commits", "added", "removed")], F.bool_and(F.col("range_complete") & (F.col("quality") == "complete")).alias("complete"),
        reason.alias("reason"), at.alias("at"), F.min(F.when(F.col("odd"), F.col("repository_id"))).alias("odd_at"),
        F.min("cost").alias("cost"), F.sum("product_lines").cast("bigint").alias("lines"),
    )
    mismatch = F.col("odd_at").isNotNull() & (F.col("at").isNull() | (F.col("odd_at") < F.col("at")))
    why = F.when(mismatch, "efficiency_evidence_mismatch").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("cost").isNull() | (F.col("lines") == 0), "zero_product_code_lines")
    return per.select("project", "repositories", "commits", "added", "removed", (F.col("added") - F.col("removed")).alias("net"), "complete", F.when(why.isNull(), efficiency(F.col("cost"), F.col("lines"))).alias("efficiency"), why.alias("reason"))
