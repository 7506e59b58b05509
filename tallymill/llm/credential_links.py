"""Secrets in texts by patterns, and weak candidates that stand near their complement (operator 13, DataFrame functions alone).

Three kinds are reported by themselves: assigned secrets, access identifiers, long hexadecimal runs. Three more are weak:
named identifiers, mixed runs of letters and digits, and endpoints. A weak candidate counts only where its complementary
parts stand within SCOPE code points: an identifier near a secret, a mixed run near an identifier, an endpoint near both.

A text is split by each pattern, so that lengths of what lies between matches and of matches are known; only these small
numbers are shuffled, once, by row. Running sums along a row give the places. The interval join is a sweep: of each class
of parts, the farthest end before a candidate and the nearest start after it tell whether one lies in its scope, so no
pair of parts is made.

Defined results: null texts are empty; a row is a document, repeated ones too; places are code points, ends are
exclusive; a weak run that overlaps a reported secret is not told again; equal starts go by kind as listed in KINDS; an
empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kinds in order of precedence, and their patterns (those of the first three are given).
KINDS = ("assign", "access", "hex", "identifier", "mixed", "endpoint")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
IDENTIFIER = r"""(?i:access_?key_?id|client_?id|account_?id|username|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"
ENDPOINT = r"(?:https?|wss?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
#: Least lengths: of an assigned value, an access identifier, a named identifier.
VALUE, ACCESS_SIZE, NAME = 12, 18, 4
#: Code points between the ends of parts that belong together.
SCOPE = 200


def _matches(text: Column, kind: int, pattern: str, passes, only: Column | None = None) -> Column:
    """An array of (kind, place, gap, size, ok): each match, its number, code points between it and the match before."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), F.coalesce(passes(m), F.lit(False)).alias("ok")))
    each = F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("place"), z["gap"].alias("gap"), z["size"].alias("size"), z["ok"].alias("ok")))
    # texts without a sign that a pattern needs are not searched
    return each if only is None else F.when(only, each).otherwise(F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,ok:boolean>>"))


def _parts(text: Column) -> Column:
    assigned = text.contains(":") | text.contains("=")
    # a match in itself has the same groups as in its text
    of = lambda pattern, least: lambda m: F.length(F.regexp_extract(m, pattern, 1)) >= least
    varied = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    every = F.lit(True)
    return F.concat(
        _matches(text, 0, ASSIGN, of(ASSIGN, VALUE), assigned),
        _matches(text, 1, ACCESS, lambda m: F.length(m) >= ACCESS_SIZE, text.contains("AKIA")),
        _matches(text, 2, HEX, lambda m: every),
        _matches(text, 3, IDENTIFIER, of(IDENTIFIER, NAME), assigned),
        _matches(text, 4, MIXED, varied),
        _matches(text, 5, ENDPOINT, lambda m: every, text.contains("://")),
    )


def spans(documents: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, reported): every match of each row of `documents`, at least one line a row (kind null).

    `row` names the row within this result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))  # numbered before anything is exploded
    found = rows.select("row", "doc_id", F.explode_outer(_parts(F.col("text"))).alias("p")).select("row", "doc_id", "p.*")
    along = Window.partitionBy("row", "kind").orderBy("place")
    placed = found.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along)).withColumn("start", F.col("end") - F.col("size"))
    parts = placed.filter("ok OR kind IS NULL OR place = 0").withColumn("ok", F.coalesce("ok", F.lit(False)))
    sweep = Window.partitionBy("row").orderBy("start", "kind")
    before, after = sweep.rowsBetween(Window.unboundedPreceding, -1), sweep.rowsBetween(1, Window.unboundedFollowing)
    classes = {"base": ("assign", "access", "hex"), "id": ("access", "identifier"), "secret": ("assign", "hex", "mixed")}
    of = {name: F.col("ok") & F.col("kind").isin(*[KINDS.index(k) for k in kinds]) for name, kinds in classes.items()}
    met = parts.withColumns({f"{n}_end": F.max(F.when(c, F.col("end"))).over(before) for n, c in of.items()})
    met = met.withColumns({f"{n}_start": F.min(F.when(c, F.col("start"))).over(after) for n, c in of.items()})
    near = lambda n: F.coalesce(F.col("start") - F.col(f"{n}_end") <= SCOPE, F.lit(False)) | F.coalesce(F.col(f"{n}_start") - F.col("end") <= SCOPE, F.lit(False))
    fresh = F.coalesce(F.col("base_end") <= F.col("start"), F.lit(True))
    weak = F.when(F.col("kind") == 3, near("secret")).when(F.col("kind") == 4, near("id") & fresh).when(F.col("kind") == 5, near("id") & near("secret"))
    return met.select("row", "doc_id", "kind", "start", "end", (F.col("ok") & ((F.col("kind") < 3) | F.coalesce(weak, F.lit(False)))).alias("reported"))


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    told, kind = F.col("reported"), F.col("kind")
    names = F.array(*map(F.lit, KINDS))

    def listed(keep: Column) -> Column:
        each = F.array_sort(F.collect_list(F.when(keep, F.struct("start", "kind", "end"))))
        return F.array_join(F.transform(each, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    rows = spans(documents).groupBy("row", "doc_id").agg(*[F.count_if(told & (kind == k)).alias(f"n_{KINDS[k]}") for k in range(3)], listed(told & (kind < 3)).alias("base"), listed(told).alias("spans"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
