"""DuckDB SQL of operators 11 to 13, written from their definitions rather than from the Spark code."""

from __future__ import annotations

_POSITIONS = "(SELECT unnest(range(1, 17)) AS place)"


def _codes(rounds: int = 4) -> str:
    """Lloyd's rounds, one pair of common tables each: assign all parts, then floor the means (an integer division that rounds down)."""
    square = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS x FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS (SELECT part, r - 1 AS k, x FROM p WHERE r <= 256)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT p.r, p.part, min(struct_pack(d := CAST({square} AS BIGINT), k := c.k)) AS m FROM p JOIN c{i} c ON c.part = p.part GROUP BY p.r, p.part)")
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT o.part, o.k, coalesce(n.x, o.x) AS x FROM c{i} o LEFT JOIN (
    SELECT part, k, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM (
      SELECT a.part, a.m.k AS k, g.place, sum(p.x[g.place]) AS s, count(*) AS n FROM a{i} a JOIN p USING (r, part), {_POSITIONS} g WHERE g.place <= len(p.x) GROUP BY 1, 2, 3)
    GROUP BY part, k) n ON n.part = o.part AND n.k = o.k)"""
            )
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', m.k), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (r), h"


_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY ALL),
v AS (SELECT lang, count(*) AS words, sum(n) AS size FROM k GROUP BY lang),
every AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.size, 0) + v.words)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (v.size + v.words)::HUGEINT AS whole
  FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - whole) * (p - whole)) // whole AS BIGINT) FROM every WHERE n > 0 AND p > whole)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
QUALIFY part = 'pair' OR rank <= 200
"""

_KEYS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
_NAMES = "[aA][cC][cC][eE][sS][sS]_?[kK][eE][yY]_?[iI][dD]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][oO][uU][nN][tT]_?[iI][dD]|[uU][sS][eE][rR][nN][aA][mM][eE]|[lL][oO][gG][iI][nN]"
#: kind, pattern, group whose length counts, least length.
_PATTERNS = (
    ("assign", f"""(?:{_KEYS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("identifier", f"""(?:{_NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.@-]+)""", 1, 4),
    ("mixed", "[A-Za-z0-9+/_-]+", 0, 24),
    ("endpoint", r"(?:https?|wss?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0, 1),
)


def _secrets(scope: int = 200) -> str:
    """Matches of each pattern with their places, then weak ones by comparing each with every part of its text."""
    found = " UNION ALL ".join(
        f"""SELECT r, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p.replace("'", "''")}', 0) AS m, regexp_extract_all(t, '{p.replace("'", "''")}', {group}) AS v,
  regexp_split_to_array(t, '{p.replace("'", "''")}') AS g, {least} AS least FROM d"""
        for k, (kind, p, group, least) in enumerate(_PATTERNS)
    )
    apart = f"(w.a - x.z <= {scope} AND x.a <= w.a OR x.a - w.z <= {scope} AND x.a >= w.a)"
    near = lambda kinds: f"EXISTS (SELECT 1 FROM ok x WHERE x.r = w.r AND x.k IN ({kinds}) AND {apart})"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT r, k, kind, least, m[i] AS m, v[i] AS v, g[i] AS g, i FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
places AS (SELECT r, k, kind, m, v, least, sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS z FROM e),
ok AS MATERIALIZED (SELECT r, k, kind, z - length(m) AS a, z FROM places WHERE length(v) >= least AND (k <> 4 OR regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]'))),
told AS (
  SELECT * FROM ok WHERE k < 3
  UNION ALL SELECT * FROM ok w WHERE k = 3 AND {near("0, 2, 4")}
  UNION ALL SELECT * FROM ok w WHERE k = 4 AND {near("1, 3")} AND NOT EXISTS (SELECT 1 FROM ok x WHERE x.r = w.r AND x.k < 3 AND x.z > w.a AND x.a <= w.a)
  UNION ALL SELECT * FROM ok w WHERE k = 5 AND {near("1, 3")} AND {near("0, 2, 4")}),
n AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(concat_ws(':', kind, CAST(a AS BIGINT), CAST(z AS BIGINT)), ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(concat_ws(':', kind, CAST(a AS BIGINT), CAST(z AS BIGINT)), ',' ORDER BY a, k) AS spans
  FROM told GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (r)
"""


SQL = {"op11_vector_codes": _codes(), "op12_source_divergence": _DIVERGENCE, "op13_secret_scan": _secrets()}
