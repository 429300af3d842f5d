"""Queries of refined roots, compressed loops and grammars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.operators import refine as R
from ostinato.plans.decoding import RECURSIVE
from ostinato.plans.fixtures import EVENTS_SQL, events
from ostinato.plans.queries import ORDER, SONG, query

_UNIT = 2**30
#: Intervals of a fifth and a second are likely steps.
STEPS = [math.log(x / 20) for x in (1, 1, 3, 1, 1, 4, 0.5, 3, 1, 1, 2.5, 1)]
_STEPS_SQL = "[" + ", ".join(str(round(0.4 * x * _UNIT)) for x in STEPS) + "]"
_IN_KEY = "((i - 1 - key) % 12 + 12) % 12 IN (0, 2, 4, 5, 7, 9, 11)"


def _round_sql(k: int, roots: str) -> str:
    """One round from the table ``roots`` (song, pos, root) to r{k}."""
    return f""", k{k} AS (SELECT song, arg_max(kk, (n, -kk)) AS key FROM (SELECT song, kk, count(*) FILTER (((root - kk) % 12 + 12) % 12 IN (0, 2, 4, 5, 7, 9, 11)) AS n FROM {roots} CROSS JOIN (SELECT unnest(range(12)) AS kk) GROUP BY 1, 2) GROUP BY 1),
    e{k} AS (SELECT song, pos, last, key, CASE WHEN sure THEN [top] ELSE range(12) END AS lab, CASE WHEN sure THEN [0::BIGINT] ELSE list_transform(range(1, 13), lambda i: round((ln(p[i] + 1e-9) + CASE WHEN {_IN_KEY} THEN 0.15 ELSE 0.0 END) * {_UNIT})::BIGINT) END AS s FROM seg JOIN k{k} USING (song)),
    f{k}(song, pos, lab, a, b) AS (SELECT song, pos, lab, s, list_transform(s, lambda y: 0::BIGINT) FROM e{k} WHERE pos = 0
      UNION ALL SELECT song, pos, lab, list_transform(range(1, len(s) + 1), lambda j: s[j] + list_max(list_transform(range(1, len(fa) + 1), lambda i: fa[i] + st[(lab[j] - flab[i] + 12) % 12 + 1]))),
        list_transform(range(1, len(s) + 1), lambda j: list_position(list_transform(range(1, len(fa) + 1), lambda i: fa[i] + st[(lab[j] - flab[i] + 12) % 12 + 1]), list_max(list_transform(range(1, len(fa) + 1), lambda i: fa[i] + st[(lab[j] - flab[i] + 12) % 12 + 1])))::BIGINT)
      FROM (SELECT e.song, e.pos, e.lab, e.s, f.a AS fa, f.lab AS flab, {_STEPS_SQL} AS st FROM f{k} f JOIN e{k} e ON e.song = f.song AND e.pos = f.pos + 1)),
    g{k}(song, pos, c) AS (SELECT f.song, f.pos, list_position(f.a, list_max(f.a))::BIGINT FROM f{k} f JOIN e{k} e ON e.song = f.song AND e.pos = f.pos AND e.pos = e.last
      UNION ALL SELECT g.song, g.pos - 1, f.b[g.c] FROM g{k} g JOIN f{k} f ON f.song = g.song AND f.pos = g.pos WHERE g.pos > 0),
    r{k} AS (SELECT g.song, g.pos, e.lab[g.c]::INTEGER AS root, e.key FROM g{k} g JOIN e{k} e USING (song, pos))"""


@query(
    RECURSIVE
    + """, raw AS (SELECT song, pos, max(pos) OVER (PARTITION BY song) AS last, list_transform(range(12), lambda i: 1.0 + CASE WHEN i = root THEN w / 4 ELSE 0.0 END + (w * (i + 3)) % 3.0) AS x FROM (SELECT song, pos, root, coalesce(w, 0.0) AS w FROM ev)),
    n AS (SELECT song, pos, last, list_transform(x, lambda y: y / list_sum(x)) AS p FROM raw),
    seg AS (SELECT *, list_position(p, list_max(p)) - 1 AS top, list_max(p) >= 0.4 AS sure FROM n), r0 AS (SELECT song, pos, top AS root FROM seg)"""
    + _round_sql(1, "r0")
    + _round_sql(2, "r1")
    + "SELECT r2.song, r2.pos, r2.root, seg.sure AS clamped, r2.key FROM r2 JOIN seg USING (song, pos)"
)
def refined_roots(spark, sf_dir) -> DataFrame:
    w = F.coalesce("w", F.lit(0.0))
    x = F.array(*[F.lit(1.0) + F.when(F.col("root") == i, w / 4).otherwise(0.0) + (w * (i + 3)) % 3.0 for i in range(12)])
    total = F.aggregate("x", F.lit(0.0), lambda a, y: a + y)
    e = events(spark, sf_dir).withColumn("x", x).withColumn("x", F.transform("x", lambda y: y / total))
    return R.refine_roots(e, SONG, ORDER, "x", STEPS, sure=0.4)


#: Bars whose roots follow a loop of two (odd songs) or four, but for heavy events, in families of 24 bars.
_LOOPED_SQL = (
    EVENTS_SQL
    + f""", b AS (SELECT song, pos // 24 AS family, pos, w, q, CASE WHEN pos % 13 = 6 THEN NULL WHEN w > 55 THEN root ELSE (pos % p) * 3 END AS root, p FROM (SELECT *, CASE WHEN song % 2 = 1 THEN 2 ELSE 4 END AS p FROM ev)),
    v AS (SELECT *, list_transform(range(12), lambda i: CASE WHEN i = root THEN 0.2 + w / 200 ELSE 0.02 + ((w * (i + 1)) % 1.0) / 20 END) AS post, CASE WHEN root IS NOT NULL THEN row_number() OVER (PARTITION BY song, family, root IS NULL ORDER BY pos) - 1 END AS k, count(root) OVER (PARTITION BY song, family) AS m FROM b),
    sl AS (SELECT song, family, k % p AS slot, root, count(*) AS n FROM v WHERE root IS NOT NULL GROUP BY 1, 2, 3, 4), pt AS (SELECT song, family, slot, root FROM sl QUALIFY row_number() OVER (PARTITION BY song, family, slot ORDER BY n DESC, root) = 1),
    lo AS (SELECT song, family, list(root ORDER BY slot) AS pat FROM pt JOIN (SELECT DISTINCT song, family, p FROM v) USING (song, family) GROUP BY 1, 2 HAVING count(*) = any_value(p)),
    x AS (SELECT v.*, pat, CASE WHEN pat IS NULL THEN NULL WHEN p = 2 AND list_contains(pat, v.root) THEN CASE WHEN v.root = pat[1] THEN 0 ELSE 1 END WHEN p = 2 THEN CASE WHEN post[pat[1] + 1] >= post[pat[2] + 1] THEN 0 ELSE 1 END ELSE k % p END AS at_ FROM v LEFT JOIN lo USING (song, family)),
    y AS (SELECT *, pat[at_ + 1] AS want, coalesce(root = pat[at_ + 1], false) AS inside FROM x),
    kd AS (SELECT song, family, k % p AS at_, q FROM (SELECT song, family, k, p, q, count(*) AS n FROM (SELECT song, family, k % p AS k, p, q FROM x WHERE root IS NOT NULL AND pat IS NOT NULL AND root = pat[k % p + 1]) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY song, family, k ORDER BY n DESC, q) = 1),
    z AS (SELECT y.*, kd.q AS mode, sum(inside::INTEGER) OVER (PARTITION BY y.song, y.family) / m AS cov FROM y LEFT JOIN kd ON kd.song = y.song AND kd.family = y.family AND kd.at_ = y.at_),
    o AS (SELECT *, coalesce(root IS NOT NULL AND NOT inside AND 1.5 * post[root + 1] * (ln(greatest(post[root + 1], 1e-9)) - ln(greatest(post[want + 1], 1e-9))) + ln(0.38 / (1 - 0.38)) - 1.2 * (cov - 0.5) + ln({list(R.BY_PLACE)}[pos % 8 + 1]) > 0, false) AS keep FROM z),
    u AS (SELECT *, pat IS NOT NULL AND m >= 8 AND sum(keep::INTEGER) OVER (PARTITION BY song, family) <= 0.35 * m AS applies FROM o),
    t AS (SELECT *, CASE WHEN NOT applies OR root IS NULL THEN 'untouched' WHEN inside THEN 'loop' WHEN keep THEN 'kept' ELSE 'snapped' END AS outcome FROM u)
    SELECT song, family, pos, CASE WHEN outcome IN ('loop', 'snapped') THEN want ELSE root END AS root, CASE WHEN outcome IN ('loop', 'snapped') THEN coalesce(mode, 'maj') ELSE q END AS q, outcome FROM t"""
)


@query(_LOOPED_SQL)
def compressed_loops(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"p": F.when(F.col("song") % 2 == 1, 2).otherwise(4), "family": F.expr("pos div 24")})
    e = e.withColumn("root", F.when(F.col("pos") % 13 == 6, None).when(F.col("w") > 55, F.col("root")).otherwise((F.col("pos") % F.col("p")).cast("int") * 3))
    e = e.withColumn("post", F.array(*[F.when(F.col("root") == i, 0.2 + F.col("w") / 200).otherwise(0.02 + ((F.col("w") * (i + 1)) % 1.0) / 20) for i in range(12)]))
    keys = ["song", "family"]
    k = (F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1) % F.col("p")
    n = e.filter("root is not null").withColumn("slot", k).groupBy(*keys, "p", "slot", "root").agg(F.count("*").alias("n"))
    best = n.groupBy(*keys, "p", "slot").agg(F.min_by("root", F.struct(-F.col("n"), F.col("root"))).alias("root"))
    loops = best.groupBy(*keys, "p").agg(F.array_sort(F.collect_list(F.struct("slot", "root"))).alias("x")).filter("size(x) = p").select(*keys, F.col("p").alias("period"), F.col("x.root").alias("pattern"))
    return R.compress_loops(e, loops, keys, "pos", "root", "q", "post")


@query(
    RECURSIVE
    + """, s AS (SELECT song, string_agg('<' || id || '>', '' ORDER BY pos) AS s, max(id) + 1 AS next FROM (SELECT song, pos, CASE q WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS id FROM ev) GROUP BY 1),
    r(song, s, next, a, b, n) AS (SELECT song, s, next, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT FROM s
      UNION ALL SELECT song, replace(s, best, '<' || next || '>'), next + 1, regexp_extract_all(best, '<\\d+>')[1], regexp_extract_all(best, '<\\d+>')[2], top
      FROM (SELECT song, s, next, top, pairs[list_position(counts, top)] AS best FROM (SELECT *, list_max(counts) AS top FROM (SELECT *, list_transform(pairs, lambda p: len(list_filter(pairs, lambda x: x = p))) AS counts
        FROM (SELECT song, s, next, list_transform(range(1, len(t)), lambda i: t[i] || t[i + 1]) AS pairs FROM (SELECT song, s, next, regexp_extract_all(s, '<\\d+>') AS t FROM r))))) WHERE top >= 2)
    SELECT song, (next - 1)::BIGINT AS rule, trim(a, '<>')::BIGINT AS a, trim(b, '<>')::BIGINT AS b, n FROM r WHERE n IS NOT NULL"""
)
def pair_rules(spark, sf_dir) -> DataFrame:
    ids = {"click": 0, "error": 1, "purchase": 2, "signup": 3}
    e = events(spark, sf_dir).withColumn("id", F.coalesce(*[F.when(F.col("q") == q, i) for q, i in ids.items()], F.lit(4)))
    return R.pair_grammar(e, SONG, ORDER, "id")[0]
