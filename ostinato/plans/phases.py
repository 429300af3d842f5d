"""Queries of loop phases and block structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import block_folds as B
from ostinato.operators import phases as P
from ostinato.plans.decoding import RECURSIVE
from ostinato.plans.fixtures import EVENTS_SQL, events
from ostinato.plans.queries import ORDER, SONG, query, r6

_KIND = {"signup": 1, "purchase": 2, "error": 3}
_KIND_SQL = "CASE q WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 0 END"

PHASE_SQL = (
    EVENTS_SQL
    + f""", x AS (SELECT song, pos, root, {_KIND_SQL} AS q, (song % 12)::INTEGER AS tonic FROM ev),
    y AS (SELECT *, lead(root) OVER w AS r1, lead(q) OVER w AS k1, lead(root, 2) OVER w AS r2, lead(q, 2) OVER w AS k2 FROM x WINDOW w AS (PARTITION BY song ORDER BY pos)),
    g AS (SELECT * FROM (SELECT unnest(range(12)) AS d) CROSS JOIN (SELECT unnest(range(5)) AS q)),
    st AS (SELECT d AS r, q, ln(c / sum(c) OVER ()) AS lp FROM (SELECT d, g.q, 0.5::DOUBLE + (SELECT count(*) FROM y WHERE pos = 0 AND r1 IS NOT NULL AND (root - tonic + 12) % 12 = g.d AND y.q = g.q) AS c FROM g)),
    n2 AS (SELECT q AS q1, (r1 - root + 12) % 12 AS dn, k1 AS qn, count(*) AS n FROM y WHERE r1 IS NOT NULL GROUP BY 1, 2, 3),
    pr AS (SELECT q1, dn, qn, c / sum(c) OVER (PARTITION BY q1) AS p FROM (SELECT a.q1, g.d AS dn, g.q AS qn, 0.5::DOUBLE + coalesce(n, 0) AS c FROM (SELECT unnest(range(5)) AS q1) a CROSS JOIN g LEFT JOIN n2 ON n2.q1 = a.q1 AND n2.dn = g.d AND n2.qn = g.q)),
    tr AS (SELECT q AS q2, (root - r1 + 12) % 12 AS d21, k1 AS q1, (r2 - r1 + 12) % 12 AS dn, k2 AS qn, count(*) AS n FROM y WHERE r2 IS NOT NULL GROUP BY ALL),
    cx AS (SELECT q2, d21, q1, sum(n) AS c FROM tr GROUP BY ALL),
    b AS (SELECT song, pos, CASE WHEN pos % 9 <> 4 THEN (root - tonic + 12) % 12 END AS r, q, count(*) OVER (PARTITION BY song) AS n FROM x),
    s AS (SELECT b.song, b.n, b.pos, sh AS shift, ((b.pos - sh) % b.n + b.n) % b.n AS place FROM b CROSS JOIN (SELECT unnest(range(8)) AS sh) WHERE n >= 16),
    l AS (SELECT s.song, s.shift, s.place % 8 AS o, a.r, a.q, p1.r AS r1, p1.q AS k1, p2.r AS r2, p2.q AS k2 FROM s JOIN b a ON a.song = s.song AND a.pos = s.pos
      JOIN b p1 ON p1.song = s.song AND p1.pos = (s.pos - 1 + s.n) % s.n JOIN b p2 ON p2.song = s.song AND p2.pos = (s.pos - 2 + s.n) % s.n WHERE s.place // 8 < s.n // 8),
    v AS (SELECT l.song, l.shift, CASE WHEN l.r IS NULL THEN 0.0 WHEN o = 0 OR r1 IS NULL THEN st.lp WHEN o >= 2 AND r2 IS NOT NULL AND cx.c > 0 THEN ln(greatest(cx.c / (cx.c + 5.0) * (coalesce(tr.n, 0) / cx.c) + (1 - cx.c / (cx.c + 5.0)) * pr.p, 1e-12)) ELSE ln(greatest(pr.p, 1e-12)) END AS v
      FROM l LEFT JOIN st ON st.r = l.r AND st.q = l.q LEFT JOIN pr ON pr.q1 = k1 AND pr.dn = (l.r - r1 + 12) % 12 AND pr.qn = l.q
      LEFT JOIN cx ON cx.q2 = k2 AND cx.d21 = (r2 - r1 + 12) % 12 AND cx.q1 = k1 LEFT JOIN tr ON tr.q2 = k2 AND tr.d21 = (r2 - r1 + 12) % 12 AND tr.q1 = k1 AND tr.dn = (l.r - r1 + 12) % 12 AND tr.qn = l.q),
    f AS (SELECT song, shift, sum(v) AS logp FROM v GROUP BY 1, 2)
"""
)


def _phases(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"kind": F.coalesce(*[F.when(F.col("q") == q, k) for q, k in _KIND.items()], F.lit(0)), "tonic": (F.col("song") % 12).cast("int")})
    model = P.progression_model(e, SONG, ORDER, "root", "kind", "tonic")
    bars = e.withColumn("above", F.when(F.col("pos") % 9 != 4, F.pmod(F.col("root") - F.col("tonic"), F.lit(12))))
    return P.phase_scores(bars, SONG, "pos", "above", "kind", model, 8)


@query(PHASE_SQL + "SELECT song, shift, round(logp, 6) AS logp FROM f")
def phase_scores(spark, sf_dir) -> DataFrame:
    return _phases(spark, sf_dir).withColumn("logp", r6("logp"))


@query(PHASE_SQL + "SELECT song, shift, round(logp, 6) AS logp FROM f QUALIFY row_number() OVER (PARTITION BY song ORDER BY round(logp, 9) DESC, shift) = 1")
def corrected_phases(spark, sf_dir) -> DataFrame:
    return P.best_shift(_phases(spark, sf_dir), SONG).withColumn("logp", r6("logp"))


@query(
    RECURSIVE
    + """, b AS (SELECT song, list(q ORDER BY pos) AS x, count(*) AS n FROM ev GROUP BY 1),
    c AS (SELECT song, x, n, p, unnest(range(p)) AS phase FROM (SELECT song, x, n, unnest([4, 8, 16, 32]) AS p FROM b) WHERE p * 2 <= n AND n >= 8),
    k AS (SELECT *, (n - p - phase) // p + 1 AS k FROM c WHERE n - p - phase >= 0),
    r(song, p, phase, j, firsts, cluster) AS (SELECT song, p, phase, 0::BIGINT, [phase], 0::BIGINT FROM k
      UNION ALL SELECT song, p, phase, j, CASE WHEN hit = 0 THEN list_append(firsts, a) ELSE firsts END, CASE WHEN hit = 0 THEN len(firsts) ELSE hit - 1 END
      FROM (SELECT song, p, phase, j, a, firsts, coalesce(list_max(list_transform(range(1, len(sims) + 1), lambda i: CASE WHEN sims[i] >= 0.8 AND sims[i] = list_max(sims) THEN i ELSE 0 END)), 0) AS hit
        FROM (SELECT r.song, r.p, r.phase, r.j + 1 AS j, r.phase + (r.j + 1) * r.p AS a, r.firsts,
            list_transform(r.firsts, lambda f: len(list_filter(range(1, r.p + 1), lambda o: k.x[f + o] = k.x[r.phase + (r.j + 1) * r.p + o])) / r.p) AS sims
          FROM r JOIN k ON k.song = r.song AND k.p = r.p AND k.phase = r.phase AND r.j + 1 < k.k))),
    w AS (SELECT song, p, phase, j, phase + j * p AS a, cluster FROM r),
    s AS (SELECT u.song, u.p, u.phase, u.cluster = v.cluster AS same, len(list_filter(range(1, u.p + 1), lambda o: b.x[u.a + o] = b.x[v.a + o])) / u.p AS s FROM w u JOIN w v ON v.song = u.song AND v.p = u.p AND v.phase = u.phase AND v.j > u.j JOIN b ON b.song = u.song),
    q AS (SELECT song, p, phase, CASE WHEN count(*) FILTER (same) = 0 THEN -1.0 ELSE avg(s) FILTER (same) - coalesce(avg(s) FILTER (NOT same), 0.0) END AS q FROM s GROUP BY 1, 2, 3),
    sc AS (SELECT q.song, q.p, q.phase, k.k, k.n, round(q.q + 0.1 * k.k * q.p / k.n + q.p / k.n, 9) AS score FROM q JOIN k USING (song, p, phase)),
    best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY song ORDER BY score DESC, p, phase) = 1),
    o AS (SELECT w.song, w.a AS start, w.a + w.p AS "end", w.cluster, w.p AS period, w.phase, score FROM w JOIN best USING (song, p, phase)
      UNION ALL SELECT song, 0, phase, -1, p, phase, score FROM best WHERE phase > 0 UNION ALL SELECT song, phase + k * p, n, -1, p, phase, score FROM best WHERE phase + k * p < n
      UNION ALL SELECT song, 0, n, 0, n, 0, NULL FROM b WHERE song NOT IN (SELECT song FROM best))
    SELECT song, start, "end", cluster, period, phase, round(score, 6) AS score FROM o"""
)
def detected_blocks(spark, sf_dir) -> DataFrame:
    bars = events(spark, sf_dir).select("song", "pos", F.array("q").alias("symbols"))
    return B.detect_blocks(bars, SONG, "pos", "symbols").withColumn("score", r6("score"))
