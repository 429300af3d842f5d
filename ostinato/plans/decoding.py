"""Queries of the decoders, each with SQL that walks its sequences by recursion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import decode as D
from ostinato.operators import joint as J
from ostinato.operators import stats as A
from ostinato.plans.fixtures import EVENTS_SQL, events
from ostinato.plans.queries import ORDER, SONG, query, r6

RECURSIVE = EVENTS_SQL.replace("WITH ev", "WITH RECURSIVE ev", 1)
_UNIT = 2**30

#: Class of an event's type (major, minor, dominant, half-diminished), and the families of the five classes.
CLASS_OF = {"click": 0, "signup": 1, "purchase": 2, "error": 3}
_CLASS_SQL = "CASE q WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 0 END"
_FAMILY_SQL = "CASE q WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 0 END"

#: Durations of up to four rows of the states quiet and loud.
LENGTHS = [[-2.0, -1.0, -0.75, -1.25], [-1.125, -0.875, -1.625, -2.25]]
STEPS = [[-1.625, -0.3125], [-0.375, -1.875]]

_LOUD = "least(w / 100, 1.0)"


@query(
    RECURSIVE
    + f""", e AS (SELECT song, pos, CAST(round(ln(1.05 - x) * {_UNIT}) AS BIGINT) AS e0, CAST(round(ln(0.05 + x) * {_UNIT}) AS BIGINT) AS e1 FROM (SELECT song, pos, {_LOUD} AS x FROM ev)),
    l AS (SELECT unnest([1, 2, 3, 4]) AS d, unnest({LENGTHS[0]}) AS d0, unnest({LENGTHS[1]}) AS d1),
    d AS (SELECT d, CAST(round(d0 * {_UNIT}) AS BIGINT) AS d0, CAST(round(d1 * {_UNIT}) AS BIGINT) AS d1 FROM l),
    c AS (SELECT song, pos, sum(e0) OVER w AS c0, sum(e1) OVER w AS c1, count(*) OVER (PARTITION BY song) AS n FROM e WINDOW w AS (PARTITION BY song ORDER BY pos)),
    seg AS (SELECT z.song, z.pos + 1 AS stop, d.d, (z.c0 - coalesce(a.c0, 0) + d.d0)::BIGINT AS g0, (z.c1 - coalesce(a.c1, 0) + d.d1)::BIGINT AS g1
      FROM c z CROSS JOIN d LEFT JOIN c a ON a.song = z.song AND a.pos = z.pos - d.d WHERE z.pos - d.d >= -1),
    gl AS (SELECT song, stop, list(g0 ORDER BY d) AS g0, list(g1 ORDER BY d) AS g1 FROM seg GROUP BY 1, 2),
    f(song, stop, enter0, enter1, s0, s1) AS (SELECT DISTINCT song, 0::BIGINT, [0::BIGINT], [0::BIGINT], 0::BIGINT, 0::BIGINT FROM e
      UNION ALL SELECT song, stop, list_prepend(greatest(b0 + {round(STEPS[0][0] * _UNIT)}, b1 + {round(STEPS[1][0] * _UNIT)}), enter0)[1:4], list_prepend(greatest(b0 + {round(STEPS[0][1] * _UNIT)}, b1 + {round(STEPS[1][1] * _UNIT)}), enter1)[1:4], b0, b1
      FROM (SELECT gl.song, gl.stop, f.enter0, f.enter1,
          list_max(list_transform(range(1, len(gl.g0) + 1), lambda d: gl.g0[d] + f.enter0[d])) AS b0, list_max(list_transform(range(1, len(gl.g1) + 1), lambda d: gl.g1[d] + f.enter1[d])) AS b1
        FROM f JOIN gl ON gl.song = f.song AND gl.stop = f.stop + 1))
    SELECT f.song, round(greatest(s0, s1) / {_UNIT}, 6) AS log_score FROM f JOIN (SELECT song, max(stop) AS stop FROM f GROUP BY 1) USING (song, stop)"""
)
def timed_score(spark, sf_dir) -> DataFrame:
    """The score of the best segmentation into quiet and loud stretches of one to four events."""
    x = F.least(F.col("w") / 100, F.lit(1.0))
    e = events(spark, sf_dir).withColumn("e", F.array(F.ln(1.05 - x), F.ln(0.05 + x)))
    return D.semi_markov(e, SONG, "pos", "e", LENGTHS, transition=STEPS).groupBy("song").agg(r6(F.first("log_score")).alias("log_score"))


def _segments(spark, sf_dir) -> DataFrame:
    """Events as segments: posteriors and class scores made of root, type and weight; some are confirmed, some tied."""
    e = events(spark, sf_dir)
    w = F.coalesce("w", F.lit(0.0))
    kind = F.coalesce(*[F.when(F.col("q") == q, c) for q, c in CLASS_OF.items()], F.lit(0))
    posterior = F.array(*[F.lit(1.0) + F.when(F.col("root") == i, 4.0).otherwise(0.0) + (w * (i + 3)) % 5.0 for i in range(12)])
    logp = F.array(*[F.array(*[-(0.3 + (w * (q + 1) + r) % 3.0) - F.when(kind == q, 0.0).otherwise(1.5) for q in range(5)]) for r in range(12)])
    greedy = F.array(*[F.when(F.col("root") == r, kind) for r in range(12)])
    confirmed = F.col("pos") % 17 == 5
    return e.select(
        "song",
        "pos",
        posterior.alias("posterior"),
        logp.alias("class_logp"),
        greedy.alias("greedy"),
        (F.col("song") % 12).cast("int").alias("tonic"),
        F.when(confirmed, (F.col("root") + 1) % 12).alias("clamp_root"),
        F.when(confirmed & (F.col("pos") % 2 == 0), 2).alias("clamp_class"),
        F.when(F.col("pos") % 8 == 3, F.expr("pos div 16")).alias("tie"),
        F.col("q"),
        F.col("root"),
    )


def _prior(segments: DataFrame) -> list[list[float]]:
    """ln P(next | previous) of the 60 scale-relative states, counts raised by 0.2: at most 3,600 counts."""
    family = F.when(F.col("q") == "signup", 1).when(F.col("q") == "error", 2).otherwise(0)
    state = (F.pmod(F.col("root") - F.col("tonic"), F.lit(12)) * 5 + family).alias("state")
    counts = {(r["s0"], r["s1"]): r["n"] for r in A.ngram_counts(segments.select("song", "pos", state), SONG, ORDER, "state", 2).collect()}
    rows = [[counts.get((a, b), 0) + 0.2 for b in range(60)] for a in range(60)]
    return [[math.log(x / sum(row)) for x in row] for row in rows]


@query(
    RECURSIVE
    + f""", x AS (SELECT song, pos, q, root, coalesce(w, 0.0) AS w, {_CLASS_SQL} AS kind, (song % 12)::INTEGER AS tonic, CASE WHEN pos % 8 = 3 THEN pos // 16 END AS tie,
      CASE WHEN pos % 17 = 5 THEN (root + 1) % 12 END AS cr, CASE WHEN pos % 17 = 5 AND pos % 2 = 0 THEN 2 END AS cc FROM ev),
    b AS (SELECT s0, s1, count(*) AS n FROM (SELECT s AS s0, lead(s) OVER (PARTITION BY song ORDER BY pos) AS s1 FROM (SELECT song, pos, ((root - tonic) % 12 + 12) % 12 * 5 + {_FAMILY_SQL} AS s FROM x)) WHERE s1 IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT a.range AS s0, b2.range AS s1, coalesce(n, 0) + 0.2::DOUBLE AS c FROM range(60) a CROSS JOIN range(60) b2 LEFT JOIN b ON b.s0 = a.range AND b.s1 = b2.range),
    lp AS (SELECT s0, s1, ln(c / sum(c) OVER (PARTITION BY s0)) AS p FROM g),
    t AS (SELECT list(p ORDER BY s0, s1) AS t, list(round(p * {_UNIT})::BIGINT ORDER BY s0, s1) AS ti FROM lp),
    r AS (SELECT x.*, i::INTEGER AS r, 1.0 + CASE WHEN root = i THEN 4.0 ELSE 0.0 END + (w * (i + 3)) % 5.0 AS p FROM x CROSS JOIN (SELECT unnest(range(12)) AS i)),
    rn AS (SELECT *, p / sum(p) OVER (PARTITION BY song, pos) AS pn, row_number() OVER (PARTITION BY song, pos ORDER BY p DESC, r DESC) AS k FROM r),
    c0 AS (SELECT *, k AS place FROM rn WHERE k <= 3 UNION ALL SELECT *, 4 FROM rn WHERE k > 3 AND r = cr),
    u AS (SELECT DISTINCT song, tie, r FROM c0 WHERE tie IS NOT NULL),
    c AS (SELECT song, pos, tie, r, place FROM c0 WHERE tie IS NULL UNION ALL SELECT x.song, x.pos, x.tie, u.r, row_number() OVER (PARTITION BY x.song, x.pos ORDER BY u.r) FROM x JOIN u USING (song, tie)),
    e0 AS (SELECT c.song, c.pos, c.tie, c.r, c.place, rn.tonic, rn.pn, rn.cr, rn.cc, rn.kind, rn.root, j::INTEGER AS j, -(0.3 + (rn.w * (j + 1) + c.r) % 3.0) - CASE WHEN rn.kind = j THEN 0.0 ELSE 1.5 END AS lp
      FROM c JOIN rn USING (song, pos, r) CROSS JOIN (SELECT unnest(range(5)) AS j)),
    e1 AS (SELECT *, max(lp) OVER (PARTITION BY song, pos, r) AS top, first(j) OVER (PARTITION BY song, pos, r ORDER BY lp DESC, j) AS best FROM e0),
    e2 AS (SELECT song, pos, tie, r, place, tonic, j, ln(greatest(pn, 1e-12)) + CASE WHEN r = root AND j = kind AND best <> kind THEN top + 0.001 ELSE lp END + CASE WHEN r = cr AND (cc IS NULL OR cc = j) THEN 40.0 ELSE 0.0 END AS s FROM e1),
    e3 AS (SELECT song, pos, tie, r, place, tonic, j, CASE WHEN tie IS NULL THEN s ELSE sum(s) OVER (PARTITION BY song, tie, r, j) END AS s FROM e2),
    st AS (SELECT song, pos, any_value(tie) AS tie, list(r ORDER BY place, j) AS rr, list(j ORDER BY place, j) AS jj, list(s ORDER BY place, j) AS s, list(round(s * {_UNIT})::BIGINT ORDER BY place, j) AS si,
      list(((r - tonic) % 12 + 12) % 12 * 5 + [0, 1, 0, 2, 2][j + 1] ORDER BY place, j) AS lab, count(*) AS n FROM e3 GROUP BY 1, 2),
    z AS (SELECT song, max(pos) AS last FROM st GROUP BY 1),
    f(song, pos, lab, a, l) AS (SELECT song, pos, lab, si, s FROM st WHERE pos = 0
      UNION ALL SELECT st.song, st.pos, st.lab,
        list_transform(range(1, st.n + 1), lambda j: st.si[j] + list_max(list_transform(range(1, len(f.a) + 1), lambda i: f.a[i] + t.ti[f.lab[i] * 60 + st.lab[j] + 1]))),
        list_transform(range(1, st.n + 1), lambda j: st.s[j] + list_max(f.l) + ln(list_sum(list_transform(range(1, len(f.l) + 1), lambda i: exp(f.l[i] - list_max(f.l) + t.t[f.lab[i] * 60 + st.lab[j] + 1])))))
      FROM f JOIN st ON st.song = f.song AND st.pos = f.pos + 1 CROSS JOIN t),
    h(song, pos, lab, a, l) AS (SELECT st.song, st.pos, st.lab, list_transform(st.si, lambda y: y), list_transform(st.s, lambda y: y) FROM st JOIN z ON z.song = st.song AND st.pos = z.last
      UNION ALL SELECT st.song, st.pos, st.lab,
        list_transform(range(1, st.n + 1), lambda j: st.si[j] + list_max(list_transform(range(1, len(h.a) + 1), lambda i: h.a[i] + t.ti[st.lab[j] * 60 + h.lab[i] + 1]))),
        list_transform(range(1, st.n + 1), lambda j: st.s[j] + list_max(h.l) + ln(list_sum(list_transform(range(1, len(h.l) + 1), lambda i: exp(h.l[i] - list_max(h.l) + t.t[st.lab[j] * 60 + h.lab[i] + 1])))))
      FROM h JOIN st ON st.song = h.song AND st.pos = h.pos - 1 CROSS JOIN t),
    m AS (SELECT st.song, st.pos, st.tie, st.rr, st.jj, st.s, list_transform(range(1, st.n + 1), lambda i: f.a[i] + h.a[i] - st.si[i]) AS ab, list_transform(range(1, st.n + 1), lambda i: f.l[i] + h.l[i] - st.s[i]) AS lm FROM st JOIN f USING (song, pos) JOIN h USING (song, pos)),
    o AS (SELECT *, CASE WHEN tie IS NULL THEN list_position(ab, list_max(ab)) ELSE list_position(s, list_max(s)) END AS chosen FROM m)
    SELECT song, pos, rr[chosen] AS root, jj[chosen] AS class, round(exp(lm[chosen] - list_max(lm)) / list_sum(list_transform(lm, lambda y: exp(y - list_max(lm)))), 5) AS confidence FROM o"""
)
def joint_segments(spark, sf_dir) -> DataFrame:
    segments = _segments(spark, sf_dir)
    out = J.joint_decode(segments.drop("q", "root"), SONG, ORDER, _prior(segments))
    return out.select("song", "pos", "root", "class", F.round("confidence", 5).alias("confidence"))
