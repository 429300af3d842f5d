"""Queries of users' constraints and of beat grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import beats as B
from ostinato.operators import constraints as C
from ostinato.operators.sequences import ordered
from ostinato.plans.decoding import RECURSIVE
from ostinato.plans.fixtures import EVENTS_SQL, events
from ostinato.plans.queries import SONG, query, r6

#: Beats every two minutes or so; spans of 6 to 8 events from every 16th, tied by type of their first event.
SPANS_SQL = (
    EVENTS_SQL
    + """, s AS (SELECT song, root % 3 AS grp, pos AS span, t / 1e6 AS t0, t / 1e6 + (5 + pos % 3) * p AS t1 FROM ev JOIN (SELECT song, median(g) AS p FROM (SELECT song, (lead(t) OVER (PARTITION BY song ORDER BY pos) - t) / 1e6 AS g FROM ev) WHERE g IS NOT NULL GROUP BY 1) USING (song) WHERE pos % 8 = 2),
    gap AS (SELECT song, median(g) AS period FROM (SELECT song, lead(t / 1e6) OVER (PARTITION BY song ORDER BY t) - t / 1e6 AS g FROM ev) WHERE g IS NOT NULL GROUP BY 1 HAVING median(g) > 1e-9),
    sb AS (SELECT s.*, (SELECT min(pos) FROM ev WHERE ev.song = s.song AND ev.t / 1e6 = s.t0) AS first, greatest(1, floor((t1 - t0) / period + 0.5))::BIGINT AS beats FROM s JOIN gap USING (song)),
    m AS (SELECT song, grp, beats AS expected, n, kinds, total FROM (SELECT song, grp, beats, count(*) AS n, count(*) OVER (PARTITION BY song, grp) AS kinds, sum(count(*)) OVER (PARTITION BY song, grp) AS total FROM sb GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY song, grp ORDER BY n DESC, beats DESC) = 1),
    rep AS (SELECT sb.*, expected, CASE WHEN total < 2 THEN 'single' WHEN n < 2 THEN 'unpoolable' WHEN kinds > 1 THEN 'partial' ELSE 'pooled' END AS status FROM sb JOIN m USING (song, grp))
"""
)


def _spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir).withColumn("time", F.col("t") / 1e6)
    gaps = e.select("song", (F.lead("time").over(ordered(SONG, ["pos"])) - F.col("time")).alias("g")).filter("g is not null").groupBy("song").agg(F.median("g").alias("p"))
    spans = e.filter("pos % 8 = 2").join(gaps, "song").select("song", (F.col("root") % 3).alias("group"), F.col("pos").alias("span"), F.col("time").alias("t0"), (F.col("time") + (5 + F.col("pos") % 3) * F.col("p")).alias("t1"))
    return C.spans_to_beats(spans, e.select("song", F.col("pos").alias("beat"), "time"), SONG), e


@query(SPANS_SQL + """SELECT song, grp AS "group", span, first, beats, expected, beats - expected AS delta, status IN ('pooled', 'partial') AND beats = expected AS used, status FROM rep""")
def pool_report(spark, sf_dir) -> DataFrame:
    return C.pool_report(_spans(spark, sf_dir)[0], SONG)


@query(
    SPANS_SQL
    + """, u AS (SELECT song, grp, span, o, first + o AS beat FROM rep CROSS JOIN (SELECT unnest(range(40)) AS o) WHERE status IN ('pooled', 'partial') AND beats = expected AND o < beats),
    v AS (SELECT song, pos AS beat, w / 50 AS a, root / 12 AS b FROM ev),
    r AS (SELECT u.*, v.a, v.b FROM u JOIN v USING (song, beat)),
    p AS (SELECT song, grp, o, count(*) AS n, sum(a) AS a, sum(b) AS b, arg_min(a + b, (beat, span)) AS own FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    x AS (SELECT r.song, r.beat, r.grp, CASE WHEN own > 0.5 AND own < 1.5 AND p.a + p.b > 1e-9 THEN p.a / (p.a + p.b) ELSE p.a END AS a, CASE WHEN own > 0.5 AND own < 1.5 AND p.a + p.b > 1e-9 THEN p.b / (p.a + p.b) ELSE p.b END AS b FROM r JOIN p USING (song, grp, o)),
    y AS (SELECT song, beat, a, b FROM x QUALIFY row_number() OVER (PARTITION BY song, beat ORDER BY grp DESC) = 1)
    SELECT v.song, v.beat, y.song IS NOT NULL AS pooled, round(coalesce(y.a, v.a), 6) AS a, round(coalesce(y.b, v.b), 6) AS b FROM v LEFT JOIN y USING (song, beat)"""
)
def pooled_spans(spark, sf_dir) -> DataFrame:
    spans, e = _spans(spark, sf_dir)
    evidence = e.select("song", F.col("pos").alias("beat"), F.array(F.col("w") / 50, F.col("root") / 12).alias("x"))
    return C.pool_evidence(spans, evidence, SONG, "x").select("song", "beat", "pooled", r6(F.col("x")[0]).alias("a"), r6(F.col("x")[1]).alias("b"))


@query(
    EVENTS_SQL
    + """, s AS (SELECT song, root % 2 AS grp, pos AS span, pos * 2.0 AS a, pos * 2.0 + 7 + pos % 4 AS z FROM ev WHERE pos % 10 = 3), g AS (SELECT song, pos AS segment, pos * 3.0 AS a, pos * 3.0 + 3 AS z FROM ev),
    m AS (SELECT song, grp FROM s GROUP BY 1, 2 HAVING count(*) >= 2),
    x AS (SELECT s.song, s.grp, s.span, g.segment, CASE WHEN g.segment IS NOT NULL THEN row_number() OVER (PARTITION BY s.song, s.grp, s.span ORDER BY g.a) - 1 END AS k FROM s JOIN m USING (song, grp) LEFT JOIN g ON g.song = s.song AND g.a < s.z AND g.z > s.a),
    n AS (SELECT song, grp, span, count(k) AS covered FROM x GROUP BY 1, 2, 3), e AS (SELECT song, grp, arg_min(covered, span) AS expected, min(covered) = max(covered) AS even FROM n GROUP BY 1, 2)
    SELECT song, grp AS "group", span, k, segment, expected, covered, even AND k IS NOT NULL AS tied FROM x JOIN n USING (song, grp, span) JOIN e USING (song, grp)"""
)
def tied_segments(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    p = F.col("pos").cast("double")
    spans = e.filter("pos % 10 = 3").select("song", (F.col("root") % 2).alias("group"), F.col("pos").alias("span"), (p * 2).alias("start"), (p * 2 + 7 + F.col("pos") % 4).alias("end"))
    return C.tied_segments(spans, e.select("song", F.col("pos").alias("segment"), (p * 3).alias("start"), (p * 3 + 3).alias("end")), SONG, 10.0)


@query(
    EVENTS_SQL
    + """, c AS (SELECT song, pos AS place, pos * 1.5 AS a, pos * 1.5 + 4 AS z, (root + 12) % 12 AS root, CASE WHEN pos % 2 = 0 THEN 1 END AS class, 40.0 AS bonus FROM ev WHERE q = 'signup'), g AS (SELECT song, pos AS segment, pos * 2.0 AS a, pos * 2.0 + 2 AS z FROM ev),
    l AS (SELECT g.song, g.segment, c.root, c.class, c.bonus FROM g JOIN c ON c.song = g.song AND g.a < c.z AND g.z > c.a QUALIFY row_number() OVER (PARTITION BY g.song, g.segment ORDER BY c.place DESC) = 1)
    SELECT g.song, g.segment, l.root AS clamp_root, l.class AS clamp_class, l.bonus AS clamp_bonus FROM g LEFT JOIN l USING (song, segment)"""
)
def clamped_segments(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    p = F.col("pos").cast("double")
    confirms = e.filter("q = 'signup'").select("song", F.col("pos").alias("place"), (p * 1.5).alias("start"), (p * 1.5 + 4).alias("end"), "root", F.when(F.col("pos") % 2 == 0, 1).alias("class"), F.lit(40.0).alias("bonus"))
    return C.clamps(confirms, e.select("song", F.col("pos").alias("segment"), (p * 2).alias("start"), (p * 2 + 2).alias("end")), SONG, 8.0).drop("start", "end")


#: Chords of a song's loop of eight events, with a seventh of them off it; sections of four events.
_MERGE_SQL = (
    EVENTS_SQL
    + """, ch AS (SELECT song, pos * 2.0 AS a, pos * 2.0 + 2 AS z, CASE WHEN (root + pos) % 7 = 0 THEN q ELSE chr((65 + pos % 4)::INTEGER) END AS symbol FROM ev),
    fr AS (SELECT song, pos * 2.0 + 0.5 AS at, [(pos % 4 = 0)::INTEGER * 40.0 + w, (pos % 4 = 1)::INTEGER * 40.0 + root, (pos % 4 = 2)::INTEGER * 40.0 + 3, (pos % 4 = 3)::INTEGER * 40.0 + 5] AS v FROM ev),
    se AS (SELECT song, pos // 4 AS section, chr((65 + (pos // 4) % 2)::INTEGER) AS label, 2 AS bars, min(pos) * 2.0 AS a, min(pos) * 2.0 + 8 AS z FROM ev GROUP BY 1, 2, 3),
    pt AS (SELECT song, section, label, k, a + k * 1.0 AS s, a + k * 1.0 + 0.5 AS m FROM se CROSS JOIN (SELECT unnest(range(8)) AS k)),
    sy AS (SELECT pt.*, ch.symbol FROM pt LEFT JOIN ch ON ch.song = pt.song AND ch.a <= pt.m AND pt.m < ch.z),
    pr AS (SELECT x.song, x.section AS a, y.section AS b, count(*) FILTER (x.symbol = y.symbol) / 8 AS agreement FROM sy x JOIN sy y ON x.song = y.song AND x.label = y.label AND x.section < y.section AND x.k = y.k GROUP BY 1, 2, 3 HAVING count(*) FILTER (x.symbol = y.symbol) / 8 > 0.75),
    mv AS (SELECT pt.song, pt.section, k, list_transform([1, 2, 3, 4], lambda i: list_avg(list_transform(list(v), lambda y: y[i]))) AS v FROM pt JOIN fr ON fr.song = pt.song AND pt.s <= fr.at AND fr.at < pt.s + 1.0 GROUP BY 1, 2, 3),
    cv AS (SELECT song, section, k, list_transform(v, lambda x: x - list_avg(v)) AS v FROM mv),
    lk AS (SELECT pr.song, pr.a, pr.b, avg(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))) AS l FROM pr JOIN cv x ON x.song = pr.song AND x.section = pr.a JOIN cv y ON y.song = pr.song AND y.section = pr.b AND y.k = x.k GROUP BY 1, 2, 3)
    SELECT song, a, b, agreement, round(greatest(0.0, least(1.0, coalesce(l, 0.0))), 6) AS likeness, coalesce(l, 0.0) > 0.75 AS fires FROM pr LEFT JOIN lk USING (song, a, b)"""
)


@query(_MERGE_SQL)
def merge_candidates(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    p, four = F.col("pos").cast("double"), F.col("pos") % 4
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), (four + 1).cast("int"))
    chords = e.select("song", (p * 2).alias("start"), (p * 2 + 2).alias("end"), F.when((F.col("root") + F.col("pos")) % 7 == 0, F.col("q")).otherwise(letter).alias("symbol"))
    peak = lambda i, x: (four == i).cast("int") * 40.0 + x
    frames = e.select("song", (p * 2 + 0.5).alias("at"), F.array(peak(0, F.col("w")), peak(1, F.col("root")), peak(2, F.lit(3.0)), peak(3, F.lit(5.0))).alias("value"))
    sections = e.groupBy("song", F.expr("pos div 4").alias("section")).agg(F.min(p * 2).alias("start"))
    sections = sections.select("song", "section", F.when(F.col("section") % 2 == 0, "A").otherwise("B").alias("label"), F.lit(2).alias("bars"), "start", (F.col("start") + 8).alias("end"))
    return C.merge_candidates(sections, chords, frames, SONG).withColumn("likeness", r6("likeness"))


@query(
    EVENTS_SQL
    + """, c AS (SELECT song, pos AS id, pos * 3 + root AS a, pos * 3 + root + 2 + root % 5 AS z FROM ev), k AS (SELECT song, a, z FROM c WHERE id % 9 = 4)
    SELECT song, id FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.song = c.song AND k.a < c.z AND c.a < k.z)"""
)
def free_candidates(spark, sf_dir) -> DataFrame:
    start = F.col("pos") * 3 + F.col("root")
    c = events(spark, sf_dir).select("song", F.col("pos").alias("id"), start.alias("start"), (start + 2 + F.col("root") % 5).alias("end"))
    return C.free_of(c, c.filter("id % 9 = 4").drop("id"), SONG, 8.0).select("song", "id")


@query(
    RECURSIVE
    + """, c AS (SELECT song, pos AS id, pos * 3 + root AS a, pos * 3 + root + 2 + root % 5 AS z FROM ev), o AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY z, a, id) AS k FROM c),
    r(song, k, id, a, z, last, taken) AS (SELECT song, k, id, a, z, z, true FROM o WHERE k = 1
      UNION ALL SELECT o.song, o.k, o.id, o.a, o.z, CASE WHEN o.a >= r.last THEN o.z ELSE r.last END, o.a >= r.last FROM r JOIN o ON o.song = r.song AND o.k = r.k + 1)
    SELECT song, id, a AS start, z AS "end" FROM r WHERE taken"""
)
def disjoint_spans(spark, sf_dir) -> DataFrame:
    start = F.col("pos") * 3 + F.col("root")
    c = events(spark, sf_dir).select("song", F.col("pos").alias("id"), start.alias("start"), (start + 2 + F.col("root") % 5).alias("end"))
    return C.disjoint(c, SONG, "id")


@query(
    EVENTS_SQL
    + """, b AS (SELECT song, pos, pos * 0.5 + w / 500 + CASE WHEN pos % 13 > 9 THEN 0.5 ELSE 0.0 END AS t, CASE WHEN song % 5 = 0 THEN 1.1 ELSE 0.51 END AS p FROM ev),
    g AS (SELECT *, t - lag(t) OVER (PARTITION BY song ORDER BY t) AS gap FROM b),
    i AS (SELECT *, sum(CASE WHEN gap IS NULL THEN 0 ELSE greatest(1, round_even(gap / p, 0)) END) OVER (PARTITION BY song ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM g),
    f AS (SELECT song, max(p) AS p, count(*) AS n, regr_slope(t, i) AS s FROM i GROUP BY 1)
    SELECT song, round(CASE WHEN n >= 8 AND s BETWEEN 0.9 * p AND 1.1 * p THEN s ELSE p END, 6) AS period, coalesce(n >= 8 AND s BETWEEN 0.9 * p AND 1.1 * p, false) AS fitted FROM f"""
)
def fitted_periods(spark, sf_dir) -> DataFrame:
    p = F.col("pos").cast("double")
    b = events(spark, sf_dir).select("song", (p * 0.5 + F.col("w") / 500 + F.when(F.col("pos") % 13 > 9, 0.5).otherwise(0.0)).alias("t"), F.when(F.col("song") % 5 == 0, 1.1).otherwise(0.51).alias("p"))
    return B.fitted_period(b, SONG, "t", "p").withColumn("period", r6("period"))


@query(
    EVENTS_SQL
    + """, n AS (SELECT song, count(*) AS n FROM ev GROUP BY 1), p AS (SELECT song, pos % 16 AS p, avg(w) AS m FROM ev JOIN n USING (song) WHERE n >= 32 AND pos < n // 16 * 16 GROUP BY 1, 2),
    b AS (SELECT song, arg_max(p, (m, -p)) AS p, max(m) / (avg(m) + 1e-9) AS ratio FROM p GROUP BY 1)
    SELECT song, coalesce(round_even(p * 4 / 16, 0)::INTEGER % 4, 0) AS phase, round(coalesce(ratio, 1.0), 6) AS ratio FROM n LEFT JOIN b USING (song)"""
)
def comb_phases(spark, sf_dir) -> DataFrame:
    return B.comb_phase(events(spark, sf_dir), SONG, "pos", "w", 16, 4).withColumn("ratio", r6("ratio"))


@query(
    EVENTS_SQL
    + """, v AS (SELECT song, pos, k, CASE WHEN k = root THEN 1.0 + w / 100 ELSE 0.05 END AS x FROM ev CROSS JOIN (SELECT unnest(range(12)) AS k)),
    c AS (SELECT song, ph, (pos - ph) // 4 AS bar, k, avg(x) AS x FROM v CROSS JOIN (SELECT unnest(range(4)) AS ph) WHERE pos >= ph AND (pos - ph) // 4 < 24 GROUP BY 1, 2, 3, 4 HAVING count(*) = 4),
    s AS (SELECT *, x / sum(x) OVER (PARTITION BY song, ph, bar) AS s FROM c), u AS (SELECT *, s / sqrt(sum(s * s) OVER (PARTITION BY song, ph, bar)) AS u FROM s),
    d AS (SELECT a.song, a.ph, a.bar, max(a.s) AS peak, sum(a.u * b.u) AS d1, sum(a.u * c.u) AS d2, max(a.s) FILTER (a.k = a.song % 12) AS tonic FROM u a LEFT JOIN u b ON b.song = a.song AND b.ph = a.ph AND b.k = a.k AND b.bar = a.bar - 1 LEFT JOIN u c ON c.song = a.song AND c.ph = a.ph AND c.k = a.k AND c.bar = a.bar - 2 GROUP BY 1, 2, 3),
    z AS (SELECT song, ph, count(*) AS n, avg(peak) + coalesce(avg(d2), 0) - coalesce(avg(d1), 0) + 0.5 * coalesce(avg(tonic) FILTER (bar % 2 = 0) - avg(tonic) FILTER (bar % 2 = 1), 0) AS score FROM d GROUP BY 1, 2)
    SELECT e.song, e.ph AS phase, round(CASE WHEN n >= 8 THEN score ELSE -1.0 END, 6) AS score FROM (SELECT DISTINCT song, ph FROM ev CROSS JOIN (SELECT unnest(range(4)) AS ph)) e LEFT JOIN z ON z.song = e.song AND z.ph = e.ph"""
)
def crisp_phases(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    v = F.array(*[F.when(F.col("root") == k, 1.0 + F.col("w") / 100).otherwise(0.05) for k in range(12)])
    return B.crispness(e.select("song", "pos", v.alias("v"), (F.col("song") % 12).cast("int").alias("tonic")), SONG, "pos", "v", tonic="tonic").withColumn("score", r6("score"))


@query()
def robust_lines(spark, sf_dir) -> DataFrame:
    """Lines through events' times in seconds by their places, with a weight in ten as an outlier."""
    p = F.col("pos").cast("double")
    e = events(spark, sf_dir).select("song", p.alias("x"), (0.5 * p + 3 + F.col("w") / 1000 + F.when(F.col("pos") % 10 == 7, 4.0).otherwise(0.0)).alias("y"))
    return B.robust_line(e, SONG, "x", "y").withColumns({"intercept": r6("intercept"), "slope": r6("slope")})
