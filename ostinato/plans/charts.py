"""Queries of chart folding over orders as bars and line items as sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import charts as C
from ostinato.operators.sequences import ordered
from ostinato.plans.fixtures import EVENTS_SQL, ORDERS_SQL, events, orders, table
from ostinato.plans.queries import SONG, query

BARS_SQL = (
    ORDERS_SQL
    + """, bar AS (SELECT song, i, CASE WHEN i < song % 3 THEN 'Intro' ELSE 'A' END AS label, CASE WHEN i % 4 = 3 THEN CASE WHEN price > 150000 THEN 'hi' ELSE 'lo' END ELSE status END AS c
      FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY t, id) - 1 AS i FROM ord)),
    run AS (SELECT *, (song % 3)::BIGINT AS run, i - song % 3 AS k, count(*) OVER (PARTITION BY song) AS m FROM bar WHERE label = 'A'),
    blocks AS (SELECT song, run, m, p, k // p AS block, min(i) AS start, list(c ORDER BY k) AS l FROM run CROSS JOIN (SELECT unnest([2, 4, 8]) AS p) WHERE 2 * p <= m AND k < m // p * p GROUP BY 1, 2, 3, 4, 5),
    hits AS (SELECT a.song, a.run, a.m, a.p, a.block, a.l, count(*) AS hits FROM blocks a JOIN blocks b USING (song, p) WHERE len(list_filter(range(1, a.p + 1), lambda x: a.l[x] = b.l[x])) / a.p >= 0.7 GROUP BY ALL),
    best AS (SELECT *, m // p AS reps FROM hits QUALIFY row_number() OVER (PARTITION BY song, p ORDER BY hits DESC, block) = 1),
    loops AS (SELECT * FROM best WHERE hits / reps >= 0.6 QUALIFY row_number() OVER (PARTITION BY song ORDER BY hits / reps DESC, p) = 1),
    passes AS (SELECT b.song, b.run, b.block AS pass, b.start, b.l FROM blocks b JOIN loops o USING (song, p))
"""
)


def _bars(spark, sf_dir) -> DataFrame:
    o = orders(spark, sf_dir).withColumn("i", (F.row_number().over(ordered(SONG, ["t", "id"])) - 1).cast("long"))
    label = F.when(F.col("i") < F.col("song") % 3, "Intro").otherwise("A")
    content = F.when(F.col("i") % 4 == 3, F.when(F.col("price") > 150000, "hi").otherwise("lo")).otherwise(F.col("status"))
    return o.select("song", "i", label.alias("label"), content.alias("c"))


@query(BARS_SQL + "SELECT song, run, m, p AS period, reps, hits, array_to_string(l, ' ') AS bars FROM loops")
def bar_loops(spark, sf_dir) -> DataFrame:
    loops, _ = C.bar_loops(_bars(spark, sf_dir), SONG, "i", "label", "c")
    return loops.withColumn("bars", F.array_join("bars", " "))


@query(
    BARS_SQL
    + """, b AS (SELECT p.*, f.l AS base, len(p.l) AS n FROM passes p JOIN passes f ON f.song = p.song AND f.pass = 0),
    s AS (SELECT song, min(len(list_filter(range(1, n), lambda x: l[x] = base[x])) / (n - 1)) AS s1, count(DISTINCT l[n:n]) AS n1, min(CASE WHEN n > 2 THEN len(list_filter(range(1, n - 1), lambda x: l[x] = base[x])) / (n - 2) END) AS s2, count(DISTINCT l[n - 1:n]) AS n2 FROM b GROUP BY 1),
    t AS (SELECT song, CASE WHEN s1 >= 0.7 AND n1 >= 2 THEN 1 WHEN s2 >= 0.7 AND n2 >= 2 THEN 2 END AS tail FROM s),
    v AS (SELECT song, x, row_number() OVER (PARTITION BY song ORDER BY min(pass)) - 1 AS variant FROM (SELECT b.song, pass, l[n - tail + 1:n] AS x FROM b JOIN t USING (song) WHERE tail IS NOT NULL) GROUP BY 1, 2)
    SELECT b.song, b.run, b.pass, b.start, t.tail, v.variant FROM b JOIN t USING (song) LEFT JOIN v ON v.song = b.song AND v.x = b.l[b.n - t.tail + 1:b.n]"""
)
def loop_endings(spark, sf_dir) -> DataFrame:
    _, passes = C.bar_loops(_bars(spark, sf_dir), SONG, "i", "label", "c")
    return C.endings(passes, ["song", "run"]).drop("bars")


@query(
    BARS_SQL
    + """, sb AS (SELECT song, i // 2 AS section, i % 2 AS o, c FROM bar),
    sec AS (SELECT song, section, count(*) AS n, chr((65 + section % 2)::INTEGER) AS label, count(*) OVER (PARTITION BY song) AS m FROM sb GROUP BY 1, 2),
    p AS (SELECT song, m, unnest(list_filter(range(2, m // 2 + 1), lambda x: m % x = 0)) AS p FROM (SELECT DISTINCT song, m FROM sec WHERE m >= 4)),
    q AS (SELECT p.song, p.p, s.section, s.label = b.label AND s.n = b.n AS alike, (SELECT avg(CASE WHEN x.c = y.c THEN 1.0 ELSE 0.0 END) FROM sb x JOIN sb y ON x.song = y.song AND x.o = y.o WHERE x.song = s.song AND x.section = s.section AND y.section = b.section) AS same
      FROM p JOIN sec s USING (song) JOIN sec b ON b.song = s.song AND b.section = s.section % p.p),
    g AS (SELECT song, min(p) AS p FROM (SELECT song, p FROM q GROUP BY 1, 2 HAVING bool_and(alike) AND min(same) >= 0.85) GROUP BY 1)
    SELECT s.song, s.section, 0 AS run, g.p AS period, s.section % g.p AS slot, s.section // g.p AS round FROM sec s JOIN g USING (song)"""
)
def section_groups(spark, sf_dir) -> DataFrame:
    bars = _bars(spark, sf_dir).select("song", F.expr("i div 2").alias("section"), (F.col("i") % 2).alias("offset"), F.col("c").alias("content"))
    names = F.when(F.col("section") % 2 == 0, "A").otherwise("B")
    sections = bars.select("song", "section").distinct().select("song", "section", names.alias("label"), F.lit(1).alias("reps"))
    return C.section_groups(sections, bars, SONG)


@query(
    EVENTS_SQL.replace("WITH ev", "WITH RECURSIVE ev", 1)
    + """, sec AS (SELECT song, pos // 4 AS section, CAST(sum(DISTINCT 1 << root) AS INTEGER) AS mask FROM ev GROUP BY 1, 2),
    r(song, section, known, letter) AS (SELECT song, section, [mask], 0::BIGINT FROM sec WHERE section = 0
      UNION ALL SELECT song, section, CASE WHEN hit > 0 THEN list_transform(known, lambda m, i: CASE WHEN i = hit THEN m | mask ELSE m END) ELSE list_append(known, mask) END, CASE WHEN hit > 0 THEN hit - 1 ELSE len(known) END
      FROM (SELECT s.song, s.section, s.mask, r.known, coalesce(list_position(list_transform(r.known, lambda m: (m | s.mask) = 0 OR bit_count(m & s.mask) / bit_count(m | s.mask) >= 0.5), true), 0) AS hit FROM r JOIN sec s ON s.song = r.song AND s.section = r.section + 1))
    SELECT song, section, letter FROM r"""
)
def content_letters(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).groupBy("song", F.expr("pos div 4").alias("section")).agg(F.collect_set("root").alias("_r"))
    e = e.withColumn("mask", F.aggregate("_r", F.lit(0), lambda a, x: a.bitwiseOR(F.element_at(F.array(*[F.lit(1 << i) for i in range(12)]), x + 1))))
    return C.content_letters(e.select("song", "section", F.lit("A").alias("label"), "mask"), SONG)


@query(
    EVENTS_SQL
    + """, s AS (SELECT song, pos, upper(q[1]) AS label, 1 + pos % 2 AS reps, CASE WHEN pos % 11 = 5 THEN 1 END AS tail FROM ev),
    n AS (SELECT *, CASE WHEN label = lag(label) OVER w AND tail IS NULL AND lag(tail) OVER w IS NULL AND pos > 0 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY song ORDER BY pos)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY song ORDER BY pos) AS g FROM n)
    SELECT song, (g - 1)::BIGINT AS section, any_value(label) AS label, CASE WHEN count(*) = 1 THEN min(reps) ELSE 1 END AS reps, min(pos) AS start, max(pos) AS "end", max(tail) AS tail FROM g GROUP BY song, g"""
)
def coalesced_sections(spark, sf_dir) -> DataFrame:
    s = events(spark, sf_dir).select("song", F.col("pos").alias("section"), F.upper(F.substring("q", 1, 1)).alias("label"), (1 + F.col("pos") % 2).alias("reps"), F.col("pos").alias("start"), F.col("pos").alias("end"), F.when(F.col("pos") % 11 == 5, 1).alias("tail"))
    return C.coalesced(s, SONG)


@query(
    """WITH s AS (SELECT l_orderkey AS song, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS section, l_returnflag AS label, 1 + (l_linenumber = 1 AND l_suppkey % 2 = 0)::INTEGER AS reps, 8 + l_partkey % 3 - 1 AS len FROM lineitem),
    f AS (SELECT *, sum(len) OVER (PARTITION BY song ORDER BY section) AS stop, count(*) OVER (PARTITION BY song) AS n, row_number() OVER (PARTITION BY song ORDER BY section) AS k FROM s),
    p AS (SELECT song, any_value(n) AS n, max(label) FILTER (k = 1) AS la, max(label) FILTER (k = 2) AS lb, max(label) FILTER (k = 3) AS lc, max(reps) FILTER (k = 1) AS ra, max(reps) FILTER (k = 2) AS rb, max(reps) FILTER (k = 3) AS rc,
      max(len) FILTER (k = 1) AS a, max(len) FILTER (k = 2) AS b, max(len) FILTER (k = 3) AS c, max(stop) FILTER (k = 2) - 1 AS last FROM f GROUP BY 1),
    x AS (SELECT *, n = 3 AND la = lc AND la <> lb AND rc = 1 AS shaped FROM p), y AS (SELECT *, shaped AND rb = 1 AND b <> c AND b + c = 2 * a AND abs(b - a) <= 2 AS moved FROM x)
    SELECT song, CASE WHEN n = 1 AND a = 12 THEN '12-bar blues' WHEN n = 1 AND ra >= 2 AND a IN (4, 8, 16, 24, 32) THEN a || '-bar loop'
      WHEN (moved OR (shaped AND b = a AND c = a)) AND a = 8 THEN 'AABA (32-bar song form)' WHEN moved OR (shaped AND b = a AND c = a) THEN 'AABA-shaped form (' || a || '-bar sections)' END AS form,
      CASE WHEN moved THEN (last - (b - a))::BIGINT END AS boundary FROM y"""
)
def form_names(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("song"), (F.row_number().over(ordered(["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"])) - 1).cast("long").alias("section"), F.col("l_returnflag").alias("label"), (1 + ((F.col("l_linenumber") == 1) & (F.col("l_suppkey") % 2 == 0)).cast("int")).alias("reps"), (7 + F.col("l_partkey") % 3).cast("long").alias("len"))
    stop = F.sum("len").over(ordered(SONG, ["section"]))
    return C.form_names(rows.withColumns({"start": stop - F.col("len"), "end": stop - 1}), SONG)


@query(
    EVENTS_SQL
    + """, b AS (SELECT song, pos AS i, CASE WHEN song % 3 = 1 AND pos % 5 < 3 THEN upper(q[1]) ELSE q END AS label, CASE WHEN pos % 7 <> 2 THEN t / 1e6 END AS t FROM ev),
    c AS (SELECT song, upper(q[1]) AS label, t / 1e6 + 0.25 AS t FROM ev WHERE song % 3 = 0 AND pos % 6 = 1),
    last AS (SELECT song, max(i) AS last FROM b GROUP BY 1),
    p AS (SELECT c.song, c.label, c.t, (SELECT min(i) FROM b WHERE b.song = c.song AND b.t >= c.t - 1e-6) AS start FROM c),
    p1 AS (SELECT song, start, label FROM p WHERE start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY song, start ORDER BY t) = 1),
    p2 AS (SELECT song, label, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE start END AS start, lead(start) OVER w - 1 AS stop FROM p1 WINDOW w AS (PARTITION BY song ORDER BY start)),
    chip AS (SELECT song, label, start, coalesce(stop, last) AS stop FROM p2 JOIN last USING (song)),
    bl AS (SELECT song, i, CASE WHEN len(label) <= 2 THEN label ELSE 'A' END AS label FROM b WHERE song NOT IN (SELECT song FROM chip) AND song IN (SELECT song FROM b WHERE len(label) <= 2)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY song ORDER BY i) AS g FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY song ORDER BY i) THEN 0 ELSE 1 END AS new FROM bl)),
    u AS (SELECT * FROM chip UNION ALL SELECT song, any_value(label), min(i), max(i) FROM g GROUP BY song, g UNION ALL SELECT song, 'A', 0, last FROM last WHERE song NOT IN (SELECT song FROM chip UNION SELECT song FROM bl))
    SELECT song, row_number() OVER (PARTITION BY song ORDER BY start) - 1 AS section, label, start, stop AS "end" FROM u"""
)
def section_runs(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    letter = F.upper(F.substring("q", 1, 1))
    bars = e.select("song", F.col("pos").alias("i"), F.when((F.col("song") % 3 == 1) & (F.col("pos") % 5 < 3), letter).otherwise(F.col("q")).alias("label"), F.when(F.col("pos") % 7 != 2, F.col("t") / 1e6).alias("t"))
    chips = e.filter("song % 3 = 0 and pos % 6 = 1").select("song", letter.alias("label"), (F.col("t") / 1e6 + 0.25).alias("t"))
    return C.section_runs(bars, chips, SONG, "i", "label", "t")
