"""Queries of scale membership, evaluation labels and charts written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.functions import scales
from ostinato.functions import vocabulary as V
from ostinato.functions.qualities import lookup
from ostinato.operators import export
from ostinato.operators.sequences import ordered
from ostinato.operators.timelines import split_by_fast_runs
from ostinato.plans.fixtures import EVENTS_SQL, events
from ostinato.plans.queries import query


@query(
    EVENTS_SQL
    + """, k AS (SELECT song, pos, (root - song % 12 + 12) % 12 AS i, song % 2 = 1 AS minor, CASE WHEN pos % 11 = 5 THEN 'sus' WHEN pos % 11 = 7 THEN 'aug' WHEN pos % 11 = 9 THEN 'other'
      WHEN q = 'error' THEN 'dim' WHEN q = 'signup' THEN 'min' ELSE 'maj' END AS t FROM ev),
    m AS (SELECT *, [0, 2, 4, 5, 7, 9, 11] AS s, ['maj', 'min', 'min', 'maj', 'maj', 'min', 'dim'] AS x, CASE WHEN minor THEN 3 ELSE 0 END AS own FROM k)
    SELECT song, pos, t AS triad, CASE WHEN t = 'sus' THEN 'sus' WHEN x[list_position(s, (i - own + 12) % 12)] = t THEN 'diatonic_own' WHEN x[list_position(s, (i - 3 + own + 12) % 12)] = t THEN 'parallel_borrow'
      WHEN i || t IN ('0min', '2dim', '3aug', '5min', '7maj', '8maj', '11dim') THEN 'harmonic_minor_borrow' ELSE 'chromatic' END AS member FROM m"""
)
def scale_members(spark, sf_dir) -> DataFrame:
    tones = {"click": [0, 4, 7, 11], "error": [0, 3, 6, 10], "purchase": [0, 4, 7, 10], "signup": [0, 3, 7, 10], "view": [0, 4, 7]}
    odd = {5: [0, 5, 7, 10], 7: [0, 4, 8], 9: [0, 4, 6]}
    as_arrays = lambda t: {k: F.array(*map(F.lit, v)) for k, v in t.items()}
    e = events(spark, sf_dir)
    at = (F.col("pos") % 11).cast("int")
    chord = F.coalesce(*[F.when(at == k, v) for k, v in as_arrays(odd).items()], *[F.when(F.col("q") == k, v) for k, v in as_arrays(tones).items()])
    d = e.select("song", "pos", "root", scales.triad(chord).alias("triad"))
    return d.select("song", "pos", "triad", scales.membership(F.col("root") - F.col("song") % 12, F.col("triad"), F.col("song") % 2 == 1).alias("member"))


@query(
    EVENTS_SQL
    + """, n AS (SELECT *, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][root + 1] AS r FROM ev)
    SELECT song, pos, CASE pos % 7 WHEN 2 THEN 'N' WHEN 3 THEN 'H7:maj' WHEN 4 THEN r || ':maj' WHEN 5 THEN r || ':maj'
      ELSE r || ':' || CASE q WHEN 'click' THEN 'minmaj7' WHEN 'error' THEN 'hdim7' WHEN 'purchase' THEN '7' WHEN 'signup' THEN 'sus4' ELSE 'maj9' END END AS label FROM n"""
)
def evaluation_labels(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    root = F.get(F.array(*map(F.lit, V.NOTES)), F.col("root"))
    quality = lookup({"click": "mMaj7", "error": "ø7", "purchase": "7#9", "signup": "9sus4", "view": "maj9#11"}, F.col("q"))
    odd = {2: F.lit("N"), 3: F.lit("H7"), 4: root, 5: F.concat(root, F.lit("weird"))}
    label = F.coalesce(*[F.when(F.col("pos") % 7 == k, v) for k, v in odd.items()], F.concat(root, quality))
    return e.select("song", "pos", V.evaluation_label(label).alias("label"))


@query(
    EVENTS_SQL
    + """, b AS (SELECT song, pos // 4 AS bar, pos, CASE WHEN pos // 4 % 7 = 3 THEN CASE WHEN pos % 4 = 0 THEN 'n' END WHEN pos // 4 % 5 <> 4
        THEN ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][root + 1] || CASE q WHEN 'click' THEN '^7' WHEN 'error' THEN 'h7' ELSE '' END END AS name FROM ev),
    t AS (SELECT song, bar // 8 AS section, bar, coalesce(string_agg(name, ' ' ORDER BY pos), 'x') AS token FROM b GROUP BY ALL),
    m AS (SELECT song, section, bar, CASE WHEN bar % 8 = 0 THEN '*' || ['A', 'B', 'C'][section % 3 + 1] ELSE '' END || token AS token FROM t)
    SELECT song, section, CAST(rep AS INTEGER) AS rep, bar, token FROM m, unnest(range(1, 2 + section % 2)) AS r(rep)"""
)
def played_bars(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).withColumn("bar", F.expr("pos div 4")).withColumn("section", F.expr("bar div 8"))
    none, held = F.col("bar") % 7 == 3, F.col("bar") % 5 == 4
    q = F.when(none, F.when(F.col("pos") % 4 == 0, "N")).when(held, F.lit(None)).otherwise(F.coalesce(lookup({"click": "^7", "error": "h7"}, F.col("q")), F.lit("")))
    label = F.get(F.array(F.lit("A1"), F.lit("B"), F.lit("C")), (F.col("section") % 3).cast("int"))
    reps = (1 + F.col("section") % 2).cast("int")
    root = F.when(~none & ~held, F.col("root"))
    chords = e.select("song", "section", label.alias("letter"), reps.alias("reps"), "bar", F.col("pos").alias("beat"), root.alias("root"), q.alias("q"))
    return export.played_bars(chords, "song").select("song", "section", "rep", "bar", "token")


@query(
    EVENTS_SQL
    + """, l AS (SELECT song, pos, t AS t0, lead(t) OVER (PARTITION BY song ORDER BY pos) AS t1, CASE q WHEN 'error' THEN 'X' ELSE root || q END AS label FROM ev QUALIFY t1 IS NOT NULL),
    c AS (SELECT song, t0, coalesce(lead(t0) OVER (PARTITION BY song ORDER BY pos), t1) AS t1, CASE WHEN pos % 10 = 0 THEN 'N' ELSE label END AS label FROM l WHERE pos % 2 = 0),
    s AS (SELECT *, sum(CASE WHEN t1 - t0 < 55000000000 THEN 0 ELSE 1 END) OVER (PARTITION BY song ORDER BY pos) AS g FROM l),
    f AS (SELECT *, count(*) OVER (PARTITION BY song, g) AS n FROM s WHERE t1 - t0 < 55000000000),
    r AS (SELECT song, g, min(t0) AS lo, max(t1) AS hi FROM f WHERE n >= 4 GROUP BY 1, 2),
    j AS (SELECT *, label <> 'N' AND EXISTS (FROM r WHERE r.song = c.song AND c.t0 + c.t1 BETWEEN 2 * lo AND 2 * hi) AS goes FROM c)
    SELECT song, t0, t1, label, false AS added FROM j WHERE NOT goes
    UNION ALL SELECT song, t0, t1, label, true FROM f WHERE n >= 4 AND label <> 'X' AND t1 - t0 >= 28000000000 AND song IN (SELECT song FROM j WHERE goes)"""
)
def split_bars(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    w = ordered(["song"], ["pos"])
    spans = e.select("song", "pos", F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), F.when(F.col("q") == "error", "X").otherwise(F.concat(F.col("root").cast("string"), "q")).alias("label")).where("t1 IS NOT NULL")
    even = spans.where("pos % 2 = 0")
    chords = even.select("song", "t0", F.coalesce(F.lead("t0").over(w), "t1").alias("t1"), F.when(F.col("pos") % 10 == 0, "N").otherwise(F.col("label")).alias("label"))
    return split_by_fast_runs(chords, spans.select("song", "t0", "t1", "label"), 2e10)
