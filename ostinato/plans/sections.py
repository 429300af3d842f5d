"""Queries over sections, cells and motifs; those that fold over whole sequences have no SQL and are tested on their own."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ostinato.functions import tokens as T
from ostinato.operators import folds, keys, motifs, sections
from ostinato.operators import sequences as S
from ostinato.plans.fixtures import CHORDS_SQL, EVENTS_SQL, chords, events, table
from ostinato.plans.queries import ORDER, SONG, query, r6

_ROWS = """WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS e FROM embeddings)"""


def _rows(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.withColumn("i", (F.row_number().over(S.ordered(["label"], ["vec_id"])) - 1).cast("long"))


#: The rows that turn twelve classes to a tonal centroid: fifths, minor thirds and (by half) major thirds, sine and cosine.
CENTROID = [[r * f(w * math.pi * k) for k in range(12)] for r, w in ((1.0, 7 / 6), (1.0, 3 / 2), (0.5, 2 / 3)) for f in (math.sin, math.cos)]


@query(
    _ROWS
    + """, n AS (SELECT label, count(*) AS n FROM v GROUP BY 1), p AS (SELECT a.label, a.i, b.i AS j, greatest(0, least(1, list_cosine_similarity(a.e, b.e))) AS s FROM v a JOIN v b ON a.label = b.label AND b.i BETWEEN a.i - 15 AND a.i + 15),
    t AS (SELECT label, i AS t FROM v JOIN n USING (label) WHERE i >= 8 AND i < n - 8),
    r AS (SELECT t.label, t.t, sum(CASE WHEN (i < t) = (j < t) THEN s ELSE -s END * exp(-((i - t) * (i - t) + (j - t) * (j - t)) / 32.0)) AS r FROM t JOIN p ON p.label = t.label AND i BETWEEN t - 8 AND t + 7 AND j BETWEEN t - 8 AND t + 7 GROUP BY 1, 2),
    k AS (SELECT range AS d, exp(-range * range / 8.0) / (SELECT sum(exp(-range * range / 8.0)) FROM range(-8, 9)) AS w FROM range(-8, 9)),
    x AS (SELECT v.label, v.i, coalesce(sum(w * r), 0) AS x FROM v CROSS JOIN k LEFT JOIN r ON r.label = v.label AND r.t = v.i + d GROUP BY 1, 2),
    m AS (SELECT *, min(x) OVER (PARTITION BY label) AS lo, max(x) OVER (PARTITION BY label) AS hi FROM x)
    SELECT label, i, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE x END, 4) AS novelty FROM m"""
)
def novelty_curve(spark, sf_dir):
    return sections.novelty(_rows(spark, sf_dir), ["label"], "i", "embedding").withColumn("novelty", F.round("novelty", 4))


@query(
    _ROWS
    + """, s AS (SELECT label, f AS bars, avg(s) AS score FROM (SELECT a.label, u.f, greatest(0, least(1, list_cosine_similarity(a.e, b.e))) AS s FROM v a CROSS JOIN unnest([2, 3, 4, 6]) u(f) JOIN v b ON b.label = a.label AND b.i = a.i - 4 * u.f) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score >= 0.1 DESC, CASE WHEN score >= 0.1 THEN bars END, score DESC, bars) AS k FROM s)
    SELECT label, bars, round(score, 6) AS score FROM r WHERE k = 1"""
)
def base_periods(spark, sf_dir):
    d = sections.base_period(_rows(spark, sf_dir), ["label"], "i", "embedding", 4, (2, 3, 4, 6), 0.1)
    return d.withColumn("score", r6("score"))


@query()
def song_sections(spark, sf_dir):
    """Sections of each song by its chords' tones, with letters."""
    d = keys.parsed(chords(spark, sf_dir)).withColumn("v", T.chord_weights(F.col("root"), F.col("quality")))
    spans = sections.sections(d, SONG, "pos", "v", 2, (4, 8, 16))
    return spans.join(sections.section_labels(d, spans, SONG, "pos", "v"), [*SONG, "section"])


@query(
    CHORDS_SQL.replace("WITH ev", "WITH RECURSIVE ev", 1)
    + f""", x AS (SELECT song, pos, k, coalesce(sum(y) FILTER (pc = k), 0.0) AS y FROM (SELECT song, pos, (root + unnest(tones)) % 12 AS pc, unnest(weights) AS y FROM ch) CROSS JOIN (SELECT unnest(range(12)) AS k) GROUP BY 1, 2, 3),
    c1 AS (SELECT song, pos // 2 AS cell, k, min(pos) AS a, max(pos) + 1 AS z, sum(y) AS y FROM x GROUP BY 1, 2, 3), c AS (SELECT song, cell, any_value(a) AS a, any_value(z) AS z, list(y ORDER BY k) AS p FROM c1 GROUP BY 1, 2),
    r(song, cell, a, p) AS (SELECT song, cell, a, p FROM c WHERE cell = 0
      UNION ALL SELECT song, cell, CASE WHEN list_sum(list_transform(d, lambda y: y * y)) <= 0.16 THEN a0 ELSE a END, CASE WHEN list_sum(list_transform(d, lambda y: y * y)) <= 0.16 THEN list_transform(range(1, 13), lambda k: p0[k] + p[k]) ELSE p END
      FROM (SELECT c.song, c.cell, c.a, c.p, r.a AS a0, r.p AS p0,
          list_transform({CENTROID}, lambda m: list_sum(list_transform(range(1, 13), lambda k: m[k] * (coalesce(r.p[k] / nullif(list_sum(r.p), 0), 0) - coalesce(c.p[k] / nullif(list_sum(c.p), 0), 0))))) AS d
        FROM r JOIN c ON c.song = r.song AND c.cell = r.cell + 1))
    SELECT r.song, r.a AS start, max(c.z) AS "end" FROM r JOIN c USING (song, cell) GROUP BY 1, 2"""
)
def merged_cells(spark, sf_dir):
    """Cells of two chords merged while their tones stay near."""
    d = keys.parsed(chords(spark, sf_dir)).withColumn("c", T.chord_weights(F.col("root"), F.col("quality")))
    total = F.array(*[F.sum(F.element_at("c", i + 1)) for i in range(12)])
    cells = d.groupBy("song", F.floor(F.col("pos") / 2).alias("cell")).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), total.alias("p"))
    return folds.merge_cells(cells, SONG, folds.centroids_within("p", 0.4), ["p"])


@query()
def motif_tiles(spark, sf_dir):
    """Every song laid out in its most sparing motifs."""
    e = events(spark, sf_dir).withColumn("bar", F.floor(F.col("pos") / 2))
    return motifs.tiled(e, SONG, ORDER, "bar", "q")


@query(
    EVENTS_SQL
    + """, c AS (SELECT song, pos, pos * 0.4 AS s, pos * 0.4 + 0.4 AS e, w / 100 AS c, count(*) OVER (PARTITION BY song) AS n FROM ev),
    d AS (SELECT *, NOT (e < 1.2 AND c < 0.7 AND pos < n - 1 AND s + 0.4 <= 4) AS strong FROM c), f AS (SELECT *, bool_or(strong) OVER (PARTITION BY song ORDER BY pos) AS stays FROM d)
    SELECT song, pos, CASE WHEN row_number() OVER (PARTITION BY song ORDER BY pos) = 1 THEN 0 ELSE round(s, 4) END AS start FROM f WHERE stays"""
)
def clean_starts(spark, sf_dir):
    e = events(spark, sf_dir)
    d = e.select("song", "pos", (F.col("pos") * 0.4).cast("double").alias("start"), (F.col("pos") * 0.4 + 0.4).cast("double").alias("end"), (F.col("w") / 100).alias("confidence"), F.lit(1.0).alias("period"))
    return folds.without_spurious_start(d, SONG, "period", 0.7).select("song", "pos", F.round("start", 4).alias("start"))


@query(
    EVENTS_SQL.replace("WITH ev", "WITH RECURSIVE ev", 1)
    + """, m AS (SELECT song, t AS tm, CASE q WHEN 'view' THEN 1 ELSE 0 END AS side, t + CASE q WHEN 'view' THEN 3600000000 ELSE 0 END AS seen FROM ev WHERE q IN ('view', 'purchase')),
    o AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY seen, side, tm) AS k FROM m),
    r(song, k, free, hits) AS (SELECT DISTINCT song, 0::BIGINT, []::BIGINT[], 0 FROM o
      UNION ALL SELECT song, k, CASE WHEN side = 0 THEN list_append(free, tm) WHEN hit THEN list_slice(live, 2, len(live)) ELSE live END, hits + (side = 1 AND hit)::INTEGER
      FROM (SELECT o.song, o.k, o.side, o.tm, r.free, r.hits, list_filter(r.free, lambda x: x >= o.tm - 3600000000) AS live, coalesce(list_filter(r.free, lambda x: x >= o.tm - 3600000000)[1] <= o.tm + 3600000000, false) AS hit FROM r JOIN o ON o.song = r.song AND o.k = r.k + 1)),
    h AS (SELECT song, max(hits)::BIGINT AS hits FROM r GROUP BY 1), n AS (SELECT song, count(*) FILTER (side = 1) AS n_found, count(*) FILTER (side = 0) AS n_true FROM o GROUP BY 1),
    p AS (SELECT *, CASE WHEN n_found > 0 THEN hits / n_found ELSE 0.0 END AS precision, CASE WHEN n_true > 0 THEN hits / n_true ELSE 0.0 END AS recall FROM n JOIN h USING (song))
    SELECT song, n_found, n_true, hits, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM p"""
)
def one_to_one_boundaries(spark, sf_dir):
    """Views against purchases, each purchase met once within an hour."""
    e = events(spark, sf_dir)
    return folds.one_to_one_scores(e.filter("q = 'view'"), e.filter("q = 'purchase'"), SONG, "t", 3600000000)
