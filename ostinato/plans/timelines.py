"""Queries over timelines, bars, sections and repeats, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions.qualities import lookup
from ostinato.operators import joins as J
from ostinato.operators import sequences as S
from ostinato.operators import stats as A
from ostinato.operators import structure as X
from ostinato.operators import timelines as L
from ostinato.plans.fixtures import EVENTS_SQL, ORDERS_SQL, events, orders, table
from ostinato.plans.queries import _SCORED, ORDER, SONG, _scored, query, r6

_HOUR = 3600000000.0
#: Hours since the song's first event; views cut a song into intervals, all events into shorter ones.
_TIMES = EVENTS_SQL + """, tm AS (SELECT song, pos, q, root, w, (t - min(t) OVER (PARTITION BY song)) / 3600000000.0 AS h FROM ev),
    al AS (SELECT song, pos, q, root, w, h AS s0, lead(h) OVER (PARTITION BY song ORDER BY pos) AS s1 FROM tm),
    vi AS (SELECT song, pos, root, h AS s0, lead(h) OVER (PARTITION BY song ORDER BY pos) AS s1 FROM tm WHERE q = 'view')"""


def _timed(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.withColumn("h", (F.col("t") - F.min("t").over(S.Window.partitionBy("song"))) / _HOUR)


def _intervals(spark, sf_dir, only: str = "true"):
    d = S.with_next(_timed(spark, sf_dir).filter(only), SONG, ORDER, end="h").filter("end is not null")
    return d.withColumnRenamed("h", "start")


@query(
    EVENTS_SQL
    + """, p AS (SELECT song, pos * 2 AS beat, q, CASE WHEN root < 9 THEN root // 3 END AS root FROM ev), z AS (SELECT song, max(beat) + 3 AS n FROM p GROUP BY 1),
    e AS (SELECT p.*, coalesce(lead(beat) OVER (PARTITION BY song ORDER BY beat), n) AS stop FROM p JOIN z USING (song)), k AS (SELECT * FROM e WHERE root IS NOT NULL),
    f AS (SELECT *, CASE WHEN lag(root) OVER w = root AND lag(stop) OVER w = beat THEN 0 ELSE 1 END AS x FROM k WINDOW w AS (PARTITION BY song ORDER BY beat)),
    r AS (SELECT *, sum(x) OVER (PARTITION BY song ORDER BY beat) AS run FROM f)
    SELECT song, root, min(beat) AS start, max(stop) AS "end" FROM r GROUP BY song, run, root"""
)
def chord_spans(spark, sf_dir):
    d = events(spark, sf_dir).select("song", (F.col("pos") * 2).alias("beat"), F.when(F.col("root") < 9, F.floor(F.col("root") / 3)).alias("root"))
    d = d.withColumn("n", F.max("beat").over(S.Window.partitionBy("song")) + 3)
    return L.spans(d, SONG, "beat", "n", ["root"]).select("song", "root", "start", "end")


_REFINED = (
    _TIMES
    + """, a AS (SELECT song, s0, s1, CAST(root AS VARCHAR) AS v FROM vi WHERE s1 IS NOT NULL), p AS (SELECT song, h AS s0, lead(h) OVER (PARTITION BY song ORDER BY pos) AS s1, CAST(root AS VARCHAR) AS v FROM tm WHERE q = 'purchase'),
    b AS (SELECT * FROM p WHERE s1 IS NOT NULL), d AS (SELECT song, s0 AS x FROM a UNION SELECT song, s1 FROM a UNION SELECT song, s0 FROM b UNION SELECT song, s1 FROM b),
    c AS (SELECT song, x AS s0, lead(x) OVER (PARTITION BY song ORDER BY x) AS s1 FROM d),
    m AS (SELECT c.song, c.s0, c.s1, coalesce(a.v, 'N') AS a, coalesce(b.v, 'N') AS b FROM c LEFT JOIN a ON a.song = c.song AND a.s0 <= c.s0 AND c.s0 < a.s1 LEFT JOIN b ON b.song = c.song AND b.s0 <= c.s0 AND c.s0 < b.s1 WHERE c.s1 IS NOT NULL)"""
)


def _two_timelines(spark, sf_dir):
    side = lambda q: _intervals(spark, sf_dir, f"q = '{q}'").select("song", "start", "end", F.col("root").cast("string").alias("v"))
    return side("view"), side("purchase")


@query(_REFINED + ' SELECT song, round(s0, 5) AS start, round(s1, 5) AS "end", a, b FROM m')
def refined_timelines(spark, sf_dir):
    d = L.refined(*_two_timelines(spark, sf_dir), SONG, "v")
    return d.select("song", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"), "a", "b")


@query(_REFINED + " SELECT a, b, round(sum(s1 - s0), 3) AS seconds, round(sum(s1 - s0) / sum(sum(s1 - s0)) OVER (PARTITION BY a), 6) AS share FROM m GROUP BY 1, 2")
def weighted_confusion(spark, sf_dir):
    d = L.weighted_confusion(*_two_timelines(spark, sf_dir), SONG, "v")
    return d.select("a", "b", F.round("seconds", 3).alias("seconds"), r6("share").alias("share"))


@query(
    EVENTS_SQL
    + """, tp AS (SELECT song, pos * 960 AS tick, 60 + root * 10 AS bpm FROM ev WHERE pos % 8 = 0),
    c AS (SELECT song, tick, bpm, (lead(tick) OVER w - tick) / 960.0 * 60.0 / bpm AS d FROM tp WINDOW w AS (PARTITION BY song ORDER BY tick)),
    m AS (SELECT song, tick, bpm, coalesce(sum(d) OVER (PARTITION BY song ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c)
    SELECT e.song, e.pos, round(s + (e.pos * 960 + 240 - tick) / 960.0 * 60.0 / bpm, 5) AS seconds FROM ev e ASOF JOIN m ON m.song = e.song AND e.pos * 960 + 240 >= m.tick"""
)
def tempo_map(spark, sf_dir):
    e = events(spark, sf_dir)
    tempos = e.filter("pos % 8 = 0").select("song", (F.col("pos") * 960).alias("tick"), (60 + F.col("root") * 10).alias("bpm"))
    d = L.ticks_to_seconds(e.select("song", "pos", (F.col("pos") * 960 + 240).alias("tick")), tempos, SONG, "tick", "bpm")
    return d.select("song", "pos", F.round("seconds", 5).alias("seconds"))


@query(_TIMES + " SELECT a.song, a.pos, v.pos AS label FROM (SELECT * FROM al WHERE s1 IS NOT NULL) a LEFT JOIN vi v ON v.song = a.song AND v.s0 <= (a.s0 + a.s1) / 2 AND (a.s0 + a.s1) / 2 < v.s1")
def midpoint_labels(spark, sf_dir):
    labels = _intervals(spark, sf_dir, "q = 'view'").select("song", "start", "end", F.col("pos").alias("label"))
    return L.at_midpoints(_intervals(spark, sf_dir).select("song", "pos", "start", "end"), labels, SONG, ["label"]).select("song", "pos", "label")


@query(
    _TIMES
    + """, o AS (SELECT v.song, v.pos, a.q AS label, sum(least(a.s1, v.s1) - greatest(a.s0, v.s0)) AS overlap FROM vi v JOIN al a ON a.song = v.song AND a.s0 < v.s1 AND v.s0 < a.s1 WHERE a.q <> 'view' GROUP BY 1, 2, 3)
    SELECT song, pos, label, round(overlap, 5) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY song, pos ORDER BY overlap DESC, label) AS k FROM o) WHERE k = 1"""
)
def longest_overlap(spark, sf_dir):
    a = _intervals(spark, sf_dir, "q = 'view'").select("song", "pos", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = _intervals(spark, sf_dir).filter("q <> 'view'").select("song", F.col("q").alias("label"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return J.overlap_vote(a, b, SONG, ["pos"], "label", 8.0).select("song", "pos", "label", F.round("overlap", 5).alias("overlap"))


@query(
    EVENTS_SQL
    + """, n AS (SELECT song, pos // 4 AS bar, q, count(*) AS n, min(pos) AS seen FROM ev GROUP BY 1, 2, 3)
    SELECT song, bar, q FROM (SELECT *, row_number() OVER (PARTITION BY song, bar ORDER BY n DESC, seen) AS k FROM n) WHERE k = 1"""
)
def bar_modes(spark, sf_dir):
    return L.bar_modes(events(spark, sf_dir), SONG, "pos", "q", 4)


_KINDS = {"click": "maj", "error": "min", "purchase": "dom", "signup": "min", "view": "maj"}


@query(
    EVENTS_SQL
    + """, c AS (SELECT song, pos, root // 2 * 2 % 8 AS degree, CASE q WHEN 'purchase' THEN 'dom' WHEN 'error' THEN 'min' WHEN 'signup' THEN 'min' ELSE 'maj' END AS kind, CAST(floor(w) AS BIGINT) AS d FROM ev),
    l AS (SELECT *, lag(degree) OVER w AS d1, lag(kind) OVER w AS k1, lag(degree, 2) OVER w AS d2, lag(kind, 2) OVER w AS k2 FROM (SELECT song, pos, CASE WHEN degree = 6 THEN 7 ELSE degree END AS degree, kind, d FROM c) WINDOW w AS (PARTITION BY song ORDER BY pos)),
    n AS (SELECT coalesce(d1 = 7 AND k1 = 'dom' AND d2 = 2 AND k2 = 'min', false) AS resolved, least(d, 12) AS d, count(*) AS n FROM l WHERE degree = 0 AND kind IN ('maj', 'min') GROUP BY 1, 2)
    SELECT resolved, d, n, round(n / sum(n) OVER (PARTITION BY resolved), 6) AS share FROM n"""
)
def tonic_durations(spark, sf_dir):
    degree = F.floor(F.col("root") / 2) * 2 % 8
    e = events(spark, sf_dir).withColumns({"degree": F.when(degree == 6, 7).otherwise(degree), "kind": lookup(_KINDS, F.col("q")), "d": F.floor("w")})
    return L.durations_after(e, SONG, ORDER, "degree", "kind", "d").withColumn("share", r6("share"))


_NOTES = ", nt AS (SELECT song, pos + w / 100 - floor(w / 100) AS at_beat, root + 36 AS pitch FROM ev), rt AS (SELECT song, pos AS beat, (root + pos) % 12 AS root FROM ev WHERE q <> 'error')"


def _notes(spark, sf_dir):
    e = events(spark, sf_dir)
    x = F.col("w") / 100
    roots = e.filter("q <> 'error'").select("song", F.col("pos").alias("beat"), F.pmod(F.col("root") + F.col("pos"), F.lit(12)).alias("root"))
    return e.select("song", (F.col("pos") + x - F.floor(x)).alias("at_beat"), (F.col("root") + 36).alias("pitch")), roots


@query(
    EVENTS_SQL
    + _NOTES
    + """, j AS (SELECT CAST(round_even(at_beat, 0) AS BIGINT) AS beat, * FROM nt), k AS (SELECT j.beat % 4 AS phase, (pitch - rt.root) % 12 AS i FROM j JOIN rt ON rt.song = j.song AND rt.beat = j.beat WHERE abs(at_beat - j.beat) <= 0.25)
    SELECT phase, round(avg(CAST(i = 0 AS INTEGER)), 6) AS root, round(avg(CAST(i IN (3, 4) AS INTEGER)), 6) AS third, round(avg(CAST(i = 7 AS INTEGER)), 6) AS fifth, round(avg(CAST(i IN (10, 11) AS INTEGER)), 6) AS seventh,
      round(avg(CAST(i NOT IN (0, 3, 4, 7, 10, 11) AS INTEGER)), 6) AS other, count(*) AS n FROM k GROUP BY 1"""
)
def interval_by_phase(spark, sf_dir):
    d = L.interval_by_phase(*_notes(spark, sf_dir), SONG, "at_beat", "pitch", 4)
    return d.select("phase", "n", *[r6(c).alias(c) for c in ("root", "third", "fifth", "seventh", "other")])


@query(
    EVENTS_SQL
    + _NOTES
    + """, j AS (SELECT song, at_beat, pitch, CAST(floor(at_beat / 2) AS BIGINT) AS bar FROM nt)
    SELECT j.song, round(avg(CAST(pitch % 12 = rt.root AS INTEGER)), 6) AS agreement, count(*) AS n FROM j JOIN rt ON rt.song = j.song AND rt.beat = j.bar WHERE at_beat - bar * 2 < 0.15 GROUP BY 1"""
)
def first_note_agreement(spark, sf_dir):
    notes, roots = _notes(spark, sf_dir)
    d = L.first_note_agreement(notes, roots.withColumnRenamed("beat", "bar"), SONG, "at_beat", "pitch", 2)
    return d.select("song", r6("agreement").alias("agreement"), "n")


@query(
    EVENTS_SQL
    + """, f AS (SELECT song, t FROM ev WHERE q = 'view'), g AS (SELECT song, t FROM ev WHERE q = 'purchase'),
    k AS (SELECT g.song, g.t, min(abs(f.t - g.t)) AS d FROM g LEFT JOIN f ON f.song = g.song GROUP BY 1, 2),
    a AS (SELECT song, count(*) AS t, sum(CASE WHEN d <= 3600000000 THEN 1 ELSE 0 END) AS h FROM k GROUP BY 1), b AS (SELECT song, count(*) AS f FROM f GROUP BY 1),
    x AS (SELECT coalesce(a.song, b.song) AS song, coalesce(h, 0) / (coalesce(f, 0) + 1e-9) AS p, coalesce(h, 0) / (coalesce(t, 0) + 1e-9) AS r FROM a FULL JOIN b ON a.song = b.song)
    SELECT song, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-9), 6) AS f1 FROM x"""
)
def boundary_hits(spark, sf_dir):
    e = events(spark, sf_dir)
    d = L.boundary_hits(e.filter("q = 'view'"), e.filter("q = 'purchase'"), SONG, "t", 3600000000)
    return d.select("song", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query(
    EVENTS_SQL
    + """, p AS (SELECT q AS was, lead(q) OVER (PARTITION BY song ORDER BY pos) AS now, w / 100 AS c, root AS n FROM ev)
    SELECT was, now, count(*) AS n, count_if(c > 0.7) AS sure_but_wrong, count_if(n >= 3) AS wide FROM p WHERE was <> now GROUP BY 1, 2"""
)
def correction_counts(spark, sf_dir):
    d = S.with_next(events(spark, sf_dir), SONG, ORDER, now="q").select(F.col("q").alias("was"), "now", (F.col("w") / 100).alias("c"), "root")
    return L.corrections_by(d, "was", "now", "c", "root")


@query(
    EVENTS_SQL
    + """, m AS (SELECT song, median(w) AS m FROM ev WHERE w > 0 GROUP BY 1), s AS (SELECT song, pos // 3 AS k, avg(w) AS e, min(pos) AS start, max(pos) + 1 AS stop FROM ev GROUP BY 1, 2)
    SELECT song, start, stop AS "end", round(e, 5) AS energy, e < 0.35 * m AS quiet FROM s JOIN m USING (song)"""
)
def quiet_segments(spark, sf_dir):
    e = events(spark, sf_dir)
    d = L.quiet_segments(e, S.on_grid(e, SONG, "pos", 3).drop("segment"), SONG, "pos", "w")
    return d.select("song", "start", "end", F.round("energy", 5).alias("energy"), "quiet")


@query(
    EVENTS_SQL
    + """, b AS (SELECT song, t, row_number() OVER (PARTITION BY song ORDER BY t) - 1 AS k FROM ev WHERE q = 'view'), c AS (SELECT song, t, pos FROM ev WHERE q = 'purchase'),
    n AS (SELECT c.song, k, row_number() OVER (PARTITION BY c.song, pos ORDER BY abs(c.t - b.t), b.t) AS r FROM c JOIN b ON b.song = c.song),
    u AS (SELECT DISTINCT song, k FROM n WHERE r = 1 UNION SELECT song, 0 FROM b), z AS (SELECT song, max(k) + 1 AS z FROM b GROUP BY 1)
    SELECT song, k AS start, coalesce(lead(k) OVER (PARTITION BY song ORDER BY k), z) AS "end" FROM u JOIN z USING (song)"""
)
def snapped_segments(spark, sf_dir):
    e = events(spark, sf_dir)
    return L.snapped_segments(e.filter("q = 'purchase'"), e.filter("q = 'view'"), SONG, "t")


@query(
    EVENTS_SQL
    + """, n AS (SELECT song, pos % 4 AS slot, q, count(*) AS n, min(pos) AS seen FROM ev GROUP BY 1, 2, 3), b AS (SELECT song, slot AS k, q AS label, 4 * (song % 3) + 3 AS target FROM (SELECT *, row_number() OVER (PARTITION BY song, slot ORDER BY n DESC, seen) AS k FROM n) WHERE k = 1),
    x AS (SELECT song, label, target, p.range AS pass, (p.range - 1) * 4 + k AS slot FROM b JOIN range(1, 4) p ON p.range <= ceil(target / 4)) SELECT song, slot, pass, label FROM x WHERE slot < target"""
)
def repeats_laid_out(spark, sf_dir):
    """Each song's commonest loop of four symbols, written out to its own number of bars."""
    loop = X.slot_votes(events(spark, sf_dir), SONG, "pos", "q", 4).withColumnRenamed("slot", "k")
    loop = loop.withColumns({"size": F.lit(4), "target": 4 * (F.col("song") % 3) + 3})
    return L.repeated(loop, SONG, "k", "size", "target").select("song", "slot", "pass", "label")


@query(
    EVENTS_SQL
    + """, s AS (SELECT song, pos, chr(65 + CAST(root // 4 AS INTEGER)) AS label FROM ev), f AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS x FROM s WINDOW w AS (PARTITION BY song ORDER BY pos))
    SELECT song, string_agg(label, '' ORDER BY pos) AS form, count(*) AS runs FROM f WHERE x = 1 GROUP BY 1"""
)
def form_letters(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("label", F.char((65 + F.floor(F.col("root") / 4)).cast("int")))
    return L.letters(d, SONG, ORDER, "label")


@query(
    EVENTS_SQL
    + """, b AS (SELECT song, pos // 8 AS block, pos % 8 AS slot, q FROM ev), n AS (SELECT song, block, count(*) AS n FROM b GROUP BY 1, 2)
    SELECT x.song, x.block, round(count(CASE WHEN y.q = z.q THEN 1 END) / greatest(max(x.n), max(o.n)), 6) AS agreement FROM n x JOIN n o ON o.song = x.song AND o.block = x.block + 1
      LEFT JOIN b y ON y.song = x.song AND y.block = x.block LEFT JOIN b z ON z.song = x.song AND z.block = x.block + 1 AND z.slot = y.slot GROUP BY 1, 2"""
)
def block_agreement(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("song", F.floor(F.col("pos") / 8).alias("block"))
    d = d.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "q"))), lambda x: x["q"]).alias("a"))
    d = S.with_next(d, SONG, ["block"], b="a").filter("b is not null")
    return d.select("song", "block", r6(L.agreement(F.col("a"), F.col("b"))).alias("agreement"))


# Segments, sections and repeats


@query(EVENTS_SQL + 'SELECT song, pos // 4 AS segment, min(pos) AS start, max(pos) + 1 AS "end" FROM ev GROUP BY 1, 2')
def grid_segments(spark, sf_dir):
    return S.on_grid(events(spark, sf_dir), SONG, "pos", 4)


@query(
    EVENTS_SQL
    + """, p AS (SELECT song, pos // 2 AS pair, arg_min(q, pos) AS q FROM ev GROUP BY 1, 2), f AS (SELECT song, pair, q, lead(q) OVER (PARTITION BY song ORDER BY pair) AS n FROM p),
    a AS (SELECT song, coalesce(avg(CASE WHEN q = n THEN 1.0 WHEN n IS NULL THEN NULL ELSE 0.0 END), 0) AS agreement FROM f WHERE pair % 2 = 0 GROUP BY 1)
    SELECT song, round(agreement, 6) AS agreement, CASE WHEN agreement > 0.3 THEN 4 ELSE 2 END AS grid FROM a"""
)
def harmonic_grid(spark, sf_dir):
    return S.harmonic_grid(events(spark, sf_dir), SONG, "pos", "q", 0.3).withColumn("agreement", r6("agreement"))


@query(
    EVENTS_SQL
    + """, i AS (SELECT song, pos AS s0, lead(pos) OVER (PARTITION BY song ORDER BY pos) AS s1 FROM ev WHERE q = 'view'), c AS (SELECT DISTINCT song, pos - 1 AS x FROM ev WHERE q = 'purchase'),
    u AS (SELECT song, s0 AS x, s1 FROM i WHERE s1 IS NOT NULL UNION SELECT i.song, x, s1 FROM i JOIN c ON c.song = i.song AND x > s0 AND x < s1)
    SELECT song, x AS start, coalesce(lead(x) OVER (PARTITION BY song, s1 ORDER BY x), s1) AS "end" FROM u"""
)
def interval_splits(spark, sf_dir):
    e = events(spark, sf_dir)
    i = S.with_next(e.filter("q = 'view'"), SONG, ORDER, end="pos").filter("end is not null").select("song", F.col("pos").alias("start"), "end")
    return S.split_at(i, e.filter("q = 'purchase'").select("song", (F.col("pos") - 1).alias("at")), SONG)


@query(
    EVENTS_SQL
    + """, k AS (SELECT song, lag, avg(x) AS score FROM (SELECT e.song, k.range AS lag, CASE WHEN e.q = f.q THEN 1.0 ELSE 0.0 END AS x FROM ev e CROSS JOIN range(2, 13) k JOIN ev f ON f.song = e.song AND f.pos = e.pos - k.range) WHERE lag IN (2, 3, 4, 6, 8, 12) GROUP BY 1, 2),
    u AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY score DESC, lag) AS r FROM k), s AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.song = a.song AND b.r < a.r AND a.lag % b.lag = 0)),
    n AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY r) - 1 AS rank FROM s) SELECT song, rank, lag, round(score, 6) AS score FROM n WHERE rank < 2"""
)
def top_periods(spark, sf_dir):
    p = X.lag_profile(events(spark, sf_dir), SONG, ORDER, "q", 2, 12)
    return X.best_periods(p, SONG, [2, 3, 4, 6, 8, 12], 2).withColumn("score", r6("score"))


@query(
    EVENTS_SQL
    + """, n AS (SELECT song, pos % 8 AS slot, q, count(*) AS n, min(pos) AS seen FROM ev GROUP BY 1, 2, 3), p AS (SELECT song, slot, q AS label FROM (SELECT *, row_number() OVER (PARTITION BY song, slot ORDER BY n DESC, seen) AS k FROM n) WHERE k = 1),
    d AS (SELECT e.song, e.pos, e.q, label, e.q <> label AS differs, w / 100 AS c FROM ev e JOIN p ON p.song = e.song AND p.slot = e.pos % 8),
    k AS (SELECT *, sum(CASE WHEN differs AND c >= 0.75 THEN 1 ELSE 0 END) OVER (PARTITION BY song) <= 0.35 * count(*) OVER (PARTITION BY song) AS settled FROM d)
    SELECT song, pos, CASE WHEN differs AND c < 0.75 AND settled THEN label ELSE q END AS q, differs AND c < 0.75 AND settled AS snapped FROM k"""
)
def pattern_snap(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("c", F.col("w") / 100)
    pattern = X.slot_votes(e, SONG, "pos", "q", 8).withColumn("period", F.lit(8))
    return X.snap_to_pattern(e, SONG, "pos", "q", "c", pattern).select("song", "pos", "q", "snapped")


_TIED = """, sp AS (SELECT song, pos // 32 AS grp, pos AS s0, pos + 2 + CAST(pos % 16 = 8 AS INTEGER) * (song % 2) AS s1 FROM ev WHERE pos % 8 = 0 AND pos + 3 <= (SELECT max(pos) FROM ev x WHERE x.song = ev.song)),
    mo AS (SELECT song, grp, n FROM (SELECT song, grp, s1 - s0 AS n, row_number() OVER (PARTITION BY song, grp ORDER BY count(*) DESC, s1 - s0 DESC) AS k FROM sp GROUP BY 1, 2, 3) WHERE k = 1)"""


def _tied(spark, sf_dir):
    e = events(spark, sf_dir)
    last = F.max("pos").over(S.Window.partitionBy("song"))
    s = e.withColumn("last", last).filter("pos % 8 = 0 and pos + 3 <= last")
    return e, s.select("song", F.floor(F.col("pos") / 32).alias("group"), F.col("pos").alias("start"), (F.col("pos") + 2 + (F.col("pos") % 16 == 8).cast("int") * (F.col("song") % 2)).alias("end"))


@query(
    EVENTS_SQL
    + _TIED
    + """, r AS (SELECT sp.song, sp.grp, s0 + o.range AS pos, o.range AS o FROM sp JOIN mo USING (song, grp) JOIN range(3) o ON o.range < n WHERE s1 - s0 = n)
    SELECT r.song, r.grp AS "group", r.pos, r.o AS "offset", round(sum(w) OVER (PARTITION BY r.song, r.grp, r.o), 4) AS w FROM r JOIN ev USING (song, pos)"""
)
def tied_evidence(spark, sf_dir):
    e, spans = _tied(spark, sf_dir)
    return X.pooled_evidence(e, spans, SONG, "pos", ["w"])[0].withColumn("w", F.round("w", 4))


@query(EVENTS_SQL + _TIED + ' SELECT sp.song, sp.grp AS "group", s0 AS start, s1 AS "end", s1 - s0 = n AS used FROM sp JOIN mo USING (song, grp)')
def tied_report(spark, sf_dir):
    e, spans = _tied(spark, sf_dir)
    return X.pooled_evidence(e, spans, SONG, "pos", ["w"])[1]


@query(
    EVENTS_SQL
    + """, s AS (SELECT song, pos, root // 6 AS r FROM ev), f AS (SELECT *, CASE WHEN lag(r) OVER w = r THEN 0 ELSE 1 END AS x FROM s WINDOW w AS (PARTITION BY song ORDER BY pos)), g AS (SELECT *, sum(x) OVER (PARTITION BY song ORDER BY pos) AS run FROM f)
    SELECT song, CAST(run AS BIGINT) AS run, r, count(*) AS n_rows, min(pos) AS start, max(pos) + 1 AS "end" FROM g GROUP BY 1, 2, 3"""
)
def root_change_segments(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("r", F.floor(F.col("root") / 6))
    return S.compress(d, SONG, ORDER, ["r"], start=F.min("pos"), end=F.max("pos") + 1)


@query(
    EVENTS_SQL
    + """, s AS (SELECT song, pos, sum(w) OVER b AS sb, sum(w * w) OVER b AS qb, count(*) OVER b AS nb, sum(w) OVER l AS sl, sum(w * w) OVER l AS ql, count(*) OVER l AS nl, sum(w) OVER r AS sr, sum(w * w) OVER r AS qr, count(*) OVER r AS nr
      FROM ev WINDOW b AS (PARTITION BY song ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING), l AS (PARTITION BY song ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY song ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
    SELECT song, pos FROM s WHERE pos % 5 = 0 AND (pos = 0 OR (nl >= 2 AND nr >= 2 AND qb - sb * sb / nb - (ql - sl * sl / nl) - (qr - sr * sr / nr) >= 900))"""
)
def pruned_boundaries(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("edge", F.col("pos") % 5 == 0)
    return S.prune_boundaries(e, SONG, ORDER, ["w"], "edge", 900.0).select("song", "pos")


@query(
    _SCORED
    + """, n AS (SELECT conf AS threshold, sum(quality) AS p, count(*) AS n FROM d GROUP BY 1), c AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER () AS pos, sum(n) OVER () AS total FROM n WINDOW w AS (ORDER BY threshold DESC))
    SELECT round(threshold, 9) AS threshold, round(tp / pos, 6) AS tpr, round((seen - tp) / (total - pos), 6) AS fpr, round(tp / seen, 6) AS precision FROM c"""
)
def roc_curve(spark, sf_dir):
    d = A.roc_points(_scored(spark, sf_dir), "conf", "quality")
    return d.select(F.round("threshold", 9).alias("threshold"), r6("tpr").alias("tpr"), r6("fpr").alias("fpr"), r6("precision").alias("precision"))


@query(
    ORDERS_SQL
    + """, s AS (SELECT song, count(*) AS n, avg(price) AS score FROM ord GROUP BY 1) SELECT song, n, round(score, 3) AS score FROM s ORDER BY score, song LIMIT 5"""
)
def hardest_five(spark, sf_dir):
    """The report's five sequences of the lowest mean score."""
    d = orders(spark, sf_dir).groupBy("song").agg(F.count("*").alias("n"), F.avg("price").alias("score"))
    return d.orderBy("score", "song").limit(5).withColumn("score", F.round("score", 3))


@query("SELECT n_name, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def dimension_join(spark, sf_dir):
    """A look-up in a table of 25 rows, which the planner may broadcast by its known size."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


@query(
    EVENTS_SQL
    + """, p AS (SELECT a.song, a.pos AS i, b.pos AS j, CASE WHEN a.q = b.q THEN 1.0 ELSE 0.0 END AS s FROM ev a JOIN ev b ON a.song = b.song AND b.pos > a.pos),
    d AS (SELECT song, j - i AS lag, avg(s) OVER (PARTITION BY song, j - i ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM p)
    SELECT song, lag, round(max(s), 6) AS s FROM d GROUP BY 1, 2"""
)
def diagonal_similarity(spark, sf_dir):
    return X.repeated_passages(events(spark, sf_dir), SONG, "pos", "q").withColumn("s", r6("s"))


@query(
    EVENTS_SQL
    + """, b AS (SELECT song, CAST(floor((pos + 0.5 - 3) / 4) AS BIGINT) AS bar, avg(w) AS a, avg(root) AS b FROM ev GROUP BY 1, 2)
    SELECT song, bar, round(a / (a + b), 6) AS a, round(b / (a + b), 6) AS b FROM b WHERE bar >= 0 AND a + b > 1e-9"""
)
def bar_distributions(spark, sf_dir):
    e = events(spark, sf_dir).select("song", (F.col("pos") + 0.5).cast("double").alias("mid"), F.col("w").alias("a"), F.col("root").cast("double").alias("b"))
    return L.bar_distributions(e, SONG, "mid", ["a", "b"], 4.0, 3.0).select("song", "bar", r6("a").alias("a"), r6("b").alias("b"))


@query(
    EVENTS_SQL
    + """, d AS (SELECT song, pos // 16 AS section, pos % 16 AS k, w FROM ev), g AS (SELECT song, section, g, k % g AS p, sum(w) AS s, count(*) AS n FROM d CROSS JOIN unnest([4, 2]) u(g) WHERE k > 0 GROUP BY 1, 2, 3, 4),
    t AS (SELECT *, s / n AS on_, coalesce((sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0), 0) AS off, sum(n) OVER w AS total FROM g WINDOW w AS (PARTITION BY song, section, g)),
    b AS (SELECT *, row_number() OVER (PARTITION BY song, section, g ORDER BY on_ - off DESC, p) AS r FROM t WHERE total >= g + 1),
    f AS (SELECT song, section, max(g) AS period FROM b WHERE r = 1 AND off <= 0.6 * on_ + 1e-9 GROUP BY 1, 2)
    SELECT song, section, coalesce(period, 1) AS period FROM (SELECT DISTINCT song, section FROM d) LEFT JOIN f USING (song, section)"""
)
def grid_periods(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"section": F.floor(F.col("pos") / 16), "k": F.col("pos") % 16})
    return L.grid_period(e, ["song", "section"], "k", "w")


@query(EVENTS_SQL + "SELECT (root + range) % 12 AS root, range AS by, q, count(*) AS n FROM ev CROSS JOIN range(12) GROUP BY 1, 2, 3")
def transposed_counts(spark, sf_dir):
    return L.transposed_copies(events(spark, sf_dir), "root").groupBy("root", "by", "q").agg(F.count("*").alias("n"))


@query(EVENTS_SQL + "SELECT song, pos % 16 AS slot, count(DISTINCT q) AS values, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(DISTINCT q) > 1")
def slot_inconsistencies(spark, sf_dir):
    return L.inconsistent(events(spark, sf_dir).withColumn("slot", F.col("pos") % 16), ["song", "slot"], "q")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def orders_not_done(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.not_done(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])
