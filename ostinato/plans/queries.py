"""Queries over the driver's tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions import vectors as V
from ostinato.operators import decode as D
from ostinato.operators import joins as J
from ostinato.operators import motifs as M
from ostinato.operators import sequences as S
from ostinato.operators import stats as A
from ostinato.operators import structure as X
from ostinato.plans.fixtures import EVENTS_SQL, ORDERS_SQL, events, orders, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SONG, ORDER = ["song"], ["pos"]
STRETCH = 3 * 86_400_000_000.0  # microseconds of a song that one task sorts in temporal joins


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Transition statistics


@query(EVENTS_SQL + "SELECT s0, s1, count(*) AS n FROM (SELECT q AS s0, lead(q) OVER (PARTITION BY song ORDER BY pos) AS s1 FROM ev) WHERE s1 IS NOT NULL GROUP BY 1, 2")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ngram_counts(events(spark, sf_dir), SONG, ORDER, "q", 2)


@query(
    EVENTS_SQL
    + """, n AS (SELECT s0, s1, count(*) AS n FROM (SELECT q AS s0, lead(q) OVER (PARTITION BY song ORDER BY pos) AS s1 FROM ev) WHERE s0 <> s1 GROUP BY 1, 2),
    st AS (SELECT DISTINCT event_type AS state FROM events),
    g AS (SELECT a.state AS s0, b.state AS s1, coalesce(n, 0) AS n FROM st a CROSS JOIN st b LEFT JOIN n ON n.s0 = a.state AND n.s1 = b.state)
    SELECT s0, s1, n, round(ln((n + 0.2) / sum(n + 0.2) OVER (PARTITION BY s0)), 6) AS logp FROM g"""
)
def bigram_logprob(spark, sf_dir):
    return A.transition_model(events(spark, sf_dir), SONG, ORDER, "q").withColumn("logp", r6("logp"))


@query(
    EVENTS_SQL
    + """, c AS (SELECT s0, s1, count(*) AS n FROM (SELECT q AS s0, lead(q) OVER w AS s1, lead(q, 2) OVER w AS s2 FROM ev WINDOW w AS (PARTITION BY song ORDER BY pos)) WHERE s2 IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT n, row_number() OVER (ORDER BY n DESC, s0, s1) AS k FROM c)
    SELECT count(*) AS contexts, median(n) AS median_n, avg(CASE WHEN n >= 20 THEN 1.0 ELSE 0.0 END) AS share_seen, sum(CASE WHEN k <= 50 THEN n END) / sum(n) AS top50_mass FROM r"""
)
def trigram_context(spark, sf_dir):
    return A.context_sparsity(events(spark, sf_dir), SONG, ORDER, "q")


@query(
    EVENTS_SQL
    + """, g AS (SELECT root, s0, s1, count(*) AS n FROM (SELECT root, q AS s0, lead(q) OVER (PARTITION BY song ORDER BY pos) AS s1 FROM ev) WHERE s1 IS NOT NULL GROUP BY 1, 2, 3),
    l AS (SELECT root, s0, s1, n, (n / sum(n) OVER (PARTITION BY root)) / (sum(n) OVER (PARTITION BY s0, s1) / sum(n) OVER ()) AS lift FROM g)
    SELECT root, s0, s1, n, round(lift, 6) AS lift, row_number() OVER (PARTITION BY root ORDER BY lift DESC, s0, s1) AS rank FROM l"""
)
def transition_lift(spark, sf_dir):
    return A.bigram_lift(events(spark, sf_dir), SONG, ORDER, "q", "root").select("root", "s0", "s1", "n", r6("lift").alias("lift"), "rank")


@query(
    EVENTS_SQL
    + """, d AS (SELECT (lead(t) OVER (PARTITION BY song ORDER BY pos) - t) / 3600000000.0 AS h FROM ev),
    b AS (SELECT greatest(1, least(32, CAST(round_even(h, 0) AS INTEGER))) AS d FROM d WHERE h IS NOT NULL),
    n AS (SELECT d, count(*) AS n FROM b GROUP BY 1)
    SELECT CAST(range AS INTEGER) AS d, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM n), 6) AS p FROM range(1, 33) LEFT JOIN n ON n.d = range"""
)
def duration_pmf(spark, sf_dir):
    d = S.durations(events(spark, sf_dir), SONG, ORDER, "t").withColumn("h", F.col("duration") / 3600000000.0)
    return A.clipped_pmf(d, "h", 32).withColumn("p", r6("p"))


@query(
    EVENTS_SQL
    + """, c AS (SELECT song, pos % 4 AS phase, q, lag(q) OVER (PARTITION BY song ORDER BY pos) AS p FROM ev),
    s AS (SELECT song, phase, avg(CASE WHEN q <> p THEN 1.0 ELSE 0.0 END) AS x FROM c WHERE p IS NOT NULL GROUP BY 1, 2)
    SELECT phase, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, count(*) AS sequences FROM s GROUP BY 1"""
)
def change_by_phase(spark, sf_dir):
    d = A.change_by_phase(events(spark, sf_dir), SONG, ORDER, "q", "pos", 4)
    return d.select("phase", r6("mean").alias("mean"), r6("deviation").alias("deviation"), "sequences")


@query(EVENTS_SQL + "SELECT q AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM ev GROUP BY 1")
def value_distribution(spark, sf_dir):
    return A.distribution(events(spark, sf_dir), "q")


@query(
    EVENTS_SQL
    + """, g AS (SELECT (lead(root) OVER w - root + 12) % 12 AS i1, (lead(root, 2) OVER w - lead(root) OVER w + 12) % 12 AS i2 FROM ev WINDOW w AS (PARTITION BY song ORDER BY pos)),
    n AS (SELECT i1, i2, count(*) AS n FROM g WHERE i2 IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT n / sum(n) OVER () AS p FROM n)
    SELECT round(-sum(p * log2(p)), 6) AS bits FROM p"""
)
def interval_trigram_entropy(spark, sf_dir):
    g = A.ngrams(events(spark, sf_dir), SONG, ORDER, "root", 3)
    g = g.select(*[F.pmod(F.col(f"s{i + 1}") - F.col(f"s{i}"), F.lit(12)).alias(f"i{i}") for i in range(2)])
    return A.entropy_bits(g, ["i0", "i1"]).select(r6("bits").alias("bits"))


@query(
    EVENTS_SQL
    + """, g AS (SELECT song, q AS s0, lead(q) OVER (PARTITION BY song ORDER BY pos) AS s1 FROM ev),
    n AS (SELECT s0, s1, count(*) AS n FROM g WHERE s1 IS NOT NULL AND song % 5 <> 0 GROUP BY 1, 2),
    k AS (SELECT s0, s1, row_number() OVER (PARTITION BY s0 ORDER BY n DESC, s1) AS r FROM n)
    SELECT count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS topk
    FROM g LEFT JOIN k USING (s0, s1) WHERE s1 IS NOT NULL AND song % 5 = 0"""
)
def split_eval_topk(spark, sf_dir):
    d = A.next_symbol_accuracy(events(spark, sf_dir), SONG, ORDER, "q", "song")
    return d.select("n", r6("top1").alias("top1"), r6("topk").alias("topk"))


@query(
    EVENTS_SQL
    + """, g AS (SELECT song, root AS s0, lead(root) OVER (PARTITION BY song ORDER BY pos) AS s1 FROM ev),
    n AS (SELECT song, least(s0, s1) AS a, greatest(s0, s1) AS b, count(*) AS n FROM g WHERE s0 <> s1 GROUP BY 1, 2, 3),
    t AS (SELECT song, a AS ta, b AS tb, n AS tn FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY n DESC, a, b) AS k FROM n) WHERE k = 1)
    SELECT song, ta AS a, tb AS b, tn AS n, coalesce(max(CASE WHEN a NOT IN (ta, tb) AND b NOT IN (ta, tb) THEN n END), 0) AS runner_up, CAST(sum(n) AS BIGINT) AS changes
    FROM n JOIN t USING (song) GROUP BY 1, 2, 3, 4"""
)
def reciprocal_pair(spark, sf_dir):
    return A.reciprocal_pair(events(spark, sf_dir), SONG, ORDER, "root")


# Runs, fills and windows


@query(
    ORDERS_SQL
    + """, f AS (SELECT *, CASE WHEN lag(status) OVER w = status THEN 0 ELSE 1 END AS x FROM ord WINDOW w AS (PARTITION BY song ORDER BY t, id)),
    r AS (SELECT *, sum(x) OVER (PARTITION BY song ORDER BY t, id) AS run FROM f)
    SELECT song, CAST(run AS BIGINT) AS run, status, count(*) AS n_rows, min(t) AS start, max(t) AS last, round(avg(price), 4) AS price FROM r GROUP BY 1, 2, 3"""
)
def runs_compress(spark, sf_dir):
    out = S.compress(orders(spark, sf_dir), SONG, ["t", "id"], ["status"], start=F.min("t"), last=F.max("t"), price=F.round(F.avg("price"), 4))
    return out.select("song", F.col("run").cast("long").alias("run"), "status", "n_rows", "start", "last", "price")


@query(
    EVENTS_SQL
    + """, f AS (SELECT *, CASE WHEN lag(q) OVER w = q THEN 0 ELSE 1 END AS x, lead(t) OVER w - t AS d FROM ev WINDOW w AS (PARTITION BY song ORDER BY pos)),
    r AS (SELECT *, sum(x) OVER (PARTITION BY song ORDER BY pos) AS run FROM f)
    SELECT song, CAST(run AS BIGINT) AS run, q, count(*) AS n_rows, round(sum(w * d) / sum(d), 4) AS confidence FROM r GROUP BY 1, 2, 3"""
)
def island_conf(spark, sf_dir):
    d = S.durations(events(spark, sf_dir), SONG, ORDER, "t")
    out = S.compress(d, SONG, ORDER, ["q"], confidence=F.round(S.duration_weighted(F.when(F.col("duration").isNotNull(), F.col("w")), F.col("duration")), 4))
    return out.select("song", F.col("run").cast("long").alias("run"), "q", "n_rows", "confidence")


@query(EVENTS_SQL + "SELECT song, pos, last_value(CASE WHEN q = 'purchase' THEN w END IGNORE NULLS) OVER (PARTITION BY song ORDER BY pos) AS held FROM ev")
def forward_fill(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("x", F.when(F.col("q") == "purchase", F.col("w")))
    return S.fill_forward(d, SONG, ORDER, "x", "held").select("song", "pos", "held")


@query(
    EVENTS_SQL
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY pos) AS k FROM ev),
    f AS (SELECT song, pos, q, lag(q) OVER (PARTITION BY song ORDER BY pos) AS previous_key FROM a WHERE k = 1 OR w >= 60)
    SELECT song, pos, previous_key, q FROM f WHERE previous_key <> q"""
)
def modulation_points(spark, sf_dir):
    return S.modulations(events(spark, sf_dir), SONG, ORDER, "q", "w", 60).select("song", "pos", "previous_key", "q")


@query(EVENTS_SQL + "SELECT song, CAST(coalesce(sum(CASE WHEN q <> p THEN 1 WHEN p IS NULL THEN NULL ELSE 0 END), 0) AS BIGINT) AS changes FROM (SELECT song, q, lag(q) OVER (PARTITION BY song ORDER BY pos) AS p FROM ev) GROUP BY 1")
def collection_churn(spark, sf_dir):
    return S.churn(events(spark, sf_dir), SONG, ORDER, "q")


@query(
    EVENTS_SQL
    + """, s AS (SELECT song, pos, sum(w) OVER b AS sb, sum(w * w) OVER b AS qb, count(*) OVER b AS nb, sum(w) OVER l AS sl, sum(w * w) OVER l AS ql, count(*) OVER l AS nl,
         sum(w) OVER r AS sr, sum(w * w) OVER r AS qr, count(*) OVER r AS nr
      FROM ev WINDOW b AS (PARTITION BY song ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING), l AS (PARTITION BY song ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
         r AS (PARTITION BY song ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
    SELECT song, pos, CASE WHEN nl >= 2 AND nr >= 2 THEN round(qb - sb * sb / nb - (ql - sl * sl / nl) - (qr - sr * sr / nr), 3) ELSE 0 END AS evidence FROM s"""
)
def changepoint_evidence(spark, sf_dir):
    return S.changepoint_score(events(spark, sf_dir), SONG, ORDER, ["w"]).select("song", "pos", F.round("evidence", 3).alias("evidence"))


@query(
    EVENTS_SQL
    + """, b AS (SELECT song, pos, coalesce(sum(CAST(floor(w) AS BIGINT)) OVER (PARTITION BY song ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM ev)
    SELECT song, pos, CAST(floor(x / 4) AS BIGINT) AS bar, CAST(x % 4 AS BIGINT) AS beat FROM b"""
)
def cumulative_bars(spark, sf_dir):
    d = S.bars_and_beats(events(spark, sf_dir).withColumn("d", F.floor("w")), SONG, ORDER, "d", 4)
    return d.select("song", "pos", "bar", F.col("beat").cast("long").alias("beat"))


# Temporal joins


@query(
    EVENTS_SQL
    + """, c AS (SELECT song, t, pos FROM ev WHERE q = 'click')
    SELECT a.song, a.pos, c.pos AS click FROM (SELECT * FROM ev WHERE q <> 'click') a ASOF LEFT JOIN c ON a.song = c.song AND a.t >= c.t"""
)
def asof_last_click(spark, sf_dir):
    e = events(spark, sf_dir)
    clicks = e.filter("q = 'click'").select("song", "t", F.col("pos").alias("click"))
    return J.as_of(e.filter("q <> 'click'"), clicks, SONG, "t", ["click"], span=STRETCH).select("song", "pos", "click")


@query(
    EVENTS_SQL
    + """, c AS (SELECT song, t AS ct, pos AS click FROM ev WHERE q = 'click'), a AS (SELECT song, pos, t FROM ev WHERE q <> 'click'),
    m AS (SELECT a.song, a.pos, click, row_number() OVER (PARTITION BY a.song, a.pos ORDER BY abs(a.t - ct), ct) AS k FROM a LEFT JOIN c ON a.song = c.song)
    SELECT song, pos, click FROM m WHERE k = 1"""
)
def nearest_click(spark, sf_dir):
    e = events(spark, sf_dir)
    clicks = e.filter("q = 'click'").select("song", "t", F.col("pos").alias("click"))
    return J.nearest(e.filter("q <> 'click'"), clicks, SONG, "t", ["click"], STRETCH).select("song", "pos", "click")


_SPANS = """, s AS (SELECT song, pos, q, t AS s0, lead(t) OVER (PARTITION BY song ORDER BY pos) AS s1 FROM ev),
    a AS (SELECT * FROM s WHERE q = 'view' AND s1 IS NOT NULL),
    b AS (SELECT song, pos, t - 7200000000 AS s0, t + 7200000000 AS s1 FROM ev WHERE q = 'purchase')"""


def _spans(spark, sf_dir):
    e = events(spark, sf_dir)
    d = S.with_next(e, SONG, ORDER, end="t").filter("end is not null and q = 'view'")
    a = d.select("song", F.col("pos").alias("a_pos"), F.col("t").alias("a_start"), F.col("end").alias("a_end"))
    b = e.filter("q = 'purchase'").select("song", F.col("pos").alias("b_pos"), (F.col("t") - 7200000000).alias("b_start"), (F.col("t") + 7200000000).alias("b_end"))
    return a, b


@query(EVENTS_SQL + _SPANS + "SELECT a.song, a.pos AS a_pos, b.pos AS b_pos, least(a.s1, b.s1) - greatest(a.s0, b.s0) AS overlap FROM a JOIN b ON a.song = b.song AND a.s0 < b.s1 AND b.s0 < a.s1")
def overlap_weight(spark, sf_dir):
    a, b = _spans(spark, sf_dir)
    return J.overlapping(a, b, SONG, 14400000000.0).select("song", "a_pos", "b_pos", "overlap")


@query(
    EVENTS_SQL
    + _SPANS
    + """, p AS (SELECT song, pos, t FROM ev WHERE q = 'error')
    SELECT p.song, p.pos, b.pos AS b_pos FROM p JOIN b ON p.song = b.song AND b.s0 <= p.t AND p.t < b.s1"""
)
def points_in_intervals(spark, sf_dir):
    _, b = _spans(spark, sf_dir)
    points = events(spark, sf_dir).filter("q = 'error'").select("song", "pos", "t")
    held = J.containing(points, b.withColumnsRenamed({"b_start": "start", "b_end": "end"}), SONG, "t", 14400000000.0)
    return held.select("song", "pos", "b_pos")


@query(
    EVENTS_SQL
    + """, g AS (SELECT song, pos AS cell, t AS s0, lead(t) OVER (PARTITION BY song ORDER BY pos) AS s1 FROM ev WHERE q = 'view'),
    c AS (SELECT * FROM g WHERE s1 IS NOT NULL),
    m AS (SELECT c.song, c.s0, avg(floor(e.w)) AS x, count(e.w) AS n FROM c LEFT JOIN (SELECT * FROM ev WHERE q <> 'view') e ON e.song = c.song AND e.t >= c.s0 AND e.t < c.s1 GROUP BY 1, 2),
    f AS (SELECT m.song, m.s0, floor(e.w) AS w, row_number() OVER (PARTITION BY m.song, m.s0 ORDER BY abs(e.t - m.s0), e.t) AS k FROM m JOIN (SELECT * FROM ev WHERE q <> 'view') e ON e.song = m.song)
    SELECT m.song, m.s0 AS start, round(coalesce(m.x, f.w), 4) AS w, m.n AS n_frames FROM m LEFT JOIN f ON f.song = m.song AND f.s0 = m.s0 AND f.k = 1"""
)
def pool_to_grid(spark, sf_dir):
    e = events(spark, sf_dir)
    grid = S.with_next(e.filter("q = 'view'"), SONG, ORDER, end="t").filter("end is not null").select("song", F.col("t").alias("start"), "end")
    out = J.pooled(e.filter("q <> 'view'").select("song", "t", F.floor("w").cast("double").alias("w")), grid, SONG, "t", "w", span=STRETCH)
    return out.select("song", "start", F.round("w", 4).alias("w"), "n_frames")


@query(
    EVENTS_SQL
    + """, f AS (SELECT song, t FROM ev WHERE q = 'view'), g AS (SELECT song, t FROM ev WHERE q = 'purchase'),
    h AS (SELECT f.song, f.t, min(abs(f.t - g.t)) AS d FROM f LEFT JOIN g ON f.song = g.song GROUP BY 1, 2),
    k AS (SELECT g.song, g.t, min(abs(f.t - g.t)) AS d FROM g LEFT JOIN f ON f.song = g.song GROUP BY 1, 2),
    p AS (SELECT song, count(*) AS n, sum(CASE WHEN d <= 3600000000 THEN 1 ELSE 0 END) AS x FROM h GROUP BY 1),
    r AS (SELECT song, count(*) AS n, sum(CASE WHEN d <= 3600000000 THEN 1 ELSE 0 END) AS x FROM k GROUP BY 1),
    b AS (SELECT coalesce(p.song, r.song) AS song, coalesce(p.x / p.n, 0.0) AS precision, coalesce(r.x / r.n, 0.0) AS recall FROM p FULL JOIN r ON p.song = r.song)
    SELECT song, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1 FROM b"""
)
def boundary_f1(spark, sf_dir):
    e = events(spark, sf_dir)
    out = J.boundary_scores(e.filter("q = 'view'"), e.filter("q = 'purchase'"), SONG, "t", 3600000000, STRETCH)
    return out.select("song", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query(
    """WITH c AS (SELECT o_orderkey, max(o_totalprice) AS p FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, coalesce(p, l_extendedprice) AS price, p IS NOT NULL AS changed FROM lineitem LEFT JOIN c ON l_orderkey = o_orderkey"""
)
def corrections_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1"))
    c = o.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.max("o_totalprice").alias("price"))
    base = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_extendedprice").alias("price"))
    return J.override(base, c, ["l_orderkey"], ["price"])


# Periods, folds and sections


_LAGS = """, l AS (SELECT e.song, k.range AS lag, CASE WHEN e.q = f.q THEN 1.0 ELSE 0.0 END AS x FROM ev e CROSS JOIN range(2, 17) k JOIN ev f ON f.song = e.song AND f.pos = e.pos - k.range),
    p AS (SELECT song, CAST(lag AS INTEGER) AS lag, avg(x) AS score, count(*) AS n FROM l GROUP BY 1, 2)"""


@query(EVENTS_SQL + _LAGS + "SELECT song, lag, round(score, 6) AS score, n FROM p")
def lag_profile(spark, sf_dir):
    return X.lag_profile(events(spark, sf_dir), SONG, ORDER, "q", 2, 16).select("song", "lag", r6("score").alias("score"), "n")


@query(EVENTS_SQL + _LAGS + "SELECT song, min(lag) AS period, round(arg_min(score, lag), 6) AS score FROM p WHERE score >= 0.3 AND n >= lag GROUP BY 1")
def period_pick(spark, sf_dir):
    return X.loop_period(events(spark, sf_dir), SONG, ORDER, "q", 2, 16, 0.3).withColumn("score", r6("score"))


@query(EVENTS_SQL + "SELECT song, pos % 8 AS phase, round(avg(w), 6) AS w, count(*) AS n FROM ev GROUP BY 1, 2")
def fold_average(spark, sf_dir):
    return X.fold_average(events(spark, sf_dir), SONG, "pos", 8, ["w"]).withColumn("w", r6("w"))


@query(
    EVENTS_SQL
    + """, n AS (SELECT song, pos % 8 AS slot, q, count(*) AS n, min(pos) AS seen FROM ev GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY song, slot ORDER BY n DESC, seen) AS k, sum(n) OVER (PARTITION BY song, slot) AS total FROM n)
    SELECT song, slot, q AS label, round(n / total, 6) AS confidence FROM r WHERE k = 1"""
)
def slot_vote(spark, sf_dir):
    return X.slot_votes(events(spark, sf_dir), SONG, "pos", "q", 8).withColumn("confidence", r6("confidence"))


@query(
    EVENTS_SQL
    + """, a AS (SELECT song, pos, q, k.range AS lag FROM ev CROSS JOIN range(2, 9) k),
    n AS (SELECT song, lag, pos % lag AS p, q, count(*) AS n FROM a GROUP BY 1, 2, 3, 4),
    m AS (SELECT song, lag, p, max(n) AS top, sum(n) AS n FROM n GROUP BY 1, 2, 3),
    d AS (SELECT song, lag, avg(top / n) AS determinism, sum(top) / sum(n) AS coverage FROM m GROUP BY 1, 2),
    l AS (SELECT e.song, k.range AS lag, avg(CASE WHEN e.q = f.q THEN 1.0 ELSE 0.0 END) AS score, count(*) AS n FROM ev e CROSS JOIN range(2, 9) k JOIN ev f ON f.song = e.song AND f.pos = e.pos - k.range GROUP BY 1, 2),
    r AS (SELECT song, lag, determinism, coverage, row_number() OVER (PARTITION BY song ORDER BY determinism - 0.03 * lag DESC, lag) AS k FROM d JOIN l USING (song, lag) WHERE l.n >= 2 AND l.score >= 0.2 AND coverage >= 0.2)
    SELECT song, CAST(lag AS INTEGER) AS lag, round(determinism, 6) AS determinism, round(coverage, 6) AS coverage FROM r WHERE k = 1"""
)
def loop_pattern(spark, sf_dir):
    d = X.loop_pattern(events(spark, sf_dir), SONG, ORDER, "pos", "q", 8, 0.2, 0.2)
    return d.select("song", "lag", r6("determinism").alias("determinism"), r6("coverage").alias("coverage"))


@query(
    """WITH v AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding AS e FROM embeddings),
    p AS (SELECT a.label, a.i, b.i AS j, list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[]) / (sqrt(list_dot_product(a.e::DOUBLE[], a.e::DOUBLE[])) * sqrt(list_dot_product(b.e::DOUBLE[], b.e::DOUBLE[]))) AS s
      FROM v a JOIN v b ON a.label = b.label AND b.i <> a.i)
    SELECT label, i, round(max(greatest(0.0, least(1.0, s))), 4) AS similarity, round(avg(greatest(0.0, least(1.0, s))), 4) AS mean FROM p GROUP BY 1, 2"""
)
def ssm_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    v = v.withColumn("i", (F.row_number().over(S.ordered(["label"], ["vec_id"])) - 1).cast("long"))
    return X.closest(v, ["label"], "i", "embedding").withColumns({c: F.round(c, 4) for c in ("similarity", "mean")})


@query(
    """WITH v AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding AS e FROM embeddings),
    p AS (SELECT a.label, b.i - a.i AS lag, list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[]) / (sqrt(list_dot_product(a.e::DOUBLE[], a.e::DOUBLE[])) * sqrt(list_dot_product(b.e::DOUBLE[], b.e::DOUBLE[]))) AS s
      FROM v a JOIN v b ON a.label = b.label AND b.i > a.i)
    SELECT label, lag, round(avg(greatest(0.0, least(1.0, s))), 4) AS score, count(*) AS n FROM p GROUP BY 1, 2"""
)
def ssm_lag_score(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    v = v.withColumn("i", (F.row_number().over(S.ordered(["label"], ["vec_id"])) - 1).cast("long"))
    return X.lag_similarity(v, ["label"], "i", "embedding").withColumn("score", F.round("score", 4))


@query(
    EVENTS_SQL
    + """, n AS (SELECT song, pos // 16 AS a, root, count(*) AS n FROM ev GROUP BY 1, 2, 3),
    s AS (SELECT song, a, root, n, sum(n) OVER (PARTITION BY song, a) AS total FROM n),
    b AS (SELECT DISTINCT song, a AS b FROM n)
    SELECT s.song, s.a, b.b, s.root AS symbol FROM s JOIN b ON s.song = b.song AND s.a <> b.b
    WHERE s.n >= 2 AND s.n / s.total >= 0.2 AND NOT EXISTS (SELECT 1 FROM n x WHERE x.song = s.song AND x.a = b.b AND x.root = s.root)"""
)
def veto_pairs(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("block", F.floor(F.col("pos") / 16))
    return X.vetoed_pairs(e, SONG, "block", "root", reach=None)


@query(
    EVENTS_SQL
    + """, n AS (SELECT song, pos // 16 AS a, root, count(*) AS n FROM ev GROUP BY 1, 2, 3),
    s AS (SELECT song, root, count(*) AS vetoes FROM (SELECT *, sum(n) OVER (PARTITION BY song, a) AS total FROM n) WHERE n >= 2 AND n / total >= 0.2 GROUP BY 1, 2),
    b AS (SELECT DISTINCT song, a AS b FROM n),
    x AS (SELECT s.song, s.root, s.vetoes, b.b, b.b - row_number() OVER (PARTITION BY s.song, s.root ORDER BY b.b) AS g FROM s JOIN b USING (song) WHERE NOT EXISTS (SELECT 1 FROM n y WHERE y.song = s.song AND y.a = b.b AND y.root = s.root))
    SELECT song, root AS symbol, min(b) AS first, max(b) AS last, any_value(vetoes) AS vetoes FROM x GROUP BY song, root, g"""
)
def veto_stretches(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("block", F.floor(F.col("pos") / 16))
    return X.vetoed_runs(e, SONG, "block", "root")


@query(
    EVENTS_SQL
    + """, n AS (SELECT song, pos // 16 AS a, root, count(*) AS n FROM ev GROUP BY 1, 2, 3),
    s AS (SELECT song, a, root, n, n / sum(n) OVER (PARTITION BY song, a) AS share FROM n),
    b AS (SELECT DISTINCT song, a AS b FROM n)
    SELECT s.song, s.a, s.root AS symbol, s.n, round(s.share, 6) AS share, count(b.b) AS absent_from
    FROM s LEFT JOIN b ON b.song = s.song AND NOT EXISTS (SELECT 1 FROM n x WHERE x.song = s.song AND x.a = b.b AND x.root = s.root)
    WHERE s.n >= 2 AND s.share >= 0.2 GROUP BY 1, 2, 3, 4, 5"""
)
def veto_counts(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("block", F.floor(F.col("pos") / 16))
    return X.vetoes(e, SONG, "block", "root").withColumn("share", r6("share"))


@query(
    EVENTS_SQL
    + """, n AS (SELECT song, q, count(*) AS n FROM ev GROUP BY 1, 2),
    g AS (SELECT song, CAST(sum(n) AS BIGINT) AS sections, count(*) AS labels, max(n) AS top FROM n GROUP BY 1)
    SELECT song, sections, labels, top, sections >= 2 AND (labels <= 1 OR sections >= 18 OR (sections >= 4 AND top / sections >= 0.85)) AS degenerate FROM g"""
)
def degenerate_sections(spark, sf_dir):
    return X.degenerate_sections(events(spark, sf_dir), SONG, "q")


@query(
    EVENTS_SQL
    + """, b AS (SELECT song, pos // 16 AS block, q, count(*) AS n, min(pos) AS seen FROM ev GROUP BY 1, 2, 3),
    l AS (SELECT song, q, row_number() OVER (PARTITION BY song, block ORDER BY n DESC, seen) AS k FROM b),
    n AS (SELECT song, q, count(*) AS n FROM l WHERE k = 1 GROUP BY 1, 2),
    g AS (SELECT song, CAST(sum(n) AS BIGINT) AS sections, count(*) AS labels, max(n) AS top FROM n GROUP BY 1)
    SELECT song, sections, labels, top, sections >= 2 AND (labels <= 1 OR sections >= 18 OR (sections >= 4 AND top / sections >= 0.85)) AS degenerate FROM g"""
)
def degenerate_block_sections(spark, sf_dir):
    return X.degenerate_sections(X.block_labels(events(spark, sf_dir), SONG, "pos", "q", 16), SONG, "label")


@query(
    EVENTS_SQL
    + """, f AS (SELECT song, min(CASE WHEN q = 'signup' THEN pos END) AS p FROM ev GROUP BY 1)
    SELECT song, coalesce(p % 16, 0) AS phase FROM f"""
)
def loop_phase(spark, sf_dir):
    return X.phase_of_loop(events(spark, sf_dir).withColumn("down", F.col("q") == "signup"), SONG, "pos", "down", 16)


@query(
    EVENTS_SQL
    + """, d AS (SELECT song, lead(pos) OVER (PARTITION BY song ORDER BY pos) - pos AS n FROM ev WHERE q = 'view'),
    c AS (SELECT song, n, count(*) AS c FROM d WHERE n > 0 GROUP BY 1, 2)
    SELECT song, n AS beats_per_bar FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY c DESC, n) AS k FROM c) WHERE k = 1"""
)
def metre_mode(spark, sf_dir):
    return X.metre(events(spark, sf_dir).withColumn("down", F.col("q") == "view"), SONG, "pos", "down")


# Agreement and calibration


_SCORED = """WITH d AS (SELECT l.quality, l.toxic, CASE WHEN n_chars % 7 < 4 THEN 1 ELSE 0 END AS guess, (n_chars % 1000) / 999.0 AS conf FROM labels l JOIN documents USING (doc_id))
"""


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("quality", "toxic", (F.col("n_chars") % 7 < 4).cast("int").alias("guess"), (F.col("n_chars") % 1000 / 999.0).alias("conf"))


@query(_SCORED + "SELECT quality, guess, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM d GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return A.confusion(_scored(spark, sf_dir), "quality", "guess").withColumn("share", r6("share"))


@query(_SCORED + "SELECT quality, guess, count(*) AS n, CAST(grouping(quality, guess) AS BIGINT) AS level FROM d GROUP BY ROLLUP (quality, guess)")
def rollup_confusion(spark, sf_dir):
    return A.confusion_rollup(_scored(spark, sf_dir), "quality", "guess")


@query(_SCORED + "SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg(CASE WHEN quality = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM d GROUP BY 1")
def ece_bins(spark, sf_dir):
    d = A.reliability(_scored(spark, sf_dir).withColumn("ok", F.col("quality") == F.col("guess")), "conf", "ok")
    return d.select("bin", "n", r6("confidence").alias("confidence"), r6("accuracy").alias("accuracy"))


@query(
    _SCORED
    + """, b AS (SELECT least(floor(conf * 10), 9) AS b, count(*) AS n, avg(conf) AS c, avg(CASE WHEN quality = guess THEN 1.0 ELSE 0.0 END) AS a FROM d GROUP BY 1)
    SELECT round(coalesce(sum(CASE WHEN n >= 10 THEN n / (SELECT sum(n) FROM b) * abs(c - a) END), 0.0), 6) AS ece FROM b"""
)
def calibration_error(spark, sf_dir):
    d = _scored(spark, sf_dir).withColumn("ok", F.col("quality") == F.col("guess"))
    return A.calibration_error(d, "conf", "ok", 10, 10).select(r6("ece").alias("ece"))


@query(
    _SCORED
    + """, r AS (SELECT quality, rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2.0 AS r FROM d)
    SELECT round((sum(CASE WHEN quality = 1 THEN r END) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality))), 6) AS auc FROM r"""
)
def auc_rank(spark, sf_dir):
    return A.auc(_scored(spark, sf_dir), "conf", "quality").select(r6("auc").alias("auc"))


@query(
    _SCORED
    + """, n AS (SELECT quality, guess, count(*) AS n FROM d GROUP BY 1, 2), c AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS t FROM n),
    r AS (SELECT sum(m * (m - 1) / 2) AS x FROM (SELECT sum(n) AS m FROM n GROUP BY quality)), k AS (SELECT sum(m * (m - 1) / 2) AS x FROM (SELECT sum(n) AS m FROM n GROUP BY guess))
    SELECT round((c.x - r.x * k.x / (t * (t - 1) / 2)) / ((r.x + k.x) / 2 - r.x * k.x / (t * (t - 1) / 2)), 6) AS ari FROM c, r, k"""
)
def ari(spark, sf_dir):
    return A.adjusted_rand(_scored(spark, sf_dir), "quality", "guess").select(r6("ari").alias("ari"))


@query(
    _SCORED
    + """, n AS (SELECT quality AS a, guess AS b, count(*) AS n FROM d GROUP BY 1, 2),
    m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM n),
    h AS (SELECT -sum(n / t * ln(n / nb)) AS ab, -sum(n / t * ln(n / na)) AS ba, -sum(n / t * ln(na / t)) AS a, -sum(n / t * ln(nb / t)) AS b FROM m),
    s AS (SELECT 1 - ab / a AS homogeneity, 1 - ba / b AS completeness FROM h)
    SELECT round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness, round(2 * homogeneity * completeness / (homogeneity + completeness), 6) AS v FROM s"""
)
def v_measure(spark, sf_dir):
    return A.v_measure(_scored(spark, sf_dir), "quality", "guess").select(*[r6(c).alias(c) for c in ("homogeneity", "completeness", "v")])


@query("SELECT round(avg(l_discount), 6) AS macro, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS micro FROM lineitem")
def macro_micro(spark, sf_dir):
    return A.macro_micro(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity").select(r6("macro").alias("macro"), r6("micro").alias("micro"))


@query(
    """WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, avg(l_quantity) OVER w AS m, stddev_pop(l_quantity) OVER w AS s, count(l_quantity) OVER w AS n, l_quantity AS x FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CASE WHEN n >= 4 AND m <> 0 AND s / abs(m) >= 0.1 THEN round((x - m) / s, 4) END AS z FROM s"""
)
def zscore_gate(spark, sf_dir):
    d = A.zscores(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity")
    return d.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.round("z", 4).alias("z"))


@query(
    EVENTS_SQL
    + """, d AS (SELECT song, lead(t) OVER (PARTITION BY song ORDER BY t) - t AS d FROM ev), m AS (SELECT song, median(d) AS m, count(*) AS n FROM d GROUP BY 1)
    SELECT song, round(CASE WHEN max(n) >= 5 THEN avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d - m) <= 0.15 * m THEN 1.0 ELSE 0.0 END) ELSE 0.0 END, 6) AS regularity FROM d JOIN m USING (song) GROUP BY 1"""
)
def regularity(spark, sf_dir):
    return A.regularity(events(spark, sf_dir), SONG, "t").withColumn("regularity", r6("regularity"))


@query(
    EVENTS_SQL
    + """, d AS (SELECT song, CAST(t - min(t) OVER (PARTITION BY song) AS DOUBLE) AS t, CAST(pos AS DOUBLE) AS i, lead(t) OVER (PARTITION BY song ORDER BY pos) - t AS d FROM ev),
    f AS (SELECT song, regr_slope(t, i) AS slope, median(d) AS median FROM d GROUP BY 1)
    SELECT song, round(CASE WHEN abs(slope - median) <= 0.5 * median THEN slope ELSE median END / 1000000.0, 2) AS seconds FROM f"""
)
def bestfit_period(spark, sf_dir):
    e = events(spark, sf_dir)
    e = e.withColumn("t", F.col("t") - F.min("t").over(S.Window.partitionBy("song")))
    return A.best_fit_period(e, SONG, "t", 0.5).select("song", F.round(F.col("period") / 1000000.0, 2).alias("seconds"))


@query(
    EVENTS_SQL
    + """, c AS (SELECT song, avg(sin(2 * pi() * ((t % 86400000000) / 86400000000.0))) AS s, avg(cos(2 * pi() * ((t % 86400000000) / 86400000000.0))) AS c FROM ev GROUP BY 1),
    a AS (SELECT song, atan2(s, c) / (2 * pi()) AS turn, sqrt(s * s + c * c) AS r FROM c)
    SELECT song, round(CASE WHEN turn < 0 THEN turn + 1 ELSE turn END, 6) AS phase, round(r, 6) AS concentration FROM a"""
)
def circular_phase(spark, sf_dir):
    day = 86400000000
    e = events(spark, sf_dir).select("song", (F.col("t") % day).cast("double").alias("t"), F.lit(float(day)).alias("day"))
    return A.circular_phase(e, SONG, "t", "day").select("song", r6("phase").alias("phase"), r6("concentration").alias("concentration"))


@query("SELECT vec_id, round(list_aggregate(embedding::DOUBLE[], 'sum'), 4) AS total, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS length, list_position(embedding, list_aggregate(embedding, 'max')) - 1 AS top FROM embeddings")
def vector_profile(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    e = F.col("embedding")
    return v.select("vec_id", F.round(V.total(F.transform(e, lambda x: x.cast("double"))), 4).alias("total"), F.round(V.norm(e), 4).alias("length"), V.argmax(e).alias("top"))


# Motifs and decoding


_RUNS = """, b AS (SELECT song, pos, q, pos // 2 AS bar FROM ev),
    f AS (SELECT *, lag(bar) OVER w IS DISTINCT FROM bar AS s, lead(bar) OVER w IS DISTINCT FROM bar AS e FROM b WINDOW w AS (PARTITION BY song ORDER BY pos)),
    r AS (SELECT a.song, CAST(z.pos - a.pos + 1 AS INTEGER) AS length, a.pos AS start, string_agg(m.q, ' ' ORDER BY m.pos) AS motif
      FROM f a JOIN f z ON z.song = a.song AND z.pos BETWEEN a.pos + 1 AND a.pos + 3 JOIN f m ON m.song = a.song AND m.pos BETWEEN a.pos AND z.pos WHERE a.s AND z.e GROUP BY 1, 2, 3)
    """


def _barred(spark, sf_dir):
    return events(spark, sf_dir).withColumn("bar", F.floor(F.col("pos") / 2))


@query(EVENTS_SQL + _RUNS + "SELECT song, length, motif, start FROM r")
def ngram_barlocked(spark, sf_dir):
    return M.bar_locked_runs(_barred(spark, sf_dir), SONG, ORDER, "bar", "q")


@query(EVENTS_SQL + _RUNS + "SELECT song, length, motif, count(*) AS n, min(start) AS first_start, (count(*) - 1) * length AS saving FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def motif_saving(spark, sf_dir):
    return M.motifs(_barred(spark, sf_dir), SONG, ORDER, "bar", "q")


@query(
    EVENTS_SQL.replace("WITH ev", "WITH RECURSIVE ev", 1)
    + """, k AS (SELECT CAST(round(ln(0.9) * 1073741824) AS BIGINT) AS stay, CAST(round(ln(0.1) * 1073741824) AS BIGINT) AS go, CAST(round(ln(0.5) * 1073741824) AS BIGINT) AS init),
    e AS (SELECT song, pos, CAST(round(ln(1.05 - x) * 1073741824) AS BIGINT) AS e0, CAST(round(ln(0.05 + x) * 1073741824) AS BIGINT) AS e1 FROM (SELECT song, pos, least(w / 100, 1.0) AS x FROM ev)),
    f(song, pos, a0, a1, b0, b1) AS (SELECT song, pos, init + e0, init + e1, 0, 0 FROM e CROSS JOIN k WHERE pos = 0
      UNION ALL SELECT e.song, e.pos, e0 + greatest(a0 + stay, a1 + go), e1 + greatest(a0 + go, a1 + stay), CASE WHEN a0 + stay >= a1 + go THEN 0 ELSE 1 END, CASE WHEN a0 + go >= a1 + stay THEN 0 ELSE 1 END
      FROM f JOIN e ON e.song = f.song AND e.pos = f.pos + 1 CROSS JOIN k),
    z AS (SELECT song, max(pos) AS pos FROM e GROUP BY 1),
    b(song, pos, s, score) AS (SELECT song, pos, CASE WHEN a0 >= a1 THEN 0 ELSE 1 END, greatest(a0, a1) FROM f JOIN z USING (song, pos)
      UNION ALL SELECT b.song, b.pos - 1, CASE b.s WHEN 0 THEN b0 ELSE b1 END, score FROM b JOIN f ON f.song = b.song AND f.pos = b.pos WHERE b.pos > 0)
    SELECT song, pos, s AS state, round(score / 1073741824, 6) AS log_score FROM b"""
)
def viterbi(spark, sf_dir):
    """Two states, quiet and loud, decoded from the events' weights."""
    x = F.least(F.col("w") / 100, F.lit(1.0))
    e = events(spark, sf_dir).withColumn("e", F.array(F.ln(1.05 - x), F.ln(0.05 + x)))
    stay, go = math.log(0.9), math.log(0.1)
    return D.viterbi(e, SONG, "pos", "e", [[stay, go], [go, stay]], [math.log(0.5)] * 2).withColumn("log_score", r6("log_score"))
