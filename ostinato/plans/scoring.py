"""Queries of chord names, vocabularies and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.functions import vocabulary as V
from ostinato.operators import scoring as S
from ostinato.plans.fixtures import CHORDS_SQL, EVENTS_SQL, chords, events, table
from ostinato.plans.queries import ORDER, SONG, query, r6

TEMPLATES = [[1.0 if k in tones else 0.0 for k in range(12)] for tones in ((0, 4, 7), (0, 3, 7), (0, 3, 6), (0, 4, 8), (0, 5, 7))]
UNIT = [[x / 3**0.5 for x in t] for t in TEMPLATES]
DEVIATIONS = [[0.2 + 0.05 * ((k * (f + 2)) % 5) for k in range(12)] for f in range(5)]

_BLOCKS_SQL = (
    EVENTS_SQL
    + """, c AS (SELECT song, pos // 4 AS block, k, sum(CASE WHEN k = root THEN w / 50 WHEN k = (root + 7) % 12 THEN w / 100 ELSE 0.01 * (k + 1) END) AS x FROM ev CROSS JOIN (SELECT unnest(range(12)) AS k) GROUP BY 1, 2, 3)"""
)


def _chroma(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    x = [F.when(F.col("root") == k, F.col("w") / 50).when((F.col("root") + 7) % 12 == k, F.col("w") / 100).otherwise(0.01 * (k + 1)) for k in range(12)]
    return e.groupBy("song", F.expr("pos div 4").alias("block")).agg(F.array(*[F.sum(v) for v in x]).alias("x"))


@query(
    CHORDS_SQL
    + """, n AS (SELECT song, pos, CASE q WHEN 'click' THEN 'M7' WHEN 'error' THEN 'm7b5' WHEN 'purchase' THEN '7' WHEN 'signup' THEN 'm7' ELSE '' END AS q, flats[root + 1] AS r, sharps[bass + 1] AS b FROM ch)
    SELECT song, pos, CASE pos % 6 WHEN 2 THEN r || '5' WHEN 3 THEN 'z' WHEN 4 THEN NULL WHEN 5 THEN r || 'mM7' ELSE r || q || CASE WHEN b IS NULL THEN '' ELSE '/' || b END END AS name FROM n"""
)
def normal_chords(spark, sf_dir) -> DataFrame:
    d = chords(spark, sf_dir)
    root = F.regexp_extract("token", "^[A-G]b?", 0)
    written = F.when(F.col("pos") % 6 == 1, F.concat("token", F.lit("N2"))).when(F.col("pos") % 6 == 2, F.concat(F.lit("W/"), root)).when(F.col("pos") % 6 == 3, "n")
    written = written.when(F.col("pos") % 6 == 4, F.concat(root, F.lit("weird"))).when(F.col("pos") % 6 == 5, F.concat(F.lit(" "), root, F.lit("-^7U"))).otherwise(F.col("token"))
    return d.select("song", "pos", V.normal_chord(written).alias("name"))


@query(EVENTS_SQL + "SELECT song, pos, CASE WHEN pos % 7 = 3 THEN 180 ELSE root * 15 + CASE q WHEN 'click' THEN 6 WHEN 'error' THEN 10 WHEN 'purchase' THEN 8 WHEN 'signup' THEN 7 ELSE 0 END END AS number FROM ev")
def chord_numbers(spark, sf_dir) -> DataFrame:
    names = {"click": "maj7", "error": "ø7", "purchase": "7", "signup": "min7"}
    quality = F.coalesce(*[F.when(F.col("q") == k, v) for k, v in names.items()], F.lit("maj"))
    e = events(spark, sf_dir).withColumn("quality", F.when(F.col("pos") % 7 == 3, "N").otherwise(quality))
    return e.select("song", "pos", V.chord_number(F.col("root"), F.col("quality")).alias("number"))


@query(
    _BLOCKS_SQL
    + f""", u AS (SELECT song, block, list(x ORDER BY k) AS x, sqrt(sum(x * x)) AS n FROM c GROUP BY 1, 2), t AS (SELECT f, unnest(range(12)) AS r, t FROM (SELECT unnest(range(5)) AS f, unnest({UNIT}) AS t)),
    s AS (SELECT song, block, r, f, list_sum(list_transform(range(1, 13), lambda k: x[k] / n * t[(k - 1 - r + 12) % 12 + 1])) AS s FROM u CROSS JOIN t)
    SELECT song, block, r AS root, f AS family, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY song, block ORDER BY round(s, 12) DESC, r, f) = 1"""
)
def best_templates(spark, sf_dir) -> DataFrame:
    d = _chroma(spark, sf_dir).select("song", "block", S.best_template(F.col("x"), UNIT).alias("b"))
    return d.select("song", "block", "b.root", "b.family", r6("b.score").alias("score"))


@query(
    _BLOCKS_SQL
    + f""", u AS (SELECT song, block, list(x ORDER BY k) AS x FROM c GROUP BY 1, 2), t AS (SELECT f, m, s, unnest(range(12)) AS r FROM (SELECT unnest(range(5)) AS f, unnest({TEMPLATES}) AS m, unnest({DEVIATIONS}) AS s))
    SELECT song, block, f AS family, r AS root, round(-0.5 * list_sum(list_transform(range(1, 13), lambda k: pow((x[(k - 1 + r) % 12 + 1] - m[k]) / s[k], 2))) - list_sum(list_transform(s, lambda y: ln(y))), 5) AS score FROM u CROSS JOIN t"""
)
def rotation_scores(spark, sf_dir) -> DataFrame:
    d = _chroma(spark, sf_dir).select("song", "block", F.posexplode(S.rotation_likelihoods(F.col("x"), TEMPLATES, DEVIATIONS)).alias("family", "by_root"))
    return d.select("song", "block", "family", F.posexplode("by_root").alias("root", "score")).withColumn("score", F.round("score", 5))


@query(
    EVENTS_SQL
    + """, d AS (SELECT song, pos % 8 AS place, w, unnest([0, 1, 2]) AS i, unnest([w / 100, (100 - w) / 200, (100 - w) / 200]) AS x FROM ev),
    s AS (SELECT song, place, i, sum(w * x) AS s FROM d GROUP BY 1, 2, 3), t AS (SELECT song, pos % 8 AS place, sum(w) AS t, count(*) AS n FROM ev GROUP BY 1, 2)
    SELECT song, place, round(max(s) / (any_value(t) + 1e-9), 6) AS agreement, any_value(n) AS n FROM s JOIN t USING (song, place) GROUP BY 1, 2"""
)
def place_agreement(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"place": F.col("pos") % 8, "d": F.array(F.col("w") / 100, (100 - F.col("w")) / 200, (100 - F.col("w")) / 200)})
    return S.agreement(e, ["song", "place"], "d", "w").withColumn("agreement", r6("agreement"))


@query(
    EVENTS_SQL
    + """, d AS (SELECT song, pos, (root - song % 12 + 12) % 12 AS d, (q = 'signup')::INTEGER AS m FROM ev), o AS (SELECT d.song, d.pos, o.o, e.d, e.m FROM d CROSS JOIN (SELECT unnest(range(9)) AS o) o JOIN d e ON e.song = d.song AND e.pos = d.pos + o.o - 4)
    SELECT song, pos, string_agg((o * 13 + d)::VARCHAR || CASE WHEN m = 1 THEN '+' ELSE '' END, ' ' ORDER BY o) AS ones FROM o GROUP BY 1, 2"""
)
def window_blocks(spark, sf_dir) -> DataFrame:
    """The places of the ones in each row's block, with a plus where the mode is one."""
    e = events(spark, sf_dir).withColumns({"d": F.pmod(F.col("root") - F.col("song") % 12, F.lit(12)).cast("int"), "m": (F.col("q") == "signup").cast("int")})
    d = S.window_block(e, SONG, ORDER, "d", "m")
    hot = F.filter(F.transform("block", lambda x, i: F.when((x == 1) & (i % 13 < 12), F.concat(i.cast("string"), F.when(F.get("block", (i - i % 13 + 12).cast("int")) == 1, "+").otherwise("")))), lambda x: x.isNotNull())
    return d.select("song", "pos", F.array_join(hot, " ").alias("ones"))


@query(
    """WITH a AS (SELECT c_nationkey AS nation, 'No ' || c_custkey % 40 AS title, c_acctbal AS balance, 0 AS source FROM customer UNION ALL SELECT s_nationkey, 'NO ' || s_suppkey % 50, s_acctbal, 1 FROM supplier),
    f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY nation, lower(title) ORDER BY source, balance, title) = 1)
    SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY nation ORDER BY source, title, balance) <= 25"""
)
def merged_sources(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.concat(F.lit("No "), (F.col("c_custkey") % 40).cast("string")).alias("title"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.concat(F.lit("NO "), (F.col("s_suppkey") % 50).cast("string")).alias("title"), F.col("s_acctbal").alias("balance"))
    return S.first_of_sources([c, s], ["nation"], "title", 25)
