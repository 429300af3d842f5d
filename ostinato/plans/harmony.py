"""Queries over chord tokens, keys and qualities, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions import qualities as Q
from ostinato.functions import tokens as T
from ostinato.functions import vectors as V
from ostinato.operators import keys as K
from ostinato.operators import sequences as S
from ostinato.operators import stats as A
from ostinato.plans.fixtures import CHORDS_SQL, EVENTS_SQL, chords, events, table
from ostinato.plans.queries import ORDER, SONG, query, r6

_MINOR = "q IN ('signup', 'error')"


def _parsed(spark, sf_dir):
    return K.parsed(chords(spark, sf_dir))


def _mode():
    return F.when(F.col("q").isin("signup", "error"), "minor").otherwise("major")


# Tokens


@query(CHORDS_SQL + "SELECT song, pos, root, tail AS quality, bass FROM ch")
def token_parse(spark, sf_dir):
    return _parsed(spark, sf_dir).select("song", "pos", "root", "quality", "bass")


@query(CHORDS_SQL + "SELECT song, pos, class, mask, round(list_sum(weights) + CASE WHEN bass IS NULL THEN 0 ELSE 1 END, 6) AS weight FROM ch JOIN mk USING (song, pos)")
def chord_tones(spark, sf_dir):
    d = _parsed(spark, sf_dir)
    return d.select("song", "pos", "class", "mask", r6(V.total(T.chord_weights(F.col("root"), F.col("quality"), F.col("bass")))).alias("weight"))


@query(
    CHORDS_SQL
    + """SELECT song, pos, CASE WHEN root IN (0, 1, 3, 5, 6, 8, 10) THEN flats ELSE sharps END[(root + 5) % 12 + 1] || tail
      || CASE WHEN bass IS NULL THEN '' ELSE '/' || CASE WHEN root IN (0, 1, 3, 5, 6, 8, 10) THEN flats ELSE sharps END[(bass + 5) % 12 + 1] END AS moved FROM ch"""
)
def token_transpose(spark, sf_dir):
    return chords(spark, sf_dir).select("song", "pos", T.transpose(F.col("token"), 5, T.prefers_flats(F.col("root"), F.lit("major"))).alias("moved"))


@query(
    CHORDS_SQL
    + f"""SELECT song, pos, CASE WHEN {_MINOR} THEN ['C', 'C#', 'D', 'Eb', 'E', 'F', 'F#', 'G', 'G#', 'A', 'Bb', 'B'][root + 1] || ' minor' ELSE flats[root + 1] || ' major' END AS name,
      root AS tonic, root + CASE WHEN {_MINOR} THEN 12 ELSE 0 END AS key, CASE WHEN {_MINOR} THEN (root + 3) % 12 ELSE root END AS collection,
      (root + pos) % 12 + CASE WHEN {_MINOR} THEN 12 ELSE 0 END AS moved FROM ch"""
)
def key_algebra(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("name", T.key_name(F.col("root"), _mode()))
    e = e.withColumn("k", T.parse_key(F.col("name"))).withColumn("key", T.key_index(F.col("k.tonic"), F.col("k.mode")))
    return e.select("song", "pos", "name", "k.tonic", "key", T.collection_of(F.col("key")).alias("collection"), T.relative_to_absolute(F.col("key"), F.col("pos")).alias("moved"))


@query(
    CHORDS_SQL
    + """, n AS (SELECT song, pos, root, class, mask, lead(root) OVER w AS r2, lead(class) OVER w AS c2, lead(mask) OVER w AS m2 FROM ch JOIN mk USING (song, pos) WINDOW w AS (PARTITION BY song ORDER BY pos)),
    f AS (SELECT *, abs(root * 7 % 12 - r2 * 7 % 12) AS d FROM n WHERE r2 IS NOT NULL)
    SELECT song, pos, round(1 - bit_count(mask & m2) / bit_count(mask | m2), 6) AS tones, least(d, 12 - d) AS fifths, CASE WHEN root <> r2 THEN 1.0 WHEN class <> c2 THEN 0.4 ELSE 0.0 END AS family,
      CASE WHEN root = r2 AND mask = m2 THEN 'exact' WHEN root = r2 AND class = c2 THEN 'family' ELSE 'mismatch' END AS grade FROM f"""
)
def chord_distances(spark, sf_dir):
    d = S.with_next(_parsed(spark, sf_dir), SONG, ORDER, r2="root", c2="class", m2="mask").filter("r2 is not null")
    c = [F.col(x) for x in ("root", "class", "mask", "r2", "c2", "m2")]
    return d.select(
        "song", "pos", r6(T.jaccard_distance(c[2], c[5])).alias("tones"), T.fifths_distance(c[0], c[3]).alias("fifths"), T.family_distance(c[0], c[1], c[3], c[4]).alias("family"),
        T.match_grade(*c).alias("grade"),
    )


@query(
    CHORDS_SQL
    + """, b AS (SELECT song, pos, root, coalesce(bass, -1) AS x, CAST(floor(w) AS BIGINT) % 12 AS y FROM ch)
    SELECT song, pos, CASE WHEN x < 0 THEN y WHEN x <> y AND y = root THEN y ELSE x END AS bass FROM b"""
)
def bass_routing(spark, sf_dir):
    d = _parsed(spark, sf_dir)
    return d.select("song", "pos", T.routed_bass(F.coalesce("bass", F.lit(-1)), (F.floor("w") % 12).cast("int"), F.col("root")).alias("bass"))


@query(
    CHORDS_SQL
    + """, l AS (SELECT *, CAST(floor(w) AS BIGINT) % 7 = 0 AS n, CAST(floor(w) AS BIGINT) % 11 = 0 AS x FROM ch)
    SELECT song, pos, CASE WHEN n THEN -1 WHEN x THEN NULL ELSE root END AS root, CASE WHEN n OR x THEN 'maj' ELSE CASE q WHEN 'click' THEN 'maj7' WHEN 'error' THEN 'hdim7' WHEN 'purchase' THEN '7' WHEN 'signup' THEN 'min7' ELSE 'maj' END END AS quality,
      CASE WHEN n THEN -1 WHEN x THEN NULL ELSE (root + 3) % 12 END AS bass FROM l"""
)
def harte_labels(spark, sf_dir):
    tail = Q.lookup({"click": "maj7", "error": "hdim7", "purchase": "7", "signup": "Min7", "view": "odd(9)"}, F.col("q"))
    label = F.concat(F.element_at(T._strings(T.FLATS), (F.col("root") + 1).cast("int")), F.lit(":"), tail, F.lit("/b3"))
    d = events(spark, sf_dir).withColumn("label", F.when(F.floor("w") % 7 == 0, "N").when(F.floor("w") % 11 == 0, "X").otherwise(label))
    h = T.harte(F.col("label"))
    return d.select("song", "pos", h["root"].alias("root"), h["quality"].alias("quality"), T.bass_class(F.col("label")).alias("bass"))


@query(CHORDS_SQL + "SELECT song, pos // 4 AS bar, pos % 4 AS slot, flats[root + 1] || tail || CASE WHEN bass IS NULL THEN '' ELSE '/' || sharps[bass + 1] END AS token FROM ch")
def measure_tokens(spark, sf_dir):
    d = chords(spark, sf_dir).groupBy("song", F.floor(F.col("pos") / 4).alias("bar"))
    d = d.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("measure"))
    return d.select("song", "bar", F.posexplode(T.split_measure(F.col("measure"))).alias("slot", "token"))


# Keys


_PROFILES = f"""pr AS (SELECT 0 AS minor, {T.MAJOR_PROFILE}::DOUBLE[] AS p UNION ALL SELECT 1, {T.MINOR_PROFILE}::DOUBLE[]),
    kd AS (SELECT minor * 12 + t.range AS key, c.range AS pc, ln(p[(c.range - t.range + 12) % 12 + 1] / list_sum(p)) AS lp FROM pr, range(12) t, range(12) c)"""
_BEST = "row_number() OVER (PARTITION BY {by} ORDER BY s DESC, key) AS k"


def _cued(by: str, extra: str = "") -> str:
    """Chroma of groups with 1.5 for the first root and 3 for the last."""
    return f"""z AS (SELECT {by}, min(pos) AS a, max(pos) AS b FROM g GROUP BY {by}),
    ct AS (SELECT {by}, t.pc, t.y FROM tone t JOIN g USING (song, pos) UNION ALL SELECT {by}, root, 1.5 FROM g JOIN z USING ({by}) WHERE pos = a UNION ALL SELECT {by}, root, 3.0 FROM g JOIN z USING ({by}) WHERE pos = b),
    cm AS (SELECT {by}, pc, sum(y) AS x FROM ct GROUP BY {by}, pc), sc AS (SELECT {by}, key, sum(x * lp) AS s FROM cm JOIN kd USING (pc) GROUP BY {by}, key)"""


@query(CHORDS_SQL + ", g AS (SELECT * FROM ch), " + _PROFILES + ", " + _cued("song") + " SELECT o.song, CAST(range AS INTEGER) AS pc, round(coalesce(x, 0), 6) AS x FROM (SELECT DISTINCT song FROM ch) o CROSS JOIN range(12) LEFT JOIN cm ON cm.song = o.song AND pc = range")
def weighted_chroma(spark, sf_dir):
    return K.chroma_by(_parsed(spark, sf_dir), SONG, ORDER).select("song", F.posexplode("chroma").alias("pc", "x")).withColumn("x", r6("x"))


@query(
    CHORDS_SQL
    + ", g AS (SELECT * FROM ch), "
    + _PROFILES
    + ", "
    + _cued("song")
    + ", r AS (SELECT *, "
    + _BEST.format(by="song")
    + ", 1 / sum(exp(s - m)) OVER (PARTITION BY song) AS c FROM (SELECT *, max(s) OVER (PARTITION BY song) AS m FROM sc)) SELECT song, key % 12 AS tonic, CASE WHEN key < 12 THEN 'major' ELSE 'minor' END AS mode, round(c, 4) AS confidence FROM r WHERE k = 1"
)
def key_estimates(spark, sf_dir):
    return K.estimate_keys(_parsed(spark, sf_dir), SONG, ORDER).select("song", "tonic", "mode", F.round("confidence", 4).alias("confidence"))


@query(
    CHORDS_SQL
    + ", g AS (SELECT *, pos // 16 AS section, song % 24 AS home FROM ch), "
    + _PROFILES
    + ", "
    + _cued("song, section, home")
    + ", h AS (SELECT song, section, s AS hs FROM sc WHERE key = home), r AS (SELECT *, "
    + _BEST.format(by="song, section")
    + " FROM sc) SELECT song, section, CASE WHEN s - hs >= 6 THEN key ELSE home END AS key FROM r JOIN h USING (song, section) WHERE k = 1"
)
def section_keys(spark, sf_dir):
    d = _parsed(spark, sf_dir).withColumns({"section": F.floor(F.col("pos") / 16), "home": F.col("song") % 24})
    return K.oracle_keys(d, SONG, "section", ORDER, "home")


@query(
    CHORDS_SQL
    + ", "
    + _PROFILES
    + """, es AS (SELECT song, pos, key, sum(y * lp) AS e FROM (SELECT * FROM tone WHERE NOT (y = 1.0 AND pc = (root + 7) % 12) UNION ALL SELECT song, pos, root, (root + 7) % 12, 1.0 FROM ch WHERE q <> 'error') JOIN kd USING (pc) GROUP BY 1, 2, 3),
    ws AS (SELECT song, pos, key, sum(e) OVER (PARTITION BY song, key ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS s FROM es),
    m AS (SELECT *, max(s) OVER (PARTITION BY song, pos) AS m FROM ws) SELECT song, pos, round(1 / sum(exp(s - m)), 4) AS confidence FROM m GROUP BY 1, 2"""
)
def rolling_keys(spark, sf_dir):
    """How sure the likeliest key of nine rows is; keys that tie differ by rounding only, their confidence doesn't."""
    d = _parsed(spark, sf_dir)
    return K.rolling_keys(d, SONG, ORDER, 4, T.chord_weights(F.col("root"), F.col("quality"))).select("song", "pos", F.round("confidence", 4).alias("confidence"))


@query(
    CHORDS_SQL
    + """, l AS (SELECT song, pos, root, class, lead(root) OVER w AS r1, lead(class) OVER w AS c1, lead(root, 2) OVER w AS r2, lead(class, 2) OVER w AS c2 FROM ch WINDOW w AS (PARTITION BY song ORDER BY pos)),
    o AS (SELECT song, pos, CASE WHEN class = 'dom' THEN (root + 5) % 12 WHEN class IN ('min', 'm7b5') AND c1 = 'dom' AND r1 = (root + 5) % 12 THEN (r1 + 5) % 12 ELSE root END AS tonic,
      CASE WHEN class = 'dom' THEN CASE WHEN r1 = (root + 5) % 12 AND c1 IN ('min', 'm7b5') THEN 'minor' ELSE 'major' END
        WHEN class IN ('min', 'm7b5') AND c1 = 'dom' AND r1 = (root + 5) % 12 THEN CASE WHEN r2 = (r1 + 5) % 12 AND c2 IN ('min', 'm7b5') THEN 'minor' ELSE 'major' END
        WHEN class IN ('min', 'm7b5') THEN 'minor' ELSE 'major' END AS mode FROM l)
    SELECT song, pos, tonic, mode FROM o"""
)
def functional_keys(spark, sf_dir):
    return K.functional_track(_parsed(spark, sf_dir), SONG, ORDER).select("song", "pos", "tonic", "mode")


@query(
    CHORDS_SQL
    + """, sk AS (SELECT 0 AS kind, t.range AS t, CAST(sum(1 << ((x + t.range) % 12)) AS INTEGER) AS m FROM range(12) t, unnest([0, 2, 4, 5, 7, 9, 11]) u(x) GROUP BY 1, 2
      UNION ALL SELECT 1, t.range, CAST(sum(1 << ((x + t.range) % 12)) AS INTEGER) FROM range(12) t, unnest([0, 2, 3, 5, 7, 9, 11]) u(x) GROUP BY 1, 2),
    f AS (SELECT song, pos, kind, t, least(abs(t * 7 % 12 - 0), 12 - abs(t * 7 % 12 - 0)) + kind AS distance FROM mk JOIN sk ON (mask & m) = mask)
    SELECT song, pos, CAST(k AS INTEGER) AS rank, CAST(distance AS INTEGER) AS distance, kind, t AS tonic FROM (SELECT *, row_number() OVER (PARTITION BY song, pos ORDER BY distance, kind, t) AS k FROM f) WHERE k <= 3"""
)
def scale_fits(spark, sf_dir):
    d = _parsed(spark, sf_dir).withColumns({"tonic": F.lit(0), "mode": F.lit("major")})
    d = K.fitting_scales(d).select("song", "pos", F.posexplode("scales").alias("rank", "s"))
    return d.select("song", "pos", (F.col("rank") + 1).alias("rank"), "s.distance", "s.kind", "s.tonic")


@query(
    CHORDS_SQL
    + """, c AS (SELECT song, pos, sum(y) AS n, sum(y * sin(7 * pi() / 6 * pc)) AS a, sum(y * cos(7 * pi() / 6 * pc)) AS b, sum(y * sin(3 * pi() / 2 * pc)) AS c, sum(y * cos(3 * pi() / 2 * pc)) AS d,
      0.5 * sum(y * sin(2 * pi() / 3 * pc)) AS e, 0.5 * sum(y * cos(2 * pi() / 3 * pc)) AS f FROM tone GROUP BY 1, 2),
    v AS (SELECT song, pos, [a / n, b / n, c / n, d / n, e / n, f / n] AS v FROM c), p AS (SELECT song, pos, v, lag(v) OVER (PARTITION BY song ORDER BY pos) AS u FROM v)
    SELECT song, pos, round(coalesce(list_distance(u, v), 0), 4) AS change FROM p"""
)
def harmonic_change(spark, sf_dir):
    d = _parsed(spark, sf_dir).withColumn("c", T.chord_weights(F.col("root"), F.col("quality"), F.col("bass")))
    return S.harmonic_change(d, SONG, ORDER, "c").select("song", "pos", F.round("change", 4).alias("change"))


# Qualities


_RAW = {"click": ["maj7", "M7", "Δ7"], "error": ["m7b5", "HalfDim", "ø"], "purchase": ["7", "13", "7sus"], "signup": ["-7", "mi9", "M"], "view": ["", "sus2", "Aug"]}
_PLAIN = {"click": ["maj7"] * 3, "error": ["ø7"] * 3, "purchase": ["7", "13", "7sus4"], "signup": ["min7", "min9", "min"], "view": ["maj", "sus2", "aug"]}
_BASES = {"click": ["maj7"] * 3, "error": ["ø7"] * 3, "purchase": ["7", "7", "7sus4"], "signup": ["min7", "min7", "min"], "view": ["maj", "sus4", "aug"]}
_SHORTS = {"click": [""] * 3, "error": ["dim"] * 3, "purchase": ["", "", "sus"], "signup": ["m"] * 3, "view": ["", "sus", "aug"]}


def _by_type(table: dict) -> str:
    return "CASE q " + " ".join(f"WHEN '{k}' THEN {v!r}[pos % 3 + 1]" for k, v in table.items()) + " END"


@query(CHORDS_SQL + f"SELECT song, pos, sharps[root + 1] || {_by_type(_PLAIN)} AS name, sharps[root + 1] || {_by_type(_SHORTS)} AS family, sharps[root + 1] || {_by_type(_BASES)} AS seventh FROM ch")
def quality_levels(spark, sf_dir):
    e = events(spark, sf_dir)
    raw = F.get(F.split(Q.lookup({k: "|".join(v) for k, v in _RAW.items()}, F.col("q")), r"\|"), (F.col("pos") % 3).cast("int"))
    e = e.withColumn("name", Q.normal_chord(F.concat(F.element_at(T._strings(T.FLATS), (F.col("root") + 1).cast("int")), raw, F.lit("/G"))))
    q = F.regexp_replace("name", "^[A-G]#?", "")
    return e.select("song", "pos", "name", Q.at_depth(F.col("root"), q, F.lit(1)).alias("family"), Q.at_depth(F.col("root"), q, F.lit(2)).alias("seventh"))


@query(
    EVENTS_SQL
    + """, s AS (SELECT song, pos, pos % 13 AS beats, CASE q WHEN 'click' THEN 'Medium Up Swing' WHEN 'error' THEN 'Slow Blues' WHEN 'purchase' THEN 'Pop Ballad' WHEN 'signup' THEN NULL ELSE 'Folk' END AS style FROM ev)
    SELECT song, pos, CASE beats WHEN 3 THEN 'JazzWaltz' WHEN 5 THEN 'Jazz54' WHEN 6 THEN '68Swing' WHEN 12 THEN 'Ballad128' ELSE CASE style WHEN 'Slow Blues' THEN 'SlowBlues' WHEN 'Pop Ballad' THEN 'Ballad' ELSE 'Swing' END END AS groove,
      CASE WHEN beats IN (3, 5) THEN 140 WHEN beats = 6 THEN 100 WHEN beats = 12 THEN 70 ELSE CASE style WHEN 'Slow Blues' THEN 65 WHEN 'Pop Ballad' THEN 70 WHEN 'Medium Up Swing' THEN 180 ELSE 140 END END AS tempo FROM s"""
)
def style_grooves(spark, sf_dir):
    style = Q.lookup({"click": "Medium Up Swing", "error": "Slow Blues", "purchase": "Pop Ballad", "view": "Folk"}, F.col("q"))
    return events(spark, sf_dir).select("song", "pos", Q.groove(style, F.col("pos") % 13).alias("g")).select("song", "pos", "g.*")


@query(
    EVENTS_SQL
    + f""", st(style, lo, hi, mode) AS (VALUES {", ".join(map(str, Q.TEMPOS))}), t AS (SELECT song, pos, 20 + 3 * pos AS bpm FROM ev),
    x AS (SELECT song, pos, style, CASE WHEN bpm BETWEEN lo AND hi THEN exp(-0.5 * ((ln(bpm) - ln(mode)) / 0.3) ** 2) ELSE 0 END AS x FROM t CROSS JOIN st),
    y AS (SELECT *, sum(x) OVER (PARTITION BY song, pos) AS total FROM x) SELECT song, pos, style, round(x / total, 6) AS p FROM y WHERE total > 0"""
)
def tempo_styles(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("x", F.explode(Q.style_posteriors((20 + 3 * F.col("pos")).cast("double"))))
    return e.select("song", "pos", "x.style", r6("x.p").alias("p"))


@query(
    CHORDS_SQL
    + """, h(mode, degree, fits, home) AS (VALUES ('major', 0, ['major', 'maj7'], 'major'), ('major', 2, ['minor'], 'minor'), ('major', 4, ['minor'], 'minor'), ('major', 5, ['major', 'maj7'], 'major'), ('major', 7, ['dom7', 'major'], 'dom7'),
      ('major', 9, ['minor'], 'minor'), ('major', 11, ['dim'], 'dim'), ('minor', 0, ['minor'], 'minor'), ('minor', 2, ['dim'], 'dim'), ('minor', 3, ['major', 'maj7'], 'major'), ('minor', 5, ['minor'], 'minor'),
      ('minor', 7, ['minor', 'dom7', 'major'], 'dom7'), ('minor', 8, ['major', 'maj7'], 'major'), ('minor', 10, ['dom7', 'major'], 'dom7'), ('minor', 11, ['dim'], 'dim')),
    a AS (SELECT song, pos, CASE WHEN song % 2 = 0 THEN 'major' ELSE 'minor' END AS mode, (root - song % 12 + 12) % 12 AS degree, pos % 100 / 100.0 AS conf, (pos % 7) / 7.0 AS kc,
      CASE q WHEN 'click' THEN 'maj7' WHEN 'error' THEN 'hdim7' WHEN 'purchase' THEN '7' WHEN 'signup' THEN 'min' ELSE 'sus4' END AS quality, CASE q WHEN 'click' THEN 'maj7' WHEN 'error' THEN 'dim' WHEN 'purchase' THEN 'dom7' WHEN 'signup' THEN 'minor' END AS q5 FROM ch),
    b AS (SELECT a.*, home, q5 IS NOT NULL AND home IS NOT NULL AND NOT list_contains(fits, q5) AND kc >= 0.3 AND conf < 0.8 AND greatest(1 - conf, 1e-6) * 4 > greatest(conf, 1e-6) AS go FROM a LEFT JOIN h USING (mode, degree))
    SELECT song, pos, CASE WHEN go THEN CASE home WHEN 'major' THEN CASE WHEN quality = 'min' THEN 'maj' ELSE 'maj7' END WHEN 'minor' THEN CASE WHEN quality = 'min' THEN 'min' ELSE 'min7' END
      WHEN 'dom7' THEN CASE WHEN quality = 'min' THEN 'maj' ELSE '7' END ELSE CASE WHEN quality = 'min' THEN 'dim' ELSE 'dim7' END END ELSE quality END AS quality,
      CASE WHEN go THEN round((1 - conf) * 4 / ((1 - conf) * 4 + greatest(conf, 1e-6)), 6) END AS p FROM b"""
)
def diatonic_prior(spark, sf_dir):
    e = events(spark, sf_dir)
    quality = Q.lookup({"click": "maj7", "error": "hdim7", "purchase": "7", "signup": "min", "view": "sus4"}, F.col("q"))
    mode = F.when(F.col("song") % 2 == 0, "major").otherwise("minor")
    x = Q.diatonic_prior(F.col("root"), quality, F.col("pos") % 100 / 100.0, F.col("song") % 12, mode, (F.col("pos") % 7) / 7.0)
    return e.select("song", "pos", x.alias("x")).select("song", "pos", "x.quality", r6("x.p").alias("p"))


_V = "WITH v AS (SELECT vec_id, label, list_transform(embedding[1:12]::DOUBLE[], lambda x: abs(x)) AS a, embedding::DOUBLE[] AS e FROM embeddings)"


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", "label", F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))).alias("a"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))


@query(
    _V
    + """, q AS (SELECT vec_id, a[(label + 7) % 12 + 1] AS p, a[(label + 6) % 12 + 1] AS d, ['min7', 'hdim7', 'min', 'dim', 'maj'][vec_id % 5 + 1] AS q FROM v),
    c AS (SELECT *, greatest(p, d) >= 0.12 AND least(p, d) > 0 AND greatest(p, d) / least(p, d) >= 1.3 AS clear FROM q)
    SELECT vec_id, CASE WHEN clear AND d > p AND q = 'min7' THEN 'hdim7' WHEN clear AND d > p AND q = 'min' THEN 'dim' WHEN clear AND p > d AND q = 'hdim7' THEN 'min7' WHEN clear AND p > d AND q = 'dim' THEN 'min' ELSE q END AS quality FROM c"""
)
def fifth_check(spark, sf_dir):
    q = F.element_at(F.array(*map(F.lit, ["min7", "hdim7", "min", "dim", "maj"])), (F.col("vec_id") % 5 + 1).cast("int"))
    return _vectors(spark, sf_dir).select("vec_id", Q.fifth_checked(q, F.col("label"), F.col("a")).alias("quality"))


@query(
    _V
    + """, s AS (SELECT vec_id, list_transform(a[1:5], lambda x: x / list_sum(a[1:5])) AS f, a[9] / (a[7] + a[8] + a[9]) AS dom, a[12] / (a[10] + a[11] + a[12]) AS half FROM v),
    r AS (SELECT vec_id, [f[1] * (1 - dom) + f[4] + f[5], f[2], f[1] * dom, f[3] * half, f[3] * (1 - half)] AS r FROM s),
    k AS (SELECT vec_id, list_transform(r, lambda x: greatest(x, 1e-9)) AS k FROM r), u AS (SELECT vec_id, unnest([0, 1, 2, 3, 4]) AS class, unnest(k) AS x, list_sum(k) AS t FROM k)
    SELECT vec_id, class, round(ln(x / t), 5) AS logp FROM u"""
)
def five_classes(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    sevenths = F.create_map(*[x for i, n in enumerate(["majT", "maj7", "dom7", "dimT", "dim7", "m7b5"]) for x in (F.lit(n), F.element_at("a", i + 7))])
    five = F.slice("a", 1, 5)
    families = F.transform(five, lambda x: x / V.total(five))
    return v.select("vec_id", F.posexplode(Q.five_classes(families, sevenths)).alias("class", "logp")).withColumn("logp", F.round("logp", 5))


@query(
    _V
    + """, g AS (SELECT vec_id, k.range AS k, a, CASE WHEN a[(k.range + 7) % 12 + 1] > 0.4 * a[k.range + 1] THEN 0.4 * a[(k.range + 7) % 12 + 1] / (a[k.range + 1] + 1e-9) * a[k.range + 1] ELSE 0 END AS give FROM v CROSS JOIN range(12) k),
    m AS (SELECT x.vec_id, x.k, greatest(x.a[x.k + 1] - x.give + y.give, 0) AS m FROM g x JOIN g y ON x.vec_id = y.vec_id AND y.k = (x.k + 7) % 12)
    SELECT vec_id, CAST(k AS INTEGER) AS root, round(m / sum(m) OVER (PARTITION BY vec_id), 5) AS p FROM m"""
)
def uninverted_roots(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(Q.uninverted(F.col("a"))).alias("root", "p")).withColumn("p", F.round("p", 5))


@query(
    EVENTS_SQL
    + """, s AS (SELECT song, pos, root, w, lead(root) OVER x AS r1, lead(w) OVER x AS w1, lead(root, 2) OVER x AS r2, lead(w, 2) OVER x AS w2 FROM ev WINDOW x AS (PARTITION BY song ORDER BY pos))
    SELECT song, pos, ((r1 - root + 12) % 12 IN (5, 7) AND w1 >= 0.6 * w) OR ((r2 - root + 12) % 12 IN (5, 7) AND w2 >= 0.6 * w) AS competes FROM s WHERE r2 IS NOT NULL"""
)
def fifth_competition(spark, sf_dir):
    d = S.with_next(S.with_next(events(spark, sf_dir), SONG, ORDER, r1="root", w1="w"), SONG, ORDER, r2="r1", w2="w1").filter("r2 is not null")
    s = F.array(*[F.struct(F.col(r).alias("root"), F.col(w).alias("c")) for r, w in (("root", "w"), ("r1", "w1"), ("r2", "w2"))])
    return d.select("song", "pos", Q.fifth_competes(F.col("root"), s).alias("competes"))


@query(
    EVENTS_SQL
    + """, x AS (SELECT song, pos, w / 100 AS x FROM ev)
    SELECT song, pos, round(CASE WHEN x <= 0.2 THEN 0.1 WHEN x <= 0.5 THEN 0.1 + (x - 0.2) * ((0.37 - 0.1) / (0.5 - 0.2)) WHEN x <= 0.9 THEN 0.37 + (x - 0.5) * ((0.95 - 0.37) / (0.9 - 0.5)) ELSE 0.95 END, 6) AS calibrated FROM x"""
)
def calibrated_confidence(spark, sf_dir):
    """Slopes are 0.9 and 1.45: weights of two decimals give six at most, so that rounding meets no ties."""
    return events(spark, sf_dir).select("song", "pos", r6(Q.interpolate(F.col("w") / 100, [(0.2, 0.1), (0.5, 0.37), (0.9, 0.95)])).alias("calibrated"))


@query(
    EVENTS_SQL
    + """, p(step, i, quality) AS (VALUES (0, 2, 'min7'), (1, 7, 'dom7'), (2, 0, 'maj7'))
    SELECT song, pos, step, (root + i) % 12 AS chord, quality FROM ev CROSS JOIN p"""
)
def progressions_set(spark, sf_dir):
    two_five_one = F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(q).alias("quality")) for i, q in ((2, "min7"), (7, "dom7"), (0, "maj7"))])
    d = events(spark, sf_dir).select("song", "pos", F.posexplode(Q.absolute(two_five_one, F.col("root"))).alias("step", "c"))
    return d.select("song", "pos", "step", F.col("c.root").alias("chord"), "c.quality")


_SEVENS = "CASE q WHEN 'click' THEN 'maj7' WHEN 'error' THEN 'm7b5' WHEN 'purchase' THEN 'dom7' WHEN 'signup' THEN 'min7' ELSE 'majT' END"
_FAMILY = "CASE q WHEN 'error' THEN 'd' WHEN 'signup' THEN 'm' ELSE 'M' END"


@query(
    EVENTS_SQL
    + f""", a AS (SELECT song, pos, 'literal' AS alphabet, root || ' ' || {_SEVENS} AS s FROM ev UNION ALL SELECT song, pos, 'folded', CASE WHEN q = 'purchase' THEN root % 6 || ' DOM' ELSE root || ' ' || {_SEVENS} END FROM ev
      UNION ALL SELECT song, pos, 'family', root || ' ' || {_FAMILY} FROM ev UNION ALL SELECT song, pos, 'both', CASE WHEN q = 'purchase' THEN root % 6 || ' DOM' ELSE root || ' ' || {_FAMILY} END FROM ev),
    t AS (SELECT alphabet, s AS s0, lead(s) OVER w AS s1, lead(s, 2) OVER w AS s2 FROM a WINDOW w AS (PARTITION BY song, alphabet ORDER BY pos))
    SELECT alphabet, count(*) AS n, count(DISTINCT s0 || '|' || s1 || '|' || s2) AS patterns FROM t WHERE s2 IS NOT NULL GROUP BY 1"""
)
def pattern_alphabets(spark, sf_dir):
    q = Q.lookup({"click": "maj7", "error": "m7b5", "purchase": "dom7", "signup": "min7", "view": "majT"}, F.col("q"))
    kinds = {"literal": (False, False), "folded": (True, False), "family": (False, True), "both": (True, True)}
    every = F.array(*[F.struct(F.lit(n).alias("alphabet"), Q.pattern_symbol(F.col("root"), q, *k).alias("s")) for n, k in kinds.items()])
    d = events(spark, sf_dir).select("song", "pos", F.explode(every).alias("x")).select("song", "pos", "x.*")
    g = A.ngrams(d, ["song", "alphabet"], ORDER, "s", 3)
    return g.groupBy("alphabet").agg(F.count("*").alias("n"), F.countDistinct("s0", "s1", "s2").alias("patterns"))


# Vectors


@query(
    _V
    + """, r AS (SELECT vec_id, e, e[8:64] || e[1:7] AS t, list_sum(list_transform(e, lambda x: exp(x - list_max(e)))) AS z FROM v)
    SELECT vec_id, round(list_cosine_similarity(e, t), 5) AS turned, round(list_max(e) + ln(z), 5) AS lse, round(exp(e[3] - list_max(e)) / z, 6) AS soft, round(e[35] / sqrt(list_dot_product(e[33:48], e[33:48])), 5) AS block,
      round(list_sum(list_transform(list_filter(range(64), lambda i: (i + 9) % 12 = 5), lambda i: e[i + 1])), 5) AS folded, round(abs(e[1]) / list_sum(list_transform(e, lambda x: abs(x))), 6) AS share FROM r"""
)
def vector_algebra(spark, sf_dir):
    v, e = _vectors(spark, sf_dir), F.col("e")
    return v.select(
        "vec_id", F.round(V.cosine(e, V.rotate(e, F.lit(7))), 5).alias("turned"), F.round(V.log_sum_exp(e), 5).alias("lse"), r6(F.element_at(V.softmax(e), 3)).alias("soft"),
        F.round(F.element_at(V.blocks_scaled(e, 16), 35), 5).alias("block"), F.round(F.element_at(V.folded(e, 9), 6), 5).alias("folded"),
        r6(F.element_at(V.shares(F.transform(e, lambda x: F.abs(x))), 1)).alias("share"),
    )
