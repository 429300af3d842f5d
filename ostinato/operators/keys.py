"""Key estimation and tracking over sequences of chord tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.functions import tokens as T
from ostinato.operators.sequences import backwards, ordered, run_ids

_MAJOR = [T.mask_of(T.MAJOR_SCALE, t) for t in range(12)]
_HARMONIC = [(_MAJOR[c] & ~(1 << (c + 7) % 12)) | 1 << (c + 8) % 12 for c in range(12)]
_MELODIC = [(_MAJOR[c] & ~(1 << (c + 5) % 12 | 1 << (c + 7) % 12)) | 1 << (c + 6) % 12 | 1 << (c + 8) % 12 for c in range(12)]
_MELODIC_MINOR = [T.mask_of(T.MELODIC_MINOR, t) for t in range(12)]


def parsed(df: DataFrame, token: str = "token") -> DataFrame:
    """Adds root, quality, bass, class and the mask of a token's own tones."""
    df = df.withColumn("_p", T.parse(F.col(token)))
    df = df.withColumns({c: F.col(f"_p.{c}") for c in ("root", "quality", "bass")}).drop("_p")
    return df.withColumns({"class": T.quality_class(F.col("quality")), "mask": T.chord_mask(F.col("root"), F.col("quality"))})


def chroma_by(df: DataFrame, keys: list[str], order: list[str], weight: Column | None = None, cues: bool = True) -> DataFrame:
    """One chroma per sequence: chord tones weighted by duration; ``cues`` adds 1.5 for the first root and
    3 for the last."""
    w = ordered(keys, order)
    chroma = F.transform(T.chord_weights(F.col("root"), F.col("quality"), F.col("bass")), lambda x: x * (F.lit(1.0) if weight is None else weight))
    if cues:
        first = F.when(F.row_number().over(w) == 1, 1.5).otherwise(0.0)
        last = F.when(F.lead(F.lit(1)).over(w).isNull(), 3.0).otherwise(0.0)
        df = df.withColumn("_cue", first + last)
        chroma = F.transform(chroma, lambda x, i: x + F.when(F.col("root") == i, F.col("_cue")).otherwise(0.0))
    d = df.select(*keys, F.posexplode(chroma).alias("pc", "x")).groupBy(*keys, "pc").agg(F.sum("x").alias("x"))
    return d.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "x"))), lambda s: s["x"]).alias("chroma"))


def estimate_keys(df: DataFrame, keys: list[str], order: list[str], weight: Column | None = None, cues: bool = True) -> DataFrame:
    """The likeliest key of each sequence (or section, if ``keys`` name one): key, tonic, mode, confidence."""
    return chroma_by(df, keys, order, weight, cues).select(*keys, T.best_key(F.col("chroma")).alias("_k")).select(*keys, "_k.*")


def rolling_keys(df: DataFrame, keys: list[str], order: list[str], window: int, chroma: Column) -> DataFrame:
    """The likeliest key in a window of rows around each row."""
    w = ordered(keys, order).rowsBetween(-window, window)
    d = df.withColumn("_c", chroma)
    summed = F.array(*[F.sum(F.element_at("_c", i + 1)).over(w) for i in range(12)])
    return d.withColumn("_s", summed).withColumn("_k", T.best_key(F.col("_s"))).select(*df.columns, "_k.*")


def functional_track(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The key each chord points to: a dominant to the key a fifth below (minor if it resolves to a minor
    chord), a ii to its dominant's, a major or single minor chord to its own; others take the key before
    them, or after them at the start. Adds tonic and mode."""
    w = ordered(keys, order)
    df = df.withColumns({"_nr": F.lead("root").over(w), "_nc": F.lead("class").over(w), "_nnr": F.lead("root", 2).over(w), "_nnc": F.lead("class", 2).over(w)})
    c, fifth = F.col("class"), lambda x: F.pmod(x + 5, F.lit(12))
    minor = lambda x: F.when(x.isin("min", "m7b5"), "minor").otherwise("major")
    target = fifth(F.col("root"))
    dom_mode = F.when(F.col("_nr") == target, minor(F.col("_nc"))).otherwise("major")
    is_ii = c.isin("min", "m7b5") & (F.col("_nc") == "dom") & (F.col("_nr") == target)
    ii_target = fifth(F.col("_nr"))
    ii_mode = F.when(F.col("_nnr") == ii_target, minor(F.col("_nnc"))).otherwise("major")
    own = (
        F.when(c.isin("dom", "sus"), F.struct(target.alias("tonic"), dom_mode.alias("mode")))
        .when(is_ii, F.struct(ii_target.alias("tonic"), ii_mode.alias("mode")))
        .when(c.isin("min", "m7b5"), F.struct(F.col("root").alias("tonic"), F.lit("minor").alias("mode")))
        .when(c == "maj", F.struct(F.col("root").alias("tonic"), F.lit("major").alias("mode")))
    )
    before = F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_own", ignorenulls=True).over(backwards(keys, order))
    none = F.struct(F.lit(0).alias("tonic"), F.lit("major").alias("mode"))
    df = df.withColumn("_own", own).withColumn("_key", F.coalesce(before, after, none))
    return df.withColumns({"tonic": F.col("_key.tonic"), "mode": F.col("_key.mode")}).drop("_nr", "_nc", "_nnr", "_nnc", "_own", "_key")


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def continuity_track(df: DataFrame, keys: list[str], order: list[str], home_tonic: int = 0, home_mode: str = "major", minor_colours: bool = True, lookahead: int | None = None) -> DataFrame:
    """The scale held at each chord: a collection of tones stays until a chord leaves it, then the nearest
    one by fifths that fits takes over (ties: fits more of the next chords, then the lower tonic). ``lookahead`` chords
    count as next: 2, or 1 where natural scales only count.

    With ``minor_colours`` a collection also holds chords of its relative harmonic minor, and those of its
    melodic minor on that minor's tonic; without, natural scales only count. A run is labelled as its major
    key or, if that has more tonic chords, its relative minor; the home collection of a minor home as that
    minor. Adds collection, tonic and mode.

    What a chord does depends on the collection held before it, which no window frame can express: the
    state is folded over each sequence's array of tones in SQL.
    """
    home = home_tonic if home_mode == "major" else (home_tonic + 3) % 12
    lookahead = lookahead or (2 if minor_colours else 1)
    w = ordered(keys, order)
    ahead = F.array(*[F.struct(F.lead("mask", k).over(w).alias("m"), F.lead("root", k).over(w).alias("r")) for k in range(1, lookahead + 1)])
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("_x", F.struct("_n", F.col("mask").alias("m"), F.col("root").alias("r"), ahead.alias("ahead")))

    def within(m, table, c):
        return m.bitwiseAND(F.bitwise_not(F.element_at(_literal(table), c + 1))) == 0

    def fits(m, r, c):
        if not minor_colours:
            return within(m, _MAJOR, c)
        return within(m, _MAJOR, c) | within(m, _HARMONIC, c) | ((r == F.pmod(c + 9, F.lit(12))) & within(m, _MELODIC, c))

    def step(state, x):
        every = F.sequence(F.lit(0), F.lit(11))
        shared = lambda c: F.bit_count(x["m"].bitwiseAND(F.element_at(_literal(_MAJOR), c + 1)))
        most = F.array_max(F.transform(every, shared))
        good = F.filter(every, lambda c: fits(x["m"], x["r"], c))
        open_ = F.when(F.size(good) > 0, good).otherwise(F.filter(every, lambda c: shared(c) == most))
        future = lambda c: F.aggregate(x["ahead"], F.lit(0), lambda n, y: n - F.when(y["m"].isNotNull() & fits(y["m"], y["r"], c), 1).otherwise(0))
        ranked = F.array_min(F.transform(open_, lambda c: F.struct(T.fifths_distance(c, state["cur"]).alias("d"), future(c).alias("f"), c.alias("c"))))
        now = F.when(fits(x["m"], x["r"], state["cur"]), state["cur"]).otherwise(ranked["c"])
        return F.struct(now.cast("int").alias("cur"), F.concat(state["out"], F.array(now.cast("int"))).alias("out"))

    start = F.struct(F.lit(home).alias("cur"), F.expr("cast(array() as array<int>)").alias("out"))
    folded = rows.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list("_x")), start, step, lambda s: s["out"]).alias("_c"))
    held = folded.select(*keys, F.posexplode("_c").alias("_n", "collection")).withColumn("_n", F.col("_n") + 1)
    out = run_ids(rows.drop("_x").join(held, [*keys, "_n"]), keys, ["_n"], ["collection"], "_run")
    region = Window.partitionBy(*keys, "_run")
    hits = lambda on: F.sum(on.cast("int")).over(region)
    relative = F.pmod(F.col("collection") + 9, F.lit(12))
    major = hits((F.col("root") == F.col("collection")) & (F.col("class") == "maj"))
    minor = hits((F.col("root") == relative) & F.col("class").isin("min", "m7b5"))
    is_minor = minor > major
    if minor_colours and home_mode == "minor":
        is_minor = is_minor | (F.col("collection") == home)
    out = out.withColumn("_minor", is_minor)
    return out.withColumns({"tonic": F.when(F.col("_minor"), relative).otherwise(F.col("collection")), "mode": F.when(F.col("_minor"), "minor").otherwise("major")}).drop("_n", "_run", "_minor")


def consolidate_dominants(df: DataFrame, keys: list[str], order: list[str], home_tonic: int = 0, home_mode: str = "major") -> DataFrame:
    """A track (tonic, mode) in which chains of two or more dominants falling by fifths, with a ii before
    them, take the key they arrive at: that of the chord they resolve to, else a fifth below the last."""
    w = ordered(keys, order)
    dom = F.col("class") == "dom"
    falls = F.pmod(F.lead("root").over(w) - F.col("root"), F.lit(12)) == 5
    df = df.withColumns({"_falls": F.coalesce(falls, F.lit(False)), "_next_dom": F.coalesce(F.lead(dom).over(w), F.lit(False)), "_nk": F.struct(F.lead("tonic").over(w).alias("tonic"), F.lead("mode").over(w).alias("mode"))})
    df = df.withColumn("_link", dom & F.col("_falls") & F.col("_next_dom"))
    df = df.withColumn("_linked", F.coalesce(F.lag("_link").over(w), F.lit(False)))
    df = df.withColumn("_in", F.col("_link") | F.col("_linked"))
    target = F.pmod(F.col("root") + 5, F.lit(12))
    implied = F.struct(target.alias("tonic"), F.when(target == home_tonic, home_mode).otherwise("major").alias("mode"))
    arrival = F.when(F.col("_linked") & ~F.col("_link"), F.when(F.col("_falls"), F.col("_nk")).otherwise(implied))
    df = df.withColumn("_a", F.last(arrival, ignorenulls=True).over(backwards(keys, order)))
    leads_in = F.col("class").isin("min", "m7b5") & F.col("_falls") & F.coalesce(F.lead("_link").over(w), F.lit(False)) & ~F.coalesce(F.lead("_linked").over(w), F.lit(False))
    df = df.withColumn("_use", F.col("_in") | leads_in)
    pick = lambda c: F.when(F.col("_use"), F.col(f"_a.{c}")).otherwise(F.col(c))
    return df.withColumns({"tonic": pick("tonic"), "mode": pick("mode")}).drop("_falls", "_next_dom", "_nk", "_link", "_linked", "_in", "_a", "_use")


def fitting_scales(df: DataFrame, most: int = 3) -> DataFrame:
    """The scales that hold each chord's tones (24 candidates), nearest to the row's key (tonic, mode)
    first: adds ``scales``, an array of at most ``most`` structs (distance, kind, tonic); kind 1 is melodic
    minor, counted a step farther."""
    home = T.collection_of(T.key_index(F.col("tonic"), F.col("mode")))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("tonic"), F.lit(table[t]).alias("scale")) for k, table in enumerate((_MAJOR, _MELODIC_MINOR)) for t in range(12)])

    def ranked(x):
        good = F.filter(kinds, lambda s: x["mask"].bitwiseAND(F.bitwise_not(s["scale"])) == 0)
        told = F.transform(good, lambda s: F.struct((T.fifths_distance(s["tonic"], x["home"]) + s["kind"]).alias("distance"), s["kind"].alias("kind"), s["tonic"].alias("tonic")))
        return F.slice(F.array_sort(told), 1, most)

    # The row's mask and home are computed once and bound, not once for each scale.
    return df.withColumn("scales", F.get(F.transform(F.array(F.struct(F.col("mask").alias("mask"), home.alias("home"))), ranked), F.lit(0)))


def oracle_keys(df: DataFrame, keys: list[str], section: str, order: list[str], home: str, margin: float = 6.0) -> DataFrame:
    """A key for each section: the sequence's home key (index in column ``home``) unless another is more
    likely by at least ``margin`` nats."""
    c = chroma_by(df, [*keys, section, home], order)
    s = c.withColumn("_s", T.key_scores(F.col("chroma")))
    best = F.array_max("_s")
    at = (F.array_position("_s", best) - 1).cast("int")
    return s.select(*keys, section, F.when(best - F.element_at("_s", (F.col(home) + 1).cast("int")) >= margin, at).otherwise(F.col(home)).alias("key"))
