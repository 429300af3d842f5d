"""Timelines of labels: refinement of two, tempo maps, midpoints, bars, and events counted against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.operators.blocks import tasks_for
from ostinato.operators.joins import as_of, first_containing
from ostinato.operators.sequences import ordered, run_ids


def spans(df: DataFrame, keys: list[str], beat: str, end: str, label: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Chord slots as merged spans: keys, the ``label`` columns, start and end.

    A slot lasts until the next one, the last until ``end`` (its sequence's length). Slots whose first label column is
    null are left out, and end the span before them; equal neighbours that touch are one span.
    """
    d = df.withColumn("_end", F.coalesce(F.lead(beat).over(ordered(keys, [beat])), F.col(end))).filter(F.col(label[0]).isNotNull())
    w = ordered(keys, [beat])
    same = F.abs(F.lag("_end").over(w) - F.col(beat)) < tolerance
    for c in label:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    d = d.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_run", *label).agg(F.min(beat).alias("start"), F.max("_end").alias("end")).drop("_run")


def refined(a: DataFrame, b: DataFrame, keys: list[str], value: str, outside: str = "N") -> DataFrame:
    """The common refinement of two timelines (start, end, ``value``): keys, start, end, a and b.

    Both sides cover the time of either; where a side has no interval it is ``outside``. Each side's intervals
    don't overlap. Edges of both are united, and each side looked up as of every edge: no pairs of intervals are made.
    """
    edges = None
    for side in (a, b):
        for c in ("start", "end"):
            e = side.select(*keys, F.col(c).cast("double").alias("start"))
            edges = e if edges is None else edges.union(e)
    cells = edges.distinct().withColumn("end", F.lead("start").over(ordered(keys, ["start"]))).filter("end is not null")
    for name, side in (("a", a), ("b", b)):
        held = side.select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("_until"), F.col(value).alias(name))
        cells = as_of(cells, held, keys, "start", ["_until", name])
        cells = cells.withColumn(name, F.when(F.col("start") < F.col("_until"), F.col(name)).otherwise(F.lit(outside))).drop("_until")
    return cells


def weighted_confusion(a: DataFrame, b: DataFrame, keys: list[str], value: str, outside: str = "N") -> DataFrame:
    """Time that each pair of labels (a, b) shares over all sequences, and its share of the time of a."""
    out = refined(a, b, keys, value, outside).groupBy("a", "b").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    return out.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy("a")))


def ticks_to_seconds(events: DataFrame, tempos: DataFrame, keys: list[str], tick: str, bpm: str, quarter: int = 960) -> DataFrame:
    """``events`` with seconds: ticks counted through the tempo map (``tick``, ``bpm``), whose first row begins the song."""
    w = ordered(keys, [tick])
    ahead = F.lead(tick).over(w) - F.col(tick)
    t = tempos.withColumn("_s", ahead / quarter * (60.0 / F.col(bpm))).withColumn("_at", F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.select(*keys, tick, F.col(tick).alias("_from"), F.col(bpm).cast("double").alias("_bpm"), "_at")
    out = as_of(events, t, keys, tick, ["_from", "_bpm", "_at"])
    return out.withColumn("seconds", F.col("_at") + (F.col(tick) - F.col("_from")) / quarter * (60.0 / F.col("_bpm"))).drop("_from", "_bpm", "_at")


def at_midpoints(segments: DataFrame, labels: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Segments (start, end) with the values of the label interval at their middle; null where there is none."""
    s = segments.withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    return first_containing(s, labels, keys, "_mid", values).drop("_mid")


def bar_modes(df: DataFrame, keys: list[str], beat: str, symbol: str, beats_per_bar: int) -> DataFrame:
    """(keys, bar, symbol): the commonest symbol of each bar, the first heard on ties; a bar without symbols has null."""
    bar = F.floor(F.col(beat) / beats_per_bar).cast("long").alias("bar")
    n = df.groupBy(*keys, bar, symbol).agg(F.count(symbol).alias("n"), F.min(beat).alias("seen"))
    return n.groupBy(*keys, "bar").agg(F.max_by(symbol, F.struct("n", -F.col("seen"))).alias(symbol))


def durations_after(df: DataFrame, keys: list[str], order: list[str], degree: str, kind: str, duration: str, most: int = 12) -> DataFrame:
    """How long tonic chords last (rounded down to ``most``) after a ii and a V, and otherwise: resolved, d, n and share.

    Tonic chords are maj or min on degree 0; resolved ones follow a dom on 7, which follows a min on 2."""
    w = ordered(keys, order)
    was = lambda k, d, q: F.coalesce((F.lag(degree, k).over(w) == d) & (F.lag(kind, k).over(w) == q), F.lit(False))
    d = df.withColumn("resolved", was(1, 7, "dom") & was(2, 2, "min"))
    d = d.filter((F.col(degree) == 0) & F.col(kind).isin("maj", "min"))
    n = d.groupBy("resolved", F.least(F.col(duration), F.lit(most)).alias("d")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("resolved")))


def interval_by_phase(notes: DataFrame, roots: DataFrame, keys: list[str], at: str, pitch: str, beats_per_bar: int, tolerance: float = 0.25) -> DataFrame:
    """Shares of root, third, fifth, seventh and other intervals of notes above the chord of their beat, by the beat's phase.

    ``at`` is in beats; a note farther than ``tolerance`` from a beat, or on a beat without a root, doesn't count.
    ``roots`` has (keys, beat, root)."""
    n = notes.withColumn("beat", F.bround(at).cast("long")).filter(F.abs(F.col(at) - F.col("beat")) <= tolerance)
    n = n.join(roots.filter("root is not null"), [*keys, "beat"])
    i = F.pmod(F.col(pitch) - F.col("root"), F.lit(12))
    part = lambda *x: F.avg(i.isin(*x).cast("double"))
    out = n.groupBy(F.pmod("beat", F.lit(beats_per_bar)).alias("phase")).agg(
        part(0).alias("root"), part(3, 4).alias("third"), part(7).alias("fifth"), part(10, 11).alias("seventh"), F.count("*").alias("n")
    )
    return out.withColumn("other", 1 - F.col("root") - F.col("third") - F.col("fifth") - F.col("seventh"))


def first_note_agreement(notes: DataFrame, roots: DataFrame, keys: list[str], at: str, pitch: str, beats_per_bar: int, tolerance: float = 0.15) -> DataFrame:
    """Per sequence the share of notes that begin a bar (within ``tolerance`` beats after it) on the bar's root; ``roots``
    has (keys, bar, root). Sequences without such notes are absent."""
    n = notes.withColumn("bar", F.floor(F.col(at) / beats_per_bar).cast("long")).filter(F.col(at) - F.col("bar") * beats_per_bar < tolerance)
    n = n.join(roots.filter("root is not null"), [*keys, "bar"])
    return n.groupBy(*keys).agg(F.avg((F.pmod(pitch, F.lit(12)) == F.col("root")).cast("double")).alias("agreement"), F.count("*").alias("n"))


def boundary_hits(found: DataFrame, true: DataFrame, keys: list[str], at: str, tolerance: float) -> DataFrame:
    """Precision, recall and F by true boundaries alone: those with a found one within ``tolerance`` are hits of both, so that
    precision can exceed 1. Sequences with boundaries on either side are returned."""
    from ostinato.operators.joins import nearest

    near = nearest(true.select(*keys, at), found.select(*keys, at), keys, at, [])
    hit = F.coalesce(F.sum((F.abs(F.col(at) - F.col("matched")) <= tolerance).cast("long")), F.lit(0))
    t = near.groupBy(*keys).agg(F.count("*").alias("_t"), hit.alias("_h"))
    both = t.join(found.groupBy(*keys).agg(F.count("*").alias("_f")), keys, "full").fillna(0, ["_t", "_h", "_f"])
    p, r = F.col("_h") / (F.col("_f") + 1e-9), F.col("_h") / (F.col("_t") + 1e-9)
    return both.select(*keys, p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + 1e-9)).alias("f1"))


def corrections_by(df: DataFrame, predicted: str, corrected: str, confidence: str, spread: str, sure: float = 0.7, wide: int = 3) -> DataFrame:
    """Corrections of labels by the pair (predicted, corrected): n, those made though the confidence was over ``sure``, and
    those that changed at least ``wide`` further labels; pairs of equal labels don't count."""
    d = df.filter(F.col(predicted) != F.col(corrected))
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return d.groupBy(predicted, corrected).agg(F.count("*").alias("n"), flag(F.col(confidence) > sure).alias("sure_but_wrong"), flag(F.col(spread) >= wide).alias("wide"))


def quiet_segments(df: DataFrame, segments: DataFrame, keys: list[str], beat: str, energy: str, share: float = 0.35) -> DataFrame:
    """Segments (start, end in beats) with whether their mean energy is under ``share`` of the median positive one of the sequence."""
    middle = df.filter(F.col(energy) > 0).groupBy(*keys).agg(F.median(energy).alias("_m"))
    s = segments.withColumn(beat, F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    mean = s.join(df.select(*keys, beat, energy), [*keys, beat], "left").groupBy(*keys, "start", "end").agg(F.avg(F.coalesce(energy, F.lit(0.0))).alias("energy"))
    return mean.join(middle, keys, "left").withColumn("quiet", F.coalesce(F.col("energy") < share * F.col("_m"), F.lit(False))).drop("_m")


def snapped_segments(times: DataFrame, beats: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Segments of beat numbers cut at the beats nearest to ``times`` (the earlier on ties): keys, start, end; they cover all beats."""
    from ostinato.operators.joins import nearest

    numbered = beats.select(*keys, at, (F.row_number().over(ordered(keys, [at])) - 1).alias("start"))
    cuts = nearest(times.select(*keys, at), numbered, keys, at, ["start"]).select(*keys, "start").filter("start is not null")
    whole = numbered.groupBy(*keys).agg((F.max("start") + 1).alias("_n"))
    cuts = cuts.union(whole.select(*keys, F.lit(0).alias("start"))).distinct()
    out = cuts.withColumn("end", F.lead("start").over(ordered(keys, ["start"]))).join(whole, keys)
    return out.select(*keys, "start", F.coalesce("end", "_n").alias("end"))


def repeated(df: DataFrame, keys: list[str], index: str, size: str, target: str) -> DataFrame:
    """Rows of a block of ``size`` repeated in turn until there are ``target``: adds slot (from 0) and pass (from 1)."""
    passes = F.ceil(F.col(target) / F.col(size)).cast("long")
    out = df.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(passes, F.lit(1)))))
    return out.withColumn("slot", (F.col("pass") - 1) * F.col(size) + F.col(index)).filter(F.col("slot") < F.col(target))


def letters(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """One row a sequence: its form, the labels of its runs joined, and the number of runs."""
    r = run_ids(df, keys, order, [label]).groupBy(*keys, "run", label).count()
    # A sequence's runs of sections are few; the list is as long as its form.
    return r.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", label))), lambda x: x[label]), "").alias("form"), F.count("*").alias("runs"))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal elements by position, over the longer array; 0 where both are empty."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull()), lambda ok: ok))
    return F.coalesce(same / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def along_diagonals(pairs: DataFrame, keys: list[str], value: str, reach: int = 3) -> DataFrame:
    """Similarities of pairs (i, j) averaged with those up to ``reach`` rows before and after on the same diagonal, so
    that repeated passages, not single rows, stand out. Pairs that aren't given don't count."""
    w = Window.partitionBy(*keys, F.col("j") - F.col("i")).orderBy("i").rangeBetween(-reach, reach)
    return pairs.withColumn(value, F.avg(value).over(w))


def bar_distributions(df: DataFrame, keys: list[str], middle: str, values: list[str], length: float, anchor: float) -> DataFrame:
    """Distributions of rows averaged over the bars of a grid (``length``, from ``anchor``) that hold their ``middle``, and
    scaled to sum to 1: keys, bar (from 0; what lies before the grid goes) and ``values``. Bars without rows up to the last have zeros."""
    bar = F.floor((F.col(middle) - anchor) / length).cast("long").alias("bar")
    d = df.select(*keys, bar, *values).filter("bar >= 0").groupBy(*keys, "bar").agg(*[F.avg(v).alias(v) for v in values])
    last = d.groupBy(*keys).agg(F.max("bar").alias("_n")).withColumn("bar", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n")))).drop("_n")
    d = last.join(d, [*keys, "bar"], "left").fillna(0.0, values)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return d.withColumn("_t", total).withColumns({v: F.when(F.col("_t") > 1e-9, F.col(v) / F.col("_t")).otherwise(F.col(v)) for v in values}).drop("_t")


def grid_period(df: DataFrame, keys: list[str], place: str, curve: str, grids: tuple[int, ...] = (4, 2), share: float = 0.6) -> DataFrame:
    """(keys, period): the coarsest grid off which a curve is at most ``share`` of what it is on it, at the phase that parts
    them most, else 1. ``place`` counts a section's rows from 0; its first row doesn't count, nor grids as long as the rest."""
    d = df.filter(F.col(place) > 0).select(*keys, place, F.col(curve).alias("_x"), F.explode(F.array(*map(F.lit, grids))).alias("g"))
    n = d.groupBy(*keys, "g", F.pmod(place, F.col("g")).alias("p")).agg(F.sum("_x").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "g")
    n = n.withColumns({"on": F.col("s") / F.col("n"), "off": F.coalesce((F.sum("s").over(w) - F.col("s")) / F.nullif(F.sum("n").over(w) - F.col("n"), F.lit(0)), F.lit(0.0)), "all": F.sum("n").over(w)})
    best = n.filter("all >= g + 1").groupBy(*keys, "g").agg(F.max_by(F.struct("on", "off"), F.struct(F.col("on") - F.col("off"), -F.col("p"))).alias("b"))
    found = best.filter(F.col("b.off") <= share * F.col("b.on") + 1e-9).groupBy(*keys).agg(F.max("g").alias("period"))
    return df.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("period", F.lit(1)).alias("period"))


def transposed_copies(df: DataFrame, root: str, by: str = "by") -> DataFrame:
    """Every row twelve times, its root moved by 0 to 11 semitones (column ``by``)."""
    out = df.withColumn(by, F.explode(F.sequence(F.lit(0), F.lit(11))))
    return out.withColumn(root, F.pmod(F.col(root) + F.col(by), F.lit(12)))


def inconsistent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups that should agree on a value but don't: keys, the number of its different values, and of rows."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("values"), F.count("*").alias("n")).filter("values > 1")


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in ``done``, so that an interrupted batch goes on where it stopped."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def split_by_fast_runs(chords: DataFrame, labels: DataFrame, period: float, song: str = "song", fast: float = 2.75, least: int = 4, shortest: float = 1.4) -> DataFrame:
    """``chords`` (song, t0, t1, label) with stretches of quick changes taken from ``labels`` (same columns), and ``added``.

    A run is at least ``least`` labels in a row that each last less than ``fast`` periods. Chords whose middle lies in a
    run, both ends included, go, except those labelled N; the run's labels that last ``shortest`` periods or more take
    their place, except N and X. A song of which no chord goes stays as it is. ``labels`` don't overlap; rows with null times or a null song
    never match. A song's rows are sorted in one task; no pairs are made. Songs are dealt out among tasks by the number of labels.
    """
    tasks = tasks_for(labels)
    order = Window.partitionBy(song).orderBy("t0", "t1", "label")
    quick = F.coalesce(F.col("t1") - F.col("t0") < F.lit(fast * period), F.lit(False))
    timed = labels.where(F.col("t0").isNotNull() & F.col("t1").isNotNull()).select(song, "t0", "t1", "label", quick.alias("quick")).repartition(tasks, song)
    numbered = timed.withColumn("place", F.row_number().over(order))
    island = F.col("place") - F.row_number().over(Window.partitionBy(song, "quick").orderBy("t0", "t1", "label"))
    of_run = Window.partitionBy(song, "island")
    quick_ones = numbered.withColumn("island", island).where("quick").withColumn("size", F.count("*").over(of_run)).where(F.col("size") >= least)
    runs = quick_ones.groupBy(song, "island").agg(F.min("t0").alias("at"), F.max("t1").alias("hi"))
    middle = (F.col("t0") + F.col("t1")) / 2
    both = chords.select(song, "t0", "t1", "label", middle.alias("at"), F.lit(None).cast("double").alias("hi"), F.lit(1).alias("kind")).unionByName(
        runs.select(song, F.col("at").cast("double").alias("at"), F.col("hi").cast("double").alias("hi"), F.lit(0).alias("kind")), allowMissingColumns=True
    ).repartition(tasks, song)
    reach = F.max("hi").over(Window.partitionBy(song).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    goes = F.coalesce((reach >= F.col("at")) & ~F.col("label").eqNullSafe(F.lit("N")) & F.col(song).isNotNull(), F.lit(False))
    judged = both.withColumn("goes", goes).where("kind = 1")
    changed = judged.where("goes").select(song).distinct()
    new = quick_ones.where(~F.coalesce(F.col("label").isin("N", "X"), F.lit(True)) & (F.col("t1") - F.col("t0") >= F.lit(shortest * period)))
    kept = judged.where("not goes").select(song, "t0", "t1", "label", F.lit(False).alias("added"))
    return kept.unionByName(new.join(changed, song, "left_semi").select(song, "t0", "t1", "label", F.lit(True).alias("added")))
