"""Constraints that users put on a song: tied spans with pooled evidence, tied segments, confirmed chords, and merges found by agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField
from pyspark.sql.window import Window

from ostinato.operators import joins as J
from ostinato.operators.blocks import join_same
from ostinato.operators.folds import fold_sorted
from ostinato.operators.sequences import ordered

# Spans that make a pool, the sums between which a row counts as a distribution, and what agreement must exceed.
LEAST_SPANS, SUM_LOW, SUM_HIGH, AGREE = 2, 0.5, 1.5, 0.75


def spans_to_beats(spans: DataFrame, grid: DataFrame, keys: list[str], beat: str = "beat", time: str = "time") -> DataFrame:
    """``spans`` (keys, group, span, t0, t1) with ``first``, the beat nearest to t0 (the earlier of two), and ``beats``, how many it lasts.

    That number is the span's duration over the grid's median spacing, rounded once (halves up), and 1 at least; so equal spans have equal numbers
    wherever they begin. ``grid`` (keys, beat, time) has two beats of a song at least; spans of songs without a spacing are left out.
    """
    w = ordered(keys, [time])
    gaps = grid.select(*keys, (F.lead(time).over(w) - F.col(time)).alias("_g")).filter("_g is not null")
    period = gaps.groupBy(*keys).agg(F.median("_g").alias("_period")).filter("_period > 1e-9")
    at = J.nearest(spans.withColumn(time, F.col("t0").cast("double")), grid.select(*keys, F.col(time).cast("double").alias(time), F.col(beat).alias("first")), keys, time, ["first"])
    out = join_same(at.drop(time, "matched"), period, keys)
    return out.withColumn("beats", F.greatest(F.lit(1), F.floor((F.col("t1") - F.col("t0")) / F.col("_period") + 0.5)).cast("long")).drop("_period")


def pool_report(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Every span (keys, group, span, first, beats) with ``expected``, the commonest number of beats in its group (the larger of equals), ``used``,
    ``delta`` and the group's ``status``: pooled, partial, unpoolable (fewer than two spans agree) or single (a group of one span)."""
    n = spans.groupBy(*keys, "group", "beats").agg(F.count("*").alias("_n"))
    mode = n.groupBy(*keys, "group").agg(F.max_by(F.struct("beats", "_n"), F.struct("_n", "beats")).alias("_m"), F.sum("_n").alias("_all"), F.count("*").alias("_kinds"))
    mode = mode.select(*keys, "group", F.col("_m.beats").alias("expected"), F.col("_m._n").alias("_agree"), "_all", "_kinds")
    d = join_same(spans, mode, [*keys, "group"])
    status = F.when(F.col("_all") < LEAST_SPANS, "single").when(F.col("_agree") < LEAST_SPANS, "unpoolable").when(F.col("_kinds") > 1, "partial").otherwise("pooled")
    d = d.withColumn("status", status)
    used = F.col("status").isin("pooled", "partial") & (F.col("beats") == F.col("expected"))
    return d.select(*keys, "group", "span", "first", "beats", "expected", (F.col("beats") - F.col("expected")).alias("delta"), used.alias("used"), "status")


def pool_evidence(spans: DataFrame, evidence: DataFrame, keys: list[str], value: str, beat: str = "beat", must_apply: bool = False) -> DataFrame:
    """``evidence`` (keys, beat and an array ``value``) with pooled arrays: each place of tied spans holds the sum over them.

    Spans are those of :func:`spans_to_beats`; of a group's the ones that :func:`pool_report` uses count. An offset that a single span has a beat for
    keeps its own. Where the first span's array is a distribution (sums to 0.5 to 1.5), the sum is scaled to 1. Every group
    pools what was there before; of groups that share a beat the last by ``group`` counts. With ``must_apply`` a song with groups none of which can be
    pooled raises an error instead of returning as it was. ``pooled`` tells the changed rows.
    """
    report = pool_report(spans, keys)
    if must_apply:
        failed = report.filter("status <> 'single'").groupBy(*keys).agg(F.max(F.col("used").cast("int")).alias("_ok"), F.array_sort(F.collect_set("beats")).alias("_seen")).filter("_ok = 0")
        why = F.concat(F.lit("tied spans have no common number of beats: "), F.array_join(F.col("_seen").cast("array<string>"), ", "))
        failed = failed.select(*keys, F.raise_error(why).cast("boolean").alias("_failed"))
    used = report.filter("used").select(*keys, "group", "span", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("beats") - 1)).alias("_offset"))
    used = used.withColumn(beat, (F.col("first") + F.col("_offset")).cast(evidence.schema[beat].dataType))
    rows = join_same(used.drop("first"), evidence.select(*keys, beat, F.col(value).alias("_v")), [*keys, beat])
    place = [*keys, "group", "_offset"]
    shape = rows.groupBy(*place).agg(F.count("*").alias("_n"), F.min_by("_v", F.struct(beat, "span")).alias("_own")).filter("_n >= 2")
    sums = join_same(rows, shape.select(*place), place).select(*place, F.posexplode("_v").alias("_i", "_x")).groupBy(*place, "_i").agg(F.sum("_x").alias("_x"))
    sums = sums.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_s")).select(*place, F.col("_s._x").alias("_sum"))
    sums = join_same(sums, shape, place)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    is_share = (add(F.col("_own")) > SUM_LOW) & (add(F.col("_own")) < SUM_HIGH) & (add(F.col("_sum")) > 1e-9)
    sums = sums.select(*place, F.when(is_share, F.transform("_sum", lambda x: x / add(F.col("_sum")))).otherwise(F.col("_sum")).alias("_pooled"))
    new = join_same(rows.drop("_v"), sums, place).groupBy(*keys, beat).agg(F.max_by("_pooled", "group").alias("_pooled"))
    out = join_same(evidence, new, [*keys, beat], "left")
    out = out.withColumns({"pooled": F.col("_pooled").isNotNull(), value: F.coalesce("_pooled", value)}).drop("_pooled")
    if must_apply:
        out = join_same(out, failed, keys, "left").withColumn("pooled", F.coalesce("_failed", "pooled")).drop("_failed")
    return out


def tied_segments(spans: DataFrame, segments: DataFrame, keys: list[str], width: float) -> DataFrame:
    """The k-th segment of every tied span: (keys, group, span, k, segment, expected, covered, tied).

    ``spans`` (keys, group, span, start, end) and ``segments`` (keys, segment, start, end) are in one unit, ends exclusive; a span covers the segments that
    it overlaps. Where spans of a group cover different numbers of segments none of it is tied: ``expected`` is what the first span has, and
    ``covered`` what this one has. A span that covers none has one row without k. Groups of one span aren't ties.
    """
    many = spans.groupBy(*keys, "group").agg(F.count("*").alias("_spans")).filter("_spans >= 2").drop("_spans")
    s = join_same(spans, many, [*keys, "group"]).select(*keys, "group", "span", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    g = segments.select(*keys, "segment", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = J.overlapping(s, g, keys, width)
    met = met.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "group", "span").orderBy("b_start", "segment")) - 1)
    out = join_same(s.select(*keys, "group", "span"), met.select(*keys, "group", "span", "k", "segment"), [*keys, "group", "span"], "left")
    sizes = out.groupBy(*keys, "group", "span").agg(F.count("k").alias("covered"))
    all_ = sizes.groupBy(*keys, "group").agg(F.min_by("covered", "span").alias("expected"), (F.min("covered") == F.max("covered")).alias("_even"))
    out = join_same(join_same(out, sizes, [*keys, "group", "span"]), all_, [*keys, "group"])
    return out.select(*keys, "group", "span", "k", "segment", "expected", "covered", (F.col("_even") & F.col("k").isNotNull()).alias("tied"))


def clamps(confirms: DataFrame, segments: DataFrame, keys: list[str], width: float) -> DataFrame:
    """``segments`` with the clamp_root, clamp_class and clamp_bonus of the confirm (keys, place, start, end, root, class, bonus) that overlaps
    them, the last by ``place`` of several; null without any."""
    c = confirms.select(*keys, "place", F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.struct("root", "class", "bonus").alias("_c"))
    g = segments.select(*keys, "segment", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    last = J.overlapping(c, g, keys, width).groupBy(*keys, "segment").agg(F.max_by("_c", "place").alias("_c"))
    out = join_same(segments, last, [*keys, "segment"], "left")
    return out.withColumns({"clamp_root": F.pmod(F.col("_c.root"), F.lit(12)), "clamp_class": F.col("_c.class"), "clamp_bonus": F.col("_c.bonus")}).drop("_c")


def merge_candidates(sections: DataFrame, chords: DataFrame, frames: DataFrame, keys: list[str], least: float = AGREE) -> DataFrame:
    """Pairs of sections of one label and number of bars that could be pooled: (keys, a, b, agreement, likeness, fires).

    ``sections`` are (keys, section, label, bars, start, end) in seconds, ``chords`` (keys, start, end, symbol) don't overlap, ``frames`` (keys, at, value) hold
    arrays. Each section is sampled at four places a bar (four at least), in the middle of equal parts: ``agreement`` is the share of places with equal,
    known symbols, ``likeness`` the mean cosine of the parts' mean frames less their own means, over parts where both sides have
    frames that vary (0 without any, negative ones 0). A pair fires if both exceed ``least``. Pairs are returned where agreement exceeds it; pairs that differ in so few
    places agree in one of some pieces wholly, so only those are compared, not all pairs of a label.
    """
    s = sections.filter("end > start").withColumn("_n", F.greatest(F.lit(4), F.coalesce(F.col("bars"), F.lit(1)).cast("int") * 4))
    part = s.select(*keys, "section", "label", "bars", "_n", "start", ((F.col("end") - F.col("start")) / F.col("_n")).alias("_w"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("k"))
    at = part.withColumn("at", F.col("start") + (F.col("k") + 0.5) * F.col("_w"))
    named = J.first_containing(at, chords.select(*keys, "start", "end", F.col("symbol").alias("_symbol")), keys, "at", ["_symbol"])
    # A piece of the places: as many as the most places that may differ, and one.
    most = F.ceil(F.col("_n") * (1 - least)).cast("int") - 1
    named = named.withColumn("_pieces", most + 1).withColumn("_j", F.floor(F.col("k") * F.col("_pieces") / F.col("_n")).cast("int"))
    group = [*keys, "label", "bars", "section"]
    pieces = named.groupBy(*group, "_j").agg(F.array_sort(F.collect_list(F.struct("k", "_symbol"))).alias("_x"), F.count_if(F.col("_symbol").isNull()).alias("_none")).filter("_none = 0").withColumn("_x", F.col("_x._symbol"))
    a, b = (pieces.select(*keys, "label", "bars", "_j", "_x", F.col("section").alias(c)) for c in ("a", "b"))
    pairs = join_same(a, b, [*keys, "label", "bars", "_j", "_x"]).filter("a < b").select(*keys, "a", "b").distinct()
    symbols = named.select(*keys, "section", "k", "_n", "_symbol")
    left = join_same(pairs, symbols.withColumnsRenamed({"section": "a", "_symbol": "_sa"}), [*keys, "a"])
    met = join_same(left, symbols.drop("_n").withColumnsRenamed({"section": "b", "_symbol": "_sb"}), [*keys, "b", "k"])
    agree = met.groupBy(*keys, "a", "b").agg((F.count_if(F.col("_sa") == F.col("_sb")) / F.first("_n")).alias("agreement")).filter(F.col("agreement") > least)
    # Frames are pooled by part for the sections in question only.
    asked = agree.select(*keys, F.col("a").alias("section")).union(agree.select(*keys, F.col("b").alias("section"))).distinct()
    cells = join_same(part, asked, [*keys, "section"]).select(*keys, "section", "k", (F.col("start") + F.col("k") * F.col("_w")).alias("start"), (F.col("start") + (F.col("k") + 1) * F.col("_w")).alias("end"))
    held = J.first_containing(frames.select(*keys, "at", "value"), cells, keys, "at", ["section", "k"]).filter("section is not null")
    mean = held.select(*keys, "section", "k", F.posexplode("value").alias("_i", "_x")).groupBy(*keys, "section", "k", "_i").agg(F.avg("_x").alias("_x"))
    vector = mean.groupBy(*keys, "section", "k").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v")).withColumn("_v", F.col("_v._x"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    vector = vector.withColumn("_v", F.transform("_v", lambda x: x - total(F.col("_v")) / F.size("_v"))).withColumn("_norm", F.sqrt(total(F.transform("_v", lambda x: x * x)))).filter("_norm >= 1e-9")
    left = join_same(agree, vector.withColumnsRenamed({"section": "a", "_v": "_va", "_norm": "_na"}), [*keys, "a"])
    met = join_same(left, vector.withColumnsRenamed({"section": "b", "_v": "_vb", "_norm": "_nb"}), [*keys, "b", "k"])
    cosine = total(F.zip_with("_va", "_vb", lambda x, y: x * y)) / (F.col("_na") * F.col("_nb"))
    alike = met.groupBy(*keys, "a", "b").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(cosine))).alias("likeness"))
    out = join_same(agree, alike, [*keys, "a", "b"], "left").withColumn("likeness", F.coalesce("likeness", F.lit(0.0)))
    return out.withColumn("fires", F.col("likeness") > least)


def free_of(candidates: DataFrame, taken: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Rows of ``candidates`` (keys, id, start, end; an id may have several spans) of whose id no span overlaps one of ``taken`` (keys, start, end)."""
    a = candidates.select(*keys, "id", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = taken.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    hit = J.overlapping(a, b, keys, width).select(*keys, "id").distinct()
    return join_same(candidates, hit, [*keys, "id"], "left_anti")


def disjoint(intervals: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """The most intervals (keys, id, start, end; end exclusive) that don't overlap: by their ends, the smaller start and id first among equals, each is
    taken that begins no earlier than the last taken one ended. One pass over a song's sorted intervals, which holds one end."""

    def make():
        last: list[float] = []

        def step(row):
            if not last or row.start >= last[0]:
                last[:] = [row.end]
                return [(getattr(row, id_), row.start, row.end)]
            return ()

        return step, list

    chosen = intervals.select(*keys, id_, "start", "end").filter("end > start")
    fields = [chosen.schema[id_], StructField("start", chosen.schema["start"].dataType), StructField("end", chosen.schema["end"].dataType)]
    return fold_sorted(chosen, keys, ["end", "start", id_], make, fields)
