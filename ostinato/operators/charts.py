"""Folding of charts: bar loops with first and second endings, repeated groups of sections, letters by content, names of forms.

Bars are rows (keys, index, label of their section, content); passes, blocks and sections are compared by joins on their
contents, so a song's bars are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField
from pyspark.sql.window import Window

from ostinato.operators.blocks import join_same
from ostinato.operators.folds import fold_sorted
from ostinato.operators.sequences import ordered

# Bars of a loop, the share of equal bars from which blocks are alike, the share of blocks that a loop explains,
# that of a repeated group of sections, the bars an ending has at most, and the sections that can be read at once.
PERIODS, ALIKE, DOMINANT, GROUP_ALIKE, LONGEST_TAIL, READABLE = (2, 4, 8), 0.7, 0.6, 0.85, 2, 12


def is_form_label(label: Column) -> Column:
    """Letters of a form: one or two characters without a space; anything else (an intro, a key's name) is none."""
    return F.coalesce((F.length(label) > 0) & (F.length(label) <= 2) & ~F.contains(label, F.lit(" ")), F.lit(False))


def _runs(rows: DataFrame, keys: list[str], index: str, label: str) -> DataFrame:
    """Rows of form labels with ``run``, a maximal stretch of them (numbered by its first index), and ``k``, the place in it."""
    w = ordered(keys, [index])
    form = is_form_label(F.col(label))
    out = rows.withColumn("_form", form).withColumn("_before", F.coalesce(F.lag("_form").over(w), F.lit(False)))
    out = out.filter("_form").withColumn("run", F.last(F.when(~F.col("_before"), F.col(index)), ignorenulls=True).over(w))
    return out.withColumn("k", F.col(index) - F.col("run")).drop("_form", "_before")


def _equal(a: Column, b: Column) -> Column:
    """How many places of two arrays are equal."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))


def _needed(frac: float, n: int) -> int:
    """The least number of equal ones among n whose share is at least ``frac``."""
    return next(k for k in range(n + 1) if k / n >= frac)


def _blocks(bars: DataFrame, keys: list[str], index: str, label: str, content: str, periods: tuple[int, ...]) -> DataFrame:
    """(keys, run, m, period, block, start, bars) of all whole blocks of every period that fits twice."""
    rows = _runs(bars.select(*keys, F.col(index).cast("long").alias("_i"), F.col(label).alias("_label"), F.col(content).alias("_c")), keys, "_i", "_label")
    sizes = rows.groupBy(*keys, "run").agg(F.count("*").alias("m"))
    rows = join_same(rows, sizes, [*keys, "run"]).withColumn("period", F.explode(F.array(*map(F.lit, periods))))
    rows = rows.filter((F.col("period") * 2 <= F.col("m")) & (F.col("k") < F.expr("m div period") * F.col("period")))
    found = rows.groupBy(*keys, "run", "m", "period", F.expr("k div period").alias("block")).agg(F.min("_i").alias("start"), F.array_sort(F.collect_list(F.struct("k", "_c"))).alias("_x"))
    return found.select(*keys, "run", "m", "period", "block", "start", F.col("_x._c").alias("bars"))


def bar_loops(bars: DataFrame, keys: list[str], index: str, label: str, content: str, frac: float = ALIKE, dominance: float = DOMINANT, periods: tuple[int, ...] = PERIODS) -> tuple[DataFrame, DataFrame]:
    """The loops of a song's form, and their passes: (keys, run, m, period, reps, hits, bars) and (keys, run, pass, start, bars).

    A run is a stretch of bars under form letters, named by its first bar; ``index`` counts bars without gaps. Its blocks of
    ``period`` bars are alike if ``frac`` of their bars are equal in place. The block that most are alike to (the first of equals) is the loop if
    it explains ``dominance`` of them; the period with the largest share wins, the shortest of equals. Runs without such a loop are
    absent: a body of verse and chorus isn't forced into one. Bars after the last whole pass belong to no pass. Null contents are equal.

    Only different contents meet, where one of their pieces is equal: two blocks that differ in d bars agree in one of d + 1 pieces at least.
    """
    if not 0 < frac <= 1:
        raise ValueError("frac must lie above 0 and at most at 1")
    blocks = _blocks(bars, keys, index, label, content, periods)
    group = [*keys, "run", "period"]
    kinds = blocks.groupBy(*group, "bars").agg(F.count("*").alias("n"), F.min("block").alias("first"))

    def cuts(p: int) -> list[tuple[int, int]]:
        pieces = p - _needed(frac, p) + 1
        edge = [p * j // pieces for j in range(pieces + 1)]
        return list(zip(edge[:-1], edge[1:], strict=True))

    def pieces(c: str) -> Column:
        by_period = F.lit(None)
        for p in periods:
            parts = F.array(*[F.slice(F.col(c), a + 1, b - a) for a, b in cuts(p)])
            by_period = F.when(F.col("period") == p, parts).otherwise(by_period)
        return by_period

    least = F.coalesce(*[F.when(F.col("period") == p, _needed(frac, p)) for p in periods])
    mine = kinds.withColumn("_pieces", pieces("bars")).select(*group, F.col("bars").alias("a"), "_pieces", F.posexplode("_pieces").alias("_j", "_piece"))
    theirs = mine.select(*group, F.col("a").alias("b"), F.col("_pieces").alias("_others"), "_j", "_piece")
    theirs = join_same(theirs, kinds.select(*group, F.col("bars").alias("b"), "n"), [*group, "b"])
    met = join_same(mine, theirs, [*group, "_j", "_piece"])
    same = F.zip_with("_pieces", "_others", lambda x, y: x.eqNullSafe(y))
    met = met.filter((F.array_position(same, True) - 1 == F.col("_j")) & (_equal(F.col("a"), F.col("b")) >= least))
    hits = met.groupBy(*group, F.col("a").alias("bars")).agg(F.sum("n").alias("hits"))
    best = join_same(hits, kinds, [*group, "bars"]).groupBy(*group).agg(F.max_by(F.struct("hits", "bars"), F.struct("hits", -F.col("first"))).alias("_b"))
    sizes = blocks.groupBy(*group).agg(F.first("m").alias("m"), F.count("*").alias("reps"))
    best = join_same(best, sizes, group).select(*group, "m", "reps", F.col("_b.hits").alias("hits"), F.col("_b.bars").alias("bars"))
    best = best.filter(F.col("hits") / F.col("reps") >= dominance)
    pick = best.groupBy(*keys, "run").agg(F.max_by(F.struct("m", "period", "reps", "hits", "bars"), F.struct(F.col("hits") / F.col("reps"), -F.col("period"))).alias("_p"))
    loops = pick.select(*keys, "run", "_p.*")
    passes = join_same(blocks.drop("m"), loops.select(*group), group, "left_semi").select(*keys, "run", F.col("block").alias("pass"), "start", "bars")
    return loops, passes


def endings(passes: DataFrame, keys: list[str], frac: float = ALIKE, longest: int = LONGEST_TAIL) -> DataFrame:
    """``passes`` (keys, pass from 0, bars) with ``tail``, the bars of an ending, and ``variant``, which ending the pass has (from 0, in order
    of first appearance); both null where a group's passes have no endings.

    They have if their bars before the tail agree with those of pass 0 (``frac`` of them in each pass) and there are two different tails at
    least; the shortest such tail, of one bar up to ``longest`` and less than the pass, counts. Passes of different lengths have none.
    """
    base = passes.filter(F.col("pass") == 0).select(*keys, F.col("bars").alias("_base"))
    d = join_same(passes, base, keys)
    size = F.size("bars")
    head = lambda t: F.slice("bars", F.lit(1), F.greatest(size - t, F.lit(0)))
    tail_of = lambda t: F.slice("bars", F.greatest(size - t, F.lit(0)) + 1, F.lit(t))
    share = lambda t: _equal(head(t), F.slice("_base", F.lit(1), F.greatest(size - t, F.lit(0)))) / (size - t)
    tests = [F.min(F.when(size > t, share(t))).alias(f"_s{t}") for t in range(1, longest + 1)]
    kinds = [F.count_distinct(F.to_json(F.struct(tail_of(t).alias("x")))).alias(f"_n{t}") for t in range(1, longest + 1)]
    found = d.groupBy(*keys).agg(F.min(size).alias("_lo"), F.max(size).alias("_hi"), *tests, *kinds)
    fits = [F.when((F.col("_lo") == F.col("_hi")) & (F.col("_lo") > t) & (F.col(f"_s{t}") >= frac) & (F.col(f"_n{t}") >= 2), t) for t in range(1, longest + 1)]
    found = found.select(*keys, F.coalesce(*fits).alias("tail"))
    d = join_same(passes, found, keys)
    d = d.withColumn("_tail", F.when(F.col("tail").isNotNull(), F.slice("bars", size - F.col("tail") + 1, F.col("tail"))))
    kinds = d.filter("tail is not null").groupBy(*keys, "_tail").agg(F.min("pass").alias("_first"))
    kinds = kinds.withColumn("variant", F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1).drop("_first")
    return join_same(d, kinds, [*keys, "_tail"], "left").drop("_tail")


def section_groups(sections: DataFrame, bars: DataFrame, keys: list[str], frac: float = GROUP_ALIKE) -> DataFrame:
    """Repeated groups of sections: (keys, section, run, period, slot, round) of every section in a run of form letters that is one group again and again.

    ``sections`` are (keys, section from 0 without gaps, label, reps), ``bars`` (keys, section, offset, content). The smallest period of two
    sections or more, that divides the run, counts if every section has the label and reps of the one in its slot of the first round, as many
    bars, and ``frac`` of them equal. Sections without bars are alike. Runs without a period are absent.
    """
    sizes = bars.groupBy(*keys, "section").agg(F.count("*").alias("_n"))
    rows = _runs(sections.select(*keys, F.col("section").cast("long").alias("section"), "label", F.coalesce("reps", F.lit(1)).alias("reps")), keys, "section", "label")
    rows = join_same(rows, sizes, [*keys, "section"], "left").fillna({"_n": 0})
    runs = rows.groupBy(*keys, "run").agg(F.count("*").alias("m")).filter("m >= 4")
    tried = runs.withColumn("period", F.explode(F.expr("filter(sequence(2, m div 2), p -> m % p = 0)"))).withColumn("period", F.col("period").cast("long"))
    pairs = join_same(rows, tried, [*keys, "run"]).withColumn("slot", F.col("k") % F.col("period"))
    base = rows.select(*keys, "run", F.col("k").alias("slot"), F.col("label").alias("_label"), F.col("reps").alias("_reps"), F.col("_n").alias("_m"), F.col("section").alias("_base"))
    pairs = join_same(pairs, base, [*keys, "run", "slot"])
    alike = F.col("label").eqNullSafe(F.col("_label")) & (F.col("reps") == F.col("_reps")) & (F.col("_n") == F.col("_m"))
    bad = pairs.filter(~alike).select(*keys, "run", "period").distinct()
    pairs = join_same(pairs, bad, [*keys, "run", "period"], "left_anti").filter("k >= period")
    # Only periods that pass so far have their bars compared, one join row for every bar.
    mine = join_same(pairs.select(*keys, "run", "period", "section", "_base"), bars.select(*keys, "section", "offset", F.col("content").alias("_a")), [*keys, "section"])
    theirs = bars.select(*keys, F.col("section").cast("long").alias("_base"), "offset", F.col("content").alias("_b"))
    same = join_same(mine, theirs, [*keys, "_base", "offset"]).groupBy(*keys, "run", "period", "section").agg(F.avg(F.col("_a").eqNullSafe(F.col("_b")).cast("double")).alias("_same"))
    bad = same.filter(F.col("_same") < frac).select(*keys, "run", "period").distinct()
    good = join_same(pairs.select(*keys, "run", "period").distinct(), bad, [*keys, "run", "period"], "left_anti")
    good = good.groupBy(*keys, "run").agg(F.min("period").alias("period"))
    out = join_same(rows, good, [*keys, "run"])
    return out.select(*keys, "section", "run", "period", (F.col("k") % F.col("period")).alias("slot"), F.expr("k div period").alias("round"))


def content_letters(sections: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """``letter`` (from 0) of every section (keys, section, label, mask) with a form label: sections of like content share it.

    ``mask`` is the set of a section's roots, a bit each. In order, a section joins the first content whose roots so far it shares by ``least``
    (intersection over union; two empty sets are alike) and adds its own, else begins a new one; so letters follow first appearance. From one
    pass over a song's sorted sections that holds a set of roots for each letter, of which there are at most as many as sets.
    """
    rows = sections.filter(is_form_label(F.col("label"))).select(*keys, F.col("section").cast("long").alias("section"), F.coalesce("mask", F.lit(0)).cast("int").alias("mask"))

    def make():
        known: list[int] = []

        def step(row):
            mask = int(row.mask)
            for i, m in enumerate(known):
                either = (m | mask).bit_count()
                if not either or (m & mask).bit_count() / either >= least:
                    known[i] |= mask
                    return [(row.section, i)]
            known.append(mask)
            return [(row.section, len(known) - 1)]

        return step, list

    return fold_sorted(rows, keys, ["section"], make, [rows.schema["section"], StructField("letter", IntegerType())])


def coalesced(sections: DataFrame, keys: list[str], unless_readable: bool = False, most: int = READABLE) -> DataFrame:
    """Neighbouring sections (keys, section, label, reps, start, end and perhaps tail) of one letter as one, its repeats being inside: reps 1.

    Sections with endings (``tail`` not null) stay as they are; so do other labels, but with ``unless_readable``, where all labels
    merge, but only in songs of more than ``most`` sections.
    """
    w = ordered(keys, ["section"])
    d = sections if "tail" in sections.columns else sections.withColumn("tail", F.lit(None).cast("int"))
    same = F.col("label").eqNullSafe(F.lag("label").over(w)) & F.col("tail").isNull() & F.lag("tail").over(w).isNull() & (F.row_number().over(w) > 1)
    if unless_readable:
        same = same & (F.count("*").over(Window.partitionBy(*keys)) > most)
    else:
        same = same & is_form_label(F.col("label"))
    d = d.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_g", F.sum("_new").over(w))
    out = d.groupBy(*keys, "_g").agg(F.min("section").alias("section"), F.first("label").alias("label"), F.when(F.count("*") == 1, F.first("reps")).otherwise(1).alias("reps"), F.min("start").alias("start"), F.max("end").alias("end"), F.first("tail").alias("tail"))
    return out.select(*keys, (F.col("_g") - 1).alias("section"), "label", "reps", "start", "end", "tail")


def form_names(sections: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, form, boundary) of every song: the name of its form, null for none, and the corrected last bar of the middle section.

    ``sections`` are (keys, section, label, reps, start, end): bars of the first pass, both inclusive. One form letter is a 12-bar blues, or a loop of
    4, 8, 16, 24 or 32 bars that is repeated. Three, of which the first (once or twice) and the last (once) have one letter and the
    middle another, are AABA if all have one length of 4 to 16 bars. Where only the boundary between the last two is off, by two bars at
    most, and together they have twice the first's length, it is moved; ``boundary`` says where to.
    """
    form = sections.filter(is_form_label(F.col("label")))
    few = form.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = join_same(form, few.filter("_n in (1, 3)"), keys)
    s = rows.groupBy(*keys).agg(F.first("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("section", "label", "reps", "start", "end"))).alias("_s"))
    a, b, c = (F.get("_s", F.lit(i)) for i in range(3))
    size = lambda x: x["end"] - x["start"] + 1
    one = F.when(size(a) == 12, "12-bar blues").when((a["reps"] >= 2) & size(a).isin(4, 8, 16, 24, 32), F.concat(size(a).cast("string"), F.lit("-bar loop")))
    shaped = (a["label"] == c["label"]) & (a["label"] != b["label"]) & a["reps"].isin(1, 2) & (c["reps"] == 1)
    off = size(b) - size(a)
    moved = shaped & (b["reps"] == 1) & (size(b) != size(c)) & (b["end"] + 1 == c["start"]) & (size(b) + size(c) == 2 * size(a)) & (F.abs(off) <= 2)
    even = shaped & (moved | ((size(b) == size(a)) & (size(c) == size(a)))) & size(a).between(4, 16)
    three = F.when(even & (size(a) == 8), "AABA (32-bar song form)").when(even, F.concat(F.lit("AABA-shaped form ("), size(a).cast("string"), F.lit("-bar sections)")))
    named = s.select(*keys, F.when(F.col("_n") == 1, one).otherwise(three).alias("form"), F.when((F.col("_n") == 3) & moved, b["end"] - off).alias("boundary"))
    return join_same(sections.select(*keys).distinct(), named, keys, "left")


def section_runs(bars: DataFrame, chips: DataFrame, keys: list[str], index: str, label: str, at: str) -> DataFrame:
    """Sections as spans of bars: (keys, section, label, start, end).

    Where a song has ``chips`` (keys, label, at): each begins at the first bar that begins no earlier (by a millionth), the first of several at one bar counts,
    and the first reaches back to bar 0. Else where a bar's label is a form letter: stretches of equal letters, others counting
    as A. Else one section A. ``at`` is a bar's time, null where it is silent; ``index`` counts bars from 0.
    """
    rows = bars.select(*keys, F.col(index).cast("long").alias("_i"), F.col(label).alias("_l"), F.col(at).cast("double").alias("_t"))
    whole = rows.groupBy(*keys).agg(F.max("_i").alias("_last"), F.max(is_form_label(F.col("_l")).cast("int")).alias("_letters"))
    # A chip's bar: both sides in one order of time, and the next bar that follows.
    marks = rows.filter("_t is not null").select(*keys, F.col("_t").alias("_x"), F.lit(1).alias("_side"), "_i", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("_at"))
    asked = chips.select(*keys, (F.col(at).cast("double") - 1e-6).alias("_x"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_i"), F.coalesce("label", F.lit("A")).alias("label"), F.col(at).cast("double").alias("_at"))
    after = Window.partitionBy(*keys).orderBy("_x", "_side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    first_after = F.min("_i").over(after)
    placed = marks.union(asked).withColumn("start", first_after).filter("_side = 0 and start is not null")
    placed = placed.groupBy(*keys, "start").agg(F.min_by("label", "_at").alias("label"))
    w = ordered(keys, ["start"])
    placed = placed.withColumn("start", F.when(F.row_number().over(w) == 1, F.lit(0).cast("long")).otherwise(F.col("start")))
    by_chip = join_same(placed, whole, keys).select(*keys, "label", "start", F.coalesce(F.lead("start").over(w) - 1, F.col("_last")).alias("end"))
    rest = join_same(whole, placed.select(*keys).distinct(), keys, "left_anti")
    order = ordered(keys, ["_i"])
    letter = F.when(is_form_label(F.col("_l")), F.col("_l")).otherwise("A")
    by_bar = join_same(rows, rest.filter("_letters = 1"), keys).withColumn("label", letter)
    by_bar = by_bar.withColumn("_g", F.sum(F.coalesce((F.col("label") != F.lag("label").over(order)).cast("int"), F.lit(1))).over(order))
    by_bar = by_bar.groupBy(*keys, "_g").agg(F.first("label").alias("label"), F.min("_i").alias("start"), F.max("_i").alias("end")).drop("_g")
    plain = rest.filter("_letters = 0").select(*keys, F.lit("A").alias("label"), F.lit(0).cast("long").alias("start"), F.col("_last").alias("end"))
    out = by_chip.union(by_bar).union(plain)
    return out.select(*keys, (F.row_number().over(ordered(keys, ["start"])) - 1).cast("long").alias("section"), "label", "start", "end")
