"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r, its expected copies. Rates minimise the entropy distance of the token mass from what it is,
sum of size * (r log r - r + 1), under two kinds of token constraints: each source has its token target, and the mix as a
whole keeps the corpus's mean length class, weighed by tokens, so that favouring a source of long or short documents doesn't
shift what lengths a model sees. The solution is an exponential tilt,
    r = min(limit, exp(lambda[source] + mu * x)),     x: the document's length class (bits of its size) less the mean,
with one lambda a source and one mu. The convex dual is solved by Newton steps on aggregates of (source, class): a source's
cells are one row, a step is a narrow pass over those rows and one sum, and mu is eliminated from the system (its matrix is
an arrow). Targets come first: where limits leave no mu that keeps the mean, mu stops and the lambdas are solved for it.

Rates are rounded to copies: everyone has floor(r) and, in the order of a hash divided by the rest of r (sequential Poisson
sampling, so the chance of one more copy is that rest), documents get one more until the source's target is met. Places in
that order are found by two-level prefix sums (ranges, then inside the one range that the target falls into). After all
first ones stand second copies, as far as the limit goes, for sources that are still short. Documents that don't fit are set aside and the sum goes on over the others, until a source is within CLOSE of its target or nothing fits;
a last one may go over if that is nearer. A decision depends on the row and its source's few numbers only, so rows are never
sorted or moved to make it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
RANGE_BITS = 12
STEPS = 40
#: Steps after which mu stays as it is.
TILT_STEPS = 14
#: A source this near to its target, as a share of it, takes no more.
CLOSE = 5e-4
#: Rows of a table by source, or by source and length class, that may be broadcast: under 100 bytes each.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def length_class(size: Column) -> Column:
    """Bits of the size; 0 for size 0."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def lot(key: Column, size: Column) -> Column:
    """A number below 2 ** 53 by which a row draws; rows with equal key and size are alike."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), size, F.lit(20260101)), 11)


def drawn(lot: Column, part: Column) -> Column:
    """The place of a row in the order in which one more copy is dealt, 0 to 2 ** 52.

    The row's uniform number over `part`, the chance of the copy: below 1/2 of the range for as many as are expected.
    """
    uniform = (lot + 0.5) / float(1 << 53)
    return F.floor(uniform / (uniform + part) * float(1 << 52)).cast("bigint")


def draws(limit: int) -> Column:
    """The places of all copies that a row (base, draw, lot) may have besides base: its own, and after all rows' own the further ones."""
    more = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(limit - 1 - F.col("base"), F.lit(0)).cast("bigint")), lambda t: F.when(t == 0, F.col("draw")).otherwise(F.shiftleft(F.lit(1).cast("bigint"), 52) * t + F.shiftright("lot", 1)))
    return F.when((F.col("base") < limit) & (F.col("size") > 0), more).otherwise(F.array().cast("array<bigint>"))


def near(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are few enough, else as it is: a shuffle join, whose hot keys AQE splits."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def targets(sizes: DataFrame, *, share: float = 1.5, limit: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """source, source_size, target for sizes (source, size).

    Sources by code point, null last, weigh `weights`, repeating; together they get share * all sizes; a target stops at
    limit * its source's size and what is over goes to the others by weight: min(limit * size, weight * level), where the
    level is that at which the targets add up.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = common.written(per.withColumn("weight", weight).withColumn("most", limit * F.col("source_size")), "mix-sources")  # a row for each source
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (share * F.sum("source_size").over(everything) - full) / left
    found = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    # the level is that of the first source, in this order, that stays below its limit
    chosen = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = found.withColumn("at", chosen)
    return found.select("source", "source_size", "weight", F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least("most", F.col("at") * F.col("weight"))).alias("target"))


def cells(light: DataFrame, wanted: DataFrame, n: int) -> tuple[DataFrame, float]:
    """source, target, lam (to begin with), cells (class, x, mass) of each source, and the mean length class by tokens."""
    masses = common.written(light.filter("size > 0").groupBy("source", "class").agg(F.sum("size").cast("double").alias("mass")), "mix-masses")
    total = masses.agg(F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.col("class")).alias("moment")).first()
    mean = total["moment"] / total["mass"] if total["mass"] else 0.0
    cell = F.struct("class", (F.col("class") - F.lit(mean)).alias("x"), "mass")
    per = masses.groupBy("source").agg(F.array_sort(F.collect_list(cell)).alias("cells"))  # as many as a size has bits
    rows = per.join(near(wanted.select(F.col("source").alias("s"), "source_size", "target"), n), F.col("source").eqNullSafe(F.col("s")))
    return rows.select("source", "source_size", "target", "cells"), mean


def _summed(value) -> Column:
    """Sum of value(cell) over the cells of a row."""
    return F.aggregate("cells", F.lit(0.0), lambda total, c: total + value(c))


def balanced(rows: DataFrame, *, limit: float = 2.0, steps: int = STEPS, tolerance: float = 1e-9) -> tuple[DataFrame, float]:
    """The dual solution for rows of cells(): source, lam, cells; and mu. Rates are least(limit, exp(lam + mu * x))."""
    top = math.log(limit)
    # sources at their limit have all rates there, those without a target have none
    begin = F.when(F.col("target") <= 0, -700.0).when(F.col("target") >= limit * F.col("source_size") * (1 - 1e-12), 700.0).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = common.written(rows.select("source", "target", "cells", begin.alias("lam")), "mix-dual")
    mu = 0.0
    for step in range(steps):
        power = lambda c: F.col("lam") + mu * c["x"]  # noqa: B023, E731
        rate = lambda c: F.exp(F.least(F.lit(top), power(c)))  # noqa: B023, E731
        slope = lambda c: F.when(power(c) < top, c["mass"] * rate(c)).otherwise(0.0)  # noqa: B023, E731
        open_ = F.abs("lam") < 700
        sums = {"miss": F.when(open_, F.col("target") - _summed(lambda c: c["mass"] * rate(c))).otherwise(0.0), "moment": _summed(lambda c: c["mass"] * c["x"] * rate(c))}  # noqa: B023
        sums |= {name: F.when(open_, _summed(lambda c, k=k: slope(c) * c["x"] ** k)).otherwise(0.0) for k, name in enumerate(("a", "b", "h"))}  # noqa: B023
        now = state.withColumns(sums).withColumn("share", F.when(F.col("a") > 0, F.col("b") / F.col("a")).otherwise(0.0))
        totals = now.agg(
            F.sum(-F.col("moment") - F.col("share") * F.col("miss")).alias("gap"), F.sum(F.col("h") - F.col("share") * F.col("b")).alias("curve"),
            F.sum(F.abs("moment")).alias("scale"), F.max(F.when(F.col("target") > 0, F.abs("miss") / F.col("target"))).alias("worst"),
        ).first()
        move = 0.0
        if step < TILT_STEPS and totals["curve"] and totals["curve"] > 1e-9 * totals["scale"]:
            move = max(-0.3, min(0.3, totals["gap"] / totals["curve"]))
            move = max(-1.0, min(1.0, mu + move)) - mu
        if (totals["worst"] or 0.0) <= tolerance and abs(move) <= 1e-9:
            break
        change = F.when(F.col("a") > 0, F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col("miss") - F.col("b") * move) / F.col("a")))).otherwise(0.0)
        after = common.written(now.select("source", "target", "cells", (F.col("lam") + change).alias("lam")), "mix-dual")
        common.dropped(state)
        state, mu = after, mu + move
    return state, mu


def rates(state: DataFrame, mu: float, limit: float = 2.0) -> DataFrame:
    """source, class, base (whole copies), part (the rest of the rate) of each cell; written, so that all that use them agree."""
    out = state.select("source", "lam", F.explode("cells").alias("c")).select("source", F.col("c.class").alias("class"), F.least(F.lit(float(limit)), F.exp(F.col("lam") + mu * F.col("c.x"))).alias("rate"))
    base = F.floor(F.col("rate") + 1e-9)
    return common.written(out.select("source", "class", base.cast("bigint").alias("base"), F.greatest(F.lit(0.0), F.col("rate") - base).alias("part")), "mix-rates")


def _with_draws(rows: DataFrame, rate: DataFrame, n: int) -> DataFrame:
    """rows (key, source, size) with base, lot and draw."""
    rows = rows.withColumn("class", length_class(F.col("size")))
    known = near(rate.select(F.col("source").alias("r_source"), F.col("class").alias("r_class"), "base", "part"), n)
    same = F.col("source").eqNullSafe(F.col("r_source")) & (F.col("class") == F.col("r_class"))
    rows = rows.join(known, same, "left").withColumns({"base": F.coalesce("base", F.lit(0).cast("bigint")), "part": F.coalesce("part", F.lit(0.0))})
    rows = rows.withColumn("lot", lot(F.col("key"), F.col("size")))
    return rows.withColumn("draw", drawn(F.col("lot"), F.col("part"))).drop("r_source", "r_class", "part", "class")


def rounded(rows: DataFrame, wanted: DataFrame, limit: float = 2.0, n: int = 0) -> DataFrame:
    """source, steps, extras: what a row (source, size, base, draw, lot, total) needs to know its copies besides base; see copies().
    wanted (n rows): source, target.

    A pass takes, in the order of draws and among the rows that still fit the gap, the longest prefix that fits as a whole.
    The row it stops at no longer fits and the next pass goes on without it, until none that is left fits or the gap is
    small. Every other pass looks at rows of at most half the gap: two passes halve it or end, so the passes are
    logarithmic in the gap.
    """
    have = rows.groupBy("source").agg(F.sum(F.col("base") * F.col("size")).alias("have")).withColumnRenamed("source", "s")
    plan = wanted.join(near(have, n), F.col("source").eqNullSafe(F.col("s")), "left")
    plan = plan.select("source", (F.col("target") - F.coalesce("have", F.lit(0))).alias("gap"), (CLOSE * F.col("target")).alias("close"))
    plan = common.written(plan.withColumn("steps", F.array().cast("array<struct<most:double,cut:bigint>>")), "mix-plan")
    rows = rows.select("source", "size", "total", F.explode(draws(int(limit))).alias("draw"))
    half = False
    while True:
        after, found = _passed(rows, plan, half, n)
        if not found and not half:
            break
        if found:
            common.dropped(plan)
            plan = after
        half = not half
    out = common.written(_closed(rows, plan, n).select("source", "steps", "extras"), "mix-decisions")
    common.dropped(plan)
    return out


def copies(limit: int) -> Column:
    """Copies of a row (base, draw, lot, size, total, and its source's steps and extras)."""
    more = F.filter(draws(limit), lambda d: _taken(F.col("steps"), d, F.col("total")) | F.array_contains(F.col("extras"), d))
    return F.col("base") + F.size(more)


def _taken(steps: Column, draw: Column, total: Column) -> Column:
    return F.exists(steps, lambda s: (total <= s["most"]) & (draw <= s["cut"]))


def _free(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    open_ = near(plan.filter("gap > close").select(F.col("source").alias("s"), "gap", "steps"), n)
    known = rows.select("source", "draw", "size", "total").join(open_, F.col("source").eqNullSafe(F.col("s")))
    return known.filter(~_taken(F.col("steps"), F.col("draw"), F.col("total")))


def _passed(rows: DataFrame, plan: DataFrame, half: bool, n: int) -> tuple[DataFrame, bool]:
    """The plan with one more step for each source that has rows of at most the gap (half: half the gap), and whether any has."""
    most = F.col("gap") / 2 if half else F.col("gap")
    part = F.shiftright("draw", 52 - RANGE_BITS)
    free = _free(rows, plan, n).filter(F.col("total") <= most)
    sums = free.groupBy("source", "gap", part.alias("part")).agg(F.sum("size").alias("size"))
    sums = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # ranges that fit as a whole, and the one that the gap falls into
    fits = F.col("upto") <= F.col("gap")
    whole = sums.groupBy("source").agg(F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("full"), F.min(F.when(~fits, F.col("part"))).alias("cut_part"))
    whole = common.written(whole.select(F.col("source").alias("w"), "full", "cut_part"), "mix-ranges")
    if whole.isEmpty():
        common.dropped(whole)
        return plan, False
    inside = free.join(near(whole, n), F.col("source").eqNullSafe(F.col("w"))).filter(part == F.col("cut_part"))
    inside = inside.groupBy("source", "draw", (F.col("gap") - F.col("full")).alias("left")).agg(F.sum("size").alias("size"))
    inside = inside.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cuts = inside.filter("upto <= left").groupBy("source").agg(F.max("draw").alias("inner"), F.max("upto").alias("more")).withColumnRenamed("source", "c")
    low = F.shiftleft(F.col("cut_part").cast("bigint"), 52 - RANGE_BITS) - 1  # the last draw before the range
    cut = F.when(F.col("cut_part").isNull(), F.lit((1 << 63) - 1)).otherwise(F.coalesce("inner", low))
    out = plan.join(near(whole, n), F.col("source").eqNullSafe(F.col("w")), "left").join(near(cuts, n), F.col("source").eqNullSafe(F.col("c")), "left")
    steps = F.when(F.col("full").isNull(), F.col("steps")).otherwise(F.array_append("steps", F.struct(most.cast("double").alias("most"), cut.alias("cut"))))
    gap = F.col("gap") - F.coalesce("full", F.lit(0)) - F.coalesce("more", F.lit(0))
    out = common.written(out.select("source", gap.alias("gap"), "close", steps.alias("steps")), "mix-plan")
    common.dropped(whole)
    return out, True


def _closed(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """The plan with extras: one more row for each source that goes over its target, if that is nearer."""
    free = _free(rows, plan, n).filter(F.col("total") < 2 * F.col("gap"))
    best = F.min(F.struct(F.abs(F.col("total") - F.col("gap")).alias("miss"), "draw"))
    chosen = free.groupBy("source").agg(best.alias("best")).select(F.col("source").alias("w"), F.array("best.draw").alias("extras"))
    out = plan.join(near(chosen, n), F.col("source").eqNullSafe(F.col("w")), "left")
    return out.withColumn("extras", F.coalesce("extras", F.array().cast("array<bigint>")))


def _with_totals(rows: DataFrame, alike: DataFrame | None) -> DataFrame:
    """rows with total: the size of all rows of a source with the same lot, which are taken together."""
    if alike is None:
        return rows.withColumn("total", F.col("size"))
    same = F.col("source").eqNullSafe(F.col("a_source")) & (F.col("lot") == F.col("a_lot"))
    return rows.join(alike, same, "left").withColumn("total", F.coalesce("a_total", "size")).drop("a_source", "a_lot", "a_total")


def mixed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, limit: float = 2.0, weights: Sequence[float] = WEIGHTS, with_rows: bool = False) -> DataFrame:
    """key, size, source_size, target, copies, taken (copies * size) of each row of docs; with_rows: all its columns in `row`, too.

    Null texts have size 0 and are taken 0 times; null sources are a source; rows with equal key and size get the same
    copies; a source whose texts have no words has target 0. Texts of any length are counted whole; one longer than what its
    source still lacks has no more copies than its rate's whole part. Empty tables give no rows. Other columns may have any
    names: they are in `row` by place (c0, c1, ...; see taken_rows()). Reruns give the same.
    """
    packed = common.Packed(docs)
    size = word_count(packed.column(text))
    named = [packed.column(key).alias("key"), packed.column(source).cast("string").alias("source"), size.alias("size")]
    light = common.written(packed.docs.select(*named), "mix-sizes")
    wanted = common.written(targets(light, share=share, limit=limit, weights=weights), "mix-targets")
    n = wanted.count()
    rows, _ = cells(light.withColumn("class", length_class(F.col("size"))), wanted, n)
    state, mu = balanced(rows, limit=limit)
    rate = rates(state, mu, limit)
    n_rates = rate.count()
    dealt = common.written(_with_draws(light, rate, n_rates), "mix-draws")
    alike = dealt.filter((F.col("size") > 0) & (F.col("base") < int(limit))).groupBy("source", "lot").agg(F.count("*").alias("n"), F.sum("size").alias("a_total")).filter("n > 1")
    alike = common.written(alike.select(F.col("source").alias("a_source"), F.col("lot").alias("a_lot"), "a_total"), "mix-alike")
    n_alike = alike.count()  # keys are unique as a rule
    alike = near(alike, n_alike) if n_alike else None
    plan = rounded(_with_totals(dealt, alike), wanted, limit, n)
    table = plan.join(near(wanted.select(F.col("source").alias("s"), "source_size", "target"), n), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("of"), "steps", "extras", "source_size", "target")
    common.dropped(light, state)
    if with_rows:
        dealt = _with_draws(packed.docs.select(*named, packed.row()), rate, n_rates)
    out = _with_totals(dealt, alike).join(near(table, n), F.col("source").eqNullSafe(F.col("of")))
    out = out.withColumn("copies", copies(int(limit)).cast("bigint"))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if with_rows else []))


def taken_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with at least one copy in the mix, with all their columns, size, source_size, target, copies and taken.

    Columns called like the five, in whatever case, stay as they are in docs and the operator's are left out.
    """
    names = docs.columns
    have = {x.lower() for x in names}
    more = [c for c in ("size", "source_size", "target", "copies", "taken") if c not in have]
    found = mixed(docs, with_rows=True, **options).filter("copies > 0")
    return found.select(*[F.col("row").getField(f"c{k}").alias(c) for k, c in enumerate(names)], *more)
