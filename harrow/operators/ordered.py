"""Order-dependent work on series that may be too long for one task.

Three building blocks carry every window feature of the package:

``positions``   exact row number and length of each series,
``over_rows``   columns over bounded row frames (lags, rolling statistics, EWM),
``running``     columns over unbounded frames (carry, cumulative product, peaks).

Each has two physical forms.

*plain* - one window per series. Chosen when the order column is a DATE: sources keep one row
per series and day, so a series is bounded by the calendar (36,525 rows per century), whatever
the data volume. This costs a single exchange on the series keys.

*blocked* - chosen for every other order column (timestamps, ids, text), where one series may hold a
third of all rows. Rows are laid out by ranges of (keys, order) of about even size and written, so a range, not a
series, is the unit of work, whatever the type and the unit of the order column.
Row numbers come from the place in the range and the counts of earlier ranges.
Bounded frames get a halo: rows near the edge of a block of rows are copied to the neighbour that needs them.
Unbounded frames get a carry: summaries (one row per series and range) are scanned, then joined back.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nullsafe import col
from ..sources.sinks import cut

# Least rows of a block with a halo, and rows of a range of values.
BLOCK_ROWS = 4096
PIECE_ROWS = 500_000


@dataclass(frozen=True)
class Ctx:
    """What a layer needs to write window expressions: the ordered window and its partitioning."""

    w: WindowSpec
    parts: tuple[str, ...]
    frames: dict[int, WindowSpec] = field(default_factory=dict)
    segment: str | None = None  # the column of segments that rows are ordered by already

    def back(self, n: int) -> WindowSpec:
        """Frame of the last n rows including the current one."""
        if n not in self.frames:
            self.frames[n] = self.w.rowsBetween(-(n - 1), 0)
        return self.frames[n]


Layer = Callable[[Ctx], dict[str, Column]]


def is_calendar(df: DataFrame, order: str) -> bool:
    return isinstance(df.schema[order].dataType, T.DateType)


def laid_out(df: DataFrame, keys: list[str], order: str, parts: int | None = None) -> DataFrame:
    """The rows by ranges of (keys, order), with __t, the range, and __at, which ascends along the order.

    `parts` ranges of about even size, by default the session's number of shuffle partitions; a hot series lies in many. Bounds
    come from a sample, so the layout is written before it is used.
    """
    by = [*keys, order]
    ranges = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    laid = ranges.sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    return cut(laid, "laid_out").withColumn("__t", F.shiftright("__at", 33))


def positions(
    df: DataFrame,
    keys: list[str],
    order: str,
    rn: str = "rn",
    n: str | None = None,
    blocked: bool | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add the 1-based row number of each row in its series and, if named, the series length.

    Blocked form: rows are laid out by range, counts of ranges (map-side combined) are prefix-summed, and a row's number
    follows from its place in the range; rows are not moved again.
    """
    if blocked is None:
        blocked = not is_calendar(df, order)
    if not blocked:
        cols = {rn: F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")}
        if n:
            cols[n] = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return df.withColumns(cols)
    laid = laid_out(df, keys, order, parts)
    counts = laid.groupBy(*keys, "__t").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__c"))
    series = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys,
        "__t",
        (F.sum("__c").over(series.orderBy("__t")) - F.col("__c") - F.col("__first") + 1).alias("__off"),
        F.sum("__c").over(series).alias(n or "__n"),
    )
    out = laid.join(offsets, [*keys, "__t"]).withColumn(rn, F.col("__off") + F.col("__at")).drop("__t", "__at", "__off")
    return out if n else out.drop("__n")


def numbered(df: DataFrame, keys: list[str], order: str, n: str | None = None, **kw) -> DataFrame:
    """`positions` as `__pos` for a following `running`."""
    return positions(df, keys, order, "__pos", n, **kw)


def over_rows(
    df: DataFrame,
    keys: list[str],
    order: str,
    layers: list[Layer],
    before: int,
    after: int = 0,
    blocked: bool | None = None,
    parts: int | None = None,
    segmented: bool = False,
) -> DataFrame:
    """Add window columns whose frames reach at most `before` rows back and `after` rows ahead.

    Layers run in order, later ones may use columns of earlier ones; `before` covers the whole
    chain. All layers share one exchange. Columns named ``__*`` are scratch and dropped. `segmented`, for layers with
    exponential means: plain rows are ordered by segment and row number, so that all layers share one sort.
    """
    if blocked is None:
        blocked = not is_calendar(df, order)
    keep = [c for c in df.columns]
    if blocked:
        out, unit = _halo(df, keys, order, before, after, parts), (*keys, "__blk")
        ctx = Ctx(Window.partitionBy(*unit).orderBy("__rn"), unit)
    else:
        out, unit = df, tuple(keys)
        ctx = Ctx(Window.partitionBy(*unit).orderBy(order), unit)
        out = out.withColumn("__rn", F.row_number().over(ctx.w).cast("long"))
        if segmented:
            seg = f"__g_{SEGMENT}"
            out = out.withColumn(seg, F.floor((F.col("__rn") - 1) / SEGMENT))
            ctx = Ctx(Window.partitionBy(*unit).orderBy(seg, "__rn"), unit, segment=seg)
    for layer in layers:
        added = layer(ctx)
        out = out.withColumns(added)
        keep += [c for c in added if not c.startswith("__") and c not in keep]
    if blocked:
        out = out.filter("__own")
    return out.select(*keep)


def _halo(
    df: DataFrame, keys: list[str], order: str, before: int, after: int, parts: int | None
) -> DataFrame:
    """Assign rows to row blocks and copy edge rows to the neighbours that look at them."""
    size = max(BLOCK_ROWS, 4 * (before + after))
    p = positions(df, keys, order, "__rn", "__n", blocked=True, parts=parts)
    r = F.col("__rn") - 1
    first = F.greatest(F.floor((r - after) / size), F.lit(0))
    last = F.least(F.floor((r + before) / size), F.floor((F.col("__n") - 1) / size))
    p = p.withColumn("__blk", F.explode(F.sequence(first, last)))
    return p.withColumn("__own", F.col("__blk") == F.floor(r / size))


@dataclass(frozen=True)
class Run:
    """One running column: kind is last, first, sum, product, max or min of `expr`.

    `last` is the latest non-null value so far, `first` the next non-null value from here on.
    """

    kind: str
    expr: Column


def _fold(kind: str, c: Column) -> Column:
    return {
        # `first` looks at rows in reverse order, where the next value is the latest one
        "last": lambda: F.last(c, ignorenulls=True),
        "first": lambda: F.last(c, ignorenulls=True),
        "sum": lambda: F.sum(c),
        "product": lambda: F.product(c),
        "max": lambda: F.max(c),
        "min": lambda: F.min(c),
    }[kind]()


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("last", "first"):
        return F.coalesce(local, carried)
    if kind == "max":
        return F.greatest(local, carried)
    if kind == "min":
        return F.least(local, carried)
    joined = carried + local if kind == "sum" else carried * local
    return F.coalesce(joined, local, carried)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    specs: dict[str, Run],
    blocked: bool | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add running columns over everything up to the row (`first`: from the row on).

    Blocked form is a two-level scan: one summary row per series and range, a scan over summaries, and a
    join that adds the carried-in value to the scan inside each range.
    """
    if blocked is None:
        blocked = not is_calendar(df, order)

    @cache
    def frame(by: tuple[str, ...], at: str, kind: str, exclude: int = 0) -> WindowSpec:
        # A frame open at its end is evaluated anew for each row; the mirrored one is not.
        w = Window.partitionBy(*by).orderBy(F.col(at).desc() if kind == "first" else F.col(at))
        return w.rowsBetween(Window.unboundedPreceding, -exclude)

    if not blocked:
        return df.withColumns(
            {o: _fold(s.kind, s.expr).over(frame((*keys,), order, s.kind)) for o, s in specs.items()}
        )

    cut_up = laid_out(df, keys, order, parts).withColumns({f"__x_{o}": s.expr for o, s in specs.items()})

    def summary(o: str, kind: str) -> Column:
        x = F.col(f"__x_{o}")
        at = F.when(x.isNotNull(), F.col("__at"))
        if kind == "last":
            return F.max_by(x, at)
        if kind == "first":
            return F.min_by(x, at)
        return _fold(kind, x)

    blocks = cut_up.groupBy(*keys, "__t").agg(*[summary(o, s.kind).alias(f"__s_{o}") for o, s in specs.items()])
    carried = blocks.select(
        *keys,
        "__t",
        *[
            _fold(s.kind, F.col(f"__s_{o}")).over(frame((*keys,), "__t", s.kind, 1)).alias(f"__c_{o}")
            for o, s in specs.items()
        ],
    )
    inside = (*keys, "__t")
    joined = cut_up.join(carried, [*keys, "__t"]).withColumns(
        {f"__l_{o}": _fold(s.kind, F.col(f"__x_{o}")).over(frame(inside, "__at", s.kind)) for o, s in specs.items()}
    )
    merged = joined.withColumns(
        {o: _merge(s.kind, F.col(f"__c_{o}"), F.col(f"__l_{o}")) for o, s in specs.items()}
    )
    keep = [c for c in df.columns if c not in specs]
    return merged.select(*keep, *specs)


def running_by_value(
    df: DataFrame, keys: list[str], value: str, specs: dict[str, Run], bounded: bool = False, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """`running` along a numeric column.

    bounded: the caller knows that a key holds at most one row per day, so a key fits one task.
    Otherwise rows are laid out by ranges of (key, value) of about `piece_rows` rows, so neither outliers nor a hot key gather rows in
    one task, and a key has ranges in proportion to its rows. The input is written out first, to be counted and laid out.
    """
    if bounded:
        return running(df, keys, value, specs, blocked=False)
    df = cut(df, "by_value")
    return running(df, keys, value, specs, blocked=True, parts=df.count() // piece_rows + 1)


def ewm_reach(span: int) -> int:
    """Rows after which the weight of an observation is below 1e-20."""
    return math.ceil(46.0 / -math.log(1 - 2 / (span + 1)))


# Rows per segment. Weights inside a segment stay below 2^700, within double range for any span
# from 3 up, and one size for all spans lets their windows share a sort.
SEGMENT = 700


def ewm_layers(out: str, c: str | Column, span: int, adjust: bool = True) -> list[Layer]:
    """Exponentially weighted mean as running sums, linear in the number of rows.

    Rows are numbered inside segments no shorter than `ewm_reach(span)`. Inside a segment the
    decayed sum is q^k * sum(x * q^-k); what earlier segments contribute is the value at the end
    of the previous one times q^(k+1), everything older has weight below 1e-20. A caller's
    `before` has to cover `ewm_reach(span)`. Missing values keep decaying the weights; at them the mean of
    the last value holds, however long the gap. In the blocked form a gap may be longer than
    the halo: apply `hold` to the result. With adjust=False the first value seeds the mean; feed
    that form a series without gaps after its first value.
    """
    q, m = 1 - 2 / (span + 1), max(SEGMENT, ewm_reach(span)) if span >= 3 else ewm_reach(span)
    x = col(c).cast("double")
    num, den, seg, k = f"__n_{out}", f"__d_{out}", f"__g_{m}", f"__k_{m}"

    def number(ctx: Ctx) -> dict[str, Column]:
        r = F.col("__rn") - 1
        return ({} if ctx.segment == seg else {seg: F.floor(r / m)}) | {k: (r % m).cast("double")}

    def inside(ctx: Ctx) -> dict[str, Column]:
        w = Window.partitionBy(*ctx.parts, seg).orderBy("__rn")
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        up, down = F.pow(F.lit(q), F.col(k)), F.pow(F.lit(q), -F.col(k))
        weight = F.lit(1.0)
        if not adjust:
            weight = F.when(F.col("__rn") == F.col(f"__rn0_{out}"), 1.0).otherwise(1 - q)
        return {
            num: up * F.sum(x * down * weight).over(w),
            den: up * F.sum(F.when(x.isNotNull(), down * weight)).over(w),
        }

    def seeds(ctx: Ctx) -> dict[str, Column]:
        # In a halo the first visible value is not the first of the series; it seeds nothing
        # there because it lies a whole reach before any row that is kept.
        w = ctx.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return {f"__rn0_{out}": F.min(F.when(x.isNotNull(), F.col("__rn"))).over(w)}

    def across(ctx: Ctx) -> dict[str, Column]:
        past = ctx.w.rowsBetween(Window.unboundedPreceding, -1)
        edge = F.col(k) == m - 1

        def total(s: str) -> Column:
            prev = F.last(F.when(edge, F.coalesce(F.col(s), F.lit(0.0))), ignorenulls=True).over(past)
            return F.coalesce(F.col(s), F.lit(0.0)) + F.pow(F.lit(q), F.col(k) + 1) * F.coalesce(prev, F.lit(0.0))

        return {f"__tn_{out}": total(num), f"__td_{out}": total(den)}

    def divide(ctx: Ctx) -> dict[str, Column]:
        # numerator and denominator decay alike: between values the mean stays what it was
        mean = F.when(x.isNotNull(), F.try_divide(F.col(f"__tn_{out}"), F.col(f"__td_{out}")))
        return {out: F.last(mean, ignorenulls=True).over(ctx.w.rowsBetween(Window.unboundedPreceding, 0))}

    return [number, seeds, inside, across, divide] if not adjust else [number, inside, across, divide]


def hold(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Carry the last known value of each column through missing ones, over any distance."""
    return running(df, keys, order, {c: Run("last", F.col(c)) for c in columns})


def side_by_side(*stacks: list[Layer]) -> list[Layer]:
    """Run several layer stacks in lockstep, so independent features share window passes."""
    depth = max(len(s) for s in stacks)

    def at(i: int) -> Layer:
        def layer(ctx: Ctx) -> dict[str, Column]:
            cols: dict[str, Column] = {}
            for s in stacks:
                if i < len(s):
                    cols.update(s[i](ctx))
            return cols

        return layer

    return [at(i) for i in range(depth)]
