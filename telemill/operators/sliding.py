"""What a tick sees of the samples before it, by prefix sums: no sample is copied to the ticks that see it.

Ticks are the multiples of a step; a tick sees the samples of a series in ``[tick - range, tick]``, both ends included.
All that a tick asks for follows from the first and the last sample it sees, and from running totals at both: how many
samples lie between, and by how much a counter has grown.  A sample is the last one of the ticks until its successor,
and the first one of the ticks that no longer see its predecessor.  So every sample names the ticks for which it is an
end, every tick with data is named twice, and rows grow with ticks, whatever the range.

Running totals are made in two levels: inside chunks of time, so that a series with a third of all samples is spread
over tasks, and then over one row per chunk.  Samples are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from telemill.functions.timegrid import MICROS, ceil_div, floor_div, long_lit

CHUNK_S = 3600
_NAN = 1 << 32


def grown(value: Column, previous: Column) -> Column:
    """By how much a counter has grown since its previous value; a lower value is a reset and counts in full."""
    return F.when(previous.isNull(), 0.0).when(value >= previous, value - previous).otherwise(value)


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def _odd(x: Column) -> Column:
    """Growth that is no number would spoil all totals after it, so it is counted beside them."""
    return F.when(F.isnan(x), long_lit(_NAN)).when(F.abs(x) == float("inf"), long_lit(1)).otherwise(long_lit(0))


def linked(samples: DataFrame, keys: Sequence[str], chunk_s: int = CHUNK_S) -> DataFrame:
    """The samples (keys, at, value) with their neighbours in time and running totals of their series.

    Adds ``before_at`` and ``after_at`` (null at the ends), ``nth`` (from 1), ``grew`` (growth since the first sample)
    and ``odd``.  Samples of one instant are ordered by value.
    """
    # Both uses below read the same columns, and no filter is inferred for one of them: one shuffle serves both.
    samples = samples.select(*keys, "at", "value").filter("at is not null")
    chunk = F.coalesce(floor_div(F.col("at"), chunk_s * MICROS), long_lit(0))
    own = [*keys, "_chunk"]
    by_time = Window.partitionBy(*own).orderBy("at", "value")
    upto = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        samples.withColumn("_chunk", chunk)
        .withColumn("_before", F.lag("at").over(by_time))
        .withColumn("_after", F.lead("at").over(by_time))
        .withColumn("_up", grown(F.col("value"), F.lag("value").over(by_time)))
        .withColumn("_n", F.row_number().over(by_time).cast("bigint"))
        .withColumn("_sum", F.sum(_finite(F.col("_up"))).over(upto))
        .withColumn("_odds", F.sum(_odd(F.col("_up"))).over(upto))
    )
    first, last = F.col("_before").isNull(), F.col("_after").isNull()
    ends = {"_head_at": (first, "at"), "_head": (first, "value"), "_tail_at": (last, "at"), "_tail": (last, "value")}
    ends |= {"_c_sum": (last, "_sum"), "_c_n": (last, "_n"), "_c_odds": (last, "_odds")}
    chunks = inside.groupBy(*own).agg(*[F.max(F.when(at, F.col(c))).alias(name) for name, (at, c) in ends.items()])
    in_order = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)

    def total(link: Column, own_total: str) -> Column:
        """What all chunks before and the links up to this one add up to."""
        return F.coalesce(F.sum(link + F.col(own_total)).over(earlier), F.lit(0)) + link

    chunks = chunks.withColumn("_link", grown(F.col("_head"), F.lag("_tail").over(in_order)))
    chunks = chunks.select(
        *own,
        F.lag("_tail_at").over(in_order).alias("_c_before"),
        F.lead("_head_at").over(in_order).alias("_c_after"),
        total(_finite(F.col("_link")), "_c_sum").alias("_b_sum"),
        total(_odd(F.col("_link")), "_c_odds").alias("_b_odds"),
        total(long_lit(0), "_c_n").alias("_b_n"),
    )
    return inside.join(chunks, own).select(
        *samples.columns,
        F.coalesce("_before", "_c_before").alias("before_at"),
        F.coalesce("_after", "_c_after").alias("after_at"),
        (F.col("_b_n") + F.col("_n")).alias("nth"),
        (F.col("_b_sum") + F.col("_sum")).alias("grew"),
        (F.col("_b_odds") + F.col("_odds")).alias("odd"),
    )


def _first_seer(step_us: int) -> Column:
    return ceil_div(F.col("at"), step_us)


def _last_seer(at: Column, step_us: int) -> Column:
    return floor_div(at + F.col("range_us"), step_us)


def visible(samples: DataFrame, step_us: int, first_us: int, last_us: int) -> DataFrame:
    """The samples (at, range_us) that any tick in ``[first_us, last_us]`` sees."""
    low, high = long_lit(-(-first_us // step_us)), long_lit(last_us // step_us)
    return samples.filter(F.greatest(_first_seer(step_us), low) <= F.least(_last_seer(F.col("at"), step_us), high))


def at_ticks(samples: DataFrame, keys: Sequence[str], step_us: int, first_us: int, last_us: int) -> DataFrame:
    """Per series and tick in ``[first_us, last_us]`` that sees samples: first and last sample, growth, number.

    ``samples`` are those of :func:`linked`, and their ``range_us``.  Columns: keys, tick_us, first_at, first_value, last_at,
    last_value, up, n.
    """
    low, high = long_lit(-(-first_us // step_us)), long_lit(last_us // step_us)
    seen_from, seen_to = _first_seer(step_us), _last_seer(F.col("at"), step_us)
    next_one = F.coalesce(ceil_div(F.col("after_at"), step_us) - 1, high)
    former = F.coalesce(_last_seer(F.col("before_at"), step_us) + 1, low)

    def named(begin: Column, end: Column, side: int) -> Column:
        """Twice the tick's number, plus one for ticks of which the sample is the first."""
        lo, hi = F.greatest(begin, low), F.least(end, high)
        # lo <= hi first: sequence() would count downwards otherwise
        ticks = F.sequence(lo * 2 + side, hi * 2 + side, long_lit(2))
        return F.when(lo <= hi, ticks).otherwise(F.array().cast("array<bigint>"))

    values = ["at", "value", "grew", "odd", "nth"]
    both = F.concat(named(seen_from, F.least(seen_to, next_one), 0), named(F.greatest(seen_from, former), seen_to, 1))
    ends = samples.select(*keys, *values, F.explode(both).alias("_end"))
    is_first = F.pmod("_end", F.lit(2)) == 1
    joined = ends.groupBy(*keys, floor_div(F.col("_end"), 2).alias("_tick")).agg(
        *[F.max(F.when(~is_first, F.col(c))).alias(f"l_{c}") for c in values],
        *[F.max(F.when(is_first, F.col(c))).alias(f"f_{c}") for c in values],
    )
    odd = F.col("l_odd") - F.col("f_odd")
    up = F.col("l_grew") - F.col("f_grew")
    return joined.select(
        *keys,
        (F.col("_tick") * long_lit(step_us)).alias("tick_us"),
        F.col("f_at").alias("first_at"),
        F.col("f_value").alias("first_value"),
        F.col("l_at").alias("last_at"),
        F.col("l_value").alias("last_value"),
        F.when(odd >= _NAN, float("nan")).when(odd > 0, float("inf")).otherwise(up).alias("up"),
        (F.col("l_nth") - F.col("f_nth") + 1).alias("n"),
    )


def gaps(samples: DataFrame, keys: Sequence[str], step_us: int, first_us: int, last_us: int) -> DataFrame:
    """Per series the runs of ticks in ``[first_us, last_us]`` that see no sample: keys, from_us, to_us (both are ticks).

    Each sample tells the run before it, the last one also the run after it; rows are bounded by samples, not by ticks.
    ``samples`` are those of :func:`linked`, with ``range_us``.
    """
    low, high = long_lit(-(-first_us // step_us)), long_lit(last_us // step_us)
    before = F.struct(
        F.greatest(F.coalesce(_last_seer(F.col("before_at"), step_us) + 1, low), low).alias("lo"),
        F.least(_first_seer(step_us) - 1, high).alias("hi"),
    )
    after = F.struct(F.greatest(_last_seer(F.col("at"), step_us) + 1, low).alias("lo"), high.alias("hi"))
    runs = F.when(F.col("after_at").isNull(), F.array(before, after)).otherwise(F.array(before))
    found = samples.select(*keys, F.explode(F.filter(runs, lambda r: r["lo"] <= r["hi"])).alias("_run"))
    return found.select(
        *keys,
        (F.col("_run.lo") * long_lit(step_us)).alias("from_us"),
        (F.col("_run.hi") * long_lit(step_us)).alias("to_us"),
    )
