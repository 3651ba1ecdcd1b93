"""Order-dependent operators for episodes of any length.

A window over an episode runs in one task. Here rows are dealt out by ranges of (episode, order), so a long episode spreads
over many tasks; each works on its own stretch, and what a stretch needs from those before it is carried over: the last
value, the sum, or the rows just before it. A stretch that isn't an episode's first begins a task's range, so there are no
more carries than tasks, and they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def segmented(rows: DataFrame, episode: str, order: list[str]) -> DataFrame:
    """rows with _segment, the number of their range, written so that it stays the same. Segments follow (episode, order);
    rows that are equal in both lie in one."""
    return written(rows.repartitionByRange(episode, *order).withColumn("_segment", F.spark_partition_id()), "segments")


def _inside(episode: str, order: list[str]):
    return Window.partitionBy(episode, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _carried(per: DataFrame, episode: str, made: dict[str, Column]) -> DataFrame:
    """What segments that aren't their episode's first need; made: aggregates over the segments before."""
    before = Window.partitionBy(episode).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("_segment").over(Window.partitionBy(episode))
    out = per.select(episode, "_segment", first.alias("_first"), *[c.over(before).alias(name) for name, c in made.items()])
    return F.broadcast(out.where("_segment > _first").drop("_first"))


def scan(rows: DataFrame, episode: str, order: list[str], last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """segmented() rows with, by name, the last value that isn't null up to a row (last), and the running sum (sums)."""
    last, sums = last or {}, sums or {}
    named = rows.withColumns({f"_v_{k}": c for k, c in (last | sums).items()})
    at = F.struct(*order)
    per = named.groupBy(episode, "_segment").agg(
        *[F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), at)).alias(k) for k in last], *[F.sum(f"_v_{k}").alias(k) for k in sums]
    )
    carry = _carried(per, episode, {f"_c_{k}": F.last(k, ignorenulls=True) for k in last} | {f"_c_{k}": F.sum(k) for k in sums})
    w = _inside(episode, order)
    out = named.withColumns({k: F.last(f"_v_{k}", ignorenulls=True).over(w) for k in last} | {k: F.sum(f"_v_{k}").over(w) for k in sums})
    out = out.join(carry, [episode, "_segment"], "left")
    for k in last:
        out = out.withColumn(k, F.coalesce(k, f"_c_{k}"))
    for k in sums:
        out = out.withColumn(k, F.when(F.col(k).isNull(), F.col(f"_c_{k}")).otherwise(F.col(k) + F.coalesce(f"_c_{k}", F.lit(0))))
    return out.drop(*[f"{p}{k}" for p in ("_v_", "_c_") for k in (*last, *sums)])


def as_of(left: DataFrame, right: DataFrame, episode: str, time: str, value: str) -> DataFrame:
    """left with the newest right value at or before each row's time, as order.as_of, for episodes of any length. Of right
    values of one time the greatest counts."""
    other = right.groupBy(episode, time).agg(F.max(value).alias("_value"))
    kind = other.schema["_value"].dataType
    marked = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(kind)}).unionByName(other.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    name = f"latest_{value}"
    out = scan(segmented(marked, episode, [time, "_side"]), episode, [time, "_side"], last={name: F.col("_value")})
    return out.where("_side = 1").drop("_side", "_value", "_segment")


def held(rows: DataFrame, episode: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The last value seen, on rows that have none."""
    return scan(segmented(rows, episode, order), episode, order, last={name: value}).drop("_segment")


def replayed(rows: DataFrame, episode: str, order: list[str], delta: Column, name: str) -> DataFrame:
    """The running sum of differences: a series from its first value and its changes."""
    return scan(segmented(rows, episode, order), episode, order, sums={name: delta}).drop("_segment")


def moving_average(rows: DataFrame, episode: str, order: list[str], value: str, n: int, name: str) -> DataFrame:
    """The mean of a row and the n - 1 before it. A segment gets the n - 1 rows before it as well, from as many segments as
    hold them."""
    cut = segmented(rows, episode, order)
    ranked = scan(cut, episode, order, sums={"_rank": F.lit(1)})
    starts = ranked.groupBy(episode, "_segment").agg(F.min("_rank").alias("_from")).where("_from > 1")
    starts = F.broadcast(starts.withColumnRenamed("_segment", "_into"))
    halo = ranked.join(starts, episode).where(f"_rank < _from and _rank >= _from - {n - 1}").withColumn("_segment", F.col("_into")).drop("_into", "_from")
    both = ranked.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)))
    w = Window.partitionBy(episode, "_segment").orderBy("_rank").rowsBetween(-(n - 1), 0)
    return both.withColumn(name, F.avg(value).over(w)).where("_own").drop("_own", "_rank", "_segment")
