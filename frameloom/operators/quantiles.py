"""Exact quantiles of any number of rows without gathering them.

A rank is bracketed by exact ends and the bracket's rows are counted in bins, a sketch that merges: each task counts its own
rows, and bins add up. The bin that holds the rank becomes the next bracket, between its own least and greatest value.
Bins are even in the logarithm while a bracket's ends are far apart, then even in value, so any doubles are told apart in a
few rounds, and a value that many rows share ends the search. So does a bracket with few rows, which are sorted.
Nothing that grows with the rows is held: a bin is four numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Bins of a bracket in one round.
BINS = 4096
#: Rows of a bracket that one task sorts, which ends the search.
SORTED = 100_000
#: Rounds after which the search must have ended: doubles have no more than 2**64 values.
ROUNDS = 80
#: Ends of one sign within this factor count as near.
NEAR = 4.0


def exact_quantiles(rows: DataFrame, value: str, probabilities: list[float], keys: list[str] | None = None, bins: int = BINS, sorted_rows: int = SORTED) -> DataFrame:
    """keys, n and quantiles: an array with a quantile for each probability, linear between the two nearest ranks.

    Null and NaN values don't count; infinite ones count as the greatest and least finite numbers. A group without values
    has no row; null keys are groups of their own. keys are few: a row a bracket is broadcast, no more than two for each
    group and probability."""
    keys = keys or []
    big = 1.7e308
    v = F.least(F.greatest(F.col(value).cast("double"), F.lit(-big)), F.lit(big))
    slim = written(rows.where(~F.isnan(F.col(value).cast("double")) & F.col(value).isNotNull()).select(*keys, v.alias("_v")), "values")
    ends = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), F.least(F.floor(x) + up, F.col("n") - 1).alias("r"), (x - F.floor(x)).alias("part")) for i, x in enumerate(at) for up in (0, 1)])
    targets = written(ends.where("n > 0").select(*keys, "n", "_a", "_b", F.col("n").alias("_rows"), F.explode(ranks).alias("t")).select(*keys, "n", "_a", "_b", "_rows", "t.*"), "targets")
    for _ in range(ROUNDS):
        most = targets.where("_a < _b").agg(F.max("_rows")).first()[0]
        if most is None:
            break
        targets = written(_narrowed(slim, targets, keys, bins if most > sorted_rows else None), "targets")
    found = targets.groupBy(*keys, "n", "i").agg(F.max(F.when(F.col("up") == 0, F.col("_a"))).alias("lo"), F.max(F.when(F.col("up") == 1, F.col("_a"))).alias("hi"), F.max("part").alias("part"))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    return found.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("i", x.alias("x")))).alias("_q")).select(*keys, "n", F.transform("_q", lambda q: q["x"]).alias("quantiles"))


def _same(names: list[str], prefix: str):
    """Equality of columns with those of the other side, whose names have a prefix; null equals null."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in names], F.lit(True))


def _share(v: Column, a: Column, b: Column) -> Column:
    """Where v lies between a and b, from 0 to 1, never falling as v grows."""
    log = lambda x: F.signum(x) * (F.log(F.abs(x) + 1e-300) - F.log(F.lit(1e-300)))
    far = (F.signum(a) != F.signum(b)) | (F.greatest(F.abs(a), F.abs(b)) > NEAR * F.least(F.abs(a), F.abs(b)))
    even = lambda x, lo, hi: (x - lo) / (hi - lo)
    linear = F.when(F.greatest(F.abs(a), F.abs(b)) > 1e300, even(v / 4, a / 4, b / 4)).otherwise(even(v, a, b))
    return F.when(a >= b, 0.0).when(far & (log(b) - log(a) > 1e-6), even(log(v), log(a), log(b))).otherwise(linear)


def _narrowed(slim: DataFrame, targets: DataFrame, keys: list[str], bins: int | None) -> DataFrame:
    """targets with the brackets of the next round, or with the values themselves where bins is null and the brackets' rows
    are few enough to sort. Brackets that ranks share are counted once."""
    ends = [*keys, "_a", "_b"]
    wide = targets.where("_a < _b").select(*ends).distinct()
    there = wide.select(*[F.col(k).alias(f"_w{k}") for k in ends])
    groups = [f"_w{k}" for k in ends]
    inside = slim.join(F.broadcast(there), _same(keys, "_w") & F.col("_v").between(F.col("_w_a"), F.col("_w_b"))).select(*groups, "_v")
    if bins is None:
        ranked = inside.withColumn("_upto", F.row_number().over(Window.partitionBy(*groups).orderBy("_v")).cast("bigint"))
        counted = ranked.select(*groups, "_upto", F.lit(1).cast("bigint").alias("_c"), F.col("_v").alias("_lo"), F.col("_v").alias("_hi"))
    else:
        bin_ = F.least(F.floor(_share(F.col("_v"), F.col("_w_a"), F.col("_w_b")) * bins), F.lit(bins - 1)).alias("_bin")
        counted = inside.groupBy(*groups, bin_).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        order = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn("_upto", F.sum("_c").over(order))
    before = F.col("_upto") - F.col("_c")
    found = targets.join(counted, _same(ends, "_w") & (F.col("r") >= before) & (F.col("r") < F.col("_upto")))
    return targets.where("_a >= _b").unionByName(found.select(*keys, "n", F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), F.col("_c").alias("_rows"), "i", "up", (F.col("r") - before).alias("r"), "part"))
