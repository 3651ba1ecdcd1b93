"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


#: Nodes with at least edges / HOT edges (and LEAST_HOT) are hubs: at most 2 * HOT of them, so that their minima can be sent
#: to all tasks and no task has to hold a hub's edges. With fewer edges than that the plain join does as well, in plans half as large.
HOT, LEAST_HOT = 500, 100_000


def _with_least(edges: DataFrame, size: int) -> DataFrame:
    """edges with m, the smallest v of each u. size: the number of edges, or more."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    if size < 2 * LEAST_HOT:
        return edges.join(least.drop("_n"), "u")
    hot = F.broadcast(least.where(F.col("_n") >= max(LEAST_HOT, size // HOT)).select("u", "m"))
    cold = edges.join(hot, "u", "left_anti")
    return edges.join(hot, "u").unionByName(cold.join(cold.groupBy("u").agg(F.min("v").alias("m")), "u"))


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * size).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
    return _with_least(edges, size).select(F.inline(pairs)).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """id and component (the smallest id reachable) for every node of an edge; edges with a null end or equal ends are ignored.

    Minima are taken by partial aggregation and joined back, those of hubs by broadcast, so a hub's neighbours are never
    gathered in one task. Each round is written to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct(), "edges")
    seen, size = None, now.count()
    for _ in range(most_rounds):
        # The large star makes no more edges than it is given.
        after = written(_small_star(_large_star(now, size), size), "edges")
        state = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_written(now)
        now, size = after, state[0]
        if state == seen or state[0] == 0:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
