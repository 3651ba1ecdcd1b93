"""The layout against a plain form of its contract, its files as they lie on disk, and odd tables."""

import calendar
import glob
import hashlib
import zlib
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from frameloom.llm import time_layout
from frameloom.llm.common import shared_dir


def moved(click_id, ts):
    k = zlib.crc32(str(click_id).encode()) % 128
    if ts is None:
        return None
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    if k > 111:
        return datetime.combine(ts.date() - timedelta(days=ts.weekday()), datetime.min.time())
    return ts


def plain_layout(rows, limit):
    """(leaf, part) to rows in file order. rows: tuples (moment, arrived_at, click_id, ...)."""
    found = {}

    def split(members, pick, prefix, form, rows):
        groups = {m: [] for m in members}
        for r in rows:
            groups[pick(r[0])].append(r)
        run = None  # first, last, rows
        done = []
        for m in members:
            inside = groups[m]
            if len(inside) > limit:
                run = None
                deeper(m, inside, prefix, done)
            elif run is not None and len(run[2]) + len(inside) <= limit:
                run[1], run[2] = m, run[2] + inside
            else:
                run = [m, m, list(inside)]
                done.append(run)
        for first, last, held in done:
            if held:
                found[f"{prefix}{form % first}-{form % last}"] = held

    def deeper(m, inside, prefix, done):
        depth = prefix.count("/")
        if depth == 0:
            split(range(1, 13), lambda t: t.month, f"{m:04d}/", "%02d", inside)
        elif depth == 1:
            y = int(prefix[:4])
            split(range(1, calendar.monthrange(y, m)[1] + 1), lambda t: t.day, f"{prefix}{m:02d}/", "%02d", inside)
        elif depth == 2:
            split(range(24), lambda t: t.hour, f"{prefix}{m:02d}/", "%02d", inside)
        else:
            done.append([m, m, inside])

    timed = [r for r in rows if r[0] is not None]
    if timed:
        years = [r[0].year for r in timed]
        split(range(min(years), max(years) + 1), lambda t: t.year, "", "%04d", timed)
    if len(timed) < len(rows):
        found["null"] = [r for r in rows if r[0] is None]
    files = {}
    for leaf, held in found.items():
        held = sorted(held, key=lambda r: (r[0] or datetime.min, r[1] or datetime.min, -1 if r[2] is None else r[2]))
        for i in range(0, len(held), limit):
            files[leaf, i // limit + 1] = held[i : i + limit]
    return files


def expected(rows, limit, early):
    """rows: (ts, arrived_at, click_id, rest). Returns leaf, part to (n_rows, n_new, rewritten, ids_sha256)."""
    rows = [(moved(r[2], r[0]), *r[1:]) for r in rows]
    start, final = plain_layout([r for r in rows if early(r)], limit), plain_layout(rows, limit)
    out = {}
    for at, held in final.items():
        stays = sorted(map(repr, start.get(at, []))) == sorted(map(repr, held))
        out[at] = (len(held), sum(not early(r) for r in held), not stays, hashlib.sha256(",".join("" if r[2] is None else str(r[2]) for r in held).encode()).hexdigest())
    return out


def clicks_of(df):
    return [(r["ts"], r["arrived_at"], r["click_id"], (r["client_id"], r["kind"], r["value"], r["props"])) for r in df.collect()]


def local(path):
    return path.removeprefix("file:").replace("//", "/")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, data, sf):
    folder = data.replace("sf0.001", sf)
    df = spark.read.parquet(f"{folder}/clicks.parquet")
    rows = clicks_of(df)
    got = time_layout.op13_time_layout(spark, folder).collect()
    want = expected(rows, 1 + len(rows) // 650, lambda r: r[1] is not None and r[1] < datetime(2024, 3, 1))
    assert {(r["leaf"], r["part"]): (r["n_rows"], r["n_new"], r["rewritten"], r["ids_sha256"]) for r in got} == want
    assert len(got) == len(want) and any(not r["rewritten"] for r in got) and any(k[1] > 1 for k in want)
    top = local(got[0]["path"]).split("/leaf=")[0]
    assert sorted(glob.glob(f"{top}/**/*.parquet", recursive=True)) == sorted(local(r["path"]) for r in got)
    for r in got[:: max(1, len(got) // 40)]:
        f = pq.ParquetFile(local(r["path"])).read()
        assert f.column_names == df.columns == r["columns"].split(",")
        assert hashlib.sha256(",".join(map(str, f["click_id"].to_pylist())).encode()).hexdigest() == r["ids_sha256"] and len(f) == r["n_rows"]


def test_odd_tables(spark, data):
    df = spark.read.parquet(f"{data}/clicks.parquet").where("click_id % 7 = 0").select("*", F.lit("x").alias("leaf"), F.lit(1).alias("part"), F.lit("y").alias("_metadata"), F.lit(0).alias("_moment"))
    some = df.limit(30)
    hot = some.limit(1).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("i")
    unknown = some.withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("arrived_at", F.lit(None).cast("timestamp_ntz"))
    nameless = some.withColumn("click_id", F.lit(None).cast("bigint"))
    every = df.unionByName(hot).unionByName(unknown).unionByName(nameless)
    rows = [(*(r["ts"], r["arrived_at"]), r["click_id"], r["kind"]) for r in every.collect()]
    layout = time_layout.Layout(shared_dir(spark, "odd"), time_layout.click_moment(), ["arrived_at", "click_id"], 12)
    early = F.col("arrived_at") < F.lit("2024-02-01").cast("timestamp_ntz")
    layout.write(every.where(early))
    layout.write(every, ~F.coalesce(early, F.lit(False)))
    got = layout.report(every.schema, "click_id").collect()
    mine = lambda r: r[1] is not None and r[1] < datetime(2024, 2, 1)
    want = plain_layout([(moved(r[2], r[0]) if r[2] is not None else r[0], *r[1:]) for r in rows], 12)
    assert {(r["leaf"], r["part"]): (r["n_rows"], r["n_new"]) for r in got} == {k: (len(v), sum(not mine(r) for r in v)) for k, v in want.items()}
    assert {r["leaf"] for r in got} >= {"null"} and "leaf_=" in got[0]["path"]
    again = layout.write(every, F.lit(False))
    assert again.where("_stays is null").count() == 0  # nothing to do the second time


def test_empty_table(spark, data):
    empty = spark.read.parquet(f"{data}/clicks.parquet").where("click_id < 0")
    layout = time_layout.Layout(shared_dir(spark, "none"), time_layout.click_moment(), ["arrived_at", "click_id"], 1)
    layout.write(empty)
    assert layout.report(empty.schema, "click_id").collect() == []
    some = spark.read.parquet(f"{data}/clicks.parquet").where("click_id < 5")
    layout.write(some)
    assert sum(r["n_rows"] for r in layout.report(some.schema, "click_id").collect()) == some.count()
    layout.write(empty)
    assert layout.report(empty.schema, "click_id").collect() == []
