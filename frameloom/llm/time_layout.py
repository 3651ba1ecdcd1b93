"""Adaptive time partitions: a Parquet folder whose files follow the calendar as finely as the rows lie, and rewriting it.

Rows are counted by hour. Years hold their rows as they are, or where they are too many are split into months, days and
hours; small neighbours share a leaf. Which leaf a row belongs to is looked up by its year, month, day and hour.

Only hours above the limit and rows without a moment fill more than one file. Their rows are numbered by a two-level
ranking: the leaves are cut into buckets, which are ranges of the rows' order; rows are counted in each bucket and the
counts summed over the buckets before it; row_number runs inside a bucket alone. The sum of both is a row's place in its
leaf and gives its part, so that no window holds a whole leaf.

What grows with the table: rows and the counts of hours, which stay distributed. Leaves and files don't: nodes above the
limit are fewer than rows/limit on each level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, drop_written, located, rooted, shared_dir, slices, written

#: Files that a table is meant to fill, about.
PARTS = 650
NULL = "null"
KEYS = ["_y", "_m", "_d", "_h"]

#: Runs of neighbours: a sibling within the limit joins the run of the one before it if that stays within the limit.
_RUNS = """aggregate(
  transform(sequence(lo, hi), x -> named_struct('at', x, 'n', coalesce(try_element_at(map_from_entries(kids), x), 0L))),
  cast(array() as array<struct<first: int, last: int, n: bigint, within: boolean>>),
  (runs, s) -> case
    when s.n <= {limit}L and try_element_at(runs, -1).within and try_element_at(runs, -1).n + s.n <= {limit}L
    then concat(slice(runs, 1, size(runs) - 1), array(named_struct('first', try_element_at(runs, -1).first, 'last', s.at, 'n', try_element_at(runs, -1).n + s.n, 'within', true)))
    else concat(runs, array(named_struct('first', s.at, 'last', s.at, 'n', s.n, 'within', s.n <= {limit}L))) end)"""


def hours_of(rows: DataFrame, moment: str) -> DataFrame:
    """Rows by year, month, day and hour (whole keys: 2024, 202403, 20240305, 2024030507) of a moment; null apart."""
    return _keyed(rows.select(moment), moment).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def _keyed(rows: DataFrame, moment: str) -> DataFrame:
    y = F.year(moment).cast("bigint")
    m = y * 100 + F.month(moment)
    d = m * 100 + F.day(moment)
    return rows.withColumns(dict(zip(KEYS, (y, m, d, d * 100 + F.hour(moment)))))


def leaves_of(hours: DataFrame, limit: int) -> DataFrame:
    """leaf, level, n, parts, first_file and keys (of the years, months, days or hours with rows), for each leaf."""
    timed = hours.where("_h is not null")
    for at, name in enumerate(("_ny", "_nm", "_nd")):
        timed = timed.withColumn(name, F.sum("n").over(Window.partitionBy(*KEYS[: at + 1])))
    level = F.when(F.col("_ny") <= limit, 1).when(F.col("_nm") <= limit, 2).when(F.col("_nd") <= limit, 3).otherwise(4)
    node = lambda k, key, n: F.struct(F.lit(k).alias("level"), F.expr(f"{key} div 100").alias("parent") if k else F.lit(0).cast("bigint").alias("parent"), (F.expr(f"{key} % 100") if k else F.col(key)).cast("int").alias("at"), F.col(n).alias("n"))
    nodes = F.array(*[node(k, key, n) for k, (key, n) in enumerate(zip(KEYS, ("_ny", "_nm", "_nd", "n")))])
    siblings = timed.select(F.explode(F.slice(nodes, 1, level)).alias("s")).groupBy("s.level", "s.parent", "s.at").agg(F.max("s.n").alias("n"))
    families = siblings.groupBy("level", "parent").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("kids"))
    days = F.day(F.last_day(F.expr("make_date(cast(parent div 100 as int), cast(parent % 100 as int), 1)")))
    lo = F.expr("case level when 0 then kids[0].at when 3 then 0 else 1 end")
    hi = F.when(F.col("level") == 0, F.expr("kids[size(kids) - 1].at")).when(F.col("level") == 1, 12).when(F.col("level") == 2, days).otherwise(23)
    runs = families.withColumn("lo", lo).withColumn("hi", hi.cast("int")).select("level", "parent", "kids", F.explode(F.expr(_RUNS.format(limit=limit))).alias("run")).where("run.n > 0 and (run.within or level = 3)")
    above = F.expr("case level when 0 then '' when 1 then format_string('%04d/', parent) when 2 then format_string('%04d/%02d/', parent div 100, parent % 100) else format_string('%04d/%02d/%02d/', parent div 10000, parent div 100 % 100, parent % 100) end")
    keys = F.expr("transform(filter(kids, k -> k.at between run.first and run.last), k -> parent * 100 + k.at)")
    named = runs.select(F.concat(above, F.expr("case level when 0 then format_string('%04d-%04d', run.first, run.last) else format_string('%02d-%02d', run.first, run.last) end")).alias("leaf"), "level", F.col("run.n").alias("n"), keys.alias("keys"))
    without = hours.where("_h is null").select(F.lit(NULL).alias("leaf"), F.lit(4).alias("level"), "n", F.array().cast("array<bigint>").alias("keys"))
    parts = F.expr(f"(n + {limit - 1}L) div {limit}L")
    order = Window.orderBy("leaf")
    return named.unionByName(without).withColumn("parts", parts).withColumn("first_file", F.coalesce(F.sum("parts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _placed(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows with _leaf, _parts and _first. Broadcast are the keys of leaves: years, and at most 67 for each node above the
    limit."""
    keys = leaves.select("level", F.explode("keys").alias("_key"), F.struct("leaf", "parts", "first_file").alias("_at"))
    out = _keyed(rows, "_moment")
    for level, key in enumerate(KEYS):
        of = keys.where(F.col("level") == level).select(F.col("_key").alias(key), F.col("_at").alias(f"_at{level}"))
        out = out.join(F.broadcast(of), key, "left")
    null = leaves.where(F.col("level") == 4).select(F.struct("leaf", "parts", "first_file").alias("_at4"))
    out = out.join(F.broadcast(null), F.col("_moment").isNull(), "left")
    at = F.coalesce(*[F.col(f"_at{k}") for k in range(5)])
    return out.withColumn("_at", at).select("_box", "_new", "_moment", *[c for c in rows.columns if c.startswith("_by")], "_file", "_row", F.coalesce("_at.leaf", F.lit(NULL)).alias("_leaf"), F.col("_at.parts").alias("_parts"), F.col("_at.first_file").alias("_first"))


def _ranked(rows: DataFrame, order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """rows of leaves above the limit with _part, by the two-level ranking, and the table of buckets. The buckets are written, so that a task that
    runs again finds the same ones; broadcast are a row for each bucket and leaf in it, no more than shuffle partitions
    and leaves together."""
    keys = ["_first", "_bucket"]
    buckets = written(rows.repartitionByRange("_first", *order).withColumn("_bucket", F.spark_partition_id()), "buckets")
    counts = buckets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_first").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    placed = buckets.withColumn("_inside", inside).join(F.broadcast(offsets), keys)
    return placed.withColumn("_part", F.expr(f"cast((_before + _inside - 1) div {limit}L + 1 as int)")).drop("_bucket", "_inside", "_before"), buckets


class Layout:
    """A folder of a table by time. moment: a timestamp of each row; order: columns that order rows of one moment (nulls
    first; what is equal in all of them goes by its place in the table's files); limit: rows of a file at most.

    Rows with a null moment fill the leaf ``null``. Repeated rows are rows like others. The table's own columns alone are
    in the files, whatever their names; an empty table leaves no file. What map columns hold can't be compared, so tables
    with them are refused by Spark. The folder's file system must be one that the driver and all executors share.
    """

    def __init__(self, folder: str, moment: Column, order: list[str], limit: int):
        self.folder, self.moment, self.order, self.limit = folder, moment, order, limit

    def _names(self, columns: list[str]) -> tuple[str, str]:
        """Names of the folders' levels that no column of the table has."""
        taken, names = {c.lower() for c in columns}, ("leaf", "part")
        while taken & set(names):
            names = tuple(f"{n}_" for n in names)
        return names

    def _assigned(self, rows: DataFrame, new: Column) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
        """Rows with _leaf, _part, _file_no and their order; the leaves; written tables to drop afterwards."""
        by = [f"_by{i}" for i in range(len(self.order))]
        rows = rooted(rows)
        tagged = located(rows, boxed(rows), new.alias("_new"), self.moment.cast("timestamp_ntz").alias("_moment"), *[F.col(f"`{c}`").alias(b) for c, b in zip(self.order, by)])
        self.by = ["_moment", *by, "_file", "_row"]
        leaves = written(leaves_of(hours_of(tagged, "_moment"), self.limit), "leaves")
        placed = _placed(tagged, leaves)
        ranked, buckets = _ranked(placed.where("_parts > 1"), self.by, self.limit)
        whole = placed.where("_parts = 1").withColumn("_part", F.lit(1))
        return whole.unionByName(ranked).withColumn("_file_no", F.col("_first") + F.col("_part") - 1), leaves, [buckets]

    def _write(self, assigned: DataFrame, columns: list[str], files: int) -> None:
        """A file for each leaf and part, each written by one task that sorts it, beside what the folder holds."""
        spark = assigned.sparkSession
        leaf, part = self._names(columns)
        tasks = max(1, min(files, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = assigned.repartitionById(tasks, (F.col("_file_no") % tasks).cast("int"))
        shaped = dealt.select(F.translate("_leaf", "/", ".").alias(leaf), F.col("_part").alias(part), *self.by, "_box").sortWithinPartitions(leaf, part, *self.by)
        shaped.select("_box.*", leaf, part).write.mode("append").partitionBy(leaf, part).parquet(self.folder)

    def files(self, schema: T.StructType) -> DataFrame:
        """The folder's rows as _box, with _leaf, _part, _path and _at (the row's place in its file)."""
        leaf, part = self._names(schema.names)
        df = self._spark.read.schema(T.StructType([*schema.fields, T.StructField(leaf, T.StringType()), T.StructField(part, T.IntegerType())])).parquet(self.folder)
        meta = df.metadataColumn("_metadata")
        box = F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("_box")
        return df.select(box, F.translate(F.col(leaf), ".", "/").alias("_leaf"), F.col(part).alias("_part"), meta["file_path"].alias("_path"), meta["row_index"].alias("_at"))

    def _exists(self) -> bool:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(path)

    def _delete(self, paths: list[str]) -> None:
        """Delete files, and folders that are empty then."""
        jvm, conf = self._spark._jvm, self._spark._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(p))
            store = path.getFileSystem(conf)
            store.delete(path, False)
            for _ in range(2):
                path = path.getParent()
                if len(store.listStatus(path)):
                    break
                store.delete(path, False)

    def write(self, rows: DataFrame, new: Column | None = None) -> DataFrame:
        """Make the folder hold exactly these rows, and return a row for each of its files: leaf, part, n_rows, n_new (rows
        for which ``new`` holds; all of them by default), rewritten, path.

        A file that is there stays if its leaf, part and rows recur: equal counts and equal sums of two 64-bit hashes of
        whole rows. New files are written beside it, whole or not at all, and those that are over are deleted after that.
        """
        self._spark = spark = rows.sparkSession
        schema, columns = rows.schema, rows.columns
        assigned, leaves, scratch = self._assigned(rows, F.lit(True) if new is None else new)
        total = lambda *seed: F.sum(F.xxhash64(*seed, "_box").cast("decimal(20,0)"))
        digest = [F.count(F.lit(1)).alias("n_rows"), total().alias("_s"), total(F.lit(7)).alias("_t")]
        planned = assigned.groupBy("_file_no", "_leaf", "_part").agg(*digest, F.count_if("_new").alias("n_new"))
        if self._exists():
            held = written(self.files(schema).groupBy("_leaf", "_part", "_path").agg(*digest), "held")
            same = held.groupBy("_leaf", "_part", "n_rows", "_s", "_t").agg(F.min("_path").alias("_stays"))
            planned = planned.join(same, ["_leaf", "_part", "n_rows", "_s", "_t"], "left")
            scratch.append(held)
        else:
            held, planned = None, planned.withColumn("_stays", F.lit(None).cast("string"))
        plan = written(planned.select("_file_no", "_leaf", "_part", "n_rows", "n_new", "_stays"), "plan")
        files = int(leaves.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0])
        changed = plan.where("_stays is null").select("_file_no")
        self._write(assigned.join(F.broadcast(changed), "_file_no", "left_semi"), columns, files)
        if held is not None:
            over = held.join(plan.select(F.col("_stays").alias("_path")), "_path", "left_anti")
            self._delete([r[0] for r in over.select("_path").collect()])
        for table in [*scratch, leaves]:
            drop_written(table)
        self.plan = plan
        return plan

    def report(self, schema: T.StructType, key: str) -> DataFrame:
        """What the folder holds after write(): leaf, part, columns, n_rows, n_new, rewritten, path, and ids_sha256 over
        the decimal keys in file order, joined by commas (a null key is empty). Files are read as Spark reads them; a task
        takes a file's keys in order and holds a batch of them."""
        spark = self._spark
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = self.files(schema).select("_leaf", "_part", "_path", "_at", F.col(f"_box.`{key}`").cast("string").alias("_key"))
        rows = rows.join(F.broadcast(self.plan), ["_leaf", "_part"])
        dealt = rows.repartitionById(n, (F.col("_file_no") % n).cast("int")).sortWithinPartitions("_file_no", "_path", "_at")
        names = ["leaf", "part", "n_rows", "n_new", "rewritten", "path", "ids_sha256"]

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = about = sha = None
            count = 0

            def done() -> pa.RecordBatch:
                values = (about["_leaf"], about["_part"], count, about["n_new"], about["_stays"] is None, about["_path"], sha.hexdigest())
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()))], names)

            for batch in slices(batches, 100_000):
                path = batch.column("_path").dictionary_encode()
                turns = [i for i, (a, b) in enumerate(zip(path.indices, path.indices[1:]), 1) if a != b] if len(path.dictionary) > 1 else []
                for lo, hi in zip([0, *turns], [*turns, batch.num_rows]):
                    part = batch.slice(lo, hi - lo)
                    head = part.slice(0, 1).to_pylist()[0]
                    if head["_path"] != now:
                        if now is not None:
                            yield done()
                        now, about, sha, count = head["_path"], head, hashlib.sha256(), 0
                    sha.update(("," * (count > 0) + ",".join(x or "" for x in part.column("_key").to_pylist())).encode())
                    count += hi - lo
            if now is not None:
                yield done()

        out = dealt.mapInArrow(digest, "leaf string, part int, n_rows bigint, n_new bigint, rewritten boolean, path string, ids_sha256 string")
        return out.withColumn("columns", F.lit(",".join(schema.names)))


def click_moment() -> Column:
    """The moment of a click: its ts, for some clicks years earlier or at the beginning of their week."""
    k = "crc32(cast(click_id as string)) % 128"
    ts = "cast(ts as timestamp_ntz)"
    return F.expr(f"case when {k} < 16 then {ts} - make_dt_interval(cast(({k} + 6) * ({k} + 6) * ({k} + 6) as int)) when {k} > 111 then cast(date_sub(cast({ts} as date), weekday({ts})) as timestamp_ntz) else {ts} end")


def op13_time_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks laid out by time up to March, then again with all rows."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    layout = Layout(shared_dir(spark, "time-layout"), click_moment(), ["arrived_at", "click_id"], 1 + clicks.count() // PARTS)
    early = F.col("arrived_at") < F.lit("2024-03-01").cast("timestamp_ntz")
    drop_written(layout.write(clicks.where(early)))
    layout.write(clicks, ~F.coalesce(early, F.lit(False)))
    return layout.report(clicks.schema, "click_id")
