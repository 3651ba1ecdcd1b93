"""What the operators share: the shared work folder, written tables, a bounded bitmap filter, text helpers.

Work folders lie under ``spark.checkpoint.dir``, which driver and executors share. Only where that setting is
absent (tests in one process) a temporary folder is made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One word: a run without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Nothing is created yet; writers do that."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        key = context.applicationId
        if key not in _LOCAL:
            _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="frameloom-")
        root = _LOCAL[key]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches, so that what is made of them doesn't add up in a worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column) -> Iterator[str | None]:
    """The strings of an Arrow column one by one, without holding all of them as Python objects."""
    return (x.as_py() for x in column)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: a cut of lineage that outlives executors. The
    table goes when the driver ends, or earlier by drop_written()."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads them any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_of(docs: DataFrame) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


#: Bits of a bitmap filter: 2 MB at least, 64 MB at most; between them eight a key.
BITS, MOST_BITS = 1 << 24, 1 << 29
_BUCKET = 32768


def bits_for(keys: int) -> int:
    """The size of a bitmap of so many keys: a power of two. Beyond the largest the filter lets more and more rows pass;
    what follows it is exact, so that costs time alone."""
    return min(MOST_BITS, max(BITS, 1 << (8 * max(keys, 1) - 1).bit_length()))


def bitmap_of(keys: DataFrame, key: list[str], bits: int = BITS) -> DataFrame:
    """A bitmap of the hashed keys, at most bits/32768 rows of 4 KB each: safe to broadcast at any input size."""
    bit = F.pmod(F.xxhash64(*key), F.lit(bits))
    return keys.select(bit.alias("_bit")).groupBy(F.expr(f"_bit div {_BUCKET}").alias("_bm_bucket")).agg(F.bitmap_construct_agg(F.col("_bit") % _BUCKET).alias("_bm"))


def _flagged(df: DataFrame, key: list[str], bitmap: DataFrame, bits: int) -> DataFrame:
    at = F.col("_bit") % _BUCKET
    byte = F.conv(F.hex(F.substring("_bm", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumn("_bit", F.pmod(F.xxhash64(*key), F.lit(bits)))
        .withColumn("_bm_bucket", F.expr(f"_bit div {_BUCKET}"))
        .join(F.broadcast(bitmap), "_bm_bucket", "left")
        .withColumn("_byte", F.coalesce(byte, F.lit(0)))
        .withColumn("_maybe", F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1)
        .drop("_bit", "_bm_bucket", "_bm", "_byte")
    )


def maybe_in(df: DataFrame, key: list[str], keys: DataFrame) -> DataFrame:
    """Rows of df whose key may be in keys (a written table): no false negatives, some false positives.
    A prefilter before an exact step; when full it lets all rows pass, and the exact step stays right."""
    bits = bits_for(keys.count())
    return _flagged(df, key, bitmap_of(keys, key, bits), bits).where("_maybe").drop("_maybe")


def without(df: DataFrame, key: list[str], dropped: DataFrame, bits: int | None = None) -> DataFrame:
    """Rows of df whose key isn't in dropped (a written table). Only rows that the bitmap can't clear are shuffled; those
    are compared by the key itself."""
    bits = bits or bits_for(dropped.count())
    flagged = _flagged(df, key, bitmap_of(dropped, key, bits), bits)
    clear = flagged.where("not _maybe").drop("_maybe")
    rest = flagged.where("_maybe").drop("_maybe").join(dropped.select(*key).distinct(), key, "left_anti")
    return clear.unionByName(rest.select(*clear.columns))


def _place(docs: DataFrame) -> list[Column]:
    """File and row of each row, also where the table has a column called _metadata."""
    meta = docs.metadataColumn("_metadata")
    return [meta["file_path"].alias("_file"), meta["row_index"].alias("_row")]


def rooted(docs: DataFrame) -> DataFrame:
    """docs itself if its rows come straight from files, else a copy written to the shared folder. Its rows can be located."""
    try:
        docs.select(*_place(docs)).schema
        return docs
    except AnalysisException:
        return written(docs, "rows")


def located(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns and a content locator for each row: _file (path) and _row (row in the file). To locate rows of the
    same table twice, root it first."""
    docs = rooted(docs)
    return docs.select(*columns, *_place(docs))


def boxed(docs: DataFrame) -> Column:
    """The whole row as one column _box, so that no name of its columns can clash; select("_box.*") opens it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_box")


#: The columns that located() adds.
LOCATOR = ["_file", "_row"]
