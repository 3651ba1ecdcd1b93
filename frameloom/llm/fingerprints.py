"""Document fingerprints as invertible Bloom lookup sketches.

A text is the set of its paragraphs (lines, cut every 400 characters), each as a 62-bit digest that includes how often it
occurs. A text of few paragraphs has its sentences, too; one of few sentences its words, and a very short one pieces of
four characters: so half of a text counts for something in texts of any length. Each digest is added to three cells of a
table of 48 cells: to its count, to the exclusive-or of digests and of check sums. That table is the fingerprint. The tables
of two versions subtract cell by cell. What is left is peeled: a cell that holds one digest gives it up, the digest leaves
its other cells, and so on, until the digests that only one version has are known. Where cells remain, the two differ in
more than the tables can tell; that pair is tried again with larger tables of the two sets, each GROW times the last.

DataFrame operations only. A fingerprint's table is one array, made, subtracted and peeled within its row; larger tables are
rows of cells, all of a pair in one partition, so rounds of peeling need no exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

CELLS = 48
HASHES = 3
GROW = 4
ROUNDS = 12
#: Tables so many times as large as both sets together must decode; beyond them sets are compared as they are.
AMPLE = 16
#: Paragraphs are cut at PIECE characters, sentences at SENTENCE; fewer than FEW of a kind are joined by the next finer
#: kind, and texts under SHORT characters by pieces of TINY.
PIECE, SENTENCE, FEW, SHORT, TINY = 400, 100, 8, 64, 4
_CELL = "struct<slot: bigint, n: bigint, key: bigint, chk: bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _marked(pieces: Column, kind: int) -> Column:
    return F.transform(pieces, lambda p: F.xxhash64(F.lit(kind), p))


def piece_hashes(text: Column) -> Column:
    """Hashes of the text's pieces, in no order, as often as they occur. Line breaks and empty lines are no part."""
    none = F.array().cast("array<bigint>")
    words = F.when(F.char_length(text) < SHORT, _marked(_found(text, f"[^\\n]{{1,{TINY}}}"), 4)).otherwise(none)
    words = lambda q, w=words: F.when(F.size(q) < FEW, F.concat(_marked(_found(text, "[^\\s]+"), 3), w)).otherwise(w)
    finer = _let(_found(text, f"[^\\n.!?]{{0,{SENTENCE}}}[.!?]+|[^\\n.!?]{{1,{SENTENCE}}}"), lambda q: F.concat(_marked(q, 2), words(q)))
    return _let(_found(text, f"[^\\n]{{1,{PIECE}}}"), lambda p: F.concat(_marked(p, 1), F.when(F.size(p) < FEW, finer).otherwise(none)))


def digests(text: Column) -> Column:
    """The text's distinct pieces as digests of 62 bits; a digest includes how often its piece occurs."""
    none = F.array().cast("array<bigint>")

    def counted(s: Column) -> Column:
        last = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i + 1)))
        one = lambda e: F.transform(e, lambda i, k: F.shiftrightunsigned(F.xxhash64(F.get(s, i), i - F.coalesce(F.get(e, k - 1), F.lit(-1))), 2))
        return F.when(F.size(s) > 0, _let(last, one)).otherwise(none)

    return F.array_distinct(_let(F.sort_array(piece_hashes(text)), counted))


def _check(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(99)), F.lit(1 << 32))


def _slot(key: Column, j: int, cells: Column) -> Column:
    part = F.floor(cells / HASHES)
    return (F.pmod(F.xxhash64(key, F.lit(j)), part) + j * part).cast("bigint")


def _entry(slot: Column, n: Column, key: Column) -> Column:
    return F.struct(slot.alias("slot"), n.cast("bigint").alias("n"), key.alias("key"), _check(key).alias("chk"))


def _added(keys: Column, sign: int, cells: Column) -> Column:
    """One entry for each digest and hash."""
    return F.flatten(F.transform(keys, lambda k: F.array(*[_entry(_slot(k, j, cells), F.lit(sign), k) for j in range(HASHES)])))


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "slot").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk")).where("n <> 0 or key <> 0 or chk <> 0")


def table_of(ids: Column, cells: int = CELLS) -> Column:
    """The table of a set as an array of cells n, key, chk."""
    part = cells // HASHES
    hashed = F.transform(ids, lambda k: F.struct(k.alias("key"), _check(k).alias("chk"), F.array(*[_slot(k, j, F.lit(cells)) for j in range(HASHES)]).alias("at")))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("n", "key", "chk")])
    add = lambda c, x: F.struct((c["n"] + 1).alias("n"), c["key"].bitwiseXOR(x["key"]).alias("key"), c["chk"].bitwiseXOR(x["chk"]).alias("chk"))
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint"))
    return _let(hashed, lambda h: F.transform(slots, lambda s: F.aggregate(F.filter(h, lambda x: F.get(x["at"], F.floor(s / part).cast("int")) == s), zero, add)))


def shown(table: Column, cells: int = CELLS) -> Column:
    """A table as text: its cells that hold anything, in order, as slot, count, digests and check sums in hexadecimal."""
    cell = lambda c, s: F.concat(F.lpad(F.hex(s), 2, "0"), F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["chk"]), 8, "0"))
    return F.concat(F.lit(f"{cells}x{HASHES}:"), F.array_join(F.transform(table, lambda c, s: F.when(c["n"] > 0, cell(c, s)).otherwise(F.lit(""))), ""))


def _less(a: Column, b: Column) -> Column:
    return F.struct((a["n"] - b["n"]).alias("n"), a["key"].bitwiseXOR(b["key"]).alias("key"), a["chk"].bitwiseXOR(b["chk"]).alias("chk"))


def subtracted(a: Column, b: Column, cells: int = CELLS) -> Column:
    """What two tables tell of their sets' difference: struct of a_only and b_only (numbers of digests), null where cells
    remain after peeling. A third of the table is peeled at a time: a digest lies in one cell of each third, so none is
    taken twice."""
    part = cells // HASHES
    left = lambda t: F.exists(t, lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0))
    state = lambda t, x, y: F.struct(t.alias("t"), x.alias("a_only"), y.alias("b_only"))

    def taken(st: Column, j: Column) -> Column:
        third = F.slice(st["t"], j * part + 1, F.lit(part))
        pure = F.filter(third, lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["key"])))
        at = lambda c, i: (F.pmod(F.xxhash64(c["key"], i), F.lit(part).cast("bigint")) + i * part).cast("bigint")
        without = lambda p: F.transform(st["t"], lambda c, s: F.aggregate(F.filter(p, lambda x: at(x, F.floor(s / part).cast("int")) == s), c, _less))
        some = lambda p: state(without(p), st["a_only"] + F.size(F.filter(p, lambda c: c["n"] == 1)), st["b_only"] + F.size(F.filter(p, lambda c: c["n"] == -1)))
        return _let(pure, lambda p: F.when(F.size(p) > 0, some(p)).otherwise(st))

    start = state(F.zip_with(a, b, _less), F.lit(0), F.lit(0))
    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    peel = lambda st, t: F.when(left(st["t"]), taken(st, F.pmod(t, F.lit(HASHES)))).otherwise(st)
    return F.aggregate(turns, start, peel, lambda st: F.when(~left(st["t"]), F.struct(st["a_only"].alias("a_only"), st["b_only"].alias("b_only"))))


def _told(a: Column, b: Column) -> Column:
    """The likeness that two tables tell; null where they don't."""
    size = F.aggregate(a, F.lit(0).cast("bigint"), lambda n, c: n + c["n"]) / HASHES
    return _let(subtracted(a, b), lambda d: F.when(d.isNotNull(), _ratio(size, d["a_only"], d["b_only"])))


def _peeled(cells_of: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """Rounds of peeling, one third of the table at a time: a digest lies in one cell of each third, so none is taken
    twice in a round. A digest taken becomes a row of its own, with a negative slot. cells: the size of the pair's table."""
    part = F.floor(F.col("cells") / HASHES)
    for t in range(rounds):
        j = t % HASHES
        pure = (F.abs("n") == 1) & (F.col("chk") == _check(F.col("key"))) & F.col("slot").between(j * part, (j + 1) * part - 1)
        leave = [_entry(_slot(F.col("key"), i, F.col("cells")), -F.col("n"), F.col("key")) for i in range(HASHES) if i != j]
        taken = F.array(_entry(-F.col("key") - 1, F.col("n"), F.col("key")), *leave)
        stays = F.array(F.struct("slot", "n", "key", "chk"))
        cells_of = _summed(cells_of.select(*by, "cells", F.inline(F.when(pure, taken).otherwise(stays).cast(f"array<{_CELL}>"))), [*by, "cells"])
    return cells_of


def differences(pairs: DataFrame, by: list[str], cells: int = CELLS) -> DataFrame:
    """by, a_size, b_size, a_only, b_only (arrays of digests) for each pair of sets a, b (array<bigint> of digests of 62
    bits; repeated ones count once), by tables larger than ``cells``. by names what identifies a pair. A pair's first table
    is the smallest of cells * GROW, cells * GROW * GROW ... that has a cell for each of its digests. Pairs that don't decode go on to tables GROW times as large;
    a table AMPLE times as large as both sets that still doesn't (equal slots or check sums by chance) is given up for the
    sets themselves."""
    both = pairs.select(*by, F.array_distinct("a").alias("a"), F.array_distinct("b").alias("b"))
    need = F.greatest((F.size("a") + F.size("b")) / cells, F.lit(float(GROW)))
    todo = both.withColumn("cells", (cells * F.pow(F.lit(float(GROW)), F.ceil(F.log(float(GROW), need) - 1e-9))).cast("bigint"))
    done, none = None, F.array().cast("array<bigint>")
    while True:
        spread = todo.repartition(*by)
        rows = spread.select(*by, "cells", F.inline(F.concat(_added(F.col("a"), 1, F.col("cells")), _added(F.col("b"), -1, F.col("cells")))))
        left = _peeled(_summed(rows, [*by, "cells"]), by, ROUNDS)
        only = lambda n: F.collect_list(F.when((F.col("slot") < 0) & (F.col("n") == n), F.col("key")))
        found = left.groupBy(*by).agg(F.count_if(F.col("slot") >= 0).alias("stuck"), only(1).alias("a_only"), only(-1).alias("b_only"))
        ample = F.col("cells") >= AMPLE * (F.size("a") + F.size("b"))
        open_ = F.coalesce("stuck", F.lit(0)) > 0
        result = lambda got, x, y: F.when(open_ & ample, F.array_except(x, y)).when(open_, none).otherwise(F.coalesce(got, none))
        again = open_ & ~ample
        tried = spread.join(found, by, "left").select(
            *by,
            F.size("a").alias("a_size"),
            F.size("b").alias("b_size"),
            again.alias("again"),
            result("a_only", "a", "b").alias("a_only"),
            result("b_only", "b", "a").alias("b_only"),
            F.when(again, F.col("a")).alias("a"),
            F.when(again, F.col("b")).alias("b"),
            (F.col("cells") * GROW).alias("cells"),
        )
        tried = written(tried, "sketches")
        good = tried.where("not again").select(*by, "a_size", "b_size", "a_only", "b_only")
        done = good if done is None else done.unionByName(good)
        todo = tried.where("again").select(*by, "a", "b", "cells")
        if not todo.limit(1).count():
            return done


def _ratio(a_size: Column, a_only: Column, b_only: Column) -> Column:
    every = a_size + b_only
    return F.when(every > 0, (a_size - a_only) / every).otherwise(F.lit(1.0))


def likeness(a_size: Column, a_only: Column, b_only: Column) -> Column:
    """Shared digests over all digests of both; 1 for two empty texts."""
    return _ratio(a_size, F.size(a_only), F.size(b_only))


def next_ids(sized: DataFrame) -> DataFrame:
    """doc_id, n, next_id: the next larger doc_id; after the largest, the smallest. sized: doc_id (distinct), n.
    Ids are range partitioned; the last of a partition is followed by the first of the next."""
    parts = written(sized.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    firsts = parts.groupBy("part").agg(F.min("doc_id").alias("first"))  # as many rows as partitions
    order = Window.orderBy("part")
    follow = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(order)).alias("follow"))
    return parts.withColumn("_in", inside).join(follow, "part").select("doc_id", "n", F.coalesce("_in", "follow").alias("next_id"))


def fingerprint_edits(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    The edited text keeps the first half (rounded up) and goes on with as many code points of the next document, by
    ascending doc_id, as it lost. Null text counts as empty; an empty text has a table without cells. Rows that repeat a
    doc_id count once, with the shortest (then smallest) text; rows with a null doc_id have no place in the order and
    are left out. A single document follows itself. Empty tables give empty results; extra columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    order = written(next_ids(rows.groupBy("doc_id").agg(F.min(F.char_length("text")).alias("n"))), "order")
    whole = rows.groupBy("doc_id").agg(F.min(F.struct(F.char_length("text").alias("n"), F.col("text"))).alias("t")).select("doc_id", "t.n", "t.text")
    before = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), F.expr("n div 2").cast("int").alias("half"))
    heads = whole.join(before, "doc_id").select(F.col("prev_id").alias("doc_id"), F.substring("text", F.lit(1), F.col("half")).alias("head"))
    both = whole.join(heads, "doc_id").withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n") - F.expr("n div 2")).cast("int")), F.col("head")))
    kinds = F.array(F.struct(F.lit("a").alias("kind"), digests(F.col("text")).alias("ids")), F.struct(F.lit("e").alias("kind"), digests(F.col("edited")).alias("ids")))
    sets = both.select("doc_id", F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("sha"), F.inline(kinds))
    sets = written(sets, "paragraphs")
    own, edited = sets.where("kind = 'a'"), sets.where("kind = 'e'").select("doc_id", F.col("ids").alias("e"))
    following = own.select("doc_id", F.col("ids").alias("f")).join(before, "doc_id").select(F.col("prev_id").alias("doc_id"), "f")
    triples = own.select("doc_id", "n_chars", "sha", F.col("ids").alias("a")).join(edited, "doc_id").join(following, "doc_id")
    tables = triples.withColumns({f"t{c}": table_of(F.col(c), cells) for c in "aef"})
    likely = tables.withColumns({"near_e": _told(F.col("ta"), F.col("te")), "near_f": _told(F.col("ta"), F.col("tf"))})
    open_ = lambda c, *near: F.when(reduce(lambda x, y: x | y, [F.col(n).isNull() for n in near]), F.col(c)).alias(c)
    told = written(
        likely.select("doc_id", "n_chars", "sha", shown(F.col("ta"), cells).alias("fingerprint"), shown(F.col("te"), cells).alias("edited_fingerprint"), "near_e", "near_f", open_("a", "near_e", "near_f"), open_("e", "near_e"), open_("f", "near_f")),
        "prints",
    )
    pair = lambda kind, b: F.when(F.col(f"near_{b}").isNull(), F.struct(F.lit(kind).alias("kind"), F.col("a"), F.col(b).alias("b")))
    pairs = told.select("doc_id", F.inline(F.filter(F.array(pair("e", "e"), pair("n", "f")), lambda p: p.isNotNull())))
    near = differences(pairs, ["doc_id", "kind"], cells).withColumn("near", likeness(F.col("a_size"), F.col("a_only"), F.col("b_only")))
    near = near.groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "e", F.col("near"))).alias("larger_e"), F.max(F.when(F.col("kind") == "n", F.col("near"))).alias("larger_f"))
    out = told.join(near, "doc_id", "left")
    return out.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", F.coalesce("near_e", "larger_e").alias("near_edited"), F.coalesce("near_f", "larger_f").alias("near_next"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
