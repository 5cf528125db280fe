"""What the operators of this subpackage share: column picking, materialised steps, components.

Spark's executors can be lost at any time, so a step that several later steps read is
written as a Parquet table in the folder that the cluster names in ``spark.checkpoint.dir``;
a lost executor then costs a task and not the lineage.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the normalisations of this subpackage define it.
SPACE = " \t\n\x0b\x0c\r"
#: The bits of sieved()'s filter, at most: 16 MB.
SIEVE_BITS = 1 << 27
#: Rows that are handed to Python at once: of whole texts, which are held several times over; and of numbers.
BATCH_ROWS, LARGE = 1000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns, cast to the given types, and no other.

    Columns are found by their exact name first, so that extra columns whose names clash
    (in another case, or with a name that an operator uses inside) don't matter.
    """
    plain = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    at = {c.lower(): i for i, c in reversed(list(enumerate(df.columns)))} | {c: i for i, c in reversed(list(enumerate(df.columns)))}
    return plain.select(*(F.col(f"_c{at[n]}").cast(kind).alias(n) for n, kind in wanted.items()))


def hidden(df: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The frame under names that clash with nothing, its old names, and where each is now."""
    new = [f"_c{i}" for i in range(len(df.columns))]
    where = {c.lower(): n for c, n in reversed(list(zip(df.columns, new, strict=True)))} | {c: n for c, n in reversed(list(zip(df.columns, new, strict=True)))}
    return df.toDF(*new), df.columns, where


def shown(df: DataFrame, names: list[str]) -> DataFrame:
    """Undoes hidden()."""
    return df.select(*(f"_c{i}" for i in range(len(names)))).toDF(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = spark.conf.get("lodestone.shared.dir", None) or "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("lodestone.shared.dir", place)
    return f"{place.rstrip('/')}/lodestone/{spark.sparkContext.applicationId}"


def small_batches(spark: SparkSession) -> None:
    """Hands at most BATCH_ROWS rows at once to Python: whole texts are long, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text as bytes of UTF-8) of docs, for functions that take Arrow batches."""
    return pick(docs, doc_id="long", text="string").withColumn("text", F.col("text").cast("binary"))


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """df, written as a table in the shared folder and read again; Python gets batch_rows at once meanwhile."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def marked_by(rows: DataFrame, id: Column, ids: DataFrame, max_bits: int = SIEVE_BITS) -> DataFrame:
    """rows with _may: whether their id may be among ids (id); never null.

    A Bloom filter of one hash, as bitmaps that are broadcast: 16 bits for each id, in a power of two, at
    most max_bits. Beyond that many ids it fills and lets more rows through.
    """
    bits = min(max_bits, 1 << max(15, math.ceil(math.log2(16 * max(1, ids.count())))))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = F.bitmap_bit_position(slot(id))
    maps = ids.select(slot(F.col("id")).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bitmap"))
    byte = F.conv(F.hex(F.substring("_bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(maps), F.bitmap_bucket_number(slot(id)) == F.col("_bucket"), "left")
    return found.withColumn("_may", id.isNotNull() & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bitmap")


def sieved(rows: DataFrame, ids: DataFrame, max_bits: int = SIEVE_BITS) -> DataFrame:
    """The rows (id, any others) whose id may be among ids (id), as marked_by() tells; a join that follows makes it exact. Null ids go."""
    return marked_by(rows, F.col("id"), ids, max_bits).filter("_may").drop("_may")


def without(rows: DataFrame, id: Column, gone: DataFrame, max_bits: int = SIEVE_BITS) -> DataFrame:
    """The rows whose id isn't among gone (id): only rows that may be are shuffled, the rest pass straight through. Null ids stay."""
    marked = marked_by(rows, id, gone, max_bits)
    stay = marked.filter("_may").join(gone.select(F.col("id").alias("_gone")), id == F.col("_gone"), "left_anti")
    return marked.filter("NOT _may").unionByName(stay).drop("_may")


def components(edges: DataFrame, nodes_name: str = "id", rounds: int = 60) -> DataFrame:
    """(id, component) of each end of edges (a, b): component is the smallest id reachable.

    Contraction: in each round every node points to its smallest neighbour or itself, chains of
    pointers are followed to their ends by doubling, edges move to where their ends point, and loops
    and repeats go. A node that stays had a neighbour that went, so the nodes at least halve each round.
    All of it is grouping and joining on ids; a hub's edges are minimised map-side and its join
    is split by adaptive execution.
    """
    left = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct()
    left = written(left, "edges")
    done = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component"))
        to = written(to, "pointers")
        while True:
            far = to
            for _ in range(2):
                far = far.join(to.select(F.col("id").alias("component"), F.col("component").alias("next")), "component", "left").select("id", F.coalesce("next", "component").alias("component"))
            far = written(far, "pointers")
            moving = not far.join(to, ["id", "component"], "left_anti").isEmpty()
            forget(to)
            to = far
            if not moving:
                break
        if done is None:
            new_done = to
        else:
            new_done = done.join(to.select(F.col("id").alias("component"), F.col("component").alias("next")), "component", "left").select("id", F.coalesce("next", "component").alias("component"))
        new_done = written(new_done, "components")
        moved = (
            left.join(to.select(F.col("id").alias("a"), F.col("component").alias("a2")), "a")
            .join(to.select(F.col("id").alias("b"), F.col("component").alias("b2")), "b")
            .filter("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct()
        )
        moved = written(moved, "edges")
        for old in (left, to, *([done] if done is not None else [])):
            if old is not new_done:
                forget(old)
        left, done = moved, new_done
    else:
        raise RuntimeError("the components didn't settle")
    if done is None:
        done = left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return done.withColumnRenamed("id", nodes_name)


def no_space(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")
