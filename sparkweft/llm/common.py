"""What the operators share: shared-folder tables, Arrow batches, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Whole texts travel in them, so they are kept few.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only where none is set, on a single machine as in tests, one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again.

    This cuts the lineage: a lost executor costs only reads of the table, and
    a later plan sees its true size.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Spark lets go of shuffles and broadcasts that nothing refers to, and the driver's heap of what it no longer needs.

    Spark removes them when the driver's JVM collects their handles. A heap
    with room left puts that off, so over many steps the driver's heap grows
    to its limit, and they pile up on the executors and on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame, name: str) -> DataFrame:
    """A staged table, after which Spark lets go of what made it, for jobs of many steps."""
    out = staged(df, name)
    let_go(df.sparkSession)
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the table has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        i, made = 0, f"__{name}"
        while made.lower() in taken:
            i, made = i + 1, f"__{name}_{i}"
        taken.add(made.lower())
        out.append(made)
    return out


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most BATCH_ROWS rows at once, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def column_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null gives b""."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def column_texts(column: pa.Array) -> list[str]:
    """Each value as text; null gives an empty one, bytes that are no UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of that column, of one row at least."""
    sizes = [len(x) for x in column_bytes(batch.column(column))] if batch.num_rows else []
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if sizes:
        yield batch.slice(start)


#: Bits that the map of ``maybe_in`` has for a key, and at most: 8 MB.
KEY_BITS, MAP_BITS = 16, 1 << 26


def maybe_in(rows: DataFrame, column: str, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false only if the column's value is not among the keys; null is a value.

    The map of the keys' hashes is of MAP_BITS / 8 bytes at most, whatever
    their number: values that share a bit only make it say true too often.
    So it goes to every task, and rows that it tells apart need no shuffle.
    The keys are counted first, so they should be a written table.
    """
    size = min(MAP_BITS, 1 << max(15, (KEY_BITS * keys.count()).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(size)) + 1
    bucket_, bits_ = fresh_names(rows, "bucket", "bits")
    bits = keys.select(bit(key).alias("b")).groupBy(F.bitmap_bucket_number("b").alias(bucket_)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias(bits_))
    at = F.bitmap_bit_position(bit(column)).cast("int")
    byte = F.conv(F.hex(F.substring(bits_, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn(bucket_, F.bitmap_bucket_number(bit(column))).join(F.broadcast(bits), bucket_, "left")
    return told.withColumn(flag, F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))).select(*rows.columns, flag)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for batches, which at its end gives freed memory back: workers live on and serve later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


#: Edges that one task connects by itself: 16 bytes each.
FEW_EDGES = 500_000


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) of the edges of all batches: least labels spread along edges, and along labels."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    a, b = (np.concatenate(x) for x in zip(*got, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "to"])


def connected_components(edges: DataFrame, node_type: str = "bigint", few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for each node of an undirected edge list (a, b).

    Each round every node takes the neighbour of least priority, itself
    included, and the edges are relabelled by it. The priority is a hash of
    the node, so chains that are sorted by node do not unroll one by one; the
    edges shrink by a constant factor a round. The maps of the rounds are then
    composed, last first. Every round is a written table, after which Spark
    lets go of its shuffles. As soon as ``few`` edges or less are left one
    task ends the work.

    Nodes with many edges cost no single task: the minimum is combined before
    the shuffle and relabelling is a plain join that Spark may split.
    """
    spark = edges.sparkSession
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    now = settled(edges.select(F.col("a").cast(node_type), F.col("b").cast(node_type)).where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while left := now.count():
        if left <= few:
            maps.append(settled(now.coalesce(1).mapInArrow(_rooted, f"node {node_type}, to {node_type}"), "step"))
            break
        ways = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = ways.groupBy("a").agg(F.min(key("b")).alias("m"))
        up = F.when(F.col("m") < key("a"), F.col("m.n")).otherwise(F.col("a"))
        step = settled(best.select(F.col("a").alias("node"), up.alias("to")), "step")
        maps.append(step)
        to_a, to_b = step.select(F.col("node").alias("a"), F.col("to").alias("a2")), step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        new = now.join(to_a, "a").join(to_b, "b").where("a2 <> b2")
        now = settled(new.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    if not maps:
        return spark.createDataFrame([], f"node {node_type}, root {node_type}")
    out = maps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("to"), F.col("root").alias("_r"))
        out = settled(step.join(later, "to", "left").select("node", F.coalesce("_r", "to").alias("root")), "roots")
    return out


