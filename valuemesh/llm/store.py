"""Intermediate tables in the cluster's shared folder, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Written tables under the folder named in spark.checkpoint.dir.

    They cut lineage like a checkpoint, survive lost executors and are compressed. Where the setting
    is unset (tests, a local session) a folder of the driver's temporary directory is used.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="valuemesh-")
        self.base = f"{base.rstrip('/')}/valuemesh-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


#: A filter has BITS_A_KEY bits a key, rounded up to a power of two, and MOST_BITS (32 MB) at most. Beyond
#: some 30 million keys it lets more and more through: then more is shuffled, and the result is the same.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 8, 1 << 15, 1 << 28


def bit_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A filter over long keys, by their low bits, sized by their number; see :func:`passes`. It never holds
    a key back."""
    known = keys.where(F.col(key).isNotNull())
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * known.count() - 1).bit_length()))
    low = F.col(key).bitwiseAND(bits - 1)
    rows = known.select(F.shiftright(low, 15).alias("bucket"), low.bitwiseAND(32767).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:  # MOST_BITS / 32768 rows at most
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.astype(np.int64) & (8 * len(bits) - 1)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0


def passing(batches: Iterable[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose key (first column) may be among the filter's; null keys stay."""
    for batch in batches:
        ids = batch.column(0)
        known = pc.fill_null(ids, 0).to_numpy()
        yield batch.filter(pa.array(passes(bits, known) | ids.is_null().to_numpy(zero_copy_only=False)))


def prefiltered(df: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """The rows of ``df`` that are :func:`passing`, before they are shuffled. Where a function in Python comes
    next, let it call that itself: a second one in a stage is a second worker for each task."""
    assert df.columns[0] == key
    return df.mapInArrow(lambda batches: passing(batches, bits), df.schema)


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for every node of an edge. Edges are (a, b), long.

    Alternating large-star and small-star: every round is two aggregations and joins over the edges;
    a star around its least node is the fixed point. Hubs never meet in one task: minima are
    pre-aggregated, and the joins are such that adaptive execution splits skewed ones.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.write(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        roots = after.select(F.col("v").alias("u")).distinct()
        done = after.groupBy("u").count().where("count > 1").isEmpty() and after.join(roots, "u", "left_semi").isEmpty()
        scratch.drop(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
