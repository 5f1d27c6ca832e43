"""Incremental graphs (described by the reference's design, not implemented there): a stream of changed
files replaces what those files contributed, and the affected values are merged again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuemesh.sources.css_theme import DECLARATIONS, parse_files, tokens_and_values


def follow(spark: SparkSession, files: DataFrame, table: str, checkpoint: str):
    """Starts a query over a stream of FILES rows: each batch deletes the declarations of its files from
    the Parquet table ``table`` and appends the new ones. The table is rewritten under a new version and
    the pointer moved, so readers see whole versions."""

    def apply(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("root", "file").agg(F.max_by(F.struct("path", "ord", "content"), "ord").alias("f"))
        files = latest.select("root", F.col("f.path").alias("path"), "file", F.col("f.ord").alias("ord"), F.col("f.content").alias("content"))
        new = parse_files(files)
        old = current(spark, table)
        kept = old.join(files.select("root", "file"), ["root", "file"], "left_anti") if old is not None else None
        out = new if kept is None else kept.unionByName(new)
        out.write.mode("overwrite").parquet(f"{table}/v{number}")
        spark.createDataFrame([(number,)], "version bigint").coalesce(1).write.mode("overwrite").json(f"{table}/pointer")

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The table's declarations, None before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/pointer/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    version = spark.read.schema("version bigint").json(f"{table}/pointer").first()["version"]
    return spark.read.schema(DECLARATIONS).parquet(f"{table}/v{version}")


def fragment(spark: SparkSession, table: str) -> tuple[DataFrame, DataFrame]:
    """The graph fragment of the table's present declarations."""
    return tokens_and_values(current(spark, table))
