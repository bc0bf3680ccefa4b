"""Dataset, result and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxtrail import schemas as S
from boxtrail.sources.readers import read_results


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    """Dataset as parquet or JSON lines, optionally one folder per split."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(by) if by else writer).save(path)


def append_results(scored: DataFrame, path: str, text_chars: int | None = None) -> None:
    """Scored rows appended as JSON lines; ``pred_text`` may be shortened for the log only."""
    rows = scored if text_chars is None else scored.withColumn("pred_text", F.substring("pred_text", 1, text_chars))
    rows.write.mode("append").json(path)


def merge_shards(spark: SparkSession, folder: str, out: str, schema: str = S.RESULT, glob: str = "rank*.jsonl") -> None:
    """All shard files as one dataset in shard order, then index."""
    rows = read_results(spark, folder, schema, glob)
    shard = F.regexp_extract(F.col("line.src.file_path"), r"(\d+)\.jsonl$", 1).try_cast("int")
    write_ordered(rows.withColumn("_s", shard).drop("line"), out, "_s", "idx", fmt="json", drop=("_s",))


def write_ordered(df: DataFrame, path: str, *keys: str, fmt: str = "parquet", files: int | None = None, drop: tuple[str, ...] = ()) -> None:
    """``df`` in files whose names follow the order of ``keys``, each sorted, dealt out by sampled ranges.

    Equal keys are told apart by the whole row, so a key that many rows share is spread over files, and repeated writes
    agree. Null keys come first.
    """
    rest = [F.col(c) for c in df.columns if c not in keys and not df.schema[c].dataType.typeName() in ("map", "variant")]
    order = [*map(F.col, keys), F.xxhash64(*rest) if rest else F.lit(0)]
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).drop(*drop).write.mode("overwrite").format(fmt).save(path)


def write_manifest(spark: SparkSession, path: str, key: str, out: str) -> None:
    """One row per file of an ordered parquet dataset: file, n_rows, and the least and greatest key in it."""
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file"))
    rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("low"), F.max(key).alias("high")).write.mode("overwrite").parquet(out)


def read_between(spark: SparkSession, path: str, manifest: str, key: str, low, high) -> DataFrame:
    """Rows with keys from ``low`` to ``high``, from the files alone that the manifest lists for that range."""
    hit = spark.read.parquet(manifest).where((F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low)))
    files = [r["file"] for r in hit.select("file").collect()]  # file names, not rows
    rows = spark.read.schema(spark.read.parquet(path).schema).parquet(*files) if files else spark.read.parquet(path).limit(0)
    return rows.where(F.col(key).between(F.lit(low), F.lit(high)))


def write_report(report: DataFrame, path: str) -> None:
    """A one-row (or short) report as a single JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
