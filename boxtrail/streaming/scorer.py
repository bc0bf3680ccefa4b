"""Structured Streaming jobs: score every index once, keep mergeable sums per shard, log finished files.

Scored rows lie below ``out`` in one folder per stream and batch, ``query=<id>/batch=<n>``. A folder counts once its
write has been committed; a batch that is replayed after a crash finds its folder committed and leaves it, or writes it
anew. Which indices were scored is read from the table itself, so files of any age may arrive in any order, an index may
come again after any time, and a lost checkpoint repeats no work: each index has one row for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from boxtrail.functions import scoring as S
from boxtrail.operators.evaluation import score_predictions, summarize

SHARDS = 64
ROWS_PER_TASK = 50_000


def is_committed(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder has ended; asked of the store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def one_per_index(batch: DataFrame) -> DataFrame:
    """One row per index of a batch: the one with the least text, so that a replay chooses alike. Null indices leave."""
    rest = [c for c in batch.columns if c != "idx"]
    first = F.min_by(F.struct(*rest), F.coalesce("pred_text", F.lit("")))
    return batch.where("idx IS NOT NULL").groupBy("idx").agg(first.alias("r")).select("idx", "r.*")


def by_index(batch: DataFrame) -> DataFrame:
    """The batch dealt out by index to tasks of about ``ROWS_PER_TASK`` rows, however many files it holds. Null indices leave."""
    tasks = max(batch.sparkSession.sparkContext.defaultParallelism, -(-batch.count() // ROWS_PER_TASK))
    return batch.where("idx IS NOT NULL").repartition(tasks, "idx")


def not_scored(batch: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows of the batch whose index the table does not hold.

    The table is read for its idx column between the batch's least and greatest index only, and narrowed to the batch's
    own indices before it meets them, so what is moved grows with the batch and not with the table.
    """
    low, high = batch.agg(F.min("idx"), F.max("idx")).first()
    if low is None:
        return batch
    seen = scored.where(F.col("idx").between(low, high)).select("idx").join(batch.select("idx"), "idx", "left_semi")
    return batch.join(seen, "idx", "left_anti")


def score_stream(predictions: DataFrame, out: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Scores predictions whose index has not been scored yet and adds them to the table at ``out``.

    Progress lives in ``checkpoint``, results in ``out``; either may be ahead of the other after a crash.
    """
    spark = predictions.sparkSession
    schema = score_predictions(predictions).schema
    if not is_committed(spark, out):  # an empty table, so that the first batch can read it
        spark.createDataFrame([], schema).write.mode("append").parquet(out)

    def score(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        query = own.sparkContext.getLocalProperty("sql.streaming.queryId")
        folder = f"{out}/query={query}/batch={number}"
        if is_committed(own, folder):
            return
        others = (F.col("query") != query) | (F.col("batch") != number)
        scored = scored_rows(own, out, schema).where(others)
        rows = one_per_index(by_index(batch)).persist()
        try:
            score_predictions(not_scored(rows, scored)).write.mode("overwrite").parquet(folder)
        finally:
            rows.unpersist()

    return predictions.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**_trigger(once)).start()


def scored_rows(spark: SparkSession, out: str, schema=None) -> DataFrame:
    """The table of scored rows with the stream (query) and batch that wrote each."""
    kept = schema if schema is not None else spark.read.parquet(out).drop("query", "batch").schema
    for name, kind in (("query", "string"), ("batch", "long")):
        kept = kept.add(name, kind) if name not in kept.names else kept
    return spark.read.schema(kept).parquet(out)


def _trigger(once: bool) -> dict:
    return {"availableNow": True} if once else {"processingTime": "30 seconds"}


def _sums(gate: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_scored"), F.coalesce(F.sum(gate), F.lit(0)).alias("n_image_valid"),
        *[F.sum(m).alias(m) for m in S.BASE_METRICS],
        *[F.sum(F.col(m) * gate).alias(m) for m in S.IMAGE_METRICS],
    ]


def partial_sums(scored: DataFrame, *by: str) -> DataFrame:
    """Sums from which every summary metric can be derived, for batches and streams."""
    return scored.groupBy(*by).agg(*_sums(F.col("image_metric_valid")))


def merged_sums(parts: DataFrame, *by: str) -> DataFrame:
    """Sums of sums: parts of any rows, added up in any order, give the sums of all rows."""
    names = ["n_scored", "n_image_valid", *S.BASE_METRICS, *S.IMAGE_METRICS]
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])


def refresh_parts(spark: SparkSession, scored_path: str, parts_path: str, n_shards: int = SHARDS) -> int:
    """Stores the sums per shard of every committed batch that has none yet; returns how many batches were read.

    Batches with stored sums are not read again. A batch's sums lie in a folder of its own name, so repeating a refresh
    that was cut off replaces them.
    """
    rows = scored_rows(spark, scored_path)
    found = rows.select("query", "batch").distinct().collect()  # one row per batch
    new = 0
    for query, batch in found:
        folder = f"{parts_path}/query={query}/batch={batch}"
        if is_committed(spark, folder) or not is_committed(spark, f"{scored_path}/query={query}/batch={batch}"):
            continue
        own = rows.where((F.col("query") == query) & (F.col("batch") == batch))
        partial_sums(own.withColumn("shard", F.pmod("idx", F.lit(n_shards))), "shard").write.mode("overwrite").parquet(folder)
        new += 1
    return new


def merged_summary(spark: SparkSession, parts_path: str, *by: str) -> DataFrame:
    """Summary from stored sums, over all rows or by ``shard``; equal to ``summarize`` over the scored rows."""
    return summary_from_sums(merged_sums(spark.read.parquet(parts_path), *by), *by)


def summary_from_sums(sums: DataFrame, *by: str) -> DataFrame:
    """The summary row of partial sums, equal to ``summarize`` over the same rows."""
    return sums.select(
        *by, *[F.try_divide(m, "n_scored").alias(m) for m in S.BASE_METRICS],
        *[F.try_divide(m, "n_image_valid").alias(m) for m in S.IMAGE_METRICS],
        "n_image_valid", "n_scored",
    )


def summary_stream(scored: DataFrame, out: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Keeps a one-row summary up to date; each batch replaces it."""
    def replace(batch: DataFrame, _: int) -> None:
        summary_from_sums(batch).coalesce(1).write.mode("overwrite").parquet(out)

    return (
        partial_sums(scored).writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", checkpoint).trigger(**_trigger(once)).start()
    )


def final_summary(spark: SparkSession, scored_path: str) -> DataFrame:
    """Summary over everything scored so far, as a batch query."""
    return summarize(scored_rows(spark, scored_path))


def manifest_stream(finished: DataFrame, out: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Appends finished files to a JSON-lines manifest."""
    writer = finished.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**_trigger(once)).start()
