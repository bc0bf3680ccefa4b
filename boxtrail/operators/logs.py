"""Evaluation logs, checkpoint listings and image trim manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from boxtrail.functions.binding import bind

# ---- Fixed values -----------------------------------------------------------
BLANK_STD = 5.0
TRIM_MARGIN = 20
# -----------------------------------------------------------------------------

STEP_BUCKET = 1024


# ---- running values over a step log -----------------------------------------

def before_bucket(per_bucket: DataFrame, keys: list[str], bucket: str, over, combine: Column, merge) -> DataFrame:
    """(keys, bucket, carried): a running value over all earlier buckets of a key.

    ``over`` applies the value to a window, ``combine`` sums up a run of buckets, ``merge`` joins the value inside such
    a run with that of the runs before. Buckets are grouped by 1,024 once more, so a key of any length is many small
    windows; only one row per million steps meets in one.
    """
    upper = per_bucket.withColumn("_ub", F.floor(F.col(bucket) / STEP_BUCKET))
    earlier = lambda order, *parts: W.partitionBy(*parts).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    above = upper.groupBy(*keys, "_ub").agg(combine).select(*keys, "_ub", over(earlier("_ub", *keys)).alias("_above"))
    inside = upper.withColumn("_inside", over(earlier(bucket, *keys, "_ub")))
    return inside.join(above, [*keys, "_ub"]).select(*keys, bucket, merge(F.col("_inside"), F.col("_above")).alias("carried"))


def _bucketed(log: DataFrame) -> DataFrame:
    return log.withColumn("_sb", F.floor(F.col("step") / STEP_BUCKET))


def metric_asof(log: DataFrame, saves: DataFrame) -> DataFrame:
    """Latest logged value at or before each save step.

    ``log`` is (run, step, pos, value), ``saves`` is (run, step). Steps are cut
    into fixed buckets: the last value of the earlier buckets comes from a small
    bucket table, the rest from a window inside the bucket, so one long run is
    still spread over tasks.
    """
    values = log.where(F.col("value").isNotNull())
    rows = _bucketed(
        values.select("run", "step", "pos", "value", F.lit(0).alias("is_save"))
        .unionByName(saves.select("run", "step", F.lit(None).cast("long").alias("pos"),
                                  F.lit(None).cast("double").alias("value"), F.lit(1).alias("is_save")))
    )
    logged = F.when(F.col("is_save") == 0, F.struct("step", "pos"))  # save rows carry no value
    per_bucket = rows.groupBy("run", "_sb").agg(F.max_by("value", logged).alias("last_value"))
    carried = before_bucket(
        per_bucket, ["run"], "_sb", lambda w: F.last("last_value", ignorenulls=True).over(w),
        F.max_by("last_value", F.when(F.col("last_value").isNotNull(), F.col("_sb"))).alias("last_value"), F.coalesce,
    )
    inside = W.partitionBy("run", "_sb").orderBy("step", "is_save", "pos").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("seen", F.last("value", ignorenulls=True).over(inside))
    return seen.where("is_save = 1").join(carried, ["run", "_sb"]).select(
        "run", "step", F.coalesce("seen", "carried").alias("value")
    )


def best_flags(log: DataFrame, greater_is_better: bool = True) -> DataFrame:
    """Marks rows that beat every earlier value of their run; ties do not beat.

    Same two-level scheme as ``metric_asof``: best of earlier buckets plus a
    window inside the bucket.
    """
    best = F.max if greater_is_better else F.min
    beats = (lambda a, b: a > b) if greater_is_better else (lambda a, b: a < b)
    rows = _bucketed(log.where(F.col("value").isNotNull()))
    per_bucket = rows.groupBy("run", "_sb").agg(best("value").alias("top"))
    combine = F.greatest if greater_is_better else F.least
    carried = before_bucket(per_bucket, ["run"], "_sb", lambda w: best("top").over(w), best("top").alias("top"), combine)
    inside = W.partitionBy("run", "_sb").orderBy("step", "pos").rowsBetween(W.unboundedPreceding, -1)
    before = rows.withColumn("inside", best("value").over(inside)).join(carried, ["run", "_sb"])
    so_far = combine(F.col("inside"), F.col("carried"))
    return before.select(
        "run", "step", "pos", "value", (so_far.isNull() | beats(F.col("value"), so_far)).alias("is_best")
    )


def best_step(log: DataFrame, greater_is_better: bool = True) -> DataFrame:
    """Step with the best value per run; the earliest wins ties."""
    signed = F.col("value") if greater_is_better else -F.col("value")
    order = F.struct(signed, -F.col("step"), -F.col("pos"))
    return log.where(F.col("value").isNotNull()).groupBy("run").agg(
        F.max_by(F.struct("step", "value"), order).alias("b")
    ).select("run", F.col("b.step").alias("best_step"), F.col("b.value").alias("best_value"))


def newest_valid(listing: DataFrame) -> DataFrame:
    """The valid checkpoint with the highest step over all locations; the first path wins ties."""
    return listing.where("valid").agg(
        F.max_by(F.struct("path", "step"), F.struct(F.col("step"), -F.col("pos"))).alias("b")
    ).select("b.path", "b.step")


def prunable(listing: DataFrame, keep: int) -> DataFrame:
    """Checkpoints beyond the newest ``keep`` of their directory.

    The newest ``keep`` are found with a per-task limit; the others are those
    below the oldest kept one. ``keep=0`` prunes nothing.
    """
    if keep <= 0:
        return listing.limit(0).select("dir", "path", "step")
    newest = W.partitionBy("dir").orderBy(F.desc("step"), F.desc("path"))
    kept = listing.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= keep)
    oldest = kept.groupBy("dir").agg(F.min(F.struct("step", "path")).alias("floor"))
    return listing.join(oldest, "dir").where(F.struct("step", "path") < F.col("floor")).select("dir", "path", "step")


# ---- trimming and rebuild manifests -----------------------------------------

def row_deviation(gray: Column) -> Column:
    """Population standard deviation of one pixel row."""
    n = F.size(gray)
    values = gray.cast("array<double>")
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    spread = lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.sqrt(bind(mean, spread) / n)


def trim_extent(rows: DataFrame) -> DataFrame:
    """New height per image: last row with content plus a margin; blank images stay.

    ``rows`` is (file, width, y, gray). Each pixel row is judged where it is
    read; only one small aggregate per image is shuffled.
    """
    judged = rows.select("file", "width", "y", (row_deviation(F.col("gray")) > BLANK_STD).alias("content"))
    sized = judged.groupBy("file").agg(
        F.max("width").alias("orig_w"), (F.max("y") + 1).alias("orig_h"),
        F.max(F.when(F.col("content"), F.col("y"))).alias("last_row"),
    )
    new_h = F.least(F.coalesce(F.col("last_row") + 1 + TRIM_MARGIN, F.col("orig_h")), F.col("orig_h"))
    return sized.select(
        "file", "orig_h", new_h.alias("new_h"), (F.col("orig_h") - new_h).alias("rows_removed"),
        (new_h >= F.col("orig_h")).alias("skipped"), F.when(new_h < F.col("orig_h"), F.col("orig_w")).alias("orig_w"),
        F.lit(None).cast("string").alias("error"),
    )


def trim_totals(manifest: DataFrame) -> DataFrame:
    """Processed images, errors, and rows and pixels saved (trimmed images only)."""
    ok = F.col("error").isNull()
    return manifest.agg(
        F.count(F.lit(1)).alias("n_done"), F.count_if(~ok).alias("n_errors"),
        F.coalesce(F.sum(F.when(ok, F.col("rows_removed"))), F.lit(0)).alias("rows_saved"),
        F.coalesce(F.sum(F.when(ok, F.col("rows_removed") * F.col("orig_w"))), F.lit(0)).alias("pixels_saved"),
    )


def rebuild_outcome(pages: DataFrame) -> DataFrame:
    """Rebuilt and failed pages with the number of paragraphs; ``pages`` is (page_id, n_paragraphs, error)."""
    bad = F.col("error").isNotNull()
    return pages.agg(
        F.count_if(~bad).alias("n_ok"), F.count_if(bad).alias("n_err"),
        F.sum(F.when(~bad, F.col("n_paragraphs"))).alias("n_paragraphs"),
    )


def first_errors(pages: DataFrame, n: int | None = None) -> DataFrame:
    """Failed pages in page order: all of them, or the first ``n`` for a report."""
    failed = pages.where(F.col("error").isNotNull()).orderBy("page_id")
    return failed if n is None else failed.limit(n)
