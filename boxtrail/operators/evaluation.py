"""Scoring predictions and aggregating the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.functions import parsing as J, scoring as S, text as T
from boxtrail.functions.geometry import IOU_THRESHOLD


def score_predictions(predictions: DataFrame, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """Adds the 17 per-sample metrics to (pred_text, answer, evidence_chain, ...).

    Row-local: parse once, flatten once, then score. ``image_metrics_enabled``
    (optional column) switches the image metrics off per row.
    """
    enabled = F.col("image_metrics_enabled") if "image_metrics_enabled" in predictions.columns else F.lit(True)
    parsed = predictions.withColumn("_v", J.parse_lenient(F.col("pred_text")))
    read = parsed.withColumns(
        {
            "_chain": J.predicted_chain(F.col("_v")),
            "_answer": F.when(J.is_object(F.col("_v")), J.scalar_text(F.try_variant_get("_v", "$.answer", "variant"))),
            "parse_ok": J.is_truthy(F.col("_v")).cast("int"),
        }
    )
    flat = read.withColumns(
        {"_pred": J.flatten_boxes(F.col("_chain")), "_gold": J.flatten_boxes(F.col("evidence_chain"))}
    )
    stats = flat.withColumns(
        {
            "_b": S.bbox_stats(F.col("_pred"), F.col("_gold"), threshold),
            "_i": S.image_chain_stats(F.col("_chain"), F.col("evidence_chain"), threshold),
            "answer_em": T.exact_match_train(F.col("_answer"), F.col("answer")),
            "answer_contains": T.answer_contains(F.col("_answer"), F.col("answer")),
        }
    )
    kept = [c for c in predictions.columns]
    # The flag of the boxes is 1 where there is nothing to find; localized is not.
    localized = F.when((F.col("_b.n_gt") > 0) & (F.col("_b.n_pred") > 0), F.col("_b.any_hit")).otherwise(0)
    return stats.select(
        *kept, "answer_em", "answer_contains", localized.alias("bbox_localized"),
        F.col("_b.recall").alias("bbox_recall"), F.col("_b.precision").alias("bbox_precision"),
        F.col("_b.all_gt_hit").alias("bbox_all_gt_hit"), F.col("_b.n_gt").alias("bbox_n_gt"),
        F.col("_b.n_pred").alias("bbox_n_pred"), "parse_ok",
        F.when(enabled, F.col("_i.valid")).otherwise(0).alias("image_metric_valid"),
        *[F.col(f"_i.{m}").alias(m) for m in S.IMAGE_METRICS],
    )


def score_chains(pairs: DataFrame, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """Answer EM and F1, chain accuracy and per-hop localization of parsed predictions.

    ``pairs`` is (idx, type, pred_answer, answer, pred_chain, evidence_chain).
    """
    return pairs.withColumn(
        "hops", S.chain_hops(F.col("pred_chain"), F.col("evidence_chain"), threshold)
    ).select(
        "idx", F.coalesce("type", F.lit("unknown")).alias("type"),
        T.exact_match_paper(F.coalesce("pred_answer", F.lit("")), F.coalesce("answer", F.lit(""))).alias("em"),
        T.answer_f1(F.coalesce("pred_answer", F.lit("")), F.coalesce("answer", F.lit(""))).alias("f1"),
        S.chain_correct(F.col("hops")).alias("chain_acc"),
        F.aggregate("hops", F.lit(0.0), lambda a, h: a + h["accuracy"]).alias("hop_acc_sum"),
        F.size("hops").alias("n_hops"),
    )


def pair_by_index(predictions: DataFrame, golds: DataFrame) -> DataFrame:
    """Predictions and gold rows with the same index."""
    return predictions.join(golds, "idx")


def count_mismatch(predictions: DataFrame, golds: DataFrame) -> DataFrame:
    """Indices present on one side only; scoring is meaningful when this is empty."""
    both = predictions.select("idx", F.lit(1).alias("p")).join(golds.select("idx", F.lit(1).alias("g")), "idx", "full")
    return both.where(F.col("p").isNull() | F.col("g").isNull()).select(
        "idx", F.when(F.col("p").isNull(), "no_prediction").otherwise("no_gold").alias("problem")
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """Percentages overall (type null) and per question type, in one aggregation.

    Localization averages over hops, everything else over samples.
    """
    grouped = scored.rollup("type").agg(
        F.grouping("type").alias("is_total"),
        (F.avg("em") * 100).alias("em"), (F.avg("f1") * 100).alias("f1"),
        (F.try_divide(F.sum("hop_acc_sum"), F.sum("n_hops")) * 100).alias("loc_acc"),
        (F.avg("chain_acc") * 100).alias("chain_acc"), F.count(F.lit(1)).alias("num_samples"),
    )
    total = F.col("is_total") == 1
    return grouped.select(
        F.when(total, F.lit("ALL")).otherwise(F.col("type")).alias("type"), "em",
        # The per-type report has no F1; the overall localization of no hops is 0.
        F.when(total, F.col("f1")).alias("f1"),
        F.when(total, F.coalesce("loc_acc", F.lit(0.0))).otherwise(F.col("loc_acc")).alias("loc_acc"),
        "chain_acc", "num_samples",
    )


def _summary_columns() -> list[Column]:
    valid = F.sum("image_metric_valid")
    cols = [F.avg(m).alias(m) for m in S.BASE_METRICS]
    for m in S.IMAGE_METRICS:
        # Null when no row is valid; a metric nobody could earn is not a zero.
        cols.append(F.try_divide(F.sum(F.col(m) * F.col("image_metric_valid")), valid).alias(m))
    return cols + [valid.alias("n_image_valid"), F.count(F.lit(1)).alias("n_scored")]


def summarize(scored: DataFrame, *by: str) -> DataFrame:
    """Means of the base metrics and gated means of the image metrics."""
    return scored.groupBy(*by).agg(*_summary_columns())


def failures(attempts: DataFrame) -> DataFrame:
    """Attempted, failed and scored rows; failed rows (non-null ``error``) carry no metrics."""
    bad = F.col("error").isNotNull()
    return attempts.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(bad).alias("n_failed"), F.count_if(~bad).alias("n_scored")
    )


def shard_progress(todo: DataFrame, done: DataFrame, n_shards: int) -> DataFrame:
    """Owned, done, failed and remaining rows per shard, with the running metrics.

    ``todo`` is (idx); ``done`` is (idx, error, answer_em, bbox_recall).
    """
    rows = todo.select("idx").join(done, "idx", "left").withColumn("shard", F.pmod("idx", F.lit(n_shards)))
    seen = F.col("answer_em").isNotNull()
    failed = F.col("error").isNotNull()
    return rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_owned"), F.count_if(seen).alias("n_done"), F.count_if(failed).alias("n_failed"),
        F.count_if(~seen & ~failed).alias("n_remaining"),
        F.avg("answer_em").alias("answer_em"), F.avg("bbox_recall").alias("bbox_recall"),
    )


def periodic_report(scored: DataFrame) -> DataFrame:
    """The short report of a running evaluation."""
    return scored.agg(
        F.avg("answer_em").alias("em"), F.avg("answer_contains").alias("contains"),
        F.avg("bbox_localized").alias("bbox_loc"), F.avg("parse_ok").alias("parse_ok"), F.count(F.lit(1)).alias("n"),
    )


def first_rows(df: DataFrame, n: int, key: str = "idx") -> DataFrame:
    """Rows with index below ``n``; a negative ``n`` keeps all."""
    return df if n < 0 else df.where(F.col(key) < n)


def remaining(todo: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    """Rows whose key has no finished result."""
    return todo.join(done.select(key), key, "left_anti")


def first_per_index(results: DataFrame) -> DataFrame:
    """One result per index, the earliest by ``line``."""
    rest = [c for c in results.columns if c not in ("idx", "line")]
    return results.groupBy("idx").agg(F.min_by(F.struct(*rest), "line").alias("r")).select("idx", "r.*")
