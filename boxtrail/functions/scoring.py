"""Per-row scoring of boxes, evidence chains and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxtrail.functions.binding import bind
from boxtrail.functions.geometry import IOU_THRESHOLD, Measures, centered, measured, overlap

# Field order of the per-sample metrics record.
BASE_METRICS = (
    "answer_em", "answer_contains", "bbox_localized", "bbox_recall", "bbox_precision", "bbox_all_gt_hit", "parse_ok",
)
IMAGE_METRICS = (
    "image_hop_acc", "image_chain_order_acc", "gold_image_recall", "gold_image_precision", "gold_image_all_hit",
    "image_bbox_joint_recall", "image_bbox_joint_all_gt_hit",
)


def _compared(preds: Column, golds: Column, body) -> Column:
    """``body`` of both lists, with each box measured once."""
    return bind(F.struct(measured(preds).alias("p"), measured(golds).alias("g")), lambda m: body(m["p"], m["g"]))


def match_table(preds: Column, golds: Column, threshold: float = IOU_THRESHOLD) -> Column:
    """Per gold box its overlap with every predicted box, null where the two do not match. Each pair is compared once."""
    def matched(p: Measures, g: Measures) -> Column:
        return bind(overlap(p, g), lambda o: F.when((o >= threshold) | centered(p, g), o))

    return _compared(
        preds, golds, lambda ps, gs: F.transform(gs, lambda g: F.transform(ps, lambda p: matched(Measures.read(p), Measures.read(g))))
    )


def any_match(preds: Column, golds: Column, threshold: float = IOU_THRESHOLD) -> Column:
    """True when some predicted box matches some gold box."""
    def matched(p: Measures, g: Measures) -> Column:
        return (overlap(p, g) >= threshold) | centered(p, g)

    return _compared(
        preds, golds, lambda ps, gs: F.exists(ps, lambda p: F.exists(gs, lambda g: matched(Measures.read(p), Measures.read(g))))
    )


def bbox_localized(preds: Column, golds: Column, threshold: float = IOU_THRESHOLD) -> Column:
    return any_match(preds, golds, threshold).cast("int")


def bbox_stats(preds: Column, golds: Column, threshold: float = IOU_THRESHOLD) -> Column:
    """Recall, precision and hit flags over all boxes of a sample.

    Abstaining when there is nothing to find scores 1 everywhere; boxes on only
    one side score 0.
    """
    counted = bind(match_table(preds, golds, threshold), lambda table: _hits(table, F.size(preds), F.size(golds)))
    return bind(counted, lambda c: _hit_stats(c["gold"], c["pred"], c["n_pred"], c["n_gold"]))


def _hits(table: Column, n_pred: Column, n_gold: Column) -> Column:
    gold_hits = F.size(F.filter(table, lambda row: F.exists(row, lambda o: o.isNotNull())))
    # The first row stands for the columns.
    pred_hits = F.size(F.filter(F.get(table, 0), lambda _, j: F.exists(table, lambda row: F.get(row, j).isNotNull())))
    return F.struct(gold_hits.alias("gold"), pred_hits.alias("pred"), n_pred.alias("n_pred"), n_gold.alias("n_gold"))


def _hit_stats(gold_hits: Column, pred_hits: Column, n_pred: Column, n_gold: Column) -> Column:
    nothing = (n_gold == 0) & (n_pred == 0)
    one_sided = (n_gold == 0) | (n_pred == 0)

    def pick(value: Column, kind: str) -> Column:
        return F.when(nothing, F.lit(1).cast(kind)).when(one_sided, F.lit(0).cast(kind)).otherwise(value.cast(kind))

    return F.struct(
        pick(F.try_divide(gold_hits, n_gold), "double").alias("recall"),
        pick(F.try_divide(pred_hits, n_pred), "double").alias("precision"),
        pick(gold_hits == n_gold, "int").alias("all_gt_hit"),
        pick(gold_hits > 0, "int").alias("any_hit"),
        n_gold.alias("n_gt"),
        n_pred.alias("n_pred"),
    )


def greedy_localization(preds: Column, golds: Column, threshold: float = IOU_THRESHOLD) -> Column:
    """One-to-one matching in gold order; each gold box takes the best free prediction.

    Order dependent, so it folds over the gold boxes inside the row. Equal
    overlap goes to the later prediction.
    """
    start = F.struct(
        F.array().cast("array<int>").alias("used"), F.lit(0).alias("hits"), F.array().cast("array<double>").alias("ious")
    )

    def step(acc: Column, row: Column) -> Column:
        options = F.transform(
            row, lambda o, j: F.when(o.isNotNull() & ~F.array_contains(acc["used"], j), F.struct(o.alias("iou"), j.alias("j")))
        )
        return bind(
            F.array_max(options),
            lambda best: F.struct(
                F.when(best.isNotNull(), F.array_append(acc["used"], best["j"])).otherwise(acc["used"]).alias("used"),
                (acc["hits"] + best.isNotNull().cast("int")).alias("hits"),
                F.array_append(acc["ious"], F.coalesce(best["iou"], F.lit(0.0))).alias("ious"),
            ),
        )

    def finish(acc: Column) -> Column:
        share = F.try_divide(acc["hits"], F.size(golds))
        return F.struct(
            F.coalesce(share, (F.size(preds) == 0).cast("double")).alias("accuracy"), acc["ious"].alias("ious")
        )

    return F.aggregate(match_table(preds, golds, threshold), start, step, finish)


def chain_hops(pred_chain: Column, gold_chain: Column, threshold: float = IOU_THRESHOLD) -> Column:
    """Per gold hop: right image (unknown ids count as right) and greedy localization.

    Predicted hops are aligned by position; a missing hop has no boxes.
    """
    none = F.array().cast("array<array<double>>")

    def hop(gold: Column, i: Column) -> Column:
        pred = F.get(pred_chain, i)
        gold_id, pred_id = F.coalesce(gold["image_id"], F.lit("")), F.coalesce(pred["image_id"], F.lit(""))
        same = (gold_id == "") | (pred_id == "") | (gold_id == pred_id)
        boxes = F.struct(
            F.coalesce(pred["bboxes"].cast("array<array<double>>"), none).alias("p"),
            F.coalesce(gold["bboxes"].cast("array<array<double>>"), none).alias("g"),
        )
        acc = F.when(
            same, bind(boxes, lambda b: greedy_localization(b["p"], b["g"], threshold)["accuracy"])
        ).otherwise(F.lit(0.0))
        return F.struct((i + 1).alias("hop"), same.alias("image_correct"), acc.alias("accuracy"))

    return F.transform(gold_chain, hop)


def chain_correct(hops: Column) -> Column:
    """1.0 when every hop is fully localized; an empty chain is correct."""
    return F.forall(hops, lambda h: h["accuracy"] == 1.0).cast("double")


def image_chain_stats(pred_chain: Column, gold_chain: Column, threshold: float = IOU_THRESHOLD) -> Column:
    """Image selection and order metrics; ``valid`` is 0 without gold image ids.

    The hop loop is positional over the gold chain cut to the number of
    non-empty gold ids, which matters when an id in the middle is empty.
    """
    none = F.array().cast("array<array<double>>")
    ident = lambda e: F.coalesce(e["image_id"], F.lit(""))
    gold_ids = F.filter(F.transform(gold_chain, ident), lambda x: x != "")
    pred_ids = F.transform(pred_chain, ident)

    def outcome(gold: Column, i: Column) -> Column:
        pred = F.get(pred_chain, i)
        right = (ident(gold) != "") & (ident(gold) == F.coalesce(pred["image_id"], F.lit("")))
        gold_boxes = F.filter(F.coalesce(gold["bboxes"].cast("array<array<double>>"), none), lambda b: F.size(b) == 4)
        pred_boxes = F.coalesce(pred["bboxes"].cast("array<array<double>>"), none)
        boxed = bind(
            F.struct(pred_boxes.alias("p"), gold_boxes.alias("g")),
            lambda b: F.when(F.size(b["g"]) == 0, F.size(b["p"]) == 0).otherwise(any_match(b["p"], b["g"], threshold)),
        )
        return F.struct(right.alias("right"), (right & boxed).alias("joint"))

    # Lists that several measures read are bound: branches of conditions would build them once each.
    facts = F.struct(
        gold_ids.alias("gold_ids"), pred_ids.alias("pred_ids"), F.array_distinct(gold_ids).alias("gold_set"),
        F.array_distinct(F.filter(pred_ids, lambda x: x != "")).alias("pred_set"),
        F.slice(F.transform(gold_chain, outcome), F.lit(1), F.greatest(F.size(gold_ids), F.lit(1))).alias("hops"),
    )
    return bind(facts, lambda f: bind(_image_counts(f), lambda c: _image_measures(f, c)))


def _image_counts(facts: Column) -> Column:
    return F.struct(
        F.size(facts["gold_ids"]).alias("n"), F.size(facts["gold_set"]).alias("n_gold"), F.size(facts["pred_set"]).alias("n_pred"),
        F.size(F.filter(facts["hops"], lambda h: h["right"])).alias("right"),
        F.size(F.filter(facts["hops"], lambda h: h["joint"])).alias("joint"),
        F.size(F.array_intersect(facts["gold_set"], facts["pred_set"])).alias("shared"),
    )


def _image_measures(facts: Column, counts: Column) -> Column:
    n, shared, joint = counts["n"], counts["shared"], counts["joint"]

    def gated(value: Column, kind: str, name: str) -> Column:
        return F.when(n > 0, F.coalesce(value.cast(kind), F.lit(0).cast(kind))).otherwise(F.lit(0).cast(kind)).alias(name)

    return F.struct(
        (n > 0).cast("int").alias("valid"),
        gated(F.try_divide(counts["right"], n), "double", "image_hop_acc"),
        gated(facts["pred_ids"] == facts["gold_ids"], "int", "image_chain_order_acc"),
        gated(F.try_divide(shared, counts["n_gold"]), "double", "gold_image_recall"),
        gated(F.try_divide(shared, counts["n_pred"]), "double", "gold_image_precision"),
        gated(shared == counts["n_gold"], "int", "gold_image_all_hit"),
        gated(F.try_divide(joint, n), "double", "image_bbox_joint_recall"),
        gated(joint == n, "int", "image_bbox_joint_all_gt_hit"),
    )


def recall_at_k(retrieved: Column, gold: Column, k: int = 5) -> Column:
    """Share of distinct gold items in the first ``k`` retrieved; no gold is 1."""
    wanted = F.array_distinct(gold)
    hits = F.size(F.array_intersect(F.slice(retrieved, 1, k), wanted))
    return F.coalesce(F.try_divide(hits, F.size(wanted)), F.lit(1.0))


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    """1/rank of the first relevant item, 0 when none is relevant."""
    rank = F.array_position(F.transform(retrieved, lambda x: F.array_contains(gold, x)), True)
    return F.when(rank > 0, 1.0 / rank).otherwise(F.lit(0.0))
