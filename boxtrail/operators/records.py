"""Samples -> training and evaluation records, their checks and overlay rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.functions import geometry as G, prompts as P, records as R, text as T
from boxtrail.functions.binding import bind
from boxtrail.operators.sampling import hash_key, hash_order, hash_unit

# ---- Fixed values -----------------------------------------------------------
EVAL_RESOLUTION = 1024
MAX_PIXELS = 1_048_576
JITTER = (0.9, 1.1)
OVERLAY_COLOURS = 8
TARGET_KEYS = ("answer", "evidence_chain")
# -----------------------------------------------------------------------------


def sub_queries(evidences: DataFrame) -> DataFrame:
    """(sample_id, entity, sub_query) from triples; a repeated entity keeps its last well-formed triple."""
    asked = T.relation_question(F.col("relation"), F.col("entity"))
    return evidences.where("entity IS NOT NULL AND relation IS NOT NULL").groupBy("sample_id", "entity").agg(F.max_by(asked, "pos").alias("sub_query"))


def _with_sub_queries(samples: DataFrame) -> DataFrame:
    """Chain with blank sub-queries filled from the sample's own triples, inside the row."""
    def filled(e: Column) -> Column:
        triple = F.try_element_at(F.filter("evidences", lambda t: (t["entity"] == e["entity"]) & t["relation"].isNotNull()), F.lit(-1))
        asked = bind(triple, lambda t: T.relation_question(t["relation"], t["entity"]))
        stored = T.strip_ws(F.coalesce(e["sub_query"], F.lit("")))
        return e.withField("sub_query", bind(stored, lambda q: F.when(q != "", q).otherwise(F.coalesce(asked, F.lit("")))))

    return samples.withColumn("evidence_chain", F.transform("evidence_chain", filled))


def permute_evidence(samples: DataFrame, seed: int) -> DataFrame:
    """Hops in hash order; the hop's own position keeps equal hops apart."""
    tagged = F.transform("evidence_chain", lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    ordered = hash_order(tagged, lambda t: hash_key(seed, F.col("sample_id"), t["i"]))
    return samples.withColumn("evidence_chain", F.transform(ordered, lambda t: t["e"]))


def choose_resolution(sample_id: Column, resolutions: list[int], seed: int) -> Column:
    """One of the training resolutions per sample."""
    pick = F.floor(hash_unit(hash_key(seed, sample_id, F.lit("resolution"))) * len(resolutions)).cast("int")
    return F.get(F.array(*[F.lit(r) for r in resolutions]), pick)


def jitter_target(target: Column, sample_id: Column, position: Column, seed: int) -> Column:
    """Target width times a uniform factor in [0.9, 1.1), truncated."""
    low, high = JITTER
    u = hash_unit(hash_key(seed, sample_id, position, F.lit("jitter")))
    return (target * (F.lit(low) + u * F.lit(high - low))).cast("long")


def attach_image_sizes(records: DataFrame, images: DataFrame, lenient: bool = False) -> DataFrame:
    """Adds ``sizes`` (one entry per item of ``shots``) and ``n_missing``.

    Lenient records give a missing image the default size; strict ones keep it
    null so that the record can be reported instead of trained on.
    """
    one = images.groupBy(F.col("path").alias("shot")).agg(
        F.max(F.struct("width", "height")).alias("size")
    )
    listed = records.select("sample_id", F.posexplode("shots").alias("pos", "shot"))
    joined = listed.join(one, "shot", "left")
    dw, dh = G.DEFAULT_IMAGE_SIZE
    default = F.struct(F.lit(dw).alias("width"), F.lit(dh).alias("height"))
    size = F.coalesce("size", default) if lenient else F.col("size")
    sizes = joined.groupBy("sample_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", size.alias("size")))), lambda r: r["size"]).alias("sizes"),
        F.count_if(F.col("size").isNull()).alias("n_missing"),
    )
    return records.join(sizes, "sample_id", "left")


def build_training_records(
    samples: DataFrame,
    images: DataFrame,
    *,
    mode: str = "multi_hop",
    image_dir: str = "",
    split: str = "train",
    resolutions: list[int] | None = None,
    eval_resolution: int = EVAL_RESOLUTION,
    max_pixels: int | None = MAX_PIXELS,
    spatial_augmentation: bool = False,
    evidence_permutation: bool = False,
    preserve_evidence_order: bool = True,
    include_reasoning: bool = True,
    lenient: bool = False,
    seed: int = 42,
) -> DataFrame:
    """Records with messages, image paths, rescaled chain and gold image ids.

    ``samples`` may carry ``candidates`` (multi-hop top-k mode); otherwise every
    hop brings its own image. Only the image sizes need a join; all else is
    row-local. In strict mode records with missing images are left out (see
    ``missing_images``).
    """
    candidate_mode = mode != "single_hop" and "candidates" in samples.columns
    train = split == "train"
    rows = samples
    for name, kind in (("evidences", "array<struct<entity:string,relation:string,value:string>>"), ("reasoning", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    for name in ("sub_query", "image_id"):
        if name not in rows.schema["evidence_chain"].dataType.elementType.fieldNames():
            rows = rows.withColumn(
                "evidence_chain", F.transform("evidence_chain", lambda e: e.withField(name, F.lit(None).cast("string")))
            )
    if evidence_permutation and train and not (candidate_mode and preserve_evidence_order):
        rows = permute_evidence(rows, seed)
    own_shots = F.transform("evidence_chain", lambda e: e["screenshot"])
    # Listed from the chain as it comes: the look-up of image sizes then makes no sub-queries of its own.
    rows = _with_sub_queries(rows.withColumn("shots", F.col("candidates") if candidate_mode else own_shots))

    target = F.lit(eval_resolution)
    if train and resolutions:
        target = choose_resolution(F.col("sample_id"), resolutions, seed)
    rows = attach_image_sizes(rows.withColumn("target", target.cast("long")), images, lenient)
    if not lenient:
        rows = rows.where(F.coalesce("n_missing", F.lit(0)) == 0)

    def planned(size: Column, i: Column) -> Column:
        goal = jitter_target(F.col("target"), F.col("sample_id"), i, seed) if train and spatial_augmentation else F.col("target")
        plan = G.resize_plan(size["width"], size["height"], goal, max_pixels)
        return F.struct(
            size["width"].alias("w"), size["height"].alias("h"), plan.width.alias("nw"), plan.height.alias("nh")
        )

    rows = rows.withColumn("plans", F.transform("sizes", planned))

    def placed(e: Column, i: Column) -> Column:
        at = F.array_position("shots", e["screenshot"]).cast("int") - 1 if candidate_mode else i
        image_id = F.when(at >= 0, F.concat(F.lit("img_"), at.cast("string"))).otherwise(F.lit(""))
        boxes = F.coalesce(e["bboxes"].cast("array<array<int>>"), F.array().cast("array<array<int>>"))
        scaled = bind(
            F.get("plans", at), lambda plan: G.scale_boxes(boxes, plan["w"], plan["h"], plan["nw"], plan["nh"])
        )
        return e.withField("image_id", image_id).withField("bboxes", F.when(at >= 0, scaled).otherwise(boxes))

    rows = rows.withColumn("evidence_chain", F.transform("evidence_chain", placed))
    prefix = image_dir.rstrip("/") + "/" if image_dir else ""
    rows = rows.withColumn("image_paths", F.transform("shots", lambda s: F.concat(F.lit(prefix), s)))

    if mode == "single_hop":
        system = P.SINGLE_HOP_SYSTEM if include_reasoning else P.SINGLE_HOP_SYSTEM_NO_REASONING
        content = R.single_hop_content(F.col("question"), F.get("image_paths", 0))
        text = R.single_hop_target(
            F.col("evidence_chain"), F.col("answer"),
            F.coalesce("reasoning", F.lit("")) if include_reasoning else None,
        )
    else:
        system = P.MULTI_HOP_SYSTEM
        content = R.multi_hop_content(F.col("question"), F.col("image_paths"))
        text = R.multi_hop_target(F.col("evidence_chain"), F.col("answer"), R.image_number_map(F.col("shots")))
    return rows.withColumn("target_text", text).select(
        "sample_id", F.lit(mode).alias("mode"), "question", "answer",
        R.messages(F.lit(system), content, F.col("target_text")).alias("messages"), "target_text", "image_paths",
        relative_paths(F.col("image_paths"), image_dir).alias("candidate_screenshots"),
        F.transform("evidence_chain", lambda e: F.coalesce(e["image_id"], F.lit(""))).alias("gold_image_ids"),
        "evidence_chain", "plans",
    )


def build_eval_records(samples: DataFrame, images: DataFrame, *, image_dir: str = "",
                       eval_resolution: int = EVAL_RESOLUTION, max_pixels: int | None = MAX_PIXELS) -> DataFrame:
    """Evaluation records: no augmentation, gold chain in resized pixels, missing images at default size."""
    rows = samples.withColumn("shots", F.transform("evidence_chain", lambda e: e["screenshot"]))
    rows = attach_image_sizes(rows, images, lenient=True)

    def placed(e: Column, i: Column) -> Column:
        size = F.get("sizes", i)
        plan = G.resize_plan(size["width"], size["height"], F.lit(eval_resolution), max_pixels)
        boxes = F.coalesce(e["bboxes"].cast("array<array<int>>"), F.array().cast("array<array<int>>"))
        return e.withField("bboxes", G.scale_boxes(boxes, size["width"], size["height"], plan.width, plan.height))

    prefix = image_dir.rstrip("/") + "/" if image_dir else ""
    hops = F.coalesce("num_hops", F.size("evidence_chain")) if "num_hops" in samples.columns else F.size("evidence_chain")
    return rows.select(
        "sample_id", "question", "answer", F.coalesce("type", F.lit("")).alias("type"), hops.alias("num_hops"),
        F.transform("evidence_chain", placed).alias("evidence_chain"),
        F.transform("shots", lambda s: F.concat(F.lit(prefix), s)).alias("gt_image_paths"),
    )


def relative_paths(paths: Column, image_dir: str) -> Column:
    """Paths below the image folder without its prefix; others stay."""
    prefix = image_dir.rstrip("/") + "/" if image_dir else ""
    if not prefix:
        return paths
    return F.transform(
        paths, lambda p: F.when(F.startswith(p, F.lit(prefix)), F.substring(p, len(prefix) + 1, 2**30)).otherwise(p)
    )


def missing_images(samples: DataFrame, images: DataFrame) -> DataFrame:
    """Screenshots a sample cites that are not in the listing."""
    cited = samples.select("sample_id", F.explode("evidence_chain").alias("e")).select("sample_id", F.col("e.screenshot").alias("path"))
    return cited.distinct().join(images.select("path"), "path", "left_anti").select("sample_id", "path")


# ---- checks -----------------------------------------------------------------

def record_violations(records: DataFrame) -> DataFrame:
    """(sample_id, rule, hop) for every broken rule of a record.

    Rules: equal chain lengths, image index in range, boxes ordered and inside
    the resized image. ``records`` carries evidence_chain, target_chain, sizes
    (new width and height per image).
    """
    chain, target = F.col("evidence_chain"), F.col("target_chain")
    lengths = F.when(
        F.size(chain) != F.size(target), F.array(F.struct(F.lit("chain_length").alias("rule"), F.lit(-1).alias("hop")))
    )

    def broken(e: Column, i: Column) -> Column:
        at = T.image_index(e["image_id"])
        size = F.when(at >= 0, F.get("sizes", at))
        outside = F.exists(
            e["bboxes"],
            lambda b: ~(
                (F.get(b, 0) >= 0) & (F.get(b, 0) <= F.get(b, 2)) & (F.get(b, 2) <= size["width"])
                & (F.get(b, 1) >= 0) & (F.get(b, 1) <= F.get(b, 3)) & (F.get(b, 3) <= size["height"])
            ),
        )
        unknown = at.isNull() | (at < 0) | (at >= F.size("sizes")) | size.isNull()
        return F.when(unknown, F.struct(F.lit("image_index").alias("rule"), i.alias("hop"))).when(
            outside, F.struct(F.lit("box_bounds").alias("rule"), i.alias("hop"))
        )

    found = F.filter(F.transform(target, broken), lambda v: v.isNotNull())
    every = F.concat(F.coalesce(lengths, F.array().cast("array<struct<rule:string,hop:int>>")), found)
    return records.select("sample_id", F.explode(every).alias("v")).select("sample_id", "v.rule", "v.hop")


def mask_violations(masked: DataFrame, decoded: str | None = None) -> DataFrame:
    """Rows whose labels are empty, whose supervised part is not one run, or whose supervised text is no target.

    ``decoded`` names the column with the text of the supervised tokens; without it that rule is left out. A target has
    the keys of ``TARGET_KEYS``; a null text has none.
    """
    on = F.transform("labels", lambda x: x != R.IGNORED_LABEL)
    n_on = F.size(F.filter(on, lambda x: x))
    keys = [F.contains(F.col(decoded), F.lit(f'"{key}"')) for key in TARGET_KEYS] if decoded else []
    no_target = F.lit(False) if not keys else ~F.coalesce(reduce(and_, keys), F.lit(False))
    first = F.array_position(on, True)
    last = F.size(on) - F.array_position(F.reverse(on), True) + 1
    return masked.select(
        "row_id",
        F.when(n_on == 0, "no_labels").when(last - first + 1 != n_on, "not_contiguous").when(no_target, "no_target").alias("rule"),
    ).where(F.col("rule").isNotNull())


# ---- overlays ---------------------------------------------------------------

def overlay_spec(predictions: DataFrame, label_chars: int | None = None) -> DataFrame:
    """Rows to draw: hop, image, colour slot, label and box; hops with unknown images are skipped.

    ``predictions`` is (idx, chain, n_images). Labels hold the whole sub-query, or its first ``label_chars`` characters.
    """
    shown = F.col("sub_query") if label_chars is None else F.substring("sub_query", 1, label_chars)
    hops = predictions.select("idx", "n_images", F.posexplode("chain").alias("pos", "e")).select(
        "idx", "pos", "n_images", F.coalesce("e.hop", F.col("pos") + 1).alias("hop"),
        "e.image_id", "e.bboxes", F.coalesce("e.sub_query", F.lit("")).alias("sub_query"),
    )
    named = hops.withColumn(
        "image", T.image_index(F.coalesce("image_id", F.concat(F.lit("img_"), (F.col("hop") - 1).cast("string"))))
    ).where(F.col("image") < F.col("n_images"))
    label = F.concat(
        F.lit("Hop "), F.col("hop").cast("string"),
        F.when(F.col("sub_query") != "", F.concat(F.lit(": "), shown)).otherwise(""),
    )
    return named.select(
        "idx", "pos", "hop", "image", F.pmod("hop", F.lit(OVERLAY_COLOURS)).alias("colour"), label.alias("label"),
        F.posexplode(F.filter("bboxes", lambda b: F.size(b) == 4)).alias("box_ord", "box"),
    )
