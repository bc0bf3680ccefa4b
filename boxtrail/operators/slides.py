"""Slide decks -> evidence samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxtrail.functions import geometry as G, text as T


def slide_images(images: DataFrame) -> DataFrame:
    """One image per (deck, slide): the best of the accepted file names.

    A path is read back into deck, slide and naming rank, then checked by
    spelling the name again. That turns three lookups per slide into one equi-join.
    """
    path, name = F.col("path"), T.base_name(F.col("path"))
    deck = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    number = F.regexp_extract(name, r"(\d+)\.png$", 1).try_cast("int")
    spelled = F.array(
        F.concat(deck, F.lit("_slide_"), number.cast("string"), F.lit(".png")),
        F.format_string("slide_%04d.png", number),
        F.concat(number.cast("string"), F.lit(".png")),
    )
    named = images.select("path", "width", "height", deck.alias("deck"), number.alias("slide"), name.alias("name")).where(
        F.col("slide").isNotNull()
    )
    ranked = named.withColumn("rank", F.array_position(spelled, F.col("name"))).where(F.col("rank") > 0)
    return ranked.groupBy("deck", "slide").agg(
        F.min_by(F.struct("path", "width", "height"), "rank").alias("img")
    ).select("deck", "slide", "img.path", "img.width", "img.height")


def convert_slides(raw: DataFrame, images: DataFrame) -> DataFrame:
    """Samples with boxes clipped to their slide; a missing slide drops the sample."""
    deck = F.coalesce("deck_name", "deck_id", F.lit(""))
    steps = raw.select(
        "sample_id", deck.alias("deck"), F.posexplode("evidence").alias("pos", "e")
    ).select(
        "sample_id", "deck", "pos", F.coalesce("e.slide_idx", "e.page", F.lit(0)).alias("slide"),
        F.coalesce("e.bboxes", F.array().cast("array<array<double>>")).alias("bboxes"),
    )
    found = steps.join(slide_images(images), ["deck", "slide"], "left")
    hop = F.struct(
        "pos",
        F.concat("deck", F.lit("/slide_"), F.col("slide").cast("string")).alias("entity"),
        F.col("path").alias("screenshot"), "width", "height",
        G.clip_boxes(F.col("bboxes"), F.col("width"), F.col("height")).alias("bboxes"),
    )
    chains = found.groupBy("sample_id").agg(
        F.bool_and(F.col("path").isNotNull()).alias("complete"), F.sort_array(F.collect_list(hop)).alias("hops")
    ).where("complete")
    chain = F.transform(
        "hops", lambda h: F.struct(h["entity"], h["screenshot"], h["width"], h["height"], h["bboxes"])
    )
    head = raw.select(
        "sample_id", F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce(F.col("answer").cast("string"), F.lit("")).alias("answer"),
        F.coalesce("question_type", F.lit("multi_hop")).alias("type"),
    )
    return chains.join(head, "sample_id").select(
        "sample_id", "question", "answer", "type", F.size("hops").alias("num_hops"), chain.alias("evidence_chain")
    )
