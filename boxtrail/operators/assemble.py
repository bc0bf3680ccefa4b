"""Facts, entities and evidence chains: ranking, assembly, checks, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.functions import geometry as G

EMPTY_BOXES = "array<array<int>>"


def explode_facts(questions: DataFrame) -> DataFrame:
    """(sample_id, fact_pos, entity, sid) from the nested supporting facts."""
    return questions.select("sample_id", F.posexplode("supporting_facts").alias("fact_pos", "f")).select(
        "sample_id", "fact_pos", F.col("f.title").alias("entity"), "f.sid"
    )


def rank_entities(facts: DataFrame, limit: int | None = None) -> DataFrame:
    """Entities by the number of distinct questions citing them; ties by name.

    The distinct step hashes on (entity, question), so a hot entity is spread
    before it is counted. With ``limit`` Spark keeps a bounded heap per task.
    """
    ranked = (
        facts.groupBy("entity").agg(F.count_distinct("sample_id").alias("n_questions"))
        .orderBy(F.desc("n_questions"), "entity")
    )
    return ranked.limit(limit) if limit else ranked


def first_context(entries: DataFrame) -> DataFrame:
    """Sentences per entity from the first place that lists them.

    ``entries`` is (sample_id, ctx_pos, entity, sents); the result has one row
    per sentence, so later joins fetch single sentences and never whole pages.
    """
    winner = entries.where(F.length("entity") > 0).groupBy("entity").agg(
        F.min_by("sents", F.struct("sample_id", "ctx_pos")).alias("sents")
    )
    return winner.select("entity", F.posexplode("sents").alias("sid", "sent"))


def known_facts(facts: DataFrame, meta: DataFrame) -> DataFrame:
    """Facts whose entity has been captured; the rest is dropped silently."""
    return facts.join(meta.select("entity"), "entity", "left_semi")


def group_facts(facts: DataFrame) -> DataFrame:
    """Sentence ids per question and entity in citation order, duplicates kept."""
    return facts.groupBy("sample_id", "entity").agg(
        F.min("fact_pos").alias("first_pos"),
        F.transform(F.sort_array(F.collect_list(F.struct("fact_pos", "sid"))), lambda x: x["sid"]).alias("sids"),
    )


def distinct_pairs(facts: DataFrame) -> DataFrame:
    """Each (entity, sentence) once: the unit of grounding work."""
    return facts.select("entity", "sid").distinct()


def pair_totals(facts: DataFrame) -> DataFrame:
    """Questions, entities and distinct pairs in one row."""
    return facts.agg(
        F.count_distinct("sample_id").alias("n_questions"),
        F.count_distinct("entity").alias("n_entities"),
        F.count_distinct("entity", "sid").alias("n_pairs"),
    )


def sentence_ids(facts: DataFrame) -> DataFrame:
    """Sorted distinct sentence ids per entity."""
    return distinct_pairs(facts).groupBy("entity").agg(F.sort_array(F.collect_list("sid")).alias("sids"))


def with_sentences(pairs: DataFrame, context: DataFrame) -> DataFrame:
    """Pairs with their sentence; null when the page text is unknown or shorter."""
    return pairs.join(context, ["entity", "sid"], "left")


def cached_entities(entities: DataFrame, meta: DataFrame) -> DataFrame:
    """Entities whose page already has paragraph boxes."""
    return entities.join(meta.where(F.col("bboxes_path").isNotNull()).select("entity"), "entity", "left_semi")


def uncached_entities(entities: DataFrame, meta: DataFrame) -> DataFrame:
    """Entities that must be located on the layout instead."""
    return entities.join(meta.where(F.col("bboxes_path").isNotNull()).select("entity"), "entity", "left_anti")


def merge_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two result tables; on equal keys the newer row wins."""
    tagged = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    latest = tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_gen").alias("_row"))
    return latest.select(*keys, "_row.*")


def assemble_samples(questions: DataFrame, facts: DataFrame, meta: DataFrame, grounded: DataFrame) -> DataFrame:
    """Samples whose every cited page has at least one grounded box.

    ``facts`` are known facts, ``grounded`` is (entity, sid, x1..y2). Hops keep
    the order in which the question first cites them; boxes keep fact order.
    Facts are hash-partitioned by question once, and both groupings reuse it.
    """
    pages = meta.select("entity", F.element_at(F.split("screenshot_path", "/"), -1).alias("screenshot"), "width", "height")
    box = F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2"))
    placed = (
        facts.join(grounded.select("entity", "sid", "x1", "y1", "x2", "y2"), ["entity", "sid"], "left")
        .join(pages, "entity")
        .select("sample_id", "fact_pos", "entity", "sid", "screenshot", "width", "height", box.alias("box"))
        .repartition("sample_id")
    )
    hops = placed.groupBy("sample_id", "entity", "screenshot", "width", "height").agg(
        F.sort_array(F.collect_list(F.struct("fact_pos", "sid", "box"))).alias("facts")
    )
    boxes = F.filter(F.transform("facts", lambda f: f["box"]), lambda b: b.isNotNull())
    hop = F.struct(
        F.get("facts", 0)["fact_pos"].alias("pos"), F.col("entity"), F.col("screenshot"), F.col("width"),
        F.col("height"), boxes.alias("bboxes"), F.transform("facts", lambda f: f["sid"]).alias("sentence_ids"),
    )
    chains = hops.groupBy("sample_id").agg(
        F.bool_and(F.size(boxes) > 0).alias("complete"), F.sort_array(F.collect_list(hop)).alias("hops")
    )
    chain = F.transform(
        "hops",
        lambda h: F.struct(h["entity"], h["screenshot"], h["width"], h["height"], h["bboxes"], h["sentence_ids"]),
    )
    return chains.where("complete").join(questions, "sample_id").select(
        "sample_id", "question", "answer", F.coalesce("type", F.lit("unknown")).alias("type"),
        F.size("hops").alias("num_hops"), chain.alias("evidence_chain"),
        *[c for c in ("evidences", "context") if c in questions.columns],
    )


def check_samples(samples: DataFrame, meta: DataFrame) -> DataFrame:
    """(sample_id, valid): known pages, boxes present and inside the page image."""
    hops = samples.select("sample_id", F.explode_outer("evidence_chain").alias("e")).select(
        "sample_id", "e.entity", "e.bboxes"
    )
    sizes = meta.select("entity", F.col("width").alias("w"), F.col("height").alias("h"))
    boxes = F.coalesce("bboxes", F.array().cast(EMPTY_BOXES))
    fits = (F.size(boxes) > 0) & F.forall(boxes, lambda b: G.within_bounds(b, F.col("w"), F.col("h")))
    judged = hops.join(sizes, "entity", "left").withColumn("ok", F.coalesce(fits & F.col("w").isNotNull(), F.lit(False)))
    return judged.groupBy("sample_id").agg(F.bool_and("ok").alias("valid"))


def samples_within_pages(samples: DataFrame) -> DataFrame:
    """Samples whose chains carry the page sizes: every hop has boxes, all inside its page image. No join."""
    fits = lambda e: (F.size(e["bboxes"]) > 0) & F.forall(e["bboxes"], lambda b: G.within_bounds(b, e["width"], e["height"])) & e["width"].isNotNull()
    every = F.forall("evidence_chain", lambda e: F.coalesce(fits(e), F.lit(False)))
    return samples.where((F.size("evidence_chain") > 0) & every)


def valid_samples(samples: DataFrame, meta: DataFrame) -> DataFrame:
    good = check_samples(samples, meta).where("valid").select("sample_id")
    return samples.join(good, "sample_id", "left_semi")


def flatten_resolved(samples: DataFrame, resolved: DataFrame) -> DataFrame:
    """One single-hop sample per resolved hop that has a box and a screenshot."""
    usable = resolved.where(F.col("bbox").isNotNull() & (F.coalesce("screenshot", F.lit("")) != ""))
    kind = samples.select("sample_id", F.coalesce("type", F.lit("")).alias("type"))
    entry = F.struct(
        F.coalesce("entity", F.lit("")).alias("entity"), F.col("screenshot"), F.array("bbox").alias("bboxes"),
        F.coalesce("sentence_ids", F.array().cast("array<int>")).alias("sentence_ids"),
    )
    return usable.join(kind, "sample_id").select(
        "sample_id", "hop_pos", "question", "answer", F.col("answer").alias("evidence_value"), "type",
        F.lit(1).alias("num_hops"), F.array(entry).alias("evidence_chain"),
    )


def unresolved_count(samples: DataFrame, resolved: DataFrame) -> DataFrame:
    """Number of samples without any resolved hop."""
    return samples.join(resolved.select("sample_id"), "sample_id", "left_anti").agg(F.count(F.lit(1)).alias("n_dropped"))


def reconcile_chain(samples: DataFrame, resolved: DataFrame) -> DataFrame:
    """Chains with the boxes of their resolved hops, plus a status per sample.

    The n-th chain entry of an entity takes the entity's n-th resolved hop; any
    entry left without one drops the sample (``missing_hop``). Each side is
    shuffled once by sample; the matching happens inside the row.
    """
    hop = F.struct("hop_pos", "entity", "bbox", "question")
    per_sample = resolved.groupBy("sample_id").agg(F.sort_array(F.collect_list(hop)).alias("hops"))
    joined = samples.join(per_sample, "sample_id", "left")
    chain, hops = F.col("evidence_chain"), F.col("placed")
    placed = F.filter("hops", lambda h: h["bbox"].isNotNull() & (h["entity"] != ""))

    def partner(e: Column, i: Column) -> Column:
        earlier = F.slice(chain, F.lit(1), i)
        nth = F.size(F.filter(earlier, lambda x: x["entity"] == e["entity"]))
        return F.get(F.filter(hops, lambda h: h["entity"] == e["entity"]), nth)

    matched = joined.withColumn("placed", placed).withColumn("partners", F.transform(chain, partner))
    status = (
        F.when(F.coalesce(F.size("hops"), F.lit(0)) <= 0, "no_resolved")
        .when(F.exists("partners", lambda p: p.isNull()), "missing_hop")
        .when(F.exists(F.arrays_zip(chain.alias("c"), F.col("partners").alias("p")),
                       lambda z: ~z["c"]["bboxes"].eqNullSafe(F.array(z["p"]["bbox"]))), "changed")
        .otherwise("same")
    )
    question = lambda p: F.trim(F.coalesce(p["question"], F.lit("")))
    rebuilt = F.zip_with(
        chain, F.col("partners"),
        lambda e, p: e.withField("bboxes", F.array(p["bbox"])).withField(
            "sub_query", F.when(question(p) != "", question(p)).otherwise(e["sub_query"])
        ),
    )
    out = matched.withColumn("status", status)
    return out.withColumn(
        "evidence_chain", F.when(F.col("status").isin("changed", "same"), rebuilt).otherwise(chain)
    ).drop("hops", "placed", "partners")


def reconcile_report(reconciled: DataFrame) -> DataFrame:
    """Samples by reconcile status with their hops before, and those kept after."""
    stays = F.col("status").isin("changed", "same")
    hops = F.size("evidence_chain")
    return reconciled.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hops).alias("n_hops"), F.sum(F.when(stays, hops).otherwise(0)).alias("n_hops_after")
    )


def hop_distribution(samples: DataFrame) -> DataFrame:
    return samples.groupBy("num_hops").agg(F.count(F.lit(1)).alias("n"))
