"""Logical tables of the library, derived from the driver tables.

Every derived value is a plain function of stored columns, so the same table
can be spelled in SQL (see ``sql.py``). Reads select columns late: Catalyst
prunes the scans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxtrail.runtime import configure, spread

BLOCK = "<(p|li|td|h1|div|b|span)([^>]*)>([^<]*)"


# Rows of these tables are a few bytes each but become chains, triples and model output.
ROWS_PER_TASK = {"orders": 100_000}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def wide(self, name: str) -> DataFrame:
        """A driver table for row-local work that is heavy per row."""
        return spread(self.raw(name), ROWS_PER_TASK.get(name))

    # ---- pages and text -----------------------------------------------------

    @cached_property
    def paragraphs(self) -> DataFrame:
        """Lines of a document as paragraphs with a box from their order and length."""
        lines = self.wide("documents").select(
            F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("para_ord", "text")
        ).where(F.length(F.trim("text")) > 0)
        return lines.selectExpr(
            "page_id", "para_ord", "text", "40 + (para_ord % 3) * 20 AS x1", "28 * para_ord AS y1",
            "40 + (para_ord % 3) * 20 + least(960, 6 * length(text)) AS x2",
            "28 * para_ord + 3 + least(length(text), 780) AS y2",
        )

    @cached_property
    def context_entries(self) -> DataFrame:
        """Each document as one context entry of the question with its number."""
        return self.wide("documents").select(
            F.col("doc_id").alias("sample_id"), F.lit(0).alias("ctx_pos"),
            F.concat(F.lit("Entity_"), F.col("doc_id").cast("string")).alias("entity"),
            F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ").alias("sents"),
        )

    @cached_property
    def sentences(self) -> DataFrame:
        """(page_id, sid, sent) for all sentences of all documents."""
        return self.context_entries.select(
            F.col("sample_id").alias("page_id"), "entity", F.posexplode("sents").alias("sid", "sent")
        )

    @cached_property
    def meta(self) -> DataFrame:
        """Captured pages; every fifth has no cached boxes."""
        return self.raw("documents").selectExpr(
            "concat('Entity_', doc_id) AS entity", "doc_id AS page_id",
            "concat('shots/shot_', doc_id, '.png') AS screenshot_path",
            "CASE WHEN doc_id % 5 <> 0 THEN concat('shots/shot_', doc_id, '_bboxes.json') END AS bboxes_path",
            "1100 + CAST(doc_id % 7 AS INT) * 50 AS width", "3000 + CAST(n_chars % 9000 AS INT) AS height",
        )

    @cached_property
    def layout(self) -> DataFrame:
        """Block elements of the raw pages with boxes from their order and text length."""
        part = lambda g: F.regexp_extract_all("html", F.lit(BLOCK), F.lit(g))
        zipped = self.wide("pages").select("page_id", F.arrays_zip(part(1).alias("t"), part(3).alias("s")).alias("z"))

        def element(z, i):
            text, n = z["s"], F.length(z["s"])
            floating = (i % 17 == 5) | (i % 19 == 3) | (i % 23 == 7)
            x1 = F.when(floating, 600 + (i % 7) * 20).otherwise(30 + (i % 5) * 10)
            w = F.when(floating, F.lit(300)).otherwise(F.least(F.lit(900), 5 * n))
            h = F.when(floating, 100 + i % 300).otherwise(10 + n % 900)
            lines = F.transform(
                F.sequence(F.lit(0), F.floor(n / 120).cast("int")),
                lambda j: F.array(x1, i * 40 + j * 18, x1 + F.least(F.lit(900), 5 * n) - j * 15, i * 40 + j * 18 + 16),
            )
            return F.struct(
                F.upper(z["t"]).alias("tag"),
                F.when(i % 17 == 5, "Infobox vcard").when(i % 23 == 7, "thumb tright").otherwise("").alias("cls"),
                text.alias("text"), F.array(x1, i * 40, x1 + w, i * 40 + h).alias("bcr"),
                F.when(i % 19 == 3, "right").otherwise("none").alias("float"),
                F.when(i % 6 == 0, F.array().cast("array<array<int>>")).otherwise(lines).alias("line_rects"),
            )

        return zipped.select("page_id", F.transform("z", element).alias("elements"))

    @cached_property
    def layout_elements(self) -> DataFrame:
        return self.layout.select("page_id", F.posexplode("elements").alias("el_ord", "e")).select("page_id", "el_ord", "e.*")

    # ---- questions and facts ------------------------------------------------

    @cached_property
    def facts(self) -> DataFrame:
        """Order lines as supporting facts of their order; equal positions are equal facts."""
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS sample_id", "l_linenumber * 1000000000L + l_partkey AS fact_pos",
            "concat('Entity_', l_partkey) AS entity", "l_linenumber - 1 AS sid",
        )

    @cached_property
    def questions(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS sample_id",
            "concat('Which ', lower(o_orderpriority), ' item belongs to customer ', o_custkey, '?') AS question",
            "concat('The ', o_orderpriority, ' order') AS answer", "o_orderstatus AS type",
        )

    @cached_property
    def page_of(self) -> DataFrame:
        """Screenshot -> page, image height (sometimes unknown) and state of the side table."""
        return self.raw("documents").selectExpr(
            "concat('shot_', doc_id, '.png') AS screenshot", "doc_id AS page_id",
            "CASE WHEN doc_id % 11 <> 0 THEN 300 + CAST(n_chars % 3000 AS INT) END AS image_height",
            "CASE WHEN doc_id % 29 = 0 THEN 'bad' ELSE 'ok' END AS side_table",
        )

    @cached_property
    def hop_samples(self) -> DataFrame:
        """Orders as samples with a chain of up to three pages and evidence triples."""
        chain = """transform(sequence(0, n - 1), i -> named_struct(
            'entity', concat('Entity_', o_custkey + 37 * i),
            'screenshot', concat('shot_', o_custkey + 37 * i, '.png'),
            'bboxes', array(array(40, 28 * i, 700, 28 * i + 60)),
            'sentence_ids', array(CAST((o_orderkey + i) % 9 AS INT)),
            'image_id', CAST(NULL AS STRING),
            'sub_query', CASE WHEN (o_orderkey + i) % 4 = 0 THEN ' ' WHEN (o_orderkey + i) % 4 = 1 THEN 'given' END))"""
        triples = """transform(sequence(0, n - 1), i -> named_struct(
            'entity', CASE (o_orderkey + i) % 7 WHEN 3 THEN concat('Entity_', o_custkey + 37 * i, ' (page)')
                WHEN 5 THEN 'Nobody' ELSE concat('Entity_', o_custkey + 37 * i) END,
            'relation', CASE WHEN (o_custkey + i) % 10 <> 7 THEN element_at(array('date_of_birth', 'place_of_death', 'director'), i + 1) END,
            'value', element_at(array('the on', 'of', 'la', 'und', 'that and', CAST(NULL AS STRING)), CAST(o_custkey % 6 AS INT) + 1)))"""
        return self.wide("orders").selectExpr("*", "CAST(1 + o_orderkey % 3 AS INT) AS n").selectExpr(
            "o_orderkey AS sample_id", "concat('Question ', o_orderkey) AS question", "o_orderpriority AS answer",
            "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS type", "n AS num_hops",
            f"{chain} AS evidence_chain",
            f"CASE WHEN o_orderkey % 13 <> 0 THEN {triples} END AS evidences",
        )

    # ---- images and slides --------------------------------------------------

    @cached_property
    def slide_files(self) -> DataFrame:
        """Slide images in forty decks under three naming rules; every eighth is missing."""
        return self.raw("part").selectExpr("*", "concat('deck', p_partkey % 40) AS deck").where("p_partkey % 8 <> 3").selectExpr(
            "concat(deck, '/', CASE p_partkey % 3 WHEN 0 THEN concat(deck, '_slide_', p_partkey) "
            "WHEN 1 THEN concat('slide_', lpad(CAST(p_partkey AS STRING), greatest(4, length(CAST(p_partkey AS STRING))), '0')) "
            "ELSE CAST(p_partkey AS STRING) END, '.png') AS path",
            "600 + p_size * 10 AS width", "400 + p_size * 5 AS height",
        )

    @cached_property
    def slide_raw(self) -> DataFrame:
        boxes = """transform(sequence(0, CAST((o_orderkey + i) % 3 AS INT)), j ->
            CASE WHEN (o_orderkey + i + j) % 10 = 7 THEN array(1D, 2D, 3D)
            ELSE array(CAST((o_orderkey * 3 + j * 50) % 900 - 20 AS DOUBLE), CAST((o_custkey + j * 30) % 500 - 10 AS DOUBLE),
                CAST((o_orderkey * 3 + j * 50) % 900 + 100 AS DOUBLE), CAST((o_custkey + j * 30) % 500 + 60 AS DOUBLE)) END)"""
        evidence = f"""transform(sequence(0, CAST(o_orderkey % 3 AS INT)), i -> named_struct(
            'slide_idx', CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 40 + 40 * ((o_orderkey + i) % 5) AS INT) END,
            'page', CAST(o_custkey % 40 + 40 * ((o_orderkey + i) % 5) AS INT),
            'bboxes', {boxes}))"""
        return self.wide("orders").selectExpr(
            "o_orderkey AS sample_id", "concat('Question ', o_orderkey) AS question", "o_totalprice AS answer",
            "CASE WHEN o_orderkey % 3 <> 1 THEN concat('deck', o_custkey % 40) END AS deck_name",
            "concat('deck', o_custkey % 40) AS deck_id",
            "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS question_type",
            f"CASE WHEN o_orderkey % 17 <> 0 THEN {evidence} END AS evidence",
        )

    @cached_property
    def deck_images(self) -> DataFrame:
        """Page images of the part catalogue: one deck per product type, some without a page number."""
        return self.raw("part").selectExpr(
            "concat('img/', p_type, CASE WHEN p_partkey % 2 = 0 THEN '__page_' ELSE '_page_' END, "
            "CASE WHEN p_partkey % 50 = 7 THEN concat('x', p_partkey) ELSE CAST(CAST(p_partkey / 3 AS INT) AS STRING) END, "
            "'.', p_partkey % 3, '.png') AS path",
            "800 + p_size * 20 AS width", "600 + CAST(p_retailprice AS INT) AS height", "p_partkey",
        )

    @cached_property
    def deck_samples(self) -> DataFrame:
        """Orders citing the catalogue page of each line (of possibly different decks, more than K for some)."""
        lines = self.raw("lineitem").selectExpr("l_orderkey AS sample_id", "l_linenumber AS pos", "l_partkey AS p_partkey")
        cited = lines.join(self.deck_images, "p_partkey")
        hops = F.sort_array(F.collect_list(F.struct("pos", "path")))
        return cited.groupBy("sample_id").agg(hops.alias("h")).select(
            "sample_id",
            F.transform("h", lambda x: F.struct(x["path"].alias("entity"), x["path"].alias("screenshot"))).alias("evidence_chain"),
            F.transform("h", lambda x: x["path"]).alias("gold"),
        )

    # ---- predictions --------------------------------------------------------

    @cached_property
    def chains(self) -> DataFrame:
        """Per order a gold chain and a predicted chain that differs by shifts, ids and missing hops."""
        gold_box = "array({x}, {y}, {x} + 40 + o_orderkey % 60, {y} + 30 + o_custkey % 50)".format(
            x="(o_orderkey * 7 + i * 31 + j * 101) % 900", y="(o_custkey * 5 + i * 17 + j * 53) % 700"
        )
        pred_box = "array({x}, {y}, {x} + 40 + o_orderkey % 60, {y} + 30 + o_custkey % 50)".format(
            x="((o_orderkey * 7 + i * 31 + j * 101) % 900 + (o_custkey % 5) * 12)",
            y="((o_custkey * 5 + i * 17 + j * 53) % 700 + (o_orderkey % 4) * 9)",
        )
        n_gold = "CASE WHEN (o_orderkey + 2 * i) % 13 = 0 THEN 0 ELSE 1 + (o_orderkey + i) % 2 END"
        n_pred = f"({n_gold}) + CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END"

        def boxes(n: str, box: str) -> str:
            return f"transform(filter(array(0L, 1L, 2L), j -> j < {n}), j -> CAST({box} AS ARRAY<DOUBLE>))"

        gold_id = "CASE WHEN (o_orderkey + i) % 11 = 0 THEN '' ELSE concat('img_', (o_orderkey + i) % 5) END"
        pred_id = f"CASE WHEN (o_custkey + i) % 6 = 0 THEN 'img_9' ELSE {gold_id} END"
        return self.wide("orders").selectExpr(
            "*", "1 + o_orderkey % 3 AS n", "1 + o_orderkey % 3 - CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS m"
        ).selectExpr(
            "o_orderkey AS idx", "o_custkey", "o_orderstatus AS type",
            "concat('The ', o_orderpriority, ' order') AS answer",
            "CASE o_custkey % 4 WHEN 0 THEN 'other thing' WHEN 1 THEN concat('a ', o_orderpriority, ' order!') "
            "WHEN 2 THEN concat('It is the ', o_orderpriority, ' order.') ELSE concat('The ', o_orderpriority, ' order') END AS pred_answer",
            f"transform(filter(array(0L, 1L, 2L), i -> i < n), i -> named_struct('image_id', {gold_id}, 'bboxes', {boxes(n_gold, gold_box)})) AS evidence_chain",
            f"transform(filter(array(0L, 1L, 2L), i -> i < m), i -> named_struct('hop', CAST(i + 1 AS INT), 'image_id', {pred_id}, 'bboxes', {boxes(n_pred, pred_box)})) AS pred_chain",
            "o_orderkey % 6 <> 5 AS image_metrics_enabled",
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """The predicted chains as model output text in ten shapes, broken ones included."""
        box_json = "concat('[', array_join(transform(b, v -> CAST(CAST(v AS INT) AS STRING)), ', '), ']')"
        boxes_json = f"concat('[', array_join(transform(e.bboxes, b -> {box_json}), ', '), ']')"
        hop_json = f"""concat('{{"hop": ', e.hop, ', "image_id": "', e.image_id, '", "bboxes": ', {boxes_json}, '}}')"""
        full = f"""concat('{{"evidence_chain": [', array_join(transform(pred_chain, e -> {hop_json}), ', '), '], "answer": "', pred_answer, '"}}')"""
        single = f"""concat('{{"bbox": ', coalesce(array_join(transform(slice(pred_chain, 1, 1), e -> {boxes_json}), ''), '[]'), ', "answer": "', pred_answer, '"}}')"""
        text = """CASE idx % 10 WHEN 3 THEN concat('```json\\n', j, '\\n```') WHEN 4 THEN concat('Sure, see: ', j)
            WHEN 5 THEN concat(j, ' Done.') WHEN 6 THEN substring(j, 1, length(j) - 5) WHEN 7 THEN ''
            WHEN 8 THEN concat('answer: ', pred_answer) WHEN 9 THEN s ELSE j END"""
        shaped = self.chains.selectExpr("*", f"{full} AS j", f"{single} AS s")
        return shaped.selectExpr(
            "idx", "type", "answer", "evidence_chain", "image_metrics_enabled", f"{text} AS pred_text"
        )

    # ---- logs ---------------------------------------------------------------

    @cached_property
    def log(self) -> DataFrame:
        """Events as a step log: one run per event type, null for unlogged values."""
        return self.raw("events").selectExpr(
            "event_type AS run", "event_id AS pos", "event_id DIV 3 AS step",
            "CASE WHEN event_id % 7 <> 0 THEN round(value, 1) END AS value",
        )

    @cached_property
    def checkpoints(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS pos", "concat('out/', event_type) AS dir", "event_id DIV 2 AS step",
            "concat('out/', event_type, '/checkpoint-', event_id) AS path", "value > 30 AS valid",
        )

    @cached_property
    def pixel_rows(self) -> DataFrame:
        """Vectors as pixel rows of images with 32 rows; most lower rows are flat."""
        level = F.when((F.col("vec_id") % 32 > 3 + F.floor(F.col("vec_id") / 32) % 12), 1.0).otherwise(400.0)
        return self.raw("embeddings").select(
            F.concat(F.lit("img_"), F.floor(F.col("vec_id") / 32).cast("string")).alias("file"),
            F.lit(64).alias("width"), (F.col("vec_id") % 32).cast("int").alias("y"),
            F.transform("embedding", lambda v: (F.lit(100) + F.floor(v.cast("double") * level)).cast("int")).alias("gray"),
        )
