"""Queries over slides, splits, distractors, records and overlays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxtrail.functions import geometry as G, records as R, text as T
from boxtrail.operators import records as RO, sampling as S, slides
from boxtrail.plans.registry import query
from boxtrail.plans.sql import with_ctes
from boxtrail.sources.readers import screenshots_large_enough

K, SEED = 5, 42
join_text = lambda arr: F.array_join(arr.cast("array<string>"), " ")

HASH_NUM = "('0x' || substring({h}, 1, 12))::BIGINT"


def boxes_text(boxes: Column) -> Column:
    return F.array_join(F.transform(boxes, join_text), ";")


@query("slide_convert", """WITH img AS (SELECT 'deck' || p_partkey % 40 AS deck, p_partkey AS slide, 'deck' || p_partkey % 40 || '/' || CASE p_partkey % 3
        WHEN 0 THEN 'deck' || p_partkey % 40 || '_slide_' || p_partkey WHEN 1 THEN 'slide_' || lpad(p_partkey::VARCHAR, greatest(4, length(p_partkey::VARCHAR))::INT, '0') ELSE p_partkey::VARCHAR END || '.png' AS path,
        600 + p_size * 10 AS w, 400 + p_size * 5 AS h FROM part WHERE p_partkey % 8 <> 3),
    ev AS (SELECT *, 'deck' || o_custkey % 40 AS deck, o_custkey % 40 + 40 * ((o_orderkey + i) % 5) AS slide FROM (SELECT *, unnest(range(1 + o_orderkey % 3)) AS i FROM orders WHERE o_orderkey % 17 <> 0)),
    bx AS (SELECT o_orderkey, i, j, (o_orderkey * 3 + j * 50) % 900 - 20 AS x1, (o_custkey + j * 30) % 500 - 10 AS y1, (o_orderkey * 3 + j * 50) % 900 + 100 AS x2, (o_custkey + j * 30) % 500 + 60 AS y2
        FROM (SELECT *, unnest(range(1 + (o_orderkey + i) % 3)) AS j FROM ev) WHERE (o_orderkey + i + j) % 10 <> 7),
    cl AS (SELECT e.o_orderkey, e.i, e.deck, e.slide, g.path, g.w, g.h, b.j, greatest(0, least(b.x1, g.w)) AS x1, greatest(0, least(b.y1, g.h)) AS y1, greatest(0, least(b.x2, g.w)) AS x2, greatest(0, least(b.y2, g.h)) AS y2
        FROM ev e LEFT JOIN img g ON g.deck = e.deck AND g.slide = e.slide LEFT JOIN bx b ON b.o_orderkey = e.o_orderkey AND b.i = e.i),
    hp AS (SELECT o_orderkey, i, any_value(deck || '/slide_' || slide || '|' || path || '|' || w || '|' || h) AS head,
        coalesce(string_agg(x1 || ' ' || y1 || ' ' || x2 || ' ' || y2, ';' ORDER BY j) FILTER (x2 > x1 AND y2 > y1), '') AS bx, bool_and(path IS NOT NULL) AS ok FROM cl GROUP BY 1, 2)
    SELECT h.o_orderkey AS sample_id, CASE WHEN any_value(o_orderstatus) = 'P' THEN 'multi_hop' ELSE any_value(o_orderstatus) END AS type, count(*)::INT AS num_hops, string_agg(head || '|' || bx, '/' ORDER BY i) AS chain
    FROM hp h JOIN orders o ON o.o_orderkey = h.o_orderkey GROUP BY 1 HAVING bool_and(ok)""")
def slide_convert(t):
    made = slides.convert_slides(t.slide_raw, t.slide_files)
    ints = lambda b: F.array_join(b.cast("array<int>").cast("array<string>"), " ")
    hop = lambda e: F.concat_ws(
        "|", e["entity"], e["screenshot"], e["width"].cast("string"), e["height"].cast("string"),
        F.array_join(F.transform(e["bboxes"], ints), ";"),
    )
    return made.select("sample_id", "type", "num_hops", F.array_join(F.transform("evidence_chain", hop), "/").alias("chain"))


@query("hash_split", """SELECT o_orderkey AS sample_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) <=
    (SELECT round_even(count(*) * 0.05::DOUBLE, 0) FROM orders) THEN 'val' ELSE 'train' END AS split FROM orders""")
def hash_split(t):
    return S.hash_split(t.questions.select("sample_id"), 0.05, SEED)


@query("head_split", """SELECT o_orderkey AS sample_id, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= (SELECT floor(count(*) * 0.8::DOUBLE) FROM orders) THEN 'train' ELSE 'test' END AS split FROM orders""")
def head_split(t):
    return S.head_split(t.questions.select("sample_id"))


@query("shard_modulo", "SELECT o_orderkey % 8 AS shard, count(*) AS n FROM orders GROUP BY 1")
def shard_modulo(t):
    return t.questions.groupBy(S.shard_of(F.col("sample_id"), 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


POOL = """, pool AS (SELECT path, row_number() OVER (ORDER BY md5('42|' || path), path) - 1 AS ordinal FROM (SELECT DISTINCT path FROM deck_image))"""
GLOBAL = POOL + """, draw AS (SELECT sample_id, gold, d, ((('0x' || substring(md5('42|' || sample_id), 1, 12))::BIGINT % total) + d) % total AS ordinal, greatest(0, 5 - len(gold)) AS need
        FROM (SELECT *, unnest(range(least(total, greatest(0, 5 - len(gold)) + len(gold)))) AS d FROM (SELECT g.*, (SELECT count(*) FROM pool) AS total FROM deck_gold g) WHERE len(gold) < 5)),
    picked AS (SELECT sample_id, d, path FROM (SELECT w.sample_id, w.d, w.need, p.path, row_number() OVER (PARTITION BY w.sample_id ORDER BY w.d) AS r FROM draw w JOIN pool p ON p.ordinal = w.ordinal WHERE NOT list_contains(w.gold, p.path)) WHERE r <= need)"""


def _gold(t):
    return t.deck_samples.select("sample_id", F.array_distinct("gold").alias("gold"))


def _images(t):
    return t.deck_images.select(F.col("path").alias("screenshot"))


@query("distractors_global", with_ctes(["deck_gold"], GLOBAL + " SELECT sample_id, string_agg(path, '|' ORDER BY d) AS distractors FROM picked GROUP BY sample_id"))
def distractors_global(t):
    return S.global_distractors(_gold(t), _images(t), K, SEED).withColumn("distractors", F.array_join("distractors", "|"))


SAME_DECK = with_ctes(["deck_gold"], """, near AS (SELECT g.sample_id, i.path, coalesce(nullif(i.page, 0), 1000000000) AS p,
        CASE WHEN len(g.pages) > 0 THEN list_min(list_transform(g.pages, lambda x: abs(coalesce(nullif(i.page, 0), 1000000000) - x))) END AS dist, 5 - len(g.gold) AS need, coalesce(len(g.pages), 0) AS np
        FROM deck_gold g JOIN deck_image i ON i.deck = g.deck WHERE NOT list_contains(g.gold, i.path)),
    ranked AS (SELECT *, CASE WHEN np > 0 THEN row_number() OVER (PARTITION BY sample_id ORDER BY dist, p, path) ELSE row_number() OVER (PARTITION BY sample_id ORDER BY path) END AS r FROM near)""")


@query("distractors_same_deck", SAME_DECK + " SELECT sample_id, string_agg(path, '|' ORDER BY r) AS distractors FROM ranked WHERE r <= need GROUP BY sample_id")
def distractors_same_deck(t):
    return S.same_deck_distractors(_gold(t), _images(t), K).withColumn("distractors", F.array_join("distractors", "|"))


@query("distractors_explicit", """WITH s AS (SELECT o_orderkey, ['shot_' || o_custkey] AS gold, list_transform(range(o_orderkey % 12), lambda i: CASE WHEN i % 5 = 4 THEN '' ELSE 'shot_' || (o_custkey + i % 7) END) AS listed FROM orders),
    p AS (SELECT o_orderkey, x, i FROM (SELECT o_orderkey, gold, unnest(listed) AS x, unnest(range(len(listed))) AS i FROM s) WHERE x <> '' AND NOT list_contains(gold, x) QUALIFY row_number() OVER (PARTITION BY o_orderkey, x ORDER BY i) = 1),
    r AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_orderkey ORDER BY md5('42|' || o_orderkey || '|' || x)) AS rh, row_number() OVER (PARTITION BY o_orderkey ORDER BY i) AS ri FROM p)
    SELECT o_orderkey AS sample_id, string_agg(x, '|' ORDER BY CASE WHEN n <= 4 THEN ri ELSE rh END) AS distractors FROM r WHERE CASE WHEN n <= 4 THEN ri ELSE rh END <= 4 GROUP BY o_orderkey""")
def distractors_explicit(t):
    listed = """transform(slice(sequence(0, 11), 1, CAST(o_orderkey % 12 AS INT)), i -> CASE WHEN i % 5 = 4 THEN '' ELSE concat('shot_', o_custkey + i % 7) END)"""
    samples = t.raw("orders").selectExpr("o_orderkey AS sample_id", "array(concat('shot_', o_custkey)) AS gold", f"{listed} AS listed")
    return S.explicit_distractors(samples, K, SEED).withColumn("distractors", F.array_join("distractors", "|"))


@query("candidate_order", with_ctes(["deck_gold"], """SELECT sample_id, string_agg(path, '|' ORDER BY md5('42|' || sample_id || '|' || path), path) AS candidates FROM (SELECT sample_id, unnest(gold) AS path FROM deck_gold) GROUP BY sample_id"""))
def candidate_order(t):
    rows = _gold(t).select("sample_id", F.col("gold").alias("candidates"))
    return S.candidate_order(rows, SEED).withColumn("candidates", F.array_join("candidates", "|"))


@query("build_candidates", with_ctes(["deck_gold"], GLOBAL.replace("FROM (SELECT DISTINCT path FROM deck_image)", "FROM (SELECT DISTINCT unnest(gold) AS path FROM deck_gold)") + """,
    every AS (SELECT sample_id, unnest(gold) AS path FROM deck_gold UNION ALL SELECT sample_id, path FROM picked)
    SELECT sample_id, string_agg(path, '|' ORDER BY md5('42|' || sample_id || '|' || path), path) AS candidates FROM every GROUP BY sample_id"""))
def build_candidates(t):
    made = S.build_candidates(t.deck_samples, K, strategy="global", seed=SEED)
    return made.select("sample_id", F.array_join("candidates", "|").alias("candidates"))


@query("build_candidates_same_deck", SAME_DECK + """, every AS (SELECT sample_id, unnest(gold) AS path FROM deck_gold UNION ALL SELECT sample_id, path FROM ranked WHERE r <= need)
    SELECT sample_id, string_agg(path, '|' ORDER BY md5('42|' || sample_id || '|' || path), path) AS candidates FROM every GROUP BY sample_id""")
def build_candidates_same_deck(t):
    """Candidates of the first gold screenshot's deck, out of all images and cited screenshots."""
    made = S.build_candidates(t.deck_samples, K, strategy="same_deck", images=t.deck_images, seed=SEED)
    return made.select("sample_id", F.array_join("candidates", "|").alias("candidates"))


@query("screenshot_pool", with_ctes(["deck_gold"], "SELECT DISTINCT path AS screenshot FROM deck_image"))
def screenshot_pool(t):
    return S.screenshot_pool(t.deck_samples, t.deck_images)


# ---- geometry ---------------------------------------------------------------

PLAN = """SELECT *, greatest(32, floor(nw / 32.0::DOUBLE)::BIGINT * 32) AS pw, greatest(32, floor(nh / 32.0::DOUBLE)::BIGINT * 32) AS ph FROM (
    SELECT *, CASE WHEN over THEN trunc(w * s2) ELSE a END AS nw, CASE WHEN over THEN trunc(h * s2) ELSE b END AS nh FROM (
    SELECT *, a * b > 1048576 AS over, s * sqrt(1048576.0::DOUBLE / (a * b)) AS s2 FROM (
    SELECT *, trunc(w * s) AS a, trunc(h * s) AS b FROM (SELECT *, 1024.0::DOUBLE / w AS s FROM ({src})))))"""
SIZES = "SELECT l_orderkey, l_linenumber, l_partkey, (200 + l_partkey % 3000)::DOUBLE AS w, (150 + l_suppkey * 7 % 9000)::DOUBLE AS h, l_quantity FROM lineitem"


@query("resize_plan", f"SELECT l_orderkey, l_linenumber, l_partkey, w::INT AS w, h::INT AS h, pw::INT AS new_w, ph::INT AS new_h FROM ({PLAN.format(src=SIZES)})")
def resize_plan(t):
    rows = t.raw("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "CAST(200 + l_partkey % 3000 AS INT) AS w", "CAST(150 + l_suppkey * 7 % 9000 AS INT) AS h")
    plan = G.resize_plan(F.col("w"), F.col("h"), F.lit(1024), 1048576)
    return rows.select("*", plan.width.alias("new_w"), plan.height.alias("new_h"))


@query("scale_boxes", f"""SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, least(pw, trunc(10 * (pw / w))))::INT || ' ' || greatest(0, least(ph, trunc(l_quantity::INT * (ph / h))))::INT || ' ' ||
    greatest(0, least(pw, trunc((l_partkey % 5000) * (pw / w))))::INT || ' ' || greatest(0, least(ph, trunc((100 + l_quantity::INT) * (ph / h))))::INT AS box FROM ({PLAN.format(src=SIZES)})""")
def scale_boxes(t):
    box = "array(array(10, CAST(l_quantity AS INT), CAST(l_partkey % 5000 AS INT), 100 + CAST(l_quantity AS INT))) AS boxes"
    rows = t.raw("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "CAST(200 + l_partkey % 3000 AS INT) AS w", "CAST(150 + l_suppkey * 7 % 9000 AS INT) AS h", box)
    plan = G.resize_plan(F.col("w"), F.col("h"), F.lit(1024), 1048576)
    planned = rows.select("*", plan.width.alias("nw"), plan.height.alias("nh"))
    scaled = G.scale_boxes(F.col("boxes"), F.col("w"), F.col("h"), F.col("nw"), F.col("nh"))
    return planned.select("l_orderkey", "l_linenumber", "l_partkey", boxes_text(scaled).alias("box"))


@query("captured_pages", "SELECT doc_id, n_chars AS height FROM documents WHERE n_chars >= 100")
def captured_pages(t):
    """Pages of usable size, their height cut at the capture limit."""
    pages = t.raw("documents").select("doc_id", F.lit(1024).alias("width"), G.captured_height(F.col("n_chars")).alias("height"))
    return screenshots_large_enough(pages).select("doc_id", "height")


# ---- records ----------------------------------------------------------------

@query("image_id_resolve", """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(CASE l_partkey % 4 WHEN 0 THEN 'own_' || l_partkey WHEN 1 THEN '' END, ''),
    CASE WHEN l_suppkey % 3 = 0 THEN 'ent_' || l_suppkey END, nullif(CASE WHEN l_suppkey % 3 = 1 THEN '' WHEN l_orderkey % 2 = 0 THEN 'shot_' || l_orderkey END, ''), 'img_' || (l_linenumber - 1)) AS image_id FROM lineitem""")
def image_id_resolve(t):
    own = F.expr("CASE l_partkey % 4 WHEN 0 THEN concat('own_', l_partkey) WHEN 1 THEN '' END")
    ent = F.expr("CASE WHEN l_suppkey % 3 = 0 THEN concat('ent_', l_suppkey) END")
    shot = F.expr("CASE WHEN l_suppkey % 3 = 1 THEN '' WHEN l_orderkey % 2 = 0 THEN concat('shot_', l_orderkey) END")
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", R.resolve_image_id(own, ent, shot, F.col("l_linenumber") - 1).alias("image_id")
    )


@query("sub_query_lookup", with_ctes("triple", """SELECT sample_id, 'G' || ((sample_id + hop_pos) % 2) AS entity, arg_max('What is the ' || trim(replace(relation, '_', ' ')) || ' of G' || ((sample_id + hop_pos) % 2) || '?', hop_pos) AS sub_query
    FROM triple WHERE relation IS NOT NULL GROUP BY 1, 2"""))
def sub_query_lookup(t):
    triples = t.hop_samples.select("sample_id", F.posexplode("evidences").alias("pos", "e")).selectExpr(
        "sample_id", "pos", "concat('G', (sample_id + pos) % 2) AS entity", "e.relation AS relation"
    )
    return RO.sub_queries(triples)


@query("relation_question", with_ctes("triple", """SELECT sample_id, hop_pos, split_part(replace(relation, '_', ' ') || ' of ', ' of ', 1) AS relation, split_part(replace(relation, '_', ' ') || ' of ', ' of ', 1) IN ('date of birth', 'date of death', 'country of citizenship', 'place of birth', 'place of death', 'director',
    'publication date', 'publisher', 'performer', 'composer', 'screenwriter', 'father', 'mother', 'spouse', 'occupation') AS known FROM triple"""))
def relation_question(t):
    """The relation read back from the templated question ends at its first " of "."""
    triples = t.hop_samples.select("sample_id", F.posexplode("evidences").alias("hop_pos", "e"))
    asked = T.relation_question(F.col("e.relation"), F.col("e.entity"))
    rel = T.relation_from_question(asked)
    return triples.select("sample_id", "hop_pos", rel.alias("relation"), T.is_known_relation(rel).alias("known"))


RECORD = f""", img AS (SELECT doc_id AS doc, (700 + doc_id % 2000)::DOUBLE AS w, (500 + n_chars % 8000)::DOUBLE AS h FROM documents),
    src AS (SELECT c.*, i.w, i.h FROM chain_entry c LEFT JOIN img i ON i.doc = c.doc),
    fit AS (SELECT *, 28 * chain_pos AS y1, 28 * chain_pos + 60 AS y2 FROM ({PLAN.format(src='SELECT * FROM src WHERE w IS NOT NULL')})),
    box AS (SELECT sample_id, chain_pos, entity, screenshot, sub_query, least(pw, trunc(40 * (pw / w)))::INT AS b1, least(ph, trunc(y1 * (ph / h)))::INT AS b2, least(pw, trunc(700 * (pw / w)))::INT AS b3, least(ph, trunc(y2 * (ph / h)))::INT AS b4 FROM fit),
    ask AS (SELECT b.*, coalesce(nullif(trim(coalesce(b.sub_query, '')), ''), (SELECT arg_max('What is the ' || replace(t.relation, '_', ' ') || ' of ' || t.entity || '?', t.hop_pos) FROM triple t WHERE t.sample_id = b.sample_id AND t.entity = b.entity AND t.relation IS NOT NULL), '') AS q FROM box b)"""


def _record_images(t):
    return t.raw("documents").selectExpr(
        "concat('shot_', doc_id, '.png') AS path", "CAST(700 + doc_id % 2000 AS INT) AS width", "CAST(500 + n_chars % 8000 AS INT) AS height"
    )


def _with_malformed_triples(samples):
    """Every triple once more behind the others, without its relation."""
    return samples.withColumn("evidences", F.concat("evidences", F.transform("evidences", lambda e: e.withField("relation", F.lit(None).cast("string")))))


@query("target_json", with_ctes(["chain_entry", "triple"], RECORD + """ SELECT a.sample_id, '{"evidence_chain": [' || string_agg('{"hop": ' || (chain_pos + 1) || ', "image_id": "img_' || chain_pos || '", "bboxes": [[' || b1 || ', ' || b2 || ', ' || b3 || ', ' || b4 || ']], "sub_query": "' || q || '"}', ', ' ORDER BY chain_pos)
    || '], "answer": "' || any_value(o_orderpriority) || '"}' AS target_text FROM ask a JOIN orders o ON o.o_orderkey = a.sample_id GROUP BY a.sample_id HAVING count(*) = 1 + a.sample_id % 3"""))
def target_json(t):
    """Multi-hop records in strict mode: samples with a missing image are left out. Malformed triples at the end change nothing."""
    made = RO.build_training_records(_with_malformed_triples(t.hop_samples), _record_images(t), split="val", image_dir="shots")
    return made.select("sample_id", "target_text")


@query("target_json_single_hop", with_ctes(["chain_entry", "triple"], RECORD + """ SELECT sample_id, chain_pos AS hop_pos, '{"bbox": [[' || b1 || ', ' || b2 || ', ' || b3 || ', ' || b4 || ']], "answer": "' || (SELECT o_orderpriority FROM orders WHERE o_orderkey = a.sample_id) || '"}' AS target_text
    FROM ask a"""))
def target_json_single_hop(t):
    """Every hop of every sample as a sample of its own."""
    chain = t.hop_samples.select("*", F.posexplode("evidence_chain").alias("hop_pos", "e"))
    single = chain.withColumns({"sample_id": F.col("sample_id") * 4 + F.col("hop_pos"), "evidence_chain": F.array("e"), "num_hops": F.lit(1)}).drop("hop_pos", "e")
    made = RO.build_training_records(single, _record_images(t), mode="single_hop", split="val", include_reasoning=False)
    return made.select(F.floor(F.col("sample_id") / 4).alias("sample_id"), (F.col("sample_id") % 4).cast("int").alias("hop_pos"), "target_text")


@query("prompt_messages", with_ctes("chain_entry", """, img AS (SELECT DISTINCT doc_id FROM documents)
    SELECT sample_id, 3 AS n_turns, 2 AS n_prompt, 2 * count(*) + 1 AS n_parts, string_agg('shots/' || screenshot || '[img_' || chain_pos || ']', '' ORDER BY chain_pos) AS shown,
    string_agg(screenshot, '|' ORDER BY chain_pos) AS relative, string_agg('img_' || chain_pos, '|' ORDER BY chain_pos) AS gold_ids
    FROM chain_entry c LEFT JOIN img ON doc_id = c.doc GROUP BY sample_id HAVING bool_and(doc_id IS NOT NULL)"""))
def prompt_messages(t):
    made = RO.build_training_records(t.hop_samples, _record_images(t), split="val", image_dir="shots")
    parts = F.get("messages", 1)["content"]
    shown = F.array_join(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.coalesce(p["image"], p["text"])), "")
    return made.select(
        "sample_id", F.size("messages").alias("n_turns"), F.size(R.prompt_only(F.col("messages"))).alias("n_prompt"),
        F.size(parts).alias("n_parts"), shown.alias("shown"), F.array_join("candidate_screenshots", "|").alias("relative"),
        F.array_join("gold_image_ids", "|").alias("gold_ids"),
    )


@query("drop_assistant_turns", "SELECT conv_id, turn, role FROM conversations WHERE role <> 'assistant'")
def drop_assistant_turns(t):
    """Conversations as message lists, without the turns a prompt must not hold."""
    turn = F.struct("turn", "role")
    lists = t.raw("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("messages"))
    return lists.select("conv_id", F.inline(R.prompt_only(F.col("messages"))))


@query("eval_records", with_ctes(["chain_entry"], f""", img AS (SELECT doc_id AS doc, (700 + doc_id % 2000)::DOUBLE AS w, (500 + n_chars % 8000)::DOUBLE AS h FROM documents),
    src AS (SELECT c.*, coalesce(i.w, 1024)::DOUBLE AS w, coalesce(i.h, 768)::DOUBLE AS h FROM chain_entry c LEFT JOIN img i ON i.doc = c.doc)
    SELECT sample_id, any_value(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END) AS type, string_agg(least(pw, trunc(40 * (pw / w)))::INT || ' ' || least(ph, trunc(28 * chain_pos * (ph / h)))::INT || ' ' || least(pw, trunc(700 * (pw / w)))::INT || ' ' || least(ph, trunc((28 * chain_pos + 60) * (ph / h)))::INT, '/' ORDER BY chain_pos) AS boxes
    FROM ({PLAN.format(src='SELECT * FROM src')}) JOIN orders ON o_orderkey = sample_id GROUP BY sample_id"""))
def eval_records(t):
    made = RO.build_eval_records(t.hop_samples, _record_images(t))
    return made.select("sample_id", "type", F.array_join(F.transform("evidence_chain", lambda e: boxes_text(e["bboxes"])), "/").alias("boxes"))


@query("missing_images", with_ctes("chain_entry", "SELECT DISTINCT sample_id, screenshot AS path FROM chain_entry WHERE doc NOT IN (SELECT doc_id FROM documents)"))
def missing_images(t):
    return RO.missing_images(t.hop_samples, _record_images(t))


@query("train_augmentation", """SELECT o_orderkey AS sample_id, ([768, 896, 1024])[1 + floor(('0x' || substring(md5('42|' || o_orderkey || '|resolution'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * 3)::INT] AS resolution,
    trunc(1024 * (0.9::DOUBLE + ('0x' || substring(md5('42|' || o_orderkey || '|0|jitter'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * (1.1::DOUBLE - 0.9::DOUBLE)))::BIGINT AS jittered FROM orders""")
def train_augmentation(t):
    key = F.col("sample_id")
    return t.questions.select(
        "sample_id", RO.choose_resolution(key, [768, 896, 1024], SEED).alias("resolution"),
        RO.jitter_target(F.lit(1024), key, F.lit(0), SEED).alias("jittered"),
    )


@query("permute_evidence", with_ctes("chain_entry", "SELECT sample_id, string_agg(entity, '|' ORDER BY md5('42|' || sample_id || '|' || chain_pos), chain_pos) AS entities FROM chain_entry GROUP BY sample_id"))
def permute_evidence(t):
    moved = RO.permute_evidence(t.hop_samples, SEED)
    return moved.select("sample_id", F.array_join(F.transform("evidence_chain", lambda e: e["entity"]), "|").alias("entities"))


TOKENS = """SELECT vec_id AS row_id, list_transform(embedding, lambda v: abs(floor(v::DOUBLE * 40))::INT) AS ids, list_slice(list_transform(embedding, lambda v: abs(floor(v::DOUBLE * 40))::INT), 1, (vec_id % 64)::INT) AS prompt FROM embeddings"""


def _tokens(t):
    ids = F.transform("embedding", lambda v: F.abs(F.floor(v.cast("double") * 40)).cast("int"))
    rows = t.raw("embeddings").select(F.col("vec_id").alias("row_id"), ids.alias("ids"))
    prompt = F.slice("ids", F.lit(1), (F.col("row_id") % 64).cast("int"))
    length = R.prompt_length(prompt, F.lit(0))
    return rows.withColumn("n_prompt", length).withColumn("labels", R.supervision_mask(F.col("ids"), F.col("n_prompt"), F.lit(0)))


MASK = f"""WITH k AS (SELECT *, len(list_filter(prompt, lambda x: x <> 0)) AS n FROM ({TOKENS})), m AS (SELECT row_id, n, list_transform(ids, lambda x, i: CASE WHEN i <= n OR x = 0 THEN -100 ELSE x END) AS labels FROM k)"""


@query("supervision_mask", MASK + " SELECT row_id, n::INT AS n_prompt, array_to_string(labels, ' ') AS labels FROM m")
def supervision_mask(t):
    return _tokens(t).select("row_id", "n_prompt", join_text(F.col("labels")).alias("labels"))


@query("mask_violations", MASK + """, f AS (SELECT row_id, list_filter(list_transform(labels, lambda x, i: CASE WHEN x <> -100 THEN i END), lambda i: i IS NOT NULL) AS pos FROM m)
    SELECT row_id, CASE WHEN len(pos) = 0 THEN 'no_labels' ELSE 'not_contiguous' END AS rule FROM f WHERE len(pos) = 0 OR list_max(pos) - list_min(pos) + 1 <> len(pos)""")
def mask_violations(t):
    return RO.mask_violations(_tokens(t))


@query("dq_violations", """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, 1 + o_orderkey % 3 AS n FROM orders), h AS (SELECT *, unnest(range(n)) AS i FROM r),
    v AS (SELECT k, CASE WHEN (k + i) % 5 >= 3 THEN 'image_index' WHEN NOT ((c + i * 7) % 50 - 2 >= 0 AND (c + i * 7) % 50 - 2 <= (k * 3) % 400 AND (k * 3) % 400 <= 390) THEN 'box_bounds' END AS rule, i AS hop FROM h)
    SELECT k AS sample_id, rule, hop::INT AS hop FROM v WHERE rule IS NOT NULL UNION ALL SELECT k, 'chain_length', -1 FROM r WHERE k % 9 = 0""")
def dq_violations(t):
    rows = t.raw("orders").selectExpr("o_orderkey AS sample_id", "o_custkey", "CAST(1 + o_orderkey % 3 AS INT) AS n").selectExpr(
        "sample_id", "sequence(1, n + CASE WHEN sample_id % 9 = 0 THEN 1 ELSE 0 END) AS evidence_chain",
        """transform(sequence(0, n - 1), i -> named_struct('image_id', concat('img_', (sample_id + i) % 5),
            'bboxes', array(array((o_custkey + i * 7) % 50 - 2, 5L, (sample_id * 3) % 400, 60L)))) AS target_chain""",
        "array(named_struct('width', 390, 'height', 100), named_struct('width', 390, 'height', 100), named_struct('width', 390, 'height', 100)) AS sizes",
    )
    return RO.record_violations(rows)


@query("overlay_spec", with_ctes("chains", """, h AS (SELECT idx, unnest(range(len(pred))) AS pos, unnest(pred) AS e FROM chains), b AS (SELECT idx, pos, e.hop AS hop, e.image_id AS image_id, unnest(range(len(e.bboxes))) AS box_ord, unnest(e.bboxes) AS box FROM h)
    SELECT idx, pos::INT AS pos, hop::INT AS hop, substring(image_id, 5)::INT AS image, (hop % 8)::INT AS colour, 'Hop ' || hop || ': ' || 'looking for ' || repeat('evidence ', (idx % 7)::INT) AS label, box_ord::INT AS box_ord, box[1]::INT AS x1, box[4]::INT AS y2
    FROM b WHERE starts_with(image_id, 'img_') AND substring(image_id, 5)::INT < 4"""))
def overlay_spec(t):
    chain = F.transform(
        "pred_chain",
        lambda e: F.struct(
            e["hop"].alias("hop"), e["image_id"].alias("image_id"), e["bboxes"].alias("bboxes"),
            F.concat(F.lit("looking for "), F.repeat(F.lit("evidence "), (F.col("idx") % 7).cast("int"))).alias("sub_query"),
        ),
    )
    spec = RO.overlay_spec(t.chains.select("idx", chain.alias("chain"), F.lit(4).alias("n_images")))
    return spec.select(
        "idx", "pos", "hop", "image", "colour", "label", "box_ord",
        F.get("box", 0).cast("int").alias("x1"), F.get("box", 3).cast("int").alias("y2"),
    )


@query("deck_and_page", with_ctes("deck_image", "SELECT p_partkey, deck, page::INT AS page FROM deck_image"))
def deck_and_page(t):
    return t.deck_images.select("p_partkey", T.deck_key(F.col("path")).alias("deck"), T.page_number(F.col("path")).alias("page"))
