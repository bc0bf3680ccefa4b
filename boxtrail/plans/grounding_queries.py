"""Queries over facts, pages, layouts and hop resolution."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxtrail.functions import text as T
from boxtrail.operators import assemble as A, grounding as G, layout as L
from boxtrail.plans.registry import query
from boxtrail.plans.sql import with_ctes
from boxtrail.runtime import materialize

JOIN_INTS = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")


def box_text(box: Column) -> Column:
    return F.array_join(box.cast("array<string>"), " ")


def _targets(t):
    """Cited (page, sentence) pairs of captured pages; null text where the page has no such sentence."""
    pairs = A.distinct_pairs(A.known_facts(t.facts, t.meta))
    context = t.sentences.select("entity", "sid", "sent")
    pages = t.meta.select("entity", "page_id")
    return A.with_sentences(pairs, context).join(pages, "entity")


def _grounded(t):
    return G.ground_sentences(_targets(t).select("page_id", "sid", "sent"), t.paragraphs)


def _assembled(t):
    grounded = _grounded(t).join(t.meta.select("page_id", "entity"), "page_id")
    return A.assemble_samples(t.questions, A.known_facts(t.facts, t.meta), t.meta, grounded)


def _resolved(t):
    return G.resolve_hops(t.hop_samples, t.sentences.select("entity", "sid", "sent"), t.page_of, t.paragraphs)


# ---- facts and entities -----------------------------------------------------

@query("entity_rank", with_ctes("fact", "SELECT entity, count(DISTINCT sample_id) AS n_questions FROM fact GROUP BY entity"))
def entity_rank(t):
    return A.rank_entities(t.facts)


@query("entity_top", with_ctes("fact", "SELECT entity, count(DISTINCT sample_id) AS n_questions FROM fact GROUP BY entity ORDER BY 2 DESC, 1 LIMIT 100"))
def entity_top(t):
    return A.rank_entities(t.facts, limit=100)


@query("fact_semi_join", with_ctes("known", "SELECT * FROM known"))
def fact_semi_join(t):
    return A.known_facts(t.facts, t.meta)


@query("distinct_pairs", with_ctes("known", "SELECT DISTINCT entity, sid FROM known"))
def distinct_pairs(t):
    return A.distinct_pairs(A.known_facts(t.facts, t.meta))


@query("pair_totals", with_ctes("known", "SELECT count(DISTINCT sample_id) AS n_questions, count(DISTINCT entity) AS n_entities, count(DISTINCT entity || '#' || sid) AS n_pairs FROM known"))
def pair_totals(t):
    return A.pair_totals(A.known_facts(t.facts, t.meta))


@query("context_first_wins", """WITH e AS (SELECT doc_id, source || ':' || lang || ':' || n_chars % 50 AS entity, string_split(replace(text, chr(10), ' '), '. ') AS sents FROM documents),
    w AS (SELECT entity, arg_min(sents, doc_id) AS sents FROM e GROUP BY entity)
    SELECT entity, unnest(range(len(sents)))::INT AS sid, unnest(sents) AS sent FROM w""")
def context_first_wins(t):
    entries = t.raw("documents").select(
        F.col("doc_id").alias("sample_id"), F.lit(0).alias("ctx_pos"),
        F.concat("source", F.lit(":"), "lang", F.lit(":"), (F.col("n_chars") % 50).cast("string")).alias("entity"),
        F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ").alias("sents"),
    )
    return A.first_context(entries)


@query("facts_grouped", with_ctes("known", "SELECT sample_id, entity, min(fact_pos) AS first_pos, string_agg(sid::VARCHAR, ',' ORDER BY fact_pos, sid) AS sids FROM known GROUP BY 1, 2"))
def facts_grouped(t):
    return A.group_facts(A.known_facts(t.facts, t.meta)).withColumn("sids", JOIN_INTS("sids"))


@query("sorted_sentence_ids", with_ctes("known", "SELECT entity, string_agg(sid::VARCHAR, ',' ORDER BY sid) AS sids FROM (SELECT DISTINCT entity, sid FROM known) GROUP BY entity"))
def sorted_sentence_ids(t):
    return A.sentence_ids(A.known_facts(t.facts, t.meta)).withColumn("sids", JOIN_INTS("sids"))


@query("cached_route", with_ctes("known", "SELECT DISTINCT k.entity, CASE WHEN m.cached THEN 'cached' ELSE 'layout' END AS route FROM known k JOIN meta m ON m.entity = k.entity"))
def cached_route(t):
    entities = A.known_facts(t.facts.select("entity").distinct(), t.meta)  # facts meet the pages as distinct entities
    return A.cached_entities(entities, t.meta).withColumn("route", F.lit("cached")).unionByName(
        A.uncached_entities(entities, t.meta).withColumn("route", F.lit("layout"))
    )


@query("merge_results", """SELECT doc_id, arg_max(quality, gen) AS quality FROM (
    SELECT doc_id, quality, 0 AS gen FROM labels UNION ALL SELECT doc_id, (n_chars % 2)::INT, 1 FROM documents WHERE doc_id % 4 = 1) GROUP BY doc_id""")
def merge_results(t):
    old = t.raw("labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    new = t.raw("documents").where("doc_id % 4 = 1").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return A.merge_results(old, new, ["doc_id"])


# ---- layout -----------------------------------------------------------------

@query("float_regions", with_ctes("float_area", """SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY el_ord) - 1)::INT AS float_ord,
    l::INT AS "left", t::INT AS top, b::INT AS bottom FROM float_area"""))
def float_regions(t):
    return L.float_regions(t.layout)


@query("layout_paragraphs", with_ctes("layout_box", "SELECT * FROM layout_box"))
def layout_paragraphs(t):
    return L.layout_to_paragraphs(t.layout)


@query("layout_paragraph_rows", with_ctes("layout_box", "SELECT * FROM layout_box"))
def layout_paragraph_rows(t):
    """The same paragraphs from one row per element, by the interval join."""
    return L.element_rows_to_paragraphs(t.layout_elements)


@query("visible_elements", with_ctes("element", """SELECT page_id, el_ord, tag, cls, text,
    CASE WHEN el_ord % 6 = 0 THEN 0 ELSE len(list_filter(range(1 + length(text) // 120), lambda j: least(900, 5 * length(text)) - j * 15 > 3)) END::INT AS n_lines
    FROM element WHERE bx2 > bx1 AND by2 > by1 AND (length(regexp_replace(text, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+', '', 'g')) > 0 OR tag IN ('IMG', 'FIGURE'))"""))
def visible_elements(t):
    return L.visible_elements(t.layout_elements).select("page_id", "el_ord", "tag", "cls", "text", F.size("line_rects").alias("n_lines"))


@query("clean_text", with_ctes("cleaned", """SELECT page_id, el_ord, clean FROM (SELECT page_id, el_ord,
    trim(regexp_replace(regexp_replace(regexp_replace('.mw-parser-output .x{a:b}' || text || ' @media print{.y{c:d}} end', '\\.mw-parser-output[^{]*\\{[^}]*\\}', ' ', 'g'),
        '@media[^{]*\\{[^{}]*(?:\\{[^}]*\\}[^{}]*)*\\}', ' ', 'g'), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+', ' ', 'g')) AS clean FROM element)"""))
def clean_text(t):
    noisy = F.concat(F.lit(".mw-parser-output .x{a:b}"), "text", F.lit(" @media print{.y{c:d}} end"))
    return t.layout_elements.select("page_id", "el_ord", T.clean_text(noisy).alias("clean"))


@query("text_locate", with_ctes(["element", "known"], """, tgt AS (SELECT page_id, el_ord AS sid, trim(text) AS sent FROM element),
    txt AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY el_ord) - 1 AS ord FROM element WHERE tag IN ('P', 'TD', 'TH', 'LI', 'DD', 'DT', 'CAPTION', 'FIGCAPTION')),
    num AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY el_ord) - 1 AS ord FROM element WHERE tag IN ('P', 'TD', 'TH', 'LI', 'DD', 'DT', 'CAPTION')
        AND length(regexp_replace(text, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+', '', 'g')) > 0),
    hit AS (SELECT g.page_id, g.sid, x.bx1, x.by1, x.bx2, x.by2 FROM tgt g JOIN txt x ON x.page_id = g.page_id AND length(g.sent) > 0
        AND x.bx2 - x.bx1 > 50 AND x.by2 - x.by1 > 5 AND contains(x.text, replace(g.sent, chr(10), ' '))
        QUALIFY row_number() OVER (PARTITION BY g.page_id, g.sid ORDER BY x.ord) = 1)
    SELECT page_id, sid, b1 || ' ' || b2 || ' ' || b3 || ' ' || b4 AS box, by_text FROM (
    SELECT g.page_id, g.sid::INT AS sid, coalesce(h.bx1, n.bx1) AS b1, coalesce(h.by1, n.by1) AS b2, coalesce(h.bx2, n.bx2) AS b3, coalesce(h.by2, n.by2) AS b4, h.page_id IS NOT NULL AS by_text
    FROM tgt g LEFT JOIN hit h ON h.page_id = g.page_id AND h.sid = g.sid LEFT JOIN num n ON n.page_id = g.page_id AND n.ord = g.sid)
    WHERE b3 - b1 > 0 AND b4 - b2 > 0"""))
def text_locate(t):
    """Every element of a page, looked up by its text."""
    wanted = t.layout_elements.select("page_id", F.col("el_ord").alias("sid"), F.trim("text").alias("sent"))
    return L.locate_sentences(wanted, t.layout).withColumn("box", box_text(F.col("box")))


@query("safe_filename", r"""SELECT p_partkey, 'https://en.wikipedia.org/wiki/' || replace(nm, ' ', '_') AS url,
    regexp_replace(nm, '[^\p{L}\p{N}._-]', '_', 'g') || '_' || substring(md5(nm), 1, 8) AS file
    FROM (SELECT p_partkey, p_name || ' é/' || p_brand || repeat('-x', (p_partkey % 50)::INT) AS nm FROM part)""")
def safe_filename(t):
    parts = t.raw("part").selectExpr("p_partkey", "concat(p_name, ' é/', p_brand, repeat('-x', CAST(p_partkey % 50 AS INT))) AS nm")
    return parts.select("p_partkey", T.entity_url(F.col("nm")).alias("url"), T.safe_filename(F.col("nm")).alias("file"))


# ---- grounding --------------------------------------------------------------

@query("similarity_parts", with_ctes("pair_sim", "SELECT page_id, sid, para_ord, round(f1, 6) AS token_f1, round(CASE WHEN c > 0 THEN gr ELSE 0 END, 6) AS gram_recall FROM pair_sim"))
def similarity_parts(t):
    scored = G.page_similarities(_targets(t).where("sent IS NOT NULL"), t.paragraphs)
    return scored.select("page_id", "sid", "para_ord", F.round("token_f1", 6).alias("token_f1"), F.round("gram_recall", 6).alias("gram_recall"))


@query("ground_sentences", with_ctes("grounded", "SELECT page_id, sid, para_ord, x1, y1, x2, y2, round(sim, 6) AS similarity FROM grounded"))
def ground_sentences(t):
    return _grounded(t).withColumn("similarity", F.round("similarity", 6))


@query("ground_sentences_indexed", with_ctes("grounded", "SELECT page_id, sid, para_ord, x1, y1, x2, y2, round(sim, 6) AS similarity FROM grounded"))
def ground_sentences_indexed(t):
    """The same result with pages above 20 paragraphs going through the inverted index."""
    targets = _targets(t).select("page_id", "sid", "sent")
    return G.ground_sentences(targets, t.paragraphs, direct_limit=20).withColumn("similarity", F.round("similarity", 6))


@query("fallback_paragraph", with_ctes("fallback", "SELECT * FROM fallback"))
def fallback_paragraph(t):
    return G.fallback_boxes(t.paragraphs)


@query("value_in_text", with_ctes("paragraph", """SELECT page_id, para_ord, v AS value, contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || v || ' ') AS has_value,
    contains(lower(text), v) AS has_text FROM paragraph, (VALUES ('the on'), ('of'), ('la')) x(v)"""))
def value_in_text(t):
    asked = t.paragraphs.withColumn("value", F.explode(F.array(F.lit("the on"), F.lit("of"), F.lit("la"))))
    return asked.select(
        "page_id", "para_ord", "value", T.value_in_text(F.col("value"), F.col("text")).alias("has_value"),
        T.contains_ci(F.col("value"), F.col("text")).alias("has_text"),
    )


@query("prefix_join", with_ctes("matched", """SELECT sample_id, hop_pos, entity AS query_entity, chain_entity AS entity, screenshot, sid,
    CASE WHEN value IS NULL THEN 'malformed_triple' WHEN chain_entity IS NULL THEN 'no_chain_entry' END AS early_status FROM matched"""))
def prefix_join(t):
    return G.match_hops(t.hop_samples).select(
        "sample_id", "hop_pos", "query_entity", "entity", "screenshot", F.get("sentence_ids", 0).alias("sid"), "early_status"
    )


@query("resolve_hops", with_ctes("resolved", "SELECT sample_id, hop_pos, question, answer, entity, screenshot, status, para_ord, bbox, round(score, 6) AS score FROM resolved"))
def resolve_hops(t):
    return _resolved(t).select(
        "sample_id", "hop_pos", "question", "answer", "entity", "screenshot", "status", "para_ord",
        box_text(F.col("bbox")).alias("bbox"), F.round("score", 6).alias("score"),
    )


@query("coverage_pick", with_ctes("pick_best", """SELECT md5(value || chr(1) || sent) AS target_id, page_id, para_ord, round(cov, 6) AS coverage, vi AS has_value FROM pick_best WHERE score >= 0.4::DOUBLE"""))
def coverage_pick(t):
    hops = G.match_hops(t.hop_samples).where("early_status IS NULL").withColumn("sid", F.get("sentence_ids", 0))
    asked = hops.join(t.page_of.where("side_table = 'ok'"), "screenshot").join(t.sentences.select("entity", "sid", "sent"), ["entity", "sid"])
    targets = asked.where("sent <> ''").select(
        "page_id", F.md5(F.concat_ws("\u0001", "value", "sent")).alias("target_id"), "value", F.col("sent").alias("text")
    ).dropDuplicates(["page_id", "target_id"])
    pages = t.page_of.where("side_table = 'ok'").select("page_id", "image_height")
    picked = G.pick_paragraphs(targets, t.paragraphs, pages)
    return picked.where("para_ord IS NOT NULL").select("target_id", "page_id", "para_ord", F.round("coverage", 6).alias("coverage"), "has_value")


@query("hop_status_histogram", with_ctes("outcome", """SELECT status, count(*) AS n FROM (SELECT status FROM resolved UNION ALL SELECT status FROM outcome) WHERE status IS NOT NULL GROUP BY status"""))
def hop_status_histogram(t):
    hops = materialize(_resolved(t).select("sample_id", "bbox", "status"), "resolved_hops")  # read twice, resolved once
    return G.status_histogram(hops, G.sample_outcomes(t.hop_samples, hops))


@query("drop_report", with_ctes("outcome", """SELECT count(*) AS n_input, count(*) FILTER (n_hops_kept > 0) AS n_kept, count(*) FILTER (n_hops_kept = 0) AS n_dropped,
    round(100.0::DOUBLE * count(*) FILTER (n_hops_kept = 0) / greatest(1, count(*)), 6) AS dropped_pct FROM outcome"""))
def drop_report(t):
    return G.drop_report(G.sample_outcomes(t.hop_samples, _resolved(t))).withColumn("dropped_pct", F.round("dropped_pct", 6))


@query("strict_filter", with_ctes("outcome", "SELECT sample_id, n_hops_kept, n_hops_total FROM outcome WHERE n_hops_kept > 0 AND n_hops_kept >= n_hops_total"))
def strict_filter(t):
    return G.sample_outcomes(t.hop_samples, _resolved(t), strict=True).where("kept").select("sample_id", "n_hops_kept", "n_hops_total")


@query("expand_single_hop", with_ctes("resolved", """SELECT sample_id, hop_pos, question, answer, answer AS evidence_value, entity, bbox, sid
    FROM resolved WHERE para_ord IS NOT NULL UNION ALL
    SELECT sample_id, chain_pos, 'Question ' || sample_id, o_orderpriority, NULL, entity, '40 ' || 28 * chain_pos || ' 700 ' || (28 * chain_pos + 60), sid
    FROM chain_entry JOIN orders ON o_orderkey = sample_id WHERE sample_id % 13 = 0"""))
def expand_single_hop(t):
    single = G.expand_single_hop(t.hop_samples, _resolved(t))
    e = F.get("evidence_chain", 0)
    return single.select(
        "sample_id", "hop_pos", "question", "answer", "evidence_value", e["entity"].alias("entity"),
        box_text(F.get(e["bboxes"], 0)).alias("bbox"), F.get(e["sentence_ids"], 0).alias("sid"),
    )


@query("pre_expanded", "SELECT bool_and(1 + o_orderkey % 3 = 1) AS pre_expanded FROM orders")
def pre_expanded(t):
    return G.is_single_hop(t.hop_samples)


@query("find_by_value", with_ctes(["sentence", "paragraph"], """, hit AS (SELECT s.page_id, s.sid, p.para_ord, p.x1, p.y1, p.x2, p.y2,
        regexp_extract_all(lower(s.sent), '[a-z0-9]+') AS a, regexp_extract_all(lower(p.text), '[a-z0-9]+') AS b
        FROM sentence s JOIN paragraph p ON p.page_id = s.page_id AND p.x2 - p.x1 >= 100 AND p.y2 - p.y1 >= 5 AND contains(lower(p.text), lower(split_part(s.sent, ' ', 1)))),
    cnt AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda u: u = t)), len(list_filter(b, lambda u: u = t))))), 0)::DOUBLE AS c FROM hit),
    f AS (SELECT *, CASE WHEN c > 0 THEN 2 * (c / len(b)) * (c / len(a)) / (c / len(b) + c / len(a)) ELSE 0::DOUBLE END AS f1 FROM cnt)
    SELECT page_id, sid AS target_id, para_ord, x1, y1, x2, y2, round(f1, 6) AS f1 FROM f
    QUALIFY row_number() OVER (PARTITION BY page_id, sid ORDER BY f1 DESC, x2 - x1 DESC, y1, para_ord) = 1"""))
def find_by_value(t):
    """Every sentence of each page, looked up by its first word."""
    targets = t.sentences.select(
        "page_id", F.col("sid").alias("target_id"), F.substring_index("sent", " ", 1).alias("value"), F.col("sent").alias("text")
    )
    return G.find_by_value(targets, t.paragraphs).withColumn("f1", F.round("f1", 6))


@query("box_contains_value", with_ctes("paragraph", """SELECT page_id, para_ord AS target_id, CASE WHEN para_ord % 4 = 3 THEN TRUE ELSE contains(lower(text), 'the') END AS ok FROM paragraph"""))
def box_contains_value(t):
    """Every paragraph box asked for one word; a quarter of the boxes is moved and hence unknown."""
    moved = F.when(F.col("para_ord") % 4 == 3, F.col("x1") - 1000).otherwise(F.col("x1"))
    targets = t.paragraphs.select(
        "page_id", F.col("para_ord").alias("target_id"), F.lit("the").alias("value"), moved.alias("x1"), "y1", "x2", "y2"
    )
    return G.box_contains_value(targets, t.paragraphs)


# ---- assembly ---------------------------------------------------------------

def _chain_text(df):
    hop = lambda e: F.concat_ws(
        "|", e["entity"], F.array_join(e["sentence_ids"].cast("array<string>"), ","),
        F.array_join(F.transform(e["bboxes"], box_text), ";"),
    )
    return df.withColumn("chain", F.array_join(F.transform("evidence_chain", hop), "/"))


@query("assemble_samples", with_ctes(["assembled", "question"], "SELECT a.sample_id, q.question, q.answer, q.type, a.num_hops, a.chain FROM assembled a JOIN question q ON q.sample_id = a.sample_id WHERE a.valid"))
def assemble_samples(t):
    """Only samples that pass validation leave the assembly."""
    return _chain_text(A.samples_within_pages(_assembled(t))).select("sample_id", "question", "answer", "type", "num_hops", "chain")


@query("sample_qa", with_ctes("assembled", "SELECT sample_id, valid FROM assembled"))
def sample_qa(t):
    return A.check_samples(_assembled(t), t.meta)


@query("flatten_resolved", with_ctes("resolved", """SELECT r.sample_id, hop_pos, question, answer, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, '') AS type, entity, screenshot, bbox
    FROM resolved r JOIN orders ON o_orderkey = r.sample_id WHERE para_ord IS NOT NULL"""))
def flatten_resolved(t):
    flat = A.flatten_resolved(t.hop_samples, _resolved(t))
    e = F.get("evidence_chain", 0)
    return flat.select(
        "sample_id", F.col("hop_pos").cast("int").alias("hop_pos"), "question", "answer", "type",
        e["entity"].alias("entity"), e["screenshot"].alias("screenshot"), box_text(F.get(e["bboxes"], 0)).alias("bbox"),
    )


RECONCILED = """, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, entity ORDER BY hop_pos) AS nth FROM resolved WHERE para_ord IS NOT NULL),
    m AS (SELECT c.sample_id, c.chain_pos, c.entity, r.bbox, r.question, '40 ' || 28 * c.chain_pos || ' 700 ' || (28 * c.chain_pos + 60) AS old_box, c.sub_query
        FROM chain_entry c LEFT JOIN r ON r.sample_id = c.sample_id AND r.entity = c.entity AND r.nth = 1),
    s AS (SELECT sample_id, CASE WHEN sample_id NOT IN (SELECT sample_id FROM resolved WHERE para_ord IS NOT NULL) THEN 'no_resolved' WHEN count(bbox) < count(*) THEN 'missing_hop'
        WHEN bool_and(bbox = old_box) THEN 'same' ELSE 'changed' END AS status, count(*)::BIGINT AS n_hops,
        string_agg(entity || '|' || coalesce(bbox, '') || '|' || coalesce(question, ''), '/' ORDER BY chain_pos) AS chain FROM m GROUP BY sample_id)"""


def _reconciled(t):
    resolved = _resolved(t).where("bbox IS NOT NULL")
    return A.reconcile_chain(t.hop_samples, resolved)


@query("reconcile_chain", with_ctes(["resolved", "chain_entry"], RECONCILED + " SELECT sample_id, chain FROM s WHERE status IN ('same', 'changed')"))
def reconcile_chain(t):
    hop = lambda e: F.concat_ws("|", e["entity"], box_text(F.get(e["bboxes"], 0)), e["sub_query"])
    kept = _reconciled(t).where("status IN ('same', 'changed')")
    return kept.select("sample_id", F.array_join(F.transform("evidence_chain", hop), "/").alias("chain"))


@query("reconcile_report", with_ctes(["resolved", "chain_entry"], RECONCILED + " SELECT status, count(*) AS n, sum(n_hops)::BIGINT AS n_hops, sum(CASE WHEN status IN ('changed', 'same') THEN n_hops ELSE 0 END)::BIGINT AS n_hops_after FROM s GROUP BY status"))
def reconcile_report(t):
    return A.reconcile_report(_reconciled(t))


@query("hop_distribution", "SELECT (1 + o_orderkey % 3)::INT AS num_hops, count(*) AS n FROM orders GROUP BY 1")
def hop_distribution(t):
    return A.hop_distribution(t.hop_samples)


@query("unresolved_count", with_ctes("outcome", "SELECT count(*) AS n_dropped FROM outcome WHERE n_hops_kept = 0"))
def unresolved_count(t):
    return A.unresolved_count(t.hop_samples, _resolved(t).where("bbox IS NOT NULL"))
