"""SQL building blocks (DuckDB dialect) for the oracle queries."""

from __future__ import annotations

from boxtrail.functions.text import STOPWORDS

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOPWORDS)) + "]"
NEWLINE = "chr(10)"

CTES = {
    "paragraph": """SELECT page_id, para_ord, text, 40 + (para_ord % 3) * 20 AS x1, 28 * para_ord AS y1,
        40 + (para_ord % 3) * 20 + least(960, 6 * length(text)) AS x2, 28 * para_ord + 3 + least(length(text), 780) AS y2
        FROM (SELECT doc_id AS page_id, unnest(range(len(string_split(text, chr(10)))))::INT AS para_ord,
            unnest(string_split(text, chr(10))) AS text FROM documents) WHERE length(trim(text)) > 0""",
    "sentence": """SELECT doc_id AS page_id, 'Entity_' || doc_id AS entity,
        unnest(range(len(string_split(replace(text, chr(10), ' '), '. '))))::INT AS sid,
        unnest(string_split(replace(text, chr(10), ' '), '. ')) AS sent FROM documents""",
    "meta": """SELECT 'Entity_' || doc_id AS entity, doc_id AS page_id, 'shot_' || doc_id || '.png' AS screenshot,
        doc_id % 5 <> 0 AS cached, (1100 + doc_id % 7 * 50)::INT AS width, (3000 + n_chars % 9000)::INT AS height FROM documents""",
    "fact": """SELECT l_orderkey AS sample_id, l_linenumber * 1000000000::BIGINT + l_partkey AS fact_pos,
        'Entity_' || l_partkey AS entity, l_linenumber - 1 AS sid FROM lineitem""",
    "known": "SELECT f.* FROM fact f SEMI JOIN meta m ON f.entity = m.entity",
    # Sentences that are cited at least once, with their text.
    "target": """SELECT DISTINCT k.entity, k.sid, m.page_id, s.sent FROM known k JOIN meta m ON m.entity = k.entity
        LEFT JOIN sentence s ON s.entity = k.entity AND s.sid = k.sid""",
    "sent_feat": """SELECT page_id, sid, tx, regexp_extract_all(lower(tx), '[a-z0-9]+') AS st,
        list_distinct(list_transform(range(1, length(tx) - 2), lambda i: substring(lower(tx), i, 4))) AS sg
        FROM (SELECT page_id, sid, regexp_replace(sent, '^[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+|[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+$', '', 'g') AS tx FROM target)
        WHERE length(tx) > 0""",
    "para_feat": """SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS pt, lower(text) AS pl FROM paragraph
        WHERE x2 - x1 >= 50 AND y2 - y1 >= 5""",
    "pair": """SELECT s.page_id, s.sid, p.para_ord, x1, y1, x2, y2, len(st) AS ns, len(pt) AS np, sg, pl,
        coalesce(list_sum(list_transform(list_distinct(st), lambda t: least(len(list_filter(st, lambda u: u = t)), len(list_filter(pt, lambda u: u = t))))), 0)::DOUBLE AS c
        FROM sent_feat s JOIN para_feat p ON s.page_id = p.page_id""",
    "pair_sim": """SELECT page_id, sid, para_ord, x1, y1, x2, y2,
        CASE WHEN c > 0 THEN 2 * (c / np) * (c / ns) / (c / np + c / ns) ELSE 0::DOUBLE END AS f1,
        CASE WHEN c > 0 AND len(sg) > 0 THEN len(list_filter(sg, lambda g: contains(pl, g)))::DOUBLE / len(sg) ELSE 0::DOUBLE END AS gr, c
        FROM pair""",
    "scored_pair": """SELECT *, CASE WHEN c > 0 THEN 0.6::DOUBLE * f1 + 0.4::DOUBLE * gr ELSE 0::DOUBLE END AS sim FROM pair_sim""",
    "fallback": """SELECT page_id, para_ord, x1, y1, x2, y2 FROM paragraph WHERE x2 - x1 >= 200 AND length(text) > 50
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY para_ord) = 1""",
    "grounded": """SELECT page_id, sid, para_ord, x1, y1, x2, y2, sim FROM (SELECT * FROM scored_pair WHERE sim >= 0.25::DOUBLE
        QUALIFY row_number() OVER (PARTITION BY page_id, sid ORDER BY sim DESC, x2 - x1 DESC, para_ord) = 1)
        UNION ALL SELECT t.page_id, t.sid, f.para_ord, f.x1, f.y1, f.x2, f.y2, NULL FROM target t JOIN fallback f ON t.page_id = f.page_id WHERE t.sent IS NULL""",
    "question": """SELECT o_orderkey AS sample_id, 'Which ' || lower(o_orderpriority) || ' item belongs to customer ' || o_custkey || '?' AS question,
        'The ' || o_orderpriority || ' order' AS answer, o_orderstatus AS type FROM orders""",
    "placed": """SELECT k.sample_id, k.entity, k.fact_pos, k.sid, m.screenshot, m.width, m.height, g.x1, g.y1, g.x2, g.y2
        FROM known k JOIN meta m ON m.entity = k.entity LEFT JOIN grounded g ON g.page_id = m.page_id AND g.sid = k.sid""",
    "hop": """SELECT sample_id, entity, min(fact_pos) AS pos, any_value(screenshot) AS screenshot, any_value(width) AS width, any_value(height) AS height,
        count(x1) AS n_boxes, string_agg(sid::VARCHAR, ',' ORDER BY fact_pos) AS sids,
        coalesce(string_agg(x1 || ' ' || y1 || ' ' || x2 || ' ' || y2, ';' ORDER BY fact_pos), '') AS boxes,
        bool_and(x1 IS NULL OR (x1 >= 0 AND y1 >= 0 AND x2 <= width AND y2 <= height)) AS inside
        FROM placed GROUP BY sample_id, entity""",
    "assembled": """SELECT sample_id, count(*)::INT AS num_hops, string_agg(entity || '|' || sids || '|' || boxes, '/' ORDER BY pos) AS chain,
        bool_and(inside) AS valid FROM hop GROUP BY sample_id HAVING min(n_boxes) > 0""",
    "element_raw": """SELECT page_id, regexp_extract_all(html, '<(p|li|td|h1|div|b|span)([^>]*)>([^<]*)', 1) AS t,
        regexp_extract_all(html, '<(p|li|td|h1|div|b|span)([^>]*)>([^<]*)', 3) AS s FROM pages""",
    "element": """SELECT page_id, i::INT AS el_ord, upper(tag) AS tag, text,
        CASE WHEN i % 17 = 5 THEN 'Infobox vcard' WHEN i % 23 = 7 THEN 'thumb tright' ELSE '' END AS cls,
        CASE WHEN i % 19 = 3 THEN 'right' ELSE 'none' END AS float_side, fl,
        CASE WHEN fl THEN 600 + (i % 7) * 20 ELSE 30 + (i % 5) * 10 END AS bx1, i * 40 AS by1,
        CASE WHEN fl THEN 600 + (i % 7) * 20 + 300 ELSE 30 + (i % 5) * 10 + least(900, 5 * length(text)) END AS bx2,
        i * 40 + CASE WHEN fl THEN 100 + i % 300 ELSE 10 + length(text) % 900 END AS by2
        FROM (SELECT *, (i % 17 = 5 OR i % 19 = 3 OR i % 23 = 7) AS fl FROM (
            SELECT page_id, unnest(range(len(t))) AS i, unnest(t) AS tag, unnest(s) AS text FROM element_raw))""",
    "cleaned": """SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\.mw-parser-output[^{]*\\{[^}]*\\}', ' ', 'g'),
        '@media[^{]*\\{[^{}]*(?:\\{[^}]*\\}[^{}]*)*\\}', ' ', 'g'), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+', ' ', 'g')) AS clean FROM element""",
    "float_area": "SELECT page_id, el_ord, bx1 - 10 AS l, by1 AS t, by2 AS b FROM element WHERE fl AND bx2 - bx1 > 50 AND by2 - by1 > 20",
    "line": """SELECT page_id, el_ord, clean, j, CASE WHEN el_ord % 6 = 0 THEN by1 ELSE el_ord * 40 + j * 18 END AS y1, bx1 AS x1,
        CASE WHEN el_ord % 6 = 0 THEN bx2 ELSE bx1 + least(900, 5 * length(text)) - j * 15 END AS x2,
        CASE WHEN el_ord % 6 = 0 THEN by2 ELSE el_ord * 40 + j * 18 + 16 END AS y2
        FROM (SELECT *, unnest(range(CASE WHEN el_ord % 6 = 0 THEN 1 ELSE 1 + length(text) // 120 END)) AS j FROM cleaned
            WHERE tag IN ('P', 'TD', 'TH', 'LI', 'DD', 'DT', 'CAPTION', 'FIGCAPTION') AND length(clean) > 0)""",
    "clipped": """SELECT n.page_id, n.el_ord, any_value(clean) AS clean, n.x1, n.y1, n.y2, least(n.x2, coalesce(min(f.l), n.x2)) AS x2
        FROM line n LEFT JOIN float_area f ON n.page_id = f.page_id AND n.y2 > f.t AND n.y1 < f.b
        GROUP BY n.page_id, n.el_ord, n.j, n.x1, n.y1, n.x2, n.y2""",
    "layout_box": """SELECT * FROM (SELECT page_id, el_ord AS para_ord, any_value(clean) AS text,
        min(x1)::INT AS x1, min(y1)::INT AS y1, max(x2)::INT AS x2, max(y2)::INT AS y2 FROM clipped WHERE x2 > x1 GROUP BY page_id, el_ord)
        WHERE x2 - x1 > 30 AND y2 - y1 > 5""",
    # ---- hop samples --------------------------------------------------------
    "hop_index": "SELECT *, unnest(range(1 + o_orderkey % 3)) AS i FROM orders",
    "chain_entry": """SELECT o_orderkey AS sample_id, i::INT AS chain_pos, 'Entity_' || (o_custkey + 37 * i) AS entity, o_custkey + 37 * i AS doc,
        'shot_' || (o_custkey + 37 * i) || '.png' AS screenshot, ((o_orderkey + i) % 9)::INT AS sid,
        CASE (o_orderkey + i) % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'given' END AS sub_query FROM hop_index""",
    "triple": """SELECT o_orderkey AS sample_id, i::INT AS hop_pos,
        CASE (o_orderkey + i) % 7 WHEN 3 THEN 'Entity_' || (o_custkey + 37 * i) || ' (page)' WHEN 5 THEN 'Nobody' ELSE 'Entity_' || (o_custkey + 37 * i) END AS entity,
        CASE WHEN (o_custkey + i) % 10 <> 7 THEN (['date_of_birth', 'place_of_death', 'director'])[i + 1] END AS relation,
        CASE WHEN (o_custkey + i) % 10 <> 7 THEN coalesce((['the on', 'of', 'la', 'und', 'that and', NULL])[o_custkey % 6 + 1], 'None') END AS value FROM hop_index WHERE o_orderkey % 13 <> 0""",
    "page_of": """SELECT doc_id AS page_id, 'shot_' || doc_id || '.png' AS screenshot,
        CASE WHEN doc_id % 11 <> 0 THEN (300 + n_chars % 3000)::INT END AS image_height,
        CASE WHEN doc_id % 29 = 0 THEN 'bad' ELSE 'ok' END AS side_table FROM documents""",
    "matched": """SELECT t.*, c.entity AS chain_entity, c.screenshot, c.sid, c.chain_pos FROM triple t LEFT JOIN chain_entry c
        ON t.sample_id = c.sample_id AND t.value IS NOT NULL AND (starts_with(c.entity, t.entity) OR starts_with(t.entity, c.entity))
        QUALIFY row_number() OVER (PARTITION BY t.sample_id, t.hop_pos ORDER BY c.entity = t.entity DESC NULLS LAST, c.chain_pos) = 1""",
    "asked": """SELECT m.*, p.page_id, p.image_height, s.sent,
        CASE WHEN m.value IS NULL THEN 'malformed_triple' WHEN m.chain_entity IS NULL THEN 'no_chain_entry'
            WHEN p.page_id IS NULL THEN 'no_bboxes_file' WHEN p.side_table = 'bad' THEN 'bad_bboxes_file'
            WHEN coalesce(s.sent, '') = '' THEN 'no_target_sent' END AS early
        FROM matched m LEFT JOIN page_of p ON p.screenshot = m.screenshot LEFT JOIN sentence s ON s.entity = m.chain_entity AND s.sid = m.sid""",
    "pick_para": f"""SELECT *, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda w: NOT list_contains({STOP_SQL}, w))) AS pc,
        ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS pw,
        len(regexp_extract_all(text, '[^\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+')) AS words
        FROM (SELECT q.*, o.image_height, coalesce(q.y2 > o.image_height, FALSE) AS oob FROM paragraph q JOIN page_of o ON o.page_id = q.page_id
            WHERE o.side_table = 'ok' AND q.x2 - q.x1 >= 80 AND q.y2 - q.y1 >= 5)""",
    "pick_stat": "SELECT page_id, count(*) FILTER (NOT oob AND words >= 8) AS n_usable, count(*) FILTER (oob) AS n_oob FROM pick_para GROUP BY page_id",
    "pick_question": f"""SELECT DISTINCT page_id, value, sent, list_distinct(list_filter(regexp_extract_all(lower(sent), '[a-z0-9]{{2,}}'), lambda w: NOT list_contains({STOP_SQL}, w))) AS tc,
        trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) AS vw FROM asked WHERE early IS NULL""",
    "pick_pair": """SELECT q.page_id, q.value, q.sent, p.para_ord, x1, y1, x2, y2,
        CASE WHEN len(tc) > 0 AND len(pc) > 0 THEN len(list_intersect(tc, pc))::DOUBLE / len(tc) ELSE 0::DOUBLE END AS cov,
        length(vw) > 0 AND contains(pw, ' ' || vw || ' ') AS vi FROM pick_question q JOIN pick_para p ON q.page_id = p.page_id AND NOT oob AND words >= 8""",
    "pick_best": """SELECT *, cov + CASE WHEN vi THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS score FROM pick_pair
        QUALIFY row_number() OVER (PARTITION BY page_id, value, sent ORDER BY score DESC, cov DESC, y1, para_ord) = 1""",
    "resolved": """SELECT a.sample_id, a.hop_pos, 'What is the ' || trim(replace(a.relation, '_', ' ')) || ' of ' || a.entity || '?' AS question,
        a.value AS answer, a.chain_entity AS entity, a.screenshot, a.sid, a.sent, a.chain_pos,
        CASE WHEN a.early IS NOT NULL THEN a.early
            WHEN coalesce(s.n_usable, 0) = 0 THEN 'no_candidates' || CASE WHEN coalesce(s.n_oob, 0) > 0 THEN '_oob' ELSE '' END
            WHEN b.score < 0.4::DOUBLE THEN 'below_threshold' || CASE WHEN s.n_oob > 0 THEN '_oob' ELSE '' END
            WHEN b.vi THEN 'val_match' ELSE 'sim_only' END AS status,
        CASE WHEN a.early IS NULL AND b.score >= 0.4::DOUBLE THEN b.para_ord END AS para_ord,
        CASE WHEN a.early IS NULL AND b.score >= 0.4::DOUBLE THEN b.x1 || ' ' || b.y1 || ' ' || b.x2 || ' ' || b.y2 END AS bbox,
        CASE WHEN a.early IS NULL AND b.score >= 0.4::DOUBLE THEN b.score END AS score
        FROM asked a LEFT JOIN pick_stat s ON s.page_id = a.page_id
        LEFT JOIN pick_best b ON b.page_id = a.page_id AND b.value = a.value AND b.sent = a.sent""",
    "outcome": """SELECT q.sample_id, coalesce(r.kept, 0) AS n_hops_kept, coalesce(r.total, 0) AS n_hops_total,
        CASE WHEN r.total IS NULL THEN 'no_evidence_or_chain' WHEN r.kept = 0 THEN 'sample_dropped_all_hops_oob'
            WHEN r.kept < r.total THEN 'sample_partial_hops_dropped' END AS status
        FROM (SELECT o_orderkey AS sample_id FROM orders) q
        LEFT JOIN (SELECT sample_id, count(*) AS total, count(para_ord) AS kept FROM resolved GROUP BY 1) r ON r.sample_id = q.sample_id""",
    # ---- decks --------------------------------------------------------------
    "deck_image": """SELECT p_partkey, 'img/' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '__page_' ELSE '_page_' END ||
        CASE WHEN p_partkey % 50 = 7 THEN 'x' || p_partkey ELSE (p_partkey // 3)::VARCHAR END || '.' || p_partkey % 3 || '.png' AS path,
        p_type AS deck, CASE WHEN p_partkey % 50 <> 7 THEN p_partkey // 3 END AS page, 800 + p_size * 20 AS width, 600 + p_retailprice::INT AS height FROM part""",
    "cited": """SELECT l_orderkey AS sample_id, l_linenumber AS pos, l_partkey AS p_partkey FROM lineitem""",
    "deck_gold": """SELECT sample_id, list(path ORDER BY pos, path) AS gold, list(page ORDER BY pos, path) FILTER (page IS NOT NULL) AS pages, arg_min(deck, (pos, path)) AS deck
        FROM (SELECT sample_id, min(pos) AS pos, p_partkey FROM cited GROUP BY 1, 3) JOIN deck_image USING (p_partkey) GROUP BY sample_id""",
    # ---- predictions --------------------------------------------------------
    "chain_raw": """SELECT o_orderkey AS idx, o_orderkey AS k, o_custkey AS c, o_orderstatus AS type, 'The ' || o_orderpriority || ' order' AS answer,
        CASE o_custkey % 4 WHEN 0 THEN 'other thing' WHEN 1 THEN 'a ' || o_orderpriority || ' order!' WHEN 2 THEN 'It is the ' || o_orderpriority || ' order.'
            ELSE 'The ' || o_orderpriority || ' order' END AS pred_answer,
        1 + o_orderkey % 3 AS n, 1 + o_orderkey % 3 - CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS m, o_orderkey % 6 <> 5 AS enabled FROM orders""",
    "chains": """SELECT *, list_transform(range(n), lambda i: {'image_id': CASE WHEN (k + i) % 11 = 0 THEN '' ELSE 'img_' || (k + i) % 5 END,
            'bboxes': list_transform(range(CASE WHEN (k + 2 * i) % 13 = 0 THEN 0 ELSE 1 + (k + i) % 2 END), lambda j: [
                (k * 7 + i * 31 + j * 101) % 900, (c * 5 + i * 17 + j * 53) % 700,
                (k * 7 + i * 31 + j * 101) % 900 + 40 + k % 60, (c * 5 + i * 17 + j * 53) % 700 + 30 + c % 50]::DOUBLE[])}) AS gold,
        list_transform(range(m), lambda i: {'hop': i + 1, 'image_id': CASE WHEN (c + i) % 6 = 0 THEN 'img_9' WHEN (k + i) % 11 = 0 THEN '' ELSE 'img_' || (k + i) % 5 END,
            'bboxes': list_transform(range(CASE WHEN (k + 2 * i) % 13 = 0 THEN 0 ELSE 1 + (k + i) % 2 END + CASE WHEN c % 9 = 0 THEN 1 ELSE 0 END), lambda j: [
                (k * 7 + i * 31 + j * 101) % 900 + (c % 5) * 12, (c * 5 + i * 17 + j * 53) % 700 + (k % 4) * 9,
                (k * 7 + i * 31 + j * 101) % 900 + (c % 5) * 12 + 40 + k % 60, (c * 5 + i * 17 + j * 53) % 700 + (k % 4) * 9 + 30 + c % 50]::DOUBLE[])}) AS pred
        FROM chain_raw""",
    "pred_json": """SELECT *, '{"evidence_chain": [' || coalesce(array_to_string(list_transform(pred, lambda e: '{"hop": ' || e.hop || ', "image_id": "' || e.image_id || '", "bboxes": [' ||
            coalesce(array_to_string(list_transform(e.bboxes, lambda b: '[' || array_to_string(list_transform(b, lambda v: v::INT::VARCHAR), ', ') || ']'), ', '), '') || ']}'), ', '), '') || '], "answer": "' || pred_answer || '"}' AS j,
        '{"bbox": ' || CASE WHEN len(pred) = 0 THEN '' ELSE '[' || coalesce(array_to_string(list_transform(pred[1].bboxes, lambda b: '[' || array_to_string(list_transform(b, lambda v: v::INT::VARCHAR), ', ') || ']'), ', '), '') || ']' END || ', "answer": "' || pred_answer || '"}' AS s
        FROM chains""",
    "prediction": """SELECT *, CASE k % 10 WHEN 3 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 4 THEN 'Sure, see: ' || j WHEN 5 THEN j || ' Done.'
        WHEN 6 THEN substring(j, 1, length(j) - 5) WHEN 7 THEN '' WHEN 8 THEN 'answer: ' || pred_answer WHEN 9 THEN s ELSE j END AS pred_text FROM pred_json""",
    "parsed": """SELECT *, CASE WHEN json_valid(pred_text) THEN pred_text WHEN json_valid(regexp_extract(pred_text, '(?s)\\{.*\\}')) THEN regexp_extract(pred_text, '(?s)\\{.*\\}') END AS v FROM prediction""",
    "lenient": """SELECT *, v ->> '$.answer' AS p_answer,
        CASE WHEN len(top) > 0 THEN [{'hop': 1, 'image_id': coalesce(v ->> '$.image_id', ''), 'bboxes': top}]
            ELSE coalesce(from_json(v -> '$.evidence_chain', '[{"hop":"BIGINT","image_id":"VARCHAR","bboxes":[["DOUBLE"]]}]'), []) END AS chain
        FROM (SELECT *, from_json(v -> '$.bbox', '[["DOUBLE"]]') AS top FROM parsed)""",
}


def norm_train(x: str) -> str:
    """Punctuation, then articles, then blanks (ASCII input)."""
    no_punct = f"regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({no_punct}, '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def norm_paper(x: str) -> str:
    """Articles, then punctuation, then blanks (ASCII input)."""
    bare = f"regexp_replace(lower({x}), '\\b(a|an|the)\\b', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({bare}, '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"


def iou(a: str, b: str) -> str:
    inter = f"(greatest(0, least({a}[3], {b}[3]) - greatest({a}[1], {b}[1])) * greatest(0, least({a}[4], {b}[4]) - greatest({a}[2], {b}[2])))"
    area = lambda x: f"(greatest(0, {x}[3] - {x}[1]) * greatest(0, {x}[4] - {x}[2]))"
    union = f"({area(a)} + {area(b)} - {inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0::DOUBLE END)"


def center(p: str, g: str) -> str:
    return f"(({p}[1] + {p}[3]) / 2 BETWEEN {g}[1] AND {g}[3] AND ({p}[2] + {p}[4]) / 2 BETWEEN {g}[2] AND {g}[4])"


def match(p: str, g: str) -> str:
    return f"({iou(p, g)} >= 0.3::DOUBLE OR {center(p, g)})"


def with_ctes(names: list[str] | str, body: str) -> str:
    """``body`` preceded by the named blocks and everything they refer to, in order."""
    import re

    wanted = [names] if isinstance(names, str) else names
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in CTES:
            if other != name and re.search(rf"\b(FROM|JOIN)\s+{other}\b", CTES[name]):
                add(other)
        order.append(name)

    for n in wanted:
        add(n)
    blocks = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {blocks}\n{body}"
