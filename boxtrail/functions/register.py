"""Selected functions and table functions as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from boxtrail.functions.parsing import JSON_PIECES, NUMBER_WORDS
from boxtrail.functions.text import ARTICLES, WS


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPACES, _ARTICLE = _literal(WS + "+"), _literal(ARTICLES)
_LISTED = "try_variant_get(try_parse_json(concat('[', t, ']')), '$', 'array<variant>')"
_WORDS = " ".join(f"WHEN '{word}' THEN '\"\\\\u0000{spelling}\"'" for word, spelling in NUMBER_WORDS.items())
_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\\\]^_`{|}~"
_BOX_AREA = "greatest(0, {b}[2] - {b}[0]) * greatest(0, {b}[3] - {b}[1])"
_OVERLAP = (
    "greatest(0, least(p[2], g[2]) - greatest(p[0], g[0])) * greatest(0, least(p[3], g[3]) - greatest(p[1], g[1]))"
)

FUNCTIONS = {
    "bt_normalize_train(s STRING) RETURNS STRING": (
        "trim(regexp_replace(regexp_replace(translate(lower(coalesce(s, '')), '" + _PUNCT + "', ''), "
        f"{_ARTICLE}, ' '), {_SPACES}, ' '))"
    ),
    "bt_normalize_paper(s STRING) RETURNS STRING": (
        f"trim(regexp_replace(translate(regexp_replace(lower(s), {_ARTICLE}, ' '), '" + _PUNCT
        + f"', ''), {_SPACES}, ' '))"
    ),
    "bt_answer_em(p STRING, g STRING) RETURNS INT": "int(bt_normalize_train(p) = bt_normalize_train(g))",
    "bt_iou(p ARRAY<DOUBLE>, g ARRAY<DOUBLE>) RETURNS DOUBLE": (
        f"coalesce(try_divide({_OVERLAP}, {_BOX_AREA.format(b='p')} + {_BOX_AREA.format(b='g')} - {_OVERLAP}), 0D)"
    ),
    "bt_center_inside(p ARRAY<DOUBLE>, g ARRAY<DOUBLE>) RETURNS BOOLEAN": (
        "(p[0] + p[2]) / 2 BETWEEN g[0] AND g[2] AND (p[1] + p[3]) / 2 BETWEEN g[1] AND g[3]"
    ),
    "bt_match(p ARRAY<DOUBLE>, g ARRAY<DOUBLE>) RETURNS BOOLEAN": "bt_iou(p, g) >= 0.3 OR bt_center_inside(p, g)",
    "bt_plain_json(t STRING) RETURNS VARIANT": (
        "CASE WHEN startswith(ltrim(t), '{') THEN try_parse_json(t) ELSE coalesce("
        f"CASE WHEN try_parse_json(concat('{{\"v\":', t, '}}')) IS NOT NULL AND size({_LISTED}) = 1 THEN get({_LISTED}, 0) END, "
        "try_parse_json(nullif(regexp_extract(t, '(?s)\\\\{.*\\\\}', 0), ''))) END"
    ),
    "bt_parse(t STRING) RETURNS VARIANT": (
        "CASE WHEN contains(t, 'NaN') OR contains(t, 'Infinity') THEN bt_plain_json(array_join(transform("
        f"regexp_extract_all(t, {_literal(JSON_PIECES)}, 0), x -> CASE x {_WORDS} ELSE x END), '')) ELSE bt_plain_json(t) END"
    ),
}


_CHAIN = "chain ARRAY<STRUCT<entity STRING, screenshot STRING, bboxes ARRAY<ARRAY<INT>>, sentence_ids ARRAY<INT>>>"

# For lateral joins: one row per hop, per box, and per single-hop sample of a chain.
TABLE_FUNCTIONS = {
    "bt_hops(chain ARRAY<STRUCT<hop INT, image_id STRING, bboxes ARRAY<ARRAY<DOUBLE>>>>) "
    "RETURNS TABLE(hop_pos INT, hop INT, image_id STRING, bboxes ARRAY<ARRAY<DOUBLE>>)": (
        "SELECT pos, coalesce(e.hop, pos + 1), e.image_id, e.bboxes FROM posexplode(chain) AS t(pos, e)"
    ),
    "bt_boxes(boxes ARRAY<ARRAY<DOUBLE>>) RETURNS TABLE(box_ord INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)": (
        "SELECT pos, b[0], b[1], b[2], b[3] FROM posexplode(filter(boxes, x -> size(x) = 4)) AS t(pos, b)"
    ),
    f"bt_expand({_CHAIN}) RETURNS TABLE(hop_pos INT, evidence_chain ARRAY<STRUCT<entity STRING, screenshot STRING, "
    "bboxes ARRAY<ARRAY<INT>>, sentence_ids ARRAY<INT>>>)": "SELECT pos, array(e) FROM posexplode(chain) AS t(pos, e)",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for signature, body in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in (*FUNCTIONS, *TABLE_FUNCTIONS)]
