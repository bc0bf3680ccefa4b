"""Queries over predictions, metrics, logs and the streaming scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.functions import geometry as G, parsing as J, scoring as S, text as T
from boxtrail.operators import evaluation as E, logs as L, records
from boxtrail.plans.registry import query
from boxtrail.plans.sql import center, iou, match, norm_paper, norm_train, with_ctes
from boxtrail.runtime import new_shared_path
from boxtrail.streaming import scorer

R6 = lambda c: F.round(c, 6)

# ---- answers ----------------------------------------------------------------

PAIRS = """SELECT c_custkey AS id, 'The ' || n_name || '-' || c_mktsegment || ', a test!' AS gold, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) || c_mktsegment || ' test'
    WHEN 1 THEN 'an ' || n_name || '-' || c_mktsegment || ' test' WHEN 2 THEN '' ELSE 'test of ' || c_mktsegment || ' the ' || n_name END AS pred FROM customer JOIN nation ON n_nationkey = c_nationkey"""


def _answers(t):
    joined = t.raw("customer").join(t.raw("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.selectExpr(
        "c_custkey AS id", "concat('The ', n_name, '-', c_mktsegment, ', a test!') AS gold",
        "CASE c_custkey % 4 WHEN 0 THEN concat(lower(n_name), c_mktsegment, ' test') WHEN 1 THEN concat('an ', n_name, '-', c_mktsegment, ' test') "
        "WHEN 2 THEN '' ELSE concat('test of ', c_mktsegment, ' the ', n_name) END AS pred",
    )


@query("normalize_em", f"""SELECT id, {norm_paper('gold')} AS gold_paper, {norm_train('gold')} AS gold_train, ({norm_paper('pred')} = {norm_paper('gold')})::INT::DOUBLE AS em_paper,
    ({norm_train('pred')} = {norm_train('gold')})::INT AS em_train, ({norm_train('gold')} <> '' AND contains({norm_train('pred')}, {norm_train('gold')}))::INT AS contains_gold FROM ({PAIRS})""")
def normalize_em(t):
    p, g = F.col("pred"), F.col("gold")
    return _answers(t).select(
        "id", T.normalize_paper(g).alias("gold_paper"), T.normalize_train(g).alias("gold_train"),
        T.exact_match_paper(p, g).alias("em_paper"), T.exact_match_train(p, g).alias("em_train"), T.answer_contains(p, g).alias("contains_gold"),
    )


def sql_f1(pred: str, gold: str, src: str, keep: str) -> str:
    return f"""SELECT {keep}, CASE WHEN p = '' OR g = '' THEN (p = g)::INT::DOUBLE WHEN c = 0 THEN 0::DOUBLE ELSE 2 * (c / len(pt)) * (c / len(gt)) / (c / len(pt) + c / len(gt)) END AS f1 FROM (
    SELECT *, coalesce(list_sum(list_transform(list_distinct(pt), lambda t: least(len(list_filter(pt, lambda u: u = t)), len(list_filter(gt, lambda u: u = t))))), 0)::DOUBLE AS c FROM (
    SELECT *, string_split(p, ' ') AS pt, string_split(g, ' ') AS gt FROM (SELECT *, {norm_paper(pred)} AS p, {norm_paper(gold)} AS g FROM ({src}))))"""


@query("answer_f1", f"SELECT id, round(f1, 6) AS f1 FROM ({sql_f1('pred', 'gold', PAIRS, 'id')})")
def answer_f1(t):
    return _answers(t).select("id", R6(T.answer_f1(F.col("pred"), F.col("gold"))).alias("f1"))


# ---- boxes ------------------------------------------------------------------

BOX_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, [l_partkey % 700, l_suppkey % 60, l_partkey % 700 + 20 + l_quantity, l_suppkey % 60 + 30]::DOUBLE[] AS g,
    [l_partkey % 700 + l_linenumber * 6, l_suppkey % 60 + l_quantity, l_partkey % 700 + l_linenumber * 6 + 40, l_suppkey % 60 + l_quantity + 25]::DOUBLE[] AS p FROM lineitem"""


def _boxes(t):
    return t.raw("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "CAST(array(l_partkey % 700, l_suppkey % 60, l_partkey % 700 + 20 + l_quantity, l_suppkey % 60 + 30) AS ARRAY<DOUBLE>) AS g",
        "CAST(array(l_partkey % 700 + l_linenumber * 6, l_suppkey % 60 + l_quantity, l_partkey % 700 + l_linenumber * 6 + 40, l_suppkey % 60 + l_quantity + 25) AS ARRAY<DOUBLE>) AS p",
    )


@query("iou_match", f"SELECT l_orderkey, l_linenumber, l_partkey, round({iou('p', 'g')}, 6) AS iou, {center('p', 'g')} AS inside, {match('p', 'g')} AS matched FROM ({BOX_SQL})")
def iou_match(t):
    p, g = F.col("p"), F.col("g")
    return _boxes(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", R6(G.iou(p, g)).alias("iou"), G.center_inside(p, g).alias("inside"), G.relaxed_match(p, g).alias("matched")
    )


FLAT = """, flat AS (SELECT *, flatten(list_transform(pred, lambda e: e.bboxes)) AS pb, flatten(list_transform(gold, lambda e: e.bboxes)) AS gb FROM chains)"""


def stat_sql(pb: str, gb: str) -> dict[str, str]:
    gh = f"len(list_filter({gb}, lambda g: len(list_filter({pb}, lambda p: {match('p', 'g')})) > 0))"
    ph = f"len(list_filter({pb}, lambda p: len(list_filter({gb}, lambda g: {match('p', 'g')})) > 0))"
    pick = lambda v, kind: f"(CASE WHEN len({gb}) = 0 AND len({pb}) = 0 THEN 1 WHEN len({gb}) = 0 OR len({pb}) = 0 THEN 0 ELSE {v} END)::{kind}"
    return {
        "recall": pick(f"{gh}::DOUBLE / len({gb})", "DOUBLE"), "precision": pick(f"{ph}::DOUBLE / len({pb})", "DOUBLE"),
        "all_gt_hit": pick(f"({gh} = len({gb}))::INT", "INT"), "any_hit": pick(f"({gh} > 0)::INT", "INT"), "localized": f"(len({gb}) > 0 AND len({pb}) > 0 AND {gh} > 0)::INT",
    }


_S = stat_sql("pb", "gb")


@query("bbox_stats", with_ctes("chains", FLAT + f""" SELECT idx, round({_S['recall']}, 6) AS recall, round({_S['precision']}, 6) AS "precision", {_S['all_gt_hit']} AS all_gt_hit, {_S['any_hit']} AS any_hit,
    len(gb)::INT AS n_gt, len(pb)::INT AS n_pred, {_S['localized']} AS localized FROM flat"""))
def bbox_stats(t):
    flat = t.chains.select("idx", J.flatten_boxes(F.col("pred_chain")).alias("p"), J.flatten_boxes(F.col("evidence_chain")).alias("g"))
    scored = flat.select("idx", S.bbox_stats(F.col("p"), F.col("g")).alias("s"), S.bbox_localized(F.col("p"), F.col("g")).alias("localized"))
    return scored.select(
        "idx", R6("s.recall").alias("recall"), R6("s.precision").alias("precision"), "s.all_gt_hit", "s.any_hit", "s.n_gt", "s.n_pred", "localized"
    )


def best_sql(preds: str, gold: str, taken: str) -> str:
    """Index (1-based) of the best free matching prediction, 0 if none; later wins ties."""
    options = f"list_filter(list_transform({preds}, lambda p, j: {{'v': {iou('p', gold)}, 'j': j, 'm': {match('p', gold)}}}), lambda o: o.m AND o.j <> {taken})"
    return f"coalesce(list_max(list_transform({options}, lambda o: {{'v': o.v, 'j': o.j}})).j, 0)"


# Gold hops carry at most two boxes here, so the greedy choice unrolls to two steps.
HOPS = f""", hp AS (SELECT idx, type, unnest(range(len(gold))) AS i, unnest(gold) AS ge, pred FROM chains),
    hb AS (SELECT idx, type, i, ge.image_id AS gid, coalesce(pred[i + 1].image_id, '') AS pid, ge.bboxes AS gb, coalesce(pred[i + 1].bboxes, []) AS pb FROM hp),
    h1 AS (SELECT *, CASE WHEN len(gb) >= 1 THEN {best_sql('pb', 'gb[1]', '0')} ELSE 0 END AS j1 FROM hb),
    h2 AS (SELECT *, CASE WHEN len(gb) >= 2 THEN {best_sql('pb', 'gb[2]', 'j1')} ELSE 0 END AS j2 FROM h1),
    hop AS (SELECT *, CASE WHEN len(gb) = 0 THEN (len(pb) = 0)::INT::DOUBLE ELSE ((j1 > 0)::INT + (j2 > 0)::INT)::DOUBLE / len(gb) END AS loc, gid = '' OR pid = '' OR gid = pid AS same FROM h2),
    ca AS (SELECT idx, type, sum(CASE WHEN same THEN loc ELSE 0 END) AS hop_acc_sum, count(*) AS n_hops, min((same AND loc = 1)::INT)::DOUBLE AS chain_acc FROM hop GROUP BY idx, type)"""


@query("greedy_loc", with_ctes("chains", HOPS + """ SELECT idx, (i + 1)::INT AS hop, round(loc, 6) AS accuracy FROM hop"""))
def greedy_loc(t):
    hops = t.chains.select("idx", "pred_chain", F.posexplode("evidence_chain").alias("i", "g"))
    none = F.array().cast("array<array<double>>")
    boxes = hops.select("idx", (F.col("i") + 1).alias("hop"), F.coalesce(F.get("pred_chain", F.col("i"))["bboxes"], none).alias("p"), F.col("g.bboxes").alias("b"))
    return boxes.select("idx", "hop", R6(S.greedy_localization(F.col("p"), F.col("b"))["accuracy"]).alias("accuracy"))


@query("chain_accuracy", with_ctes("chains", HOPS + " SELECT idx, round(hop_acc_sum, 6) AS hop_acc_sum, n_hops, chain_acc FROM ca"))
def chain_accuracy(t):
    hops = t.chains.select("idx", S.chain_hops(F.col("pred_chain"), F.col("evidence_chain")).alias("h"))
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x["accuracy"])
    return hops.select("idx", R6(total).alias("hop_acc_sum"), F.size("h").alias("n_hops"), S.chain_correct(F.col("h")).alias("chain_acc"))


def image_sql(pred: str, src: str) -> str:
    """Image metrics per row of ``chains``-like rows with the predicted chain ``pred``."""
    joint = f"len(list_filter({pred}[i].bboxes, lambda p: len(list_filter(e.bboxes, lambda g: {match('p', 'g')})) > 0)) > 0"
    boxed = f"CASE WHEN len(e.bboxes) = 0 THEN coalesce(len({pred}[i].bboxes), 0) = 0 ELSE coalesce({joint}, FALSE) END"
    return f"""SELECT *, len(list_filter(hops, lambda h: h.r)) AS n_right, len(list_filter(hops, lambda h: h.j)) AS n_joint, len(list_intersect(gs, ps)) AS n_shared FROM (
        SELECT *, list_slice(list_transform(gold, lambda e, i: {{'r': e.image_id <> '' AND coalesce({pred}[i].image_id, '') = e.image_id,
            'j': e.image_id <> '' AND coalesce({pred}[i].image_id, '') = e.image_id AND ({boxed})}}), 1, len(gids)) AS hops, list_distinct(gids) AS gs, list_distinct(list_filter(pids, lambda x: x <> '')) AS ps FROM (
        SELECT *, list_filter(list_transform(gold, lambda e: e.image_id), lambda x: x <> '') AS gids, list_transform({pred}, lambda e: e.image_id) AS pids FROM {src}))"""


IMAGE_COLS = {
    "image_hop_acc": "CASE WHEN len(gids) > 0 THEN n_right::DOUBLE / len(gids) ELSE 0::DOUBLE END",
    "image_chain_order_acc": "(len(gids) > 0 AND pids = gids)::INT",
    "gold_image_recall": "CASE WHEN len(gids) > 0 THEN n_shared::DOUBLE / len(gs) ELSE 0::DOUBLE END",
    "gold_image_precision": "CASE WHEN len(gids) > 0 AND len(ps) > 0 THEN n_shared::DOUBLE / len(ps) ELSE 0::DOUBLE END",
    "gold_image_all_hit": "(len(gids) > 0 AND n_shared = len(gs))::INT",
    "image_bbox_joint_recall": "CASE WHEN len(gids) > 0 THEN n_joint::DOUBLE / len(gids) ELSE 0::DOUBLE END",
    "image_bbox_joint_all_gt_hit": "(len(gids) > 0 AND n_joint = len(gids))::INT",
}
FRACTIONS = ("image_hop_acc", "gold_image_recall", "gold_image_precision", "image_bbox_joint_recall")


@query("image_chain_stats", with_ctes("chains", "SELECT idx, (len(gids) > 0)::INT AS valid, " + ", ".join(
    (f"round({v}, 6)" if k in FRACTIONS else v) + f" AS {k}" for k, v in IMAGE_COLS.items()) + f" FROM ({image_sql('pred', 'chains')})"))
def image_chain_stats(t):
    stats = t.chains.select("idx", S.image_chain_stats(F.col("pred_chain"), F.col("evidence_chain")).alias("s"))
    return stats.select("idx", "s.valid", *[(R6(f"s.{m}") if m in FRACTIONS else F.col(f"s.{m}")).alias(m) for m in S.IMAGE_METRICS])


# ---- parsing ----------------------------------------------------------------

@query("lenient_parse", with_ctes("lenient", """SELECT idx, (v IS NOT NULL)::INT AS parse_ok, p_answer AS answer, len(chain)::INT AS n_hops,
    coalesce(array_to_string(list_transform(chain, lambda e: coalesce(e.image_id, '') || ':' || coalesce(array_to_string(list_transform(e.bboxes, lambda b: array_to_string(list_transform(b, lambda x: x::INT::VARCHAR), ' ')), ';'), '')), '/'), '') AS chain FROM lenient"""))
def lenient_parse(t):
    v = F.col("v")
    read = t.predictions.select("idx", J.parse_lenient(F.col("pred_text")).alias("v")).select(
        "idx", J.is_truthy(v).cast("int").alias("parse_ok"), J.scalar_text(F.try_variant_get(v, "$.answer", "variant")).alias("answer"), J.predicted_chain(v).alias("chain")
    )
    boxes = lambda e: F.array_join(F.transform(e["bboxes"], lambda b: F.array_join(b.cast("array<int>").cast("array<string>"), " ")), ";")
    shown = F.array_join(F.transform("chain", lambda e: F.concat(e["image_id"], F.lit(":"), boxes(e))), "/")
    return read.select("idx", "parse_ok", "answer", F.size("chain").alias("n_hops"), shown.alias("chain"))


@query("target_key_violations", with_ctes("prediction", """SELECT idx AS row_id, CASE WHEN idx % 7 = 0 THEN 'no_labels' WHEN idx % 7 = 1 THEN 'not_contiguous' ELSE 'no_target' END AS rule FROM prediction
    WHERE idx % 7 < 2 OR NOT (contains(pred_text, '"answer"') AND contains(pred_text, '"evidence_chain"'))"""))
def target_key_violations(t):
    """Output texts as the decoded supervised part; labels of some rows are empty or in two runs."""
    labels = F.when(F.col("idx") % 7 == 0, F.array(F.lit(-100))).when(F.col("idx") % 7 == 1, F.array(F.lit(5), F.lit(-100), F.lit(5)))
    rows = t.predictions.select(F.col("idx").alias("row_id"), "pred_text", F.coalesce(labels, F.array(F.lit(-100), F.lit(5), F.lit(5))).alias("labels"))
    return records.mask_violations(rows, decoded="pred_text")


@query("strict_parse", with_ctes("prediction", """, s AS (SELECT idx, pred_text AS x, CASE WHEN json_valid(pred_text) THEN pred_text WHEN json_valid(regexp_extract(pred_text, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1)) THEN regexp_extract(pred_text, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1)
        WHEN json_valid(regexp_extract(pred_text, '(?s)\\{.*\\}')) THEN regexp_extract(pred_text, '(?s)\\{.*\\}') END AS v FROM prediction),
    c AS (SELECT *, coalesce(from_json(v -> '$.evidence_chain', '[{"hop":"BIGINT","image_id":"VARCHAR","bboxes":[["DOUBLE"]]}]'), []) AS chain FROM s)
    SELECT idx, CASE WHEN v IS NOT NULL THEN v ->> '$.answer' WHEN regexp_matches(x, '(?i)"answer"\\s*:\\s*"([^"]*)"') THEN trim(regexp_extract(x, '(?i)"answer"\\s*:\\s*"([^"]*)"', 1))
        WHEN regexp_matches(x, '(?i)answer[:\\s]+(.+?)(?:\\n|$)') THEN trim(regexp_extract(x, '(?i)answer[:\\s]+(.+?)(?:\\n|$)', 1)) END AS answer, len(chain)::INT AS n_hops,
    coalesce(array_to_string(list_transform(chain, lambda e: e.hop || '@' || coalesce(e.image_id, 'img_' || (e.hop - 1)) || ':' || len(e.bboxes)), '/'), '') AS chain FROM c"""))
def strict_parse(t):
    v = F.col("v")
    read = t.predictions.select("idx", "pred_text", J.parse_strict(F.col("pred_text")).alias("v")).select(
        "idx", J.strict_answer(v, F.col("pred_text")).alias("answer"), J.strict_chain(v).alias("chain")
    )
    shown = F.transform("chain", lambda e: F.concat(e["hop"].cast("string"), F.lit("@"), e["image_id"], F.lit(":"), F.size(e["bboxes"]).cast("string")))
    return read.select("idx", "answer", F.size("chain").alias("n_hops"), F.array_join(shown, "/").alias("chain"))


# ---- scores -----------------------------------------------------------------

_L = stat_sql("pb", "gb")
SCORED = f""", fl AS (SELECT *, flatten(list_transform(chain, lambda e: e.bboxes)) AS pb, flatten(list_transform(gold, lambda e: e.bboxes)) AS gb FROM lenient),
    im AS ({image_sql('chain', 'fl')}),
    sc AS (SELECT idx, ({norm_train('p_answer')} = {norm_train('answer')})::INT AS answer_em, ({norm_train('answer')} <> '' AND contains({norm_train('p_answer')}, {norm_train('answer')}))::INT AS answer_contains,
        {_L['localized']} AS bbox_localized, {_L['recall']} AS bbox_recall, {_L['precision']} AS bbox_precision, {_L['all_gt_hit']} AS bbox_all_gt_hit, len(gb)::INT AS bbox_n_gt, len(pb)::INT AS bbox_n_pred,
        (v IS NOT NULL)::INT AS parse_ok, (enabled AND len(gids) > 0)::INT AS image_metric_valid, {', '.join(f'{v} AS {k}' for k, v in IMAGE_COLS.items())} FROM im)"""
FLOATS = ("bbox_recall", "bbox_precision", *FRACTIONS)
ALL_METRICS = (
    "answer_em", "answer_contains", "bbox_localized", "bbox_recall", "bbox_precision", "bbox_all_gt_hit", "bbox_n_gt", "bbox_n_pred", "parse_ok", "image_metric_valid", *S.IMAGE_METRICS,
)
BASE_SQL = ", ".join(f"round(avg({m}), 6) AS {m}" for m in S.BASE_METRICS)
GATED_SQL = ", ".join(f"round(sum({m} * image_metric_valid) / nullif(sum(image_metric_valid), 0)::DOUBLE, 6) AS {m}" for m in S.IMAGE_METRICS)
SUMMARY_SQL = f"{BASE_SQL}, {GATED_SQL}, sum(image_metric_valid)::BIGINT AS n_image_valid, count(*) AS n_scored"


def _scored(t):
    return E.score_predictions(t.predictions)


def _rounded(df, cols):
    return df.withColumns({c: R6(c) for c in cols})


@query("score_predictions", with_ctes("lenient", SCORED + " SELECT idx, " + ", ".join(f"round({m}, 6) AS {m}" if m in FLOATS else m for m in ALL_METRICS) + " FROM sc"))
def score_predictions(t):
    return _rounded(_scored(t).select("idx", *ALL_METRICS), FLOATS)


@query("summary_gated", with_ctes("lenient", SCORED + f" SELECT {SUMMARY_SQL} FROM sc"))
def summary_gated(t):
    return _rounded(E.summarize(_scored(t)), S.BASE_METRICS + S.IMAGE_METRICS)


@query("periodic_report", with_ctes("lenient", SCORED + " SELECT round(avg(answer_em), 6) AS em, round(avg(answer_contains), 6) AS contains, round(avg(bbox_localized), 6) AS bbox_loc, round(avg(parse_ok), 6) AS parse_ok, count(*) AS n FROM sc"))
def periodic_report(t):
    return _rounded(E.periodic_report(_scored(t)), ("em", "contains", "bbox_loc", "parse_ok"))


@query("shard_progress", with_ctes("lenient", SCORED + """, dn AS (SELECT *, CASE WHEN idx % 10 = 7 THEN 'empty output' END AS error FROM sc WHERE idx % 6 <> 1)
    SELECT o_orderkey % 8 AS shard, count(*) AS n_owned, count(*) FILTER (error IS NULL AND idx IS NOT NULL) AS n_done, count(*) FILTER (error IS NOT NULL) AS n_failed, count(*) FILTER (idx IS NULL) AS n_remaining,
    round(avg(CASE WHEN error IS NULL THEN answer_em END), 6) AS answer_em, round(avg(CASE WHEN error IS NULL THEN bbox_recall END), 6) AS bbox_recall FROM orders LEFT JOIN dn ON idx = o_orderkey GROUP BY 1"""))
def shard_progress(t):
    """A sixth of the rows is still open; empty outputs count as failed."""
    failed = F.when(F.col("idx") % 10 == 7, "empty output")
    ok = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    done = _scored(t).where("idx % 6 <> 1").withColumn("error", failed).select("idx", "error", ok("answer_em"), ok("bbox_recall"))
    todo = t.raw("orders").select(F.col("o_orderkey").alias("idx"))
    return _rounded(E.shard_progress(todo, done, 8), ("answer_em", "bbox_recall"))


@query("failure_counts", "SELECT count(*) AS n_total, count(*) FILTER (event_type = 'error') AS n_failed, count(*) FILTER (event_type <> 'error') AS n_scored FROM events")
def failure_counts(t):
    return E.failures(t.raw("events").select(F.when(F.col("event_type") == "error", F.col("props")).alias("error")))


F1_SQL = sql_f1("pred_answer", "answer", "SELECT idx, type, pred_answer, answer FROM chains", "idx, type, p, g")


@query("evaluate_by_type", with_ctes("chains", HOPS + f""", fa AS ({F1_SQL}), al AS (SELECT fa.type, (p = g)::INT::DOUBLE AS em, f1, chain_acc, hop_acc_sum, n_hops FROM fa JOIN ca USING (idx))
    SELECT coalesce(type, 'ALL') AS type, round(avg(em) * 100, 6) AS em, CASE WHEN type IS NULL THEN round(avg(f1) * 100, 6) END AS f1, round(sum(hop_acc_sum) / sum(n_hops) * 100, 6) AS loc_acc, round(avg(chain_acc) * 100, 6) AS chain_acc, count(*) AS num_samples
    FROM al GROUP BY GROUPING SETS ((type), ())"""))
def evaluate_by_type(t):
    return _rounded(E.evaluate(E.score_chains(t.chains)), ("em", "f1", "loc_acc", "chain_acc"))


@query("pair_mismatch", "SELECT coalesce(c_custkey, s_suppkey) AS idx, CASE WHEN c_custkey IS NULL THEN 'no_prediction' ELSE 'no_gold' END AS problem FROM customer FULL JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey IS NULL OR s_suppkey IS NULL")
def pair_mismatch(t):
    return E.count_mismatch(t.raw("customer").select(F.col("c_custkey").alias("idx")), t.raw("supplier").select(F.col("s_suppkey").alias("idx")))


@query("resume_anti_join", "SELECT doc_id AS idx FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(t):
    todo = t.raw("documents").select(F.col("doc_id").alias("idx"))
    return E.remaining(todo, t.raw("labels").select(F.col("doc_id").alias("idx")))


@query("first_per_index", "SELECT user_id AS idx, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id")
def first_per_index(t):
    rows = t.raw("events").select(F.col("user_id").alias("idx"), F.col("event_id").alias("line"), "event_type", "value")
    return E.first_per_index(rows)


# ---- ranked lists -----------------------------------------------------------

LISTS = """SELECT vec_id, list_transform(list_slice(embedding, 1, 48), lambda v: 'e' || (floor(abs(v::DOUBLE) * 10000)::BIGINT % 150)) AS r, list_transform(list_slice(embedding, 49, 49 + (vec_id % 17)::INT - 1), lambda v: 'e' || (floor(abs(v::DOUBLE) * 10000)::BIGINT % 150)) AS g FROM embeddings"""


def _lists(t):
    name = lambda v: F.concat(F.lit("e"), (F.floor(F.abs(v.cast("double")) * 10_000) % 150).cast("string"))
    return t.raw("embeddings").select(
        "vec_id", F.transform(F.slice("embedding", 1, 48), name).alias("r"),
        F.transform(F.slice("embedding", F.lit(49), (F.col("vec_id") % 17).cast("int")), name).alias("g"),
    )


@query("recall_at_k", f"SELECT vec_id, round(CASE WHEN len(g) = 0 THEN 1::DOUBLE ELSE len(list_intersect(list_slice(r, 1, 5), g))::DOUBLE / len(list_distinct(g)) END, 6) AS recall FROM ({LISTS})")
def recall_at_k(t):
    return _lists(t).select("vec_id", R6(S.recall_at_k(F.col("r"), F.col("g"), 5)).alias("recall"))


@query("mrr", f"SELECT round(avg(CASE WHEN p IS NULL THEN 0::DOUBLE ELSE 1.0::DOUBLE / p END), 6) AS mrr, count(*) AS n FROM (SELECT list_min(list_filter(list_transform(r, lambda x, i: CASE WHEN list_contains(g, x) THEN i END), lambda i: i IS NOT NULL)) AS p FROM ({LISTS}))")
def mrr(t):
    return _lists(t).agg(R6(F.avg(S.reciprocal_rank(F.col("r"), F.col("g")))).alias("mrr"), F.count(F.lit(1)).alias("n"))


# ---- logs -------------------------------------------------------------------

LOG = "SELECT event_type AS run, event_id AS pos, event_id // 3 AS step, CASE WHEN event_id % 7 <> 0 THEN round(value, 1) END AS value FROM events"


@query("best_step", f"SELECT run, arg_max(step, (value, -step, -pos)) AS best_step, max(value) AS best_value FROM ({LOG}) WHERE value IS NOT NULL GROUP BY run")
def best_step(t):
    return L.best_step(t.log)


@query("best_flags", f"SELECT run, step, pos, value, coalesce(value > max(value) OVER (PARTITION BY run ORDER BY step, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best FROM ({LOG}) WHERE value IS NOT NULL")
def best_flags(t):
    return L.best_flags(t.log)


@query("metric_asof", f"""WITH l AS ({LOG}), s AS (SELECT DISTINCT event_type AS run, event_id // 100 * 50 AS step FROM events)
    SELECT s.run, s.step, (SELECT arg_max(l.value, (l.step, l.pos)) FROM l WHERE l.run = s.run AND l.step <= s.step AND l.value IS NOT NULL) AS value FROM s""")
def metric_asof(t):
    saves = t.raw("events").selectExpr("event_type AS run", "event_id DIV 100 * 50 AS step").distinct()
    return L.metric_asof(t.log, saves)


CKPT = "SELECT event_id AS pos, 'out/' || event_type AS dir, event_id // 2 AS step, 'out/' || event_type || '/checkpoint-' || event_id AS path, value > 30 AS valid FROM events"


@query("retain_newest", f"SELECT dir, path, step FROM ({CKPT}) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY step DESC, path DESC) > 3")
def retain_newest(t):
    return L.prunable(t.checkpoints, keep=3)


@query("newest_valid", f"SELECT path, step FROM ({CKPT}) WHERE valid ORDER BY step DESC, pos LIMIT 1")
def newest_valid(t):
    return L.newest_valid(t.checkpoints)


PIXELS = """SELECT 'img_' || (vec_id // 32) AS file, 64 AS width, vec_id % 32 AS y, list_transform(embedding, lambda v: (100 + floor(v::DOUBLE * CASE WHEN vec_id % 32 > 3 + (vec_id // 32) % 12 THEN 1.0::DOUBLE ELSE 400.0::DOUBLE END))::INT) AS gray FROM embeddings"""
TRIM = f"""WITH r AS (SELECT file, width, y, list_aggregate(gray, 'stddev_pop') > 5 AS content FROM ({PIXELS})), z AS (SELECT file, max(width) AS w, max(y) + 1 AS h, max(CASE WHEN content THEN y END) AS l FROM r GROUP BY file),
    m AS (SELECT file, h AS orig_h, least(coalesce(l + 21, h), h) AS new_h, w FROM z)"""


@query("trim_extent", TRIM + " SELECT file, orig_h::INT AS orig_h, new_h::INT AS new_h, (orig_h - new_h)::INT AS rows_removed, new_h >= orig_h AS skipped, CASE WHEN new_h < orig_h THEN w END AS orig_w FROM m")
def trim_extent(t):
    return L.trim_extent(t.pixel_rows).drop("error")


@query("trim_totals", TRIM + " SELECT count(*) AS n_done, 0::BIGINT AS n_errors, sum(orig_h - new_h)::BIGINT AS rows_saved, coalesce(sum(CASE WHEN new_h < orig_h THEN (orig_h - new_h) * w END), 0)::BIGINT AS pixels_saved FROM m")
def trim_totals(t):
    return L.trim_totals(L.trim_extent(t.pixel_rows))


@query("rebuild_outcome", "SELECT count(*) FILTER (lang <> 'de') AS n_ok, count(*) FILTER (lang = 'de') AS n_err, sum(CASE WHEN lang <> 'de' THEN len(string_split(text, chr(10))) END)::BIGINT AS n_paragraphs FROM documents")
def rebuild_outcome(t):
    return L.rebuild_outcome(_rebuilt(t))


@query("first_errors", "SELECT doc_id AS page_id FROM documents WHERE lang = 'de'")
def first_errors(t):
    return L.first_errors(_rebuilt(t)).select("page_id")


def _rebuilt(t):
    return t.raw("documents").select(
        F.col("doc_id").alias("page_id"), F.size(F.split("text", "\n")).alias("n_paragraphs"), F.when(F.col("lang") == "de", "bad layout").alias("error")
    )


# ---- streaming --------------------------------------------------------------

@query("stream_summary", with_ctes("lenient", SCORED + f" SELECT {SUMMARY_SQL} FROM sc"))
def stream_summary(t):
    """Predictions written as files, scored by a stream whose batches leave sums per shard; the sums are then merged.

    Half of the rows arrive twice, the second time after the first half has been scored. The result equals the batch
    summary.
    """
    spark = t.spark
    inbox, scored, parts = (new_shared_path(spark, n) for n in ("inbox", "scored", "parts"))
    rows = t.predictions
    for arriving in (rows.where("idx % 2 = 0"), rows):
        arriving.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(inbox)
        scorer.score_stream(stream, scored, scored + ".checkpoint").awaitTermination()
        scorer.refresh_parts(spark, scored, parts)
    return _rounded(scorer.merged_summary(spark, parts), S.BASE_METRICS + S.IMAGE_METRICS)
