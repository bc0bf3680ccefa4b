"""Golden values of the Column functions."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boxtrail.functions import geometry as G, parsing as J, records as R, register, scoring as S, text as T


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_normalizers_differ_in_order(spark):
    got = one(spark, [("a-b",), ("The U.S.A.",), ("",)], "s string", T.normalize_paper(F.col("s")), T.normalize_train(F.col("s")))
    assert got == [("b", "ab"), ("us", "usa"), ("", "")]


def test_null_answer_and_contains(spark):
    rows = [(None, "x"), ("the big cat", "Cat!"), ("anything", "the")]
    got = one(spark, rows, "p string, g string", T.exact_match_train(F.col("p"), F.col("g")), T.answer_contains(F.col("p"), F.col("g")))
    assert got == [(0, 0), (0, 1), (0, 0)]


def test_value_and_coverage(spark):
    rows = [("Frederick IX", "frederick, ix of", "red apple pie", "apple red"), ("", "x", "the of", "apple")]
    got = one(
        spark, rows, "v string, t string, a string, b string", T.value_in_text(F.col("v"), F.col("t")),
        F.round(T.coverage(T.content_tokens(F.col("a")), T.content_tokens(F.col("b"))), 6),
        F.round(T.coverage_within(T.content_tokens(F.col("a")), T.plain_words(F.col("b"))), 6),
    )
    assert got == [(True, 0.666667, 0.666667), (False, 0.0, 0.0)]


def test_deck_page_and_image_index(spark):
    rows = [("d/x__page_12.png",), ("deck_page_3.png",), ("deck__page_x.png",), ("plain.png",)]
    assert one(spark, rows, "s string", T.deck_key(F.col("s")), T.page_number(F.col("s"))) == [("x", 12), ("deck", 3), ("deck", None), ("", None)]
    assert one(spark, [("img_4",), ("img_",), ("x_1",), (None,)], "s string", T.image_index(F.col("s"))) == [(4,), (None,), (None,), (None,)]


def test_clean_text(spark):
    raw = ".mw-parser-output .a{b:c}Hello  world @media print{.x{y:z}.q{r:s}} end"
    assert one(spark, [(raw,)], "s string", T.clean_text(F.col("s"))) == [("Hello world end",)]


def reference_similarity(a, b):
    tok = lambda t: Counter(re.findall("[a-z0-9]+", t.lower()))
    x, y = tok(a), tok(b)
    common = sum((x & y).values())
    if not common:
        return 0.0
    p, r = common / sum(y.values()), common / sum(x.values())
    grams = lambda t: {t.lower()[i:i + 4] for i in range(len(t) - 3)}
    ga, gb = grams(a), grams(b)
    return 0.6 * 2 * p * r / (p + r) + 0.4 * (len(ga & gb) / len(ga) if ga else 0)


def test_similarity_matches_specification_on_random_text(spark):
    rnd = random.Random(7)
    words = ["the", "cat", "sat", "été", "on", "mat", "a", "big-dog", "42", "x", "\n"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, text(rnd.randint(1, 8)), text(rnd.randint(1, 20))) for i in range(80)]
    from boxtrail.operators.grounding import PARAGRAPH_FEATURES, SENTENCE_FEATURES, _made, with_similarity

    df = spark.createDataFrame(rows, "i int, a string, b string")
    pairs = df.select("i", *[c.alias(n) for n, c in _made(SENTENCE_FEATURES, "a").items()], *[c.alias(n) for n, c in _made(PARAGRAPH_FEATURES, "b").items()])
    got = {r["i"]: r["similarity"] for r in with_similarity(pairs, ["i"]).collect()}
    for i, a, b in rows:
        assert got[i] == pytest.approx(reference_similarity(a, b), abs=1e-9)


def test_iou_center_and_patch(spark):
    rows = [([0.0, 0.0, 10.0, 10.0], [5.0, 5.0, 15.0, 15.0])]
    got = one(spark, rows, "a array<double>, b array<double>", F.round(G.iou(F.col("a"), F.col("b")), 6), G.center_inside(F.col("a"), F.col("b")), G.relaxed_match(F.col("a"), F.col("b")))
    assert got == [(round(25 / 175, 6), True, True)]
    assert one(spark, [(31,), (32,), (1023,)], "n int", G.round_to_patch(F.col("n"))) == [(32,), (32,), (992,)]


def python_plan(w, h, target, cap):
    scale = target / w
    nw, nh = int(w * scale), int(h * scale)
    if nw * nh > cap:
        scale *= (cap / (nw * nh)) ** 0.5
        nw, nh = int(w * scale), int(h * scale)
    fit = lambda n: max(32, n // 32 * 32)
    return fit(nw), fit(nh)


def test_resize_plan_matches_float_order(spark):
    rows = [(w, h) for w in range(300, 3000, 7) for h in (200, 5000)]
    p = G.resize_plan(F.col("w"), F.col("h"), F.lit(1024), 1048576)
    got = one(spark, rows, "w int, h int", "w", "h", p.width, p.height)
    assert all((a, b) == python_plan(w, h, 1024, 1048576) for w, h, a, b in got)


PARSE = [
    ('{"answer":"x"}', 1, "x", 0),
    ('```json\n{"answer":"x","bbox":[1,2,3,4]}\n```', 1, "x", 1),
    ('{"answer":"x"} trailing {', 1, "x", 0),
    ('{"answer":"x"', 0, None, 0),
    ("", 0, None, 0), (None, 0, None, 0), ("5", 1, None, 0), ("[1]", 1, None, 0), ("{}", 0, None, 0), ("5 apples", 0, None, 0),
    ('{"answer":["a","b"],"bbox":["1","2","3","4"]}', 1, "a, b", 0),
    ('{"answer":1,"bboxes":[["1",2,3,4],[1,2,3]]}', 1, "1", 1),
    ('{"answer":NaN,"bbox":[1,2,NaN,4]}', 1, "nan", 1), ('so {"answer":[-Infinity, Infinity, "NaN"]} ok', 1, "-inf, inf, NaN", 0),
    ('{"answer":"say \\"NaN\\" or -Infinity","bboxes":[]}', 1, 'say "NaN" or -Infinity', 0), ('NaN', 1, None, 0), ('{"answer": NaNs}', 0, None, 0),
    ('{"answer":"a","answer":"b"}', 1, "b", 0),
    ('pre {"answer":"}","evidence_chain":[{"hop":"x","image_id":"img_1","bboxes":[[1,2,3,4]]},7,{"hop":5}]}', 1, "}", 2),
]


def test_lenient_parse_shapes(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PARSE)], "i int, t string").withColumn("v", J.parse_lenient(F.col("t")))
    answer = F.when(J.is_object(F.col("v")), J.scalar_text(F.try_variant_get("v", "$.answer", "variant")))
    got = df.select("i", J.is_truthy(F.col("v")).cast("int"), answer, F.size(J.predicted_chain(F.col("v")))).orderBy("i").collect()
    for row, (text, ok, ans, hops) in zip(got, PARSE):
        assert tuple(row)[1:] == (ok, ans, hops), text


def test_sql_parse_equals_the_column_function(spark):
    register.register(spark)
    rows = [(i, p[0]) for i, p in enumerate(PARSE)] + [(99, '[{"a":1}]'), (98, ' {"a":1} x'), (97, "1 2")]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("v", J.parse_lenient(F.col("t")))
    for r in df.select("t", F.to_json("v").alias("a"), F.to_json(F.expr("bt_parse(t)")).alias("b")).collect():
        assert r.a == r.b, r.t


def test_sql_normalizers_equal_the_column_functions(spark):
    register.register(spark)
    rows = [("The\u2003U.S.A.\x1f x",), ("a-b  THE end",), ("",), (None,), ("it's an \x0b apple\u00a0",)]
    df = spark.createDataFrame(rows, "s string")
    for r in df.select(T.normalize_train(F.col("s")), F.expr("bt_normalize_train(s)"), T.normalize_paper(F.col("s")), F.expr("bt_normalize_paper(s)")).collect():
        assert r[0] == r[1] and r[2] == r[3]


SCALARS = [
    ("1.0", "1.0"), ("1", "1"), ("1.50", "1.5"), ("true", "True"), ("null", None), ('{"a": 1}', "{'a': 1}"), ('{"a": "x", "b": [1]}', "{'a': 'x', 'b': [1]}"),
    ('{"k": null, "z": 2.0}', "{'k': None, 'z': 2.0}"), ("[1, 2.0, null, false]", "1, 2.0, None, False"), ('[{"a": "it\'s"}]', '{\'a\': "it\'s"}'), ('"1.0"', "1.0"),
]


def test_answer_texts(spark):
    """Texts of answers as they are compared, by hand."""
    df = spark.createDataFrame([(i, f'{{"answer": {a}}}') for i, (a, _) in enumerate(SCALARS)], "i int, t string")
    v = F.try_variant_get(J.parse_lenient(F.col("t")), "$.answer", "variant")
    got = [r[0] for r in df.orderBy("i").select(J.scalar_text(v)).collect()]
    assert got == [want for _, want in SCALARS]


def test_number_words_in_boxes_match_nothing(spark):
    """Such boxes count as predictions, in either form and as texts too, but overlap no gold box."""
    rows = [("[NaN,0,10,10]",), ("[[0,0,Infinity,10],[0,0,10,10]]",), ('[["nan",0,10,10],["x",0,1,1]]',), ("[-Infinity,-Infinity,Infinity,Infinity]",)]
    df = spark.createDataFrame([(i, f'{{"hop": NaN, "answer": {{"a": NaN}}, "evidence_chain": [{{"hop": Infinity, "bboxes": {r[0]}}}]}}') for i, r in enumerate(rows)], "i int, t string")
    v = df.withColumn("v", J.parse_lenient(F.col("t"))).select("i", J.predicted_chain(F.col("v")).alias("c"), J.scalar_text(F.try_variant_get("v", "$.answer", "variant")).alias("a"), J.strict_chain(J.parse_strict(F.col("t"))).alias("s"))
    nowhere, gold = list(J.NOWHERE), [0.0, 0.0, 10.0, 10.0]
    got = {r["i"]: (r["c"][0]["hop"], r["c"][0]["bboxes"], r["a"], [e["bboxes"] for e in r["s"]]) for r in v.collect()}
    assert got[0][:3] == (1, [nowhere], "{'a': nan}") and got[1][:2] == (1, [nowhere, gold]) and got[2][1] == [nowhere] and got[3][1] == [nowhere]
    assert got[0][3] == [[]] and got[1][3] == [[[0, 0, 10, 10]]]
    hit = spark.createDataFrame([(nowhere, gold)], "p array<double>, g array<double>").select(G.relaxed_match(F.col("p"), F.col("g"))).first()[0]
    assert hit is False


def test_hop_numbers(spark):
    hops = ['"3.0"', '"7"', '" -2 "', "2.9", "true", '"x"', "[4]", "null"]
    t = '{"evidence_chain":[' + ",".join(f'{{"hop":{h}}}' for h in hops) + "]}"
    (row,) = spark.createDataFrame([(t,)], "t string").select(J.predicted_chain(J.parse_lenient(F.col("t"))).alias("c")).collect()
    assert [h["hop"] for h in row["c"]] == [1, 7, -2, 2, 1, 6, 7, 8]


def test_chain_defaults(spark):
    t = '{"evidence_chain":[{"hop":"x","image_id":"img_1","bboxes":[[1,2,3,4]]},7,{"hop":5}]}'
    v = J.parse_lenient(F.col("t"))
    (row,) = spark.createDataFrame([(t,)], "t string").select(J.predicted_chain(v).alias("c")).collect()
    assert [(h["hop"], h["image_id"], h["bboxes"]) for h in row["c"]] == [(1, "img_1", [[1.0, 2.0, 3.0, 4.0]]), (5, "", [])]


def test_strict_parse(spark):
    rows = [('x ```json {"answer": 3, "evidence_chain":[{"bboxes":[[1,1,2,2],[3,3,2,2]]}]} ``` y',), ('The answer is: Paris.',), ("nothing",), ('{"a":1}',)]
    df = spark.createDataFrame(rows, "t string").withColumn("v", J.parse_strict(F.col("t")))
    got = df.select(J.strict_answer(F.col("v"), F.col("t")), J.strict_chain(F.col("v"))).collect()
    assert got[0][0] == "3" and [(h["hop"], h["image_id"], h["bboxes"]) for h in got[0][1]] == [(1, "img_0", [[1, 1, 2, 2]])]
    assert [g[0] for g in got[1:]] == ["is: Paris.", None, None]


def python_greedy(preds, golds, t=0.3):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(0, w) * max(0, h)
        area = lambda z: max(0, z[2] - z[0]) * max(0, z[3] - z[1])
        union = area(a) + area(b) - inter
        return inter / union if union > 0 else 0.0
    if not golds:
        return 0.0 if preds else 1.0
    used, hits = set(), 0
    for g in golds:
        best = None
        for j, p in enumerate(preds):
            inside = g[0] <= (p[0] + p[2]) / 2 <= g[2] and g[1] <= (p[1] + p[3]) / 2 <= g[3]
            if j not in used and (iou(p, g) >= t or inside) and (best is None or iou(p, g) >= best[0]):
                best = (iou(p, g), j)
        if best:
            used.add(best[1])
            hits += 1
    return hits / len(golds)


def test_greedy_localization_against_brute_force(spark):
    rnd = random.Random(3)
    box = lambda: (lambda x, y: [float(x), float(y), float(x + rnd.randint(1, 12)), float(y + rnd.randint(1, 12))])(rnd.randint(0, 15), rnd.randint(0, 15))
    rows = [(i, [box() for _ in range(rnd.randint(0, 5))], [box() for _ in range(rnd.randint(0, 5))]) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, p array<array<double>>, g array<array<double>>")
    got = dict(df.select("i", S.greedy_localization(F.col("p"), F.col("g"))["accuracy"]).collect())
    assert all(got[i] == pytest.approx(python_greedy(p, g)) for i, p, g in rows)


def test_box_stats_without_boxes(spark):
    none = F.array().cast("array<array<double>>")
    (row,) = spark.range(1).select(S.bbox_stats(none, none).alias("s"), S.bbox_localized(none, none).alias("l")).collect()
    assert tuple(row["s"]) == (1.0, 1.0, 1, 1, 0, 0) and row["l"] == 0


def test_image_stats_keep_positional_quirk(spark):
    hop = "struct<image_id:string,bboxes:array<array<double>>>"
    box = [[0.0, 0.0, 9.0, 9.0]]
    rows = [([("img_0", box), ("img_1", box)], [("", box), ("img_1", box)])]
    (row,) = spark.createDataFrame(rows, f"p array<{hop}>, g array<{hop}>").select(S.image_chain_stats(F.col("p"), F.col("g")).alias("s")).collect()
    # One non-empty gold id: only the first position is inspected, and it has no id.
    assert row["s"]["valid"] == 1 and row["s"]["image_hop_acc"] == 0.0 and row["s"]["gold_image_recall"] == 1.0


def test_ranked_lists(spark):
    rows = [(["a", "b", "c"], ["b", "z"]), (["a"], []), (["a"], ["q"])]
    got = one(spark, rows, "r array<string>, g array<string>", S.recall_at_k(F.col("r"), F.col("g"), 2), S.reciprocal_rank(F.col("r"), F.col("g")))
    assert got == [(0.5, 0.5), (1.0, 0.0), (0.0, 0.0)]


def test_target_text_equals_json_dumps(spark):
    answer = 'é "quoted"\n\\ tab\t'
    (row,) = spark.createDataFrame([(answer, [[1, 2, 3, 4], [5, 6, 7]])], "a string, b array<array<int>>").select(
        R.single_hop_target(F.array(F.struct(F.col("b").alias("bboxes"))), F.col("a"), F.lit(""))
    ).collect()
    assert row[0] == json.dumps({"reasoning": "", "bbox": [[1, 2, 3, 4]], "answer": answer}, ensure_ascii=False)


def test_supervision_mask(spark):
    got = one(spark, [([7, 8, 9, 0, 0],)], "x array<int>", R.supervision_mask(F.col("x"), F.lit(2), F.lit(0)))
    assert got == [([-100, -100, 9, -100, -100],)]


def test_registered_sql_functions(spark):
    register.register(spark)
    row = spark.sql("SELECT bt_normalize_train('The U.S.A.') a, bt_iou(array(0D,0D,10D,10D), array(5D,5D,15D,15D)) b, bt_answer_em('A cat', 'cat') c, bt_parse('x {\"a\":1}') IS NOT NULL d").first()
    assert row["a"] == "usa" and row["b"] == pytest.approx(25 / 175) and row["c"] == 1 and row["d"]


def test_boxes_are_measured_once_and_hops_judged_once(spark):
    """Lists compared pair by pair give what single pairs give, whatever the boxes; no list is built per measure."""
    nan = float("nan")
    boxes = [[0.0, 0.0, 10.0, 10.0], [9.0, 9.0, 1.0, 1.0], [nan, 0.0, 5.0, 5.0], [-1.0, -1.0, -1.0, -1.0], [2.0, 2.0, 9.0, 9.0], [1.0, 2.0], [None, 0.0, 4.0, 4.0]]
    df = spark.createDataFrame([(boxes, boxes[::-1])], "p array<array<double>>, g array<array<double>>")
    (row,) = df.select(S.match_table(F.col("p"), F.col("g")).alias("t"), S.any_match(F.col("p"), F.col("g")).alias("a")).collect()
    pairs = df.select(F.posexplode("g").alias("i", "y"), "p").select("i", "y", F.posexplode("p").alias("j", "x"))
    single = pairs.select("i", "j", F.when(G.relaxed_match(F.col("x"), F.col("y")), G.iou(F.col("x"), F.col("y"))).alias("o")).collect()
    assert {(r.i, r.j): repr(r.o) for r in single} == {(i, j): repr(o) for i, line in enumerate(row.t) for j, o in enumerate(line)} and row.a
    hop = "array<struct<image_id:string,bboxes:array<array<double>>>>"
    chains = spark.createDataFrame([([("a", boxes[:1])], [("a", boxes[4:5])])], f"p {hop}, g {hop}")
    stats = chains.select(S.image_chain_stats(F.col("p"), F.col("g")).alias("s"))
    assert stats._jdf.queryExecution().analyzed().toString().count("slice(") == 1 and stats.first().s.image_bbox_joint_recall == 1.0


def test_empty_and_nested_values_are_told_apart(spark):
    """Objects and lists are recognised without spelling their types; empty ones count as no output."""
    texts = ["{}", "[]", '{"a": []}', "[[]]", "0", "0.0", "false", "true", '""', '"{}"', '"[]"', '"false"', "null", '"x"', "[0]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("v", F.try_parse_json("t")).orderBy("i")
    got = df.select(J.is_truthy(F.col("v")).alias("t"), J.is_object(F.col("v")).alias("o")).collect()
    assert [r.t for r in got] == [False, False, True, True, False, False, False, True, False, True, True, True, False, True, True]
    assert [i for i, r in enumerate(got) if r.o] == [0, 2]


def test_boxes_read_as_a_whole_equal_boxes_read_one_by_one(spark, monkeypatch):
    """Well-formed lists take one reading; any other value gives the boxes and ids of the reading by item."""
    four, nowhere = [1.0, 2.0, 3.0, 4.0], [-1.0, -1.0, -1.0, -1.0]
    boxes = {
        "[]": [], "[[1,2,3,4]]": [four], "[1,2,3,4]": [four], '[["1","2","3","4"]]': [four], '["1","2","3","4"]': [], "[[1,2,3],[1,2,3,4]]": [four],
        '[[1,2,"x",4],[1,2,3,4]]': [four], "[[1,2,null,4]]": [], "[null,[1,2,3,4]]": [four], "[[NaN,2,3,4],[1,2,3,4]]": [nowhere, four],
        "[[1,2,3,4],5]": [four], "[[[1],2,3,4]]": [], '"text"': [], '{"a":1}': [], "null": [], "[[1e400,2,3,4]]": None,
    }
    ids = {"5": "5", "1.0": "1.0", '""': "", '" a"': " a", "true": "True", "false": "", "[1,2]": "1, 2", "{}": "", "0": "", "null": "", "NaN": "nan", "-Infinity": "-inf"}
    texts = [f'{{"evidence_chain":[{{"bboxes":{b}}}]}}' for b in boxes] + [f'{{"evidence_chain":[{{"image_id":{i}}}]}}' for i in ids]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    read = df.select("i", J.predicted_chain(J.parse_lenient(F.col("t"))).alias("c")).orderBy("i").collect()
    got = [r.c[0] if r.c else None for r in read]
    for g, (text, want) in zip(got, boxes.items()):
        assert want is None or g.bboxes == want, text
    assert [g.image_id for g in got[len(boxes):]] == list(ids.values())
    by_item = []
    monkeypatch.setattr(J, "_boxes_of", lambda items: by_item.append(1) or F.array(F.array(*[F.lit(9.0)] * 4)))
    whole = df.select("i", J.predicted_chain(J.parse_lenient(F.col("t"))).alias("c")).orderBy("i").collect()
    assert whole[1].c[0].bboxes == [four] and whole[2].c[0].bboxes == [[9.0] * 4] and by_item
