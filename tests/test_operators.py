"""Operators on small fixtures, against brute force where they take a shortcut."""

import glob
import json
import os
import random
import re
import struct
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boxtrail import runtime
from boxtrail.functions import parsing as J, register, scoring, text as T
from boxtrail.operators import assemble as A, containment, evaluation as E, grounding as G, layout, logs as L, phrases, records as RO, sampling as S
from boxtrail.sources import headers, json_objects, readers, writers
from boxtrail.streaming import scorer
from tests.test_functions import reference_similarity

PARA = "page_id long, para_ord int, text string, x1 int, y1 int, x2 int, y2 int"


@pytest.mark.parametrize("limit", [1_000, 0])
def test_grounding_routes_equal_brute_force(spark, limit):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(30)] + ["the"] * 30
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    paras = [(p, o, text(rnd.randint(1, 12)), 0, o, 40 + rnd.randint(0, 3) * 10, o + 6) for p in range(3) for o in range(25)]
    sents = [(p, s, text(rnd.randint(1, 6))) for p in range(4) for s in range(8)] + [(0, 90, " "), (1, 91, None)]
    got = G.ground_sentences(spark.createDataFrame(sents, "page_id long, sid int, sent string"), spark.createDataFrame(paras, PARA), limit)
    found = {(r["page_id"], r["sid"]): r["para_ord"] for r in got.collect()}
    want = {}
    for p, s, t in sents:
        if not t or not t.strip():
            continue
        scored = [(reference_similarity(t, x[2]), x[5] - x[3], -x[1]) for x in paras if x[0] == p and x[5] - x[3] >= 50]
        if scored and max(scored)[0] >= 0.25:
            want[(p, s)] = -max(scored)[2]
    assert found == want


def test_picked_paragraphs_equal_brute_force(spark):
    """Repeated words, phrases at the edges and over them, values of several words, absent words, nulls and empty texts."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(12)] + ["the", "of"] * 3
    text = lambda n: rnd.choice([" ", ", ", "-"]).join(rnd.choice(vocab) for _ in range(n))
    paras = [(p, o, text(rnd.randint(6, 20)), 0, 10 * o, 100, 10 * o + rnd.choice([4, 8])) for p in range(4) for o in range(20)]
    paras += [(0, 90, None, 0, 0, 100, 9), (0, 91, "", 0, 0, 100, 9), (None, 92, text(9), 0, 0, 100, 9)]
    targets = [(p, f"{p}-{i}", text(rnd.randint(1, 3)), text(rnd.randint(1, 7))) for p in range(5) for i in range(25)]
    targets += [(1, "blank", "w1", ""), (1, "null", "w1", None), (1, "none", None, "w1 w2"), (1, "odd", "!", "w3 zz"), (2, "far", "zz w1", "the of")]
    got = G.pick_paragraphs(
        spark.createDataFrame(targets, "page_id long, target_id string, value string, text string"), spark.createDataFrame(paras, PARA),
        spark.createDataFrame([(0, 1_000), (1, None), (2, 150), (3, 2)], "page_id long, image_height int"),
    )
    found = {r["target_id"]: (r["status"], r["para_ord"], r["score"] and round(r["score"], 9)) for r in got.collect()}
    words = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()
    heights = {0: 1_000, 1: None, 2: 150, 3: 2}
    want = {}
    for page, target, value, sent in targets:
        if not sent:
            want[target] = ("no_target_sent", None, None)
            continue
        large = [x for x in paras if x[0] == page and page in heights and x[5] - x[3] >= 80 and x[6] - x[4] >= 5]
        low = [x for x in large if heights[page] is not None and x[6] > heights[page]]
        usable = [x for x in large if x not in low and len((x[2] or "").split()) >= 8]
        content = {w for w in words(sent).split() if len(w) > 1 and w not in ("the", "of")}
        best = None
        for x in usable:
            share = len(content & set(words(x[2]).split())) / len(content) if content else 0.0
            holds = bool(words(value)) and f" {words(value)} " in f" {words(x[2])} "
            best = max(filter(None, [best, (share + 0.2 * holds, share, -x[4], -x[1], holds)]))
        tail = "_oob" if low else ""
        if not usable:
            want[target] = ("no_candidates" + tail, None, None)
        elif best[0] < 0.4:
            want[target] = ("below_threshold" + tail, None, None)
        else:
            want[target] = ("val_match" if best[4] else "sim_only", -best[3], round(best[0], 9))
    assert found == want
    assert {s for s, _, _ in want.values()} >= {"val_match", "sim_only", "below_threshold", "no_target_sent", "no_candidates"}


def test_candidates_of_one_hot_page(spark):
    """Of a thousand like paragraphs only those with the rare word leave the index, each once with all its places."""
    paras = [(7, o, ["a", "b"] * 5 + (["rare", "b", "rare", "b"] if o % 100 == 0 else [])) for o in range(1_000)]
    texts = spark.createDataFrame(paras, "page_id long, para_ord int, words array<string>")
    targets = spark.createDataFrame([(7, "t", "b rare", ["rare"]), (7, "u", "rare zz", []), (7, "v", None, None), (8, "t", "a", ["a"])], "page_id long, target_id string, phrase string, tokens array<string>")
    got = phrases.candidates(targets, texts, 0.4).collect()
    assert sorted((r["target_id"], r["para_ord"], sorted(r["starts"])) for r in got) == [("t", o, [9, 11]) for o in range(0, 1_000, 100)]
    nothing = phrases.candidates(targets.limit(0), texts, 0.4).unionByName(phrases.candidates(targets, texts.limit(0), 0.4))
    assert nothing.count() == 0


LAYOUT_ELEMENT = "tag string, cls string, text string, bcr array<int>, float string, line_rects array<array<int>>"


@pytest.mark.parametrize("strip", [512, 7])
def test_element_rows_equal_nested_pages(spark, monkeypatch, strip):
    """Floats over several strips, lines touching their edges, lines upside down or without height, null and missing rectangles."""
    monkeypatch.setattr(layout, "STRIP", strip)
    rnd = random.Random(8)

    def rect(tall):
        x, y = rnd.randint(0, 600), rnd.randint(-40, 900)
        return [x, y, x + rnd.randint(0, 400), y + rnd.choice([-3, 0, 1, 16, tall])]

    def element():
        kind = rnd.randint(0, 5)
        lines = [rect(60) for _ in range(rnd.randint(0, 5))] + ([None] if kind == 1 else [])
        box = None if kind == 2 and not lines else rect(300)
        return (rnd.choice(["P", "LI", "DIV"]), rnd.choice(["", None, "Infobox"]), rnd.choice(["some text", " ", None]), box, rnd.choice(["right", "none", None, "none"]), None if kind == 3 else lines)

    pages = [(p, [element() for _ in range(40)]) for p in range(4)] + [(9, [])]
    nested = spark.createDataFrame(pages, f"page_id long, elements array<struct<{LAYOUT_ELEMENT.replace(' ', ':').replace(',:', ',')}>>")
    rows = spark.createDataFrame([(p, i, *e) for p, es in pages for i, e in enumerate(es)], f"page_id long, el_ord int, {LAYOUT_ELEMENT}")
    for limits in ({}, {"text_chars": 4, "max_height": 200}):
        want = sorted(map(tuple, layout.layout_to_paragraphs(nested, **limits).collect()))
        assert want and sorted(map(tuple, layout.element_rows_to_paragraphs(rows, **limits).collect())) == want
    assert layout.element_rows_to_paragraphs(rows.limit(0)).count() == 0


def test_lines_of_one_long_page_spread_over_tasks(spark):
    lines = spark.range(100_000).selectExpr("1L AS page_id", "CAST(id AS int) AS el_ord", "0 AS x1", "CAST(20 * id AS int) AS y1", "500 AS x2", "CAST(20 * id + 16 AS int) AS y2")
    floats = spark.range(1_000).selectExpr("1L AS page_id", "CAST(300 + id % 7 AS int) AS left", "CAST(2000 * id AS int) AS top", "CAST(2000 * id + 1000 AS int) AS bottom")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = layout.clip_lines(lines, floats).withColumn("part", F.spark_partition_id())
        by_part = got.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x2") < 500).alias("cut")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(by_part) == 4 and sum(r["n"] for r in by_part) == 100_000 and sum(r["cut"] for r in by_part) == 50_000


def test_context_first_wins_and_meta_semi_join(spark):
    entries = spark.createDataFrame([(2, 0, "A", ["late"]), (1, 1, "A", ["x", "y"]), (1, 0, "B", ["b"])], "sample_id long, ctx_pos int, entity string, sents array<string>")
    assert sorted(map(tuple, A.first_context(entries).collect())) == [("A", 0, "x"), ("A", 1, "y"), ("B", 0, "b")]


def test_prefix_match_repeated_entity_keeps_last_content(spark):
    chain = "array<struct<entity:string,screenshot:string,sentence_ids:array<int>>>"
    rows = [(1, [("Ann", "a.png", [0]), ("Bob", "b.png", [1]), ("Ann", "c.png", [2])], [("Ann B", "r", "v"), ("Bob", "r", "v"), ("Zed", "r", "v"), ("Bob", None, "v")])]
    df = spark.createDataFrame(rows, f"sample_id long, evidence_chain {chain}, evidences array<struct<entity:string,relation:string,value:string>>")
    got = [tuple(r) for r in G.match_hops(df).orderBy("hop_pos").select("entity", "screenshot", "early_status").collect()]
    assert got == [("Ann", "c.png", None), ("Bob", "b.png", None), (None, None, "no_chain_entry"), (None, None, "malformed_triple")]


def test_hash_split_size_and_stability(spark):
    df = spark.range(30).withColumnRenamed("id", "sample_id")
    one = {r[0]: r[1] for r in S.hash_split(df, 0.05, 42).collect()}
    two = {r[0]: r[1] for r in S.hash_split(df.repartition(7), 0.05, 42).collect()}
    assert one == two and len(one) == 30 and sum(v == "val" for v in one.values()) == 2
    assert all(r[1] == "train" for r in S.hash_split(df, 0.0, 42).collect())


def test_global_distractors_contract(spark):
    pool = spark.createDataFrame([(f"s{i}",) for i in range(9)], "screenshot string")
    samples = spark.createDataFrame([(i, [f"s{i % 9}", f"s{(i + 1) % 9}"]) for i in range(40)] + [(99, [f"s{i}" for i in range(6)])], "sample_id long, gold array<string>")
    got = {r[0]: r[1] for r in S.global_distractors(samples, pool, 5, 1).collect()}
    assert len(got) == 40 and 99 not in got
    for i in range(40):
        assert len(set(got[i])) == 3 and not set(got[i]) & {f"s{i % 9}", f"s{(i + 1) % 9}"}


def test_same_deck_equals_brute_force(spark):
    rnd = random.Random(5)
    names = [f"d{rnd.randint(0, 2)}__page_{rnd.choice(['x', rnd.randint(0, 3000), rnd.randint(0, 9)])}.{i}.png" for i in range(200)]
    rows = [(i, rnd.sample(names, rnd.randint(1, 3))) for i in range(60)]
    got = {r[0]: r[1] for r in S.same_deck_distractors(
        spark.createDataFrame(rows, "sample_id long, gold array<string>"), spark.createDataFrame([(n,) for n in names], "screenshot string"), 5).collect()}

    def page(n):
        v = n.split("__page_")[1].split(".")[0]
        return int(v) if v.isdigit() else None

    for i, gold in rows:
        deck = gold[0].split("__page_")[0]
        rest = [n for n in names if n.split("__page_")[0] == deck and n not in gold]
        pages = [page(g) for g in gold if page(g) is not None]
        key = (lambda n: (min(abs((page(n) or 10**9) - g) for g in pages), page(n) or 10**9, n)) if pages else (lambda n: n)
        assert got.get(i, []) == sorted(rest, key=key)[: 5 - len(gold)]


def test_reconcile_statuses(spark):
    chain = "array<struct<entity:string,bboxes:array<array<int>>,sub_query:string>>"
    samples = spark.createDataFrame([
        (1, [("A", [[1, 1, 2, 2]], None), ("A", [[9, 9, 9, 9]], "keep")]), (2, [("A", [[1, 1, 2, 2]], None)]), (3, [("B", [[0, 0, 1, 1]], None)]), (4, [("B", [[0, 0, 1, 1]], None)]),
    ], f"sample_id long, evidence_chain {chain}")
    resolved = spark.createDataFrame([
        (1, 0, "A", [1, 1, 2, 2], "q1"), (1, 1, "A", [3, 3, 4, 4], " "), (3, 0, "C", [1, 1, 1, 1], "q"), (4, 0, "B", [0, 0, 1, 1], "q"),
    ], "sample_id long, hop_pos int, entity string, bbox array<int>, question string")
    out = {r["sample_id"]: r for r in A.reconcile_chain(samples, resolved).collect()}
    assert {k: r["status"] for k, r in out.items()} == {1: "changed", 2: "no_resolved", 3: "missing_hop", 4: "same"}
    assert [(e["bboxes"], e["sub_query"]) for e in out[1]["evidence_chain"]] == [([[1, 1, 2, 2]], "q1"), ([[3, 3, 4, 4]], "keep")]


def test_best_step_ties_and_retention(spark):
    log = spark.createDataFrame([("r", 0, 1, 0.5), ("r", 1, 5000, 0.9), ("r", 2, 9000, 0.9), ("r", 3, 9500, None)], "run string, pos long, step long, value double")
    assert L.best_step(log).first()["best_step"] == 5000
    assert [r["is_best"] for r in L.best_flags(log).orderBy("step").collect()] == [True, True, False]
    saves = spark.createDataFrame([("r", 0), ("r", 4999), ("r", 99999)], "run string, step long")
    assert [r["value"] for r in L.metric_asof(log, saves).orderBy("step").collect()] == [None, 0.5, 0.9]
    ckpt = spark.createDataFrame([("d", f"c{i}", i) for i in range(5)], "dir string, path string, step long")
    assert {r["path"] for r in L.prunable(ckpt, 2).collect()} == {"c0", "c1", "c2"} and L.prunable(ckpt, 0).count() == 0


def test_sources_round_trip(spark, tmp_path):
    shots = tmp_path / "shots" / "sub"
    shots.mkdir(parents=True)
    ihdr = struct.pack(">IIBBBBB", 640, 480, 8, 2, 0, 0, 0)
    (shots / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + ihdr + struct.pack(">I", zlib.crc32(b"IHDR" + ihdr)))
    (shots / "b.PNG").write_bytes(b"broken")
    (shots / "c.txt").write_text("x")
    root = str(tmp_path / "shots")
    assert sorted(map(tuple, readers.image_sizes(spark, root).collect())) == [("sub/a.png", 640, 480), ("sub/b.PNG", None, None)]
    assert readers.list_images(spark, root).count() == 2

    (shots / "p_bboxes.json").write_text(json.dumps([{"text": "t", "bbox": [1, 2, 3, 4]}]))
    (shots / "q_bboxes.json").write_text("{not json")
    paras, status = readers.read_paragraphs(spark, str(shots))
    assert [tuple(r) for r in paras.collect()] == [("p", 0, "t", 1, 2, 3, 4)]
    assert sorted(map(tuple, status.collect())) == [("p", "ok"), ("q", "bad")]

    questions = tmp_path / "q.json"
    questions.write_text(json.dumps([
        {"sample_id": 1, "question": "q", "answer": "a", "supporting_facts": [["T", 0], ["U", 2]], "context": [["T", ["s0", "s1"]]], "evidences": [["T", "r", "v"], ["x", "y"]]},
        {"sample_id": 2, "question": "q", "answer": "a", "type": "k", "supporting_facts": {"title": ["T"], "sent_id": [1]}, "context": [], "evidences": []},
    ]))
    df = readers.read_questions(spark, str(questions))
    facts = sorted(map(tuple, A.explode_facts(df).collect()))
    assert facts == [(1, 0, "T", 0), (1, 1, "U", 2), (2, 0, "T", 1)]
    assert [tuple(r) for r in readers.context_entries(df).collect()] == [(1, 0, "T", ["s0", "s1"])]


def test_results_resume_and_merge(spark, tmp_path):
    folder = tmp_path / "res"
    folder.mkdir()
    (folder / "rank0.jsonl").write_text('{"idx": 0, "answer_em": 1}\n{broken\n{"idx": 0, "answer_em": 0}\n')
    (folder / "rank1.jsonl").write_text('{"idx": 1, "answer_em": 0}\n')
    rows = readers.read_results(spark, str(folder), "idx long, answer_em int", "rank*.jsonl")
    assert sorted((r["idx"], r["answer_em"]) for r in E.first_per_index(rows).collect()) == [(0, 1), (1, 0)]
    todo = spark.range(4).withColumnRenamed("id", "idx")
    assert sorted(r["idx"] for r in E.remaining(todo, rows).collect()) == [2, 3]
    writers.merge_shards(spark, str(folder), str(tmp_path / "all"), "idx long, answer_em int")
    files = sorted(glob.glob(str(tmp_path / "all" / "*.json")))
    assert [json.loads(line)["idx"] for f in files for line in open(f)] == [0, 0, 1]


def test_image_headers(spark, tmp_path):
    """Sizes of three formats; only the bytes that hold them are read."""
    be, segment = (lambda n: struct.pack(">H", n)), lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    frame = lambda m: segment(m, b"\x08" + be(480) + be(640) + b"\x03" + bytes(9))
    chunk = lambda kind, body: b"RIFF" + struct.pack("<I", 4 + 8 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body
    tail = bytes(200_000)
    made = {
        "base.jpg": b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xDB, bytes(65)) + frame(0xC0) + tail,
        "late.jpeg": b"\xff\xd8" + segment(0xE1, b"\xff\xc0" * 30_000) + segment(0xC4, bytes(28)) + b"\xff\xff" + frame(0xC2) + tail,
        "scan.jpg": b"\xff\xd8" + segment(0xDA, bytes(10)) + frame(0xC0),
        "cut.jpg": (b"\xff\xd8" + segment(0xE0, bytes(9)) + frame(0xC0))[:20],
        "x.webp": chunk(b"VP8X", bytes(4) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")) + tail,
        "lossy.webp": chunk(b"VP8 ", bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 640 | 1 << 14, 480) + bytes(9)),
        "lossless.webp": chunk(b"VP8L", b"\x2f" + (639 | 479 << 14).to_bytes(4, "little") + bytes(9)),
        "empty.png": b"", "other.png": b"GIF89a" + bytes(40),
    }
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
        asked = []
        headers.size_of(lambda at, n: asked.append(n) or raw[at : at + n])
        assert sum(asked) < 200
    got = {r.path: (r.width, r.height) for r in readers.image_sizes(spark, str(tmp_path)).collect()}
    broken = {"scan.jpg", "cut.jpg", "empty.png", "other.png"}
    assert got == {name: (None, None) if name in broken else (640, 480) for name in made if made[name]}


def test_ordered_write_and_manifest(spark, tmp_path):
    out, index = str(tmp_path / "out"), str(tmp_path / "index")
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("idx"), F.lit("x").alias("v"))
    rows = rows.unionByName(rows.sparkSession.range(3000).select(F.lit(77).cast("long").alias("idx"), F.col("id").cast("string").alias("v"))).repartition(5)
    writers.write_ordered(rows, out, "idx", files=6)
    parts = [spark.read.parquet(f).select("idx").toPandas()["idx"].tolist() for f in sorted(glob.glob(out + "/*.parquet"))]
    whole = [i for part in parts for i in part]
    assert whole == sorted([*range(5000), *[77] * 3000]) and len(parts) == 6 and max(map(len, parts)) < 3000
    writers.write_manifest(spark, out, "idx", index)
    assert sorted((r.low, r.high, r.n_rows) for r in spark.read.parquet(index).collect()) == sorted((p[0], p[-1], len(p)) for p in parts)
    some = writers.read_between(spark, out, index, "idx", 4990, 6000)
    assert sorted(r.idx for r in some.collect()) == list(range(4990, 5000)) and len(some.inputFiles()) == 1
    assert writers.read_between(spark, out, index, "idx", 9000, 9999).count() == 0


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    hop = "array<struct<image_id:string,bboxes:array<array<int>>>>"
    schema = f"idx long, answer string, evidence_chain {hop}, pred_text string"
    rows = [(i, "yes", [("img_0", [[0, 0, 9, 9]])], json.dumps({"answer": "yes" if i % 2 else "no", "evidence_chain": [{"image_id": "img_0", "bboxes": [[0, 0, 9, 9]]}]})) for i in range(10)]
    inbox, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    spark.createDataFrame(rows[:6], schema).write.mode("append").parquet(inbox)
    run = lambda: scorer.score_stream(spark.readStream.schema(schema).parquet(inbox), out, ckpt).awaitTermination()
    run()
    spark.createDataFrame(rows[4:], schema).write.mode("append").parquet(inbox)
    run()
    assert sorted(r["idx"] for r in spark.read.parquet(out).select("idx").collect()) == list(range(10))
    stream = spark.readStream.schema(spark.read.parquet(out).schema).parquet(out)
    scorer.summary_stream(stream, str(tmp_path / "sum"), str(tmp_path / "ckpt2")).awaitTermination()
    batch, live = scorer.final_summary(spark, out).first().asDict(), spark.read.parquet(str(tmp_path / "sum")).first().asDict()
    assert live == pytest.approx(batch) and batch["answer_em"] == 0.5
    parts = str(tmp_path / "parts")
    assert scorer.refresh_parts(spark, out, parts, 4) == 2 and scorer.refresh_parts(spark, out, parts, 4) == 0
    assert scorer.merged_summary(spark, parts).first().asDict() == pytest.approx(batch)
    spark.createDataFrame([(20, *rows[0][1:])], schema).write.mode("append").parquet(inbox)
    run()
    assert scorer.refresh_parts(spark, out, parts, 4) == 1  # only the new batch is read
    assert scorer.merged_summary(spark, parts).first().asDict() == pytest.approx(scorer.final_summary(spark, out).first().asDict())
    by_shard = {r["shard"]: r["n_scored"] for r in scorer.merged_summary(spark, parts, "shard").collect()}
    assert by_shard == {0: 4, 1: 3, 2: 2, 3: 2}


def test_stream_takes_files_of_any_age_and_repeats_nothing(spark, tmp_path):
    hop = "array<struct<image_id:string,bboxes:array<array<int>>>>"
    schema = f"idx long, answer string, evidence_chain {hop}, pred_text string"
    row = lambda i: (i, "yes", [("img_0", [[0, 0, 9, 9]])], json.dumps({"answer": "yes"}))
    inbox, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    count = lambda: sorted(r["idx"] for r in spark.read.parquet(out).select("idx").collect())

    def run(ids, age, where=ckpt):
        before = set(glob.glob(f"{inbox}/*.parquet"))
        spark.createDataFrame([row(i) for i in ids], schema).coalesce(1).write.mode("append").parquet(inbox)
        for f in set(glob.glob(f"{inbox}/*.parquet")) - before:
            os.utime(f, (time.time() + age,) * 2)
        scorer.score_stream(spark.readStream.schema(schema).parquet(inbox), out, where).awaitTermination()

    run([0, 1, 2, 2, None], 0)
    run([3, 4], -2 * 3600)
    run([0, 5, 6], 2 * 3600)
    run([1, 3, 7, 8], 0)
    assert count() == list(range(9))
    # A batch killed after its rows were written, and one killed before.
    forget = lambda number: [os.remove(f"{ckpt}/commits/{f}") for f in (str(number), f".{number}.crc")]
    forget(3)
    run([9], 0)
    assert count() == list(range(10))
    last = max(int(f) for f in os.listdir(f"{ckpt}/commits") if f.isdigit())
    (folder,) = glob.glob(f"{out}/query=*/batch={last}")
    forget(last)
    os.remove(f"{folder}/_SUCCESS")
    run([2, 10], -9 * 3600)
    assert count() == list(range(11))
    # A lost checkpoint: all files come again.
    run([11], 0, str(tmp_path / "ckpt2"))
    assert count() == list(range(12))


def test_containing_equals_searching_everything(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abé😀 .\n", k=rnd.randrange(0, 6)))
    texts = [(p, i, " ".join(word() for _ in range(rnd.randrange(0, 25)))) for p in range(4) for i in range(40)]
    needles = {(p, t[a : a + n]) for p, _, t in texts for n in (0, 1, 2, 3, 7, 8, 9, 30) for a in [rnd.randrange(0, len(t) + 1)]}
    needles |= {(p, word() + word()) for p in range(5) for _ in range(60)} | {(1, "aaaaaaaaaa"), (9, "a"), (1, "abababab")}
    texts += [(1, 100, "ab" * 200), (1, 101, ""), (1, 102, None), (2, 103, "ab" * 200)]
    got = containment.containing(
        spark.createDataFrame([*needles, (1, None), (1, "a")], "page_id int, needle string"),
        spark.createDataFrame(texts, "page_id int, text_id int, text string"),
    ).collect()
    want = Counter((p, n, i) for p, n in needles for q, i, t in texts if p == q and t is not None and n in t)
    assert Counter(map(tuple, got)) == want and sum(want.values()) > 1000


def test_last_well_formed_triple_asks(spark):
    rows = [(1, "E", 0, "director"), (1, "E", 1, None), (1, "F", 2, None), (1, None, 3, "x"), (2, "E", 0, "a_b"), (2, "E", 1, "c")]
    got = RO.sub_queries(spark.createDataFrame(rows, "sample_id int, entity string, pos int, relation string")).collect()
    assert {(r.sample_id, r.entity): r.sub_query for r in got} == {(1, "E"): "What is the director of E?", (2, "E"): "What is the c of E?"}


def test_bad_image_numbers_are_reported(spark):
    box = [[1, 1, 5, 5]]
    schema = "sample_id int, evidence_chain array<int>, target_chain array<struct<image_id:string,bboxes:array<array<int>>>>, sizes array<struct<width:int,height:int>>"
    rows = [(1, [1], [("img_-1", box)], [(9, 9)]), (2, [1], [("img_1", box)], [(9, 9)]), (3, [1], [("img_0", box)], [None]), (4, [1], [("img_0", box)], [(9, 9)]), (5, [1], [("img_0", box)], [(4, 9)])]
    got = {(r.sample_id, r.rule) for r in RO.record_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "image_index"), (2, "image_index"), (3, "image_index"), (5, "box_bounds")}


def test_invalid_samples_leave(spark):
    samples = spark.createDataFrame([(1, [("A", [[0, 0, 9, 9]])]), (2, [("A", [[0, 0, 11, 9]])]), (3, [("B", [[0, 0, 1, 1]])]), (4, [("A", [])])], "sample_id int, evidence_chain array<struct<entity:string,bboxes:array<array<int>>>>")
    meta = spark.createDataFrame([("A", 10, 10)], "entity string, width int, height int")
    assert [r.sample_id for r in A.valid_samples(samples, meta).collect()] == [1]


@pytest.mark.parametrize("keys", [[], [5], list(range(10)), [2**62, -(2**62), 0, 1, 2, 3], [7] * 9 + [8], [i * i for i in range(300)]])
def test_head_split_in_key_order(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "sample_id long")
    got = sorted((r.sample_id, r.split) for r in S.head_split(df).collect())
    n = int(len(keys) * 0.8)
    last = sorted(keys)[n - 1] if n else None
    assert got == sorted((k, "train" if n and k <= last else "test") for k in keys)
    if len(set(keys)) == 10:
        assert [r.split for r in S.head_split(df, cap=3).orderBy("sample_id").collect()] == ["train"] * 3 + ["test"] * 7


def test_values_run_over_buckets_of_one_long_run(spark, monkeypatch):
    """One run over many buckets, and buckets of buckets."""
    monkeypatch.setattr(L, "STEP_BUCKET", 3)
    log = [("r", s, s, float((s * 7919) % 101) if s % 4 else None) for s in range(100)]
    df = spark.createDataFrame(log, "run string, step long, pos long, value double")
    saves = spark.createDataFrame([("r", s) for s in range(0, 100, 5)], "run string, step long")
    known = {}
    for _, s, _, v in log:
        known[s] = v if v is not None else known.get(s - 1)
    assert {r.step: r.value for r in L.metric_asof(df, saves).collect()} == {s: known[s] for s in range(0, 100, 5)}
    top, want = None, {}
    for _, s, _, v in log:
        if v is not None:
            want[s] = top is None or v > top
            top = v if want[s] else top
    assert {r.step: r.is_best for r in L.best_flags(df).collect()} == want


def test_first_rows_pairs_and_hops(spark):
    """Small operators that no registered query reaches."""
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "idx long, v string")
    assert [r.idx for r in E.first_rows(rows, 2).collect()] == [1] and E.first_rows(rows, -1).count() == 3
    pred = spark.createDataFrame([([(2, "img_0", [[1.0, 2.0, 3.0, 4.0]])],)], f"c {J.CHAIN_TYPE}")
    assert [tuple(h) for h in pred.select(J.hop_boxes(F.col("c")).alias("h")).first()["h"]] == [(2, [[1.0, 2.0, 3.0, 4.0]])]


def test_sinks_write_what_readers_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x" * 9, 1), (2, "y", 0)], "idx long, pred_text string, answer_em int")
    writers.append_results(rows, str(tmp_path / "r"))
    writers.append_results(rows.limit(1), str(tmp_path / "r"), text_chars=3)
    got = sorted((r.idx, len(r.pred_text)) for r in spark.read.json(str(tmp_path / "r")).collect())
    assert len(got) == 3 and sum(n for _, n in got) in (13, 11)
    writers.write_dataset(rows, str(tmp_path / "d"), by="answer_em")
    assert sorted(r.idx for r in spark.read.parquet(str(tmp_path / "d")).where("answer_em = 1").collect()) == [1]
    writers.write_report(rows.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "report"))
    assert [r.n for r in spark.read.json(str(tmp_path / "report")).collect()] == [2]


def test_layout_reader(spark, tmp_path):
    page = {"page_width": 9, "page_height": 8, "num_elements": 1, "elements": [{"tag": "P", "text": "hi", "bcr": [0, 0, 5, 5], "float": "none"}]}
    for n in ("a", "b"):
        (tmp_path / f"{n}_layout.json").write_text(json.dumps(page))
    rows = readers.read_layouts(spark, str(tmp_path)).orderBy("page_id").collect()
    assert len(rows) == 2 and rows[0]["elements"][0]["text"] == "hi"


@pytest.mark.parametrize("size", [100, 1 << 20])
def test_json_objects_of_one_file_in_many_tasks(spark, tmp_path, size):
    """Braces, quotes and backslashes in texts, objects over many splits, scalars between them, other file forms."""
    rnd = random.Random(size)
    odd = ["{", "}", "[", "]", '"', "\\", "\\\\", '\\"', "},{", "\n", "é", "😀", "}" * 5, "\\}", ":", ",", " "]
    text = lambda n: "".join(rnd.choice(odd) for _ in range(rnd.randrange(n)))
    made = [{"k": i, "s": text(30), "o": {"a": [text(5), {"b": text(5)}], text(4) or "x": None}} for i in range(20)] + [{"k": 60, "s": text(400), "o": {}}, {}]
    listed, spaced, lines = (tmp_path / n for n in ("a.json", "b.json", "c.json"))
    listed.write_text(json.dumps(made, ensure_ascii=False))
    spaced.write_text("﻿ \n" + json.dumps(made, indent=2).replace("\n  {\n    \"k\": 7,", '\n 1, null, "a{b}", -2.5e3, {"k": 7,'))
    lines.write_text("\n".join(map(json.dumps, made)))
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "cut.json").write_text('[{"k": 1, "s": "x"}, {"k": 2, "s": "y')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        for path in (listed, spaced, lines):
            rows = json_objects.split_objects(spark, str(path)).orderBy("ord").collect()
            assert [json.loads(r.value) for r in rows] == made and [r.ord for r in rows] == list(range(len(made)))
        whole = json_objects.split_objects(spark, str(tmp_path))
        assert whole.count() == 3 * len(made) + 1
        read = readers.read_json_array(spark, str(listed), "k long, s string, o string").collect()
        want = spark.read.schema("k long, s string, o string").option("multiLine", True).json(str(listed)).collect()
        shown = lambda rows: sorted(json.dumps([r.k, r.s, r.o and json.loads(r.o)], sort_keys=True) for r in rows)
        assert shown(read) == shown(want) and len(want) == len(made)
        parts = spark.read.option("lineSep", "}").text(str(listed)).rdd.getNumPartitions()
        assert parts > 20 if size == 100 else parts >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert readers.read_json_array(spark, str(tmp_path / "empty.json"), "k long").count() == 0


def test_box_scores_equal_all_comparisons(spark):
    """Each pair is compared once; recall, precision and flags are those of comparing all pairs again."""
    rnd = random.Random(9)
    box = lambda: (lambda x, y: [float(x), float(y), float(x + rnd.randint(1, 12)), float(y + rnd.randint(1, 12))])(rnd.randint(0, 20), rnd.randint(0, 20))

    def match(p, g):
        w, h = min(p[2], g[2]) - max(p[0], g[0]), min(p[3], g[3]) - max(p[1], g[1])
        inter = max(0, w) * max(0, h)
        area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
        inside = g[0] <= (p[0] + p[2]) / 2 <= g[2] and g[1] <= (p[1] + p[3]) / 2 <= g[3]
        return inter / (area(p) + area(g) - inter) >= 0.3 or inside

    rows = [(i, [box() for _ in range(rnd.randint(0, 5))], [box() for _ in range(rnd.randint(0, 5))]) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, p array<array<double>>, g array<array<double>>")
    got = {r.i: r.s for r in df.select("i", scoring.bbox_stats(F.col("p"), F.col("g")).alias("s")).collect()}
    for i, p, g in rows:
        found = sum(any(match(a, b) for a in p) for b in g)
        right = sum(any(match(a, b) for b in g) for a in p)
        nothing, one_sided = not p and not g, not p or not g
        want = (1, 1, 1, 1) if nothing else (0, 0, 0, 0) if one_sided else (found / len(g), right / len(p), int(found == len(g)), int(found > 0))
        assert tuple(got[i])[:4] == pytest.approx(want) and (got[i].n_gt, got[i].n_pred) == (len(g), len(p))


def test_samples_within_their_pages(spark):
    """The check on the chain's own sizes equals the one that joins the pages."""
    chain = "array<struct<entity:string,width:int,height:int,bboxes:array<array<int>>>>"
    hop = lambda w, h, *b: ("A" if w else "N", w, h, [list(x) for x in b])
    rows = [(1, [hop(10, 10, (0, 0, 9, 9))]), (2, [hop(10, 10, (0, 0, 11, 9))]), (3, [hop(None, None, (0, 0, 1, 1))]), (4, [hop(10, 10)]), (5, []), (6, None), (7, [hop(10, 10, (1, 1, 2, 2)), hop(10, 10, (5, 5, 2, 9))]), (8, [("A", 10, 10, None)])]
    samples = spark.createDataFrame(rows, f"sample_id int, evidence_chain {chain}")
    meta = spark.createDataFrame([("A", 10, 10), ("N", None, None)], "entity string, width int, height int")
    ids = lambda df: sorted(r.sample_id for r in df.collect())
    assert ids(A.samples_within_pages(samples)) == ids(A.valid_samples(samples, meta)) and 1 in ids(A.samples_within_pages(samples))


def test_reconcile_report_counts_hops_before_and_after(spark):
    rows = spark.createDataFrame([("same", [1, 2]), ("changed", [1]), ("missing_hop", [1, 2, 3]), ("same", [])], "status string, evidence_chain array<int>")
    assert {tuple(r) for r in A.reconcile_report(rows).collect()} == {("same", 2, 2, 2), ("changed", 1, 1, 1), ("missing_hop", 1, 3, 0)}


def test_table_functions_equal_the_operators(spark):
    register.register(spark)
    entry = "array<struct<entity:string,screenshot:string,bboxes:array<array<int>>,sentence_ids:array<int>>>"
    rows = [(1, "q", "a", "t", None, [("A", "a.png", [[1, 2, 3, 4]], [0]), ("B", "b.png", [], None)]), (2, "q", "a", None, None, [("C", "c.png", [[1, 1, 2, 2], [3, 3, 4, 4]], [1])]), (3, "q", "a", "t", None, []), (4, "q", "a", "t", None, None)]
    samples = spark.createDataFrame(rows, f"sample_id int, question string, answer string, type string, evidences array<struct<entity:string,relation:string,value:string>>, evidence_chain {entry}")
    samples.createOrReplaceTempView("bt_samples")
    got = spark.sql("SELECT sample_id, e.hop_pos, e.evidence_chain FROM bt_samples s, LATERAL bt_expand(s.evidence_chain) e").collect()
    none = spark.createDataFrame([], "sample_id int, hop_pos int, question string, answer string, target_sentence string, bbox array<int>, entity string, screenshot string, sentence_ids array<int>")
    want = G.expand_single_hop(samples, none).select("sample_id", "hop_pos", "evidence_chain").collect()
    assert len(want) == 3 and sorted(map(str, got)) == sorted(map(str, want))

    spark.createDataFrame([(1, [(2, "img_0", [[1.0, 2.0, 3.0, 4.0], [5.0]]), (None, "img_1", [])]), (2, None)], f"id int, c {J.CHAIN_TYPE}").createOrReplaceTempView("bt_chains")
    hops = spark.sql("SELECT id, h.* FROM bt_chains t, LATERAL bt_hops(t.c) h ORDER BY hop_pos").collect()
    assert [(r.id, r.hop_pos, r.hop, r.image_id) for r in hops] == [(1, 0, 2, "img_0"), (1, 1, 2, "img_1")]
    boxes = spark.sql("SELECT id, b.* FROM bt_chains t, LATERAL bt_hops(t.c) h, LATERAL bt_boxes(h.bboxes) b").collect()
    assert [tuple(r) for r in boxes] == [(1, 0, 1.0, 2.0, 3.0, 4.0)]


def test_pairs_mismatches_and_manifest(spark, tmp_path):
    pred = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "idx int, pred string")
    gold = spark.createDataFrame([(2, "a"), (3, "b"), (4, "c")], "idx int, gold string")
    assert sorted(map(tuple, E.pair_by_index(pred, gold).collect())) == [(2, "q", "a"), (3, "r", "b")]
    assert sorted(map(tuple, E.count_mismatch(pred, gold).collect())) == [(1, "no_gold"), (4, "no_prediction")]
    inbox, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    files = lambda names: spark.createDataFrame([(n, 5) for n in names], "path string, n_rows int").write.mode("append").parquet(inbox)
    run = lambda: scorer.manifest_stream(spark.readStream.schema("path string, n_rows int").parquet(inbox), out, ckpt).awaitTermination()
    files(["a", "b"])
    run()
    run()
    files(["c"])
    run()
    assert sorted(map(tuple, spark.read.schema("path string, n_rows int").json(out).collect())) == [("a", 5), ("b", 5), ("c", 5)]


def test_training_records_with_candidates(spark):
    """Train split with candidates, permutation, jitter and lenient sizes; positions follow the candidates."""
    chain = "array<struct<entity:string,screenshot:string,bboxes:array<array<int>>,sentence_ids:array<int>>>"
    rows = [(i, "q", "a", [("A", "a.png", [[10, 10, 100, 100]], [0]), ("B", "b.png", [[0, 0, 50, 60]], [1])], ["c.png", "b.png", "a.png"]) for i in range(20)]
    samples = spark.createDataFrame(rows, f"sample_id long, question string, answer string, evidence_chain {chain}, candidates array<string>")
    images = spark.createDataFrame([("a.png", 1000, 800), ("b.png", 640, 640)], "path string, width int, height int")
    made = lambda **more: RO.build_training_records(samples, images, split="train", resolutions=[512, 768], seed=1, **more)
    assert made().count() == 0  # c.png is missing
    kept = made(lenient=True, evidence_permutation=True, spatial_augmentation=True).collect()
    assert len(kept) == 20 and {tuple(r.gold_image_ids) for r in kept} == {("img_2", "img_1")}
    widths = {r.plans[0]["nw"] for r in kept}
    assert all(r.plans[0]["w"] == 1024 and r.plans[0]["h"] == 768 and 432 <= r.plans[0]["nw"] <= 845 for r in kept) and len(widths) > 4
    for r in kept:
        for e, p in zip(r.evidence_chain, (r.plans[2], r.plans[1])):
            assert e["bboxes"] and all(0 <= b[0] <= b[2] <= p["nw"] and 0 <= b[1] <= b[3] <= p["nh"] for b in e["bboxes"])
    moved = made(lenient=True, evidence_permutation=True, preserve_evidence_order=False).collect()
    assert {tuple(r.gold_image_ids) for r in moved} == {("img_2", "img_1"), ("img_1", "img_2")}
    plain = RO.build_training_records(samples.drop("candidates"), images, split="train", evidence_permutation=True, seed=1).collect()
    assert len(plain) == 20 and {tuple(r.gold_image_ids) for r in plain} == {("img_0", "img_1")} and len({r.evidence_chain[0]["entity"] for r in plain}) == 2


def test_long_pages_are_searched_by_the_index_with_the_same_rows(spark):
    """Short pages are joined directly, long ones go through the index; both carry columns of either side."""
    texts = spark.createDataFrame([(p, i, f"t{i % 7} word{i} end", i * 2) for p, n in ((1, 12), (2, 5), (3, 9)) for i in range(n)], "page_id int, text_id int, text string, box int")
    needles = spark.createDataFrame([(p, s, v) for p in (1, 2, 3, 4) for s, v in enumerate(["t1 word1", "t1 word1", "word", "", "zz", None])], "page_id int, sid int, needle string")
    rows = lambda limit: sorted(map(tuple, containment.containing(needles, texts, needle_carry=("sid",), text_carry=("box",), direct_limit=limit).collect()))
    plan = containment.containing(needles, texts)._jdf.queryExecution().optimizedPlan().toString()
    assert rows(0) == rows(8) == rows(100) and len(rows(8)) == 26 * 2 + 3 * 2
    assert "Generate" not in plan  # no gram of a short page becomes a row


def test_repeated_words_are_counted_in_linear_time(spark):
    texts = ["b a b a b", "", None, "a " * 30_000, "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tagged_tokens(T.word_tokens(F.col("t"))).alias("g"))
    got = [sorted(r.g or []) for r in df.collect()]
    assert got == [["a#0", "a#1", "b#0", "b#1", "b#2"], [], [], sorted(f"a#{i}" for i in range(30_000)), ["x#0"]]


def test_paragraphs_of_short_and_long_pages_are_picked_alike(spark):
    """Direct comparison and index give the same rows, and no word of a short page becomes a row."""
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice(["w1", "w2", "w3", "the", "Of", "w4,"]) for _ in range(n))
    paras = spark.createDataFrame([(p, o, text(rnd.randint(6, 15)), 0, 10 * o, 100, 10 * o + 8) for p, n in ((1, 4), (2, 30), (3, 12)) for o in range(n)], PARA)
    targets = spark.createDataFrame(
        [(p, f"{p}-{i}", text(2), text(rnd.randint(0, 6))) for p in (1, 2, 3, 4, None) for i in range(12)], "page_id long, target_id string, value string, text string"
    )
    pages = spark.createDataFrame([(1, 1_000), (2, None), (3, 50)], "page_id long, image_height int")
    made = lambda limit: G.pick_paragraphs(targets, paras, pages, limit)
    rows = [Counter(map(tuple, made(limit).collect())) for limit in (0, 10, 1_000)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 60
    assert "Generate" not in made(1_000)._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_of_short_long_and_cut_pages_are_grounded_alike(spark, monkeypatch):
    """Page by page, through the index and through an index cut into blocks; no word or gram becomes a row."""
    rnd = random.Random(11)
    text = lambda n: " ".join(rnd.choice(["alpha", "beta", "Gamma", "of", "été", "d3lta"]) + rnd.choice(["", "", ",", "😀"]) for _ in range(n))
    paras = spark.createDataFrame([(p, o, text(rnd.randint(1, 12)), 0, 10 * o, rnd.choice([60, 90]), 10 * o + 8) for p, n in ((1, 3), (2, 40), (3, 15)) for o in range(n)], PARA)
    asked = [(p, s, text(rnd.randint(1, 6))) for p in (1, 2, 3, 4) for s in range(15)] + [(2, 90, None), (2, 91, " "), (None, 1, "alpha"), (1, 92, "zzzz")]
    sentences = spark.createDataFrame(asked, "page_id long, sid int, sent string")
    made = lambda limit: G.ground_sentences(sentences, paras, direct_limit=limit)
    rows = lambda limit: Counter((r.page_id, r.sid, r.para_ord, r.x2, r.similarity) for r in made(limit).collect())
    direct = rows(1_000)
    assert "Generate" not in made(1_000)._jdf.queryExecution().optimizedPlan().toString()
    assert rows(10) == direct and len(direct) > 40
    monkeypatch.setattr("boxtrail.operators.page_scores.BLOCK", 4)
    assert rows(0) == direct
    parts = {(r.page_id, r.sid, r.para_ord): r.similarity for r in G.page_similarities(sentences, paras).collect()}
    assert len(parts) == 15 * (3 + 40 + 15) + 3 and all(parts[p, s, o] == v for p, s, o, _, v in direct if v is not None)


def test_heavy_rows_are_spread_by_their_number(spark):
    few = spark.range(0, 1_000, 1, 1)
    assert runtime.spread(few, 10).rdd.getNumPartitions() == 100 and runtime.spread(few, 10).count() == 1_000
    assert runtime.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_same_deck_meets_short_lists(spark):
    """A sample is joined with one short list per gold page, whatever the number of images on the pages around."""
    names = [f"d__page_{p}.{i}.png" for p in range(1, 9) for i in range(30)]
    samples = spark.createDataFrame([(1, [names[0], names[200]]), (2, ["d__page_4.zz.png"]), (3, [names[35], names[35]])], "sample_id long, gold array<string>")
    pool = spark.createDataFrame([(n,) for n in names] + [("d__page_4.0.png",)], "screenshot string")
    made = S.same_deck_distractors(samples, pool, 4)
    got = {r[0]: r[1] for r in made.collect()}
    assert got[1] == ["d__page_1.1.png", "d__page_1.10.png"]
    assert got[2] == ["d__page_4.0.png", "d__page_4.0.png", "d__page_4.1.png"]
    assert got[3] == ["d__page_2.0.png", "d__page_2.1.png"]
    plan = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "Generate explode(sequence" in x and "sample_id" in x]


def test_candidates_build_their_samples_once(spark):
    """What makes the samples runs once for all branches and once for the rows that leave."""
    from pyspark.sql.types import StringType

    calls = spark.sparkContext.accumulator(0)

    def shot(i):
        calls.add(1)
        return f"d__page_{i}.png"

    named = F.udf(shot, StringType()).asNondeterministic()
    rows = spark.range(20).select(F.col("id").alias("sample_id"), F.array(F.struct(named("id").alias("screenshot"))).alias("evidence_chain"))
    made = S.build_candidates(rows, 3, strategy="same_deck")
    assert {r[0]: len(r[1]) for r in made.select("sample_id", "candidates").collect()} == {i: 3 for i in range(20)}
    assert calls.value <= 40


def test_routes_of_entities_are_found_from_distinct_entities(spark):
    """Where the pages are too many to be sent to all tasks, facts are counted out before they meet them."""
    from boxtrail.plans import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["cached_route"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    last = lambda word: max(i for i, x in enumerate(plan) if word in x)
    assert last("Aggregate") > last("LeftSemi")


def test_hops_ask_each_question_once_and_keep_every_state(spark, tmp_path):
    """Hops of unknown pages and equal questions move nowhere: pages and answers are met by one join each."""
    hop = lambda name, sid: {"entity": name, "screenshot": f"{name}.png", "sentence_ids": [sid] if sid is not None else []}
    ask = lambda name: {"entity": name, "relation": "director", "value": "the long red house"}
    chains = [[hop("a", 0)], [hop("a", 0)], [hop("b", 0)], [hop("gone", 0)], [hop("a", None)], [hop("a", 0)]]
    triples = [[ask("a")], [ask("a")], [ask("b")], [ask("gone")], [ask("a")], [ask("zz"), {"entity": "a", "relation": None, "value": "x"}]]
    samples = spark.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate(zip(chains, triples))],
        "sample_id long, evidence_chain array<struct<entity:string,screenshot:string,sentence_ids:array<int>>>, "
        "evidences array<struct<entity:string,relation:string,value:string>>",
    )
    text = "one and two saw the long red house on a far hill"
    context = spark.createDataFrame([("a", 0, text), ("b", 0, text), ("gone", 0, text)], "entity string, sid int, sent string")
    pages = spark.createDataFrame(
        [("a.png", 1, None, "ok"), ("b.png", 2, None, "bad")], "screenshot string, page_id long, image_height int, side_table string"
    )
    paras = spark.createDataFrame([(1, 0, text, 0, 0, 500, 50), (1, 1, "no words here", 0, 60, 500, 90)], PARA)
    resolved = G.resolve_hops(samples, context, pages, paras)
    got = {(r.sample_id, r.hop_pos): (r.status, r.para_ord, r.target_sentence) for r in resolved.collect()}
    assert got == {
        (0, 0): ("val_match", 0, text), (1, 0): ("val_match", 0, text), (2, 0): ("bad_bboxes_file", None, text),
        (3, 0): ("no_bboxes_file", None, text), (4, 0): ("no_target_sent", None, ""),
        (5, 0): ("no_chain_entry", None, ""), (5, 1): ("malformed_triple", None, ""),
    }
    # Where only boxes are wanted, the hops meet no table of sentences and those of unknown pages leave first.
    counted = resolved.where("bbox IS NOT NULL").select("sample_id")
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "of_sent" not in plan
    assert sorted(r.sample_id for r in counted.collect()) == [0, 1]


def test_only_sentences_of_asked_numbers_move(spark, monkeypatch):
    """Long pages with few cited sentences: the others stay where they are. No number asked and no question at all are fine."""
    made = {}

    def watched(df, name):
        made[name] = df
        return runtime.materialize(df, name)

    monkeypatch.setattr(G, "materialize", watched)
    shape = "sample_id long, evidence_chain array<struct<entity:string,screenshot:string,sentence_ids:array<int>>>, evidences array<struct<entity:string,relation:string,value:string>>"
    hops = lambda asked: spark.createDataFrame([(i, [(n, f"{n}.png", ids)], [(n, "director", "the long red house")]) for i, (n, ids) in enumerate(asked)], shape)
    text = "one and two saw the long red house on a far hill"
    context = spark.createDataFrame([("a", i, f"{text} {i}") for i in range(50)], "entity string, sid int, sent string")
    pages = spark.createDataFrame([("a.png", 1, None, "ok")], "screenshot string, page_id long, image_height int, side_table string")
    paras = spark.createDataFrame([(1, 0, text, 0, 0, 500, 50)], PARA)
    seen = lambda asked: [
        (r.sample_id, r.status, r.target_sentence) for r in G.resolve_hops(hops(asked), context, pages, paras).orderBy("sample_id").collect()
    ]
    assert seen([("a", [7]), ("a", [3]), ("a", None), ("gone", [40])]) == [
        (0, "val_match", f"{text} 7"), (1, "val_match", f"{text} 3"), (2, "no_target_sent", ""), (3, "no_bboxes_file", ""),
    ]
    plan = made["hop_questions"]._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"sid#\d+ >= 3\b", plan) and re.search(r"sid#\d+ <= 7\b", plan)
    assert seen([("a", None)]) == [(0, "no_target_sent", "")] and seen([("gone", [1])]) == [(0, "no_bboxes_file", "")]


def test_stream_batches_are_dealt_out_by_rows(spark, monkeypatch):
    """A batch of many files is not scored by a fixed number of tasks; rows of one index stay together."""
    monkeypatch.setattr(scorer, "ROWS_PER_TASK", 10)
    batch = spark.range(0, 100).select(F.when(F.col("id") % 10 > 0, F.col("id") % 50).alias("idx")).coalesce(1)
    dealt = scorer.by_index(batch)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 90
    places = dealt.select("idx", F.spark_partition_id().alias("p")).distinct()
    assert places.count() == dealt.select("idx").distinct().count() == 45


def test_sub_queries_are_made_once_per_record(spark):
    """The look-up of image sizes reads the screenshots only."""
    hop = "struct<entity:string,screenshot:string,bboxes:array<array<int>>,sub_query:string,image_id:string>"
    triple = "struct<entity:string,relation:string,value:string>"
    rows = [(1, "q", "a", [("e", "s.png", [[0, 0, 9, 9]], None, None), ("f", "s.png", [[0, 0, 9, 9]], " given ", None)], [("e", "director", "x"), ("e", None, "y")])]
    samples = spark.createDataFrame(rows, f"sample_id long, question string, answer string, evidence_chain array<{hop}>, evidences array<{triple}>")
    images = spark.createDataFrame([("s.png", 100, 100)], "path string, width int, height int")
    made = RO.build_training_records(samples, images, split="val").select("sample_id", "target_text")
    assert [e["sub_query"] for e in json.loads(made.first().target_text)["evidence_chain"]] == ["What is the director of e?", "given"]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("What is the ") == 1
