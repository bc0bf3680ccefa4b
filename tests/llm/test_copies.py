"""Near-duplicates, components, repeated strings and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from boxtrail.llm import bagminhash, parsing, repeats
from boxtrail.llm.components import components
from tests.llm.conftest import AWKWARD, PROSE, SF

WIDTH = repeats.WIDTH


def classes_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def plain_shingles(text):
    """Runs of five words; the whole of a shorter text."""
    words = re.findall(r"[^\W_]+", text.lower())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])


def plain_classes(texts):
    keys = sorted(texts)
    bags = [Counter(plain_shingles(texts[k] or "")) for k in keys]
    holders = defaultdict(set)
    for o, bag in enumerate(bags):
        for x in bag:
            holders[x].add(o)
    links = [(i, j) for i in range(len(keys)) for j in range(i) if (texts[keys[i]] or "") == (texts[keys[j]] or "")]
    for i, bag in enumerate(bags):
        for j in {j for x in bag for j in holders[x] if j < i}:
            if (bag & bags[j]).total() >= 0.8 * (bag | bags[j]).total():
                links.append((i, j))
    return {keys[i]: keys[r] for i, r in classes_of(range(len(keys)), links).items()}


def test_near_duplicate_query(spark, docs):
    rows = bagminhash.op3_near_duplicates(spark, SF).collect()
    want = plain_classes(docs[1])
    assert {r.doc_id: r.class_id for r in rows} == want
    sizes = Counter(want.values())
    assert all(r.class_docs == sizes[r.class_id] and r.keep == (r.class_id == r.doc_id) for r in rows)


def test_signature_estimates_are_unbiased():
    rnd = random.Random(5)
    texts = []
    for k in range(60):
        words = [f"{k}w{i % 40 if i % 7 == 0 else i}" for i in range(300)]
        other = list(words)
        for _ in range(k):
            other[rnd.randrange(300)] = f"x{rnd.random()}"
        texts += [" ".join(words) + f" spam{k}" * (3 * k + 9), " ".join(other) + f" spam{k}" * (5 * k + 9)]
    sig = bagminhash.signatures(*bagminhash.shingles(texts), len(texts))
    guess = (sig[::2] == sig[1::2]).mean(axis=1)
    true = np.array([bagminhash.overlap(a, b) for a, b in zip(texts[::2], texts[1::2])])
    assert abs((guess - true).mean()) < 0.02 and (guess - true).std() < 0.05 and true.min() < 0.5


def test_signatures_do_not_depend_on_the_batch():
    texts = [PROSE * 2, "a b c", "", PROSE + "tail end of it all"]
    one = bagminhash.signatures(*bagminhash.shingles(texts), len(texts))
    many = bagminhash.signatures(*bagminhash.shingles(texts[::-1] * 300), 1200)
    assert np.array_equal(one, many[-4:][::-1])


def test_overlap_counts_the_multiset():
    assert bagminhash.overlap("a b c d e f", "a b c d e") == 0.5
    assert bagminhash.overlap("x " * 14, "x " * 9) == 0.5
    assert bagminhash.overlap("A b", "a, B!") == 1.0 and bagminhash.overlap("a", "b") == 0.0


def test_pairs_beyond_the_pivot_are_found(spark):
    """A chain whose ends are unlike, and a bucket in blocks: every link between components counts."""
    rnd = random.Random(6)
    words = [str(rnd.random()) for _ in range(400)]
    texts = {}
    for k in range(12):
        w = list(words)
        w[: 8 * k] = [f"{k // 2}-{i}" for i in range(8 * k)]
        texts[k] = " ".join(w)
    want = plain_classes(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for block in (512, 2):
        bagminhash.BLOCK = block
        try:
            assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(df).collect()} == want
        finally:
            bagminhash.BLOCK = 512


def test_near_duplicate_edges(spark, awkward, empty):
    rows = bagminhash.near_duplicates(awkward).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert by[1].class_id == by[2].class_id == 1 and by[2].class_docs >= 3
    assert by[4].class_id == by[5].class_id == 4 and by[6].class_id == 6 and by[7].class_id == 7
    kept = bagminhash.without_near_duplicates(awkward)
    got = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == awkward.columns and got[1] == 1 and not got[2] and got[None] == 1 and got[4] == 1 and not got[5]
    assert bagminhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(99, 98), (98, 97)], [(i, i % 7) for i in range(100)]])
def test_components(spark, links):
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == classes_of(nodes, [(a, b) for a, b in links if a != b])


def plain_repeats(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[d] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def found(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_repeat_query(spark, docs):
    assert found(repeats.op9_repeated_strings(spark, SF).collect()) == plain_repeats(docs[1])


@pytest.mark.parametrize("group", [repeats.GROUP, 3])
def test_repeats_in_repetitive_texts(spark, group):
    rnd = random.Random(7)
    parts, texts = ["aa", "b", "the ", "é", "xyz ", "\n", "of "], {}
    for i in range(250):
        old = (texts[rnd.randrange(i)] or "") if i else ""
        at = rnd.randrange(len(old) + 1)
        texts[i] = rnd.choice((old[:at] + rnd.choice(parts) + old[at:], rnd.choice(parts) * rnd.randrange(400), old[20:260] + old[:150], None, "".join(rnd.choice(parts) + str(rnd.randrange(9)) for _ in range(rnd.randrange(160)))))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert found(repeats.remove_repeats(df, group).collect()) == plain_repeats(texts)


def test_repeats_across_blocks_of_a_long_text(spark, monkeypatch):
    rnd = random.Random(8)
    piece = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    texts = {1: piece + "".join(rnd.choice("xyz") for _ in range(900)) + piece, 2: "q" + piece[100:400], 3: "z" * 5000}
    want = plain_repeats(texts)
    for size in (repeats.MAX_BLOCK, 333):
        monkeypatch.setattr(repeats, "MAX_BLOCK", size)
        monkeypatch.setattr(repeats, "CHUNK", min(size, repeats.CHUNK))
        starts = defaultdict(set)
        raw = [texts[d].encode() for d in sorted(texts)]
        for lo, hi, at, block, sizes in repeats._blocks(raw):
            p, _ = parsing.parse(np.frombuffer(block, np.uint8), sizes, WIDTH)
            base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            for d, a, b in zip(p.doc, p.first, p.last):
                new = set(range(a - base[d] + at, b - base[d] + at + 1))
                assert not new & starts[lo + d]
                starts[lo + d] |= new
        assert all(starts[i] == set(range(len(x) - WIDTH + 1)) for i, x in enumerate(raw))
    monkeypatch.undo()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(repeats.remove_repeats(df).collect()) == want


def test_equal_strings_share_trigger_and_offset():
    rnd = random.Random(9)
    core = bytes(rnd.choice(b"abcd ") for _ in range(400))
    raw = [bytes(rnd.choice(b"wxyz") for _ in range(k)) + core + b"!" * k for k in (0, 1, 50, 333)]
    names = []
    for r in raw:
        p, _ = parsing.parse(np.frombuffer(r, np.uint8), np.array([len(r)]), WIDTH)
        at = r.index(core)
        own = {}
        for a, b, t, name in zip(p.first, p.last, p.trigger, p.name):
            own |= {s - at: (t - s, name) for s in range(a, b + 1)}
        names.append([own[s] for s in range(len(core) - WIDTH + 1)])
    assert all(n == names[0] for n in names)


def test_repeat_edges(spark, awkward, empty):
    rows = repeats.remove_repeats(awkward, keep_text=True).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert {r.n_bytes for r in rows if r.doc_id in (4, 5)} == {0} and by[4].kept_sha256 == hashlib.sha256(b"").hexdigest()
    same = [(1, "".join(map(str, range(100)))), (1, "".join(map(str, range(100)))), (1, "other text " * 3), (2, "".join(map(str, range(99))))]
    out = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(same, "doc_id long, text string")).collect())
    assert out == [(1, 33, 0), (1, 190, 0), (1, 190, 0), (2, 188, 188)]  # equal rows are one document
    assert by[2].n_removed == by[2].n_bytes and by[10].n_removed == by[10].n_bytes - len(by[10].kept) > 149_000
    assert repeats.remove_repeats(empty).count() == 0


def test_pipeline(spark, docs):
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["language", "near_duplicates", "benchmark", "secrets", "packing"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    now, seen = table, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == table.columns
        rows = now.collect()
        seen[name] = {r.doc_id: r for r in rows}
        assert len(seen[name]) == len(rows)
        now = spark.createDataFrame(rows, table.schema)
    want = plain_classes({d: r.text for d, r in seen["language"].items()})
    assert len(seen["language"]) >= len(docs[1]) - 2
    assert set(seen["near_duplicates"]) == set(want.values())
    assert set(seen["benchmark"]) < set(seen["near_duplicates"]) and set(seen["secrets"]) == set(seen["benchmark"])
    assert all(r.text == seen["benchmark"][d].text or "[secret]" in r.text for d, r in seen["secrets"].items())
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen["secrets"])


def test_pipeline_edges(spark, awkward, write):
    tables = {"documents": awkward, "benchmark": spark.createDataFrame([(1, "hunter2hunter2 mail a.b@c.example.org")], "item_id long, text string")}
    rows = corpus_pipeline.run(spark, write(**tables)).collect()
    left = {r.doc_id for r in rows}
    assert 1 in left and 2 not in left and 9 not in left and not left & {4, 5, 6, 7}
    assert corpus_pipeline.run(spark, write(documents=awkward.where("doc_id > 1000"), benchmark=tables["benchmark"])).count() == 0


def test_bags_leave_with_their_task():
    """A Python worker that has compared texts holds none of their bags afterwards."""
    import gc

    import numpy as np
    import pandas as pd

    from boxtrail.llm import bagminhash

    texts = [f"text {i} " + "of words that follow one another " * 40 for i in range(200)]
    gc.collect()
    before = {id(x) for x in gc.get_objects() if isinstance(x, tuple) and len(x) == 2 and all(isinstance(y, np.ndarray) for y in x)}
    got = pd.concat(bagminhash.similarity.func(iter([(pd.Series(texts), pd.Series(texts[1:] + texts[:1]))])))
    assert len(got) == 200 and got.between(0.5, 1).all()
    gc.collect()
    assert not [x for x in gc.get_objects() if isinstance(x, tuple) and len(x) == 2 and all(isinstance(y, np.ndarray) for y in x) and id(x) not in before]
    assert not [n for n, v in vars(bagminhash).items() if hasattr(v, "cache_info") and v.cache_info().currsize]
