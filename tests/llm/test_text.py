"""Token counts, packing, quality rules, language ID and decontamination."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtrail.llm import decontam, langid, packing, quality, token_counts
from boxtrail.llm.common import encoder, slices
from tests.llm.conftest import AWKWARD, PROSE, SF


@pytest.fixture(scope="module")
def ids(docs):
    """Token ids of every document, by the tokenizers library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    keys = list(docs[1])
    return dict(zip(keys, (e.ids for e in tokenizer.encode_batch([docs[1][k] for k in keys], add_special_tokens=False))))


def test_slices_keep_all_texts_and_order():
    assert list(slices(["aa", None, "bbbb", "", "c" * 9, "d"], 5)) == [(0, 2), (2, 4), (4, 5), (5, 6)]
    assert list(slices([], 5)) == []


def test_encoder_equals_the_tokenizers_library(ids, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder()
    odd = ["", " ", "a<|endoftext|>b", "é😀‍", "x" * 3000, "\n\n \t z", "I'LL we've", "12345 ١٢٣", "\x00\x01", "日本語 text"]
    assert all(encode(t) == tokenizer.encode(t, add_special_tokens=False).ids for t in odd)
    assert all(encode(docs[1][k]) == v for k, v in ids.items())


def test_histogram_query(spark, ids):
    lengths = np.array([len(v) for v in ids.values()])
    rows = token_counts.op1_token_histogram(spark, SF).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(lengths.tolist())
    for r in rows:
        cut = np.minimum(lengths, r.n_tokens)
        want = ((lengths >= r.n_tokens).sum(), lengths[lengths >= r.n_tokens].sum(), (lengths <= r.n_tokens).sum(), cut.sum(), lengths.sum() - cut.sum(), len(lengths), lengths.sum())
        assert (r.docs_at_least, r.tokens_at_least, r.docs_at_most, r.truncated_total, r.cut_tokens, r.all_docs, r.all_tokens) == want


def test_histogram_answers_any_limit(spark, awkward, empty):
    hist = token_counts.histogram(token_counts.token_lengths(awkward)).cache()
    lengths = np.array([len(encoder()(t)) if t else 0 for _, t in AWKWARD])
    for r in token_counts.at_limits(hist, [0, 7, 100, 10**6]).collect():
        assert (r.total, r.truncated_total, r.docs_cut) == (lengths.sum(), np.minimum(lengths, r.limit).sum(), (lengths > r.limit).sum())
    for block in (1, 10, 1024):
        sums = token_counts.suffix_sums(hist, block)
        assert sum(r.n_docs for r in sums.collect()) == len(AWKWARD)
        got = {r.level: r.n_tokens for r in token_counts.quantiles(sums, [0.0, 0.5, 0.9, 1.0]).collect()}
        assert got == {q: int(np.sort(lengths)[max(1, int(np.ceil(q * len(lengths)))) - 1]) for q in (0.0, 0.5, 0.9, 1.0)}
    none = token_counts.histogram(token_counts.token_lengths(empty))
    assert token_counts.suffix_sums(none).count() == 0
    assert token_counts.at_limits(none, [5]).collect()[0].total == 0


def check_packing(rows, ids):
    used = Counter()
    spots = {}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        used[r.doc_id] += r.length
        spots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert used == {k: len(v) for k, v in ids.items()}
    for parts in spots.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(spots) == list(range(len(spots)))
    return sum(used.values()) / len(spots) / 2048


def test_packing_query(spark, ids):
    assert check_packing(packing.op5_packing(spark, SF).collect(), {k: [*v, 1] for k, v in ids.items()}) > 0.97


def test_packing_edges(spark, awkward, empty):
    rows = packing.pack(awkward).collect()
    n = {None: 0} | Counter()
    for d, t in AWKWARD:
        n[d] = n.get(d, 0) + len(encoder()(t) if t else []) + 1
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == n and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(empty).count() == 0


def test_shortest_pack_first_by_hand():
    placed = packing.shortest_pack_first({6: 2, 4: 3, 2: 1, 10: 1}, 10)
    assert placed == [(10, 0, 0, 0, 0), (6, 0, 1, 1, 0), (4, 0, 1, 1, 6), (4, 2, 2, 3, 0), (2, 0, 0, 3, 4)]
    assert packing.shortest_pack_first({}) == []


def test_ranks_are_gapless_in_any_number_of_buckets(spark):
    cut = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("start"), (F.col("id") % 3).alias("length"), F.lit(0).cast("long").alias("ids_crc32"), F.lit(1).cast("long").alias("doc_tokens"))
    for buckets in (1, 7, 1000):
        rows = packing.ranked(cut, buckets).collect()
        for n in range(3):
            own = sorted(r.length_rank for r in rows if r.length == n)
            assert own == list(range(len(own)))


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_query(spark, docs):
    rows = quality.op6_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs[1])
    for r in rows:
        n, *rest = plain_quality(docs[1][r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n) and not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    sound = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in sound) >= 0.98 * len(sound)


def test_quality_edges(spark, awkward, empty, write):
    texts = ["a b c d e f g h " * 3, "x y z \x1c w\x85v", "one two\r\none two\r\n\r\n", "é😀 #|# \x0b\x0c é😀", "퟿" * 3 + " <>", " ".join(map(str, range(8))) + "\n" + " ".join(map(str, range(8)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (None, 1), (77, 1), (1, None)], "doc_id long, quality int")
    for r in quality.quality_rules(df, labels, "doc_id").collect():
        assert tuple(r[f] for f in quality.FIELDS[:-1]) == plain_quality(texts[r.doc_id])
    rows = quality.quality_rules(awkward, labels.where("doc_id > 1000"), "doc_id").collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in AWKWARD)
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in rows)
    assert quality.quality_rules(empty, labels, "doc_id").count() == 0


def test_log_ratio_by_hand():
    got = quality.log_ratios(np.array([3, 1]), np.array([1, 1]))
    assert np.allclose(got, np.log([(2 / 4) / (4 / 6), (2 / 4) / (2 / 6)]))


def test_language_query_on_the_held_out_fold(spark):
    rows = langid.op7_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 2


def toy():
    english, german = "the cat sat on the mat and the hat", "die katze sass auf der matte und dem hut"
    tables = []
    for text in (english, german):
        chars, kept = langid.cleaned([text])
        at = langid.scored_places(kept)
        tables.append(np.unique(np.stack([chars[at - k] for k in (3, 2, 1, 0)], axis=1), axis=0, return_counts=True))
    return langid.train(["de", "en"], tables[::-1]), (english, german)


def plain_probability(grams, counts, context, char, letters):
    """Interpolated Kneser-Ney by its definition, from the counts of the highest order."""
    n = len(context) + 1
    table = Counter()
    for g, c in zip(map(tuple, grams.tolist()), counts.tolist()):
        if n == 4:
            table[g] += c
    if n < 4:
        longer = {tuple(g[-n - 1 :]) for g in map(tuple, grams.tolist())}
        table = Counter(g[1:] for g in longer)
    ones, twos = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
    d = ones / (ones + 2 * twos) if ones and twos else 0.5
    follow = {g[-1]: c for g, c in table.items() if g[:-1] == context}
    lower = plain_probability(grams, counts, context[1:], char, letters) if n > 1 else 1 / letters
    if not follow:
        return lower
    total = sum(follow.values())
    return max(follow.get(char, 0) - d, 0) / total + d * len(follow) / total * lower


def test_model_probabilities_follow_the_definition():
    model, texts = toy()
    tables = []
    for text in texts[::-1]:
        chars, kept = langid.cleaned([text])
        at = langid.scored_places(kept)
        tables.append(np.unique(np.stack([chars[at - k] for k in (3, 2, 1, 0)], axis=1), axis=0, return_counts=True))
    letters = len({c for t in texts for c in t}) + 1
    chars, kept = langid.cleaned(["the katze qx on"])
    at = langid.scored_places(kept)
    got = model.log_probabilities(chars, at)
    for row, place in zip(got, at):
        context, char = tuple(chars[place - 3 : place].tolist()), int(chars[place])
        for k, (grams, counts) in enumerate(tables):
            assert abs(row[k] - np.log(plain_probability(grams, counts, context, char, letters))) < 1e-4


def test_cleaning_and_und():
    chars, kept = langid.cleaned(["  Ab--c 1", "", "É"])
    assert "".join(map(chr, chars)) == "   ab c " + "   " + "   é" and kept.tolist() == [5, 0, 1]
    model, _ = toy()
    langid.calibrate(model, [("en", "the cat on the mat"), ("de", "die katze auf der matte")])
    got = model.predict([None, "", "123 %%", "the mat", "der hut"])
    assert [x[0] for x in got] == ["und", "und", "und", "en", "de"] and all(x[1] == 0 and x[2] for x in got[:3])
    assert model.predict(["zqxj" * 50])[0][2]


def test_language_edges(spark, awkward, empty):
    model = langid.fit(awkward)
    rows = langid.predict(awkward, model, "doc_id").collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in AWKWARD)
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 6, 7)} == {"und"}
    kept = langid.accepted(awkward, model)
    assert kept.columns == awkward.columns and not {r.doc_id for r in kept.collect()} & {4, 5, 6, 7}
    assert langid.predict(empty, langid.fit(empty), "doc_id").count() == 0
    assert {r.lang_pred for r in langid.predict(awkward, langid.fit(empty), "doc_id").collect()} == {"und"}


def test_decontamination_query(spark, docs):
    """Every document with a whole item is found, and no other."""
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs[1].items() for i, item in items.items() if f" {item} " in f" {norm(t)} "}
    got = {(r.doc_id, r.item_id) for r in decontam.op10_benchmark_overlaps(spark, SF).collect()}
    assert want and got == want


def test_decontamination_tolerates_substitutions(spark):
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ab", "er", "it", "on", "us", "el", "im", "or")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(30)]
    filler = lambda: " ".join(rnd.choice(words) for _ in range(60))
    texts = {}
    for i, text in items:
        w = text.split()
        for k in range(3, 40, 8):
            w[k] = "CHANGED"
        texts[i] = f"{filler()}. {' '.join(w)}, {filler()}"
        texts[100 + i] = filler()
        texts[200 + i] = filler() + " " + " ".join(text.split()[:12])  # less than half of an item
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = decontam.overlaps(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, _ in items}
    assert all(r.matched == 35 and r.item_words == 40 for r in got)


def test_decontamination_finds_passages_of_long_items(spark):
    """A passage of 13 equal words is an overlap in an item of any length; 12 words of a long item are not."""
    sizes = {59: 29, 1000: 450, 300: 13, 301: 12, 400: 30}
    items = {n: [f"item{n}word{k}" for k in range(n)] for n in sizes}
    texts = {n: " ".join(["before"] * 50 + items[n][20 : 20 + size] + ["after"] * 50) for n, size in sizes.items()}
    spread = [w if k % 8 else "CHANGED" for k, w in enumerate(items[1000][100:132])]  # 28 of 32 words
    noise = ["CHANGED" if k % 7 < 2 else w for k, w in enumerate(items[400][50:])]  # the whole diagonal is under 80 %
    texts |= {1: " ".join(spread), 2: " ".join(items[400][20:50] + noise)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.item_words, r.matched, r.covered) for r in decontam.overlaps(df, table).collect()}
    assert got.pop((2, 400))[1] >= 30
    assert got == {
        (59, 59): (59, 29, 29),
        (1000, 1000): (1000, 450, 450),
        (300, 300): (300, 13, 13),
        (400, 400): (400, 30, 30),
        (1, 1000): (1000, 28, 31),
    }
    assert {r.doc_id for r in decontam.without_benchmark(df, table).collect()} == {301}


def test_decontamination_tolerates_substitutions_in_short_items(spark):
    """Every way to replace so many words leaves a hit; items of up to 8 words are found as a whole only."""
    texts, items = {}, {}
    for n, changed in ((9, 1), (10, 1), (11, 1), (11, 2), (12, 2), (15, 3)):
        for places in itertools.combinations(range(n), changed):
            i = len(items)
            items[i] = [f"item{i}word{k}" for k in range(n)]
            texts[i] = " ".join(["before", *("CHANGED" if k in places else w for k, w in enumerate(items[i])), "after"])
    for n in (5, 8):
        i = len(items)
        items[i] = [f"item{i}word{k}" for k in range(n)]
        texts[i], texts[-i] = " ".join(items[i]), " ".join([*items[i][:-1], "CHANGED"])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.overlaps(df, table).collect()}
    assert set(got) == {(i, i) for i in items}
    assert all(r.matched >= 8 or r.matched == r.item_words for r in got.values())


def test_decontamination_edges(spark, awkward, empty):
    items = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, "hunter2hunter2 mail a.b@c.example.org"), (5, "with a")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(awkward, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1), (8, 1), (9, 4)}
    left = decontam.without_benchmark(awkward, items)
    assert left.columns == awkward.columns and sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 7, 10]
    assert decontam.overlaps(empty, items).count() == 0 and decontam.overlaps(awkward, items.where("item_id > 9")).count() == 0


def test_short_items_are_found_as_a_whole(spark):
    items = [(0, "yes"), (1, "two words"), (2, "one two three four"), (3, "a b c d e f"), (4, ""), (5, "!?"), (6, "never seen")]
    texts = ["yes " * 5000, "Two, words; yes", "x one two three four y one two three four", "one two three", "words two", "a b c d e", "z a b c d e f yes", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    holds = lambda t, i: any(t[k : k + len(i)] == i for k in range(len(t) - len(i) + 1))
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if words(x) and holds(words(t), words(x))}
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, benchmark, least=1).collect()} == want and len(want) == 6
    kept = {r.doc_id for r in decontam.without_benchmark(docs, benchmark).collect()}
    assert kept == set(range(len(texts))) - {6}


def test_filter_grows_with_the_seeds(spark):
    assert [decontam.filter_bits(n) for n in (0, 1 << 16, 1 << 20, 1 << 40)] == [26, 26, 27, 30]
    seeds = spark.range(40_000).select(F.xxhash64("id").alias("seed"))
    for bits in (20, 22):
        table = decontam.bloom_filter(seeds, bits)
        assert len(table) * 8 == 1 << bits and np.unpackbits(table).mean() < 0.2


def test_equal_pieces_are_dealt_out(spark):
    """A third of all pieces are equal rows; ranks stay gapless and no bucket holds them all."""
    own = [(d, 0, 5, d, 5) for d in range(4000)] + [(-1, 0, 5, 7, 5)] * 2000 + [(d, 0, 9, d, 9) for d in range(50)]
    cut = spark.createDataFrame(own, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    rows = packing.ranked(cut, 64).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == Counter((o[0], o[2]) for o in own)
    for n, size in ((5, 6000), (9, 50)):
        assert sorted(r.length_rank for r in rows if r.length == n) == list(range(size))
    hot = sorted(r.length_rank for r in rows if r.doc_id == -1)
    assert max(np.diff(hot)) < 400 and hot[-1] - hot[0] > 5000


def test_language_query_on_awkward_and_empty_tables(spark, awkward, empty, write):
    for df in (awkward.select("doc_id", "text", "lang"), empty.select("doc_id", "text", "lang")):
        rows = langid.op7_language_id(spark, write(documents=df)).collect()
        want = df.select("doc_id", "text").collect()
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        assert Counter((r.doc_id, r.held_out) for r in rows) == Counter((r.doc_id, held(r.doc_id)) for r in want)
        assert all(r.lang_pred in ("en", "und") and 0 <= r.score <= 1 for r in rows)


def test_equal_languages_tie_by_name():
    grams = np.array([[1, 2, 3, 4], [2, 3, 4, 5]], np.uint32)
    model = langid.train(["aa", "bb"], [(grams, np.array([3, 3]))] * 2)
    model = langid.calibrate(model, [])
    assert all(lang in ("aa", "und") for lang, *_ in model.predict(["some text", "other"]))


def test_quality_learns_from_all_trusted_documents(spark):
    labels = spark.range(6_000).selectExpr("id AS doc_id", "1 AS quality").union(spark.createDataFrame([(7, 1), (9_000, 0)], "doc_id long, quality int"))
    assert quality.trusted_ids(labels).count() == 6_000
    scores = np.random.default_rng(3).normal(size=1_237)
    table = spark.createDataFrame([(float(x),) for x in scores], "llr double")
    for share in (0.0, 0.002, 0.4, 1.0):
        assert abs(quality.low_quantile(table, share) - np.quantile(scores, share)) < 1e-12
    assert quality.low_quantile(table.limit(0), 0.002) is None


def test_quality_moves_texts_the_same_way_at_any_size(spark, write, monkeypatch):
    """Few labels are not sent to all tasks, and no text is written again."""
    from boxtrail import runtime

    texts = [(i, f"{i} " + "plain words follow one another " * 8) for i in range(40)]
    folder = write(
        documents=spark.createDataFrame(texts, "doc_id long, text string"),
        labels=spark.createDataFrame([(i, i % 2) for i in range(0, 40, 3)] + [(None, 1)], "doc_id long, quality int"),
    )
    written, counted = [], []
    write_out, count = runtime.materialize, quality.bucket_counts
    monkeypatch.setattr(runtime, "materialize", lambda df, name: written.append(df.columns) or write_out(df, name))
    monkeypatch.setattr(quality, "bucket_counts", lambda df, *a: counted.append(df._jdf.queryExecution().executedPlan().toString()) or count(df, *a))
    assert quality.op6_quality_rules(spark, folder).count() == 40
    assert not any("text" in c for c in written)
    assert "BroadcastHashJoin" not in counted[1] and "Join" in counted[1]
