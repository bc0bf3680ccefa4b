"""License scans, fill-in-middle and tokenizer alignment against plain rewrites and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from boxtrail.llm import alignment, licenses, middle
from boxtrail.llm.common import vocabulary
from tests.compare import compare, connect
from tests.llm.conftest import AWKWARD, PROSE, SF

ODD = ["", " ", "  two  spaces  ", "é😀‍ 日本語 🀄\n\n", "a<|endoftext|>b</s><unk>", "\x00\x01 tab\t", "▁ marked ▁", "x" * 3000, "I'LL we've don't", "<P>", "a<S", "M>b <", "́ é ﬁ İı"]


@pytest.mark.parametrize("query,sql", [(licenses.op11_license_scan, licenses.OP11_SQL), (middle.op12_fill_in_middle, middle.OP12_SQL)])
def test_queries_equal_their_sql(spark, query, sql):
    ok, rows, _, _, note = compare(spark, connect(SF), SF, query, sql)
    assert ok and rows, note


@pytest.mark.parametrize("query,sql", [(licenses.op11_license_scan, licenses.OP11_SQL), (middle.op12_fill_in_middle, middle.OP12_SQL)])
def test_queries_equal_their_sql_on_awkward_rows(spark, awkward, empty, write, query, sql):
    import duckdb

    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for df in (awkward.select("doc_id", "text").unionByName(more).coalesce(1), empty):
        folder = write(documents=df)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        ok, rows, _, _, note = compare(spark, con, folder, query, sql)
        assert ok, note


# fill-in-middle


def test_skip_list_reaches_every_rank():
    rnd = random.Random(1)
    for n in (0, 1, 2, 5, 64, 3000):
        widths = np.array([rnd.randrange(1, 9) for _ in range(n)], np.int64)
        lanes = middle.SkipList(widths)
        ends = [0, *np.cumsum(widths).tolist()]
        assert [lanes.descend(r) for r in range(n + 1)] == ends
    assert len(lanes.lanes) > 3 and all(step.sum() == n and wide.sum() == ends[-1] for step, wide, _ in lanes.lanes)


def test_units_over_slices(monkeypatch):
    texts = [*ODD, "abc" * 7 + "é1" + "zz" * 9]
    for width in (1, 2, 5, 1 << 20):
        monkeypatch.setattr(middle, "SLICE", width)
        for t in texts:
            assert middle.unit_widths(t).tolist() == [len(u) for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)]


def test_fill_in_middle_texts(spark, awkward):
    rows = middle.fill_in_middle(awkward, "doc_id", "tag", "text").withColumn("back", middle.restored()).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(AWKWARD)
    for r in rows:
        assert r.back == (r.text or "") and r.tag == "x"
        h = [int(hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", r.text or "", re.S)
        if r.form != "plain":
            lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
            p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
            assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}") and (r.prefix_chars, r.middle_chars) == (len(p), len(m))
            assert (r.form == "spm") == (h[3] % 100 < 20)
        else:
            assert r.output == (r.text or "") and (not r.text or h[2] % 100 >= 90)


def test_sentinels_stay_plain(spark):
    df = spark.createDataFrame([(i, f"word {s} word") for i in range(40) for s in ("<P>", "<S>", "<M>", "<X>", "<P")], "doc_id long, text string")
    rows = middle.fill_in_middle(df, "text").collect()
    assert all((r.form == "plain") for r in rows if re.search("<[PSM]>", r.text)) and {r.form for r in rows if "<X>" in r.text} == {"plain", "psm", "spm"}


# licenses


def plain_matches(text, templates):
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    out = {}
    for t in templates:
        if t.phrase:
            for i in range(len(words)):
                if words[i : i + len(t.words)] == t.words:
                    out.setdefault((t.label, True), []).append(i)
        else:
            for start in range(0, len(words), 128):
                share = len(set(words[start : start + 256]) & set(t.words)) / len(set(t.words))
                if share >= 0.8:
                    out[t.label, False] = max(share, out.get((t.label, False), 0))
    return words, out


def license_texts():
    rnd = random.Random(3)
    prose = PROSE.split()
    texts = []
    for label, notice in licenses.NOTICES:
        words = notice.split()
        for lost in (0, 1, 3, 5, 8, 14):
            kept = [w if rnd.random() >= lost / len(words) else "other" for w in words]
            texts.append(" ".join([*rnd.choices(prose, k=rnd.randrange(0, 600)), *kept, *rnd.choices(prose, k=rnd.randrange(0, 300))]))
    texts += ["x " * k + "Under-the MIT, license! under the mit license" + " y" * 7 for k in (0, 1, 125, 126, 127, 128, 254, 255, 256)]
    return texts + ["CC BY-NC CC BY NC 4.0 cc by", "apache license version 2" + " of the apache license, version 2.0" * 200, None, "under the mit"]


def test_join_equals_comparing_everything(spark):
    texts = license_texts()
    templates = licenses.templates_of()
    df = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:5])], "doc_id long, text string").repartition(4)
    rows = licenses.scan_licenses(df, "doc_id", "text").collect()
    assert len(rows) == len(texts) + 5
    for r in rows:
        words, want = plain_matches(r.text, templates)
        places = sorted(p for (_, phrase), found in want.items() if phrase for p in found)
        assert r.n_words == len(words) and r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for label, phrase in want if phrase}))
        assert r.labels == ",".join(sorted({label for label, _ in want}))
        assert r.score == pytest.approx(max((1 if phrase else v for (_, phrase), v in want.items()), default=0))
    assert {label for r in rows for label in r.labels.split(",")} >= {label for label, _ in licenses.NOTICES}


def test_clean_prose_has_no_license(spark, awkward):
    assert all((r.n_base, r.labels, r.score) == (0, "", 0) for r in licenses.scan_licenses(awkward, "doc_id").collect())


def test_own_templates_and_threshold(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta"), (3, "delta epsilon beta alpha")], "doc_id long, text string")
    for threshold, want in ((1.0, {1}), (0.75, {1, 3}), (0.5, {1, 2, 3})):
        rows = licenses.scan_licenses(df, "doc_id", phrases=[], notices=[("own", "alpha beta gamma delta")], threshold=threshold).collect()
        assert {r.doc_id for r in rows if r.labels == "own"} == want
    assert [r.labels for r in licenses.scan_licenses(df, phrases=[], notices=[]).collect()] == [""] * 3
    with pytest.raises(ValueError):
        licenses.templates_of([], [("long", "w " * 129)])


# alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Tokenizers(vocabulary(alignment.TOKENIZER_A), vocabulary(alignment.TOKENIZER_B))


def plain_tokens(pair, text):
    """(id, bytes) of both sides, from ids and vocabulary entries alone."""
    if not text:
        return None
    alphabet = {}
    shift = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            alphabet[chr(b)] = b
        else:
            alphabet[chr(256 + shift)] = b
            shift += 1
    raw = (" " + text).encode()
    a = [(i, bytes(alphabet[c] for c in pair.a.id_to_token(i))) for i in pair.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in pair.b.encode(text):
        piece = pair.b.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()))
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else None


def plain_alignment(pair, texts):
    """The contract's columns, by walking bytes."""
    links, out = [], []
    for text in texts:
        found = plain_tokens(pair, text)
        if not found:
            links.append([])
            out.append((0, 0, 0, ""))
            continue
        ends = []
        for side in found:
            at, where = 0, {}
            for i, raw in side:
                at += len(raw)
                where[at] = i
            ends.append(where)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links.append([(ends[0][c], ends[1][c]) for c in cuts])
        places = [iter(sorted(where)) for where in ends]
        groups = []
        for c in cuts:
            sides = []
            for where, place in zip(ends, places):
                own = [next(place)]
                while own[-1] < c:
                    own.append(next(place))
                sides.append(",".join(str(where[e]) for e in own))
            groups.append("|".join(sides))
        out.append((len(found[0]), len(found[1]), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for one in links for x in one)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(*o, len(one), sum(count[x] == best[x[1]] for x in one), sum(count[x] for x in one)) for o, one in zip(out, links)]


def plain_links(pair, text):
    ends = [dict(zip(np.cumsum([len(x) for _, x in side]).tolist(), (i for i, _ in side))) for side in plain_tokens(pair, text)]
    return [(ends[0][c], ends[1][c]) for c in sorted(set(ends[0]) & set(ends[1]))]


FIELDS = ("n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum")


def test_spans_equal_decoded_bytes(pair, docs):
    for t in [t for t in [*ODD, *list(docs[1].values())[:60]] if t]:
        want, got = plain_tokens(pair, t), pair.align(t)
        assert (want is None) == (got is None)
        for side, tokens in zip(want or (), got or ()):
            assert tokens.ids.tolist() == [i for i, _ in side] and tokens.ends.tolist() == np.cumsum([len(x) for _, x in side]).tolist()
    assert pair.splits and pair.align("▁ marked") is None


@pytest.mark.parametrize("part,kept", [(1 << 18, 1 << 17), (20, 50)])
def test_segments_equal_whole_texts(pair, docs, monkeypatch, part, kept):
    """What is kept or joined changes nothing, nor do random characters around the cuts."""
    monkeypatch.setattr(alignment, "PART", part)
    monkeypatch.setattr(alignment, "KEPT", kept)
    rnd = random.Random(4)
    mixed = ["".join(rnd.choices("ab  é😀.'1\n\t\u00a0\u3000\x1c\u0085\u200bs", k=60)) for _ in range(100)]
    aligner = alignment.Aligner(pair)
    for t in [*ODD, *mixed, *list(docs[1].values())[:60]]:
        found = aligner.document(t)
        (want,) = plain_alignment(pair, [t])
        got = (found.n_a, found.n_b, len(found.links), hashlib.sha256(found.groups.encode()).hexdigest()) if found else (0, 0, 0, "")
        assert got == want[:4]
        assert not found or [(x >> 32, x & 0xFFFFFFFF) for x in found.links.tolist()] == plain_links(pair, t)


def test_alignment_query(spark, pair, docs):
    rows = {r.doc_id: tuple(r[f] for f in FIELDS) for r in alignment.op13_token_alignment(spark, SF).collect()}
    assert rows == dict(zip(docs[1], plain_alignment(pair, docs[1].values())))


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_alignment_of_awkward_rows(spark, pair, awkward, chunk):
    texts = [*AWKWARD, *((200 + i, t) for i, t in enumerate(ODD)), (300, None)]
    df = awkward.unionByName(spark.createDataFrame(texts[len(AWKWARD) :], "doc_id long, text string"), allowMissingColumns=True).where("doc_id is null or doc_id != 10")
    texts = [x for x in texts if x[0] != 10]
    rows = alignment.token_alignment(df, chunk=chunk).collect()
    want = Counter((d, *w) for (d, _), w in zip(texts, plain_alignment(pair, [t for _, t in texts])))
    assert Counter((r.doc_id, *(r[f] for f in FIELDS)) for r in rows) == want


def test_alignment_of_an_empty_table(spark, empty):
    assert alignment.token_alignment(empty).collect() == []
