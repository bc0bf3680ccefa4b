"""Secret scans, personal data and sharding."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boxtrail.llm import pii, secrets, sharding, spans
from boxtrail.runtime import new_shared_path
from tests.llm.conftest import AWKWARD, SF

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain_secrets(text):
    text, found = text or "", []
    found += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_pii(text):
    text, found = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def noise(seed, alphabet, parts, n=800):
    rnd = random.Random(seed)
    return ["".join(rnd.choice((rnd.choice(alphabet), rnd.choice(parts))) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_secret_query_against_plain_search(spark, docs):
    rows = secrets.op2_secret_scan(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs[1])
    for r in rows:
        want = plain_secrets(docs[1][r.doc_id])
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r.base_sha256, r.n_assign, r.n_access, r.n_hex) == (sha(want), kinds["assign"], kinds["access"], kinds["hex"])


def test_secret_edges(spark, awkward, write):
    texts = noise(1, "ab:= \"'é😀_-AKIA09f", ["token", "Secret=", "api_key: ", "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "=passwd=", "PASSWORD"])
    texts += ["f" * 100_000, "AKIA" * 20_000, "token=" * 20_000, "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----"]
    folder = write(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in secrets.op2_secret_scan(spark, folder).collect():
        assert r.base_sha256 == sha(plain_secrets(texts[r.doc_id])), texts[r.doc_id][:200]
        if r.doc_id >= len(texts) - 2:
            assert r.spans.split(":")[0] in ("host_token", "private_key")
    rows = secrets.op2_secret_scan(spark, write(documents=awkward)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in AWKWARD)
    assert [r.n_assign for r in rows if r.doc_id == 9] == [1]


def test_empty_tables(spark, empty, write):
    folder = write(documents=empty)
    for query in (secrets.op2_secret_scan, pii.op4_personal_data, sharding.op8_virtual_slots):
        assert query(spark, folder).count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    path = new_shared_path(spark, "ledger")
    old = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "x")], "doc_id long, text string")
    new = spark.createDataFrame([(3, "token=abcdefgh1"), (4, "y")], "doc_id long, text string")
    assert secrets.update_ledger(old, path).count() == 2
    ledger = secrets.update_ledger(old.union(new), path)
    assert ledger.count() == 3 and secrets.unseen(secrets.blobs(new), ledger).count() == 0
    assert secrets.unseen(secrets.blobs(new), ledger, rules=99).count() == 2
    found = {r.doc_id: r.spans for r in secrets.findings(old.union(new), ledger).collect()}
    assert found[1] == found[3] and len(found[1]) == 1 and found[2] == found[4] == []


def test_redaction_merges_overlaps(spark):
    df = spark.createDataFrame([("é0123456789", [(1, 0, 4, "a"), (2, 0, 6, "b"), (8, 0, 9, "a")]), ("abc", [(0, 0, 3, "a")]), ("abc", []), (None, [])], "text string, spans array<struct<start:int,rank:int,end:int,kind:string>>")
    got = [r[0] for r in df.select(secrets.redact(F.col("text"), F.col("spans"), "#")).collect()]
    assert got == ["é#56#89"[0:2] + "56#89", "#", "abc", None]


def test_masked_rows_keep_their_columns(spark, awkward):
    out = secrets.without_secrets(awkward.withColumn("n_chars", F.length("text")), new_shared_path(spark, "ledger"))
    rows = out.collect()
    assert out.columns == [*awkward.columns, "n_chars"] and len(rows) == len(AWKWARD)
    changed = [r for r in rows if r.doc_id == 9][0]
    assert "hunter2" not in changed.text and changed.n_chars == len(changed.text)


def test_pii_query_against_plain_search(spark, docs):
    for r in pii.op4_personal_data(spark, SF).collect():
        want = plain_pii(docs[1][r.doc_id])
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) == (sha(want), *(kinds[k] for k in pii.BASE))


def test_pii_edges(spark, awkward, write):
    texts = noise(2, "a@b.c-_+1 23().04é😀", ["1.2.3.4", "a@b.c", "4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", " "])
    texts += ["1" * 50_000, "a.b" * 20_000, "a@" + "b." * 20_000 + "c", "+1" + "2" * 20_000, "1 " * 20_000]
    folder = write(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in pii.op4_personal_data(spark, folder).collect():
        assert r.base_sha256 == sha(plain_pii(texts[r.doc_id])), texts[r.doc_id][:200]
    rows = pii.op4_personal_data(spark, write(documents=awkward)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in AWKWARD)
    assert [(r.n_email, r.n_phone, r.n_card) for r in rows if r.doc_id == 9] == [(1, 1, 1)]


def test_expectation_maximisation_finds_the_reliable_labelers():
    patterns = [("phone", 1, 1, 0, 1, 400), ("phone", 1, 0, 1, 1, 200), ("phone", -1, -1, 0, -1, 300), ("phone", -1, 0, -1, 1, 100), ("phone", 1, 0, 0, -1, 5)]
    post = pii.expectation_maximisation(patterns)
    assert post["phone", 1, 1, 0, 1] > 0.95 and post["phone", 1, 0, 1, 1] > 0.95
    assert post["phone", -1, -1, 0, -1] < 0.05 and post["phone", -1, 0, -1, 1] < 0.2
    assert pii.expectation_maximisation([]) == {}


def test_added_spans_need_support(spark):
    good = [(i, f"call my phone 415-555-{1000 + i} or mail me{i}@site.com today") for i in range(200)]
    bad = [(1000 + i, f"invoice 415-555-{1000 + i}x and 000-12-{1000 + i} again") for i in range(200)]
    rows = pii.find_personal_data(spark.createDataFrame(good + bad, "doc_id long, text string")).select("doc_id", spans.joined(F.col("spans"))).collect()
    hit = {r[0] for r in rows if "local_phone" in r[1]}
    assert len(hit & {i for i, _ in good}) == 200 and not hit & {i for i, _ in bad}
    assert not any("ssn" in r[1] for r in rows)


def test_sharding_query(spark, docs):
    rows = sharding.op8_virtual_slots(spark, SF).collect()
    assert len(rows) == len(docs[1])
    loads = Counter()
    for r in rows:
        raw = docs[1][r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        loads[r.shard] += r["size"]
    assert set(loads) == set(range(24)) and max(loads.values()) <= 1.02 * min(loads.values())
    for s in loads:
        assert sorted(r["slot"] for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sharding_edges(spark, awkward):
    rows = sharding.shard_documents(awkward, 3).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in AWKWARD)
    assert {r["size"] for r in rows if r.doc_id == 4} == {8} and {r.text_crc32 for r in rows if r.doc_id in (4, 5)} == {0}


@pytest.mark.parametrize("n_shards", [5, 3])
def test_rebalancing_edits_the_stored_map(spark, n_shards):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    stats = sharding.slot_stats(sharding.records(rows, 256)).cache()
    path = new_shared_path(spark, "maps")
    sharding.store_map(sharding.new_map(stats, 4), path)
    sharding.store_map(sharding.rebalance(sharding.read_map(spark, path), stats, n_shards), path)
    old = {r.virtual_slot: r for r in sharding.read_map(spark, path, 1).collect()}
    new = {r.virtual_slot: r for r in sharding.read_map(spark, path).collect()}
    assert {r.version for r in new.values()} == {2} and set(old) == set(new)
    loads = Counter()
    for r in new.values():
        loads[r.shard] += r.bytes
    assert set(loads) == set(range(n_shards)) and max(loads.values()) <= 1.1 * min(loads.values())
    stay = sum(old[s].shard == new[s].shard for s in old) / len(old)
    assert stay >= (0.7 if n_shards == 5 else 0.6)


def test_equal_rows_are_spread_over_slots(spark):
    """5,000 equal rows, a third of all, make no hot slot; rows that occur once keep the slot of their hash."""
    once = spark.range(10_000).select(F.col("id").alias("doc_id"), F.format_string("text %06d", "id").alias("text"))
    same = spark.range(5_000).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("text 000000").alias("text"))
    rows = sharding.shard_documents(once.unionByName(same), 8, 256).collect()
    assert len(rows) == 15_000 and sum(r.doc_id == -1 for r in rows) == 5_000
    slots, shards = Counter(r.virtual_slot for r in rows), Counter()
    for r in rows:
        shards[r.shard] += r.size
    assert max(slots.values()) < 120 and max(shards.values()) < 1.02 * min(shards.values())
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows))) for k in range(8))
    plain = once.select("doc_id", F.pmod(F.xxhash64("doc_id", F.crc32("text"), (F.octet_length("text") + 8).cast("long")), F.lit(256)).alias("v"))
    assert {r.doc_id: r.v for r in plain.collect()} == {r.doc_id: r.virtual_slot for r in rows if r.doc_id >= 0}


def test_stored_map_is_edited_by_the_next_run(spark, empty):
    """A second run over grown data reads the newest version, stores the next, and moves few rows."""
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") % 40).cast("int")).alias("text"))
    path = new_shared_path(spark, "maps")
    first = {r.doc_id: r.shard for r in sharding.shard_documents(rows.where("doc_id < 5000"), 6, 512, path).collect()}
    second = {r.doc_id: r.shard for r in sharding.shard_documents(rows, 6, 512, path).collect()}
    assert {r.version for r in spark.read.parquet(path).select("version").distinct().collect()} == {1, 2}
    assert len(first) == 5000 and len(second) == 6000 and sum(first[d] != second[d] for d in first) < 0.3 * len(first)
    loads = Counter()
    for d, k in second.items():
        loads[k] += 8 + d % 40
    assert max(loads.values()) < 1.1 * min(loads.values())
    third = {r.doc_id: r.shard for r in sharding.shard_documents(rows, 4, 512, path).collect()}
    assert set(third.values()) == set(range(4))
    assert sharding.shard_documents(empty.select("doc_id", "text"), 3, map_path=new_shared_path(spark, "maps")).collect() == []


def test_rules_are_named_by_their_patterns(spark, monkeypatch):
    """New rules scan every blob again, and paths are not doubled by the older entries or by repeated ones."""
    docs = spark.createDataFrame([(1, "token = abcdefgh1"), (2, "none"), (3, "token = abcdefgh1")], "doc_id long, text string")
    path = new_shared_path(spark, "ledger")
    ledger = secrets.update_ledger(docs, path)
    assert ledger.count() == 2 and secrets.update_ledger(docs, path).count() == 2
    ledger = secrets.update_ledger(docs, path, rules=secrets.RULES_VERSION + 1)
    assert ledger.count() == 4
    twice = ledger.unionByName(ledger)
    rows = secrets.findings(docs, twice, secrets.RULES_VERSION + 1).collect()
    assert {r.doc_id: len(r.spans) for r in rows} == {1: 1, 2: 0, 3: 1} and len(rows) == 3
    import importlib

    source = secrets.HEX
    own = importlib.util.spec_from_file_location("edited_secrets", secrets.__file__)
    text = open(secrets.__file__).read()
    edited: dict = {"__name__": "boxtrail.llm.edited"}
    exec(compile(text.replace(source, "[0-9a-f]{33,}"), own.origin, "exec"), edited)
    assert edited["HEX"] != source and edited["RULES_VERSION"] != secrets.RULES_VERSION
