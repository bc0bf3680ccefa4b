"""Near-duplicates by BagMinHash over word shingles.

A document is the multiset of its five-word shingles. Every shingle drives Poisson processes over discretised weights:
one for the weights (0, 1], one for each doubling above. Points come in the order of their time, each falls on one
signature component at one weight; a document sees the points below its own count and keeps the earliest of every
component. Two signatures agree in a component with the probability of the weighted Jaccard similarity. Generation
stops as soon as a shingle's next point is later than all components, so long texts cost about one point a shingle.

Texts are compared as classes of equal text. Bands of the signature put classes into buckets; every class is verified
against the pivot of each of its buckets. Buckets whose classes are not yet in one component are then compared in
blocks by finer signatures, and all pairs of unlike components that look similar enough are verified too. Verification counts the multiset overlap of whole texts. No bucket is collected, and no
pair that signatures rule out is written.

Null texts count as empty. Texts without words are one class by equality only; texts of one to four words have a single
shingle of all their words. Equal doc_ids with different texts are told apart. Repeated rows are copies. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Iterator, Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from boxtrail.llm.common import columns_of, documents, mix, slices, word_hashes
from boxtrail.llm.components import components
from boxtrail.runtime import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 7
COMPONENTS = BANDS * ROWS
# A pair at the threshold agrees in 0.8 of the components with a deviation of 0.025; fewer than 0.68 happens once in a
# million such pairs.
LEAST_AGREEMENT = 0.68
# The last comparison takes as many more components for the texts that are still apart: a deviation of 0.0125.
FINE_COMPONENTS = 1024
FINE_AGREEMENT = 0.745
BLOCK = 512
CACHED_TEXTS, CACHED_CHARS = 4096, 8000
CHUNK = 1 << 20
POINTS = 1 << 18
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, count) of the distinct shingles of each text, in order of owner and hash."""
    words, sizes = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = max(0, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * GOLDEN + words[k : k + n]
    inside = owner[:n] == owner[width - 1 :] if n else np.zeros(0, bool)
    who, h = owner[:n][inside], mix(h[inside])
    ends = np.cumsum(sizes)
    few = np.flatnonzero((sizes > 0) & (sizes < width))
    whole = np.array([mix(np.array([sum((int(w) * 31 ** (i + 7)) for i, w in enumerate(words[ends[d] - sizes[d] : ends[d]])) % (1 << 64)], np.uint64))[0] for d in few], np.uint64)
    who, h = np.concatenate((who, few)), np.concatenate((h, whole))
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
    return who[first], h[first], np.diff(np.append(first, len(h)))


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """float64 [document, component]: time of the earliest point of each component; infinite without shingles."""
    sig = np.full((n_docs, m), np.inf)
    flat = sig.reshape(-1)
    level = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)  # the last weight interval that a count reaches into
    parts = np.repeat(np.arange(len(owner)), level + 1)
    j = np.arange(len(parts)) - np.repeat(np.cumsum(level + 1) - (level + 1), level + 1)
    low = np.where(j == 0, 0, 1 << np.maximum(j - 1, 0))  # interval (low, low + rate]
    rate = np.maximum(low, 1).astype(np.float64)
    doc, seed = owner[parts], mix(hashes[parts] + j.astype(np.uint64) * GOLDEN)
    share = (counts[parts] - low) / rate  # of the interval that lies below the count
    time, step = np.zeros(len(parts)), 0
    active = np.arange(len(parts))
    latest = np.full(n_docs, np.inf)
    while len(active):
        k = int(max(1, min(64, POINTS // len(active))))
        steps = (np.arange(step, step + k, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        r = mix(seed[active][:, None] + steps)
        gaps = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / (rate[active] * m)[:, None]
        gaps[:, 0] += time[active]
        at = np.cumsum(gaps, axis=1)
        q = mix(r + GOLDEN)
        where = doc[active][:, None] * m + (q % np.uint64(m)).astype(np.int64)
        weight = (mix(q + GOLDEN) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        use = (weight < share[active][:, None]) & (at < latest[doc[active]][:, None])
        np.minimum.at(flat, where[use], at[use])
        time[active], step = at[:, -1], step + k
        some = np.unique(doc[active])
        latest[some] = sig[some].max(axis=1)
        active = active[time[active] < latest[doc[active]]]
    return sig


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, h, n = shingles([text])
    return h, n


def overlap(a: str, b: str, kept: Callable = _bag) -> float:
    """Weighted Jaccard similarity of the shingle multisets of two texts; ``kept`` gives the bags of short ones."""
    (ha, na), (hb, nb) = ((kept if len(x) <= CACHED_CHARS else _bag)(x) for x in (a, b))
    _, left, right = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(na[left], nb[right]).sum()
    either = na.sum() + nb.sum() - both
    return float(both / either) if either else 1.0


def class_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def sketched(docs: DataFrame) -> DataFrame:
    """cid, bands, sig, one row per distinct text: band hashes, and a byte of every component."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (texts,) = columns_of(b, "text")
            cids, seen, keep = b.column(b.schema.get_field_index("cid")).to_pylist(), set(), []
            for i, c in enumerate(cids):
                if c not in seen:
                    seen.add(c)
                    keep.append(i)
            for lo, hi in slices([texts[i] for i in keep], CHUNK):
                own = keep[lo:hi]
                sig = signatures(*shingles([texts[i] for i in own]), len(own))
                bits = mix(sig.view(np.uint64))
                bands = np.zeros((len(own), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = bands * GOLDEN + bits[:, r::ROWS]
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                some = np.isfinite(sig[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cids[i] for i in own], pa.binary()), pa.array([list(x) if s else [] for x, s in zip(bands, some)], pa.list_(pa.int64())), pa.array([x.tobytes() for x in (bits & np.uint64(255)).astype(np.uint8)], pa.binary())],
                    names=["cid", "bands", "sig"],
                )

    rows = docs.select(class_key().alias("cid"), "text").mapInArrow(sketch, "cid binary, bands array<long>, sig binary")
    return rows.groupBy("cid").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"))


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal signature components."""
    if not len(a):
        return pd.Series([], dtype=float)
    left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), COMPONENTS) for x in (a, b))
    return pd.Series((left == right).mean(axis=1))


def similarities(pairs: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity of pairs of texts. The bags it keeps leave with the task: Python workers outlive their tasks."""
    kept = lru_cache(CACHED_TEXTS)(_bag)
    for a, b in pairs:
        yield pd.Series([overlap(x, y, kept) for x, y in zip(a, b)], dtype=float)


similarity = F.pandas_udf(similarities, DoubleType())


def shared_buckets(entries: DataFrame) -> DataFrame:
    """bucket, cid, n: entries of buckets with more than one class."""
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return entries.join(sizes, "bucket")


def pivot_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): every class with the pivot of each of its buckets.

    The pivot is the class that meets most others over all its buckets: in a group of edited copies that is the text
    they were made from, if it is there. It is an aggregate that joins back, so a bucket of any size is spread by the
    skew join.
    """
    company = shared.groupBy("cid").agg(F.sum(F.col("n") - 1).alias("company"))
    pivots = shared.join(company, "cid").groupBy("bucket").agg(F.min(F.struct((-F.col("company")).alias("order"), "cid")).alias("first"))
    met = shared.join(pivots.select("bucket", F.col("first.cid").alias("pivot")), "bucket").where("pivot != cid")
    return met.select(F.least("pivot", "cid").alias("a"), F.greatest("pivot", "cid").alias("b")).distinct()


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose signatures agree well enough to be verified."""
    sig = sketches.select("cid", "sig")
    both = pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.where(agreement("sig_a", "sig_b") >= LEAST_AGREEMENT).select("a", "b")


def texts_of(docs: DataFrame, cids: DataFrame) -> DataFrame:
    """cid, text of the given classes, each once."""
    return docs.select(class_key().alias("cid"), F.coalesce("text", F.lit("")).alias("text")).join(cids, "cid", "left_semi").dropDuplicates(["cid"])


def verified(texts: DataFrame, pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs whose whole texts reach the similarity."""
    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    return both.where(similarity("text_a", "text_b") >= least).select("a", "b")


def open_entries(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, cid, n, label: entries of buckets that hold classes of unlike components."""
    named = shared.where("n > 2").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    open_ = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    return named.join(open_, "bucket")


def fine_signatures(texts: DataFrame) -> DataFrame:
    """cid, bands, sig: a byte of each of ``FINE_COMPONENTS`` further components."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (own,) = columns_of(b, "text")
            cids, bands = (b.column(b.schema.get_field_index(c)) for c in ("cid", "bands"))
            for lo, hi in slices(own, CHUNK):
                owner, h, n = shingles(own[lo:hi])
                sig = signatures(owner, mix(h + GOLDEN), n, hi - lo, FINE_COMPONENTS)
                raw = pa.array([x.tobytes() for x in (mix(sig.view(np.uint64)) & np.uint64(255)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([cids.slice(lo, hi - lo), bands.slice(lo, hi - lo), raw], names=["cid", "bands", "sig"])

    return texts.mapInArrow(sketch, "cid binary, bands array<long>, sig binary")


def remaining_pairs(open_: DataFrame, sketches: DataFrame, least: float = FINE_AGREEMENT) -> DataFrame:
    """Pairs of unlike components that share a bucket and agree by signature.

    A bucket is dealt into blocks of about ``BLOCK`` classes, and each two blocks meet in a task of their own. A pair is
    returned from the first of the buckets that it shares only.
    """
    members = open_.join(sketches.select("cid", "bands", "sig"), "cid")
    dealt = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meet = dealt.select("bucket", "cid", "label", "bands", "sig", "block", other.alias("other")).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "label", "bands", "sig")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1)
        cid, block, bands = rows["cid"].to_numpy(), rows["block"].to_numpy(), np.stack(rows["bands"])
        band = int((bands[0] == rows["bucket"].iloc[0]).argmax())
        label = pd.factorize(rows["label"])[0]
        inside = rows["i"].iloc[0] == rows["j"].iloc[0]
        largest = np.bincount(label).argmax()
        a, b = [], []
        for k in np.flatnonzero(label != largest):
            at = np.flatnonzero((label != label[k]) & ((block != block[k]) | inside))
            at = at[(bands[at] == bands[k]).argmax(axis=1) == band]
            for x in at[(sig[at] == sig[k]).mean(axis=1) >= least]:
                a.append(min(cid[k], cid[x]))
                b.append(max(cid[k], cid[x]))
        return pd.DataFrame({"a": a, "b": b})

    return meet.groupBy("bucket", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def class_links(docs: DataFrame) -> DataFrame:
    """(a, b): verified links between distinct texts that hold every component together.

    First every class meets the pivots of its buckets. Then the classes of buckets whose classes are not all in one
    component get finer signatures, and every two of unlike components that these do not rule out are verified.
    """
    sketches = materialize(sketched(docs), "signatures")
    shared = materialize(shared_buckets(sketches.select("cid", F.explode("bands").alias("bucket"))), "shared_buckets")
    texts = materialize(texts_of(docs, shared.select("cid").distinct()), "candidate_texts")
    links = materialize(verified(texts, likely(pivot_pairs(shared), sketches)), "pivot_links")
    still = materialize(open_entries(shared, components(links)), "open_buckets")
    fine = materialize(fine_signatures(texts.join(still.select("cid").distinct(), "cid", "left_semi").join(sketches.select("cid", "bands"), "cid")), "fine_signatures")
    more = materialize(remaining_pairs(still, fine), "remaining_pairs")
    return materialize(links.unionByName(verified(texts, more)), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, cid, class_id, class_docs, keep: one row per input row.

    ``class_id`` is the least doc_id of the class; ``keep`` marks the document (equal rows: each of them) that stands
    for its class, the one of the least doc_id.
    """
    labels = components(class_links(docs))
    rows = docs.select("doc_id", class_key().alias("cid"))
    texts = rows.groupBy("cid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = texts.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = materialize(named, "labelled_texts")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "cid"))
    classes = named.groupBy("label").agg(first.alias("first"), F.sum("copies").alias("class_docs"))
    full = named.join(classes, "label").select("cid", "first", "class_docs")
    keep = (F.col("cid") == F.col("first.cid")) & F.col("doc_id").eqNullSafe(F.col("first.least"))
    return rows.join(full, "cid").select("doc_id", "cid", F.col("first.least").alias("class_id"), "class_docs", keep.alias("keep"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns as they are."""
    kept = near_duplicates(docs).where("keep").select("doc_id", "cid").distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), class_key().alias("key"))
    found = whole.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("cid")))
    return found.dropDuplicates(["id", "key"]).select("row.*")


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(documents(spark, sf_dir)).drop("cid")
