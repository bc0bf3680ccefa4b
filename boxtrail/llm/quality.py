"""Quality rules: heuristics, then a log-likelihood ratio of hashed word n-grams.

Single words and word pairs are hashed into ``BUCKETS``. The raw multinomial counts every document; the target
multinomial counts every trusted one (label quality = 1). A document's score is the mean log ratio of its n-grams, so
its length cancels. Every document is kept or dropped by one threshold: the ``QUANTILE`` of all trusted documents' own
scores, less ``SLACK``.

Null and empty texts have no words, fail the base rules and are not kept. Repeated rows count as often as they occur and
get equal results. Without labels the ratio is 0 everywhere and only the base rules decide. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import columns_of, mix, slices

BUCKETS = 1 << 14
QUANTILE = 0.002
SLACK = 0.05
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
CHUNK = 1 << 21


def words_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and each text's number of words. Words end at ASCII white space."""
    import xxhash

    words: list[bytes] = []
    sizes = np.zeros(len(raw), np.int64)
    for i, text in enumerate(raw):
        found = text.split()
        sizes[i] = len(found)
        words += found
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), sizes


def gram_buckets(words: np.ndarray, sizes: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and owner of every single word and every pair inside a text."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    pair = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    inside = owner[:-1] == owner[1:]
    one = (mix(words) % np.uint64(buckets)).astype(np.int64)
    two = (mix(pair[inside]) % np.uint64(buckets)).astype(np.int64)
    return np.concatenate((one, two)), np.concatenate((owner, owner[:-1][inside]))


def repeated_words(words: np.ndarray, sizes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """For each text, its words inside windows of ``width`` words that it holds twice or more."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(len(sizes), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(owner[:n] == owner[width - 1 :])
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    h = mix(h[start] + mix(owner[start].astype(np.uint64)))
    order = np.argsort(h, kind="stable")
    same = np.concatenate(([False], h[order][1:] == h[order][:-1]))
    twice = start[order[same | np.append(same[1:], False)]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return np.bincount(owner, np.cumsum(edge)[:-1] > 0, len(sizes)).astype(np.int64)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _is_space(raw: bytes) -> int:
    return sum(raw.count(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of every document labelled good."""
    return labels.where("quality = 1").select("doc_id").distinct()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts by bucket over all documents. Tasks send one dense count at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for b in batches:
            (texts,) = columns_of(b, "text")
            for lo, hi in slices(texts, CHUNK):
                words, sizes = words_of([(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]])
                held += np.bincount(gram_buckets(words, sizes, buckets)[0], minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": held[some]})

    got = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most `buckets` rows
    total = np.zeros(buckets, np.int64)
    total[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return total


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability by bucket, both smoothed by one; 0 without trusted text."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(raw))) - np.log((raw + 1) / (raw.sum() + len(raw)))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")


def measured(docs: DataFrame, ratios: np.ndarray, *carry: str) -> DataFrame:
    """carry columns and FIELDS, one row per input row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    buckets = len(ratios)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), *(f"{c} long" for c in FIELDS[:-1]), "llr double"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (texts,) = columns_of(b, "text")
            parts: list[list] = [[] for _ in FIELDS]
            for lo, hi in slices(texts, CHUNK):
                own = [t or "" for t in texts[lo:hi]]
                raw = [t.encode("utf-8", "surrogatepass") for t in own]
                words, sizes = words_of(raw)
                bucket, owner = gram_buckets(words, sizes, buckets)
                total, n = np.bincount(owner, shared.value[bucket], len(own)), np.bincount(owner, minlength=len(own))
                columns = (
                    sizes,
                    [len(t) - _is_space(r) for t, r in zip(own, raw)],
                    [sum(map(r.count, SYMBOLS)) for r in raw],
                    [duplicate_lines(r) for r in raw],
                    repeated_words(words, sizes),
                    total / np.maximum(n, 1),
                )
                for p, c in zip(parts, columns):
                    p.extend(c)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in carry), *(pa.array(p, pa.float64() if f == "llr" else pa.int64()) for f, p in zip(FIELDS, parts))], names=[*carry, *FIELDS])

    return docs.select(*dict.fromkeys((*carry, "text"))).mapInArrow(measure, schema)


def low_quantile(scores: DataFrame, share: float) -> float | None:
    """Exact quantile of the column ``llr``, interpolated; only the rows up to it are ordered and reach the driver."""
    n = scores.count()
    if not n:
        return None
    place = share * (n - 1)
    at = int(place)
    least = scores.select("llr").orderBy("llr").limit(min(n, at + 2)).toArrow()["llr"].to_numpy()
    low, high = float(least[at]), float(least[min(at + 1, n - 1)])
    return low + (high - low) * (place - at)


def threshold(trusted: DataFrame) -> float:
    """Least score that is kept: a low quantile of the judged trusted documents that pass the base rules."""
    from boxtrail.runtime import materialize

    least = low_quantile(materialize(trusted.where("not base_failed").select("llr"), "trusted_scores"), QUANTILE)
    return -np.inf if least is None else least - SLACK


def judged(rows: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def quality_rules(docs: DataFrame, labels: DataFrame, *carry: str) -> DataFrame:
    """carry columns, base measures, llr, base_failed and kept, one row per input row.

    Texts meet the labels once, to be counted, by a shuffle at every size of the labels. All documents are then measured
    once, where they are read, and only their measures meet the labels to set the threshold.
    """
    from boxtrail.runtime import materialize

    good = trusted_ids(labels).hint("merge")
    ratios = log_ratios(bucket_counts(docs), bucket_counts(docs.select("doc_id", "text").join(good, "doc_id", "left_semi")))
    own = tuple(dict.fromkeys((*carry, "doc_id")))
    rows = judged(materialize(measured(docs, ratios, *own), "quality_measures"))
    least = threshold(rows.join(good, "doc_id", "left_semi"))
    return rows.select(*carry, *FIELDS, "base_failed").withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(least)))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base measures and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id")
    return rows.select("doc_id", *FIELDS[:-1], "base_failed", "kept", "llr")
