"""Token counts by an exact length histogram.

Every document is encoded once, whole; only its length leaves the task. Lengths are counted exactly, and suffix sums
over the histogram answer totals, quantiles and truncated totals for every context limit without another pass.

Null and empty texts have length 0. Repeated rows count as often as they occur. An empty table gives an empty
histogram. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxtrail.llm.common import columns_of, documents, encoder
from boxtrail.runtime import materialize

BLOCK = 1024


def token_lengths(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """n_tokens per input row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab)
        for batch in batches:
            (texts,) = columns_of(batch, "text")
            yield pa.RecordBatch.from_pydict({"n_tokens": np.array([len(encode(t)) if t else 0 for t in texts], dtype=np.int64)})

    return docs.select("text").mapInArrow(count, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: one row per occurring length, combined on the map side."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """The histogram with running totals, and what a context limit of that very length keeps.

    Sums run inside blocks of ``block`` lengths; only one row per block is summed across blocks, so no task holds the
    histogram as a whole. Between two occurring lengths all of these are linear in the limit (see ``at_limits``).
    """
    n, docs = F.col("n_tokens"), F.col("n_docs")
    rows = hist.select("n_tokens", "n_docs", (n * docs).alias("tokens"), F.floor(n / block).alias("block"))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(W.partitionBy()).alias("all_docs"),
        F.sum("block_tokens").over(W.partitionBy()).alias("all_tokens"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = rows.join(totals, "block").withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("later_docs")).withColumn("tokens_at_least", F.sum("tokens").over(inside) + F.col("later_tokens"))
    return out.select(
        "n_tokens", "n_docs", "tokens", "docs_at_least", "tokens_at_least",
        (F.col("all_docs") - F.col("docs_at_least") + docs).alias("docs_at_most"),
        (F.col("all_tokens") - F.col("tokens_at_least") + n * F.col("docs_at_least")).alias("truncated_total"),
        (F.col("tokens_at_least") - n * F.col("docs_at_least")).alias("cut_tokens"),
        "all_docs", "all_tokens",
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, total, truncated_total, docs_cut, for any limits, exactly; an empty histogram gives zeros."""
    n, docs = F.col("n_tokens"), F.col("n_docs")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = [F.struct(F.lit(int(x)).cast("long").alias("limit"), zero(n * docs).alias("total"), zero(F.least(n, F.lit(int(x))) * docs).alias("truncated_total"), zero(F.when(n > x, docs)).alias("docs_cut")) for x in limits]
    return hist.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def quantiles(sums: DataFrame, levels: list[float]) -> DataFrame:
    """level, n_tokens: the least length that at least that share of the documents does not exceed."""
    rows = [F.struct(F.lit(float(q)).alias("level"), F.min(F.when(F.col("docs_at_most") >= F.greatest(F.lit(1), F.ceil(F.col("all_docs") * F.lit(float(q)))), F.col("n_tokens"))).alias("n_tokens")) for q in levels]
    return sums.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def op1_token_histogram(spark, sf_dir: str) -> DataFrame:
    """Length histogram of all documents with its suffix sums."""
    return suffix_sums(materialize(histogram(token_lengths(documents(spark, sf_dir, "text"))), "token_histogram"))
