"""Sequence packing, shortest pack first over the length histogram.

Each document is encoded once and cut into pieces of at most one sequence. The histogram of piece lengths (at most
``capacity`` rows) is packed on the driver: lengths are placed longest first, always into the pack with the least
tokens so far, whole groups of equal packs at a time. A placement says which ranks of a length go to which run of
sequences; pieces get their rank in their length and join the placements.

Null text: an empty document, which still has its end id. Repeated rows are packed as often as they occur. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxtrail.llm.common import columns_of, documents, encoder
from boxtrail.runtime import materialize

CAPACITY = 2048
END_ID = 1
RANK_BUCKETS = 1024
COPIES_A_ROW = 1024
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
PIECES = "doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocab: str | None = None) -> DataFrame:
    """Pieces of each row's ids: full ones first, then what is left."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(*columns_of(batch, "doc_id", "text")):
                ids = np.array([*(encode(text) if text else ()), end_id], dtype="<u4")
                raw = memoryview(ids.tobytes())
                for start in range(0, len(ids), capacity):
                    end = min(len(ids), start + capacity)
                    out.append((doc, start, end - start, zlib.crc32(raw[4 * start : 4 * end]), len(ids)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(id_type=id_type))


def shortest_pack_first(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, last rank, first sequence, offset).

    A heap entry stands for a run of ``n`` sequences with equal contents; placing a length fills whole runs and splits
    at most the last one. Ties go to the lower sequence.
    """
    heap: list[tuple[int, int, int]] = []  # tokens so far, first sequence, sequences
    out, fresh = [], 0
    for length in sorted(hist, reverse=True):
        rank, left = 0, hist[length]
        while left:
            if heap and heap[0][0] + length <= capacity:
                used, first, n = heapq.heappop(heap)
            else:
                used, first, n = 0, fresh, left
                fresh += left
            take = min(left, n)
            if used + length < capacity:
                heapq.heappush(heap, (used + length, first, take))
            if take < n:
                heapq.heappush(heap, (used, first + take, n - take))
            out.append((length, rank, rank + take - 1, first, used))
            rank, left = rank + take, left - take
    return out


def numbered(cut: DataFrame) -> DataFrame:
    """The pieces with ``ordinal``, 0 for one of each kind and counting on for equal ones.

    Equal pieces are counted, not moved, and written out ``COPIES_A_ROW`` at a time, so no task makes or sorts all
    copies of a piece.
    """
    counted = cut.groupBy(*PIECE).agg(F.count(F.lit(1)).alias("n"))
    step = F.lit(COPIES_A_ROW).cast("long")
    parts = counted.select(*PIECE, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)).alias("first"))
    return parts.select(*PIECE, F.explode(F.sequence("first", F.least(F.col("first") + step, "n") - 1)).alias("ordinal"))


def ranked(cut: DataFrame, buckets: int = RANK_BUCKETS) -> DataFrame:
    """``length_rank``: a piece's place among all pieces of its length, gapless from 0.

    A length is counted in ``buckets`` hash buckets, and equal pieces are dealt out by their ordinal, so neither a length
    nor a piece that many rows share is a single task.
    """
    rows = numbered(cut).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "ordinal"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "ordinal")) - 1
    return rows.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("length_rank", F.col("before") + F.col("inside")).drop("bucket", "inside", "before", "ordinal")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocab: str | None = None) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, end_id, vocab), "pack_pieces")
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    placed = spark.createDataFrame(shortest_pack_first(hist, capacity), "length long, first_rank long, last_rank long, first_sequence long, offset long")
    fits = F.col("length_rank").between(F.col("first_rank"), F.col("last_rank"))
    joined = ranked(cut).alias("r").join(F.broadcast(placed).alias("p"), (F.col("r.length") == F.col("p.length")) & fits)
    return joined.select("r.doc_id", "r.start", "r.length", "r.ids_crc32", "r.doc_tokens", (F.col("first_sequence") + F.col("length_rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(documents(spark, sf_dir))
