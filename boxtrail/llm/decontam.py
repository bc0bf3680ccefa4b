"""Benchmark decontamination by spaced seeds.

A mask slides over the words of a text and hashes only some of the positions it covers, so a window still matches when
words at the ignored positions were replaced. Windows of the corpus are tested against a Bloom filter of the benchmark's
windows, whose size is fixed; documents with a survivor keep their word hashes and join the benchmark's windows by hash.
Each hit names a diagonal, an alignment of a document with an item; the words around the hit are compared along it.

Words are runs of letters and digits, in lower case. An item is found in a document when verified stretches (at least
``MIN_MATCHED`` equal words, or the whole item, 80 % of the aligned words equal) cover at least half of the item, or when
one of them has ``PASSAGE`` equal words, however long the item is. ``PASSAGE`` is above ``SPAN``: so many words in a row
fill every mask, so a verbatim passage always has a seed.

Null and empty texts have no words and match nothing; items of up to ``MIN_MATCHED`` words are found only as a whole, a
single word too where ``least`` asks for it. By default, and where documents are cleaned by them, items have ``TELLING``
words or more, as fewer words occur anywhere and say nothing about a source. Repeated rows of a document give one result; equal doc_ids with different
texts are searched one by one. An empty corpus or benchmark gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import columns_of, documents, mix, slices, text_key, word_hashes
from boxtrail.runtime import materialize

# Nine of twelve words each; together they keep a hit on most ways to replace a word in five of a long item.
MASKS = ("110110110111", "111011011011", "110011101111", "101111001111", "111100110111", "101011110111")
# Five of five to eight words each, for items of fewer than LIGHT_BELOW words, which have few places for the long ones.
LIGHT = ("11111", "110111", "1101011", "11001011")
LIGHT_BELOW = 30
SPAN = len(MASKS[0])
TELLING = 5
MIN_MATCHED = 8
IDENTITY = 0.8
COVERED = 0.5
PASSAGE = 13
FILTER_BITS = (26, 30)  # least and most: 8 and 128 MB
BITS_A_SEED = 128  # with four probes one window in a million passes by chance; a text has thousands
PROBES = 4
CHUNK = 1 << 21


def masks_for(short: list[int]) -> list[tuple[int, ...]]:
    """Offsets of every mask for items of the ``short`` lengths, all below ``LIGHT_BELOW``, and of any longer ones.

    Items of up to ``MIN_MATCHED`` words must match as a whole and have a full mask of their length.
    """
    light = LIGHT if any(n > MIN_MATCHED for n in short) else ()
    spaced = [tuple(i for i, c in enumerate(m) if c == "1") for m in (*MASKS, *light)]
    return list(dict.fromkeys(spaced + [tuple(range(n)) for n in sorted(short) if n <= MIN_MATCHED]))


def windows(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the mask at every place where it fits."""
    span = offsets[-1] + 1
    n = max(0, len(words) - span + 1)
    h = np.full(n, span * 131 + len(offsets), np.uint64)
    for k, o in enumerate(offsets):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[o : o + n] + np.uint64(k + 1) * np.uint64(o + 1)
    return mix(h)


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield (h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)


def benchmark_seeds(benchmark: DataFrame, item: str = "item_id", least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(item, words) and (item, pos, seed) of items of ``least`` words or more, both written once."""
    kind = benchmark.schema[item].dataType.simpleString()

    def words(batches):
        for b in batches:
            ids, texts = columns_of(b, "item_id", "text")
            h, sizes = word_hashes(texts)
            parts = np.split(h.view(np.int64), np.cumsum(sizes)[:-1]) if len(texts) else []
            keep = [i for i, n in enumerate(sizes) if n >= max(1, least)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], b.schema.field("item_id").type), pa.array([parts[i] for i in keep], pa.list_(pa.int64()))], names=["item_id", "words"])

    items = materialize(benchmark.select(F.col(item).alias("item_id"), "text").distinct().mapInArrow(words, f"item_id {kind}, words array<long>"), "benchmark_words")

    def seeds(batches):
        for b in batches:
            ids, lists = columns_of(b, "item_id", "words")
            out: list[tuple] = []
            for i, w in zip(ids, lists):
                w = np.array(w, np.int64).view(np.uint64)
                for offsets in masks_for([len(w)] if len(w) < LIGHT_BELOW else []):
                    out += ((i, k, s) for k, s in enumerate(windows(w, offsets).view(np.int64).tolist()))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("item_id").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["item_id", "pos", "seed"])

    return items, materialize(items.mapInArrow(seeds, f"item_id {kind}, pos int, seed long"), "benchmark_seeds")


def filter_bits(n_seeds: int) -> int:
    """Size of the filter as a power of two: ``BITS_A_SEED`` for each seed, within ``FILTER_BITS``."""
    return min(max(FILTER_BITS[0], (BITS_A_SEED * max(1, n_seeds) - 1).bit_length()), FILTER_BITS[1])


def bloom_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bits of the benchmark's windows, eight to a byte: 2**bits / 8 bytes.

    A fuller filter lets more documents through to the join; it never hides a hit.
    """

    def places(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate(list(_probes(h, bits)))) if len(h) else np.zeros(0, np.uint64)
            word, bit = (at >> np.uint64(5)).astype(np.int64), np.int64(1) << (at & np.uint64(31)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"word": word, "bit": bit})

    rows = seeds.select("seed").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return table.view(np.uint8)


def suspects(docs: DataFrame, table: np.ndarray, short: list[int]) -> DataFrame:
    """doc_id, text_key, words, seeds, places: documents with a window that passes the filter."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(table)
    bits = (8 * len(table)).bit_length() - 1

    def search(batches):
        seen, masks, light = shared.value, masks_for(short), masks_for([LIGHT_BELOW - 1])
        for b in batches:
            ids, keys, texts = columns_of(b, "doc_id", "text_key", "text")
            out: list[tuple] = []
            for lo, hi in slices(texts, CHUNK):
                words, sizes = word_hashes(texts[lo:hi])
                ends = np.cumsum(sizes)
                owner = np.repeat(np.arange(hi - lo), sizes)
                found_seed, found_at = [], []
                for offsets in masks:
                    h = windows(words, offsets)
                    at = np.arange(len(h))
                    for p in _probes(h, bits):
                        ok = (seen[p[at] >> np.uint64(3)] >> (p[at] & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        at = at[ok]
                    at = at[at + offsets[-1] < ends[owner[at]]]  # a window stays inside its document
                    if offsets not in light:  # a whole item: its first place tells all
                        _, first = np.unique(np.stack((owner[at].view(np.uint64), h[at])), axis=1, return_index=True)
                        at = at[np.sort(first)]
                    found_seed.append(h[at])
                    found_at.append(at)
                seed, at = np.concatenate(found_seed), np.concatenate(found_at)
                order = np.argsort(owner[at], kind="stable")
                seed, at = seed[order], at[order]
                who, first = np.unique(owner[at], return_index=True)
                for d, s, p in zip(who, np.split(seed, first[1:]), np.split(at, first[1:])):
                    start = ends[d] - sizes[d]
                    out.append((ids[lo + d], keys[lo + d], words[start : ends[d]].view(np.int64), s.view(np.int64), (p - start).astype(np.int32)))
            cols = list(zip(*out)) or [()] * 5
            kinds = [b.schema.field("doc_id").type, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "text_key", "words", "seeds", "places"])

    rows = docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(search, f"doc_id {kind}, text_key string, words array<long>, seeds array<long>, places array<int>")
    return materialize(rows.dropDuplicates(["doc_id", "text_key"]), "suspects")


def best_stretch(same: np.ndarray, loss: int) -> tuple[int, int]:
    """Start and end of the stretch with the largest sum, an equal word counting 1 and an unequal one -loss."""
    run = np.concatenate(([0], np.cumsum(np.where(same, 1, -loss))))
    end = int((run - np.minimum.accumulate(run)).argmax())
    return int(run[: end + 1].argmin()), end


def aligned(doc: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple[int, int, int]:
    """(equal words, item words covered, equal words of the best stretch) of the verified stretches along the diagonals.

    On a diagonal the stretch is the one with the largest sum, an unequal word costing two equal ones, or four where the
    stretch is below ``IDENTITY`` otherwise; where that is too short, all from the first to the last equal word, if enough
    of it is equal. Further stretches are sought on both sides of it.
    """
    covered, equal, most = np.zeros(len(item), bool), np.zeros(len(item), bool), 0
    for shift in diagonals:
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        if hi <= lo:
            continue
        same = doc[lo + shift : hi + shift] == item[lo:hi]
        todo = [(0, hi - lo)]
        while todo:
            a, b = todo.pop()
            if same[a:b].sum() < min(MIN_MATCHED, len(item)):
                continue
            start, end = best_stretch(same[a:b], 2)
            if same[a + start : a + end].mean() < IDENTITY:
                start, end = best_stretch(same[a:b], 4)
            if same[a + start : a + end].sum() < min(MIN_MATCHED, len(item)):
                ends = np.flatnonzero(same[a:b])[[0, -1]]
                if same[a + ends[0] : a + ends[1] + 1].mean() >= IDENTITY:
                    start, end = int(ends[0]), int(ends[1]) + 1
            part = same[a + start : a + end]
            if part.sum() >= min(MIN_MATCHED, len(item)):
                covered[lo + a + start : lo + a + end] = True
                equal[lo + a + start : lo + a + end] |= part
                most = max(most, int(part.sum()))
            todo += [(a, a + start), (a + end, b)]
    return int(equal.sum()), int(covered.sum()), most


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = TELLING) -> DataFrame:
    """doc_id, text_key, item_id, item_words, matched, covered: verified overlaps with items of ``least`` words or more.

    ``matched`` and ``covered`` count words of the item over all its verified stretches in the document.
    """
    items, seeds = benchmark_seeds(benchmark, least=least)
    lengths = items.agg(F.collect_set(F.when(F.size("words") < LIGHT_BELOW, F.size("words"))).alias("n")).first()["n"]  # fewer than LIGHT_BELOW values
    found = suspects(docs, bloom_filter(seeds, filter_bits(seeds.count())), lengths)
    hits = found.select("doc_id", "text_key", F.inline(F.arrays_zip("seeds", "places"))).join(seeds, F.col("seeds") == F.col("seed"))
    pairs = hits.groupBy("doc_id", "text_key", "item_id").agg(F.collect_set(F.col("places") - F.col("pos")).alias("diagonals"))
    same = F.col("p.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("p.text_key") == F.col("f.text_key"))
    both = pairs.alias("p").join(found.select("doc_id", "text_key", F.col("words").alias("doc_words")).alias("f"), same).join(items.alias("i"), F.col("p.item_id").eqNullSafe(F.col("i.item_id"))).select("p.*", "doc_words", "words")
    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("doc_id", "text_key", "item_id")]

    def verify(batches):
        for b in batches:
            rows = [aligned(np.array(d), np.array(w), x) for d, w, x in zip(*columns_of(b, "doc_words", "words", "diagonals"))]
            size = [len(w) for (w,) in zip(*columns_of(b, "words"))]
            numbers = [size, *([r[k] for r in rows] for k in range(3))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text_key", "item_id")), *(pa.array(x, pa.int32()) for x in numbers)], names=["doc_id", "text_key", "item_id", "item_words", "matched", "covered", "most"])

    out = both.mapInArrow(verify, ", ".join([*kinds, "item_words int", "matched int", "covered int", "most int"]))
    return out.where((F.col("matched") > 0) & ((F.col("covered") >= F.lit(COVERED) * F.col("item_words")) | (F.col("most") >= PASSAGE))).drop("most")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item of ``TELLING`` words or more, with all their columns as they are."""
    hit = overlaps(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct()
    hit = materialize(hit, "benchmark_hits")  # of known size: a few hits go to the texts, many meet them by key
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key().alias("key"))
    return whole.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left_anti").select("row.*")


def op10_benchmark_overlaps(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items of any length, with the items."""
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), least=1).drop("text_key")
