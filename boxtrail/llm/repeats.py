"""Removal of repeated byte strings by prefix-free parsing.

Every byte that a string of ``WIDTH`` bytes covers goes if that string also starts earlier in the corpus (smaller
doc_id, or earlier in the same document). Documents are parsed into phrases around rolling-hash triggers
(``parsing``); equal strings lie at equal offsets from equal triggers. The steps:

1. Parse. Of equal phrases in one run of texts only the first is sent on, the others are known to repeat.
2. Dictionary: rows meet by trigger. A phrase that occurred earlier repeats as a whole. A phrase whose trigger has only
   one content is unique as a whole. Both need no text.
3. Order inside the dictionary: what is left are the first occurrences of phrases that share a trigger but not their
   content, mostly the edges of copied passages. Their bytes are fetched, and their suffixes of ``WIDTH`` bytes are put
   into classes of equal strings in corpus order; all but the first of a class repeat. Classes are named by hash
   instead of by rank in alphabetical order, as only equality and corpus order count here.
4. Ranges meet their texts and are cut out.

Triggers with more than ``GROUP`` contents spread their suffixes over all tasks by their hash; others are ordered
together. Both ways give the same result.

Null text: empty. Null doc_id: before all others. Documents with one doc_id and different texts follow each other by a
hash of the text; equal rows are one document, returned for each row. An empty table gives an empty result. Other
columns are ignored. Hashes have 64 bits for the trigger and 64 more for the content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxtrail.llm.common import columns_of, documents, mix, slices
from boxtrail.llm.parsing import BASES, MAX_BLOCK, Rolling, parse
from boxtrail.runtime import materialize

WIDTH = 100
GROUP = 20_000
CHUNK = 1 << 20
DOC = ["doc", "tag"]


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tag, text: ``tag`` tells apart rows that share a doc_id; it is 0 where no doc_id repeats."""
    repeated = not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    tag = F.hash(F.coalesce("text", F.lit(""))) if repeated else F.lit(0)
    return docs.select(F.col("doc_id").alias("doc"), tag.alias("tag"), "text")


def _blocks(raw: list[bytes]) -> Iterator[tuple[int, int, int, bytes, np.ndarray]]:
    """(first document, end, offset in it, bytes, sizes): runs of whole documents, or overlapping parts of a very long one."""
    for lo, hi in slices(raw, CHUNK):
        block = b"".join(raw[lo:hi])
        if len(block) <= MAX_BLOCK:
            yield lo, hi, 0, block, np.array([len(x) for x in raw[lo:hi]])
            continue
        for at in range(0, len(block) - WIDTH + 1, MAX_BLOCK - WIDTH + 1):
            part = block[at : at + MAX_BLOCK]
            yield lo, hi, at, part, np.array([len(part)])


def phrase_rows(texts: DataFrame) -> DataFrame:
    """trigger, content, doc, tag, start, strings, offset: phrases, each once per run of texts.

    Rows without content say that ``strings`` strings from ``start`` on repeat, as an equal phrase stands earlier in the
    same run.
    """
    kind = texts.schema["doc"].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, tags, own = columns_of(b, "doc", "tag", "text")
            order = sorted(range(len(docs)), key=lambda i: (docs[i] is not None, docs[i] if docs[i] is not None else 0, tags[i]))
            docs, tags, raw = pa.array([docs[i] for i in order], b.schema.field("doc").type), np.array([tags[i] for i in order], np.int32), [_bytes(own[i]) for i in order]
            codes = _codes(docs, tags)
            for lo, hi, skipped, block, sizes in _blocks(raw):
                p, _ = parse(np.frombuffer(block, np.uint8), sizes, WIDTH)
                if not len(p.doc):
                    continue
                base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                start = p.first - base[p.doc] + skipped
                by = np.lexsort((np.arange(len(p.doc)), p.content, p.name))
                new = np.concatenate(([True], (p.name[by][1:] != p.name[by][:-1]) | (p.content[by][1:] != p.content[by][:-1])))
                head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
                again = np.zeros(len(by), bool)
                again[by] = ~new
                same_place = np.zeros(len(by), bool)  # equal rows of one document are not earlier than each other
                same_place[by] = (start[by] == start[head]) & (codes[lo:hi][p.doc[by]] == codes[lo:hi][p.doc[head]])
                # Repeating phrases that follow each other are one row.
                keep = np.flatnonzero(~(again & same_place))
                joins = again[keep][1:] & again[keep][:-1] & (p.doc[keep][1:] == p.doc[keep][:-1]) & (p.first[keep][1:] == p.last[keep][:-1] + 1)
                head = np.flatnonzero(np.concatenate(([True], ~joins)))
                strings = np.add.reduceat(p.last[keep] - p.first[keep] + 1, head)
                keep = keep[head]
                d, again, start = p.doc[keep] + lo, again[keep], start[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(again, mix(p.doc[keep].astype(np.uint64) + p.content[keep]), p.name[keep]).view(np.int64)),
                        pa.array(p.content[keep].view(np.int64), mask=again),
                        docs.take(pa.array(d)),
                        pa.array(tags[d]),
                        pa.array(start.astype(np.int32)),
                        pa.array(strings.astype(np.int32)),
                        pa.array((p.trigger - p.first)[keep].astype(np.int16)),
                    ],
                    names=["trigger", "content", "doc", "tag", "start", "strings", "offset"],
                )

    return texts.mapInArrow(parsed, f"trigger long, content long, doc {kind}, tag int, start int, strings int, offset short")


def _codes(docs: pa.Array, tags: np.ndarray) -> np.ndarray:
    """A number for each document, equal for equal (doc, tag)."""
    ids = docs.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return (ids << 32) + tags.astype(np.int64)


def dictionary(rows: DataFrame) -> DataFrame:
    """doc, tag, start, strings, trigger, offset, contents: what repeats, and what has to be ordered.

    ``trigger`` is null for strings that repeat. Otherwise the phrase is the first of its content, and ``contents``
    counts the different contents of its trigger. One exchange and one sort serve all windows.
    """
    place = ["doc", "tag", "start"]
    inside = W.partitionBy("trigger", "content").orderBy(*place)
    all_ = W.partitionBy("trigger")
    dealt = rows.repartition("trigger")
    seen = dealt.withColumn("nth", F.row_number().over(inside)).withColumn("rank", F.rank().over(inside))
    first = F.col("content").isNotNull() & (F.col("nth") == 1)
    seen = seen.withColumn("contents", F.sum(F.when(first, 1).otherwise(0)).over(all_))
    repeats = F.col("content").isNull() | (F.col("rank") > 1)
    kept = seen.where(repeats | (first & (F.col("contents") > 1)))
    return kept.select(*place, "strings", F.when(~repeats, F.col("trigger")).alias("trigger"), "offset", "contents")


def _packed(texts: DataFrame) -> DataFrame:
    """Texts as compressed bytes, for the shuffles that bring them to their ranges."""
    kind = texts.schema["doc"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for b in batches:
            (own,) = columns_of(b, "text")
            raw = [_bytes(t) for t in own]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc")), b.column(b.schema.get_field_index("tag")), pa.array([len(x) for x in raw], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], names=["doc", "tag", "n_bytes", "packed"])

    return texts.mapInArrow(pack, f"doc {kind}, tag int, n_bytes long, packed binary")


def _same_doc(a: str, b: str):
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.tag") == F.col(f"{b}.tag"))


def phrase_bytes(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """The rows of ``open_`` with the bytes of their phrase."""
    fields = ["start", "strings", "trigger", "offset", "contents"]
    per_doc = open_.groupBy(*DOC).agg(F.collect_list(F.struct(*fields)).alias("phrases"))
    both = _packed(texts).alias("t").join(per_doc.alias("p"), _same_doc("t", "p")).select("t.doc", "t.tag", "n_bytes", "packed", "phrases").dropDuplicates(DOC)
    kind = texts.schema["doc"].dataType.simpleString()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            who, data = [], []
            lists = b.column(b.schema.get_field_index("phrases"))
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            starts, strings = flat.field("start").to_numpy(), flat.field("strings").to_numpy()
            at = 0
            for i, (n, packed) in enumerate(zip(*columns_of(b, "n_bytes", "packed"))):
                raw = codec.decompress(packed, n, asbytes=True) if n else b""
                for k in range(at, at + sizes[i]):
                    data.append(raw[starts[k] : starts[k] + strings[k] - 1 + WIDTH])
                who += [i] * sizes[i]
                at += sizes[i]
            take = pa.array(who, pa.int64())
            doc, tag = (b.column(b.schema.get_field_index(c)).take(take) for c in DOC)
            yield pa.RecordBatch.from_arrays([doc, tag, *(flat.field(c) for c in fields), pa.array(data, pa.binary())], names=[*DOC, *fields, "bytes"])

    return both.mapInArrow(fetch, f"doc {kind}, tag int, start int, strings int, trigger long, offset short, contents long, bytes binary")


def _strings(rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in its document, name) of every string of the phrases; equal strings at equal offsets share a name."""
    data, strings = rows["bytes"], rows["strings"].astype(np.int64)
    sizes = strings - 1 + WIDTH
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    row = np.repeat(np.arange(len(strings)), strings)
    k = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = base[row] + k
    content = Rolling(np.frombuffer(b"".join(data), np.uint8), BASES[1]).some(at, at + WIDTH)
    name = mix(content + mix(rows["trigger"].view(np.uint64)[row] + (rows["offset"][row] - k).astype(np.uint64)))
    return row, rows["start"].astype(np.int64)[row] + k, name


def _columns(table: pa.Table) -> dict:
    out = {c: table[c].to_numpy() for c in ("start", "strings", "trigger", "offset")}
    out["bytes"] = table["bytes"].to_pylist()
    return out


def ordered_together(rows: DataFrame) -> DataFrame:
    """doc, tag, start, strings: repeating strings of phrases whose trigger has few contents.

    Tasks read their phrases by trigger and corpus order; a trigger's phrases are kept together across batches.
    """
    kind = rows.schema["doc"].dataType.simpleString()
    sorted_ = rows.repartition("trigger").sortWithinPartitions("trigger", *DOC, "start")

    def judge(table: pa.Table) -> pa.RecordBatch:
        row, start, name = _strings(_columns(table))
        by = np.argsort(name, kind="stable")
        again = np.zeros(len(by), bool)
        again[by[1:]] = name[by][1:] == name[by][:-1]
        new = again & np.concatenate(([True], ~again[:-1] | (row[1:] != row[:-1])))
        first = np.flatnonzero(new)
        length = np.add.reduceat(again, first) if len(first) else np.zeros(0, np.int64)
        take = pa.array(row[first])
        doc, tag = (table[c].combine_chunks().take(take) for c in DOC)
        return pa.RecordBatch.from_arrays([doc, tag, pa.array(start[first].astype(np.int32)), pa.array(length.astype(np.int32))], names=[*DOC, "start", "strings"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            trigger = b.column(b.schema.get_field_index("trigger")).to_numpy()
            last = int(np.searchsorted(trigger, trigger[-1]))  # from here on the trigger may go on in the next batch
            if last:
                yield judge(pa.Table.from_batches([*kept, b.slice(0, last)]))
                kept = []
            elif kept and kept[-1].column(kept[-1].schema.get_field_index("trigger"))[-1].as_py() != trigger[0]:
                yield judge(pa.Table.from_batches(kept))
                kept = []
            kept.append(b.slice(last))
        if kept:
            yield judge(pa.Table.from_batches(kept))

    return sorted_.mapInArrow(order, f"doc {kind}, tag int, start int, strings int")


def ordered_apart(rows: DataFrame) -> DataFrame:
    """The same for triggers with very many contents: strings meet by name, the first of a class is an aggregate."""
    kind = rows.schema["doc"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b])
            row, start, name = _strings(_columns(table))
            doc, tag, trigger = (table[c].combine_chunks().take(pa.array(row)) for c in (*DOC, "trigger"))
            yield pa.RecordBatch.from_arrays([trigger, pa.array(name.view(np.int64)), doc, tag, pa.array(start.astype(np.int32))], names=["trigger", "name", *DOC, "start"])

    strings = rows.mapInArrow(each, f"trigger long, name long, doc {kind}, tag int, start int")
    place = F.struct(*DOC, "start")
    least = strings.groupBy("trigger", "name").agg(F.min(place).alias("least"))
    return strings.join(least, ["trigger", "name"]).where(place > F.col("least")).select(*DOC, "start", F.lit(1).alias("strings"))


def cut(texts: DataFrame, ranges: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc, tag, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the remaining bytes), one row per input row."""
    kind = texts.schema["doc"].dataType.simpleString()
    per_doc = ranges.groupBy(*DOC).agg(F.collect_list("start").alias("starts"), F.collect_list("strings").alias("strings"))
    both = _packed(texts).alias("t").join(per_doc.alias("r"), _same_doc("t", "r"), "left").select("t.doc", "t.tag", "n_bytes", "packed", "starts", "strings")
    schema = f"doc {kind}, tag int, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            out = []
            for n, packed, starts, strings in zip(*columns_of(b, "n_bytes", "packed", "starts", "strings")):
                raw = codec.decompress(packed, n, asbytes=True) if n else b""
                removed = spans = 0
                if starts:
                    edge = np.zeros(n + 1, np.int64)
                    s = np.array(starts, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + np.array(strings, np.int64) - 1 + WIDTH, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((n, removed, spans, hashlib.sha256(raw).hexdigest(), raw))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + keep_text]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + keep_text]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc")), b.column(b.schema.get_field_index("tag")), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc", "tag", *names])

    return both.mapInArrow(remove, schema)


def repeated_ranges(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """doc, tag, start, strings: ``strings`` consecutive strings from byte ``start`` on that also start earlier."""
    known = materialize(dictionary(phrase_rows(texts)), "phrases")
    pieces = materialize(phrase_bytes(texts, known.where(F.col("trigger").isNotNull())), "phrase_bytes")
    place = [*DOC, "start", "strings"]
    found = ordered_together(pieces.where(F.col("contents") <= group)).unionByName(ordered_apart(pieces.where(F.col("contents") > group)))
    return known.where(F.col("trigger").isNull()).select(*place).unionByName(found.select(*place))


def remove_repeats(docs: DataFrame, group: int = GROUP, keep_text: bool = False) -> DataFrame:
    texts = keyed(docs)
    return cut(texts, repeated_ranges(texts, group), keep_text).withColumnRenamed("doc", "doc_id").drop("tag")


def op9_repeated_strings(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that are left without repeated strings of 100 bytes."""
    return remove_repeats(documents(spark, sf_dir))
