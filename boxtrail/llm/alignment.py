"""Alignment of two tokenizers over the same bytes.

Each text is encoded, behind one space, by a byte-level BPE (A) and by a sentencepiece BPE that adds the space itself
(B). The tokenizers' own spans are the coarse cuts: character offsets of A, byte spans of B (as the immutable proto held
them; the library now calls this form ``offset_mapping``). Where a span is not as long as the token's decoded bytes - A
cuts inside a multibyte character, B falls back to single bytes - the cuts are refined by adding up decoded bytes. Byte
offsets where tokens of both end form groups, and the two tokens that end there are linked.

Corpus-wide counts of linked id pairs travel by chunks. A task gathers whole documents up to ``CHUNK`` links, names the
chunk's distinct pairs once, and stores links as numbers into them. Only these distinct pairs are summed over the corpus
and joined back with their counts, chunk by chunk; links themselves are never exploded, and no table of all pairs is
broadcast or gathered.

A text is cut before single spaces between two other characters, where neither tokenizer joins anything (checked on B's
vocabulary; A's pattern never does), so its tokens are those of its segments. A task keeps the alignment of up to ``KEPT``
short segments it has met; unknown ones are joined up to ``PART`` characters and aligned in one go. A text without such
a place is one segment. A document of more than ``CHUNK`` links is stored as several rows of a chunk each. Null and empty
texts, and texts whose tokens do not give the very bytes back (U+2581 in the text), have no tokens: zeros and an empty
groups string. Rows that are repeated count as often as they occur. Equal highest counts all are best. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import columns_of, documents, vocabulary
from boxtrail.runtime import materialize

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 1 << 20
PART = 1 << 18
KEPT = 1 << 18
KEPT_CHARS = 200
PAIR_BITS = 32
SPACE_MARK = "▁"
FALLBACK = re.compile(r"<0x([0-9A-F]{2})>")
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


UNKNOWN = object()


class Tokens(NamedTuple):
    ids: np.ndarray
    ends: np.ndarray  # byte offsets


class Tokenizers:
    """Both tokenizers and, for every id, its decoded bytes."""

    def __init__(self, place_a: str, place_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(place_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=place_b)
        alphabet, entries = byte_alphabet(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes.fromhex(m[1]) if (m := FALLBACK.fullmatch(p)) else p.replace(SPACE_MARK, " ").encode() for p in pieces]
        self.splits = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        self.sizes_a, self.sizes_b = (np.array([len(b) for b in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.names = np.array([str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object)

    def segments(self, text: str) -> list[str]:
        """The text cut before single spaces; each segment stands for a space and itself."""
        return BETWEEN.split(text) if self.splits else [text]

    def spans_a(self, text: str, raw: bytes) -> Tokens | None:
        code = self.a.encode(text, add_special_tokens=False)
        ids = np.array(code.ids, np.int64)
        if b"".join(map(self.bytes_a.__getitem__, code.ids)) != raw:
            return None
        spans = pairs_of(code.offsets)
        if len(raw) != len(text):  # characters to bytes
            spans = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))[spans]
        return Tokens(ids, refined(spans, self.sizes_a[ids]))

    def spans_b(self, text: str, raw: bytes) -> Tokens | None:
        code = self.b.encode(text, return_type="offset_mapping", return_bytes=True)
        ids = np.array(code["ids"], np.int64)
        if b"".join(map(self.bytes_b.__getitem__, code["ids"])) != raw:
            return None
        spans = pairs_of(code["offsets"]) + 1  # the space that B adds has no span
        spans[0, 0] = 0
        return Tokens(ids, refined(spans, self.sizes_b[ids]))

    def align(self, text: str) -> tuple[Tokens, Tokens] | None:
        """Tokens of a space and the text by A and B; None if either does not give the bytes back."""
        raw = b" " + text.encode("utf-8", "surrogatepass")
        a = self.spans_a(" " + text, raw)
        b = self.spans_b(text, raw) if a else None
        return (a, b) if b else None


class Aligned(NamedTuple):
    n_a: int
    n_b: int
    links: np.ndarray  # A's id << PAIR_BITS | B's id, one per group
    groups: str


class Aligner:
    """Alignment of texts by segments, which it keeps."""

    def __init__(self, own: Tokenizers):
        self.own, self.kept = own, {}

    def together(self, segments: list[str]) -> list[Aligned | None]:
        """Segments aligned as one text; they must be cut where ``Tokenizers.segments`` would cut them."""
        found = self.own.align(" ".join(segments))
        if not found:
            return [None] if len(segments) == 1 else [self.together([s])[0] for s in segments]
        a, b = found
        cuts = np.intersect1d(a.ends, b.ends, assume_unique=True)
        links = a.ids[np.searchsorted(a.ends, cuts)] << PAIR_BITS | b.ids[np.searchsorted(b.ends, cuts)]
        stops = np.cumsum([len(s.encode("utf-8", "surrogatepass")) + 1 for s in segments])
        upto = np.searchsorted(cuts, stops) + 1
        sizes = [np.diff(np.searchsorted(side.ends, stops) + 1, prepend=0).tolist() for side in found]
        groups = groups_text(a, b, cuts, self.own.names, upto).split("\n")
        last = upto.tolist()
        return list(map(Aligned, *sizes, [links[i:j] for i, j in zip([0, *last], last)], groups))

    def learn(self, segments: list[str]) -> dict[str, Aligned | None]:
        """Alignment of segments not kept so far, kept from now on if short."""
        out: dict[str, Aligned | None] = {}
        run: list[str] = []
        size = 0
        for k, s in enumerate(segments):
            plain = bool(s) and not (s[0].isspace() or s[-1].isspace())
            if not plain:  # at an end of its text; not to be joined
                out[s] = self.together([s])[0]
            else:
                run.append(s)
                size += len(s)
            if run and (size > PART or k + 1 == len(segments)):
                out.update(zip(run, self.together(run)))
                run, size = [], 0
        if len(self.kept) + len(out) > KEPT:
            self.kept.clear()
        self.kept.update((s, found) for s, found in out.items() if len(s) <= KEPT_CHARS)
        return out

    def document(self, text: str | None) -> Aligned | None:
        """The whole text; None without tokens."""
        if not text:
            return None
        segments = self.own.segments(text)
        known = list(map(self.kept.get, segments, repeat(UNKNOWN)))
        new = {s: None for s, found in zip(segments, known) if found is UNKNOWN}
        if new:
            fresh = self.learn(list(new))
            known = [fresh[s] if found is UNKNOWN else found for s, found in zip(segments, known)]
        if None in known:
            return None
        n_a, n_b, links, groups = zip(*known)
        return Aligned(sum(n_a), sum(n_b), np.concatenate(links), ";".join(groups))


def pairs_of(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


def refined(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse span's where it is as long as the token, else counted on from the last such one."""
    total = np.cumsum(sizes)
    exact = spans[:, 1] - spans[:, 0] == sizes
    anchor = np.maximum.accumulate(np.where(exact, np.arange(len(sizes)), -1))
    before = np.where(anchor >= 0, spans[anchor, 1] - total[anchor], 0)
    return before + total


@lru_cache(1)
def tokenizers(place_a: str, place_b: str) -> Tokenizers:
    return Tokenizers(place_a, place_b)


def groups_text(a: Tokens, b: Tokens, cuts: np.ndarray, names: np.ndarray, lines: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: ids of A and B per group, a new line after each number of groups in ``lines``.

    Every token is written with what follows it and dealt to its place.
    """
    of_a, of_b = np.searchsorted(cuts, a.ends), np.searchsorted(cuts, b.ends)
    a_upto, b_upto = np.cumsum(np.bincount(of_a, minlength=len(cuts))), np.cumsum(np.bincount(of_b, minlength=len(cuts)))
    out = np.empty(2 * (len(a.ids) + len(b.ids)), object)
    at_a = np.arange(len(a.ids)) + np.concatenate(([0], b_upto))[of_a]
    at_b = np.arange(len(b.ids)) + a_upto[of_b]
    out[2 * at_a], out[2 * at_b] = names[a.ids], names[b.ids]
    out[2 * at_a + 1], out[2 * at_b + 1] = ",", ","
    out[2 * (a_upto + np.concatenate(([0], b_upto[:-1]))) - 1] = "|"
    ends = 2 * (a_upto + b_upto) - 1
    out[ends] = ";"
    out[ends[lines - 1]] = "\n"
    return "".join(out[:-1].tolist())


ROW = "row_id long, chunk long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, pairs array<long>, counts array<long>"


def encoded(docs: DataFrame, place_a: str | None = None, place_b: str | None = None, most: int = CHUNK) -> DataFrame:
    """Rows of documents with their links as numbers into the chunk's pairs, and one row per chunk with pairs and counts.

    Ids of rows and chunks hold the partition, so the table is to be written once and read again.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(tokenizers(place_a or vocabulary(TOKENIZER_A), place_b or vocabulary(TOKENIZER_B)))
        base = TaskContext.get().partitionId() << 32
        row = chunk = held = 0
        rows: list[tuple] = []
        doc_type = None

        def flush() -> pa.RecordBatch:
            nonlocal rows, held, chunk
            links = np.concatenate([r[-1] for r in rows])
            pairs, numbers, counts = np.unique(links, return_inverse=True, return_counts=True)
            stops = np.cumsum([len(r[-1]) for r in rows])
            columns = [*zip(*(r[:-1] for r in rows))]
            n = len(rows)
            numbers = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops, [stops[-1]])).astype(np.int32)), pa.array(numbers.astype(np.int32)))
            types = (pa.int64(), doc_type, *[pa.int64()] * 4, pa.string())
            filled = [pa.array([*c, None], t) for c, t in zip(columns, types)]
            last = lambda values: pa.array([*[None] * n, values], pa.list_(pa.int64()))
            out = [filled[0], pa.array([base + chunk] * (n + 1), pa.int64()), *filled[1:], numbers, last(pairs), last(counts)]
            rows, held, chunk = [], 0, chunk + 1
            return pa.RecordBatch.from_arrays(out, names=["row_id", "chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "counts"])

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for doc, text in zip(*columns_of(batch, "doc_id", "text")):
                found = aligner.document(text)
                digest, links, sizes = "", np.zeros(0, np.int64), (0, 0, 0, 0)
                if found:
                    links, sizes = found.links, (found.n_a, found.n_b, len(found.links), len(found.links))
                    digest = hashlib.sha256(found.groups.encode()).hexdigest()
                for lo in range(0, max(1, len(links)), most):
                    part = links[lo : lo + most]
                    rows.append((base + row, doc, *sizes, digest, part))
                    held += len(part)
                    if held >= most:
                        yield flush()
                row += 1
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(encode, ROW.format(id_type=id_type))


def pair_counts(held: DataFrame) -> DataFrame:
    """pair, n and best (no pair with the same B id has more links), from the chunks' own counts."""
    totals = held.groupBy("pair").agg(F.sum("n").alias("n"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1))
    highest = totals.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("highest"))
    return totals.withColumn("b_id", b_id).join(highest, "b_id").select("pair", F.col("n").alias("total"), (F.col("n") == F.col("highest")).alias("best"))


SCORED = "row_id long, n_best long, count_sum long"


def token_alignment(docs: DataFrame, place_a: str | None = None, place_b: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per input row."""
    rows = materialize(encoded(docs, place_a, place_b, chunk), "alignment_rows")
    held = materialize(rows.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts"))).select("chunk", F.col("pos").alias("number"), F.col("col.pairs").alias("pair"), F.col("col.counts").alias("n")), "alignment_pairs")
    valued = held.join(pair_counts(held), "pair").select("chunk", "number", "total", "best")

    def score(key, links: pa.Table, values: pa.Table) -> pa.Table:
        total, best = np.zeros(values.num_rows, np.int64), np.zeros(values.num_rows, np.int64)
        number = values["number"].to_numpy()
        total[number], best[number] = values["total"].to_numpy(), values["best"].to_numpy()
        column = links["links"].combine_chunks()
        stops = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())))
        own = column.flatten().to_numpy()
        sums = [np.concatenate(([0], np.cumsum(v[own]))) for v in (best, total)]
        return pa.table({"row_id": links["row_id"], **{name: s[stops[1:]] - s[stops[:-1]] for name, s in zip(("n_best", "count_sum"), sums)}})

    linked = rows.where("row_id is not null and size(links) > 0").select("row_id", "chunk", "links")
    scored = linked.groupBy("chunk").cogroup(valued.groupBy("chunk")).applyInArrow(score, SCORED)
    scored = scored.groupBy("row_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    facts = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    whole = rows.where("row_id is not null").select("row_id", *facts).dropDuplicates(["row_id"])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return whole.join(scored, "row_id", "left").select(*facts[:-1], zero("n_best"), zero("count_sum"), facts[-1])


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents aligned between the byte-level and the sentencepiece vocabulary."""
    return token_alignment(documents(spark, sf_dir))
