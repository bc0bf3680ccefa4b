"""Token and gram counts of sentences against the paragraphs of their page, taken in tasks over rows sorted by page.

Texts are shuffled whole, by page; words and grams live only inside the task that compares them. A page's paragraphs come
first in a task, then its sentences one by one. Pages listed as long are cut into blocks of about ``BLOCK`` paragraphs, so
none has to fit one task; in a block an inverted index names the paragraphs that can reach the least similarity.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boxtrail.functions.text import WEIGHT_GRAM_RECALL, WEIGHT_TOKEN_F1

BLOCK = 1024
OUT_ROWS = 8192
GRAM = 4
WORD = re.compile("[a-z0-9]+")

BOX = ("x1", "y1", "x2", "y2")
SCORES = ("token_f1", "gram_recall", "similarity")


def tagged(words: list[str]) -> set[str]:
    """Words as set elements: the n-th occurrence of a word is its own element."""
    seen: dict[str, int] = {}
    out = set()
    for w in words:
        n = seen[w] = seen.get(w, 0) + 1
        out.add(w if n == 1 else f"{w}#{n}")
    return out


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


class Paragraph:
    """Features of one lower-cased paragraph; grams are made when a sentence first shares a word with it."""

    __slots__ = ("text", "row", "words", "n_words", "_grams")

    def __init__(self, text: str, row: tuple):
        found = WORD.findall(text)
        self.text, self.row, self.words, self.n_words, self._grams = text, row, tagged(found), len(found), None

    @property
    def grams(self) -> set[str]:
        if self._grams is None:
            self._grams = grams(self.text)
        return self._grams


class Sentence:
    __slots__ = ("words", "n_words", "grams")

    def __init__(self, text: str):
        found = WORD.findall(text)
        self.words, self.n_words, self.grams = tagged(found), len(found), grams(text)


def scores(s: Sentence, p: Paragraph) -> tuple[float, float, float]:
    """Token F1, gram recall and their blend; all zero without a common word."""
    common = len(s.words & p.words)
    if not common:
        return 0.0, 0.0, 0.0
    precision, recall = common / p.n_words, common / s.n_words
    f1 = 2 * precision * recall / (precision + recall)
    found = len(s.grams & p.grams) / len(s.grams) if s.grams else 0.0
    return f1, found, WEIGHT_TOKEN_F1 * f1 + WEIGHT_GRAM_RECALL * found


class BlockIndex:
    """Paragraphs of a block by word and by gram, with the exact overlap bound.

    A paragraph that holds at least ``t`` of a sentence's ``n`` features holds one of any ``n - t + 1`` of them, so only
    the rarest are looked up.
    """

    def __init__(self, paragraphs: list[Paragraph], shares: tuple[float, float]):
        self.paragraphs, self.shares = paragraphs, shares
        self.places: tuple[dict, dict] = ({}, {})
        for i, p in enumerate(paragraphs):
            for features, place in zip((p.words, p.grams), self.places):
                for f in features:
                    place.setdefault(f, []).append(i)

    def candidates(self, s: Sentence) -> list[Paragraph]:
        found: set[int] = set()
        for features, place, share in zip((s.words, s.grams), self.places, self.shares):
            need = max(1, -int(-(len(features) * share - 1e-9) // 1))
            rarest = sorted((len(place.get(f, ())), f) for f in features)[: len(features) - need + 1]
            for n, f in rarest:
                if n:
                    found.update(place[f])
        return [self.paragraphs[i] for i in sorted(found)]


def _rows(
    sentences: DataFrame, paragraphs: DataFrame, long: DataFrame | None
) -> DataFrame:
    """Both tables in one, by page and block, paragraphs first. A sentence of a long page goes to each of its blocks."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    texts = paragraphs.select(
        "page_id", F.lit(0).alias("kind"), "para_ord", *BOX, none(sentences, "target_id"), F.lower("text").alias("text")
    )
    asked = sentences.select(
        "page_id", F.lit(1).alias("kind"), none(paragraphs, "para_ord"), *(none(paragraphs, c) for c in BOX), "target_id", F.lower("text").alias("text")
    )
    texts, asked = texts.where(F.col("page_id").isNotNull()), asked.where(F.col("page_id").isNotNull())
    if long is None:
        both = texts.unionByName(asked).withColumns({"block": F.lit(0), "indexed": F.lit(False)})
    else:
        blocks = long.select("page_id", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        n = F.coalesce("blocks", F.lit(1))
        own = F.pmod(F.xxhash64("para_ord"), n).cast("int")
        texts, asked = texts.join(blocks, "page_id", "left"), asked.join(blocks, "page_id", "left")
        placed = texts.withColumn("block", own).unionByName(asked.withColumn("block", F.explode(F.sequence(F.lit(0), n - 1))))
        both = placed.withColumn("indexed", F.col("blocks").isNotNull()).drop("blocks")
    return both.repartition("page_id", "block").sortWithinPartitions("page_id", "block", "kind")


def _compared(
    rows: DataFrame, of_page: Callable[[list[Paragraph], bool], Callable[[Sentence], Iterator[tuple]]]
) -> DataFrame:
    """(page_id, target_id, para_ord, box, scores) as ``of_page`` picks them for each sentence."""
    names = ("page_id", "target_id", "para_ord", *BOX)
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names), *(f"{c} double" for c in SCORES)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, pick, out, types = None, [], None, [], None

        def flush() -> pa.RecordBatch:
            columns = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*names, *SCORES])

        for b in batches:
            types = types or [*(b.schema.field(c).type for c in names), *[pa.float64()] * len(SCORES)]
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "block", "kind", "indexed", "target_id", "text", "para_ord", *BOX)]
            for page, block, kind, indexed, target, text, *place in zip(*columns):
                if (page, block) != at:
                    at, held, pick = (page, block), [], None
                if kind == 0:
                    held.append(Paragraph(text or "", tuple(place)))
                elif held:
                    pick = pick or of_page(held, indexed)
                    out.extend((page, target, *row) for row in pick(Sentence(text)))
                    if len(out) >= OUT_ROWS:
                        yield flush()
                        out.clear()
        if out:
            yield flush()

    return rows.mapInArrow(compare, schema)


def best_of_page(
    sentences: DataFrame, paragraphs: DataFrame, shares: tuple[float, float], long: DataFrame | None = None
) -> DataFrame:
    """The most similar, then widest, then first paragraph of the page for each sentence, one row per block.

    ``sentences`` is (page_id, target_id, text), ``paragraphs`` (page_id, para_ord, text, x1, y1, x2, y2), ``long`` the
    (page_id, n) of the pages that take the index; there paragraphs with less than ``shares`` of a sentence's words and
    grams may be left out.
    """
    def of_page(held: list[Paragraph], indexed: bool):
        index = BlockIndex(held, shares) if indexed else None

        def pick(s: Sentence) -> Iterator[tuple]:
            best = None
            for p in index.candidates(s) if indexed else held:
                made = scores(s, p)
                if best is not None and made[2] < best[0][0]:
                    continue
                order, x1, _, x2, _ = p.row
                rank = (made[2], x2 - x1, order is not None, -(order or 0))
                if best is None or rank > best[0]:
                    best = rank, (*p.row, *made)
            if best is not None:
                yield best[1]

        return pick

    return _compared(_rows(sentences, paragraphs, long), of_page)


def all_of_page(sentences: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Every sentence with every paragraph of its page."""
    def of_page(held: list[Paragraph], indexed: bool):
        return lambda s: ((*p.row, *scores(s, p)) for p in held)

    return _compared(_rows(sentences, paragraphs, None), of_page)
