"""The paragraph of a page that holds a value and is closest to a sentence, found in tasks over rows sorted by page.

Texts are shuffled whole, once, by page; words are counted inside the task. Neither words nor pairs of a value and a paragraph
are ever written or sorted. A page's paragraphs come first in a task, best box first, then its values one by one, so equal
scores fall to the paragraph that came first. Pages listed as long are cut into blocks of about ``BLOCK`` paragraphs, so none
has to fit one task; each of their values goes to every block. Blocks and pages of more than ``SCAN_LIMIT`` paragraphs look a
value up by its rarest gram.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter
from string import ascii_lowercase, digits

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from boxtrail.operators.page_scores import BLOCK, BOX, OUT_ROWS

# Pages with more paragraphs than this are not searched one by one.
SCAN_LIMIT = 256
GRAM = 3

# For rounding, in words.
MARGIN = 1e-6

PLACE = ("para_ord", *BOX)

# Of lower-cased UTF-8 only ASCII letters and digits are word characters; all other bytes part words.
PARTED = bytes(c if chr(c) in ascii_lowercase + digits else 32 for c in range(256))

# What tells the further occurrences of a word apart.
TAGS = [b"#%d" % k for k in range(1, 64)]


def words(text: str) -> tuple[int, set]:
    """Number of words of a lower-cased text, and the words as set elements: the n-th occurrence of a word is its own."""
    found = text.encode().translate(PARTED).split()
    elements = set(found)
    if len(elements) < len(found):
        for w, n in Counter(found).items():
            if n > 1:
                tags = TAGS[: n - 1] if n <= len(TAGS) else (b"#%d" % k for k in range(1, n))
                elements.update([w + tag for tag in tags])
    return len(found), elements


class Page:
    """Lower-cased paragraphs of a page or block, from the one with the fewest words to the one with the most.

    They are given by rank, best box first.
    """

    def __init__(self, texts: list[str]):
        counted = [(*words(t), t, rank) for rank, t in enumerate(texts)]
        self.paragraphs = sorted(((n, t, elements, rank) for n, elements, t, rank in counted), key=itemgetter(0, 3))
        self.lengths = [p[0] for p in self.paragraphs]
        self._grams: dict[int, dict[str, list[int]]] = {}

    def _with_grams(self, n: int) -> dict[str, list[int]]:
        """Places by windows of ``n`` characters, made when first asked for."""
        if n not in self._grams:
            made = self._grams[n] = {}
            for i, (_, t, _, _) in enumerate(self.paragraphs):
                for g in {t[k : k + n] for k in range(len(t) - n + 1)}:
                    made.setdefault(g, []).append(i)
        return self._grams[n]

    def sides(self, value: str, n: int) -> tuple[list[tuple], list[tuple]]:
        """Paragraphs with at least and with less than ``n`` words, the nearest in length first; all that hold the value are there."""
        at, short = bisect_left(self.lengths, n), min(len(value), GRAM)
        if not short or len(self.lengths) <= SCAN_LIMIT:
            return self.paragraphs[at:], self.paragraphs[:at][::-1]
        made = self._with_grams(short)
        places = min((made.get(value[k : k + short], []) for k in range(len(value) - short + 1)), key=len)
        at = bisect_left(places, at)
        return [self.paragraphs[i] for i in places[at:]], [self.paragraphs[i] for i in places[:at][::-1]]

    def best(self, value: str, text: str) -> tuple[float, int] | None:
        """F1 and rank of the closest paragraph that holds the value, of equal ones the first by rank."""
        n, elements = words(text)
        most, at, least, limit = -1.0, -1, -1.0, math.inf
        for side in self.sides(value, n):
            for m, t, held, rank in side:
                # No more words are shared than the shorter text has: beyond these lengths paragraphs are less close.
                if not least <= m <= limit:
                    break
                if value in t:
                    common = len(elements & held)
                    f1 = 0.0
                    if common:
                        precision, recall = common / m, common / n
                        f1 = 2 * precision * recall / (precision + recall)
                    if f1 > most or f1 == most and rank < at:
                        most, at = f1, rank
                        if common:
                            least, limit = n * f1 / (2 - f1) - MARGIN, 2 * n / f1 - n + MARGIN
        return (most, at) if at >= 0 else None


def _rows(targets: DataFrame, paragraphs: DataFrame, long: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """Both tables in one, and what they are dealt out by: page, and block if there are long pages. Paragraphs come first."""
    known = F.col("page_id").isNotNull()
    texts = paragraphs.where(known & F.col("text").isNotNull()).select("page_id", F.struct(*PLACE).alias("place"), F.lower("text").alias("text"))
    asked = targets.where(known & F.col("value").isNotNull()).select("page_id", "target_id", F.lower("value").alias("value"), F.lower("text").alias("text"))
    keys = ["page_id"]
    if long is not None:
        keys.append("block")
        blocks = long.select("page_id", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        n = F.coalesce("blocks", F.lit(1))
        own = F.pmod(F.xxhash64("place", "text"), n).cast("int")
        texts = texts.join(blocks, "page_id", "left").withColumn("block", own).drop("blocks")
        asked = asked.join(blocks, "page_id", "left").withColumn("block", F.explode(F.sequence(F.lit(0), n - 1))).drop("blocks")
    both = texts.unionByName(asked, allowMissingColumns=True)
    in_order = [F.col("place").isNull(), F.col("target_id"), *(F.desc(c) for c in box_order(lambda c: F.col(f"place.{c}")))]
    return both.repartition(*keys).sortWithinPartitions(*keys, *in_order), keys


def box_order(of=F.col) -> list[Column]:
    """What ranks equally close paragraphs: the widest, then the topmost, then the first."""
    return [of("x2") - of("x1"), -of("y1"), -of("para_ord")]


def _values(column: pa.Array) -> list:
    """The values of a column; whole numbers and texts without the detour over scalars."""
    plain = pa.types.is_integer(column.type) and not column.null_count or pa.types.is_string(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _finder(keys: list[str], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes the sorted rows and gives the best place of each key and target; ``names`` are the columns of the result."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, target, best, page, out, types = None, None, None, None, [], None
        texts: list[str] = []
        places: list[tuple] = []

        def settle() -> None:
            """Lists the best place of the target that ends here."""
            if best is not None:
                out.append((key[0], target, *places[best[1]], best[0]))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return made

        for b in batches:
            of = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023
            place = of("place")
            types = types or [of("page_id").type, of("target_id").type, *(f.type for f in place.type), pa.float64()]
            is_text = place.is_valid()
            boxes = zip(*map(_values, place.filter(is_text).flatten()))
            dealt = zip(*(_values(of(c)) for c in keys))
            for at, held, asks, value, text in zip(dealt, is_text.to_pylist(), *(_values(of(c)) for c in ("target_id", "value", "text"))):
                if at != key:
                    settle()
                    key, best, page, texts, places = at, None, None, [], []
                if held:
                    texts.append(text)
                    places.append(next(boxes))
                    continue
                if best is None or asks != target:
                    settle()
                    target, best = asks, None
                    if len(out) >= OUT_ROWS:
                        yield flush()
                if texts:
                    page = page or Page(texts)
                    found = page.best(value, text or "")
                    if found is not None and (best is None or (found[0], -found[1]) > (best[0], -best[1])):
                        best = found
        settle()
        if out:
            yield flush()

    return find


def closest_holding(targets: DataFrame, paragraphs: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """(page_id, target_id, para_ord, box, f1) of the paragraph of the page that holds the value and is closest to the text.

    ``targets`` is (page_id, target_id, value, text), ``paragraphs`` (page_id, para_ord, text, x1, y1, x2, y2), ``long`` the
    (page_id, n) of the pages that are cut into blocks. Target ids that repeat give their best row. A null text has no word;
    null pages, values and paragraph texts match nothing.
    """
    rows, keys = _rows(targets, paragraphs, long)
    kind = rows.schema["place"].dataType
    schema = StructType([rows.schema["page_id"], rows.schema["target_id"], *kind.fields, StructField("f1", DoubleType())])
    found = rows.mapInArrow(_finder(keys, schema.fieldNames()), schema)
    if long is None:
        return found
    return found.groupBy("page_id", "target_id").agg(
        F.max_by(F.struct(*PLACE, "f1"), F.struct("f1", *box_order())).alias("b")
    ).select("page_id", "target_id", "b.*")
