"""Fill-in-middle transformation over indexable skip lists.

A text is a sequence of units (runs of ASCII letters, every other code point alone). A skip list over its units carries
on each express lane how many units and how many code points a link spans; a descent that adds these widths up finds
the code point at which any unit rank begins, exactly, in a logarithmic number of steps. Two ranks drawn from the hash
of the document's id cut the text into prefix, middle and suffix, which are written in one of three forms. ``restored``
rebuilds the text from output and form.

Null text: an empty one, which stays plain. A null doc_id draws from the hash of the seed alone. Rows with equal
doc_id and text get equal results, once per row; a doc_id with several texts draws the same numbers for each. A text
that spells out a sentinel stays plain. Texts are cut whole, however long; units are counted in slices of ``SLICE`` code
points. An empty table gives an empty result. Other columns of the input are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import documents, mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
TRANSFORMED_PERCENT = 90
SPM_PERCENT = 20
SLICE = 1 << 20
FAN_OUT_BITS = 2
DRAWS = ("h1", "h2", "h3", "h4")


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit, in order."""
    starts, before = [], False
    for lo in range(0, len(text), SLICE):
        points = np.frombuffer(text[lo : lo + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        lower = points | 32
        letter = (lower >= 97) & (lower <= 122) & (points < 128)
        inside = letter & np.concatenate(([before], letter[:-1]))
        starts.append(np.flatnonzero(~inside) + lo)
        before = bool(letter[-1])
    return np.diff(np.concatenate((*starts, [len(text)]))) if starts else np.zeros(0, np.int64)


_heights = np.zeros(0, np.int8)


def heights(n: int) -> np.ndarray:
    """Highest lane of each node, by a hash of its rank: one node in ``2**FAN_OUT_BITS`` reaches the next lane."""
    global _heights
    if len(_heights) < n:
        h = mix(np.arange(1, max(n, 2 * len(_heights), 4096) + 1, dtype=np.uint64))
        tall = np.zeros(len(h), np.int8)
        for lane in range(1, 64 // FAN_OUT_BITS):
            reach = h & np.uint64((1 << FAN_OUT_BITS * lane) - 1) == 0
            if not reach.any():
                break
            tall[reach] = lane
        _heights = tall
    return _heights[:n]


class SkipList:
    """Units of one text; lane 0 links every unit to the next, higher lanes skip. The first unit is on every lane.

    A lane holds, per link, its width in units and in code points, and the place of its node one lane below.
    """

    def __init__(self, widths: np.ndarray):
        self.n, self.points = len(widths), int(widths.sum())
        self.lanes = [(np.ones(self.n, np.int64), widths, None)]
        tall, lane = heights(self.n), 0
        while len(self.lanes[-1][0]) > 1 << FAN_OUT_BITS:
            lane += 1
            on = tall >= lane
            on[0] = True
            down = np.flatnonzero(on)
            units, points, _ = self.lanes[-1]
            if len(down) == len(units):  # nothing skips
                continue
            self.lanes.append((np.add.reduceat(units, down), np.add.reduceat(points, down), np.append(down, len(units))))
            tall = tall[on]

    def descend(self, rank: int) -> int:
        """Code points before the unit of that rank; all of them for rank n."""
        units = points = at = 0
        for step, wide, down in reversed(self.lanes):
            while at < len(step) and units + step[at] <= rank:
                units, points, at = units + int(step[at]), points + int(wide[at]), at + 1
            at = at if down is None else int(down[at])
        return points


def rearranged(text: str, first: int, last: int, spm: bool) -> str:
    """The three parts of ``text``, cut at code points ``first`` and ``last``, behind their sentinels."""
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if spm else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws(key: str | Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and key."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(DRAWS)]


def fill_in_middle(docs: DataFrame, *carry: str, key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """carry columns, n (units), form, prefix_chars, middle_chars and output, one row per input row, no shuffle."""
    extra = [(c, docs.schema[c].dataType.simpleString()) for c in carry]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in extra), "n long", "form string", "prefix_chars long", "middle_chars long", "output string"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lo = 0, 0
            rows: list[tuple] = []
            kept = [batch.column(k) for k in range(len(carry))]
            for i, (text, h1, h2, h3, h4) in enumerate(zip(*(batch.column(len(carry) + k).to_pylist() for k in range(5)))):
                text = text or ""
                widths = unit_widths(text)
                n = len(widths)
                if not text or h3 % 100 >= TRANSFORMED_PERCENT or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((n, "plain", None, None, text))
                else:
                    spm = h4 % 100 < SPM_PERCENT
                    ranks = sorted((h1 % (n + 1), h2 % (n + 1)))
                    lanes = SkipList(widths)
                    first, last = map(lanes.descend, ranks)
                    rows.append((n, "spm" if spm else "psm", first, last - first, rearranged(text, first, last, spm)))
                size += len(text)
                if size > SLICE or i + 1 == batch.num_rows:
                    columns = list(zip(*rows))
                    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, i + 1 - lo) for c in kept), *(pa.array(c, t) for c, t in zip(columns, types))], names=[*carry, "n", "form", "prefix_chars", "middle_chars", "output"])
                    size, lo, rows = 0, i + 1, []

    own = [F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry)]
    return docs.select(*own, F.col("text").alias("_text"), *draws(key, seed)).mapInArrow(cut, schema)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that ``output`` was made from. Parts hold no sentinel, so the first one of each kind is the cut."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    after = lambda whole, part: F.substring(whole, F.length(part) + F.lit(len(MIDDLE) + 1), F.length(whole))

    def parts(sentinel: str) -> tuple[Column, Column, Column]:
        inner = after(output, F.lit(""))
        head = F.substring_index(inner, sentinel, 1)
        rest = after(inner, head)
        second = F.substring_index(rest, MIDDLE, 1)
        return head, second, after(rest, second)

    prefix, suffix, middle = parts(SUFFIX)
    spm_suffix, spm_prefix, spm_middle = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix)).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form, and proof that each is rebuilt from it."""
    rows = fill_in_middle(documents(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP12_SQL = f"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
        sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS hex
    FROM documents
), numbers AS (
    SELECT *, len(units) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
        ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4
    FROM drawn
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS first, greatest(h1 % (n + 1), h2 % (n + 1)) AS last,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {TRANSFORMED_PERCENT}
            THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), parts AS (
    SELECT *, array_to_string(units[1:first], '') AS prefix, array_to_string(units[first + 1:last], '') AS middle,
        array_to_string(units[last + 1:], '') AS suffix
    FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
        WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
