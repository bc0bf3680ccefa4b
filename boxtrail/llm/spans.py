"""Pattern matches with their positions, in DataFrame expressions.

``split`` by a pattern and ``regexp_extract_all`` walk the same leftmost non-overlapping matches, so the texts between
matches and the matches themselves give every position. Lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HIT = "array<struct<kind:string,ord:int,gap:int,hit:string>>"


def matches(text: Column, kind: str, pattern: str, where: Column) -> Column:
    """Array of (kind, ord, gap, hit): matches of ``pattern``, and how many characters lie before each since the last.

    ``where`` is a cheap test that every text with a match passes; others are not searched.
    """
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))
    rows = F.transform(
        F.filter(found, lambda m: m["0"].isNotNull()),
        lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), F.length(m["1"]).alias("gap"), m["0"].alias("hit")),
    )
    return F.when(where, rows).otherwise(F.array().cast(HIT))


def located(rows: DataFrame, keys: list[str], hits: str = "hits") -> DataFrame:
    """keys, kind, ord, hit, start, end (exclusive): one row per match.

    ``keys`` must tell the rows apart. A window holds the matches of one kind in one text.
    """
    one = rows.select(*keys, F.inline(hits))
    size = F.length("hit")
    end = F.sum(F.col("gap") + size).over(W.partitionBy(*keys, "kind").orderBy("ord"))
    return one.select(*keys, "kind", "ord", "hit", end.cast("int").alias("end")).withColumn("start", F.col("end") - size)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an ordered array of spans, comma-joined; empty for none."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
