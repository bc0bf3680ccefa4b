"""Containment join: which texts of a page contain which needles, by an inverted index of sampled character grams.

Pages of up to ``DIRECT_LIMIT`` texts are joined on the page key and searched: each text is shuffled once and no index is
made for them. Longer pages take the index, so no long page has its needles paired with all of its texts. There a text is indexed by its minimizers: the least hash among every ``WINDOW`` neighbouring grams of ``GRAM`` characters.
A needle of at least ``LONG`` characters holds a whole window, so every text that contains it holds that window's
minimizer too. Of a needle's grams the one with the fewest texts on its page is looked up, and only those texts are
searched. Shorter needles look up their rarest pair of characters (or their only character) in an index that is made for
pages with such needles alone. Nothing is missed either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.runtime import materialize

GRAM, WINDOW = 4, 5
LONG = GRAM + WINDOW - 1

# Pages with more texts than this use the inverted index.
DIRECT_LIMIT = 1_000


def _grams(text: Column, n: int) -> Column:
    """All windows of ``n`` characters in order; one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def minimizers(text: Column) -> Column:
    """Distinct least gram hashes of all windows; none for texts shorter than ``LONG``."""
    hashed = F.transform(_grams(text, GRAM), lambda g: F.xxhash64(g))
    starts = lambda h: F.when(F.size(h) >= WINDOW, F.sequence(F.lit(1), F.size(h) - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    # Bound once by the one-element array, else every window would hash the text again.
    per_text = F.transform(F.array(hashed), lambda h: F.transform(starts(h), lambda i: F.array_min(F.slice(h, i, F.lit(WINDOW)))))
    return F.array_distinct(F.get(per_text, 0))


def short_grams(text: Column) -> Column:
    """Hashes of the empty string and of the distinct single characters and pairs."""
    every = F.concat(F.array(F.lit("")), F.split(text, ""), _grams(text, 2))
    return F.transform(F.array_distinct(every), lambda g: F.xxhash64(F.lit("short"), g))


def _needle_grams(needle: Column) -> Column:
    pairs = F.transform(F.array_distinct(_grams(needle, 2)), lambda g: F.xxhash64(F.lit("short"), g))
    own = F.array(F.xxhash64(F.lit("short"), needle))
    return F.when(F.length(needle) >= LONG, minimizers(needle)).when(F.length(needle) >= 2, pairs).otherwise(own)


def long_keys(rows: DataFrame, key: str, limit: int) -> DataFrame | None:
    """(key, n) of the keys with more than ``limit`` rows, or None if there is none.

    Counted while the plan is built, so that nothing is planned for long keys where there are none.
    """
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > limit) & F.col(key).isNotNull())
    long = materialize(counted, "long_keys")
    return None if long.isEmpty() else long


def containing(
    needles: DataFrame, texts: DataFrame, key: str = "page_id", *, needle_carry: tuple[str, ...] = (),
    text_carry: tuple[str, ...] = (), direct_limit: int = DIRECT_LIMIT,
) -> DataFrame:
    """(key, needle, text_id) for every text of the key that contains the needle, each pair once.

    ``needles`` is (key, needle), ``texts`` is (key, text_id, text) with unique text ids. An empty needle is in every
    text; null needles, texts and keys match nothing. With columns to carry there is a row for each needle row and text,
    with those columns of both sides.
    """
    wanted = needles.select(key, "needle", *needle_carry).where(F.col("needle").isNotNull())
    wanted = wanted if needle_carry else wanted.distinct()
    known = texts.select(key, "text_id", "text", *text_carry).where(F.col("text").isNotNull())
    out = [key, "needle", "text_id", *needle_carry, *text_carry]
    direct = lambda w: w.join(known.hint("merge"), key).where(F.contains("text", "needle")).select(out)
    long = long_keys(known.select(key), key, direct_limit)
    if long is None:
        return direct(wanted)
    found = _indexed(wanted.select(key, "needle").distinct(), known.select(key, "text_id", "text"), long.select(key), key)
    if needle_carry:
        found = found.join(wanted, [key, "needle"])
    if text_carry:
        found = found.join(known.select(key, "text_id", *text_carry), [key, "text_id"])
    return direct(wanted.join(long, key, "left_anti")).unionByName(found.select(out))


def _indexed(needles: DataFrame, texts: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, needle, text_id) of the given keys, through the index of grams."""
    wanted, known = needles.join(keys, key, "left_semi"), texts.join(keys, key, "left_semi")
    is_long = F.length("needle") >= LONG

    def indexed(condition: Column, grams: Column) -> DataFrame:
        pages = wanted.where(condition).select(key).distinct()
        return known.join(pages, key, "left_semi").select(key, "text_id", F.explode(grams).alias("gram"))

    postings = indexed(is_long, minimizers(F.col("text"))).unionByName(indexed(~is_long, short_grams(F.col("text"))))
    held = postings.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n_texts"))
    asked = wanted.select(key, "needle", F.explode(_needle_grams(F.col("needle"))).alias("gram"))
    rarest = (
        asked.join(held, [key, "gram"], "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(0)))
        .groupBy(key, "needle").agg(F.min(F.struct("n_texts", "gram")).alias("r"))
        # A needle with a gram that no text holds is in none.
        .where("r.n_texts > 0").select(key, "needle", F.col("r.gram").alias("gram"))
    )
    pairs = rarest.join(postings, [key, "gram"]).select(key, "needle", "text_id")
    return pairs.join(known, [key, "text_id"]).where(F.contains("text", "needle")).select(key, "needle", "text_id")
