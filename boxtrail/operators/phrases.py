"""Phrase look-up: which paragraphs of a page can hold a phrase or enough of a sentence's words, by an index of words and places.

Of a phrase's words the one with the fewest occurrences on the page is looked up; each of its places fixes where the phrase
would start, and only there the words are compared. A paragraph with ``t`` of a sentence's ``n`` words has one of any
``n - t + 1``, so only the rarest are looked up. No page has its targets paired with all of its paragraphs, and no text is
searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def candidates(targets: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """(page_id, target_id, para_ord, starts) of every paragraph that can qualify, each pair once.

    ``targets`` is (page_id, target_id, phrase, tokens): a phrase with single blanks between its words, as ``plain_words``
    makes it, and distinct tokens. ``texts`` is (page_id, para_ord, words). A paragraph qualifies by holding the phrase or
    ``share`` of the tokens. ``starts`` lists the places where the phrase may stand (see ``stands_at``), empty if none.
    Null or empty phrases, tokens and words look up nothing; null pages meet nothing.
    """
    places = texts.select("page_id", "para_ord", F.posexplode("words").alias("pos", "word"))
    held = places.groupBy("page_id", "word").agg(F.count(F.lit(1)).alias("n"))

    item = lambda word, offset, keep: F.struct(word.alias("word"), offset.alias("offset"), keep.alias("keep"))
    need = F.greatest(F.lit(1), F.ceil(F.size("tokens") * share - F.lit(1e-9)))
    whole = lambda c: c.cast("int")
    words = F.filter(F.split(F.coalesce("phrase", F.lit("")), " "), lambda w: w != "")
    of_phrase = F.transform(words, lambda w, i: item(w, whole(i), F.lit(1)))
    of_tokens = F.transform(
        F.coalesce("tokens", F.array().cast("array<string>")), lambda t: item(t, F.lit(None).cast("int"), whole(F.size("tokens") - need + 1))
    )
    asked = targets.select("page_id", "target_id", F.explode(F.concat(of_phrase, of_tokens)).alias("i")).select(
        "page_id", "target_id", "i.*"
    )
    # A word the page lacks counts as the rarest: a phrase with one is nowhere, and a token that is absent is one of the n.
    known = asked.join(held, ["page_id", "word"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = W.partitionBy("page_id", "target_id", F.col("offset").isNull()).orderBy("n", "word", "offset")
    rarest = known.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= F.col("keep")) & (F.col("n") > 0))
    found = rarest.select("page_id", "target_id", "word", "offset").join(places, ["page_id", "word"])
    return found.groupBy("page_id", "target_id", "para_ord").agg(
        F.collect_set(F.when(F.col("pos") >= F.col("offset"), F.col("pos") - F.col("offset"))).alias("starts")
    )


def stands_at(phrase: Column, words: Column, starts: Column) -> Column:
    """Whether the phrase's words stand in ``words`` from one of the places on; false for no place."""
    length = F.size(F.split(phrase, " "))
    return F.exists(starts, lambda s: F.array_join(F.slice(words, s + 1, length), " ") == phrase)
