"""Splits, distractors and candidate order.

Randomness is hash order: ``md5(seed|id)`` ranks rows, so results repeat after
a retry and on any cluster size. Exact counts come from a 65,536-bucket
histogram of the hash instead of a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from boxtrail.functions import text as T
from boxtrail.operators.logs import before_bucket
from boxtrail.runtime import materialize

# ---- Fixed values -----------------------------------------------------------
HEAD_SHARE = 0.8
NO_PAGE = 10**9
# -----------------------------------------------------------------------------

BUCKET_DIGITS = 4  # hex digits: at most 65,536 buckets, whatever the input size
KEY_RANGES = 1 << 16
PAGE_BUCKET = 1024


def hash_key(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_number(key: Column) -> Column:
    """48 bits of a hex digest as a long."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("long")


def hash_unit(key: Column) -> Column:
    """Uniform double in [0, 1) from a hex digest."""
    return hash_number(key) / F.lit(float(2**48))


def hash_order(items: Column, key) -> Column:
    """Array reordered by ``key(item)``."""
    ranked = F.array_sort(F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("x"))))
    return F.transform(ranked, lambda r: r["x"])


def _bucket_offsets(keyed: DataFrame, bucket: str) -> DataFrame:
    """(bucket, before, n): rows in earlier buckets; bounded by the bucket count."""
    counts = keyed.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before", before)


# ---- splits -----------------------------------------------------------------

def hash_split(df: DataFrame, fraction: float, seed: int, key: str = "sample_id") -> DataFrame:
    """Adds ``split``: exactly ``round(n * fraction)`` rows are ``val``.

    Rounding is half to even. All buckets but one are decided by comparing the
    hash prefix with the cut bucket; only that bucket's rows (about n / 65,536)
    are ranked. ``key`` identifies a whole multi-hop sample, so no hop leaks.
    """
    keyed = df.withColumn("_h", hash_key(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    hist = _bucket_offsets(keyed.select("_b"), "_b").withColumn(
        "want", F.bround(F.sum("n").over(W.partitionBy()) * F.lit(fraction)).cast("long")
    )
    cut = hist.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("n") >= F.col("want")))
    cut_bucket = F.coalesce(cut.select("_b").scalar(), F.lit(""))
    still = F.coalesce(cut.select(F.col("want") - F.col("before")).scalar(), F.lit(0))
    name = lambda flag: F.when(flag, "val").otherwise("train")
    clear = keyed.where(F.col("_b") != cut_bucket).withColumn("split", name(F.col("_b") < cut_bucket))
    ranked = keyed.where(F.col("_b") == cut_bucket).withColumn(
        "_r", F.row_number().over(W.partitionBy("_b").orderBy("_h", key))
    )
    edge = ranked.withColumn("split", name(F.col("_r") <= still)).drop("_r")
    return clear.unionByName(edge).drop("_h", "_b")


def nth_key(df: DataFrame, key: str, n: int) -> int | None:
    """The ``n``-th smallest whole-number key, counted from 1, without a sort.

    A histogram over ``KEY_RANGES`` equal ranges of the keys finds the range that holds it; the range is split again
    until it is one key. Each pass divides the range by 65,536, so 64-bit keys need at most four.
    """
    bounds = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None or n < 1:
        return None
    while lo < hi:
        step = (hi - lo) // KEY_RANGES + 1
        place = F.expr(f"(`{key}` - pmod(`{key}`, {step}L)) div {step}L")  # floor, in whole numbers
        hist = _bucket_offsets(df.where(F.col(key).between(lo, hi)).select(place.alias("_b")), "_b")
        cut = hist.where((F.col("before") < n) & (F.col("before") + F.col("n") >= n)).first()
        if cut is None:
            return hi
        n -= cut["before"]
        lo, hi = max(lo, cut["_b"] * step), min(hi, cut["_b"] * step + step - 1)
    return lo


def head_split(df: DataFrame, key: str = "sample_id", cap: int | None = None) -> DataFrame:
    """Adds ``split``: the first int(0.8 n) rows in key order are ``train``, at most ``cap`` if given.

    The published split caps them at 40,000. Rows that share the last key go together.
    """
    size = int(df.count() * HEAD_SHARE)
    last = nth_key(df, key, size if cap is None else min(cap, size))
    return df.withColumn("split", F.when(F.col(key) <= F.lit(last), "train").otherwise("test"))


def shard_of(idx: Column, n_shards: int) -> Column:
    return F.pmod(idx, F.lit(n_shards))


# ---- candidate pools --------------------------------------------------------

def screenshot_pool(samples: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Distinct screenshots cited by any sample, plus an image listing if given."""
    cited = samples.select(F.explode(F.transform("evidence_chain", lambda e: e["screenshot"])).alias("screenshot"))
    every = cited if images is None else cited.unionByName(images.select(F.col("path").alias("screenshot")))
    return every.where(F.length("screenshot") > 0).distinct()


def gold_screenshots(chain: Column) -> Column:
    """Distinct screenshots of a chain in hop order."""
    return F.array_distinct(F.transform(chain, lambda e: e["screenshot"]))


def _need(k: int) -> Column:
    return F.greatest(F.lit(0), F.lit(k) - F.size("gold"))


def _top(order: Column) -> Column:
    """First ``need`` screenshots of a collected, bounded candidate list."""
    ranked = F.sort_array(F.collect_list(order))
    return F.transform(F.slice(ranked, F.lit(1), F.first("need")), lambda r: r["screenshot"]).alias("distractors")


def global_distractors(samples: DataFrame, pool: DataFrame, k: int, seed: int) -> DataFrame:
    """``k - |gold|`` distinct non-gold screenshots of the whole pool per sample.

    The pool gets dense ordinals in hash order. A sample starts at a hashed
    ordinal and reads ``need + |gold|`` neighbours, wrapping around: always
    enough, never a repeat, and never a product of samples and pool.
    ``samples`` is (sample_id, gold).
    """
    keyed = pool.select("screenshot", hash_key(seed, F.col("screenshot")).alias("_h")).withColumn(
        "_b", F.substring("_h", 1, BUCKET_DIGITS)
    )
    offsets = _bucket_offsets(keyed.select("_b"), "_b")
    total = offsets.agg(F.sum("n")).scalar()
    in_bucket = F.row_number().over(W.partitionBy("_b").orderBy("_h", "screenshot"))
    # At most 65,536 offset rows: the broadcast is bounded by construction.
    placed = keyed.withColumn("_r", in_bucket).join(F.broadcast(offsets), "_b").select(
        (F.col("before") + F.col("_r") - 1).alias("ordinal"), "screenshot"
    )
    asked = samples.withColumn("need", _need(k)).where("need > 0").withColumn("total", total).where("total > 0")
    reads = F.least(F.col("total"), F.col("need") + F.size("gold")).cast("int")
    start = hash_number(hash_key(seed, F.col("sample_id"))) % F.col("total")
    draws = asked.select(
        "sample_id", "gold", "need", "total", start.alias("start"), F.explode(F.sequence(F.lit(0), reads - 1)).alias("draw")
    ).withColumn("ordinal", (F.col("start") + F.col("draw")) % F.col("total"))
    hits = draws.join(placed, "ordinal").where(~F.array_contains("gold", F.col("screenshot")))
    return hits.groupBy("sample_id").agg(_top(F.struct("draw", "screenshot")))


def _page_ranks(pages: DataFrame) -> DataFrame:
    """Number of real pages up to each (deck, page), without one task per deck.

    Pages are counted in buckets of 1,024 page numbers; a page's rank is its
    bucket's offset plus its place inside the bucket, so both windows stay small.
    """
    bucketed = pages.withColumn("pb", F.floor(F.col("page") / PAGE_BUCKET))
    per_bucket = bucketed.groupBy("deck", "pb").agg(F.sum("is_real").alias("n"))
    total = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    offsets = before_bucket(per_bucket, ["deck"], "pb", lambda w: F.sum("n").over(w), F.sum("n").alias("n"), total).withColumnRenamed("carried", "before")
    running = W.partitionBy("deck", "pb").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    return (
        bucketed.withColumn("inside", F.sum("is_real").over(running))
        .join(offsets, ["deck", "pb"])
        .select("deck", "page", "is_real", (F.col("before") + F.col("inside")).alias("page_rank"))
    )


def same_deck_distractors(samples: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Nearest pages of the first gold screenshot's deck, never the whole deck.

    Order: distance to the closest gold page, page number, name. A chosen image has fewer than ``k`` images before it in
    the order of its closest gold page, gold ones included. So the ``k`` first images of each cited page are found once
    for all samples, among its ``k`` nearest pages on either side and the ``k`` smallest names of a page, and a sample
    only merges the short lists of its own pages. Without a gold page number the first names of the deck are taken.
    Images and questions are written once to the shared folder, as several branches read them.
    """
    page = T.page_number(F.col("screenshot"))
    located = F.when(F.coalesce(page, F.lit(0)) == 0, F.lit(NO_PAGE)).otherwise(page)
    images = pool.select("screenshot", T.deck_key(F.col("screenshot")).alias("deck"), located.alias("page")).where("deck != ''")
    images = materialize(images, "deck_images")
    per_page = W.partitionBy("deck", "page").orderBy("screenshot")
    copies = F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies")  # rows of the pool that repeat a name
    kept = images.withColumn("_r", F.dense_rank().over(per_page)).where(F.col("_r") <= k).groupBy("deck", "page", "screenshot").agg(copies)

    pages_of = F.filter(F.transform("gold", T.page_number), lambda p: p.isNotNull())
    asked = samples.where(F.size("gold") > 0).select(
        "sample_id", "gold", _need(k).alias("need"), T.deck_key(F.get("gold", 0)).alias("deck"), pages_of.alias("gold_pages")
    ).where("need > 0 AND deck != ''")
    asked = materialize(asked, "deck_samples")

    # Gold pages may lie outside the deck; they take part in the ranking as empty pages.
    marks = asked.select("deck", F.explode("gold_pages").alias("page")).distinct()
    pages = kept.select("deck", "page", F.lit(1).alias("is_real")).unionByName(
        marks.select("deck", "page", F.lit(0).alias("is_real"))
    ).groupBy("deck", "page").agg(F.max("is_real").alias("is_real"))
    ranks = _page_ranks(pages)
    shelf = kept.join(ranks.where("is_real = 1"), ["deck", "page"]).select("deck", "page_rank", "page", "screenshot", "copies")

    away = F.abs(F.col("page") - F.col("mark"))
    nearest = W.partitionBy("deck", "mark").orderBy(away, "page", "screenshot")
    lists = (
        marks.join(ranks, ["deck", "page"])
        .select("deck", F.col("page").alias("mark"), F.explode(F.sequence(F.col("page_rank") - (k - 1), F.col("page_rank") + k)).alias("page_rank"))
        .join(shelf, ["deck", "page_rank"])
        .withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k)
        .groupBy("deck", "mark").agg(F.collect_list(F.struct(away.alias("distance"), "page", "screenshot", "copies")).alias("near"))
    )

    # Fewer than ``k`` gold screenshots, so a sample has fewer than ``k`` lists of at most ``k`` images.
    paged = asked.where("sample_id IS NOT NULL").select("sample_id", "gold", "need", "deck", F.explode(F.array_distinct("gold_pages")).alias("mark"))
    met = paged.join(lists, ["deck", "mark"]).withColumn("near", F.filter("near", lambda n: ~F.array_contains("gold", n["screenshot"])))
    ordered = F.array_sort(F.flatten(F.collect_list("near")))
    images_once = F.array_distinct(F.transform(ordered, lambda n: F.struct(n["screenshot"], n["copies"])))  # an image's first place is its closest
    names = F.flatten(F.transform(images_once, lambda n: F.array_repeat(n["screenshot"], n["copies"])))
    by_page = met.groupBy("sample_id").agg(F.slice(names, F.lit(1), F.first("need")).alias("distractors")).where(F.size("distractors") > 0)

    by_deck = W.partitionBy("deck").orderBy("screenshot")
    first_names = images.withColumn("_r", F.row_number().over(by_deck)).where(F.col("_r") <= k).select("deck", "screenshot")
    by_name = (
        asked.where(F.size("gold_pages") == 0)
        .join(first_names, "deck")
        .where(~F.array_contains("gold", F.col("screenshot")))
        .groupBy("sample_id").agg(_top(F.struct("screenshot")))
    )
    return by_page.unionByName(by_name)


def explicit_pool(listed: Column, gold: Column) -> Column:
    """Distinct non-gold, non-empty items of a sample's own candidate list."""
    return F.array_distinct(
        F.filter(listed, lambda s: (F.coalesce(s, F.lit("")) != "") & ~F.array_contains(gold, s))
    )


def explicit_distractors(samples: DataFrame, k: int, seed: int) -> DataFrame:
    """Hash-chosen items of the sample's own list; a short list is taken in order. No shuffle."""
    pool = explicit_pool(F.col("listed"), F.col("gold"))
    drawn = hash_order(F.col("pool"), lambda s: hash_key(seed, F.col("sample_id"), s))
    return (
        samples.withColumn("pool", pool).withColumn("need", _need(k)).where("need > 0 AND size(pool) > 0")
        .select(
            "sample_id",
            F.slice(F.when(F.size("pool") <= F.col("need"), F.col("pool")).otherwise(drawn), F.lit(1), F.col("need")).alias("distractors"),
        )
    )


def candidate_order(samples: DataFrame, seed: int) -> DataFrame:
    """Candidates in hash order; a candidate's position is its image number."""
    return samples.withColumn(
        "candidates", hash_order(F.col("candidates"), lambda s: hash_key(seed, F.col("sample_id"), s))
    )


def build_candidates(
    samples: DataFrame,
    k: int,
    *,
    strategy: str = "global",
    images: DataFrame | None = None,
    shuffle: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Samples with ``candidates``: all gold screenshots plus distractors up to ``k``.

    A sample's own list (``candidate_screenshots``, else
    ``distractor_screenshots``) overrides the strategy ``global`` or ``same_deck``. Gold screenshots and lists are
    written once to the shared folder, as several branches read them.
    """
    listed = F.array().cast("array<string>")
    for name in ("distractor_screenshots", "candidate_screenshots"):
        if name in samples.columns:
            listed = F.when(F.coalesce(F.size(name), F.lit(0)) > 0, F.col(name)).otherwise(listed)
    gold = samples.select("sample_id", gold_screenshots(F.col("evidence_chain")).alias("gold"), listed.alias("listed"))
    gold = materialize(gold, "candidate_gold")  # read by every branch below; what builds the samples runs once for all
    own = F.size(explicit_pool(F.col("listed"), F.col("gold"))) > 0
    rest = gold.where(~own).select("sample_id", "gold")
    same_deck = strategy == "same_deck"
    cited = gold.select(F.transform("gold", lambda s: F.struct(s.alias("screenshot"))).alias("evidence_chain"))
    pool = screenshot_pool(cited, images if same_deck else None)
    drawn = same_deck_distractors(rest, pool, k) if same_deck else global_distractors(rest, pool, k, seed)
    distractors = drawn.unionByName(explicit_distractors(gold.where(own), k, seed))
    none = F.array().cast("array<string>")
    joined = gold.select("sample_id", "gold").join(distractors, "sample_id", "left").select(
        "sample_id", F.concat("gold", F.coalesce("distractors", none)).alias("candidates")
    )
    ordered = candidate_order(joined, seed) if shuffle else joined
    return samples.join(ordered, "sample_id")
