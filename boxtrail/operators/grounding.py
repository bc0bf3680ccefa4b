"""Grounding sentences and values in the paragraphs of their page.

Input tables
    paragraphs  (page_id, para_ord, text, x1, y1, x2, y2)
    sentences   (page_id, sid, sent)          sent null = text unknown
    hops        see ``match_hops``

Every target is compared with paragraphs of its own page only. Targets of pages
with up to ``DIRECT_LIMIT`` paragraphs meet all of them: both sides are shuffled
once, by page. Longer pages go through an inverted index with an exact overlap
bound, so no long page has all its pairs enumerated.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.functions import text as T
from boxtrail.operators.containment import long_keys
from boxtrail.operators.page_scores import all_of_page, best_of_page
from boxtrail.operators.page_values import closest_holding
from boxtrail.operators.phrases import candidates, stands_at
from boxtrail.runtime import materialize

# ---- Fixed values -----------------------------------------------------------
MIN_SIMILARITY = 0.25
MIN_GROUND_WIDTH, MIN_GROUND_HEIGHT = 50, 5
FALLBACK_WIDTH, FALLBACK_CHARS = 200, 50
MIN_PICK_WIDTH, MIN_PICK_HEIGHT, MIN_PICK_WORDS = 80, 5, 8
MIN_PICK_SCORE = 0.4
MIN_LEGACY_WIDTH = 100
# -----------------------------------------------------------------------------

# Pages with more candidate paragraphs than this use the inverted index.
DIRECT_LIMIT = 1_000

# A pair reaching MIN_SIMILARITY = 0.6 * F1 + 0.4 * recall has F1 >= 0.25 or
# gram recall >= 0.25, because below both the blend stays under 0.25.
# F1 >= f needs a shared token share of at least f / (2 - f) of the sentence.
TOKEN_SHARE = MIN_SIMILARITY / (2 - MIN_SIMILARITY)
GRAM_SHARE = MIN_SIMILARITY

# Keys that rows without a partner are dealt out to.
LONELY_KEYS = 4096


def width() -> Column:
    return F.col("x2") - F.col("x1")


def height() -> Column:
    return F.col("y2") - F.col("y1")


# ---- sentence grounding -----------------------------------------------------

SENTENCE_FEATURES = {
    "st": T.word_tokens, "ss": lambda c: T.spaced_tokens(T.word_tokens(c)), "sg": T.char_grams,
}
PARAGRAPH_FEATURES = {
    "ps": lambda c: T.spaced_tokens(T.word_tokens(c)), "pl": F.lower,
}


def _made(features: dict[str, Callable[[Column], Column]], column: str = "text") -> dict[str, Column]:
    return {name: make(F.col(column)) for name, make in features.items()}


def with_similarity(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds token F1, gram recall and ``similarity`` to pairs of prepared features."""
    counted = pairs.withColumn("common", T.multiset_overlap(F.col("st"), F.col("ss"), F.col("ps")))
    return counted.withColumns(
        {
            "token_f1": T.f1_from_counts(F.col("common"), T.spaced_count(F.col("ps")), F.size("st")),
            # The gram scan is the expensive part; without a common token it is not needed.
            "gram_recall": F.when(F.col("common") > 0, T.gram_recall(F.col("sg"), F.col("pl"))).otherwise(0.0),
        }
    ).withColumn(
        "similarity", T.blend_similarity(F.col("common"), F.col("token_f1"), F.col("gram_recall"))
    ).select(*keep, "token_f1", "gram_recall", "similarity")


def page_similarities(sentences: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Similarity parts of every sentence and sized paragraph of a page (for inspection)."""
    known = sentences.select("page_id", "sid", T.strip_ws(F.col("sent")).alias("text")).where(F.length("text") > 0)
    scored = all_of_page(known.withColumnRenamed("sid", "target_id"), _sized(paragraphs))
    return scored.select("page_id", F.col("target_id").alias("sid"), "para_ord", "token_f1", "gram_recall", "similarity")


def _sized(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where((height() >= MIN_GROUND_HEIGHT) & (width() >= MIN_GROUND_WIDTH)).select(
        "page_id", "para_ord", "text", "x1", "y1", "x2", "y2"
    )


def fallback_boxes(paragraphs: DataFrame) -> DataFrame:
    """First wide paragraph with some text per page, for sentences of unknown text."""
    wide = paragraphs.where((width() >= FALLBACK_WIDTH) & (F.length("text") > FALLBACK_CHARS))
    first = F.min_by(F.struct("para_ord", "x1", "y1", "x2", "y2"), "para_ord").alias("f")
    return wide.groupBy("page_id").agg(first).select("page_id", "f.*")


def ground_sentences(
    sentences: DataFrame, paragraphs: DataFrame, direct_limit: int = DIRECT_LIMIT
) -> DataFrame:
    """Best paragraph per sentence, if similar enough.

    Order: similarity, then width, then page order. Unknown sentence text takes
    the page's first wide paragraph; blank text grounds to nothing.
    """
    trimmed = T.strip_ws(F.col("sent"))
    known = sentences.where(F.length(trimmed) > 0).select(
        "page_id", F.col("sid").alias("target_id"), trimmed.alias("text")
    )
    sized = _sized(paragraphs)
    # One row per target and block of its page; only long pages have more than one block. The threshold is applied to
    # the winner.
    long = long_keys(sized.select("page_id"), "page_id", direct_limit)
    scored = best_of_page(known, sized, (TOKEN_SHARE, GRAM_SHARE), long)
    best = scored.groupBy("page_id", "target_id").agg(
        F.max_by(
            F.struct("para_ord", "x1", "y1", "x2", "y2", "similarity"),
            F.struct("similarity", width(), -F.col("para_ord")),
        ).alias("b")
    )
    grounded = best.where(F.col("b.similarity") >= MIN_SIMILARITY).select(
        "page_id", F.col("target_id").alias("sid"), "b.*"
    )

    unknown = sentences.where(F.col("sent").isNull()).select("page_id", "sid")
    guessed = unknown.join(fallback_boxes(paragraphs), "page_id").withColumn("similarity", F.lit(None).cast("double"))
    return grounded.unionByName(guessed.select(*grounded.columns))


# ---- hop resolution ---------------------------------------------------------

def match_hops(samples: DataFrame) -> DataFrame:
    """Each evidence triple with the chain entry it refers to.

    The exact entity wins; else the first entry where one name is a prefix of
    the other. Both arrays live in the sample row, so there is no join. A
    repeated entity keeps its first position but its last content.
    """
    name = lambda e: F.coalesce(e["entity"], F.lit(""))
    chain = F.col("evidence_chain")
    prefixed = lambda a, b: F.startswith(a, b) | F.startswith(b, a)
    first_alike = F.get(F.filter(chain, lambda e: prefixed(name(e), F.col("t.entity"))), 0)
    exact = F.exists(chain, lambda e: name(e) == F.col("t.entity"))
    matched = F.when(exact, F.col("t.entity")).otherwise(name(first_alike))
    same_name = F.filter(chain, lambda e: name(e) == F.col("matched"))
    last = F.when(F.col("matched").isNotNull(), F.try_element_at(same_name, F.lit(-1)))

    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    usable = filled("evidences") & filled("evidence_chain")
    triples = samples.where(usable).select(
        "sample_id", "evidence_chain", F.posexplode("evidences").alias("hop_pos", "t")
    )
    # Lists of another length than three arrive without entity and relation; a null value is a value.
    malformed = F.col("t.entity").isNull() | F.col("t.relation").isNull()
    return (
        triples.withColumn("matched", F.when(~malformed, matched))
        .withColumn("entry", last)
        .select(
            "sample_id", "hop_pos", F.col("t.entity").alias("query_entity"), "t.relation", F.when(~malformed, F.coalesce("t.value", F.lit("None"))).alias("value"),
            F.col("entry.entity").alias("entity"), F.col("entry.screenshot").alias("screenshot"),
            F.col("entry.sentence_ids").alias("sentence_ids"),
            F.when(malformed, "malformed_triple").when(F.col("entry").isNull(), "no_chain_entry").alias("early_status"),
        )
    )


def _flagged(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Large paragraphs, whether each lies below the image or is usable, and the words of usable ones.

    ``pages`` is ``(page_id, image_height)``; a null height switches the bounds
    check off.
    """
    sized = paragraphs.where((width() >= MIN_PICK_WIDTH) & (height() >= MIN_PICK_HEIGHT)).join(pages, "page_id")
    oob = F.coalesce(F.col("y2") > F.col("image_height"), F.lit(False))
    wordy = F.coalesce(T.word_count(F.col("text")) >= MIN_PICK_WORDS, F.lit(False))
    return sized.withColumns({"oob": oob, "usable": ~oob & wordy}).select(
        "page_id", "para_ord", "x1", "y1", "x2", "y2", "oob", "usable",
        F.when(F.col("usable"), F.split(T.plain_words(F.col("text")), " ")).alias("words"),
    )


def pick_paragraphs(
    targets: DataFrame, paragraphs: DataFrame, pages: DataFrame, direct_limit: int = DIRECT_LIMIT
) -> DataFrame:
    """Best paragraph for each ``(page_id, target_id, value, text)`` with a status.

    Score is coverage of the target sentence plus a bonus when the paragraph
    holds the value; order is score, coverage, top edge, page order.

    Targets of pages with up to ``direct_limit`` paragraphs are compared with
    all of them: both sides are shuffled once, by page. Longer pages take the
    index, see ``_picked_by_index``.
    """
    prepared = targets.select(
        "page_id", "target_id", "text", T.plain_words(F.col("value")).alias("phrase"),
        T.content_tokens(F.col("text")).alias("tokens"),
    )
    long = long_keys(paragraphs.select("page_id"), "page_id", direct_limit)
    if long is None:
        return _picked_directly(prepared, _flagged(paragraphs, pages))
    short, rest = prepared.join(long, "page_id", "left_anti"), prepared.join(long, "page_id", "left_semi")
    on_short, on_long = pages.join(long, "page_id", "left_anti"), pages.join(long, "page_id", "left_semi")
    return _picked_directly(short, _flagged(paragraphs, on_short)).unionByName(
        _picked_by_index(rest, paragraphs, on_long)
    )


# Highest score, then coverage, then the top edge, then page order.
PICK_ORDER = lambda: F.struct("score", "coverage", -F.col("y1"), -F.col("para_ord"))
PICKED = lambda: F.struct("para_ord", "x1", "y1", "x2", "y2", "coverage", "has_value", "score")


def _picked(judged: DataFrame) -> DataFrame:
    """Status and winner of targets that carry ``n_usable``, ``n_oob`` and the best-scored candidate ``b``."""
    reached = judged.withColumn("b", F.when(F.col("b.score") >= MIN_PICK_SCORE, F.col("b")))
    oob = lambda reason: F.concat(F.lit(reason), F.when(F.coalesce("n_oob", F.lit(0)) > 0, "_oob").otherwise(""))
    status = (
        F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "no_target_sent")
        .when(F.coalesce("n_usable", F.lit(0)) == 0, oob("no_candidates"))
        .when(F.col("b").isNull(), oob("below_threshold"))
        .when(F.col("b.has_value"), "val_match")
        .otherwise("sim_only")
    )
    return reached.select("page_id", "target_id", status.alias("status"), "b.*")


def _picked_directly(prepared: DataFrame, flagged: DataFrame) -> DataFrame:
    """Every target next to all large paragraphs of its page: one join and one aggregate on the page key."""
    texts = flagged.withColumn("words", F.array_join("words", " "))
    compared = prepared.join(texts.hint("merge"), "page_id", "left").withColumn(
        "asks", F.coalesce(F.col("usable") & (F.length("text") > 0), F.lit(False))
    ).withColumns(
        {
            "coverage": F.when(F.col("asks"), T.coverage_within(F.col("tokens"), F.col("words"))),
            "has_value": F.when(F.col("asks"), F.coalesce(T.words_within(F.col("phrase"), F.col("words")), F.lit(False))),
        }
    )
    scored = compared.withColumn(
        "score", F.col("coverage") + F.when(F.col("has_value"), T.VALUE_BONUS).otherwise(0.0)
    )
    # Rows without a score have no order, and ``max_by`` passes them over.
    return _picked(
        scored.groupBy("page_id", "target_id", "text").agg(
            F.count_if("usable").alias("n_usable"), F.count_if("oob").alias("n_oob"),
            F.max_by(PICKED(), F.when(F.col("score").isNotNull(), PICK_ORDER())).alias("b"),
        )
    )


def _picked_by_index(prepared: DataFrame, paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """The same for long pages, by an index of words and places.

    A paragraph with the value is found by phrase look-up. One without it needs
    the whole score as coverage, so only the rarest words of a target are looked
    up. Both prepared tables are written to the shared folder while the plan is
    built, because several branches read them.
    """
    prepared = materialize(prepared, "pick_targets")
    asked_pages = prepared.select("page_id").distinct()
    flagged = materialize(_flagged(paragraphs, pages.join(asked_pages, "page_id", "left_semi")), "pick_paragraphs")
    stats = flagged.groupBy("page_id").agg(F.count_if("usable").alias("n_usable"), F.count_if("oob").alias("n_oob"))
    usable = flagged.where("usable")
    asked = prepared.where(F.length("text") > 0)

    # Without the bonus of the value all of the score has to be coverage.
    pairs = candidates(asked, usable, MIN_PICK_SCORE)
    compared = pairs.join(asked.select("page_id", "target_id", "phrase", "tokens"), ["page_id", "target_id"]).join(
        usable.select("page_id", "para_ord", "x1", "y1", "x2", "y2", "words"), ["page_id", "para_ord"]
    ).withColumns(
        {
            "coverage": T.coverage(F.col("tokens"), F.col("words")),
            "has_value": stands_at(F.col("phrase"), F.col("words"), F.col("starts")),
        }
    )
    scored = compared.select(
        "page_id", "target_id", "para_ord", "x1", "y1", "x2", "y2", "coverage", "has_value",
        (F.col("coverage") + F.when(F.col("has_value"), T.VALUE_BONUS).otherwise(0.0)).alias("score"),
    )
    best = scored.groupBy("page_id", "target_id").agg(F.max_by(PICKED(), PICK_ORDER()).alias("b"))
    return _picked(prepared.join(stats, "page_id", "left").join(best, ["page_id", "target_id"], "left"))


def resolve_hops(samples: DataFrame, context: DataFrame, page_of: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row per evidence triple with its status and, if resolved, its box.

    ``context`` is (entity, sid, sent), ``page_of`` is (screenshot, page_id,
    image_height, side_table): ``side_table`` is ``ok``, ``missing`` or ``bad``.
    Equal questions, that is (screenshot, entity, sentence, value), are answered
    once, and only hops of known pages ask one. Pages, questions and answers are
    written to the shared folder while the plan is built, so that their sizes
    decide how the many hops meet them; the hops themselves move once.
    """
    hops = match_hops(samples).withColumn("sid", F.get("sentence_ids", 0))
    pages = materialize(page_of.select("screenshot", "page_id", "image_height", "side_table"), "hop_pages")
    answers = materialize(_answered(hops, context, pages, paragraphs), "hop_answers")
    # Rows without a partner get keys of their own, which match nothing: null keys would all meet in one task.
    alone = _alone("sample_id", "hop_pos")
    answer = answers.select(*[F.col(c).alias(f"a_{c}") for c in QUESTION], *[c for c in answers.columns if c not in QUESTION])
    # Where only resolved hops are wanted, this condition lets those of unknown pages leave before the others move.
    same = (F.col("page") == F.col("a_screenshot")) & (F.coalesce("page", alone) == F.col("a_screenshot")) & (
        (F.col("value") == F.col("a_value")) & F.col("entity").eqNullSafe(F.col("a_entity")) & F.col("sid").eqNullSafe(F.col("a_sid"))
    )
    listed = pages.select(F.col("screenshot").alias("page")).distinct()
    paged = hops.withColumn("at", F.coalesce("screenshot", alone)).join(listed, F.col("at") == F.col("page"), "left").drop("at")
    # The sentence of a hop whose page is unknown; the optimizer leaves this join out where nobody reads the sentence.
    known = context.groupBy(F.col("entity").alias("of"), F.col("sid").alias("of_sid")).agg(F.min("sent").alias("of_sent"))
    found = paged.join(answer, same, "left").withColumn("at", F.when(F.col("status").isNull(), F.coalesce("entity", alone)).otherwise(alone))
    return found.join(known, (F.col("at") == F.col("of")) & (F.col("sid") == F.col("of_sid")), "left").select(
        "sample_id", "hop_pos",
        T.relation_question(F.col("relation"), F.col("query_entity")).alias("question"),
        F.col("value").alias("answer"), "entity", "screenshot", "sentence_ids",
        F.coalesce("early_status", "status", F.lit("no_bboxes_file")).alias("status"), "para_ord",
        F.when(F.col("para_ord").isNotNull(), F.array("x1", "y1", "x2", "y2")).alias("bbox"),
        F.coalesce("sent", "of_sent", F.lit("")).alias("target_sentence"), "coverage", "score",
    )


QUESTION = ("screenshot", "entity", "sid", "value")


def _alone(*key: str) -> Column:
    """A key that no name equals, one of ``LONELY_KEYS``."""
    return F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*key), F.lit(LONELY_KEYS)).cast("string"))


def _answered(hops: DataFrame, context: DataFrame, pages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Each distinct question of a known page with its sentence, status and best paragraph.

    Pages and sentences listed more than once give one row each time.
    """
    questions = materialize(
        hops.where(F.col("early_status").isNull()).select(*QUESTION)
        .join(pages.select("screenshot"), "screenshot", "left_semi").dropDuplicates(),
        "hop_asked",
    )
    # Sentences outside the asked numbers move nowhere; no question or no number asks for none.
    first, last = questions.agg(F.min("sid"), F.max("sid")).first()
    context = context.where(F.col("sid").between(first, last))
    alone = _alone(*QUESTION)
    side = F.coalesce("side_table", F.lit("missing"))
    state = F.when(side == "missing", "no_bboxes_file").when(side == "bad", "bad_bboxes_file")
    key = F.unhex(F.md5(F.concat_ws("\u0001", F.col("page_id").cast("string"), "value", F.coalesce("sent", F.lit("")))))
    keyed = materialize(
        questions.join(pages, "screenshot").withColumn("of", F.coalesce("entity", alone))
        .join(context.select(F.col("entity").alias("of"), "sid", "sent"), ["of", "sid"], "left")
        .withColumn("state", state)
        .select(*QUESTION, "page_id", "sent", "state", F.coalesce(F.when(F.col("state").isNull(), key), alone.cast("binary")).alias("target_id")),
        "hop_questions",
    )
    wanted = (
        keyed.where(F.col("state").isNull())
        .select("page_id", "target_id", "value", F.coalesce("sent", F.lit("")).alias("text"))
        .repartition("page_id")  # one shuffle for the distinct step and the comparison with the page
        .dropDuplicates(["page_id", "target_id"])
    )
    readable = pages.where("side_table = 'ok'").select("page_id", "image_height").dropDuplicates(["page_id"])
    picked = pick_paragraphs(wanted, paragraphs, readable)
    return keyed.drop("page_id").join(picked.drop("page_id"), "target_id", "left").select(
        *QUESTION, "sent", F.coalesce("state", "status").alias("status"), "para_ord", "x1", "y1", "x2", "y2", "coverage", "score"
    )


def sample_outcomes(samples: DataFrame, hops: DataFrame, strict: bool = False) -> DataFrame:
    """Kept and total hops per sample, the sample-level status, and whether it stays."""
    counts = hops.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_hops_total"), F.count("bbox").alias("n_hops_kept")
    )
    kept, total = F.coalesce("n_hops_kept", F.lit(0)), F.coalesce("n_hops_total", F.lit(0))
    status = (
        F.when(total == 0, "no_evidence_or_chain")
        .when(kept == 0, "sample_dropped_all_hops_oob")
        .when(kept < total, "sample_partial_hops_dropped")
    )
    stays = (kept >= total) & (kept > 0) if strict else kept > 0
    return samples.select("sample_id").join(counts, "sample_id", "left").select(
        "sample_id", kept.alias("n_hops_kept"), total.alias("n_hops_total"), status.alias("status"), stays.alias("kept")
    )


def status_histogram(hops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Hop and sample statuses with their counts, most frequent first."""
    statuses = hops.select("status").unionByName(outcomes.select("status")).where(F.col("status").isNotNull())
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def drop_report(outcomes: DataFrame) -> DataFrame:
    """One row with input, kept and dropped sample counts and the dropped share in percent."""
    n = F.count(F.lit(1))
    kept = F.count_if("kept")
    return outcomes.agg(n.alias("n_input"), kept.alias("n_kept"), (n - kept).alias("n_dropped")).withColumn(
        "dropped_pct", 100.0 * F.col("n_dropped") / F.greatest(F.lit(1), F.col("n_input"))
    )


# ---- single-hop expansion ---------------------------------------------------

def expand_single_hop(samples: DataFrame, hops: DataFrame) -> DataFrame:
    """Single-hop samples: one per resolved triple, or per chain entry without triples."""
    entry = F.struct(
        F.col("entity"), F.col("screenshot"), F.array("bbox").alias("bboxes"), F.col("sentence_ids")
    )
    kind = samples.select("sample_id", F.coalesce("type", F.lit("")).alias("type"))
    by_triple = hops.where(F.col("bbox").isNotNull()).join(kind, "sample_id").select(
        "sample_id", F.col("hop_pos").cast("int").alias("hop_pos"), "question", "answer",
        F.col("answer").alias("evidence_value"), "target_sentence", "type", F.lit(1).alias("num_hops"),
        F.array(entry).alias("evidence_chain"),
    )
    no_triples = samples.where(F.coalesce(F.size("evidences"), F.lit(0)) <= 0)
    none = F.lit(None).cast("string")
    by_entry = no_triples.select(
        "sample_id", F.posexplode("evidence_chain").alias("hop_pos", "e"), "question", "answer", "type"
    ).select(
        "sample_id", "hop_pos", "question", "answer", none.alias("evidence_value"), none.alias("target_sentence"),
        F.coalesce("type", F.lit("")).alias("type"), F.lit(1).alias("num_hops"),
        F.array(F.struct("e.entity", "e.screenshot", "e.bboxes", "e.sentence_ids")).alias("evidence_chain"),
    )
    return by_triple.unionByName(by_entry)


def is_single_hop(samples: DataFrame) -> DataFrame:
    """Whether all samples have exactly one hop; false for an empty table."""
    one = (F.coalesce("num_hops", F.lit(0)) == 1) & (F.coalesce(F.size("evidence_chain"), F.lit(0)) == 1)
    return samples.agg(F.coalesce(F.bool_and(one), F.lit(False)).alias("pre_expanded"))


# ---- legacy value checks ----------------------------------------------------

def find_by_value(targets: DataFrame, paragraphs: DataFrame, direct_limit: int = DIRECT_LIMIT) -> DataFrame:
    """Paragraph holding the value, closest to the sentence, then widest, then topmost.

    ``targets`` is ``(page_id, target_id, value, text)``; ``text`` may be empty.
    Pages of more than ``direct_limit`` paragraphs are cut into blocks.
    """
    sized = paragraphs.where((width() >= MIN_LEGACY_WIDTH) & (height() >= MIN_PICK_HEIGHT))
    long = long_keys(sized.where(F.col("text").isNotNull()).select("page_id"), "page_id", direct_limit)
    return closest_holding(targets, sized, long)


def box_contains_value(targets: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Whether the first paragraph at the given box holds the value; unknown boxes pass."""
    box = ["x1", "y1", "x2", "y2"]
    joined = targets.join(paragraphs, ["page_id", *box], "left")
    first = F.min_by(T.contains_ci(F.col("value"), F.col("text")), "para_ord")
    return joined.groupBy("page_id", "target_id").agg(F.coalesce(first, F.lit(True)).alias("ok"))
