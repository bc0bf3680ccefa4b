"""Text functions: cleaning, tokens, similarity, answer normalization, keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxtrail.functions.binding import bind

# ---- Fixed values -----------------------------------------------------------
# Whitespace as Unicode defines it, including the separator control characters.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NOT_WS = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"

# Style blocks that leak into element text.
STYLE_RULE = r"\.mw-parser-output[^{]*\{[^}]*\}"
MEDIA_RULE = r"@media[^{]*\{[^{}]*(?:\{[^}]*\}[^{}]*)*\}"

# Words that carry no content.
STOPWORDS = """
a an the and or but if then else when of in on at to from by for with as
is are was were be been being have has had do does did will would shall
should may might must can could this that these those he she it they we
you i me him her his hers its their theirs our ours your yours my mine
who whom whose which what where why how there here not no yes so than
because about into through during before after above below up down out
off over under again further once all any both each few more most other
some such only own same too very s t just now also which
""".split()

ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"(?U)\b(a|an|the)\b"

WIKI_BASE = "https://en.wikipedia.org/wiki/"
PAGE_MARKERS = ("__page_", "_page_")

# Similarity weights.
WEIGHT_TOKEN_F1 = 0.6
WEIGHT_GRAM_RECALL = 0.4
VALUE_BONUS = 0.2

# Relations the single-hop builder knows.
RELATIONS = (
    "date of birth", "date of death", "country of citizenship", "place of birth",
    "place of death", "director", "publication date", "publisher", "performer",
    "composer", "screenwriter", "father", "mother", "spouse", "occupation",
)
# -----------------------------------------------------------------------------


def collapse_ws(text: Column) -> Column:
    """Runs of whitespace become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def strip_ws(text: Column) -> Column:
    """Whitespace removed at both ends only."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def clean_text(text: Column) -> Column:
    """Element text without leaked style rules and with collapsed whitespace."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), STYLE_RULE, " ")
    return collapse_ws(F.regexp_replace(bare, MEDIA_RULE, " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_WS + "+"))


# ---- tokens and grams -------------------------------------------------------

def word_tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric words, in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Distinct word tokens of two or more characters that are not stopwords."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOPWORDS)])
    long_enough = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.array_except(long_enough, stop)


def char_grams(text: Column, n: int = 4) -> Column:
    """Distinct character windows of length ``n`` of the lower-cased text.

    One regex pass: each match looks ahead for a window and then consumes a
    single character, so long texts cost linear time.
    """
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))


def spaced_tokens(tokens: Column) -> Column:
    """Tokens in one string, each with its own blank on both sides.

    The doubled inner blank keeps neighbouring equal tokens from sharing a
    separator, so counting ``' tok '`` counts occurrences exactly.
    """
    return F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))


def _occurrences(spaced: Column, token: Column) -> Column:
    padded = F.concat(F.lit(" "), token, F.lit(" "))
    return ((F.length(spaced) - F.length(F.replace(spaced, padded, F.lit("")))) / F.length(padded)).cast("int")


def spaced_count(spaced: Column) -> Column:
    """Number of tokens in a ``spaced_tokens`` string."""
    return F.regexp_count(spaced, F.lit("[a-z0-9]+"))


def multiset_overlap(a_tokens: Column, a_spaced: Column, b_spaced: Column) -> Column:
    """Size of the multiset intersection; ``a`` should be the shorter side.

    Counting runs as string replacement on the spaced form, so the long side
    is never turned into per-element lambda work.
    """
    return F.aggregate(
        F.array_distinct(a_tokens),
        F.lit(0),
        lambda acc, tok: acc + F.least(_occurrences(a_spaced, tok), _occurrences(b_spaced, tok)),
    )


def tagged_tokens(tokens: Column) -> Column:
    """Tokens as set elements: the n-th occurrence of a word is its own element, so an intersection counts multisets.

    In the sorted array equal words are adjacent; each run is numbered on its own, so long texts cost linear time
    after the sort.
    """
    def numbered(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        run = lambda b, at, j: F.slice(s, at + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - at)
        tag = lambda t, k: F.concat(t, F.lit("#"), k.cast("string"))
        return bind(starts, lambda b: F.flatten(F.transform(b, lambda at, j: F.transform(run(b, at, j), tag))))

    return bind(F.array_sort(tokens), numbered)


def f1_from_counts(common: Column, n_pred: Column, n_gold: Column) -> Column:
    """F1 of precision ``common/n_pred`` and recall ``common/n_gold``; 0 if none."""
    p = common / F.greatest(n_pred, F.lit(1))
    r = common / F.greatest(n_gold, F.lit(1))
    return F.when(common > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def gram_recall(sent_grams: Column, para_lower: Column) -> Column:
    """Share of the sentence's grams that occur in the paragraph text.

    A gram is in the paragraph's gram set exactly if the paragraph contains it,
    so the long side needs no gram array.
    """
    hits = F.size(F.filter(sent_grams, lambda g: F.contains(para_lower, g)))
    return F.when(F.size(sent_grams) > 0, hits / F.size(sent_grams)).otherwise(F.lit(0.0))


def blend_similarity(common: Column, f1: Column, recall: Column) -> Column:
    """Weighted similarity; zero when no token is shared."""
    return F.when(common > 0, WEIGHT_TOKEN_F1 * f1 + WEIGHT_GRAM_RECALL * recall).otherwise(F.lit(0.0))


def coverage(target_tokens: Column, para_tokens: Column) -> Column:
    """Share of the target's distinct content tokens found in the paragraph."""
    both = (F.size(target_tokens) > 0) & (F.size(para_tokens) > 0)
    shared = F.size(F.array_intersect(target_tokens, para_tokens))
    return F.when(both, shared / F.size(target_tokens)).otherwise(F.lit(0.0))


def coverage_within(target_tokens: Column, para_words: Column) -> Column:
    """``coverage`` against the ``plain_words`` text of a paragraph."""
    padded = F.concat(F.lit(" "), para_words, F.lit(" "))
    hits = bind(
        padded, lambda p: F.size(F.filter(target_tokens, lambda t: F.contains(p, F.concat(F.lit(" "), t, F.lit(" ")))))
    )
    return F.when(F.size(target_tokens) > 0, hits / F.size(target_tokens)).otherwise(F.lit(0.0))


def plain_words(text: Column) -> Column:
    """Lower-case text with every non-alphanumeric run turned into one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def words_within(value_words: Column, text_words: Column) -> Column:
    """Whole-word containment of two ``plain_words`` strings; blank is false."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (F.length(value_words) > 0) & F.contains(pad(text_words), pad(value_words))


def value_in_text(value: Column, text: Column) -> Column:
    return words_within(plain_words(value), plain_words(text))


def contains_ci(value: Column, text: Column) -> Column:
    return F.contains(F.lower(text), F.lower(value))


# ---- relations and questions ------------------------------------------------

def humanize_relation(relation: Column) -> Column:
    return strip_ws(F.replace(relation, F.lit("_"), F.lit(" ")))


def relation_question(relation: Column, entity: Column) -> Column:
    return F.concat(F.lit("What is the "), humanize_relation(relation), F.lit(" of "), entity, F.lit("?"))


def relation_from_question(question: Column) -> Column:
    """Relation phrase of a templated question, empty when it has another form."""
    return F.regexp_extract(F.lower(question), "^what is the (.+?) of ", 1)


def is_known_relation(relation: Column) -> Column:
    return relation.isin(*RELATIONS)


# ---- file and page keys -----------------------------------------------------

def entity_url(entity: Column, base: str = WIKI_BASE) -> Column:
    return F.concat(F.lit(base), F.replace(entity, F.lit(" "), F.lit("_")))


def safe_filename(entity: Column, chars: int | None = None) -> Column:
    """File-system safe stem: cleaned name, cut at ``chars`` if given (80 in the published data), plus an md5 tag."""
    safe = F.regexp_replace(entity, r"[^\p{L}\p{N}._-]", "_")
    safe = safe if chars is None else F.substring(safe, 1, chars)
    return F.concat_ws("_", safe, F.substring(F.md5(entity), 1, 8))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def deck_key(screenshot: Column) -> Column:
    """Deck part of a page image name, empty without a page marker."""
    stem = base_name(screenshot)
    first, second = PAGE_MARKERS
    return (
        F.when(F.contains(stem, F.lit(first)), F.substring_index(stem, first, 1))
        .when(F.contains(stem, F.lit(second)), F.substring_index(stem, second, 1))
        .otherwise(F.lit(""))
    )


def page_number(screenshot: Column) -> Column:
    """Number between the page marker and the next dot; null when unreadable."""
    stem = base_name(screenshot)
    rest = F.lit(None).cast("string")
    for marker in reversed(PAGE_MARKERS):
        tail = F.substring(stem, F.locate(marker, stem) + len(marker), F.lit(2**30))
        rest = F.when(F.contains(stem, F.lit(marker)), tail).otherwise(rest)
    return F.trim(F.substring_index(rest, ".", 1)).try_cast("int")


def image_index(image_id: Column) -> Column:
    """``img_N`` -> N, otherwise null."""
    digits = F.nullif(F.regexp_extract(image_id, r"^img_([^_]*)", 1), F.lit(""))
    return F.trim(digits).try_cast("int")


# ---- answers ----------------------------------------------------------------

def _drop_punctuation(text: Column) -> Column:
    return F.translate(text, ASCII_PUNCTUATION, "")


def normalize_paper(answer: Column) -> Column:
    """Articles go first, then punctuation (so ``a-b`` becomes ``b``)."""
    return collapse_ws(_drop_punctuation(F.regexp_replace(F.lower(answer), ARTICLES, " ")))


def normalize_train(answer: Column) -> Column:
    """Punctuation goes first, then articles (so ``a-b`` becomes ``ab``); null is empty."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return collapse_ws(F.regexp_replace(_drop_punctuation(low), ARTICLES, " "))


def exact_match_paper(pred: Column, gold: Column) -> Column:
    return (normalize_paper(pred) == normalize_paper(gold)).cast("double")


def exact_match_train(pred: Column, gold: Column) -> Column:
    return (normalize_train(pred) == normalize_train(gold)).cast("int")


def answer_contains(pred: Column, gold: Column) -> Column:
    """1 when the normalized gold answer is non-empty and inside the prediction."""
    g = normalize_train(gold)
    return ((g != "") & F.contains(normalize_train(pred), g)).cast("int")


def answer_f1(pred: Column, gold: Column) -> Column:
    """Token F1 of normalized answers; equality when either side is empty."""
    def score(x: Column) -> Column:
        p, g = x["p"], x["g"]
        n = lambda side: F.size(F.split(side, " "))
        common = bind(
            F.struct(
                F.split(p, " ").alias("t"), spaced_tokens(F.split(p, " ")).alias("p"), spaced_tokens(F.split(g, " ")).alias("g")
            ),
            lambda y: multiset_overlap(y["t"], y["p"], y["g"]),
        )
        f1 = bind(common, lambda c: f1_from_counts(c, n(p), n(g)))
        return F.when((p == "") | (g == ""), (p == g).cast("double")).otherwise(f1)

    return bind(F.struct(normalize_paper(pred).alias("p"), normalize_paper(gold).alias("g")), score)
