"""Reading untrusted model output with VARIANT columns."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, functions as F

from boxtrail.functions.binding import bind
from boxtrail.functions.text import strip_ws

# ---- Fixed values -----------------------------------------------------------
FENCED_OBJECT = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
ANSWER_PHRASES = (
    r'(?i)"answer"\s*:\s*"([^"]*)"',
    r"(?i)answer[:\s]+(.+?)(?:\n|$)",
    r"(?i)The answer is[:\s]+(.+?)(?:\.|$)",
)
# -----------------------------------------------------------------------------

# Strings, number words and everything between them, without loss.
JSON_PIECES = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?Infinity|NaN|[^"NI\-]++|.'
# JSON has no such numbers: they are read as texts with this mark, followed by the spelling answers are compared in.
MARK = "\u0000"
NUMBER_WORDS = {"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}
# Box in place of one with a coordinate that is no finite number: it overlaps nothing and its center lies in no image.
NOWHERE = (-1.0, -1.0, -1.0, -1.0)

CHAIN_TYPE = "array<struct<hop:int,image_id:string,bboxes:array<array<double>>>>"
NO_BOXES = "array<array<double>>"


def _kind(v: Column) -> Column:
    """Type name of a variant value, e.g. ``BIGINT`` or ``ARRAY<...>``."""
    return F.schema_of_variant(v)


def _is_array(v: Column) -> Column:
    return _items(v).isNotNull()  # the type name would spell out all that is inside


def is_object(v: Column) -> Column:
    return _entries(v).isNotNull()


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _entries(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def json_whole(text: Column) -> Column:
    """Variant of a text that is one complete JSON value, otherwise null.

    The JSON reader stops after the first complete value. Wrapping the text in
    brackets makes trailing text visible: it turns into a syntax error or into
    a second element.
    """
    closed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    listed = _items(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    return F.when(closed, bind(listed, lambda items: F.when(F.size(items) == 1, F.get(items, 0))))


def has_number_words(text: Column) -> Column:
    return F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity"))


def marked_numbers(text: Column) -> Column:
    """``NaN``, ``Infinity`` and ``-Infinity`` outside strings as marked texts, everything else as it is."""
    def piece(x: Column) -> Column:
        shown = x
        for word, spelling in NUMBER_WORDS.items():
            shown = F.when(x == word, F.lit(f'"\\u0000{spelling}"')).otherwise(shown)
        return shown

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(JSON_PIECES), F.lit(0)), piece), "")


def _with_number_words(text: Column, parse: Callable[[Column], Column]) -> Column:
    """``parse`` of the text; only the few texts with number words are rewritten first."""
    return F.when(has_number_words(text), bind(marked_numbers(text), parse)).otherwise(parse(text))


def _is_marked(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit(MARK)), F.lit(False))


def parse_lenient(text: Column) -> Column:
    """Variant found in model output: whole text, else the first ``{...}`` value. ``NaN`` and infinities are numbers."""
    return _with_number_words(text, _parse_lenient)


def _parse_lenient(text: Column) -> Column:
    blob = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    # A text that opens with an object needs one parse: its first complete value
    # is the answer, whether or not other text follows.
    opens = F.startswith(F.ltrim(text), F.lit("{"))
    return F.when(opens, F.try_parse_json(text)).otherwise(F.coalesce(json_whole(text), F.try_parse_json(blob)))


def is_truthy(v: Column) -> Column:
    """Whether a parsed value counts as output: not null, empty, zero or false."""
    return bind(v, _is_truthy)


def _is_truthy(v: Column) -> Column:
    shown = v.cast("string")
    is_text = F.coalesce(_kind(v) == "STRING", F.lit(False))
    zero = F.coalesce(F.try_variant_get(v, "$", "double") == 0, F.lit(False))
    scalar = F.when(is_text, shown == "").otherwise((shown == "false") | zero)
    # Each list is unpacked once.
    empty = lambda found, other: bind(found, lambda x: F.when(x.isNotNull(), F.size(x) == 0).otherwise(other))
    nothing = empty(_entries(v), empty(_items(v), scalar))
    return ~(v.isNull() | F.is_variant_null(v) | F.coalesce(nothing, F.lit(False)))


def scalar_text(v: Column) -> Column:
    """Text of a variant: strings as they are, lists joined by ``", "``, null as null.

    Booleans read ``True``/``False``, nested nulls ``None``, numbers with a
    fraction or exponent keep one (``1.0``), and objects show their entries,
    the spelling answers are compared in. Entries are in key order.
    """
    return bind(v, _scalar_text)


def _string_text(x: Column) -> Column:
    written = x.cast("string")
    return F.when(_is_marked(written), F.substring(written, 2, 4)).otherwise(written)


def _number_text(x: Column) -> Column:
    """Whole values of non-integer literals end in ``.0``."""
    plain = _string_text(x)
    fraction = F.coalesce(_kind(x).rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit(False)) & ~plain.rlike("[.EeIN]")
    return F.when(fraction, F.concat(plain, F.lit(".0"))).otherwise(plain)


def _quoted(x: Column) -> Column:
    """A value inside an object: texts in quotes, deeper values as JSON."""
    text = x.cast("string")
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    as_text = F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
    return (
        F.when(x.isNull() | F.is_variant_null(x), F.lit("None"))
        .when(_kind(x) == "BOOLEAN", F.initcap(text))
        .when((_kind(x) == "STRING") & ~_is_marked(text), as_text)
        .otherwise(_number_text(x))
    )


def _object_text(v: Column) -> Column:
    entries = F.map_entries(_entries(v))
    shown = F.transform(entries, lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), _quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}"))


def _scalar_text(v: Column) -> Column:
    def shown(x: Column) -> Column:
        return (
            F.when(x.isNull() | F.is_variant_null(x), F.lit("None"))
            .when(_kind(x) == "BOOLEAN", F.initcap(x.cast("string")))
            .when(is_object(x), _object_text(x))
            .otherwise(_number_text(x))
        )

    joined = F.array_join(F.transform(_items(v), shown), ", ")
    return F.when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("string")).when(
        _is_array(v), joined
    ).otherwise(shown(v))


def _text_or_empty(v: Column) -> Column:
    """Text of a truthy scalar, empty otherwise."""
    any_kind = lambda x: F.when(_is_truthy(x), _scalar_text(x)).otherwise(F.lit(""))
    # Nearly all are strings, which are their own text.
    return bind(v, lambda x: F.when(_kind(x) == "STRING", _string_text(x)).otherwise(any_kind(x)))


def box_list(v: Column) -> Column:
    """Boxes from ``[x1,y1,x2,y2]`` (numbers only) or ``[[...], ...]``; bad items are skipped.

    A box with ``NaN`` or an infinite coordinate counts as a box that matches nothing.
    """
    none = F.array().cast(NO_BOXES)
    by_item = bind(_items(v), lambda items: F.when(items.isNotNull(), _boxes_of(items)).otherwise(none))
    # A list of well-formed boxes is read as a whole; any other one item by item.
    whole = F.try_variant_get(v, "$", NO_BOXES)
    return bind(whole, lambda boxes: F.when(F.forall(boxes, lambda b: (F.size(b) == 4) & _finite(b)), boxes).otherwise(by_item))


def _finite(box: Column) -> Column:
    return F.forall(box, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def _boxes_of(items: Column) -> Column:
    is_number = lambda x: ~F.coalesce(_kind(x).rlike("^(STRING|VOID|ARRAY|OBJECT)"), F.lit(True)) | _is_marked(
        F.try_variant_get(x, "$", "string")
    )
    flat = (F.size(items) == 4) & F.forall(items, is_number)
    one = F.array(F.transform(items, lambda x: F.try_variant_get(x, "$", "double")))

    four = F.filter(F.transform(items, _items), lambda b: b.isNotNull() & (F.size(b) == 4))
    read = F.transform(four, lambda b: F.transform(b, lambda x: F.try_variant_get(x, "$", "double")))
    good = F.filter(read, lambda b: F.forall(b, lambda x: x.isNotNull()))
    nowhere = F.array(*[F.lit(x) for x in NOWHERE])
    return F.transform(F.when(flat, one).otherwise(good), lambda b: F.when(_finite(b), b).otherwise(nowhere))


def _hop_number(v: Column) -> Column:
    """Whole number of a hop: numbers are cut, texts must be whole numbers, anything else is null."""
    return bind(v, _whole_number)


def _whole_number(v: Column) -> Column:
    text = strip_ws(v.cast("string"))
    return F.when(_kind(v) == "STRING", F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))).otherwise(
        F.try_variant_get(v, "$", "double").try_cast("int")
    )


def predicted_chain(parsed: Column) -> Column:
    """Evidence hops of a parsed output.

    A non-empty top-level ``bbox`` (then ``bboxes``) is a single hop. Otherwise
    the object items of ``evidence_chain`` are the hops; a missing or
    non-numeric hop number is the item's position.
    """
    at = lambda v, key, kind="variant": F.try_variant_get(v, f"$.{key}", kind)
    filled = lambda key: bind(box_list(at(parsed, key)), lambda b: F.when(F.size(b) > 0, b))
    single = F.coalesce(filled("bbox"), filled("bboxes"))
    one_hop = bind(
        single,
        lambda b: F.when(
            b.isNotNull(),
            F.array(
                F.struct(F.lit(1).alias("hop"), _text_or_empty(at(parsed, "image_id")).alias("image_id"), b.alias("bboxes"))
            ),
        ),
    )

    steps = F.transform(
        _items(at(parsed, "evidence_chain")),
        lambda ev, i: F.when(
            is_object(ev),
            F.struct(
                F.coalesce(_hop_number(at(ev, "hop")), i + 1).alias("hop"),
                _text_or_empty(at(ev, "image_id")).alias("image_id"),
                F.coalesce(box_list(at(ev, "bboxes")), F.array().cast(NO_BOXES)).alias("bboxes"),
            ),
        ),
    )
    hops = F.filter(steps, lambda s: s.isNotNull())
    found = F.coalesce(one_hop.cast(CHAIN_TYPE), hops.cast(CHAIN_TYPE), F.array().cast(CHAIN_TYPE))
    return F.when(is_object(parsed), found).otherwise(F.array().cast(CHAIN_TYPE))


def hop_boxes(chain: Column) -> Column:
    """(hop, boxes) pairs of a predicted chain."""
    return F.transform(chain, lambda e: F.struct(e["hop"].alias("hop"), e["bboxes"].alias("bboxes")))


def flatten_boxes(chain: Column) -> Column:
    """All four-number boxes of a chain, in hop order."""
    boxes = F.flatten(F.transform(chain, lambda e: F.coalesce(e["bboxes"], F.array().cast(NO_BOXES)).cast(NO_BOXES)))
    return F.filter(boxes, lambda b: F.size(b) == 4)


# ---- strict reading ---------------------------------------------------------

def _with_answer(v: Column) -> Column:
    return bind(v, lambda x: F.when(F.try_variant_get(x, "$.answer", "variant").isNotNull(), x))


def parse_strict(text: Column) -> Column:
    """Object with an ``answer`` key from the text, a fenced block, or the outer braces."""
    return _with_number_words(text, _parse_strict)


def _parse_strict(text: Column) -> Column:
    bare = strip_ws(text)
    fenced = F.nullif(F.regexp_extract(bare, FENCED_OBJECT, 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(*[_with_answer(json_whole(c)) for c in (bare, fenced, outer)])


def fallback_answer(text: Column) -> Column:
    """Answer phrase of free text, null when none is marked."""
    bare = strip_ws(text)
    return F.coalesce(*[F.when(bare.rlike(p), strip_ws(F.regexp_extract(bare, p, 1))) for p in ANSWER_PHRASES])


def strict_answer(parsed: Column, text: Column) -> Column:
    """Answer as text: of the parsed object, else of the free text."""
    v = F.try_variant_get(parsed, "$.answer", "variant")
    return F.when(parsed.isNotNull(), F.coalesce(scalar_text(v), F.lit("None"))).otherwise(fallback_answer(text))


def strict_chain(parsed: Column) -> Column:
    """Cleaned hops of a strict parse: default ids, integer boxes of positive area."""
    at = lambda v, key, kind="variant": F.try_variant_get(v, f"$.{key}", kind)

    def boxes(ev: Column) -> Column:
        lists = F.filter(_items(at(ev, "bboxes")), lambda b: _is_array(b) & (F.size(_items(b)) == 4))
        ints = F.transform(
            lists, lambda b: F.transform(_items(b), lambda x: F.try_variant_get(x, "$", "double").try_cast("int"))
        )
        return F.filter(
            ints,
            lambda b: F.forall(b, lambda x: x.isNotNull()) & (F.get(b, 2) > F.get(b, 0)) & (F.get(b, 3) > F.get(b, 1)),
        )

    def step(ev: Column, i: Column) -> Column:
        hop = F.coalesce(at(ev, "hop", "int"), i + 1)
        return F.struct(
            hop.alias("hop"),
            F.coalesce(at(ev, "image_id", "string"), F.concat(F.lit("img_"), (hop - 1).cast("string"))).alias("image_id"),
            F.coalesce(boxes(ev), F.array().cast("array<array<int>>")).alias("bboxes"),
            F.coalesce(at(ev, "sub_query", "string"), F.lit("")).alias("sub_query"),
        )

    empty = F.array().cast("array<struct<hop:int,image_id:string,bboxes:array<array<int>>,sub_query:string>>")
    return F.coalesce(F.transform(_items(at(parsed, "evidence_chain")), step), empty)
