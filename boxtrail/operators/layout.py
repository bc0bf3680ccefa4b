"""Page layout snapshots -> paragraph boxes, and locating sentences on a page.

A layout row holds one page with its elements nested, so everything up to the
exploded paragraph table happens inside the row: no shuffle. Pages too long for
that come as element rows and go through an interval join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.functions import geometry as G, text as T
from boxtrail.functions.binding import select_where
from boxtrail.operators.containment import containing
from boxtrail.runtime import materialize

# ---- Fixed values -----------------------------------------------------------
TEXT_TAGS = ("P", "TD", "TH", "LI", "DD", "DT", "CAPTION", "FIGCAPTION")
ORDINAL_TAGS = ("P", "TD", "TH", "LI", "DD", "DT", "CAPTION")
FLOAT_CLASSES = ("infobox", "vcard", "sidebar", "floatright")
FLOAT_MIN_WIDTH, FLOAT_MIN_HEIGHT, FLOAT_GAP = 50, 20, 10
MIN_WIDTH, MIN_HEIGHT = 30, 5
LINE_MIN_WIDTH, LINE_MIN_HEIGHT = 3, 2
SEARCH_MIN_WIDTH = 50
# -----------------------------------------------------------------------------

# Height of the page strips in which lines meet floats; any value gives the same rows.
STRIP = 512


def visible_elements(elements: DataFrame, text_chars: int | None = None, class_chars: int | None = None) -> DataFrame:
    """Rendered elements worth keeping in a snapshot.

    Drops zero-size elements and textless ones other than images and figures. Fields stay whole unless a number of
    characters is given (500 and 200 in the published data).
    """
    shown = (G.width(F.col("bcr")) > 0) & (G.height(F.col("bcr")) > 0)
    texty = (F.length(T.strip_ws(F.coalesce("text", F.lit("")))) > 0) | F.col("tag").isin("IMG", "FIGURE")
    rects = F.filter("line_rects", lambda r: (G.width(r) > LINE_MIN_WIDTH) & (G.height(r) > LINE_MIN_HEIGHT))
    return elements.where(shown & texty).withColumns(
        {"cls": _cut("cls", class_chars), "text": _cut("text", text_chars), "line_rects": rects}
    )


def _cut(name: str, chars: int | None) -> Column:
    return F.col(name) if chars is None else F.substring(name, 1, chars)


def _is_float(el: Column) -> Column:
    cls = F.lower(F.coalesce(el["cls"], F.lit("")))
    named = F.lit(False)
    for name in FLOAT_CLASSES:
        named = named | F.contains(cls, F.lit(name))
    thumb = F.contains(cls, F.lit("thumb")) & F.contains(cls, F.lit("tright"))
    big = (G.width(el["bcr"]) > FLOAT_MIN_WIDTH) & (G.height(el["bcr"]) > FLOAT_MIN_HEIGHT)
    return ((F.coalesce(el["float"], F.lit("none")) == "right") | named | thumb) & big


def float_areas(elements: Column) -> Column:
    """Right-hand regions as ``(left, top, bottom)``; text must end before ``left``."""
    return F.transform(
        F.filter(elements, _is_float),
        lambda el: F.struct(
            (F.get(el["bcr"], 0).cast("int") - FLOAT_GAP).alias("left"),
            F.get(el["bcr"], 1).cast("int").alias("top"),
            F.get(el["bcr"], 3).cast("int").alias("bottom"),
        ),
    )


def float_regions(layout: DataFrame) -> DataFrame:
    """One row per float region of a page."""
    return layout.select("page_id", F.posexplode(float_areas(F.col("elements"))).alias("float_ord", "r")).select(
        "page_id", "float_ord", "r.left", "r.top", "r.bottom"
    )


def _clip_right(rect: Column, floats: Column) -> Column:
    """The rectangle with its right edge moved left of every float it overlaps vertically."""
    overlapping = F.filter(floats, lambda f: (F.get(rect, 3) > f["top"]) & (F.get(rect, 1) < f["bottom"]))
    right = F.aggregate(overlapping, F.get(rect, 2).cast("int"), lambda x2, f: F.least(x2, f["left"]))
    return F.array(F.get(rect, 0).cast("int"), F.get(rect, 1).cast("int"), right, F.get(rect, 3).cast("int"))


def layout_to_paragraphs(layout: DataFrame, text_chars: int | None = None, max_height: int | None = None) -> DataFrame:
    """Text elements of each page with their tight, float-free box.

    Texts stay whole and boxes may have any height, unless limits are given (2000 characters, below 800 pixels in the
    published data).

    Lines are clipped one by one and the survivors are united. Elements without
    line rectangles use their own rectangle; elements whose lines all vanish
    are dropped.
    """
    areas = layout.select("page_id", "elements", float_areas(F.col("elements")).alias("floats"))
    elements = areas.select("page_id", "floats", F.posexplode("elements").alias("el_ord", "el"))
    texts = select_where(
        elements.where(F.col("el.tag").isin(*TEXT_TAGS)),
        ["page_id", "el_ord", "floats", "el.bcr", "el.line_rects"],
        F.struct(T.clean_text(F.col("el.text")).alias("text")),
        lambda s: F.length(s["text"]) > 0,
    )

    has_lines = F.size(F.coalesce("line_rects", F.array().cast("array<array<int>>"))) > 0
    sources = F.when(has_lines, F.col("line_rects")).otherwise(F.array("bcr"))
    clipped = F.transform(sources, lambda r: _clip_right(r, F.col("floats")))
    kept = texts.select(
        "page_id", "el_ord", _cut("text", text_chars).alias("text"),
        F.filter(clipped, lambda r: G.width(r) > 0).alias("rects"),
    )

    edge = lambda i, pick: pick(F.transform("rects", lambda r: F.get(r, i)))
    box = F.struct(
        edge(0, F.array_min).alias("x1"), edge(1, F.array_min).alias("y1"),
        edge(2, F.array_max).alias("x2"), edge(3, F.array_max).alias("y2"),
    )

    def fits(b: Column) -> Column:
        w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
        big = (w > MIN_WIDTH) & (h > MIN_HEIGHT)
        return big if max_height is None else big & (h < max_height)

    # el_ord is the paragraph's order on its page: gaps do not matter, only the order does.
    return select_where(kept, ["page_id", F.col("el_ord").alias("para_ord"), "text"], box, fits)


def _strips(top: Column, bottom: Column) -> Column:
    """Numbers of the page strips between two edges, both included, in whichever order they are; null for a null edge."""
    number = lambda y: F.floor(y / STRIP)
    return F.sequence(number(F.least(top, bottom)), number(F.greatest(top, bottom)))


def clip_lines(lines: DataFrame, floats: DataFrame) -> DataFrame:
    """Lines with their right edge moved left of every float they overlap vertically, as an interval join.

    ``lines`` is (page_id, el_ord, x1, y1, x2, y2), ``floats`` is (page_id, left, top, bottom) with top above bottom. Both
    are cut into page strips: an overlap has a point in some strip of either, and the least edge does not mind being found
    in two, so lines meet only the floats of their own strips and a long page spreads over as many tasks as it has strips.
    Equal lines of an element become one. Lines with a null edge pass unchanged, lines left without width are dropped.
    """
    edges = ["x1", "y1", "x2", "y2"]
    # Edges are whole pixels, as in the row-wise form; a line without edges lies in no strip and stays by the outer explode.
    cut = lines.select("page_id", "el_ord", *edges, F.explode_outer(_strips(F.col("y1"), F.col("y2"))).alias("strip"))
    walls = floats.select(
        F.col("page_id").alias("on"), "left", "top", "bottom", F.explode(_strips(F.col("top"), F.col("bottom"))).alias("at")
    ).distinct()
    meets = (F.col("page_id") == F.col("on")) & (F.col("strip") == F.col("at")) & (F.col("y2") > F.col("top")) & (F.col("y1") < F.col("bottom"))
    nearest = cut.join(walls, meets, "left").groupBy("page_id", "el_ord", *edges).agg(F.min("left").alias("left"))
    return nearest.withColumn("x2", F.least("x2", "left")).where(F.col("x2") > F.col("x1")).select("page_id", "el_ord", *edges)


def element_rows_to_paragraphs(elements: DataFrame, text_chars: int | None = None, max_height: int | None = None) -> DataFrame:
    """``layout_to_paragraphs`` for pages kept as one row per element, so that no page has to fit one row or one task.

    ``elements`` is (page_id, el_ord, tag, cls, text, bcr, float, line_rects) with (page_id, el_ord) unique. Rows are the
    same; see there for the optional limits. An empty table gives no rows.
    """
    whole = F.struct("cls", "float", "bcr")
    floats = elements.where(_is_float(whole)).select("page_id", F.explode(float_areas(F.array(whole))).alias("r")).select("page_id", "r.*")
    texts = select_where(
        elements.where(F.col("tag").isin(*TEXT_TAGS)), ["page_id", "el_ord", "bcr", "line_rects"],
        F.struct(T.clean_text(F.col("text")).alias("text")), lambda s: F.length(s["text"]) > 0,
    )
    has_lines = F.size(F.coalesce("line_rects", F.array().cast("array<array<int>>"))) > 0
    rects = texts.select("page_id", "el_ord", F.explode(F.when(has_lines, F.col("line_rects")).otherwise(F.array("bcr"))).alias("r"))
    lines = rects.select("page_id", "el_ord", *[F.get("r", i).cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    boxes = clip_lines(lines, floats).groupBy("page_id", "el_ord").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    big = (w > MIN_WIDTH) & (h > MIN_HEIGHT)
    kept = boxes.where(big if max_height is None else big & (h < max_height))
    return texts.join(kept, ["page_id", "el_ord"]).select(
        "page_id", F.col("el_ord").alias("para_ord"), _cut("text", text_chars).alias("text"), "x1", "y1", "x2", "y2"
    )


def locatable_elements(layout: DataFrame) -> DataFrame:
    """Text elements with their order and their number among non-empty elements."""
    tagged = F.filter("elements", lambda e: e["tag"].isin(*TEXT_TAGS))
    filled = F.filter("elements", lambda e: e["tag"].isin(*ORDINAL_TAGS) & (F.length(T.strip_ws(e["text"])) > 0))
    pick = lambda arr, kind: F.transform(
        arr,
        lambda e, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("ord"), e["text"].alias("text"), e["bcr"].alias("box")
        ),
    )
    both = F.concat(pick(tagged, "text"), pick(filled, "ordinal"))
    return layout.select("page_id", F.explode(both).alias("e")).select("page_id", "e.*")


def locate_by_text(targets: DataFrame, layout: DataFrame, prefix: int | None = None, max_height: int | None = None) -> DataFrame:
    """First fitting element of the page whose text contains the whole sentence, or its first ``prefix`` characters.

    ``targets`` is ``(page_id, sid, sent)``. Equal texts of a page are searched
    once, through the containment join; only the first hit leaves the aggregate. The texts are written to the shared
    folder while the plan is built, as they are counted and searched.
    """
    w, h = G.width(F.col("box")), G.height(F.col("box"))
    fit = (w > SEARCH_MIN_WIDTH) & (h > MIN_HEIGHT)
    fit = fit if max_height is None else fit & (h < max_height)
    elements = locatable_elements(layout).where((F.col("kind") == "text") & fit)
    first = materialize(
        elements.groupBy("page_id", "text").agg(F.min("ord").alias("text_id"), F.min_by("box", "ord").alias("box")), "page_texts"
    )
    start = F.trim("sent") if prefix is None else F.substring(F.trim("sent"), 1, prefix)
    needle = F.replace(start, F.lit("\n"), F.lit(" "))
    wanted = targets.where(F.length(F.trim("sent")) > 0).select("page_id", "sid", needle.alias("needle"))
    hits = containing(wanted, first, needle_carry=("sid",), text_carry=("box",))
    return hits.groupBy("page_id", "sid").agg(F.min_by("box", "text_id").alias("text_box"))


def locate_by_ordinal(targets: DataFrame, layout: DataFrame) -> DataFrame:
    """Element whose number among the page's non-empty elements equals the sentence id."""
    numbered = locatable_elements(layout).where(F.col("kind") == "ordinal").select(
        "page_id", F.col("ord").alias("sid"), F.col("box").alias("ordinal_box")
    )
    return targets.select("page_id", "sid").join(numbered, ["page_id", "sid"])


def locate_sentences(targets: DataFrame, layout: DataFrame) -> DataFrame:
    """Box per target: by text if found, else by ordinal; insane boxes are dropped."""
    found = (
        targets.select("page_id", "sid")
        .join(locate_by_text(targets, layout), ["page_id", "sid"], "left")
        .join(locate_by_ordinal(targets, layout), ["page_id", "sid"], "left")
    )
    return found.withColumn("box", F.coalesce("text_box", "ordinal_box")).where(G.is_sane(F.col("box"))).select(
        "page_id", "sid", "box", F.col("text_box").isNotNull().alias("by_text")
    )
