"""Box and image geometry. A box is an array ``[x1, y1, x2, y2]`` in pixels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from boxtrail.functions.binding import bind

# ---- Fixed values -----------------------------------------------------------
PATCH = 32
IOU_THRESHOLD = 0.3
MIN_SCREENSHOT_SIDE = 100
DEFAULT_IMAGE_SIZE = (1024, 768)
# -----------------------------------------------------------------------------


def width(box: Column) -> Column:
    return F.get(box, 2) - F.get(box, 0)


def height(box: Column) -> Column:
    return F.get(box, 3) - F.get(box, 1)


def _area(box: Column) -> Column:
    return F.greatest(F.lit(0), width(box)) * F.greatest(F.lit(0), height(box))


class Measures(NamedTuple):
    """Corners, area and center of a box; of one box they serve all its comparisons."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column
    area: Column
    cx: Column
    cy: Column

    @classmethod
    def of(cls, box: Column) -> Measures:
        x1, y1, x2, y2 = (F.get(box, i) for i in range(4))
        return cls(x1, y1, x2, y2, _area(box), (x1 + x2) / 2, (y1 + y2) / 2)

    @classmethod
    def read(cls, measured: Column) -> Measures:
        return cls(*[measured[name] for name in cls._fields])

    def stored(self) -> Column:
        return F.struct(*[value.alias(name) for name, value in zip(self._fields, self)])


def measured(boxes: Column) -> Column:
    """The measures of each box, for lists that are compared pair by pair."""
    return F.transform(boxes, lambda b: Measures.of(b).stored())


def overlap(a: Measures, b: Measures) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    inter = F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)
    union = a.area + b.area - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def centered(pred: Measures, gold: Measures) -> Column:
    return pred.cx.between(gold.x1, gold.x2) & pred.cy.between(gold.y1, gold.y2)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when the union is empty."""
    return overlap(Measures.of(a), Measures.of(b))


def center_inside(pred: Column, gold: Column) -> Column:
    """Center of ``pred`` lies in ``gold``; the border counts."""
    return centered(Measures.of(pred), Measures.of(gold))


def relaxed_match(pred: Column, gold: Column, threshold: float = IOU_THRESHOLD) -> Column:
    return (iou(pred, gold) >= threshold) | center_inside(pred, gold)


def is_sane(box: Column, max_side: int | None = None) -> Column:
    """Positive sides; with ``max_side`` (2000 in the published data) none longer than that."""
    sane = (width(box) >= 1) & (height(box) >= 1)
    return sane if max_side is None else sane & (width(box) <= max_side) & (height(box) <= max_side)


def captured_height(h: Column, cap: int | None = None) -> Column:
    """Page height as captured: whole, or cut at ``cap`` pixels (15000 in the published data)."""
    return h if cap is None else F.least(h, F.lit(cap))


def within_bounds(box: Column, w: Column, h: Column) -> Column:
    return (F.get(box, 0) >= 0) & (F.get(box, 1) >= 0) & (F.get(box, 2) <= w) & (F.get(box, 3) <= h)


def _clip(value: Column, upper: Column) -> Column:
    return F.greatest(F.lit(0).cast("double"), F.least(value.cast("double"), upper.cast("double")))


def clip_boxes(boxes: Column, w: Column, h: Column) -> Column:
    """Boxes moved into the image; malformed and empty ones are dropped."""
    four = F.filter(boxes, lambda b: F.size(b) == 4)
    moved = F.transform(
        four,
        lambda b: F.array(_clip(F.get(b, 0), w), _clip(F.get(b, 1), h), _clip(F.get(b, 2), w), _clip(F.get(b, 3), h)),
    )
    return F.filter(moved, lambda b: (width(b) > 0) & (height(b) > 0))


def round_to_patch(n: Column) -> Column:
    return F.greatest(F.lit(PATCH), F.floor(n / PATCH).cast("int") * PATCH).cast("int")


class ResizePlan(NamedTuple):
    width: Column
    height: Column


def resize_plan(w: Column, h: Column, target: Column, max_pixels: int | None) -> ResizePlan:
    """New image size: scale the width to ``target``, respect the pixel budget, floor to patches.

    The order of the floating-point steps is part of the contract: truncation
    sees exactly these products.
    """
    w, h = w.cast("double"), h.cast("double")
    scale = target.cast("double") / w
    nw, nh = (w * scale).cast("long"), (h * scale).cast("long")
    if max_pixels:
        over = nw * nh > max_pixels
        shrunk = scale * F.sqrt(F.lit(float(max_pixels)) / (nw * nh).cast("double"))
        nw, nh = (
            F.when(over, (w * shrunk).cast("long")).otherwise(nw),
            F.when(over, (h * shrunk).cast("long")).otherwise(nh),
        )
    return ResizePlan(round_to_patch(nw), round_to_patch(nh))


def scale_boxes(boxes: Column, w: Column, h: Column, new_w: Column, new_h: Column) -> Column:
    """Integer boxes of the resized image, truncated and clipped per axis."""
    size = F.struct(
        (new_w.cast("double") / w.cast("double")).alias("sx"), (new_h.cast("double") / h.cast("double")).alias("sy"),
        new_w.cast("int").alias("w"), new_h.cast("int").alias("h"),
    )

    def fit(v: Column, s: Column, upper: Column) -> Column:
        return F.greatest(F.lit(0), F.least(upper, (v.cast("int") * s).cast("int")))

    return bind(
        size,
        lambda z: F.transform(
            boxes,
            lambda b: F.array(
                fit(F.get(b, 0), z["sx"], z["w"]), fit(F.get(b, 1), z["sy"], z["h"]),
                fit(F.get(b, 2), z["sx"], z["w"]), fit(F.get(b, 3), z["sy"], z["h"]),
            ),
        ),
    )
