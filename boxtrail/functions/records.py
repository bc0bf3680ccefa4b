"""Target texts, prompt contents, image ids and supervision masks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boxtrail.functions import prompts as P
from boxtrail.functions.binding import bind

IGNORED_LABEL = -100


def json_text(value: Column) -> Column:
    """A string as a JSON string literal; non-ASCII characters stay."""
    wrapped = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v")))
    return bind(wrapped, lambda w: F.substring(w, F.lit(6), F.length(w) - 6))


def boxes_text(boxes: Column) -> Column:
    """``[[x1, y1, x2, y2], ...]`` of all boxes with four numbers."""
    four = F.filter(F.coalesce(boxes, F.array().cast("array<array<int>>")), lambda b: F.size(b) == 4)
    shown = F.transform(four, lambda b: F.concat(F.lit("["), F.array_join(b.cast("array<string>"), ", "), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def image_number_map(screenshots: Column) -> Column:
    """screenshot -> ``img_N``; on repeats the last position counts."""
    distinct = F.array_distinct(screenshots)
    n = F.size(screenshots)
    last = lambda s: n - F.array_position(F.reverse(screenshots), s).cast("int")
    return F.map_from_arrays(distinct, F.transform(distinct, lambda s: F.concat(F.lit("img_"), last(s).cast("string"))))


def resolve_image_id(own: Column, by_entity: Column, by_screenshot: Column, position: Column) -> Column:
    """Own id, the entity's, the screenshot's, else ``img_<position>``; empty counts as missing."""
    blank = F.lit("")
    return F.coalesce(
        F.nullif(own, blank), F.nullif(by_entity, blank), F.nullif(by_screenshot, blank),
        F.concat(F.lit("img_"), position.cast("string")),
    )


def multi_hop_target(chain: Column, answer: Column, images: Column) -> Column:
    """Target text with the evidence chain first and the answer last.

    ``images`` maps entities and screenshots to image ids, used where a hop has none.
    """
    key = lambda e: F.coalesce(e["entity"], e["screenshot"], F.lit(""))

    def hop(e: Column, i: Column) -> Column:
        image = resolve_image_id(
            e["image_id"], F.try_element_at(images, key(e)), F.try_element_at(images, F.coalesce(e["screenshot"], F.lit(""))), i
        )
        return F.concat(
            F.lit('{"hop": '), (i + 1).cast("string"), F.lit(', "image_id": '), json_text(image),
            F.lit(', "bboxes": '), boxes_text(e["bboxes"]), F.lit(', "sub_query": '), json_text(e["sub_query"]), F.lit("}"),
        )

    return F.concat(
        F.lit('{"evidence_chain": ['), F.array_join(F.transform(chain, hop), ", "),
        F.lit('], "answer": '), json_text(answer), F.lit("}"),
    )


def single_hop_target(chain: Column, answer: Column, reasoning: Column | None) -> Column:
    """Short target with all boxes of the first hop; ``reasoning=None`` leaves that key out."""
    lead = F.lit('{"bbox": ') if reasoning is None else F.concat(
        F.lit('{"reasoning": '), json_text(reasoning), F.lit(', "bbox": ')
    )
    return F.concat(lead, boxes_text(F.get(chain, 0)["bboxes"]), F.lit(', "answer": '), json_text(answer), F.lit("}"))


def _part(kind: str, image: Column | None = None, text: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("type"), (none if image is None else image).alias("image"), (none if text is None else text).alias("text")
    )


def multi_hop_content(question: Column, paths: Column) -> Column:
    """Interleaved images and ``[img_i]`` tags, then the question and the instruction."""
    pairs = F.flatten(
        F.transform(
            paths,
            lambda p, i: F.array(
                _part("image", image=p), _part("text", text=F.concat(F.lit("[img_"), i.cast("string"), F.lit("]")))
            ),
        )
    )
    ask = F.concat(F.lit("\nQuestion: "), question, F.lit("\n\n" + P.MULTI_HOP_INSTRUCTION))
    return F.concat(pairs, F.array(_part("text", text=ask)))


def single_hop_content(question: Column, path: Column) -> Column:
    ask = F.concat(F.lit("Question: "), question, F.lit("\n\n" + P.SINGLE_HOP_INSTRUCTION))
    return F.array(_part("image", image=path), _part("text", text=ask))


def messages(system: Column, content: Column, target: Column) -> Column:
    """System, user and assistant turns; the user turn carries typed parts."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.array(_part("text", text=system)).alias("content")),
        F.struct(F.lit("user").alias("role"), content.alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.array(_part("text", text=target)).alias("content")),
    )


def prompt_only(turns: Column) -> Column:
    """The conversation without assistant turns."""
    return F.filter(turns, lambda m: m["role"] != "assistant")


def supervision_mask(input_ids: Column, prompt_len: Column, pad_id: Column) -> Column:
    """Labels: the prompt and all padding are ignored, the rest is copied."""
    return F.transform(
        input_ids, lambda x, i: F.when((i < prompt_len) | (x == pad_id), F.lit(IGNORED_LABEL)).otherwise(x)
    )


def prompt_length(prompt_ids: Column, pad_id: Column) -> Column:
    """Number of prompt tokens that are not padding."""
    return F.size(F.filter(prompt_ids, lambda x: x != pad_id))
