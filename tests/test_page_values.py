"""Values looked up in the paragraphs of their page, against brute force and by what the plan moves."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from boxtrail.operators import grounding as G
from boxtrail.operators.page_values import SCAN_LIMIT, Page

PARAGRAPH = "page_id long, para_ord int, text string, x1 int, y1 int, x2 int, y2 int"
TARGET = "page_id long, target_id int, value string, text string"
WORDS = ["The", "the", "of", "cat", "catalogue", "Zürich", "straße", "İstanbul", "42", "a", "and", "|", "ab", "dog's"]


def rows_of(seed: int, pages: int, most: int):
    pick = random.Random(seed)
    line = lambda n: " ".join(pick.choice(WORDS) for _ in range(n))
    paragraphs, targets = [], []
    for page in [*range(pages), None]:
        for k in range(pick.randrange(1, most)):
            # Boxes repeat, so many paragraphs are equally wide and high; some are too narrow or low, some have no size.
            width, top = pick.choice([90, 100, 300, 300, 500, None]), pick.choice([0, 10, 20])
            text = None if pick.random() < 0.05 else line(pick.randrange(0, 12))
            paragraphs.append((page, None if pick.random() < 0.02 else k, text, 5, top, width and 5 + width, top + pick.choice([3, 5, 40])))
        for k in range(most):
            value = pick.choice([None, "", "the", "CAT", "ZÜRICH", "|", "i̇stanbul", "none such", line(1), line(2)])
            targets.append((page, pick.choice([None, k, k, k]), value, pick.choice([None, "", line(3), line(9)])))
    targets += targets[:5]
    paragraphs.append((0, most, "the " * 99 + "end", 5, 0, 105, 40))  # words that repeat often
    targets += [(0, most, "end", "the " * 70), (0, most + 1, "end", "the " * 120)]
    return paragraphs, targets


def by_brute_force(paragraphs, targets):
    words = lambda t: Counter(re.findall("[a-z0-9]+", (t or "").lower()))
    best = {}
    for page, target, value, text in targets:
        for p, k, para, x1, y1, x2, y2 in paragraphs:
            if None in (page, value, para, x2) or p != page or x2 - x1 < 100 or y2 - y1 < 5 or value.lower() not in para.lower():
                continue
            a, b = words(text), words(para)
            common = sum((a & b).values())
            n_a, n_b = sum(a.values()), sum(b.values())
            f1 = 2 * (common / n_b) * (common / n_a) / (common / n_b + common / n_a) if common else 0.0
            rank = f1, x2 - x1, -y1, k is not None, -(k or 0)
            if (page, target) not in best or rank > best[page, target][0]:
                best[page, target] = rank, (page, target, k, x1, y1, x2, y2, f1)
    return Counter(r for _, r in best.values())


# With a limit of three paragraphs nearly every page is long; those of more than a block are cut.
@pytest.mark.parametrize(("pages", "most", "limit"), [(12, 14, 1000), (12, 14, 3), (1, 30, 3)])
def test_find_by_value_equals_brute_force(spark, monkeypatch, pages, most, limit):
    monkeypatch.setattr("boxtrail.operators.page_values.BLOCK", 4)
    paragraphs, targets = rows_of(pages + limit, pages, most)
    got = G.find_by_value(spark.createDataFrame(targets, TARGET), spark.createDataFrame(paragraphs, PARAGRAPH), direct_limit=limit)
    assert got.columns == ["page_id", "target_id", "para_ord", "x1", "y1", "x2", "y2", "f1"]
    want = by_brute_force(paragraphs, targets)
    assert want and Counter(map(tuple, got.collect())) == want


def test_find_by_value_moves_texts_once(spark):
    """No words and no pairs of a value and a paragraph are shuffled or sorted, on long pages either."""
    paragraphs, targets = rows_of(1, 5, 9)
    for limit in ({}, {"direct_limit": 0}):
        found = G.find_by_value(spark.createDataFrame(targets, TARGET), spark.createDataFrame(paragraphs, PARAGRAPH), **limit)
        moved = [m for m in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in m]
        logical = found._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in logical and "contains(" not in logical.lower()
        assert len(moved) == (2 if limit else 1), moved  # the best of each block meet once more


def test_no_rows(spark):
    paragraphs, targets = rows_of(2, 2, 5)
    none, some = spark.createDataFrame([], PARAGRAPH), spark.createDataFrame(targets, TARGET)
    assert G.find_by_value(some, none).count() == 0
    assert G.find_by_value(spark.createDataFrame([], TARGET), spark.createDataFrame(paragraphs, PARAGRAPH)).count() == 0


def test_index_of_a_long_page_misses_nothing():
    pick = random.Random(3)
    texts = ["".join(pick.choice("abcü ") for _ in range(pick.randrange(0, 30))) for _ in range(SCAN_LIMIT + 50)]
    page = Page(texts)
    for n in (0, 1, 2, 3, 4, 6, 9):
        for _ in range(40):
            value = "".join(pick.choice("abcü d") for _ in range(n))
            longer, shorter = page.sides(value, 3)
            lengths = [p[0] for p in shorter[::-1] + longer]
            assert lengths == sorted(lengths) and all(p[0] >= 3 for p in longer) and all(p[0] < 3 for p in shorter)
            holding = [rank for rank, t in enumerate(texts) if value in t]
            assert holding == sorted(p[3] for p in longer + shorter if value in p[1])
            assert page.best(value, "") == ((0.0, holding[0]) if holding else None)
