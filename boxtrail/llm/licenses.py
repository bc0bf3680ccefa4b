"""License scans: exact set-similarity join of text blocks with license templates.

The words of a text form overlapping blocks of twice ``STRIDE`` words, so every span of up to ``STRIDE`` words lies in a
block. A block matches a notice when it holds at least ``threshold`` of the notice's distinct words (containment). Words
are ordered by the number of documents that hold them, rarest first. A block that reaches the threshold shares a word
with the notice's prefix (all but the ``need - 1`` most frequent of its words); that word leads from the block to the
notice, unless too few words can follow it on either side (length and positional filters). What is left is compared
exactly, so nothing that reaches the threshold is missed. Phrases take the same way with a threshold of 1 and must then
also stand in the block word by word; each place counts in the block whose first half it begins in.

Only words of templates are ordered and kept, as others cannot be shared; the vocabulary and the templates are given by
the caller on the driver and so are their broadcasts' bound. Counts cover all documents.

Null text: no words, no match. Rows with equal texts are matched once and each gets the result. A text of any length is
its blocks, matched one by one. Notices with equal containment all give their label. An empty table gives an empty
result; without templates nothing matches. Other columns of the input are ignored unless carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import columns_of, documents, text_key
from boxtrail.runtime import materialize

STRIDE = 128
THRESHOLD = 0.8
#: Upper case to lower case; every other ASCII character but digits and letters to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

# Phrases and labels of the base, standard notices of public licenses.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Template(NamedTuple):
    label: str
    phrase: bool
    words: list[bytes]
    need: int  # distinct words that a block must share


def templates_of(phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD) -> list[Template]:
    out = [Template(label, True, words, len(set(words))) for label, text in phrases if (words := words_of(text))]
    out += [Template(label, False, words, math.ceil(threshold * len(set(words)) - 1e-9)) for label, text in notices if (words := words_of(text))]
    if any(len(t.words) > STRIDE for t in out):
        raise ValueError(f"a template has more than {STRIDE} words")
    return out


def document_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """Documents that hold each word. Tasks send one count per word at most."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            for text in columns_of(batch, "text")[0]:
                for word in shared.value.intersection(words_of(text or "")):
                    found[word] = found.get(word, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}  # at most one row per word of the templates


def ranked_blocks(docs: DataFrame, ranks: dict[bytes, int], probes: set[int], *carry: str) -> DataFrame:
    """carry columns, text_id, n_words and the blocks that hold a probe word, one row per input row.

    A block is its first word's number and the ranks of its words in text order, -1 for words outside the templates.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, np.array(sorted(probes), np.int32)))
    block_type = pa.list_(pa.struct([("start", pa.int64()), ("seq", pa.list_(pa.int32()))]))
    extra = [(c, docs.schema[c].dataType.simpleString()) for c in carry]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in extra), "text_id string, n_words long, blocks array<struct<start:long,seq:array<int>>>"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, probe = shared.value
        for batch in batches:
            sizes, blocks = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                words = words_of(text or "")
                seq = np.fromiter((rank.get(w, -1) for w in words), np.int32, len(words))
                at = np.flatnonzero(np.isin(seq, probe)) // STRIDE
                own = np.unique(np.concatenate((at, at[at > 0] - 1)))
                sizes.append(len(words))
                blocks.append([(int(k) * STRIDE, seq[k * STRIDE : (k + 2) * STRIDE]) for k in own])
            out = [*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(sizes, pa.int64()), pa.array(blocks, block_type)]
            yield pa.RecordBatch.from_arrays(out, names=[*carry, "text_id", "n_words", "blocks"])

    own = [F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry)]
    return docs.select(*own, text_key("text").alias("_text_id"), F.col("text").alias("_text")).mapInArrow(cut, schema)


def template_index(spark, templates: list[Template], ranks: dict[bytes, int]) -> DataFrame:
    """One row per prefix word of each template: its rank, its place, and the template as ranks."""
    rows = []
    for label, phrase, words, need in templates:
        tokens = sorted({ranks[w] for w in words})
        prefix = tokens[: len(tokens) - need + 1]
        rows += [(token, place, label, phrase, need, tokens, prefix, [ranks[w] for w in words]) for place, token in enumerate(prefix)]
    return spark.createDataFrame(rows, "token int, place int, label string, phrase boolean, need int, tokens array<int>, prefix array<int>, words array<int>")


def containment_join(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """text_id, start, label, phrase, containment and places of every block and template that reach the threshold.

    ``blocks`` has text_id, start and seq. A pair is compared once, at the first prefix word that both share.
    """
    held = blocks.withColumn("ranks", F.array_sort(F.array_distinct(F.filter("seq", lambda x: x >= 0))))
    probes = held.select("text_id", "start", "seq", "ranks", F.posexplode("ranks").alias("pos", "token"))
    size = F.size("ranks")
    can_reach = (size >= F.col("need")) & (1 + F.least(F.size("tokens") - F.col("place"), size - F.col("pos")) - 1 >= F.col("need"))
    first = F.array_min(F.array_intersect("prefix", "ranks")) == F.col("token")
    pairs = probes.join(F.broadcast(index), "token").where(can_reach & first)
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("tokens", "ranks"))).where(F.col("overlap") >= F.col("need"))
    last = F.least(F.lit(STRIDE), F.size("seq") - F.size("words") + 1)
    starts = F.when(F.col("phrase") & (last > 0), F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    places = F.filter(starts, lambda i: F.slice("seq", i + 1, F.size("words")) == F.col("words"))
    matched = pairs.select("text_id", "start", "label", "phrase", (F.col("overlap") / F.size("tokens")).alias("containment"), F.transform(places, lambda i: i + F.col("start")).alias("places"))
    return matched.where(~F.col("phrase") | (F.size("places") > 0))


def scan_licenses(docs: DataFrame, *carry: str, phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """carry columns, n_words, places of phrases (n_base, first_word, last_word), their labels, all labels and score.

    The score is the highest containment of a matched template, 1 for a phrase, 0 without a match.
    """
    spark = docs.sparkSession
    templates = templates_of(phrases, notices, threshold)
    vocabulary = sorted({w for t in templates for w in t.words})
    counts = document_frequencies(docs, vocabulary) if vocabulary else {}
    ranks = {w: r for r, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index = template_index(spark, templates, ranks)
    probes = {ranks[w] for t in templates for w in t.words} & {r["token"] for r in index.select("token").collect()}
    rows = materialize(ranked_blocks(docs, ranks, probes, *carry), "license_blocks")
    texts = rows.where(F.size("blocks") > 0).groupBy("text_id").agg(F.first("blocks").alias("blocks"))
    matches = containment_join(texts.select("text_id", F.inline("blocks")), index)
    found = matches.groupBy("text_id").agg(
        F.sum(F.size("places")).cast("long").alias("n_base"),
        F.min(F.array_min("places")).alias("first_word"),
        F.max(F.array_max("places")).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("containment").alias("score"),
    )  # labels: bounded by the templates
    out = rows.drop("blocks").join(found, "text_id", "left")
    zero = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select(*carry, "n_words", *(F.coalesce(c, zero[c]).alias(c) if c in zero else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return scan_licenses(documents(spark, sf_dir), "doc_id")


def _sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    values = ",\n        ".join(f"('{t.label}', {str(t.phrase).lower()}, {quoted(t.words)}, {t.need})" for t in templates_of())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH templates(label, phrase, words, need) AS (
    VALUES {values}
), docs AS (
    SELECT row_number() OVER () AS id, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), starts AS (
    SELECT id, w, unnest(range(0, len(w), {STRIDE})) AS start FROM docs
), blocks AS (
    SELECT id, start, list_distinct(w[start + 1:start + {2 * STRIDE}]) AS held FROM starts
), notices AS (
    SELECT id, label, false AS phrase, max(len(list_intersect(held, words)) / len(list_distinct(words))) AS score, NULL AS place
    FROM blocks JOIN templates ON NOT phrase AND len(list_intersect(held, words)) >= need GROUP BY id, label
), words AS (
    SELECT id, w, unnest(range(0, len(w))) AS place FROM docs
), places AS (
    SELECT id, label, true AS phrase, 1.0 AS score, place FROM words JOIN templates ON phrase AND w[place + 1] = words[1] AND w[place + 1:place + len(words)] = words
), found AS (
    SELECT id, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
        coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase), '') AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score)::DOUBLE AS score
    FROM (SELECT * FROM notices UNION ALL SELECT * FROM places) GROUP BY id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN found USING (id)
"""


OP11_SQL = _sql()
