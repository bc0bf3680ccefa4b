"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k"
WORD = re.compile(r"[^\W_]+")
END_OF_TEXT = "<|endoftext|>"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ("doc_id", "text"))


def text_key(text: str | Column = "text") -> Column:
    """128 bits of the text's content; tells apart rows that share a doc_id."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def slices(texts: list, max_chars: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``max_chars`` characters; a longer text is a run of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > max_chars:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def vocabulary(name: str = TOKENIZER) -> str:
    """Place of a vocabulary file, on the machine where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict = {}


def encoder(vocab: str | None = None):
    """Function from a text to its token ids, by the byte-level BPE of ``vocab``.

    The ids are those of the `tokenizers` library for ``<vocab>.json`` without special tokens added. Texts that spell
    out the end-of-text token go through that library itself; all others take the rank file of the same vocabulary,
    which gives equal ids several times faster.
    """
    stem = vocab or TOKENIZER
    if stem not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        place = (lambda end: f"{stem}{end}") if "/" in stem else (lambda end: public_tokenizers.path(f"{stem}{end}"))
        with open(place(".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow: list = []

        def encode(text: str) -> list[int]:
            if END_OF_TEXT not in text:
                return fast.encode_ordinary(text)
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(place(".json")))
            return slow[0].encode(text, add_special_tokens=False).ids

        _encoders[stem] = encode
    return _encoders[stem]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and each text's number of words."""
    import xxhash

    words, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = WORD.findall(text.lower()) if text else ()
        sizes[i] = len(found)
        words.extend(found)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), sizes
