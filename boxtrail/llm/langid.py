"""Language identification by interpolated Kneser-Ney character models.

One model per language, all trained on the same bounded sample of labelled rows (``per_lang`` documents of each
language, chosen by a hash). The n-grams of all languages share one sorted hash array per order; beside it stand the log
probabilities of each language, interpolated down to single letters, and for contexts the weights of the lower order.
A text takes the language of the lowest cross-entropy per character. Part of the sample is set aside to calibrate: the
temperature of the score, and for each language the cross-entropy beyond which a text is rejected.

A text is read whole: letters in lower case, everything else a single space. Null texts and texts without a letter are
``und`` with score 0. Rows without a language are never trained on. Equal scores go to the first language by name.
Repeated rows get equal results. An empty table, or one without labelled rows, gives ``und`` throughout. Only the text
is an input of a prediction; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxtrail.llm.common import columns_of, mix, slices

ORDER = 4
PER_LANG = 1000
CALIBRATION_PART = 5  # one document of so many in the sample is set aside
FOLDS = 5
UNKNOWN = "und"
CHUNK = 1 << 19
CALIBRATED_CHARS = 200  # a score is as sure as that many characters can make it
REJECT_QUANTILE = 0.999
REJECT_SLACK = 0.5  # bits a character beyond that quantile
SHORT_SLACK = 40.0  # further bits, spread over the characters of the text

_table: list = []


def letters_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _table:
        lower = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                lower[c] = ord(low) if len(low) == 1 else c
        _table.append(lower)
    return _table[0]


def cleaned(texts: list, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of all texts in a row, and each text's length.

    Each text starts with ``order - 1`` spaces, which are context only and not part of its length.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    c = letters_table()[raw]
    space = c == 32
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))[sizes > 0]
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[first] = ~space[first]
    owner = np.repeat(np.arange(len(texts)), sizes)[keep]
    kept = np.bincount(owner, minlength=len(texts))
    out = np.full(len(owner) + (order - 1) * len(texts), 32, np.uint32)
    out[np.arange(len(owner)) + (order - 1) * (owner + 1)] = c[keep]
    return out, kept


def scored_places(kept: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Where the characters of all texts stand in ``cleaned``'s array."""
    owner = np.repeat(np.arange(len(kept)), kept)
    return np.arange(len(owner)) + (order - 1) * (owner + 1)


def gram_hash(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place."""
    h = np.full(len(at), n, np.uint64)
    for k in range(n - 1, -1, -1):
        h = h * np.uint64(0x100000001B3) + chars[at - k]
    return mix(h)


class Sorted:
    """Sorted array of hashes with a directory of their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(1, int(len(hashes) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.padded = np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is absent."""
        at = self.start[h >> self.shift]
        there = self.padded[at]
        todo = np.flatnonzero(there < h)
        while len(todo):
            at[todo] += 1
            there[todo] = self.padded[at[todo]]
            todo = todo[there[todo] < h[todo]]
        return np.where((there == h) & (at < len(self.hashes)), at, -1)


@dataclass
class Model:
    langs: list[str]
    grams: list  # by order from 1: Sorted
    logp: list  # by order: float32 [n-gram, language]
    contexts: list  # by length from 0: Sorted (None for length 0)
    back: list  # by length: float32 [context, language], log weight of the lower order
    floor: np.ndarray  # log probability of a letter that no language has
    temperature: float = 1.0
    limits: np.ndarray | None = None  # bits a character, by language

    @property
    def order(self) -> int:
        return len(self.grams)

    def log_probabilities(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log of each character's probability in each language."""
        out = np.empty((len(at), len(self.langs)), np.float32)
        todo, extra = np.arange(len(at)), None
        for n in range(self.order, 0, -1):
            found = self.grams[n - 1].find(gram_hash(chars, at[todo], n))
            hit = found >= 0
            rows = self.logp[n - 1][found[hit]]
            out[todo[hit]] = rows if extra is None else rows + extra[hit]
            todo = todo[~hit]
            extra = np.zeros((len(todo), len(self.langs)), np.float32) if extra is None else extra[~hit]
            if not len(todo):
                return out
            if n > 1:
                context = self.contexts[n - 1].find(gram_hash(chars, at[todo] - 1, n - 1))
                known = context >= 0
                extra[known] += self.back[n - 1][context[known]]
        out[todo] = extra + self.floor
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of each text in each language, and the number of characters."""
        chars, kept = cleaned(texts, self.order)
        at, owner = scored_places(kept, self.order), np.repeat(np.arange(len(texts)), kept)
        sums = np.zeros((len(texts), len(self.langs)))
        for lo in range(0, len(at), CHUNK):  # a very long text is scored in parts
            logs, who = self.log_probabilities(chars, at[lo : lo + CHUNK]), owner[lo : lo + CHUNK]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            sums[who[first]] += np.add.reduceat(logs, first, axis=0, dtype=np.float64)
        return -sums / np.maximum(kept, 1)[:, None] / np.log(2), kept

    def predict(self, texts: list) -> list[tuple[str, float, bool, float]]:
        """(language, score, rejected, bits a character) of each text."""
        out: list = [(UNKNOWN, 0.0, True, 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and self.langs]
        for lo, hi in slices([texts[i] for i in some], CHUNK):
            bits, n = self.cross_entropies([texts[i] for i in some[lo:hi]])
            best = bits.argmin(axis=1)
            gap = (bits.min(axis=1)[:, None] - bits) * np.minimum(n, CALIBRATED_CHARS)[:, None] * np.log(2) / self.temperature
            score = 1 / np.exp(gap).sum(axis=1)
            low = bits.min(axis=1)
            far = low > self.limits[best] + SHORT_SLACK / np.maximum(n, 1)
            for j, i in enumerate(some[lo:hi]):
                if n[j]:
                    out[i] = (self.langs[best[j]], float(score[j]), bool(far[j]), float(low[j]))
        return out


def sample(docs: DataFrame, per_lang: int = PER_LANG, folds: int = FOLDS) -> DataFrame:
    """lang, text, calibrate: at most ``per_lang`` labelled documents of each language outside of the held-out fold.

    A hash threshold from the languages' counts keeps about 1.2 times as many; only those are ranked.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != 0))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return labelled.select("lang", "text", F.lit(False).alias("calibrate"))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.2 * per_lang + 50) / n))))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = labelled.withColumn("draw", draw).where(F.col("draw") < F.element_at(share, F.col("lang")))
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id")))
    return ranked.where(F.col("rank") <= per_lang).select("lang", "text", (F.col("rank") % CALIBRATION_PART == 0).alias("calibrate"))


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, c1..cN, n: n-grams of the highest order, counted per task and then summed."""

    def count(batches):
        for b in batches:
            langs, texts = columns_of(b, "lang", "text")
            out = []
            for lang in sorted(set(langs)):
                own = [t for x, t in zip(langs, texts) if x == lang]
                for lo, hi in slices(own, CHUNK):
                    chars, kept = cleaned(own[lo:hi], order)
                    at = scored_places(kept, order)
                    grams, n = np.unique(np.stack([chars[at - k] for k in range(order - 1, -1, -1)], axis=1), axis=0, return_counts=True)
                    out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *(pa.array(grams[:, k].astype(np.int32)) for k in range(order)), pa.array(n)], names=["lang", *(f"c{k + 1}" for k in range(order)), "n"]))
            yield from out

    names = [f"c{k + 1}" for k in range(order)]
    return rows.select("lang", "text").mapInArrow(count, f"lang string, {', '.join(c + ' int' for c in names)}, n long").groupBy("lang", *names).agg(F.sum("n").alias("n"))


def _discount(counts: np.ndarray) -> float:
    ones, twos = (counts == 1).sum(), (counts == 2).sum()
    return float(ones / (ones + 2 * twos)) if ones and twos else 0.5


def _union(tables: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(tables), axis=0)


def _hashes(grams: np.ndarray) -> np.ndarray:
    n = grams.shape[1]
    flat = grams.astype(np.uint32).reshape(-1)
    return gram_hash(flat, np.arange(len(grams)) * n + n - 1, n)


def train(langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models from each language's n-grams of the highest order and their counts.

    Lower orders count in how many contexts an n-gram occurs. All orders use absolute discounting and interpolate.
    """
    order = tables[0][0].shape[1]
    by_order: list[list] = [[] for _ in range(order)]
    for grams, counts in tables:
        for n in range(order, 0, -1):
            by_order[n - 1].append((grams, counts))
            if n > 1:
                grams, counts = np.unique(grams[:, 1:], axis=0, return_counts=True)
    model = Model(list(langs), [], [], [None], [None], np.zeros(0))
    lower: np.ndarray | None = None
    letters = len(_union([g for g, _ in by_order[0]])) + 1
    for n in range(1, order + 1):
        union = _union([g for g, _ in by_order[n - 1]])
        keys = _hashes(union)
        rank = np.argsort(keys)
        union, index = union[rank], Sorted(keys[rank])
        p = np.zeros((len(union), len(langs)))
        if n == 1:
            model.floor = np.zeros(len(langs), np.float32)
        else:
            heads = _union([g[:, :-1] for g, _ in by_order[n - 1]])
            head_keys = _hashes(heads)
            head_rank = np.argsort(head_keys)
            contexts = Sorted(head_keys[head_rank])
            back = np.ones((len(heads), len(langs)))
            of = contexts.find(_hashes(union[:, :-1]))
            suffix = model.grams[n - 2].find(_hashes(union[:, 1:]))
        for k, (grams, counts) in enumerate(by_order[n - 1]):
            d, place = _discount(counts), index.find(_hashes(grams))
            if n == 1:
                total, kinds = counts.sum(), len(counts)
                p[:, k] = d * kinds / total / letters
                model.floor[k] = np.log(d * kinds / total / letters)
                p[place, k] += (counts - d) / total
                continue
            head = contexts.find(_hashes(grams[:, :-1]))
            total, kinds = np.bincount(head, counts, len(heads)), np.bincount(head, minlength=len(heads))
            seen = total > 0
            back[seen, k] = d * kinds[seen] / total[seen]
            p[:, k] = back[of, k] * lower[suffix, k]
            p[place, k] += (counts - d) / total[head]
        model.grams.append(index)
        model.logp.append(np.log(p).astype(np.float32))
        if n > 1:
            model.contexts.append(contexts)
            model.back.append(np.log(back).astype(np.float32))
        lower = p
    return model


def measured(model: Model, langs: list[str], texts: list[str]) -> list[tuple[int, int, list[float]]]:
    """(number of the language, length, bits by language) of each text that has any length."""
    out: list[tuple] = []
    for lo, hi in slices(texts, CHUNK):
        b, n = model.cross_entropies([t or "" for t in texts[lo:hi]])
        out += ((model.langs.index(lang), int(m), row.tolist()) for lang, m, row in zip(langs[lo:hi], n, b) if m > 0)
    return out


def calibrate(model: Model, rows: list[tuple[str, str]]) -> Model:
    """``fitted`` on (lang, text) rows at hand."""
    return fitted(model, measured(model, *map(list, zip(*rows))) if rows else [])


def fitted(model: Model, rows: list[tuple[int, int, list[float]]]) -> Model:
    """Sets temperature and rejection limits from measured texts that were not trained on.

    The temperature is fitted as if no text had more than ``CALIBRATED_CHARS`` characters: beyond, all are certain.
    """
    truth = [k for k, _, _ in rows]
    model.limits = np.full(len(model.langs), np.inf)
    if not truth:
        return model
    b, n, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), np.array(truth)
    own = b[np.arange(len(y)), y]
    for k in range(len(model.langs)):
        if (y == k).any():
            model.limits[k] = np.quantile(own[y == k], REJECT_QUANTILE) + REJECT_SLACK
    scale = np.minimum(n, CALIBRATED_CHARS)[:, None] * np.log(2)

    def loss(t: float) -> float:
        z = (own[:, None] - b) * scale / t
        return float(np.log(np.exp(np.minimum(z, 500)).sum(axis=1)).mean())

    model.temperature = min((1.0, 2.0, 4.0, 8.0, 16.0), key=loss)
    return model


def fit(docs: DataFrame, order: int = ORDER, per_lang: int = PER_LANG) -> Model:
    """The model of ``docs`` (doc_id, text, lang). What reaches the driver is bounded by the sample."""
    from boxtrail.runtime import materialize

    rows = materialize(sample(docs, per_lang), "langid_sample")
    counts = gram_counts(rows.where("not calibrate"), order).toPandas()
    langs = sorted(counts["lang"].unique())
    if not langs:
        return Model([], [], [], [], [], np.zeros(0), limits=np.zeros(0))
    names = [f"c{k + 1}" for k in range(order)]
    tables = []
    for lang in langs:
        own = counts[counts["lang"] == lang]
        tables.append((own[names].to_numpy(np.uint32), own["n"].to_numpy(np.int64)))
    model = train(langs, tables)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for b in batches:
            own, texts = columns_of(b, "lang", "text")
            known = [i for i, lang in enumerate(own) if lang in langs]
            cols = list(zip(*measured(shared.value, [own[i] for i in known], [texts[i] for i in known]))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64()))], names=["k", "n", "bits"])

    aside = rows.where("calibrate").select("lang", "text").mapInArrow(measure, "k int, n long, bits array<double>")
    return fitted(model, [(r["k"], r["n"], r["bits"]) for r in aside.toLocalIterator()])  # numbers of the sample's texts


def predict(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """carry columns, lang_pred, score, rejected, bits: one row per input row, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*carry, "text") if "text" not in carry else docs.select(*carry)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "lang_pred string", "score double", "rejected boolean", "bits double"])

    def classify(batches):
        for b in batches:
            (texts,) = columns_of(b, "text")
            found = list(zip(*shared.value.predict(texts))) or [(), (), (), ()]
            kinds = (pa.string(), pa.float64(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in carry), *(pa.array(v, t) for v, t in zip(found, kinds))], names=[*carry, "lang_pred", "score", "rejected", "bits"])

    return rows.mapInArrow(classify, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is not rejected, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for b in batches:
            (texts,) = columns_of(b, "text")
            yield b.filter(pa.array([not rejected for _, _, rejected, _ in shared.value.predict(texts)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four of five folds; a null doc_id is in no fold and not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, fit(docs), "doc_id")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected", "bits")
