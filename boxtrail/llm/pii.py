"""Personal data by weak supervision.

Regular expressions propose spans. Four labelers vote on each: form (checks of the kind), gazetteer (known values),
context (words before it) and boundary (what touches it). Votes are counted by pattern over all candidates;
expectation-maximisation on these counts estimates each labeler's reliability without labels. The posteriors train a
naive Bayes classifier over hashed span features, which decides about candidates beyond the base kinds. Base spans
that pass their form check always stay.

All of it is DataFrame expressions. The driver sees the table of vote patterns (at most 81 per kind) only.

Null text: an empty document without spans. Repeated rows each get the spans of their text; equal doc_ids may have
different texts. An empty table gives an empty result. Other columns of the input are ignored. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxtrail.llm.common import text_key
from boxtrail.llm.spans import joined
from boxtrail.runtime import materialize

BASE = ("email", "ip", "card", "phone")
ADDED = ("ssn", "local_phone", "iban")
KINDS = (*BASE, *ADDED)
LABELERS = ("form", "gazetteer", "context", "boundary")
CONTEXT = 32
FEATURE_BUCKETS = 4096
ACCEPT = 0.9
KEYS = ["doc_id", "text_key"]

# Possessive forms of the base patterns: the same matches, found without backtracking or recursion. A run that holds no
# match is entered once, at its start or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.()-])(?<!\+[0-9]{1,3}[ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
}

# Gazetteers and cue words.
TOP_DOMAINS = "com|org|net|edu|gov|int|io|info|eu|de|fr|es|it|nl|uk|us|ca|ch|at|be|pl|se|jp|cn|in|br|au"
CALLING_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|60|61|62|63|64|65|66|81|82|84|86|90|91|92"
CARD_ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
IBAN_COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
RESERVED_NETS = r"(0|10|127|22[4-9]|2[3-5][0-9]|192\.168|169\.254|172\.(1[6-9]|2[0-9]|3[01]))\."
CUES = {
    "email": "mail|contact|write|kontakt|courriel|correo",
    "ip": "ip|host|server|address|adresse|login|peer",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "ssn": "ssn|social security|insured",
    "local_phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|konto|compte|cuenta|bank",
}
ANTI_CUES = r"version|release|build|isbn|order|invoice|ticket|sku|serial|\bv$|[#$€£]$"


def _neighbours(text: Column, kind: str, where: Column) -> Column:
    """Matches of a kind with what stands before and after each."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    after = F.transform(between, lambda g: F.left(g, F.lit(1)))
    rows = F.arrays_zip(found, F.transform(between, lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("tail"))), F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0))))
    rows = F.transform(
        F.filter(rows, lambda m: m["0"].isNotNull()),
        lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), m["1"]["n"].alias("gap"), m["0"].alias("hit"), m["1"]["tail"].alias("before"), m["2"].alias("after")),
    )
    return F.when(where, rows).otherwise(F.array().cast("array<struct<kind:string,ord:int,gap:int,hit:string,before:string,after:string>>"))


def _candidates(text: Column) -> Column:
    digits = F.rlike(text, F.lit("[0-9]"))
    where = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]"))}
    where["card"] = F.rlike(text, F.lit(PATTERNS["card"]))
    return F.concat(*(_neighbours(text, k, digits & where.get(k, F.rlike(text, F.lit(PATTERNS[k]))) if k != "email" else where[k]) for k in KINDS))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, hits: every row with the candidates of its whole text; the text is read once."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text_key().alias("text_key"), _candidates(text).alias("hits"))


def _luhn(hit: Column) -> Column:
    digits = F.reverse(F.filter(F.split(F.regexp_replace(hit, "[^0-9]", ""), ""), lambda c: c != ""))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(digits, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _by_kind(rules: dict[str, Column], default: Column) -> Column:
    return F.coalesce(*(F.when(F.col("kind") == k, rule) for k, rule in rules.items()), default)


def form_ok() -> Column:
    """The checks that a kind asks for beyond its pattern."""
    hit = F.col("hit")
    n = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    part = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return _by_kind(
        {
            "ip": F.rlike(hit, F.lit(rf"^{part}\.{part}\.{part}\.{part}$")),
            "card": n.between(16, 19) & _luhn(hit),
            "phone": n.between(8, 15),
            "ssn": ~F.rlike(hit, F.lit("^(000|666|9..)|-00-|-0000$")),
        },
        F.lit(True),
    )


def votes() -> list[Column]:
    """One column per labeler: 1 personal data, -1 not, 0 abstains."""
    hit, before = F.col("hit"), F.lower("before")
    vote = lambda yes, no=None: F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)
    known = _by_kind(
        {
            "email": vote(F.rlike(hit, F.lit(rf"(?i)\.({TOP_DOMAINS})$"))),
            "ip": vote(~F.rlike(hit, F.lit(f"^{RESERVED_NETS}"))),
            "card": vote(F.rlike(hit, F.lit(f"^({CARD_ISSUERS})")), F.lit(True)),
            "phone": vote(F.rlike(hit, F.lit(rf"^\+({CALLING_CODES})"))),
            "iban": vote(F.rlike(hit, F.lit(f"^({IBAN_COUNTRIES})")), F.lit(True)),
        },
        F.lit(0),
    )
    cue = _by_kind({k: F.rlike(before, F.lit(rf"(^|[^\p{{L}}])({c})([^\p{{L}}]|$)")) for k, c in CUES.items()}, F.lit(False))
    touched = F.rlike(F.concat(F.right("before", F.lit(1)), F.lit(" "), F.coalesce("after", F.lit(""))), F.lit(r"[\p{L}\p{N}_]"))
    return [
        vote(form_ok(), F.lit(True)).alias("form"),
        known.alias("gazetteer"),
        vote(cue, F.rlike(before, F.lit(ANTI_CUES))).alias("context"),
        vote(~touched, touched).alias("boundary"),
    ]


def located_candidates(rows: DataFrame) -> DataFrame:
    """One row per candidate span of a distinct text, with its position and votes."""
    one = rows.where(F.size("hits") > 0).dropDuplicates(KEYS).select(*KEYS, F.inline("hits"))
    end = F.sum(F.col("gap") + F.length("hit")).over(W.partitionBy(*KEYS, "kind").orderBy("ord"))
    return one.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("hit")).select(*KEYS, "kind", "ord", "start", "end", "hit", "before", *votes())


def expectation_maximisation(patterns: list[tuple], rounds: int = 30) -> dict[tuple, float]:
    """Posterior of each (kind, vote, ...) pattern given its count.

    Labelers are independent given the truth, with one table of P(vote | truth) each; every kind has its own prior.
    Starts from the share of positive votes; counts are smoothed by one.
    """
    post = {p[:-1]: min(0.95, max(0.05, 0.5 + 0.2 * sum(p[1:-1]))) for p in patterns}
    for _ in range(rounds):
        prior: dict = {}
        table = [{(y, v): 1.0 for y in (0, 1) for v in (-1, 0, 1)} for _ in LABELERS]
        for *key, n in patterns:
            q = post[tuple(key)]
            a, b = prior.get(key[0], (1.0, 1.0))
            prior[key[0]] = (a + n * q, b + n * (1 - q))
            for t, v in zip(table, key[1:]):
                t[1, v] += n * q
                t[0, v] += n * (1 - q)
        total = [{y: sum(t[y, v] for v in (-1, 0, 1)) for y in (0, 1)} for t in table]
        for key in post:
            yes, no = prior[key[0]]
            odds = math.log(yes / no) + sum(math.log(t[1, v] / s[1]) - math.log(t[0, v] / s[0]) for t, s, v in zip(table, total, key[1:]))
            post[key] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return post


def _posterior(rows: DataFrame) -> Column:
    patterns = [(r["kind"], *(r[x] for x in LABELERS), r["n"]) for r in rows.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()]
    name = F.concat_ws("|", "kind", *(F.col(x).cast("string") for x in LABELERS))
    post = sorted(expectation_maximisation(sorted(patterns)).items())
    known = F.create_map(*(F.lit(x) for key, p in post for x in ("|".join(map(str, key)), p))) if post else F.create_map(F.lit(""), F.lit(0.5))
    return F.coalesce(F.element_at(known, name), F.lit(0.5))


def classified(rows: DataFrame, buckets: int = FEATURE_BUCKETS) -> DataFrame:
    """Candidates with ``p``, the probability of the span classifier.

    Features: the kind with each vote, the last word before the span and the span's shape, hashed into ``buckets``;
    the table of their weights has that many rows at most and is broadcast.
    """
    word = F.regexp_extract(F.lower("before"), r"(\p{L}+)[^\p{L}]*$", 1)
    shape = F.regexp_replace(F.regexp_replace("hit", "[0-9]", "9"), r"\p{L}+", "a")
    parts = [F.lit("kind"), *(F.concat(F.lit(x), F.col(x).cast("string")) for x in LABELERS), F.concat(F.lit("word"), word), F.concat(F.lit("shape"), shape)]
    features = F.array_distinct(F.array(*(F.pmod(F.xxhash64("kind", p), F.lit(buckets)).cast("int") for p in parts)))
    soft = rows.select(*KEYS, "kind", "ord", _posterior(rows).alias("q"), F.explode(features).alias("feature"))
    sums = soft.groupBy("feature").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
    all_rows = sums.agg(F.max("yes").alias("y"), F.max("no").alias("n")).first()
    y, n = max(all_rows["y"] or 0.0, 1e-9) + 1, max(all_rows["n"] or 0.0, 1e-9) + 1
    weights = sums.select("feature", (F.log((F.col("yes") + 1) / (y + 1)) - F.log((F.col("no") + 1) / (n + 1))).alias("weight"))
    odds = soft.join(F.broadcast(weights), "feature").groupBy(*KEYS, "kind", "ord").agg(F.sum("weight").alias("odds"))
    p = 1 / (1 + F.exp(-(F.col("odds") + F.lit(math.log(y / n)))))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*KEYS, "kind", "ord")]
    return rows.alias("r").join(odds.select(*KEYS, "kind", "ord", p.alias("p")).alias("o"), same).select("r.*", "p")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (rank, start, end, kind, base, p) per input row, ordered by kind as listed, then start."""
    rows = materialize(scanned(docs), "pii_scanned")
    spans = classified(materialize(located_candidates(rows), "pii_candidates"))
    base = F.col("kind").isin(*BASE)
    kept = spans.where(F.when(base, F.col("form") == 1).otherwise((F.col("form") == 1) & (F.col("p") >= ACCEPT)))
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)))
    listed = kept.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", base.alias("base"), "p"))).alias("spans"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in KEYS]
    none = F.array().cast(listed.schema["spans"].dataType)
    return rows.select(*KEYS).alias("d").join(listed.alias("s"), same, "left").select("d.doc_id", F.coalesce("spans", none).alias("spans"))


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
