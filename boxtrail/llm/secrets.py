"""Secret scans over an incremental blob ledger.

A text version is a blob, named by the SHA-256 of its content; the rows that carry it are its paths. The ledger lists
the (blob, rule version) pairs that were scanned and what they held. A scan reads only blobs without an entry for the
current rules, each once however many paths have it, and findings are joined back to all paths.

Null text: an empty blob. Repeated rows are paths of one blob. Equal doc_ids may have different texts. An empty table
gives an empty result. Other columns of the input are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxtrail.llm import spans
from boxtrail.runtime import materialize, new_shared_path

# The scanned forms.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # `AKIA[A-Z0-9]+` of 16 characters or more: runs are maximal, shorter ones hold no longer match
HEX = r"[0-9a-f]{32,}"  # `[0-9a-f]+` of 32 characters or more, for the same reason
HOST_TOKEN = r"gh[pousr]_[A-Za-z0-9]{36,}"
PRIVATE_KEY = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"

BASE = ("assign", "access", "hex")
ORDER = (*BASE, "host_token", "private_key")
#: Named by what is searched: an edited pattern is a new version, whose entries no blob has yet.
RULES_VERSION = zlib.crc32("\n".join((ASSIGN, str(ASSIGN_VALUE), ACCESS, HEX, HOST_TOKEN, PRIVATE_KEY, *ORDER)).encode()) & 0x7FFFFFFF
LEDGER = "blob string, rules int, spans array<struct<start:int,rank:int,end:int,kind:string>>"


def _hits(text: Column) -> Column:
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.arrays_zip(spans.matches(text, "assign", ASSIGN, F.lit(True)), value)
    assign = F.transform(assign, lambda m: F.struct(m["0"]["kind"].alias("kind"), m["0"]["ord"].alias("ord"), m["0"]["gap"].alias("gap"), m["0"]["hit"].alias("hit"), (F.length(m["1"]) >= ASSIGN_VALUE).alias("ok")))
    sure = lambda rows: F.transform(rows, lambda m: F.struct(m["kind"].alias("kind"), m["ord"].alias("ord"), m["gap"].alias("gap"), m["hit"].alias("hit"), F.lit(True).alias("ok")))
    none = F.array().cast("array<struct<kind:string,ord:int,gap:int,hit:string,ok:boolean>>")
    return F.concat(
        F.when(F.rlike(text, F.lit(ASSIGN)), assign).otherwise(none),
        sure(spans.matches(text, "access", ACCESS, F.contains(text, F.lit("AKIA")))),
        sure(spans.matches(text, "hex", HEX, F.rlike(text, F.lit(HEX)))),
        sure(spans.matches(text, "host_token", HOST_TOKEN, F.contains(text, F.lit("gh")) & F.rlike(text, F.lit(HOST_TOKEN)))),
        sure(spans.matches(text, "private_key", PRIVATE_KEY, F.contains(text, F.lit("PRIVATE KEY-----")))),
    )


def blob_of(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def blobs(docs: DataFrame) -> DataFrame:
    """blob, text: each content once. Copies are combined before the shuffle, so a hot text is one row per task."""
    return docs.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])


def unseen(contents: DataFrame, ledger: DataFrame | None, rules: int = RULES_VERSION) -> DataFrame:
    """Blobs without an entry for these rules."""
    if ledger is None:
        return contents
    return contents.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")


def scan(contents: DataFrame, rules: int = RULES_VERSION) -> DataFrame:
    """Ledger entries of the given blobs: every blob has one, with an ordered array of its spans, empty for none."""
    searched = contents.select("blob", _hits(F.col("text")).alias("hits"))
    one = searched.select("blob", F.explode_outer("hits").alias("m")).select("blob", "m.kind", "m.ord", "m.gap", "m.hit", "m.ok")
    size = F.length("hit")
    end = F.sum(F.col("gap") + size).over(W.partitionBy("blob", "kind").orderBy("ord")).cast("int")
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(ORDER)))
    found = one.withColumn("end", end).withColumn("span", F.when(F.col("ok"), F.struct((F.col("end") - size).alias("start"), rank.alias("rank"), F.col("end").alias("end"), F.col("kind").alias("kind"))))
    return found.groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("spans")).select("blob", F.lit(rules).alias("rules"), "spans")


def update_ledger(docs: DataFrame, path: str, rules: int = RULES_VERSION) -> DataFrame:
    """Scans what the ledger at ``path`` has not seen, appends it, and returns the whole ledger.

    The append is one job: a lost executor repeats tasks, a lost job leaves the ledger as it was. Entries are keyed by
    content, so a second run of the same scan adds nothing.
    """
    spark = docs.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
    except Exception as e:  # noqa: BLE001 - the first run has no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = None
    scan(unseen(blobs(docs), ledger, rules), rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def entries(ledger: DataFrame, rules: int = RULES_VERSION) -> DataFrame:
    """blob, spans under the rules, each blob once: scans that ran at the same time may both have listed it."""
    return ledger.where(F.col("rules") == rules).groupBy("blob").agg(F.first("spans").alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, rules: int = RULES_VERSION, *carry: str) -> DataFrame:
    """doc_id, blob, spans: one row per path. A blob with very many paths is split by the skew join."""
    paths = docs.select("doc_id", *carry, blob_of().alias("blob"))
    return paths.join(entries(ledger, rules), "blob", "left")


def redact(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans are replaced once, as one.

    Spans are in order of their start, so one fold keeps what lies between the furthest end so far and the next start.
    """
    state = F.aggregate(
        found,
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"])))).otherwise(acc["parts"]).alias("parts"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.array_join(F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), mask),
    )
    return F.when(F.size(found) > 0, state).otherwise(text)


def without_secrets(docs: DataFrame, ledger_path: str) -> DataFrame:
    """All rows, with every secret in the text masked; ``n_chars``, where there is such a column, follows the text."""
    ledger = update_ledger(docs.select("doc_id", "text"), ledger_path)
    # Of known size: a few findings go to the texts, many meet them by key.
    found = materialize(entries(ledger.where(F.size("spans") > 0)), "secret_findings")
    whole = docs.select(F.struct("*").alias("row"), blob_of().alias("key")).join(found, F.col("key") == F.col("blob"), "left")
    text = F.when(F.col("spans").isNotNull(), redact(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    masked = whole.select("row", "spans", text.alias("masked"))
    changed = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        size = F.length("masked").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("spans").isNotNull(), size).otherwise(F.col("row.n_chars"))
    return masked.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document, scanned once per distinct text against a fresh ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = findings(docs, update_ledger(docs, new_shared_path(spark, "secret_ledger")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"), "blob")
