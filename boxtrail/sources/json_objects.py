"""Objects of large JSON files, one file read by many tasks.

A file is read as text rows that end at every closing brace, so it splits like any text file. A row knows neither whether
it begins inside a string nor how deep; both follow from the rows before it. Every split is measured for both cases of
its first character, one small row per split carries the state from split to split, and each text row then finds its own
state. A brace inside a string never ends an object, and no backslash can stand before a brace that ends a row, because
``\\}`` is no JSON escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# What may stand between two objects: commas, the opening bracket, scalars.
BETWEEN = r'^(?:[\s,\[\x{FEFF}]++|[-+.\w]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+(?=\{)'
SPLIT = ["path", "start"]


def _opened(plain: Column, in_text: bool) -> Column:
    """Brackets opened less those closed before the row's last brace; texts are left out, escapes are gone already."""
    bare = F.regexp_replace(F.concat(F.lit('"'), plain) if in_text else plain, r'"[^"]*(?:"|\z)', "")
    return F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"\]"))


def _sum_before(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """Text rows with their number of quotes and depth change, for a split that begins outside (``out``) or inside (``in``) a string."""
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"), "value",
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    measured = text.select(
        "*", (F.regexp_count(plain, F.lit('"')) % 2).alias("odd"), _opened(plain, False).alias("d0"), _opened(plain, True).alias("d1")
    ).withColumns({"d0": F.col("d0") - (F.col("odd") == 0).cast("int"), "d1": F.col("d1") - (F.col("odd") == 1).cast("int")})
    order = W.partitionBy(*SPLIT).orderBy("n")
    turned = measured.withColumn("turned", _sum_before(F.col("odd"), order) % 2)
    same, other = (F.when(F.col("turned") == t, F.col("d0")).otherwise(F.col("d1")) for t in (0, 1))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return turned.withColumns({"out": same, "in": other}).withColumns({"run_out": F.sum("out").over(upto), "run_in": F.sum("in").over(upto)})


def split_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, value): the text of every outermost object of JSON arrays, or of files that hold one object after another.

    ``ord`` counts from 0 in the order of the file. Values between the objects are skipped; an empty file or array gives no
    row. Of a file that is cut off, the object that lacks its end is left out, unless only its last brace is missing. After
    an unbalanced quote or bracket the rest of the file cannot be told apart and comes as one text or not at all.

    No task holds more than one split or one object. The texts are shuffled twice, by split and by object; what is carried
    from split to split is one row for each.
    """
    rows = _rows(spark, path)
    listed = F.when(F.col("start") == 0, F.col("value").rlike(r"^[\s\x{FEFF}]*\[").cast("int"))
    totals = rows.groupBy(*SPLIT).agg(
        F.sum("odd").alias("odd"), F.sum("out").alias("out"), F.sum("in").alias("in"), F.min_by(listed, "n").alias("base")
    )
    in_file = W.partitionBy("path")
    by_start = in_file.orderBy("start")
    states = (
        totals.withColumns({"in_text": _sum_before(F.col("odd"), by_start) % 2, "base": F.coalesce(F.max("base").over(in_file), F.lit(0))})
        .withColumn("depth", _sum_before(F.when(F.col("in_text") == 0, F.col("out")).otherwise(F.col("in")), by_start))
        .select(*SPLIT, "in_text", "base", "depth")
    )
    reached = F.col("depth") + F.when(F.col("in_text") == 0, F.col("run_out")).otherwise(F.col("run_in"))
    closed = (F.col("in_text") + F.col("turned") + F.col("odd")) % 2 == 0
    ended = rows.join(states, SPLIT).select(*SPLIT, "n", "value", (closed & (reached == F.col("base"))).cast("int").alias("ends"))
    numbers = ended.groupBy(*SPLIT).agg(F.sum("ends").alias("ends")).select(*SPLIT, _sum_before(F.col("ends"), by_start).alias("before"))
    place = F.col("before") + _sum_before(F.col("ends"), W.partitionBy(*SPLIT).orderBy("n"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("start", "n", "value"))), lambda p: p["value"])
    objects = (
        ended.join(numbers, SPLIT).withColumn("ord", place)
        .groupBy("path", "ord").agg(F.concat(F.array_join(pieces, "}"), F.lit("}")).alias("value"), F.max("ends").alias("whole"))
    )
    return objects.where("whole = 1").select("path", "ord", F.regexp_replace("value", BETWEEN, "").alias("value"))
