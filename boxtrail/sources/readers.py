"""JSON, JSONL and image-folder sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as Ty

from boxtrail import schemas as S
from boxtrail.sources import headers
from boxtrail.functions.geometry import MIN_SCREENSHOT_SIDE
from boxtrail.sources.json_objects import split_objects

# ---- Fixed values -----------------------------------------------------------
LAYOUT_SUFFIX, BOXES_SUFFIX = "_layout.json", "_bboxes.json"
IMAGE_NAME = r"(?i)\.(png|jpe?g|webp)$"
# -----------------------------------------------------------------------------


def _ddl(text: str) -> Ty.StructType:
    return Ty.StructType.fromDDL(text)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Samples from JSON-array files or files with one object after another, one file read by many tasks.

    Nested values declared as strings keep their value, not its spacing or escapes. Objects that do not fit the schema
    have null fields (``json_objects.split_objects`` for broken files).
    """
    objects = split_objects(spark, path)
    return objects.select(F.from_json("value", _ddl(schema)).alias("r")).select("r.*")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Raw multi-hop questions; pairs and triples become named structs.

    The mixed-type JSON lists are read as text and then parsed with an exact
    schema, so nothing is inferred. Supporting facts may be a list of pairs or
    an object with ``title`` and ``sent_id`` lists.
    """
    raw = read_json_array(
        spark, path,
        "sample_id long, question string, answer string, type string, supporting_facts string, context string, evidences string",
    )
    pairs = F.from_json("supporting_facts", "array<array<string>>")
    listed = F.transform(
        F.filter(pairs, lambda p: F.size(p) == 2),
        lambda p: F.struct(F.get(p, 0).alias("title"), F.get(p, 1).try_cast("int").alias("sid")),
    )
    obj = F.from_json("supporting_facts", "struct<title:array<string>,sent_id:array<int>>")
    zipped = F.zip_with(obj["title"], obj["sent_id"], lambda t, s: F.struct(t.alias("title"), s.alias("sid")))
    entries = F.from_json("context", "array<array<string>>")
    context = F.transform(
        F.filter(entries, lambda e: F.size(e) == 2),
        lambda e: F.struct(F.get(e, 0).alias("title"), F.from_json(F.get(e, 1), "array<string>").alias("sents")),
    )
    triples = F.transform(
        F.from_json("evidences", "array<array<string>>"),
        lambda t: F.when(
            F.size(t) == 3,
            F.struct(F.get(t, 0).alias("entity"), F.get(t, 1).alias("relation"), F.get(t, 2).alias("value")),
        ).otherwise(F.struct(*[F.lit(None).cast("string").alias(n) for n in ("entity", "relation", "value")])),
    )
    is_list = F.startswith(F.ltrim("supporting_facts"), F.lit("["))
    # Parsing runs once: the columns are split into their own projection.
    return raw.withColumns(
        {"supporting_facts": F.when(is_list, listed).otherwise(zipped), "context": context, "evidences": triples}
    )


def context_entries(questions: DataFrame) -> DataFrame:
    """(sample_id, ctx_pos, entity, sents) from the nested context."""
    return questions.select("sample_id", F.posexplode("context").alias("ctx_pos", "c")).select(
        "sample_id", "ctx_pos", F.col("c.title").alias("entity"), "c.sents"
    )


def _page_id(suffix: str) -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), suffix.replace(".", r"\.") + "$", "")


def read_layouts(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Page layout snapshots of a folder, one row per file; ``limit`` reads the first files only."""
    df = (
        spark.read.schema(_ddl(S.LAYOUT)).option("multiLine", True).option("pathGlobFilter", f"*{LAYOUT_SUFFIX}")
        .json(folder).withColumn("page_id", _page_id(LAYOUT_SUFFIX))
    )
    return df.orderBy("page_id").limit(limit) if limit else df


def read_paragraphs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Paragraph side files -> (paragraphs, page status).

    A corrupt file yields the status ``bad`` instead of failing the job; pages
    without a file are simply absent and read as ``missing`` after a left join.
    """
    texts = (
        spark.read.option("wholetext", True).option("pathGlobFilter", f"*{BOXES_SUFFIX}").text(folder)
        .select(_page_id(BOXES_SUFFIX).alias("page_id"), F.from_json("value", "array<struct<text:string,bbox:array<int>>>").alias("rows"))
    )
    box = lambda i: F.get("r.bbox", i)
    paragraphs = texts.select("page_id", F.posexplode("rows").alias("para_ord", "r")).where(F.size("r.bbox") == 4).select(
        "page_id", "para_ord", "r.text", box(0).alias("x1"), box(1).alias("y1"), box(2).alias("x2"), box(3).alias("y2")
    )
    status = texts.select("page_id", F.when(F.col("rows").isNull(), "bad").otherwise("ok").alias("side_table"))
    return paragraphs, status


def read_results(spark: SparkSession, folder: str, schema: str = S.RESULT, glob: str = "*.json*") -> DataFrame:
    """Scored rows from JSON lines; broken lines are skipped."""
    declared = _ddl(schema).add("_corrupt", Ty.StringType())
    rows = (
        spark.read.schema(declared).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", glob).json(folder)
    )
    source = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    # Order of appearance: by file, split and line within the split.
    tagged = rows.withColumn("line", F.struct(source.alias("src"), F.monotonically_increasing_id().alias("n")))
    return tagged.where(F.col("_corrupt").isNull() & F.col("idx").isNotNull()).drop("_corrupt")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size in bytes) of image files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return _relative(files, folder).where(F.col("path").rlike(IMAGE_NAME))


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height) of PNG, JPEG and WebP images; unreadable ones have null sizes, empty files no row.

    The listing is dealt over tasks, and a task reads the leading bytes of each file that its size stands in, never the
    whole file (``headers.size_of``).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    named = files.where(F.col("path").rlike(IMAGE_NAME))
    return _relative(named.mapInArrow(headers.sizes, "path string, width int, height int"), folder)


def _relative(files: DataFrame, folder: str) -> DataFrame:
    root = folder.rstrip("/") + "/"
    plain = F.regexp_replace("path", "^file:/+", "/")
    below = F.when(F.startswith(plain, F.lit(root)), F.substring(plain, F.lit(len(root) + 1), F.length(plain)))
    return files.withColumn("path", F.coalesce(below, "path"))


def screenshots_large_enough(images: DataFrame, side: int = MIN_SCREENSHOT_SIDE) -> DataFrame:
    """Images whose width and height reach ``side`` pixels."""
    return images.where((F.col("width") >= side) & (F.col("height") >= side))
