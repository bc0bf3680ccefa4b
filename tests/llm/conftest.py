import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew strong coffee near the old harbour wall "


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of the smallest size, as (doc_id, text) and as rows."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return df, {r.doc_id: r.text for r in df.collect()}


AWKWARD = [
    (1, PROSE * 3),
    (1, PROSE * 3),  # a repeated row
    (2, PROSE * 3),  # a copy
    (3, PROSE * 3 + "with a new ending"),
    (4, None),
    (5, ""),
    (6, "  \n\t "),
    (7, "%%% 123 ###"),
    (None, PROSE + "a row without an id"),
    (8, "same id, first text " + PROSE),
    (8, "same id, second text, é😀 " + PROSE),
    (9, "password = hunter2hunter2 mail a.b@c.example.org, +1 (017) 555-7713 and 4111111111111111"),
    (10, "word " * 30_000),  # very long
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    clash = "tag doc cid spans start length size slot words seeds score kept rank bucket label n row hits".split()
    return rows.select("doc_id", "text", F.lit("en").alias("lang"), *(F.lit("x").alias(c) for c in clash)).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("doc_id > 1000")


@pytest.fixture(scope="session")
def write(tmp_path_factory):
    """Folder with the given tables, as a query reads them."""

    def put(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return put
