import pytest

#: Rows that every operator must bear: nulls in any column, empty and very long texts, repeated rows.
ODD = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, 0), (3, " \n\t ", "en", "s", 4), (4, "word " * 30_000, "en", "s", 150_000), (4, "word " * 30_000, "en", "s", 150_000), (5, "é𝒳漢 \u0000 x", "fr", "s", 7), (5, "another text of this id", "fr", "s", 23)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Also with columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("_id", "_text", "key", "node", "labels", "spans", "bucket", "shard", "quality"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
