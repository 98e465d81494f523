import pytest
from pyspark.sql import types as T

#: Columns of documents, and one whose name operators use themselves.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
])


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text[, lang[, source]]) rows."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None, "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture
def stored(tmp_path):
    """A folder with the frame as its documents table."""

    def write(df, name="documents"):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
