import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

CLASHES = ["score", "shard", "slot", "fp", "key", "node", "root", "rep", "cell", "u", "v", "kept", "_size", "_kept", "size", "held_out"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)
PROSE = "the quiet river carried small boats past the mill while children waved from the old stone bridge at noon"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
TEXTS = [
    (1, PROSE, "a"), (2, PROSE, "a"), (3, PROSE.upper(), "b"), (4, None, None), (5, "", "b"), (6, "   \t\n ", None), (7, LONG, "a"), (7, LONG, "a"),
    (8, "one", "c"), (9, "Released under the MIT Licence. All rights reserved.", "c"), (10, "you idiot, what a stup1d m0ron and scуm", "c"), (None, "no id here", "a"), (11, "naïve ▁ text 漢字 \U0001f600", "é"),
]


@pytest.fixture(scope="session")
def documents(spark):
    rows = [(i, t, "en", s, len(t or "")) + ("clash",) * len(CLASHES) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (5, 0, 0), (10, 0, 1), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    return lambda table: spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
