"""Small tables that every operator must bear."""
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for their own columns
    T.StructField("keep", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("node", T.LongType()), T.StructField("h", T.LongType()),
])
LONG = "the quick brown fox and the lazy dog went over the hill. " * 4000


def rows(texts, start=0, lang="en"):
    return [(start + i, t, lang, "s", len(t) if t is not None else None, "x", 1, 2, 3, 4) for i, t in enumerate(texts)]


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    data = rows(["the quick brown fox", "", None, LONG, "the quick brown fox", " \n\t ", "ünïcödé ß 日本 \U0001F600", "###"])
    data += [data[0], data[3], (None, "the quick brown fox", None, None, None, None, None, None, None, None), (None,) * 10]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, texts, **k):
    return spark.createDataFrame(rows(texts, **k), SCHEMA)


NAMES = ["_gone", "_again", "_row", "_folded_text", "folded", "id", "row", "rows", "duplicate", "group_id", "sig", "sketch", "bucket", "part", "place", "span", "n_tokens", "component", "a.b", "x y", "P"]


def clashing(spark):
    """Documents whose other columns have names that the operators use, or awkward ones."""
    texts = ["the quick brown fox went over the hill and came home late", "another text about houses and water and the light of day"] * 2
    schema = T.StructType([*SCHEMA.fields, *(T.StructField(n, T.LongType()) for n in NAMES)])
    return spark.createDataFrame([r + tuple(100 * i + k for k in range(len(NAMES))) for i, r in enumerate(rows(texts))], schema)


def same_rows(some, table, keys=None):
    """Every row of some is a row of table, all values unchanged; keys: which doc_ids there are."""
    there = {r["doc_id"]: tuple(r) for r in table.collect()}
    found = some.collect()
    assert all(tuple(r) == there[r["doc_id"]] for r in found)
    assert keys is None or sorted(r["doc_id"] for r in found) == keys
