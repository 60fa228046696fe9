"""Documents with everything that may go wrong in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 977} of the {i}" for i in range(9000))
BASE = "the quick brown fox jumps over the lazy dog while the small cat looks at a very old grey house and then it is gone for good"


def rows() -> list[tuple]:
    texts: list[str | None] = [
        None, "", " ", "\n", "\n\n", "a", "A\tb  c", BASE, BASE, BASE.upper(), BASE + " today", BASE + " now", "  " + BASE, LONG, LONG + " end", "É à ü ß 中文 字 한국어 🙂🙂",
        "same line\nother\nsame line", "Same Line \nx", "\tsame line\ny\r\nz", "one two three", "one two", "one",
    ]
    out = [(i, t, "en", "web", len(t) if t is not None else None) for i, t in enumerate(texts)]
    out.append((7, BASE, "en", "web", len(BASE)))  # a repeated row
    out.append((None, BASE, None, None, None))
    out.append((None, None, None, None, None))
    out += [(100 + i, f"same line\nown text number {i} with several words of its own {i * i}", "en", "hot", None) for i in range(12)]
    return out


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def clashing(spark: SparkSession) -> DataFrame:
    """The same with columns whose names the operators use inside."""
    df = documents(spark)
    names = ["h", "fp", "k", "n", "t", "pos", "counts", "score", "s", "row", "rate", "copies", "span", "at", "full", "kept", "g", "wh", "pid", "halo", "gone", "ls", "value", "items", "x", "l", "p_good", "component_id", "toxic", "quality", "u", "v"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def bag(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(7, 1, 0), (8, 1, None), (9, None, 1), (10, 0, 1), (None, 1, 1), (13, 0, 0), (100, 1, 0), (101, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
