"""Documents that hold the awkward cases, for the tests of every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, spans string, score string, row int"
LONG = " ".join(f"word{n % 977} and{n % 13}" for n in range(60_000))
PROSE = "the old mill by the river was quiet until the miller came home with seven sacks of grain and a letter from the town"


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]], lang: str | None = "en") -> DataFrame:
    """Rows of (doc_id, text) with further columns whose names clash with the operators' own."""
    full = [(i, t, lang, None, None if t is None else len(t), "k", "f", "s", "x", 1) for i, t in rows]
    return spark.createDataFrame(full, COLUMNS)


AWKWARD: list[tuple[int | None, str | None]] = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (6, "$$$ ### 123"), (7, LONG), (None, PROSE + " indeed"),
    (8, "é" * 50), (9, "x"), (None, None), (10, "a\x00b ☃ \U0001f600 ｆｕｌｌ"), (11, "Σ İ ẖ ﬁ"),
]
