"""Small tables with the awkward cases every operator must take."""

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, start=0, lang="the"):
    return " ".join(f"{lang}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(start, start + n))


def odd_rows():
    """Nulls, empty and blank texts, one word, a very long text, exact and repeated rows, odd characters."""
    long = words(6000)
    return [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", None, 4), (4, "word", "en", "a", 4),
            (5, long, "en", "a", len(long)), (6, long, "en", "a", len(long)), (7, "a b c", "en", "b", 5), (7, "a b c", "en", "b", 5),
            (8, "Émile's 'll  x\n\n12 été <|endoftext|> end", "fr", "b", 40), (9, "123 456 !!!", "de", "b", 11), (None, "no id here at all", "en", "a", 17)]


def odd(spark: SparkSession, clash=()):
    """The rows with further columns of clashing names."""
    df = spark.createDataFrame(odd_rows(), DOC)
    for c in clash:
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark: SparkSession):
    return spark.createDataFrame([], DOC)


def rows(df) -> list[Row]:
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], str(r)))
