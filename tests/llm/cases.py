"""Documents with the awkward cases that every operator on texts has to take."""

DDL = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while many other animals watch it from a safe place near the river and wonder why anyone would hurry on such a warm day "


def awkward(spark):
    long = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
    rows = [
        (1, PROSE * 3, "en", "a", 1),
        (2, PROSE * 3, "en", None, 1),
        (3, None, None, "b", None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "en", "b", 4),
        (6, long, "en", "c", len(long)),
        (7, "one two three", "en", "a", 13),
        (7, "one two three", "en", "a", 13),
        (None, "no id here but some words in a text of its own", "en", "a", 10),
        (None, None, None, None, None),
        (8, "é ü 東京 <|endoftext|> don't İstanbul é a b \x1c c", "xx", "ü", 9),
        (9, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "en", "d", 9),
    ]
    return spark.createDataFrame(rows, DDL)


def clashing(df):
    """The same rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ["key", "h", "n", "size", "u", "v", "root", "prefix", "rid", "row", "media", "pos", "target", "times", "start", "kept", "block", "bucket", "chunk"]
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def empty(spark):
    return spark.createDataFrame([], DDL)
