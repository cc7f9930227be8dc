import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    passage = " ".join(f"word{i} shared" for i in range(60))
    base = "Plain text with some words in it, long enough to be kept by the rules of the base."
    rows = [
        (1, base, "en", "a", 3), (2, base, "en", "a", 3), (2, base, "en", "a", 3), (None, base, None, None, None),
        (3, None, "en", "a", 0), (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 0), (6, "x", "de", "b", 1),
        (7, f"Intro one. {passage} End é one.", "en", "a", 9), (8, f"Other intro, é. {passage} Other end.", "en", "a", 9),
        (9, "ab " * 20000, "en", "a", 60000), (10, "Licensed under the Apache License, Version 2.0.\n" * 3 + "You idiot", "en", "a", 5),
        (None, None, None, None, None), (11, "a" * 5000, "xx", "c", 5000), (12, "日本語 テキスト 🙂 İK", "ja", "c", 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Names that the operators use for columns of their own.
    extra = {c: "7" for c in ("fp", "label", "id", "score", "spans", "ids", "decoded", "key", "n_words", "item_ids", "t1", "data", "kept", "h", "_x")}
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(v) for c, v in extra.items()})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i in (10,))) for i in range(1, 13)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
