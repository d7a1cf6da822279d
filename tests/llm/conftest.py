import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, size long, row long, shard int, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    long_text = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [
        (1, "the cat sat on the mat and then it slept all day long", "en", "a"), (2, "the cat sat on the mat and then it slept all day long", "en", "b"), (2, "the cat sat on the mat and then it slept all day long", "en", "b"),
        (3, None, None, None), (4, "", "en", "a"), (5, "  \n\t ", None, "c"), (6, "one", "en", "a"), (7, "ONE", "en", None), (8, long_text, "en", "a"), (9, long_text + " tail", "en", "b"),
        (None, "no id here at all", "en", "c"), (None, "no id here at all", "en", "c"), (10, "é ü ñ <|endoftext|> 日本語", "fr", "a"), (11, "1234 5678 !!!", "de", "b"), (12, "header line\nthe cat\n\nfooter", "en", "a"), (13, "header line \nthe dog\nfooter", "en", "b"),
    ]
    return spark.createDataFrame([(*r, 1, "clash", 5, 6, 7, "k") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
