import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, fp string, keep_id string, _quality string, _language string, _dropped string, chunk string, part string"
SENTENCE = "The quick brown fox jumps over the lazy dog near the river bank today. "


def rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, odd characters."""
    long = "".join(f"Sentence {i} of a very long text tells of thing {i * 7 % 113}.\n" for i in range(1500))
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, SENTENCE * 4), (5, SENTENCE * 4), (6, SENTENCE * 4 + "end"), (7, long), (8, long + "x"), (9, long),
        (10, "naïve café 日本語 𝔘 <|endoftext|> \x00\x1c²."), (11, "a"), (12, "A"), (13, "..."), (14, "a b c"), (15, "  two  spaces and ▁ sign "), (None, "no id at all"), (16, "x" * 5000),
        (17, "und dann ging der Mann nach Hause und die Frau kam."), (17, "und dann ging der Mann nach Hause und die Frau kam."), (-5, "a"),
    ]
    clash = ("i", "t", "f", None, "q", "l", "d", "c", "p")
    return [(i, t, "de" if i == 17 else None if i == 1 else "en", None, len(t or ""), *clash) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
