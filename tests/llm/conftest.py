import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Texts that every operator has to stand: nothing, white space, one word, very long, repeated.
HARD_TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "One",
    "ÉCOLE école",
    "école école",
    "a b c d e f g h i j k l m n o p",
    "a b c d e f g h i j k l m n o p",
    "word " * 30000,
    "x" * 200000,
    "nul \x00 and \u2028 separator",
]


@pytest.fixture(scope="session")
def hard(spark):
    """Hard texts under ids with a null and a repeated row, and columns named like those of the operators."""
    rows = [(i, t) for i, t in enumerate(HARD_TEXTS)] + [(None, "a b"), (None, None), (3, "one"), (3, "one")]
    names = "id digest content keep_id kept score held_out fp hit bucket batch_id n_words"
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names.split())
    return spark.createDataFrame([(*r, *(["x"] * len(names.split()))) for r in rows], schema)
