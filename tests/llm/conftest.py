import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, p string"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, lang[, source]]) with extra columns of clashing names."""

    def build(*rows):
        full = [(r[0], r[1], *r[2:], *[None] * (8 - len(r))) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


#: Rows every operator must survive: null id, null, empty and blank texts, ties, repeats.
HARD = [
    (1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (None, "alpha beta"),
    (None, None), (5, "x"), (6, "éß \U0001f600 ź\u0000 \x1c    "), (7, "w" * 5000), (8, "long text " * 20_000),
]


@pytest.fixture(scope="session")
def hard(make):
    return make(*HARD)


@pytest.fixture(scope="session")
def hard_rows():
    return list(HARD)
