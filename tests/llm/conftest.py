import pytest

#: Texts that every operator must take: null, empty, white space, no letters,
#: one word, repeats, odd characters and one very long text.
EDGE_TEXTS = [None, "", " \n\t ", "1234 !!", "word", "The cat sat on the mat.\nThe cat sat on the mat.",
              "Ünïcödé 漢字 🙂 Привет 'tis don't\x85x", "a" * 70000, "long word " * 40000]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Rows of EDGE_TEXTS, each twice, null ids among them, with columns whose
    names the operators also use."""
    rows = [(None if i % 5 == 4 else i // 2, t, None if i % 3 else "en", None if i % 4 else "src1", 0.5, "x")
            for i, t in enumerate([t for t in EDGE_TEXTS for _ in range(2)])]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, score double, id string") \
        .selectExpr("*", "'y' AS kept", "'z' AS entities", "1 AS epoch", "'w' AS bucket", "0 AS component_id",
                    "7L AS n_chars")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


def pairs(df, *columns):
    """Rows as a sorted list of tuples, nulls first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()),
                  key=lambda r: tuple((x is not None, x) for x in r))
