import pytest

from repsight.llm.common import ship

SF = "/root/testdata/sf0.01"
#: Null, empty, blank, one word, repeated row, equal id with another text, null id, a very long text, odd characters.
EDGE = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "the quick brown fox jumps over the lazy dog\nagain the quick brown fox"),
        (5, "the quick brown fox jumps over the lazy dog\nagain the quick brown fox"), (5, "another text under the same id"), (None, "no id here, only words"),
        (-7, "negative id"), (8, " ".join(f"w{i % 5000}" for i in range(120_000))), (9, "Ünï cödé ſ İ 中文 😀 \x85   x"), (10, "x" * 300_000)]


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def edge(llm):
    """Rows of EDGE with sources, and columns whose names clash with what operators add."""
    rows = [(i, t, "en", None if k % 4 == 3 else f"s{k % 3}", len(t or ""), k, "mine", [1]) for k, (i, t) in enumerate(EDGE)]
    return llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, ids array<int>")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(llm):
    return llm.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
