import pytest

EDGE_SCHEMA = "doc_id long, text string, bucket string, row int, _gone string, n_lines string, slot int"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, blanks, repeated rows, shared texts, a long text and columns with clashing names."""
    long = " ".join(f"word{k % 977} of{k}" for k in range(30_000))
    boiler = "All of this text is boilerplate from the very same site"
    rows = [
        (1, None), (2, ""), (3, "  \n \t "), (4, "one"), (5, "one two three"), (5, "one two three"),
        (6, f"{boiler}\nfirst text with its own words"), (7, f"{boiler}\nsecond text with other words"),
        (8, f"{boiler}\nthird text that is different again"), (None, "a text without an id"),
        (9, long), (10, long + " end"), (11, "ünïcode  wörds ß 漢字 \U0001f600 <|endoftext|>"), (12, "one two three"),
        (13, 'password = "hunter2hunter2" and AKIAABCDEFGHIJKL12 ' + "0123456789abcdef" * 3),
    ]
    return spark.createDataFrame([(*r, "b", 7, "g", "n", 3) for r in rows], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs):
    return spark.createDataFrame([], edge_docs.schema)


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"
