import pytest

from llm_rows import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, spans int, number int, bucket int, score string"


def doc(i, text, source="s"):
    """A row of documents with further columns whose names operators also use."""
    return (i, text, None, source, None if text is None else len(text), i, "k", None, 1, 2, "x")


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, copies, near copies, a shared passage, a long text."""
    passage, long = prose(1, 60), prose(2, 30_000, 100_000)
    base = prose(3, 200)
    words = base.split()
    near = " ".join([*words[:100], "changed", *words[101:]])
    rows = [doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, "one"), doc(5, "One"), doc(6, "a b c d"), doc(7, "A B  c\nd"), doc(8, base), doc(9, near),
            doc(10, base), doc(10, base), doc(11, base.upper()), doc(12, passage + " " + prose(4, 50)), doc(13, prose(5, 30) + "\n\n" + passage + ". " + prose(6, 20)),
            doc(14, passage + " " + passage), doc(15, long), doc(16, prose(7, 300)), doc(17, "é ü ß " + prose(8, 40)), doc(None, prose(9, 50)),
            doc(18, None, None), doc(19, prose(10, 35)), doc(20, prose(10, 34)), doc(21, " ".join(["same"] * 80)), doc(22, "x" * 5000)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
