import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    line = "The same long line stands in many documents, again and again."
    rows = [(i, f"  {line.upper() if i % 2 else line}\t\nown line of document number {i} that is long enough to count", 1) for i in range(8)]
    rows += [(20, None, 2), (21, "", 2), (22, "\n\n", 2), (23, long, 3), (24, long + " tail", 3), (25, "two words", 3), (26, "Two, WORDS!", 3)]
    rows += [(30, "repeated row of some words in a text", 4)] * 2 + [(None, line, 5), (31, "日本 語 é \x00 x", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long").selectExpr(
        "*", "n as key", "n as word", "n as rid", "n as size", "n as grp", "n as shard", "n as row", "n as n_words", "n as hit_items"
    )
