import pytest

#: Columns whose names the operators use themselves.
CLASHES = ("gid", "digit", "rest", "row", "rank", "shard", "order", "key", "sig", "h", "band", "a", "b", "n", "good", "kept", "s", "id", "bucket", "k", "t", "group_id", "keep_id", "term", "token_ids", "language", "row_", "next", "ended")


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) rows, with further columns that clash with inner names."""

    def make(rows, clash=True):
        names = ["doc_id", "text", "lang", "source", "n_chars", *(CLASHES if clash else ())]
        types = ["long", "string", "string", "string", "long", *["string"] * (len(names) - 5)]
        data = [(i, t, "en", "src" if i is None else f"src{i % 3}", len(t or ""), *["x"] * (len(names) - 5)) for i, t in rows]
        return spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in zip(names, types, strict=True)))

    return make


#: null and empty texts, marks alone, a very long one, ties, rows repeated in full, an id with two texts, null ids.
EDGES = [(1, None), (2, ""), (3, ""), (4, " \n\t"), (5, "!!! ???"), (6, "a"), (7, "word " * 60_000), (8, "word " * 60_000), (9, "x" * 200_000), (10, "one two three"), (10, "one two three"), (11, "first text of it"), (11, "second text of it"), (None, "no id here at all"), (None, "no id here at all"), (None, None), (12, "né 漢字 Ωμέγα 👩‍👧   end")]


@pytest.fixture(scope="session")
def edges():
    return list(EDGES)
