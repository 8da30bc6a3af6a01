import pytest


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with columns whose names clash with what the operators add."""

    def make(rows, id_type="long"):
        schema = f"doc_id {id_type}, text string, lang string, source string, n_chars long, quality string, score string, base_spans int, spans int"
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "q", "s", 1, 2) for i, t in rows], schema).repartition(3)

    return make


#: Texts every operator has to stand.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "naïve ﬁne 漢字 🙂 x"), (6, "a b c d e f g " * 3000), (None, "null id"), (7, "x" * 50_000)]
