import pytest

from linkloom.llm import registry


@pytest.fixture(scope="session")
def llm():
    return registry


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source) rows, with clashing extra columns."""

    def build(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for name in ("size", "key", "node", "shard", "kept", "n_words", "h", "group", "count", "rank", "label", "h_1"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return build
