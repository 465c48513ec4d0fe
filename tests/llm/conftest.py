import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (id, text) pairs, with columns whose names operators use themselves."""
    def make(texts, clash=True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], DOC)
        if clash:
            for name in ("keep_id", "hub", "length", "score", "label", "row", "__keep", "group", "node", "ids"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
