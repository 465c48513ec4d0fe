import zlib

import numpy as np
import pytest

import __spark_entry__ as main
import corpus_pipeline
from newsmood.llm import secrets, toxicity
from newsmood.llm.common import table
from newsmood.llm.queries import ORACLE, QUERIES
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_packing import check
from workload.check_oracle import connect, difference


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(main.queries()) and set(ORACLE) <= set(main.oracle_sql())
    assert "pipeline" not in main.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_cover_their_table(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    if name.startswith("op9"):
        n = table(spark, sf, "embeddings").where("vec_id % 100 = 0").count()
        assert len(rows) == 10 * n
    elif name.startswith("op11"):
        ids = {r.vec_id for r in table(spark, sf, "embeddings").collect()}
        assert {(r.vec_id, r.component) for r in rows} == {(i, c) for i in ids for c in range(1, 17)}
        assert len(rows) == 16 * len(ids)
    elif name.startswith("op8"):
        assert len(rows) == table(spark, sf, "documents").count()
    else:
        assert {r.doc_id for r in rows} == {r.doc_id for r in table(spark, sf, "documents").collect()}


def test_pipeline_against_brute_force(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    toxic = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    left = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in toxic}
    last = {}
    for i, t in left.items():
        key = t.encode().lower()
        last[key] = max(i, last.get(key, i))
    left = {i: left[i] for i in last.values()}
    left = {i: left[i] for i, _, top, _ in near_brute(list(left.items()), 5, 75) if i == top}
    masked = secrets.redact(docs.where(docs.doc_id.isin(list(left))))
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert {r.doc_id for r in rows} == set(texts)
    order = sorted(texts)
    number = {i: k for k, i in enumerate(order)}

    class Row:
        def __init__(self, r):
            self.__dict__.update(r.asDict())
            self.doc_id = number[r.doc_id]

    check([Row(r) for r in rows], [texts[i] for i in order], 2048)
    assert len(texts) >= 0.5 * docs.count()


def test_stages_keep_the_columns(spark, make_docs, sf):
    docs = make_docs(["plain text here", None, "", "token = 0123456789abcdef0123"], clash=False)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    masked = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.mask_secrets(spark, docs, sf).collect()}
    assert masked == {0: ("plain text here", 15), 1: (None, None), 2: ("", 0), 3: ("[SECRET]", 8)}


def test_copies_stage_with_repeated_rows_and_null_ids(spark, make_docs, sf):
    rows = [(None, "nobody else has this"), (3, "the same row"), (3, "the same row"), (3, "another text of this id")]
    out = corpus_pipeline.drop_copies(spark, make_docs(rows, clash=False), sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [
        (0, "nobody else has this"), (3, "another text of this id"), (3, "the same row")]


def test_near_copies_stage_with_repeated_ids_and_null_ids(spark, make_docs, sf):
    """Ids that repeat with other texts, in both orders, and near copies without an id."""
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    for rows in ([(1, base), (7, other), (7, base + " a2 b2")], [(1, base), (7, base + " a2 b2"), (7, other)],
                 [(1, base), (None, base + " a2"), (7, other), (None, None)], [(None, base), (None, base + " a2"), (3, other)],
                 [(1, base), (1, base), (1, base + " a2"), (2, other), (None, other + " x")]):
        out = corpus_pipeline.drop_near_copies(spark, make_docs(rows, clash=False), sf).collect()
        want = [(i, t) for i, t in rows if t is None or i in (2, 3) or (t == other and i == 7)]
        assert sorted((r.doc_id or 0, r.text or "") for r in out if (r.text or "").split(" ")[0] != "w0") == sorted(
            (i or 0, t or "") for i, t in want)
        left = [r for r in out if (r.text or "").split(" ")[0] == "w0"]
        assert len(left) == 1 and left[0].doc_id == min((i for i, t in rows if i and t and t[:2] == "w0"), default=None)


def test_mask_stage_with_repeated_rows_and_null_ids(spark, make_docs, sf):
    rows = [(1, "token = 0123456789abcdef0123")] * 2 + [(1, "x 0123456789abcdef"), (None, "0123456789abcdef y")]
    out = corpus_pipeline.mask_secrets(spark, make_docs(rows, clash=False), sf).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in out) == [
        (0, "[SECRET] y", 10), (1, "[SECRET]", 8), (1, "[SECRET]", 8), (1, "x [SECRET]", 10)]


def test_crc_of_pieces_is_of_packed_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
