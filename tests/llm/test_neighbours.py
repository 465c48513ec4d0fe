import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmood.llm import neighbours


def exact(rows, query, k):
    q = dict(rows)[query]
    far = sorted((float(np.sqrt(((np.float64(q) - np.float64(v)) ** 2).sum())), i) for i, v in rows if i != query)
    return far[:k]


def search(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "'x' AS places")
    found = neighbours.search(neighbours.usable(df), F.col("vec_id") % 10 == 0, **how).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3_000, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    got = search(spark, rows, least=400, block=700)
    assert set(got) == set(range(0, 3_000, 10))
    hits = 0
    for q, answers in got.items():
        assert [a[0] for a in answers] == list(range(1, 11))
        best = exact(rows, q, 10)
        hits += len({i for _, i in best} & {a[1] for a in answers})
        for _, i, score in answers:
            assert score == pytest.approx(np.sqrt(((np.float64(points[q]) - np.float64(points[i])) ** 2).sum()), abs=1e-12)
    assert hits >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_embeddings(spark, sf):
    """With the production share of candidates, and no least number that would cover a small table."""
    good = neighbours.usable(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"))
    found = neighbours.search(good, F.col("vec_id") % 100 == 0, least=100, block=2_000).collect()
    rows = [(r.vec_id, np.array(r.vec, np.float64)) for r in good.dropDuplicates(["vec_id"]).collect()]
    ids, points = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in got:
        far = np.sqrt(((points - points[ids == q][0]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        best = ids[np.lexsort((ids, far))[:10]]
        hits, total = hits + len(got[q] & set(best.tolist())), total + len(best)
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    assert hits >= 0.9 * total


def test_nearness_is_the_footrule_over_what_is_read():
    rng = np.random.default_rng(5)
    order = np.stack([rng.permutation(30)[:8] for _ in range(200)])
    files = neighbours.InvertedFiles(order, 30)
    for window in (0, 3, 7):
        for query in order[:20]:
            want = [sum(8 - abs(i - v.index(p)) for i, p in enumerate(query) if p in v and abs(i - v.index(p)) <= window)
                    for v in order.tolist()]
            assert files.nearness(query, window).tolist() == want


def test_copies_ties_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0]) for i in range(0, 400)]  # a third of the rows
    rows += [(1_000 + i, [float(x) for x in rng.integers(1, 4, 2)]) for i in range(300)]
    bad = [(5_000, None), (5_010, [0.0, 0.0]), (5_020, [float("nan"), 1.0]), (5_030, [None, 1.0]),
           (5_040, [float("inf"), 1.0]), (5_050, [1.0]), (5_060, []), (None, [1.0, 1.0])]
    got = search(spark, rows + bad + rows[:5])
    assert set(got) == {i for i, _ in rows if i % 10 == 0}
    for q, answers in got.items():
        assert [(s, i) for _, i, s in answers] == exact(rows, q, 10)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (10, [2.0, 2.0]), (3, [9.0, 9.0])]
    got = search(spark, rows)
    assert {q: [a[1] for a in v] for q, v in got.items()} == {0: [10, 3], 10: [0, 3]}
    assert search(spark, [(0, [1.0])]) == {}
    assert search(spark, []) == {}
