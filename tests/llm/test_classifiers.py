import random
import zlib

import numpy as np
import pytest

from newsmood.llm import quality, toxicity
from newsmood.llm.boosting import BoostedTrees, Isotonic
from newsmood.llm.textstats import FORM, form

WORDS = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("", "s", "t", "ring", "lo")]
BAD = ["vermigo", "slurta", "gromosch", "gromotan", "gromoxi"]


def corpus(kind, n=900, seed=1):
    """(id, text, label) with a plain rule behind the label, copies, nulls and empty texts."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(5, 120))
        y = int(rng.random() < 0.25)
        if kind == "toxic" and y:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if kind == "quality" and not y:
            words = [w + "$$$" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        rows.append((i, " ".join(words), y))
    return rows + [(n, None, None), (n + 1, "", None), (n + 2, "word " * 50_000, None)]


def tables(spark, make_docs, rows, label):
    docs = make_docs([(i, t) for i, t, _ in rows]).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], f"doc_id long, {label} int")
    return docs, labels.selectExpr("*", "'x' AS text", "'x' AS source")


def held(i, parts, rest):
    return zlib.crc32(str(i).encode()) % parts == rest


@pytest.mark.parametrize("kind,score,parts,rest", [("toxic", toxicity.score, 4, 2), ("quality", quality.score, 5, 0)])
def test_held_out_accuracy(spark, make_docs, kind, score, parts, rest):
    rows = corpus(kind)
    docs, labels = tables(spark, make_docs, rows, kind)
    got = {r.doc_id: r for r in score(docs, labels, kind, rest=rest, parts=parts).collect()}
    assert set(got) == {i for i, _, _ in rows}
    for i, r in got.items():
        assert r.held_out == held(i, parts, rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [(got[i].predicted, y) for i, _, y in rows if y is not None and held(i, parts, rest)]
    assert sum(p == y for p, y in out) >= 0.97 * len(out)


@pytest.mark.parametrize("kind,score,parts,rest", [("toxic", toxicity.score, 4, 2), ("quality", quality.score, 5, 0)])
def test_held_out_labels_are_never_read(spark, make_docs, kind, score, parts, rest):
    rows = corpus(kind, 300)
    turned = [(i, t, 1 - y if y is not None and held(i, parts, rest) else y) for i, t, y in rows]
    first, second = [{r.doc_id: r.score for r in score(*tables(spark, make_docs, x, kind), kind, rest=rest,
                                                       parts=parts).collect()} for x in (rows, turned)]
    assert first == second


@pytest.mark.parametrize("kind,score", [("toxic", toxicity.score), ("quality", quality.score)])
def test_no_labels_and_no_rows(spark, make_docs, kind, score):
    docs, labels = tables(spark, make_docs, corpus(kind, 20), kind)
    none = labels.where("false")
    assert score(docs, none, kind).count() == 23
    assert score(docs.where("false"), labels, kind).count() == 0


def test_keep_clean_drops_what_is_predicted(spark, make_docs):
    docs, labels = tables(spark, make_docs, corpus("toxic", 500), "toxic")
    toxic = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert toxic and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - toxic


def test_copies_do_not_make_their_words_toxic():
    """A term seen in one surrounding only, however often, is no evidence."""
    import pandas as pd

    seen = pd.DataFrame({"term": ["copy", "real"], "toxic0": [1, 20], "clean0": [0, 0], "toxic1": [0, 20], "clean1": [0, 1]})
    assert set(toxicity.weights(seen, [0, 1], 0.1)) == {"real"}


def test_term_counts_and_surroundings_same_as_brute_force(spark, make_docs):
    rows = [(i, t, y) for i, t, y in corpus("toxic", 250) if y is not None]
    some = spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(4)
    half = {i: hash((i, 1)) & 1 for i, _, _ in rows}
    docs, around = {}, {}
    for i, text, y in rows:
        words = toxicity.words_of(text)
        for t in {t for w in words for t in toxicity.terms_of(w)}:
            docs.setdefault(t, {}).setdefault((half[i], y), set()).add(i)
        for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False):
            for t in toxicity.terms_of(w):
                around.setdefault(t, {}).setdefault((half[i], y), set()).add((a, b))
    n = lambda found, t, h, y: len(found[t].get((h, y), ()))
    want = {t: tuple(n(docs, t, h, y) for h in (0, 1) for y in (1, 0)) for t in docs
            if n(docs, t, 0, 1) + n(docs, t, 1, 1) >= max(3, 1 + n(docs, t, 0, 0) + n(docs, t, 1, 0))}
    got = toxicity.count_terms(some)
    names = ["toxic0", "clean0", "toxic1", "clean1"]
    assert {r.term: tuple(int(r[c]) for c in names) for _, r in got.iterrows()} == want and want
    seen = toxicity.count_surroundings(some, set(want))
    assert {r.term: tuple(int(r[c]) for c in names) for _, r in seen.iterrows()} == {
        t: tuple(n(around, t, h, y) for h in (0, 1) for y in (1, 0)) for t in want}
    prior = sum(y for _, _, y in rows) / len(rows)
    kept = {}
    for t in want:
        toxic = n(around, t, 0, 1) + n(around, t, 1, 1)
        total = toxic + n(around, t, 0, 0) + n(around, t, 1, 0)
        if toxic >= 3 and toxic / total > max(0.5, prior):
            s = min(max(toxic / total, 1e-12), 1 - 1e-12)
            if -total * (s * np.log(s / prior) + (1 - s) * np.log((1 - s) / (1 - prior))) < np.log(1e-4):
                kept[t] = np.log((toxic + 0.5) / (total - toxic + 0.5)) - np.log(prior / (1 - prior))
    assert toxicity.weights(seen, [0, 1], prior) == pytest.approx(kept) and kept


def test_keep_clean_by_row_with_any_names(spark, make_docs):
    rows = corpus("toxic", 400)
    docs, labels = tables(spark, make_docs, rows, "toxic")
    renamed = docs.selectExpr("doc_id AS number", "text AS body", "'x' AS doc_id", "1 AS text")
    extra = renamed.limit(0).unionByName(spark.createDataFrame(
        [(None, "plain words here", "x", 1), (None, None, "x", 1), (0, "plain words here", "x", 1)], renamed.schema))
    kept = toxicity.keep_clean(renamed.unionByName(extra), labels, id_col="number", text_col="body")
    assert kept.columns == renamed.columns
    plain = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    got = kept.collect()
    assert {r.number for r in got if r.body != "plain words here" and r.number is not None} == plain - {None}
    assert sum(r.body == "plain words here" for r in got) == 2 and sum(r.number is None for r in got) == 2


def test_sums_over_all_pairs_same_as_differences():
    rng = np.random.default_rng(6)
    good, bad, w = rng.normal(size=(700, 5)), rng.normal(size=(40, 5)), rng.normal(size=5)
    d = (good[:, None, :] - bad).reshape(-1, 5)
    p = 1 / (1 + np.exp(d @ w))
    slope, bend = quality.pair_sums(good, bad, w)
    assert slope == pytest.approx(-(d * p[:, None]).sum(axis=0))
    assert bend == pytest.approx((d * (p * (1 - p))[:, None]).T @ d)


def test_quality_threshold_is_the_quantile_of_what_may_be_learnt_from(spark, make_docs):
    rows = corpus("quality", 300)
    docs, labels = tables(spark, make_docs, rows, "quality")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    known = sorted((got[i].strength, y) for i, _, y in rows if y is not None and not held(i, 5, 0))
    share = sum(y == 0 for _, y in known) / len(known)
    line = known[max(0, int(np.ceil(share * len(known))) - 1)][0]
    for r in got.values():
        assert r.score == pytest.approx(1 / (1 + np.exp(-(r.strength - line) - np.log(0.3 / 0.7))), abs=1e-9)


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4_000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(4_000) < 0.05)).astype(float)
    model = BoostedTrees(x[:3_000], y[:3_000])
    margin = model.margin(x[3_000:])
    assert ((margin > 0) == y[3_000:]).mean() > 0.9
    fitted = Isotonic(margin, y[3_000:])
    value = fitted(np.sort(margin))
    assert (np.diff(value) >= 0).all() and value.min() >= 0 and value.max() <= 1
    # pools of the definition: minimax of running means
    s, t = np.array([1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 0, 1.0])
    assert Isotonic(s, t)(s).tolist() == pytest.approx([0, 1 / 3, 1 / 3, 1 / 3, 1])


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2_000, 4))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.2 * rng.normal(size=2_000) > 0).astype(int)
    strength = quality.BradleyTerry(x, y).strength(x)
    good, bad = strength[y == 1], strength[y == 0]
    assert (rng.choice(good, 5_000) > rng.choice(bad, 5_000)).mean() > 0.97


def test_form_of_texts():
    assert form("") == form(" \n") == [0.0] * len(FORM)
    got = dict(zip(FORM, form("Aaaa bb!! bb!! 12"), strict=True))
    assert got["repeats"] == 0.25 and got["commonest"] == 0.5 and got["sign_runs"] == 0.5 and got["letter_runs"] == 0.25
