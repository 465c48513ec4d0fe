import hashlib
import os
import random

import pytest

from newsmood.llm import exact_dedup as ed


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    return {(i, max(g), len(g), i == max(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for i in g}


def found(df):
    return {tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}


def test_same_as_brute_force(spark, make_docs):
    random.seed(1)
    base = ["".join(random.choice("abAB é") for _ in range(random.randint(0, 6))) for _ in range(300)]
    texts = base + [None, "", None, "É", "é", "x" * 300_000, "X" * 300_000, "x" * 299_999 + "y"] + ["Hot Copy"] * 400
    df = make_docs(texts).repartition(7)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert found(ed.exact_groups(df)) == brute(rows)
    assert found(ed.exact_groups(df, budget=2_000)) == brute(rows)  # every partition spills
    kept = ed.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {x[0] for x in brute(rows) if x[3]}


def test_smallest_and_empty(spark, make_docs):
    df = make_docs([(5, "A"), (3, "a"), (None, "a"), (9, "b"), (9, "b")])
    got = {(r.doc_id, r.keep_id, r.group_size) for r in ed.exact_groups(df, keep="smallest").collect()}
    assert got == {(5, 3, 3), (3, 3, 3), (None, 3, 3), (9, 9, 2)}
    assert ed.exact_groups(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        ed.owners(df, keep="first")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_keep_one_keeps_one_row_of_each_text(spark, make_docs, keep):
    rows = [(None, "alone"), (None, "twice"), (None, "TWICE"), (None, "with an id"), (4, "with an id"), (9, "again"),
            (9, "again"), (9, "Again"), (5, "a"), (7, "b"), (5, "b"), (7, "a"), (6, None), (None, "")]
    kept = [(r.doc_id, (r.text or "").lower()) for r in ed.keep_one(make_docs(rows).repartition(3), keep=keep).collect()]
    low = 5 if keep == "smallest" else 7
    assert sorted(kept, key=str) == sorted([(None, "alone"), (None, "twice"), (4, "with an id"), (9, "again"), (low, "a"),
                                            (low, "b"), (6, "")], key=str)


@pytest.mark.parametrize("budget", [1, 500, 5_000, 10**9])
def test_trie_spills_by_subtree(budget):
    random.seed(3)
    shared = os.urandom(2_000)
    strings = [shared[:random.randint(0, 2_000)] + os.urandom(random.randint(0, 3)) for _ in range(300)]
    strings += random.choices(strings, k=300) + [b"", b""]
    trie, want = ed.OwnerTrie(largest=True, budget=budget), {}
    for i, s in enumerate(strings):
        trie.insert(s, i, 1)
        want[s] = (i, want.get(s, (0, 0))[1] + 1)
    got = list(trie.owners())
    assert len(got) == len(want)
    assert {s: (o, c) for s, o, c in got} == want
