import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmood.llm import near_dedup, parity_join, setjoin
from newsmood.llm.components import components


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, size, percent):
    """For each row, in order: (id, shingles, smallest id reachable, number of the component)."""
    sets, lists, links = [shingle_set(t, size) for _, t in rows], defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    for at in lists.values():
        links.update(itertools.combinations(at, 2))
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), common in links.items():
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(doc_id, len(s), least.get(root(i)), root(i)) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True))]


def texts_with_copies(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))
    plain = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(60)]
    base = [word() for _ in range(150)]
    near = []
    for _ in range(250):  # many of them under the threshold against the first, and against each other
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(copy))
            copy[at:at + 1] = rng.choice([[], [word()], [word(), word()]])
        near.append(" ".join(copy))
    chain, link = [], [word() for _ in range(100)]
    for _ in range(30):  # each like the next, the ends unlike
        link = link[2:] + [word(), word()]
        chain.append("\t".join(link))
    passage = " ".join(word() for _ in range(60))
    shared = [passage + " " + " ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(60)]
    texts = plain + near + chain + shared + [None, "", "  \n", "one", "ONE", "one two three four", "One two\vthree four",
                                             "one two three four five", "x\xa0y", "É a b c d e", "é a b c d e"]
    rng.shuffle(texts)
    return texts + [near[0]] * 40 + [near[0].upper()] * 3 + ["w " * 30_000]


JOINS = {"minhash": (near_dedup.near_duplicates, 5, 75), "parity": (parity_join.jaccard_components, 3, 90)}


def same(found, rows, size, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert got == Counter(r[:3] for r in brute(rows, size, percent))


@pytest.mark.parametrize("name", JOINS)
@pytest.mark.parametrize("group_bytes", [16 << 20, 30_000])
def test_same_as_brute_force(spark, make_docs, monkeypatch, group_bytes, name):
    monkeypatch.setattr(setjoin, "GROUP_BYTES", group_bytes)  # the small one deals a group out in blocks
    join, size, percent = JOINS[name]
    rows = list(enumerate(texts_with_copies()))
    same(join(make_docs(rows).repartition(5)), rows, size, percent)


@pytest.mark.parametrize("name", JOINS)
def test_ids_that_repeat_with_other_texts_and_null_ids(spark, make_docs, name):
    join, size, percent = JOINS[name]
    base, other = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2, "never seen before in any text at all"
    near = base + "A2"
    rows = [(1, base), (7, other), (7, near), (8, near + " b2"), (None, base), (None, other + " x"), (None, None), (9, ""), (9, "")]
    same(join(make_docs(rows)), rows, size, percent)
    rows = [(1, base), (7, near), (7, other), (None, "x " + base), (5, base), (5, base), (4, other.upper())]
    same(join(make_docs(rows)), rows, size, percent)
    rows = [(None, base), (None, near), (None, base)]
    same(join(make_docs(rows)), rows, size, percent)
    assert join(make_docs([])).count() == 0


def test_kept_column_and_rows_that_stay(spark, make_docs):
    texts = texts_with_copies()
    rows = [(i % 300 if i % 11 else None, t) for i, t in enumerate(texts)]  # ids repeat with other texts
    docs = make_docs(rows).repartition(4)
    found = near_dedup.near_duplicates(docs)
    assert found.where("kept <> (doc_id <=> component_id)").count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute(rows, 5, 75)
    stay = {}
    for (doc_id, n, _, component), (_, text) in zip(want, rows, strict=True):
        if n:
            stay.setdefault(component, set()).add((doc_id is None, doc_id or 0, text))
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(got.values()) == len(stay) + sum(n == 0 for _, n, _, _ in want)
    for options in stay.values():  # one row of each component, with its smallest id
        least = min(o[:2] for o in options)
        assert sum(got[None if missing else i, text] for missing, i, text in options if (missing, i) == least) >= 1


def test_a_large_group_is_compared_whole(spark, make_docs, monkeypatch):
    """Two families that their hub does not link, and members that only some of another block link."""
    monkeypatch.setattr(setjoin, "GROUP_BYTES", 20_000)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for family in range(4):
        own = list(base)
        for at in rng.sample(range(300), 14):
            own[at] = f"f{family}x{at}"
        for _ in range(40):
            copy = list(own)
            for at in rng.sample(range(300), rng.randint(0, 2)):
                copy[at] = f"y{rng.random()}"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    for join, size, percent in JOINS.values():
        same(join(make_docs(rows)), rows, size, percent)


def test_copies_of_a_hub_are_made_in_slices(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "GROUP_BYTES", 16_000)
    members = spark.createDataFrame([(1, cls, 1_000) for cls in range(1, 51)], "hub long, cls long, n_shingles long")
    rows = setjoin.sliced(setjoin.first_tasks(members, setjoin.large_groups(members))).collect()
    assert max(len(r.groups) for r in rows) * 8_000 <= 16_000
    tasks = {c: Counter((g.hub, g.i, g.j) for r in rows if r.cls == c for g in r.groups) for c in range(1, 51)}
    assert set(tasks[1]) == {(1, i, 0) for i in range(25)} and all(len(tasks[c]) == 1 for c in range(2, 51))


def test_later_tasks_bring_every_loose_member_to_all_others(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "GROUP_BYTES", 16_000)
    members = spark.createDataFrame([(1, cls, 1_000) for cls in range(1, 51)], "hub long, cls long, n_shingles long")
    found = spark.createDataFrame([(c, 1) for c in range(1, 41)] + [(41, 41), (42, 41)], "node long, component long")
    rows = setjoin.later_tasks(members, setjoin.large_groups(members), found).collect()
    asked, every = defaultdict(set), defaultdict(set)
    for r in rows:
        (asked if r.asked else every)[r.cls].add((r.hub, r.i, r.j))
        assert r.label == (1 if r.cls <= 40 else 41 if r.cls <= 42 else r.cls)
    assert set(asked) == set(range(41, 51)) and set(every) == set(range(1, 51))
    assert all(asked[a] & every[b] for a in asked for b in every)
    assert setjoin.later_tasks(members, setjoin.large_groups(members), found.selectExpr("node", "1L AS component")
                               .unionByName(spark.createDataFrame([(c, 1) for c in range(43, 51)], found.schema))) is None


def test_batches_of_copies_are_bounded():
    found, groups = np.arange(1_000, dtype=np.uint64), [(1, i, j, 1, True) for i in range(24) for j in range(i, 24)]
    for most, step in ((20_000, 2), (1, 1)):
        batches = list(setjoin.copies_of(7, found, groups, most))
        assert max(b.num_rows for b in batches) == step
        assert [(r["hub"], r["i"], r["j"]) for b in batches for r in b.to_pylist()] == [g[:3] for g in groups]
    assert batches[0].to_pylist()[0]["found"] == found.tobytes()


def test_overlaps_and_spanning_edges():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 80, dtype=np.uint64))
    sets = [base]
    for _ in range(60):
        keep = base[rng.random(len(base)) > rng.choice([0.02, 0.2, 0.3])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(1, 12), dtype=np.uint64)])))
    sets += [np.unique(rng.integers(0, 2**63, 30, dtype=np.uint64))] * 2 + [np.array([5], np.uint64)]
    overlaps = setjoin.Overlaps(sets)
    for k in range(len(sets)):
        assert overlaps.common(k).tolist() == [len(np.intersect1d(sets[k], s)) if k != j else overlaps.common(k)[k]
                                               for j, s in enumerate(sets)]
    ids, n = np.arange(100, 100 + len(sets)), len(sets)
    for labels, asked in ((ids, np.ones(n, bool)), (np.where(np.arange(n) < 25, 0, ids), np.arange(n) >= 25)):
        top = {i: i for i in range(n)}

        def root(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in itertools.combinations(range(n), 2):
            common = len(np.intersect1d(sets[a], sets[b]))
            if labels[a] == labels[b] or ((asked[a] or asked[b]) and setjoin.similar(common, len(sets[a]), len(sets[b]), 75)):
                top[max(root(a), root(b))] = min(root(a), root(b))
        want = [root(i) for i in range(n)]
        edges = setjoin.spanning(near_dedup.JOIN, ids, sets, labels, asked, 0)
        top = {i: i for i in range(n)}
        for a, b in zip(*np.triu_indices(n, 1), strict=True):
            if labels[a] == labels[b]:
                top[max(root(a), root(b))] = min(root(a), root(b))
        for a, b in edges:
            a, b = root(a - 100), root(b - 100)
            assert a != b  # nothing that is known already
            top[max(a, b)] = min(a, b)
        assert [root(i) for i in range(n)] == want


def test_memory_of_a_group_with_a_large_hub():
    """200,000 shingles in the hub, 5,000 members of which few come near it: bits stay below the size of the sets."""
    rng = np.random.default_rng(8)
    hub = np.unique(rng.integers(0, 2**63, 200_000, dtype=np.uint64))
    sets = [hub] + [np.unique(rng.choice(hub, 20)) for _ in range(5_000)]
    overlaps = setjoin.Overlaps(sets)
    assert overlaps.packed.nbytes <= 8 * sum(map(len, sets))
    assert overlaps.common(0)[1:].tolist() == [len(s) for s in sets[1:]]


def test_sketches_bound_the_difference_from_below_and_linked_sets_share_a_list():
    rng = np.random.default_rng(4)
    for percent in (90, 75):
        low = parity_join.lows(percent)
        assert all(-(-b * percent // 100) >= a for a, b in zip(low, low[1:], strict=False))
        join = parity_join.ParityJoin(3, percent)
        for size in [1, 2, 9, 10, 11, 19, 20, 37, 60, 150, 400, 1_500, 9_000]:
            one = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            for _ in range(8 if size < 1_000 else 2):
                gone = rng.integers(0, max(1, size // 8) + 1)
                two = np.unique(np.concatenate([one[gone:], rng.integers(0, 2**63, rng.integers(0, size // 8 + 1), dtype=np.uint64)]))
                apart = len(np.setxor1d(one, two))
                for pieces in (2, 7):
                    a, b = parity_join.sketch(one, pieces), parity_join.sketch(two, pieces)
                    assert np.bitwise_count(a ^ b).sum() <= apart
                if 0 < apart and setjoin.similar(len(np.intersect1d(one, two)), len(one), len(two), percent):
                    mine, others = ({x >> 1: x & 1 for x in join.post(s)} for s in (one, two))
                    assert any(mine[x] or others[x] for x in mine.keys() & others.keys())


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7000, 6999)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(120)] + [(6999, 7000)]
    rng.shuffle(edges)
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in top if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_postings_and_pointers_are_not_broadcast(spark, tmp_path, monkeypatch):
    """However small their files are: a posting is a row on the driver, of which a file says little."""
    plans = []

    def stored(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        df.write.parquet(path := str(tmp_path / f"{label}-{len(plans)}"))
        return spark.read.parquet(path)

    monkeypatch.setattr(near_dedup, "materialise", stored)
    monkeypatch.setattr("newsmood.llm.components.materialise", stored)
    classes = stored(spark.range(200).selectExpr(
        "id AS cls", "10L AS n_shingles", "transform(sequence(1, 32), i -> cast(id DIV 4 * 32 + i AS int)) AS payload"), "classes")
    stars = near_dedup.stars(classes)
    assert stars.count() == 200 and {r.cls - r.hub for r in stars.collect()} == {0, 1, 2, 3}
    found = components(stars.select(F.col("hub").alias("a"), F.col("cls").alias("b")))
    assert {(r.node, r.component) for r in found.collect()} == {(i, i // 4 * 4) for i in range(200)}
    joined = [plan for _, plan in plans if "Join" in plan]
    assert len(joined) >= 4 and not [plan for plan in joined if "Broadcast" in plan]
