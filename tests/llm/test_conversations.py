import functools
import hashlib
import random
import re
import zlib

import pytest

from newsmood.llm import conversations, lattice

ROWS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def order(row):
    _, turn, role, text = row
    return turn is not None, turn or 0, role.encode(), hashlib.sha256(text.encode()).digest()[:16]


def cheapest(rows):
    """(cost, audit) by plain recursion over whole rows, copies included."""
    @functools.cache
    def best(i, q):
        ways = []
        if i == len(rows):
            if q in "0a":
                ways.append((0, ""))
        else:
            letter, dead, cut = rows[i]
            more = 5 if cut else 0
            ways.append((2, "D", best(i + 1, q)))
            if not dead:
                follow = "ua"[q == "u"]
                if letter == follow or (letter == "s" and q == "0"):
                    ways.append((more, "K", best(i + 1, letter)))
                ways.append((1 + more, "R", best(i + 1, follow)))
        one = "ua"[q == "u"]  # one insert, or two, at this place; a third never helps
        for n, to in ((1, one), (2, "ua"[one == "u"])):
            plain = plain_best(i, to)
            if plain is not None:
                ways.append((5 * n, "I" * n, plain))
        ways = [(w[0] + w[2][0], w[1] + w[2][1]) if len(w) == 3 else w for w in ways if len(w) == 2 or w[2]]
        return min(ways) if ways else None

    @functools.cache
    def plain_best(i, q):
        """Without an insert here."""
        if i == len(rows):
            return (0, "") if q in "0a" else None
        letter, dead, cut = rows[i]
        more, ways = 5 if cut else 0, [(2, "D", best(i + 1, q))]
        if not dead:
            follow = "ua"[q == "u"]
            if letter == follow or (letter == "s" and q == "0"):
                ways.append((more, "K", best(i + 1, letter)))
            ways.append((1 + more, "R", best(i + 1, follow)))
        ways = [(c + b[0], x + b[1]) for c, x, b in ways if b]
        return min(ways) if ways else None

    for i in range(len(rows), -1, -1):  # keeps the recursion shallow
        for q in "0sua":
            best(i, q)
    return best(0, "0")


def brute(rows):
    out, after = {}, {}
    for row in damage(rows):
        after.setdefault(row[0], []).append(row)
    for conv in {r[0] for r in rows}:
        mine = sorted(after.get(conv, []), key=order)
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            bare = text.rstrip(WHITE)
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                     else None if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(tuple(marked))
        lines, at, last = [], 0, "0"
        for edit in audit:
            if edit != "I":
                row, at = mine[at], at + 1
            if edit == "D":
                continue
            role, text = (None, "") if edit == "I" else row[2:]
            last = role[:1] if edit == "K" else "ua"[last == "u"]
            lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[last]}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(120):
        for turn in range(rng.choice([1, 2, 5, 8, 9, 30, 61])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "why", " \n", "", "Good?  ", "x" * 50 + ".", "plain\t", None, f"{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for t in range(40)]  # sound before the damage
    rows += [(501, 7, "user", "same.")] * 50 + [(None, None, None, None), (None, 3, "user", "a."), (None, 4, "assistant", "b.")]
    rows += [(502, t, "system", "Sys.") for t in (0, 10**12)]
    rng.shuffle(rows)
    return rows


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal",
                                                       "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("leaf, fan", [(2048, 512), (4, 3)])
def test_same_as_brute_force(spark, monkeypatch, leaf, fan):
    monkeypatch.setattr(conversations, "LEAF", leaf)  # the small ones take conversations apart, in several levels
    monkeypatch.setattr(conversations, "FAN", fan)
    rows = made()
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' AS conv", "'y' AS digest", "1 AS copies", "2 AS at")
    found = conversations.report(df, conversations.damaged(df))
    assert found.count() == len({r[0] for r in rows})
    assert got(found) == brute(rows)


def test_edits_are_whole_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi again."), (1, 3, "assistant", "cut off"),
            (1, 4, "assistant", "Yes."), (1, 5, "assistant", " ")]
    found = conversations.edits(spark.createDataFrame(rows, ROWS)).collect()
    assert [(r.turn, r.edit, r.fault, r.cost, r.role, r.text) for r in found] == [
        (0, "K", None, 0, "system", "Be kind."), (1, "D", None, 2, None, None), (2, "K", None, 0, "user", "Hi again."),
        (3, "D", "truncated", 2, None, None), (4, "K", None, 0, "assistant", "Yes."), (5, "D", "blank", 2, None, None)]


def test_no_rows_and_no_rows_left(spark):
    assert conversations.report(*[spark.createDataFrame([], ROWS)] * 2).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], ROWS)
    assert got(conversations.report(df, conversations.damaged(df))) == {
        gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_lattice_of_a_long_conversation_takes_linear_time(monkeypatch):
    rng = random.Random(4)
    steps = []

    class Path(list):
        def append(self, node):
            steps[-1] += 1
            super().append(node)

    monkeypatch.setattr(lattice, "Path", Path)
    for n in (2_000, 8_000):
        steps.append(0)
        codes = bytes(rng.choice([1, 2, 1, 2, 0, 3, 17, 5, 10]) for _ in range(n))
        found = conversations.leaf_lattice(codes, conversations.DONE, True)
        letters, end = found.trace(0)
        rows = tuple(("sua"[c & 3] if c & 3 < 3 else "x", bool(c & 12), bool(c & 16)) for c in codes[:600])
        short = conversations.leaf_lattice(codes[:600], conversations.DONE, True)
        assert (short.cost(0, 0), "".join(short.trace(0)[0])) == cheapest(rows)
        assert end in (0, 3) and sum(x != "I" for x in letters) == n
    assert steps[1] < 5 * steps[0]
