"""SQL of the operators that compare sets and repair conversations, for small tables: plain definitions, no sketches."""

from __future__ import annotations


def components(words: int, percent: int) -> str:
    """(doc_id, n_shingles, component_id): shingle sets as lists, all pairs that share a shingle, all that is reachable."""
    return rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}),
                                                    lambda i: array_to_string(w[i:i + {words - 1}], ' '))) END AS sh FROM d),
        k AS (SELECT doc_id, len(sh) AS n, sh, CASE WHEN len(sh) > 0 THEN md5(array_to_string(list_sort(sh), chr(10))) END
                     AS key FROM s),
        c AS (SELECT key, any_value(n) AS n, any_value(sh) AS sh, min(doc_id) AS least FROM k WHERE key IS NOT NULL
              GROUP BY key),
        post AS (SELECT key, n, unnest(sh) AS x FROM c),
        pairs AS (SELECT a.key AS a, b.key AS b FROM post a JOIN post b ON a.x = b.x AND a.key < b.key
                  GROUP BY a.key, b.key, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach(key, other) AS (SELECT key, key FROM c UNION
                              SELECT r.key, p.b FROM reach r JOIN both_ways p ON r.other = p.a),
        top AS (SELECT r.key, min(c.least) AS component_id FROM reach r JOIN c ON c.key = r.other GROUP BY r.key)
        SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.key IS NULL THEN k.doc_id ELSE top.component_id END AS component_id
        FROM k LEFT JOIN top USING (key)"""


def near_duplicates(words: int, percent: int) -> str:
    return f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({components(words, percent)})"


NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}


def _way(cost: str, letters: str, then: str) -> str:
    return f"{{'c': {cost} + {then}.c, 's': '{letters}' || {then}.s}}"


def _with_inserts(q: str) -> str:
    one, two = NEXT[q], NEXT[NEXT[q]]
    ways = [f"g{q}"] + [f"CASE WHEN g{to} IS NOT NULL THEN {_way(str(5 * n), 'I' * n, f'g{to}')} END"
                        for n, to in ((1, one), (2, two))]
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1] AS f{q}"


def _without_inserts(q: str) -> str:
    kept = {"0": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[q]
    ways = [_way("2", "D", f"t.f{q}")]
    ways += [f"CASE WHEN NOT r.dead AND r.initial = '{to}' THEN {_way('r.more', 'K', f't.f{to}')} END" for to in kept]
    ways.append(f"CASE WHEN NOT r.dead THEN {_way('1 + r.more', 'R', f't.f{NEXT[q]}')} END")
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1] AS g{q}"


#: Best edits from the row after ``i`` to the end, for each state before it, from the last row backwards.
CONVERSATIONS = rf"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
        FROM conversations),
    sums AS (SELECT DISTINCT key, xor(list_reduce(
        list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: CAST(0 AS BIGINT))),
            lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS what
        FROM keyed),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
               CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN what = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM keyed JOIN sums USING (key) WHERE what <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i
               FROM damaged),
    faulty AS (
        SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?')
                    THEN 'truncated' ELSE '' END AS fault
        FROM placed),
    r AS (SELECT *, fault IN ('blank', 'duplicate') AS dead, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more,
                 lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM faulty),
    t(conv_id, i, f0, fs, fu, fa) AS (
        SELECT conv_id, max(i), {{'c': 0, 's': ''}}, {{'c': 10, 's': 'II'}}, {{'c': 5, 's': 'I'}}, {{'c': 0, 's': ''}}
        FROM r GROUP BY conv_id
        UNION ALL
        SELECT conv_id, i, {', '.join(_with_inserts(q) for q in NEXT)} FROM (
            SELECT t.conv_id, t.i - 1 AS i, {', '.join(_without_inserts(q) for q in NEXT)}
            FROM t JOIN r ON r.i = t.i AND r.conv_id IS NOT DISTINCT FROM t.conv_id)),
    best AS (SELECT conv_id, f0.c AS cost, f0.s AS audit FROM t WHERE i = 0),
    letters AS (SELECT conv_id, audit[j] AS edit, j FROM (
        SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)),
    at_row AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i FROM letters),
    kept AS (SELECT l.conv_id, l.j, l.edit, r.role, r.initial, CASE WHEN l.edit = 'I' THEN '' ELSE r.text END AS text,
                    row_number() OVER (PARTITION BY l.conv_id ORDER BY l.j) AS m
             FROM at_row l LEFT JOIN r ON r.i = l.i AND r.conv_id IS NOT DISTINCT FROM l.conv_id WHERE l.edit <> 'D'),
    led AS (SELECT *, CAST(coalesce(bool_or(m = 1 AND edit = 'K' AND initial = 's') OVER (PARTITION BY conv_id), false)
                           AS INTEGER) AS lead FROM kept),
    repaired AS (SELECT conv_id, string_agg(
        CASE WHEN edit = 'K' THEN role WHEN (m - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10)
        ORDER BY j) AS whole FROM led GROUP BY conv_id),
    counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                       count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                       count(*) FILTER (fault = 'truncated') AS truncated,
                       count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
    SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
           coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
           sha256(coalesce(whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) e
    LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM e.conv_id
    LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id
    LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM e.conv_id"""
