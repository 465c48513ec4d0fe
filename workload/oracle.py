"""The same queries in DuckDB SQL, over the same whole tables."""

from __future__ import annotations

from newsmood.constants import BOOSTERS_DOWN, BOOSTERS_UP, NEGATIONS, PUNCTUATION
from workload.fixtures import COUNTRY_TERMS, HEADLINE_SUBJECTS, IDIOMS, LEXICON_WORDS, RULE_WORDS, SUBJECTS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({columns})"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


_KEY = "strftime({0}, '%Y-%m-%d-%H') AS slot_key"
_FIRST = "TIMESTAMP '2025-01-01 00:00:00'"

_VIEWS = {
    "codes": "SELECT n_name AS name, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation",
    "articles": f"""
        SELECT d.doc_id, d.text AS title, d.lang AS language, s.s_name AS domain, n.n_name AS source_country,
               {_FIRST} + to_hours(CAST((d.doc_id % 6) * 4 AS INTEGER)) AS slot,
               {_FIRST} + to_hours(CAST((d.doc_id % 6) * 4 AS INTEGER)) + to_seconds(d.doc_id % 14400) AS seen
        FROM documents d
        JOIN supplier s ON s.s_suppkey = d.doc_id % (SELECT count(*) FROM supplier)
        JOIN nation n ON n.n_nationkey = s.s_nationkey""",
    "terms": "SELECT * FROM " + _values(
        [(n, w, len(set(t.split()))) for n, t in COUNTRY_TERMS.items() for w in set(t.split())], "country, word, n"),
    "subject_terms": "SELECT * FROM " + _values(
        [(s, w, len(set(s.split()))) for s in SUBJECTS for w in set(s.split())], "subject, word, n"),
    "title_words": r"""
        SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents""",
    "named": "SELECT doc_id, country FROM title_words JOIN terms USING (word) GROUP BY ALL HAVING count(*) = max(n)",
    "held": """
        SELECT doc_id, string_agg(subject, '|' ORDER BY subject) AS subjects FROM (
            SELECT doc_id, subject FROM title_words JOIN subject_terms USING (word)
            GROUP BY doc_id, subject HAVING count(*) = max(n)) GROUP BY doc_id""",
    "pairs": """
        SELECT a.*, t.country AS target_country, c.code AS target_code,
               CASE WHEN a.source_country = t.country THEN 'national' ELSE 'international' END AS scope
        FROM articles a JOIN named t ON t.doc_id = a.doc_id JOIN codes c ON c.name = t.country""",
    "mentions": """
        SELECT s.s_name AS domain, lpad(CAST(c.c_nationkey AS VARCHAR), 2, '0') AS code, count(*) AS cnt
        FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer c ON o_custkey = c_custkey GROUP BY ALL""",
    "ranks": """
        SELECT domain, code, rank, 1 / (ln(rank + 10) + 1) + 0.68 AS weight FROM (
            SELECT domain, code, CAST(row_number() OVER (PARTITION BY code ORDER BY cnt DESC, domain) AS DOUBLE)
                   AS rank FROM mentions)""",
    "authority": """
        SELECT s_name AS domain, CAST(CAST(floor(s_acctbal / 100) AS BIGINT) AS VARCHAR) AS domain_auth FROM supplier
        UNION ALL SELECT r_name, CAST(r_regionkey * 20 AS VARCHAR) FROM region""",
    "best": """
        SELECT domain, code AS country_code, weight FROM ranks
        QUALIFY row_number() OVER (PARTITION BY domain ORDER BY rank, code) = 1""",
    "domain_info": """
        SELECT m.domain, b.country_code, coalesce(b.weight, 0.0) AS domain_weight, m.codes,
               CAST(a.domain_auth AS INTEGER) AS domain_auth
        FROM (SELECT domain, count(*) AS codes FROM mentions GROUP BY domain) m
        LEFT JOIN best b USING (domain) LEFT JOIN authority a USING (domain)""",
    "relevant": """
        SELECT m.domain, m.code FROM mentions m JOIN domain_info i USING (domain)
        WHERE m.cnt > 40 OR i.domain_weight >= 0.966""",
    "raw_scores": """
        SELECT vec_id, 'NATION_' || label AS target_country, 'NATION_' || label AS source_country,
               'headline ' || vec_id AS title, 'site' || (vec_id % 7) AS domain,
               CASE WHEN (vec_id // 6) % 2 = 0 THEN 'national' ELSE 'international' END AS scope,
               TIMESTAMP '2025-01-01 00:00:00' + to_hours(CAST((vec_id % 6) * 4 AS INTEGER)) AS slot,
               t1, t2, t3,
               exp(2 * t1 - 2 * greatest(t1, t2, t3)) AS x1, exp(2 * t2 - 2 * greatest(t1, t2, t3)) AS x2,
               exp(2 * t3 - 2 * greatest(t1, t2, t3)) AS x3, round(tanh(h1 - h2), 4) AS c
        FROM folded""",
    "folded": "SELECT vec_id, label, " + ", ".join(
        f"list_sum(list_transform(list_filter(range(1, len(embedding) + 1), lambda i: i % {of} = {rest % of}), "
        f"lambda i: CAST(embedding[i] AS DOUBLE))) AS {name}{rest}"
        for of, name in ((3, "t"), (2, "h")) for rest in range(1, of + 1)) + " FROM embeddings",
    "subject_rows": " UNION ALL ".join(
        f"SELECT vec_id, '{s}' AS subject FROM folded WHERE t{i} > 0" for i, s in enumerate(HEADLINE_SUBJECTS, 1)),
    "wide": """
        SELECT *, row_number() OVER (PARTITION BY target_country, slot, scope ORDER BY vec_id) - 1 AS pos,
               round(x1 / (x1 + x2 + x3), 4) AS cneg, round(x2 / (x1 + x2 + x3), 4) AS cneu,
               round(x3 / (x1 + x2 + x3), 4) AS cpos,
               greatest(-c, 0) AS lneg, greatest(c, 0) AS lpos,
               round(1 - greatest(c, 0) - greatest(-c, 0), 4) AS lneu
        FROM raw_scores""",
    "labelled": """
        SELECT target_country, slot, scope, vec_id, 'lexicon' AS model,
               CASE WHEN c <= -0.05 THEN 'negative' WHEN c >= 0.05 THEN 'positive' ELSE 'neutral' END AS label
        FROM wide UNION ALL
        SELECT target_country, slot, scope, vec_id, 'classifier',
               CASE WHEN tanh(cpos - cneg) <= -0.05 THEN 'negative' WHEN tanh(cpos - cneg) >= 0.05 THEN 'positive'
                    ELSE 'neutral' END FROM wide""",
    "counts": """
        SELECT target_country, slot, scope, model, count(*) FILTER (label = 'negative') AS negative,
               count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (label = 'positive') AS positive
        FROM labelled GROUP BY ALL""",
    "silent": "SELECT n_name AS target_country FROM nation WHERE n_name NOT IN (SELECT target_country FROM wide)",
    "nested_keys": f"""
        SELECT target_country, slot, count(*) FILTER (scope = 'national') AS nat,
               count(*) FILTER (scope = 'international') AS inter
        FROM wide GROUP BY ALL UNION ALL SELECT target_country, {_FIRST}, 0, 0 FROM silent""",
    "events_labelled": """
        SELECT *, CASE WHEN tanh((value - 35) / 50) <= -0.05 THEN 'negative'
                       WHEN tanh((value - 35) / 50) >= 0.05 THEN 'positive' ELSE 'neutral' END AS label
        FROM events""",
    "lexicon": "SELECT * FROM " + _values(LEXICON_WORDS, "token, valence"),
}

_NEEDS = {
    "named": ["title_words", "terms"], "held": ["title_words", "subject_terms"], "raw_scores": ["folded"],
    "subject_rows": ["folded"],
    "pairs": ["articles", "named", "codes"], "ranks": ["mentions"], "best": ["ranks"],
    "domain_info": ["mentions", "best", "authority"], "relevant": ["mentions", "domain_info"],
    "wide": ["raw_scores"], "labelled": ["wide"], "counts": ["labelled"], "silent": ["wide"],
    "nested_keys": ["wide", "silent"],
}


def _with(names: list[str], body: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in order) + "\n" + body


_CELLS = [("lexicon", "national", "lexicon_nat"), ("classifier", "national", "classifier_nat"),
          ("lexicon", "international", "lexicon_int"), ("classifier", "international", "classifier_int")]
_LABELS = ["negative", "neutral", "positive"]


def _cell_sums() -> str:
    return ", ".join(
        f"CAST(sum({lab}) FILTER (model = '{m}' AND scope = '{s}') AS BIGINT) AS {n}_{lab}"
        for m, s, n in _CELLS for lab in _LABELS)


def _net(neg="negative", neu="neutral", pos="positive") -> str:
    return f"round(({pos} - {neg}) / nullif(CAST({neu} + abs({pos} - {neg}) AS DOUBLE), 0), 6)"


def _six(alias: str = "") -> str:
    return ", ".join(f"count(*) FILTER ({alias}model = '{m}' AND {alias}label = '{lab}') AS {m}_{lab}"
                     for m in ("lexicon", "classifier") for lab in _LABELS)


def _gap_sums() -> str:
    parts = []
    tests = {"negative": "toxic = 1", "positive": "toxic <> 1 AND quality = 1",
             "neutral": "toxic <> 1 AND quality <> 1"}
    for lab in _LABELS:
        n = f"count(*) FILTER (l.doc_id IS NOT NULL AND {tests[lab]})"
        parts.append(f"CASE WHEN count(l.doc_id) = count(*) THEN {n} END AS strict_{lab}")
        parts.append(f"{n} AS lenient_{lab}")
    return ", ".join(parts)


def _nested_sums() -> str:
    parts = []
    for column, scope in (("senti_count_nat", "national"), ("senti_count_int", "international")):
        for i, model in ((1, "lexicon"), (2, "classifier")):
            for lab in _LABELS:
                parts.append(f"CAST(coalesce(sum({lab}) FILTER (model = '{model}' AND scope = '{scope}'), 0) "
                             f"AS BIGINT) AS {column}_{i}_{lab}")
        parts += [f"CAST(NULL AS BIGINT) AS {column}_3_{lab}" for lab in _LABELS]
    return ", ".join(parts)


def _composite(name: str) -> str:
    fields = " || ',' || ".join(f"{name}_{lab}" for lab in _LABELS)
    return f"coalesce('\"(' || {fields} || ')\"', 'null')"


def _spoken() -> str:
    text = "text"
    for old, new in RULE_WORDS:
        text = f"replace({text}, {_q(f' {old} ')}, {_q(f' {new} ')})"
    return text


def _lexicon_ctes(spoken: str, idioms: str) -> str:
    """The rules step by step, over (doc_id, text) with phrases (phrase, value)."""
    marks = "|".join("".join("\\" + c if c in ".?-" else c for c in p)
                     for p in sorted(PUNCTUATION, key=len, reverse=True)).replace("'", "''")
    word = "[^[:punct:]\\s]{2,}"
    up, down, neg = _in(BOOSTERS_UP), _in(BOOSTERS_DOWN), _in(NEGATIONS)

    def shouted(w: str) -> str:
        return f"({w} = upper({w}) AND {w} <> lower({w}))"

    def degree(k: int) -> str:
        w, v = f"p{k}", f"s{k - 1}"
        base = f"CASE WHEN lower({w}) IN {up} THEN 0.293 WHEN lower({w}) IN {down} THEN -0.293 END"
        return (f"coalesce(({base}) * CASE WHEN {v} < 0 THEN -1 ELSE 1 END + CASE WHEN mixed AND {shouted(w)} "
                f"THEN CASE WHEN {v} > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END, 0)")

    def negated(k: int) -> str:
        return f"(lower(p{k}) IN {neg} OR contains(lower(p{k}), 'n''t'))"

    def step(k: int, damp: str, never: str, name: str) -> str:
        factor = f"CASE {never} WHEN {negated(k)} THEN -0.74 ELSE 1 END"
        return (f"st{k} AS (SELECT *, CASE WHEN p{k} IS NOT NULL AND k{k} IS NULL THEN (s{k - 1} + {damp} * "
                f"{degree(k)}) * {factor} ELSE s{k - 1} END AS {name} FROM {'st' + str(k - 1)})")

    orders = [("word", "n1", "n2"), ("word", "n1"), ("p1", "word"), ("p2", "p1", "word"), ("p2", "p1"),
              ("p3", "p2", "p1"), ("p3", "p2")]
    phrases = "coalesce(" + ", ".join(
        f"(SELECT value FROM idioms WHERE phrase = {joined})" for joined in (" || ' ' || ".join(o) for o in orders)) + ")"
    weak = _in(["kind of", "sort of", "just enough"])
    return f"""
    lexicon AS ({_VIEWS['lexicon']}),
    spoken AS ({spoken}),
    idioms AS ({idioms}),
    split AS (SELECT doc_id, text, list_transform(
        list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 1),
        lambda w: regexp_replace(regexp_replace(w, '^(?:{marks})({word})$', '\\1'),
                                 '^({word})(?:{marks})$', '\\1')) AS w FROM spoken),
    facts AS (SELECT doc_id, w, len(w) AS n,
        len(list_filter(w, lambda x: {shouted('x')})) AS n_shouted,
        coalesce(list_position(list_transform(w, lambda x: lower(x)), 'but'), 0) AS but_at,
        least(length(text) - length(replace(text, '!', '')), 4) * 0.292
        + CASE WHEN length(text) - length(replace(text, '?', '')) <= 1 THEN 0
               WHEN length(text) - length(replace(text, '?', '')) <= 3
               THEN (length(text) - length(replace(text, '?', ''))) * 0.18 ELSE 0.96 END AS emphasis FROM split),
    words AS (SELECT doc_id, n_shouted > 0 AND n_shouted < n AS mixed, but_at, unnest(w) AS word,
                     unnest(range(1, n + 1)) AS i FROM facts),
    near AS (SELECT *, lag(word, 1) OVER o AS p1, lag(word, 2) OVER o AS p2, lag(word, 3) OVER o AS p3,
                    lead(word, 1) OVER o AS n1, lead(word, 2) OVER o AS n2
             FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    st0 AS (SELECT near.*, l0.valence AS v, l1.token AS k1, l2.token AS k2, l3.token AS k3,
        lower(word) NOT IN {up} AND lower(word) NOT IN {down}
        AND NOT (lower(word) = 'kind' AND coalesce(lower(n1), '') = 'of') AS plain,
        CASE WHEN lower(word) NOT IN {up} AND lower(word) NOT IN {down}
             AND NOT (lower(word) = 'kind' AND coalesce(lower(n1), '') = 'of') THEN l0.valence
             + CASE WHEN mixed AND {shouted('word')} THEN CASE WHEN l0.valence > 0 THEN 0.733 ELSE -0.733 END
                    ELSE 0 END END AS s0
        FROM near LEFT JOIN lexicon l0 ON lower(word) = l0.token LEFT JOIN lexicon l1 ON lower(p1) = l1.token
        LEFT JOIN lexicon l2 ON lower(p2) = l2.token LEFT JOIN lexicon l3 ON lower(p3) = l3.token),
    {step(1, '1', '', 's1')},
    {step(2, '0.95', "WHEN p2 = 'never' AND p1 IN ('so', 'this') THEN 1.5", 's2')},
    {step(3, '0.9', "WHEN p3 = 'never' AND (p2 IN ('so', 'this') OR p1 IN ('so', 'this')) THEN 1.25", 'r3')
     .replace('st3 AS', 'st3r AS')},
    st3 AS (SELECT *, CASE WHEN p3 IS NOT NULL AND k3 IS NULL THEN CASE WHEN plain AND v IS NOT NULL THEN coalesce({phrases}, r3)
        + CASE WHEN concat(p3, ' ', p2) IN {weak} OR concat(p2, ' ', p1) IN {weak} THEN -0.293 ELSE 0 END END
        ELSE r3 END AS s3 FROM st3r),
    done AS (SELECT doc_id, coalesce(s3
        * CASE WHEN lower(p1) = 'least' AND k1 IS NULL AND coalesce(lower(p2), '') NOT IN ('at', 'very')
               THEN -0.74 ELSE 1 END
        * CASE WHEN but_at > 0 AND i < but_at THEN 0.5 WHEN but_at > 0 AND i > but_at THEN 1.5 ELSE 1 END, 0)
        AS s FROM st3),
    sums AS (SELECT doc_id, count(*) AS n, round(sum(s), 9) AS total,
        round(sum(CASE WHEN s > 0 THEN s + 1 ELSE 0 END), 9) AS up,
        round(sum(CASE WHEN s < 0 THEN 1 - s ELSE 0 END), 9) AS down, count(*) FILTER (s = 0) AS flat
        FROM done GROUP BY doc_id),
    loud AS (SELECT f.doc_id, coalesce(s.n, 0) AS n, coalesce(flat, 0) AS flat,
        CASE WHEN total > 0 THEN total + emphasis WHEN total < 0 THEN total - emphasis ELSE coalesce(total, 0) END AS t,
        CASE WHEN up > down THEN up + emphasis ELSE up END AS u,
        CASE WHEN down > up THEN down + emphasis ELSE down END AS d
        FROM facts f LEFT JOIN sums s USING (doc_id)),
    lexicon_scores AS (SELECT doc_id, CASE WHEN n > 0 THEN round(d / (u + d + flat), 3) ELSE 0 END AS neg,
           CASE WHEN n > 0 THEN round(flat / (u + d + flat), 3) ELSE 0 END AS neu,
           CASE WHEN n > 0 THEN round(u / (u + d + flat), 3) ELSE 0 END AS positive,
           round(t / sqrt(t * t + 15), 4) AS compound
    FROM loud)"""


def _lexicon_rules() -> str:
    ctes = _lexicon_ctes(f"SELECT doc_id, {_spoken()} AS text FROM documents",
                         f"SELECT * FROM {_values(IDIOMS.items(), 'phrase, value')}")
    return f"WITH {ctes} SELECT * FROM lexicon_scores"


def _phrase_rules() -> str:
    runs = " UNION ".join(
        f"SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS phrase"
        " FROM (SELECT string_split_regex(text, '\\s+') AS w FROM documents)" for n in (2, 3))
    ctes = _lexicon_ctes("SELECT doc_id, text FROM documents",
                         f"SELECT phrase, length(phrase) % 9 - 4.5 AS value FROM ({runs})")
    return f"WITH {ctes} SELECT * FROM lexicon_scores"


_URL = "'http://news.example/' || doc_id"
_RELEVANT = """EXISTS (SELECT 1 FROM relevant r WHERE r.domain = p.domain AND
    ((p.scope = 'national' AND r.code = p.target_code) OR (p.scope = 'international' AND r.code <> p.target_code)))"""


def _load(where: str = "true") -> str:
    """The whole load; ``where`` picks slots out of the fact."""
    english = "CASE WHEN lang = 'en' THEN text ELSE '[en] ' || text END AS text"
    ctes = _lexicon_ctes(f"SELECT doc_id, {english} FROM documents", "SELECT '' AS phrase, 0.0 AS value WHERE false")
    return _with(["pairs", "held", "relevant"], f""",
    matched AS (SELECT p.*, h.subjects FROM pairs p JOIN held h USING (doc_id)),
    first_seen AS (SELECT * FROM matched QUALIFY row_number() OVER (
        PARTITION BY target_country, scope, slot, title ORDER BY seen, {_URL}) = 1),
    flagged AS (SELECT p.*, {_RELEVANT} AS relevant FROM first_seen p),
    whole AS (SELECT *, bool_or(relevant) OVER (PARTITION BY target_country, scope, slot) AS any_here,
                     bool_or(scope = 'national') OVER s AND bool_or(scope = 'international') OVER s AS complete
              FROM flagged WINDOW s AS (PARTITION BY target_country, slot)),
    kept AS (SELECT *, CASE WHEN language = 'en' THEN title ELSE '[en] ' || title END AS shown FROM whole w
             WHERE (relevant OR NOT any_here) AND complete AND (language = 'en' OR EXISTS (
                 SELECT 1 FROM documents d JOIN labels l ON l.doc_id = d.doc_id
                 WHERE d.lang = w.language AND d.text = w.title))),
    {ctes},
    raw AS (SELECT *, exp((length(shown) % 5) / 2) AS a, exp((length(shown) % 3) / 2) AS b,
                   exp((length(shown) % 7) / 2) AS c FROM kept),
    p AS (SELECT *, round(a / (a + b + c), 4) AS neg, round(b / (a + b + c), 4) AS neu,
                 round(c / (a + b + c), 4) AS positive FROM raw),
    fact AS (SELECT k.*, 'lexicon' AS model, round(s.neg, 4) AS neg, round(s.neu, 4) AS neu,
                    round(s.positive, 4) AS positive, round(s.compound, 6) AS compound
             FROM kept k JOIN lexicon_scores s USING (doc_id) UNION ALL
             SELECT * EXCLUDE (a, b, c, neg, neu, positive), 'classifier', neg, neu, positive,
                    round((positive - neg) / (neu + 1), 6) FROM p)
    SELECT target_country, {_KEY.format("slot")}, scope, model, sha256(shown) AS title_sha, domain, source_country, subjects,
           neg, neu, positive, compound, strftime(slot, '%Y%m%d') AS day FROM fact WHERE {where}""")


_K = _KEY.format("slot")
_TOKENS = "unnest(regexp_extract_all(lower({0}), '\\p{{L}}+'))"
_SLOT_OF = "time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01')"
_EVENT_COUNTS = f"""
    SELECT {_KEY.format(_SLOT_OF)}, event_type, count(*) FILTER (label = 'negative') AS negative,
           count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (label = 'positive') AS positive
    FROM events_labelled GROUP BY ALL"""


def _outlets() -> str:
    """Records by absolute position in the page's text, values after the last token that contains a key."""
    def last(key: str) -> str:
        return f"list_max(list_filter(range(2, len(t) + 1), lambda j: contains(t[j], '{key}')))"

    def value(key: str, offset: int) -> str:
        return f"coalesce(t[{last(key)} + {offset}], '')"

    def plain(key: str) -> str:
        v = value(key, 2)
        return (f"CASE WHEN contains({v}, 'Twitter') THEN left({v}, length({v}) - 7) "
                f"WHEN contains({v}, 'Instagram') THEN left({v}, length({v}) - 9) ELSE {v} END")

    return f"""
    WITH page AS (SELECT page_id, html, length(html) AS size,
                         regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages),
    txt AS (SELECT page_id, replace(replace(replace(html, '</p>', '</p> Media Outlet www.' || host
        || ' Facebook Followers 12M Frequency 1 post/week Domain Authority ' || ((size + page_id) % 100) || ' '),
        '<p>', ' Media Outlet ' || host || ' Facebook Followers ' || size || 'KTwitter Twitter Followers ' || page_id
        || 'MInstagram Instagram Followers 7K Frequency ' || (size % 30) || ' posts/day Domain Authority '
        || (size % 100) || ' <p>'), chr(10), ' ')
        || ' Media Outlet bbc.com Domain Authority 95 Media Outlet blank.example nothing here'
        || ' Media Outlet Contact us Media Outlet late.example Domain Authority 99 ' AS text FROM page),
    parts AS (SELECT page_id, text, string_split(text, 'Media Outlet') AS p FROM txt),
    marks AS (SELECT page_id, text, unnest(range(1, len(p))) AS k, p FROM parts),
    cut AS (SELECT page_id, k - 1 AS record, string_split(
        substr(text, length(array_to_string(p[1:k], 'Media Outlet')) + 14, 157), ' ') AS t FROM marks),
    live AS (SELECT * FROM cut QUALIFY record < coalesce(
        min(CASE WHEN t[1] = 'Contact' THEN record END) OVER (PARTITION BY page_id), 1000000))
    SELECT page_id, record, t[1] AS domain, {plain('Facebook')} AS facebook_fol, {plain('Twitter')} AS twitter_fol,
           {plain('Instagram')} AS insta_fol, {value('Frequency', 1)} || {value('Frequency', 2)} AS freq_post,
           {value('Domain', 2)} AS domain_auth
    FROM live
    WHERE TRY_CAST({value('Domain', 2)} AS INTEGER) >= 60 AND t[1] NOT IN ('nytimes.com', 'bbc.com')"""


ORACLE = {
    "label_counts": _with(["labelled"], f"SELECT {_six()} FROM labelled"),
    "label_counts_by_group": _with(
        ["counts"], f"SELECT target_country, {_K}, scope, model, negative, neutral, positive FROM counts"),
    "label_counts_sql": _with(["counts"], """
        SELECT target_country, model, CAST(sum(negative) AS BIGINT) AS negative,
               CAST(sum(neutral) AS BIGINT) AS neutral, CAST(sum(positive) AS BIGINT) AS positive
        FROM counts GROUP BY ALL"""),
    "counts_by_country_slot": _with(
        ["counts"], f"SELECT target_country, {_K}, {_cell_sums()} FROM counts GROUP BY target_country, slot"),
    "counts_by_country": _with(
        ["counts"], f"SELECT target_country, {_cell_sums()} FROM counts GROUP BY target_country"),
    "counts_one_country": _with(["counts"], f"""
        SELECT target_country, {_K}, {_cell_sums()} FROM counts
        WHERE target_country = (SELECT n_name FROM nation WHERE n_nationkey = 3) AND target_country <> 'none'
        GROUP BY target_country, slot"""),
    "counts_unknown_code": _with(
        ["counts"], f"SELECT target_country, {_K}, {_cell_sums()} FROM counts GROUP BY target_country, slot"),
    "counts_missing_model": f"""
        SELECT d.lang, CAST(floor(d.n_chars / 250) AS BIGINT) AS size_class, {_gap_sums()}
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2""",
    "avg_scores": _with(["wide"], """
        SELECT round(avg(lneg), 6) AS lexicon_neg, round(avg(lneu), 6) AS lexicon_neu,
               round(avg(lpos), 6) AS lexicon_pos, round(avg(c), 6) AS lexicon_compound,
               round(avg(cneg), 6) AS classifier_neg, round(avg(cneu), 6) AS classifier_neu,
               round(avg(cpos), 6) AS classifier_pos, round(tanh(avg(cneg) - avg(cpos)), 6) AS classifier_polarity
        FROM wide"""),
    "headline_total": _with(["wide"], "SELECT count(*) AS headline_amount FROM wide WHERE scope = 'national'"),
    "headline_count_since": _with(["wide"], """
        SELECT count(*) AS headline_amount FROM wide
        WHERE scope = 'national' AND slot >= TIMESTAMP '2025-01-01 12:00:00'"""),
    "nested_label_counts": _with(["labelled"], f"SELECT {_six()} FROM labelled WHERE scope = 'national'"),
    "nested_counts_by_country": _with(
        ["counts"], f"SELECT target_country, {_nested_sums()} FROM counts GROUP BY target_country"),
    "rows_per_country": _with(
        ["nested_keys"], "SELECT target_country, count(*) AS rows FROM nested_keys GROUP BY ALL"),
    "rows_per_country_day": _with(["nested_keys"], """
        SELECT target_country, strftime(slot, '%Y%m%d') AS day, count(*) AS rows FROM nested_keys GROUP BY ALL"""),
    "headline_lengths": _with(["nested_keys"], f"""
        SELECT target_country, {_K}, nullif(nat, 0) AS head_nat, nullif(inter, 0) AS head_int FROM nested_keys"""),
    "scores_per_headline": _with(["wide"], f"""
        SELECT target_country, {_K}, pos, title, c AS lexicon_compound,
               round(tanh(cpos - cneg), 6) AS classifier_polarity FROM wide WHERE scope = 'national'"""),
    "pair_models": _with(["wide"], f"""
        SELECT target_country, {_K}, pos, title, c AS lexicon_compound,
               round((cpos - cneg) / (cneu + 1), 6) AS classifier_compound FROM wide WHERE scope = 'international'"""),
    "second_model_slice": _with(["wide"], f"""
        SELECT target_country, {_K}, count(*) AS n, round(sum(cneg), 4) AS neg, round(sum(cpos), 4) AS pos
        FROM wide WHERE scope = 'national' GROUP BY target_country, slot"""),
    "nested_roundtrip": _with(["wide"], f"""
        SELECT target_country, {_K}, scope, pos, title, domain, source_country, 'lexicon' AS model, lneg AS neg,
               lneu AS neu, lpos AS positive, round(c, 6) AS compound FROM wide UNION ALL
        SELECT target_country, {_K}, scope, pos, title, domain, source_country, 'classifier', cneg, cneu, cpos,
               round((cpos - cneg) / (cneu + 1), 6) FROM wide"""),
    "softmax_scores": _with(["wide"], "SELECT vec_id, cneg AS neg, cneu AS neu, cpos AS pos FROM wide"),
    "three_class_compound": _with(
        ["wide"], "SELECT vec_id, round((cpos - cneg) / (cneu + 1), 6) AS compound FROM wide"),
    "net_score_series": _with(["counts"], f"""
        SELECT *, {_net()} AS net FROM (
            SELECT target_country, {_K}, CAST(sum(negative) AS BIGINT) AS negative,
                   CAST(sum(neutral) AS BIGINT) AS neutral, CAST(sum(positive) AS BIGINT) AS positive
            FROM counts WHERE scope = 'international' GROUP BY target_country, slot)"""),
    "net_score_total": _with(["counts"], f"""
        SELECT *, {_net()} AS net FROM (
            SELECT target_country, CAST(sum(negative) AS BIGINT) AS negative,
                   CAST(sum(neutral) AS BIGINT) AS neutral, CAST(sum(positive) AS BIGINT) AS positive
            FROM counts WHERE scope = 'national' GROUP BY target_country)"""),
    "region_scores": _with(["counts", "codes"], f"""
        SELECT c.code || '_' || r.r_name AS region_name,
               CASE WHEN t.target_country IS NULL THEN -500.0 ELSE {_net()} END AS sentiment
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN codes c ON c.name = n.n_name
        LEFT JOIN (SELECT target_country, sum(negative) AS negative, sum(neutral) AS neutral,
                          sum(positive) AS positive
                   FROM counts WHERE scope = 'international' GROUP BY 1) t ON t.target_country = n.n_name"""),
    "country_slot_map": _with(
        ["counts"], f"SELECT target_country, {_K}, {_cell_sums()} FROM counts GROUP BY target_country, slot"),
    "response_rows": _with(["counts", "codes"], f"""
        SELECT target_country, slot_key, '["' || code || '",' || {_composite('lexicon_nat')} || ','
               || {_composite('classifier_nat')} || ',' || {_composite('lexicon_int')} || ','
               || {_composite('classifier_int')} || ',"' || slot_key || '","' || target_country || '"]' AS response
        FROM (SELECT target_country, {_K}, {_cell_sums()} FROM counts GROUP BY target_country, slot)
        JOIN codes ON name = target_country"""),
    "composite_parse": _with(["counts"], f"""
        SELECT target_country, {_K}, scope, model,
               '(' || negative || ',' || neutral || ',' || positive || ')' AS composite,
               negative AS n0, neutral AS n1, positive AS n2 FROM counts"""),
    "subject_match": _with(
        ["pairs", "held"], "SELECT p.doc_id, target_country, subjects FROM pairs p JOIN held h ON h.doc_id = p.doc_id"),
    "scope_split": _with(["pairs"], """
        SELECT target_country, scope, CASE WHEN scope = 'international' THEN '-' ELSE '' END || target_country
               AS query_name, count(*) AS articles, target_country AS plain_name
        FROM pairs GROUP BY target_country, scope"""),
    "both_scope_rows": _with(["pairs"], f"""
        SELECT target_country, {_K}, count(*) AS articles FROM pairs GROUP BY target_country, slot
        HAVING count(DISTINCT scope) = 2"""),
    "dedup_titles": _with(["pairs"], f"""
        SELECT target_country, scope, {_K}, min(doc_id) AS doc_id FROM pairs
        GROUP BY target_country, scope, slot, title"""),
    "cap_per_group": _with(["pairs"], f"""
        SELECT target_country, scope, {_K}, doc_id FROM pairs
        QUALIFY row_number() OVER (PARTITION BY target_country, scope, slot ORDER BY seen DESC, doc_id) <= 10"""),
    "relevant_articles": _with(["pairs", "relevant"], f"""
        SELECT target_country, scope, {_K}, doc_id, relevant FROM (
            SELECT *, bool_or(relevant) OVER (PARTITION BY target_country, scope, slot) AS any_here FROM (
                SELECT p.*, EXISTS (SELECT 1 FROM relevant r WHERE r.domain = p.domain AND
                    ((p.scope = 'national' AND r.code = p.target_code)
                     OR (p.scope = 'international' AND r.code <> p.target_code))) AS relevant FROM pairs p))
        WHERE relevant OR NOT any_here"""),
    "relevance_counters": _with(["pairs", "relevant"], """
        SELECT target_country, scope, count(*) FILTER (relevant) AS kept, count(*) FILTER (NOT relevant) AS removed
        FROM (SELECT p.*, EXISTS (SELECT 1 FROM relevant r WHERE r.domain = p.domain AND
                  ((p.scope = 'national' AND r.code = p.target_code)
                   OR (p.scope = 'international' AND r.code <> p.target_code))) AS relevant FROM pairs p)
        GROUP BY ALL"""),
    "language_volume": _with(["articles"], """
        SELECT lower(language) AS language, count(*) AS titles, CAST(sum(length(title)) AS BIGINT) AS chars
        FROM articles GROUP BY 1"""),
    "translated_titles": _with(["articles"], """
        SELECT doc_id, language, domain,
               CASE WHEN language = 'en' THEN title ELSE '[en] ' || title END AS title
        FROM articles a WHERE language = 'en' OR EXISTS (
            SELECT 1 FROM documents d JOIN labels l ON l.doc_id = d.doc_id
            WHERE d.lang = a.language AND d.text = a.title)"""),
    "slot_window": """
        SELECT event_type,
               count(*) FILTER (ts >= TIMESTAMP '2024-01-15 04:00:00' AND ts < TIMESTAMP '2024-01-15 08:00:00')
               AS in_slot,
               count(*) FILTER (ts >= TIMESTAMP '2024-01-14 08:00:00' AND ts < TIMESTAMP '2024-01-15 08:00:00')
               AS in_day FROM events GROUP BY event_type""",
    "slot_series": f"""
        WITH series AS (SELECT (SELECT min({_SLOT_OF}) FROM events) + to_hours(CAST(i * 4 AS INTEGER)) AS slot
                        FROM range(58) AS r(i))
        SELECT {_KEY.format('s.slot')}, count(e.event_id) AS events
        FROM series s LEFT JOIN events e ON e.ts >= s.slot AND e.ts < s.slot + INTERVAL 4 HOUR GROUP BY s.slot""",
    "time_keys": """
        SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS second_key, strftime(ts, '%Y-%m-%d-%H') AS hour_key,
               strftime(ts, '%Y%m%d') AS day_key, strftime(ts - INTERVAL 1 DAY, '%Y%m%d%H%M%S') AS day_before,
               strftime(ts - INTERVAL 4 HOUR, '%Y%m%d%H%M%S') AS slot_before,
               strftime(date_trunc('hour', ts), '%Y%m%d%H%M%S') AS hour_start,
               CAST(floor(epoch(ts)) AS BIGINT) AS epoch, strftime(ts, '%Y%m%d%H%M%S') AS epoch_back
        FROM events""",
    "pending_slots": _with(["counts"], f"""
        SELECT target_country, {_K} FROM (
            SELECT n_name AS target_country, slot FROM nation, (
                SELECT DISTINCT slot FROM counts UNION ALL SELECT max(slot) + INTERVAL 4 HOUR FROM counts)
            EXCEPT SELECT target_country, slot FROM counts GROUP BY 1, 2 HAVING count(DISTINCT scope) = 2)"""),
    "domain_mentions": _with(["mentions"], """
        SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY code) - 1 AS INTEGER) AS place, code,
               CAST(cnt AS BIGINT) AS cnt FROM mentions"""),
    "domain_weight": _with(["ranks"], "SELECT domain, code, rank, round(weight, 6) AS weight FROM ranks"),
    "domain_best_rank": _with(["domain_info"], """
        SELECT domain, country_code, round(domain_weight, 6) AS domain_weight, codes AS countries FROM domain_info"""),
    "domain_authority": _with(
        ["domain_info"], "SELECT domain, '20250101000000' AS change_date, domain_auth FROM domain_info"),
    "domain_authority_missing": _with(["mentions", "authority"], """
        SELECT domain, domain_auth FROM authority WHERE domain NOT IN (SELECT domain FROM mentions)"""),
    "relevant_domains_national": _with(["relevant"], "SELECT code AS target_code, domain FROM relevant"),
    "relevant_domains_international": _with(["relevant", "codes"], """
        SELECT c.code AS target_code, count(DISTINCT r.domain) AS domains
        FROM codes c LEFT JOIN relevant r ON r.code <> c.code GROUP BY 1"""),
    "domains_for_country": _with(["relevant"], """
        SELECT DISTINCT domain, 'national' AS scope FROM relevant WHERE code = '07' UNION ALL
        SELECT DISTINCT domain, 'international' FROM relevant WHERE code <> '07'"""),
    "heavy_domains": _with(["mentions", "domain_info"], """
        SELECT DISTINCT domain, 'anywhere' AS kind FROM mentions JOIN domain_info USING (domain)
        WHERE cnt > 38 AND domain_weight > 0.1 UNION ALL
        SELECT DISTINCT domain, 'one country' FROM mentions JOIN domain_info USING (domain)
        WHERE cnt > 25 AND code = '07' AND domain_weight >= 0.5"""),
    "country_code_lookup": _with(["codes"], """
        SELECT country, coalesce(code, country) AS country_code, regexp_replace(country, '\\s+', '', 'g') AS squeezed
        FROM (SELECT n_name AS country FROM nation UNION ALL
              SELECT CASE r_name WHEN 'ASIA' THEN 'NATION_3' WHEN 'EUROPE' THEN 'EU ROPE' ELSE r_name END FROM region)
        LEFT JOIN codes ON name = country"""),
    "code_to_country": _with(["codes"], """
        SELECT u.code, customers, coalesce(c.name, 'World') AS country
        FROM (SELECT lpad(CAST(c_nationkey + CAST(floor(c_acctbal / 500) AS BIGINT) AS VARCHAR), 2, '0') AS code,
                     count(*) AS customers FROM customer GROUP BY 1) u LEFT JOIN codes c ON c.code = u.code"""),
    "registered_codes": _with(["domain_info"], "SELECT count(country_code) AS codes FROM domain_info"),
    "unique_domains": _with(["mentions"], "SELECT DISTINCT domain FROM mentions"),
    "batch_names": """
        SELECT event_id, replace('processed_batch_' || strftime(ts, '%Y-%m-%d %H:%M:%S'), ':', '_') AS name
        FROM events""",
    "try_casts": """
        SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand_no,
               TRY_CAST(p_brand AS INTEGER) AS no_number, p_retailprice AS price FROM part""",
    "mask_handles": """
        SELECT doc_id, array_to_string(list_transform(
            string_split('@' || source || ' @ ' || text || ' http://' || source || '.example/' || doc_id, ' '),
            lambda t: CASE WHEN starts_with(t, '@') AND length(t) > 1 THEN '@user'
                           WHEN starts_with(t, 'http') THEN 'http' ELSE t END), ' ') AS masked
        FROM documents""",
    "token_counts": f"""
        SELECT token, count(*) AS n FROM (SELECT {_TOKENS.format('text')} AS token FROM documents) GROUP BY token""",
    "lexicon_sum": _with(["lexicon"], f"""
        SELECT *, round(valence / sqrt(valence * valence + 15), 4) AS compound FROM (
            SELECT d.doc_id, count(t.token) AS words, count(l.valence) AS hits,
                   round(coalesce(sum(CAST(l.valence AS DOUBLE)), 0), 6) AS valence
            FROM documents d LEFT JOIN (SELECT doc_id, {_TOKENS.format('text')} AS token FROM documents) t
                 USING (doc_id) LEFT JOIN lexicon l ON l.token = t.token GROUP BY d.doc_id)"""),
    "lexicon_score": _lexicon_rules(),
    "outlet_extract": _outlets(),
    "label_counts_day_subject": _with(["labelled", "subject_rows"], f"""
        SELECT {_six()} FROM labelled WHERE CAST(slot AS DATE) = DATE '2025-01-01'
        AND vec_id IN (SELECT vec_id FROM subject_rows WHERE subject = 'Economy')"""),
    "nested_daily": _with(["wide", "subject_rows"], """
        SELECT target_country, strftime(slot, '%Y%m%d') AS day, subject AS on_subject, scope,
               row_number() OVER (PARTITION BY target_country, CAST(slot AS DATE), subject, scope ORDER BY slot, pos) - 1
               AS pos, title, domain, c AS lexicon_compound, cneg AS classifier_neg
        FROM wide JOIN subject_rows USING (vec_id)"""),
    "response_by_country": _with(["counts", "codes"], f"""
        SELECT target_country, '["' || code || '",' || {_composite('lexicon_nat')} || ','
               || {_composite('classifier_nat')} || ',' || {_composite('lexicon_int')} || ','
               || {_composite('classifier_int')} || ',"' || target_country || '"]' AS response
        FROM (SELECT target_country, {_cell_sums()} FROM counts GROUP BY target_country)
        JOIN codes ON name = target_country"""),
    "translate_hook": """
        SELECT doc_id, lang AS language, CASE WHEN lang = 'en' THEN text ELSE '[' || lang || '] ' || text END AS title
        FROM documents WHERE lang = 'en' OR length(text) % 7 <> 0""",
    "classify_documents": """
        WITH raw AS (SELECT doc_id, exp((length(text) % 5) / 2) AS a, exp((length(text) % 3) / 2) AS b,
                            exp((length(text) % 7) / 2) AS c FROM documents),
        p AS (SELECT doc_id, round(a / (a + b + c), 4) AS neg, round(b / (a + b + c), 4) AS neu,
                     round(c / (a + b + c), 4) AS positive FROM raw)
        SELECT *, round((positive - neg) / (neu + 1), 6) AS compound,
               CASE WHEN tanh(positive - neg) <= -0.05 THEN 'negative' WHEN tanh(positive - neg) >= 0.05 THEN 'positive'
                    ELSE 'neutral' END AS label FROM p""",
    "classify_once": "classify_documents",
    "translation_batches": _with(["articles"], """
        , titles AS (SELECT DISTINCT language, sha256(title) AS digest, CAST(length(title) AS BIGINT) AS chars
                     FROM articles WHERE language <> 'en'),
        sums AS (SELECT *, row_number() OVER w - 1 AS n, sum(chars) OVER w - chars AS c FROM titles WHERE chars <= 20000
                 WINDOW w AS (PARTITION BY language ORDER BY digest))
        SELECT language, digest, chars, (n // 150) || '-' || CAST(c // 20000 AS BIGINT) AS batch FROM sums UNION ALL
        SELECT language, digest, chars, 'long-' || digest FROM titles WHERE chars > 20000"""),
    "translation_memory": """
        WITH tagged AS (SELECT doc_id, lang, text, length(text) AS n, bool_or(doc_id IN (SELECT doc_id FROM labels))
                               OVER (PARTITION BY lang, text) AS known FROM documents)
        SELECT doc_id, lang AS language, sha256(CASE
                   WHEN lang = 'en' THEN text WHEN known AND n % 7 <> 0 THEN '[1 ' || lang || '] ' || text
                   ELSE '[2 ' || lang || '] ' || text END) AS title_sha
        FROM tagged WHERE lang = 'en' OR (known AND n % 7 <> 0) OR n % 11 <> 0""",
    "load_scored": _load(),
    "stream_load": _load("slot + INTERVAL 4 HOUR <= (SELECT max(seen) - INTERVAL 1 HOUR FROM matched)"),
    "load_counters": _with(["pairs", "relevant"], f"""
        , flags AS (SELECT p.*, {_RELEVANT} AS relevant FROM pairs p),
        n AS (SELECT target_country, scope, count(*) FILTER (relevant) AS kept, count(*) FILTER (NOT relevant) AS removed
              FROM flags GROUP BY ALL)
        SELECT target_country, scope, 'kept' AS kind, kept AS n FROM n UNION ALL
        SELECT target_country, scope, 'removed', removed FROM n UNION ALL
        SELECT '', '', 'broken', count(DISTINCT doc_id // 7) FROM articles"""),
    "rollup_deltas": _with(["wide"], f"""
        , every AS (
            SELECT target_country, slot, scope, 'lexicon' AS model,
                   CASE WHEN c <= -0.05 THEN 'negative' WHEN c >= 0.05 THEN 'positive' ELSE 'neutral' END AS label
            FROM wide UNION ALL
            SELECT target_country, slot, scope, 'classifier',
                   CASE WHEN tanh(cneg - cpos) <= -0.05 THEN 'negative' WHEN tanh(cneg - cpos) >= 0.05 THEN 'positive'
                        ELSE 'neutral' END FROM wide)
        SELECT target_country, {_KEY.format("slot")}, scope, model, count(*) FILTER (label = 'negative') AS negative,
               count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (label = 'positive') AS positive
        FROM every GROUP BY target_country, slot, scope, model"""),
    "phrase_sentiment": _phrase_rules(),
    "pending_bucketed": "pending_slots",
    "stream_append_nulls": _with(["events_labelled"], """
        SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type, label,
               CASE WHEN label <> 'neutral' THEN strftime(ts, '%Y%m%d') END AS day FROM events_labelled"""),
    "mention_array": "mention_files",
    "rank_files": _with(["ranks"], "SELECT domain, code, rank FROM ranks"),
    "dimension_files": """
        SELECT n_name AS name, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation UNION ALL
        SELECT DISTINCT lang, 'language' FROM documents""",
    "page_files": "outlet_extract",
    "outlet_files": "outlet_extract",
    "table_append": _with(["counts", "mentions"], f"""
        SELECT 'counts' AS kind, target_country, {_KEY.format("slot")}, scope, model, negative, neutral, positive
        FROM counts UNION ALL
        SELECT 'domain', domain, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT domain FROM mentions) UNION ALL
        SELECT 'table', unnest(['scored_headline', 'sentiment_counts', 'global_info', 'global_info_hourly', 'domain_info']),
               NULL, NULL, NULL, NULL, NULL, NULL"""),
    "stream_append_once": _with(["events_labelled"], """
        SELECT event_id, event_type, label, strftime(ts, '%Y%m%d') AS day FROM events_labelled"""),
    "stream_dedup_titles": "SELECT DISTINCT sha256(text) AS title_sha FROM documents",
    "stream_closed_counts": _with(["events_labelled"], f"""
        SELECT * EXCLUDE (ends) FROM (
            SELECT {_KEY.format(_SLOT_OF)}, event_type, {_SLOT_OF} + INTERVAL 4 HOUR AS ends,
                   count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'neutral') AS neutral,
                   count(*) FILTER (label = 'positive') AS positive FROM events_labelled GROUP BY ALL)
        WHERE ends <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""),
    "backfill_counts": _with(["events_labelled"], f"""
        SELECT * FROM ({_EVENT_COUNTS}) WHERE slot_key IN (
            SELECT strftime((SELECT min({_SLOT_OF}) FROM events) + to_hours(CAST(i * 4 AS INTEGER)), '%Y-%m-%d-%H')
            FROM range(58) AS r(i))"""),
    "article_files": _with(["articles"], """
        SELECT 'http://news.example/' || doc_id AS url, sha256(title) AS title_sha,
               strftime(seen, '%Y%m%d%H%M%S') AS seen, domain, language, source_country,
               row_number() OVER (PARTITION BY doc_id // 7 ORDER BY doc_id) - 1 AS arrival FROM articles"""),
    "mention_files": _with(["mentions"], "SELECT domain, code, cnt FROM mentions"),
    "authority_files": _with(
        ["authority"], "SELECT domain, domain_auth, CAST(NULL AS VARCHAR) AS facebook_fol FROM authority"),
    "staged_roundtrip": _with(["wide"], """
        SELECT target_country, strftime(slot, '%Y%m%d%H%M%S') AS slot_key,
               CASE WHEN scope = 'national' THEN 'economy' ELSE '-economy' END AS query, title, domain, source_country
        FROM wide"""),
    "scored_roundtrip": _with(["wide"], f"""
        SELECT target_country, {_K}, scope, title, domain, source_country, lneg AS lexicon_neg, lneu AS lexicon_neu,
               lpos AS lexicon_pos, c AS lexicon_compound, cneg AS classifier_neg, cneu AS classifier_neu,
               cpos AS classifier_pos FROM wide"""),
    "batch_roundtrip": "SELECT * FROM documents",
    "term_lists": """
        SELECT n_name, array_to_string(t, ' OR ') AS joined, CAST(i - 1 AS INTEGER) AS place, t[i] AS term
        FROM (SELECT n_name, [n_name || ' Climate', n_name || ' Economy', n_name || ' Trade'] AS t FROM nation),
             range(1, 4) AS r(i)""",
    "stream_slot_counts": _with(["events_labelled"], _EVENT_COUNTS),
    "batch_slot_counts": _with(["events_labelled"], _EVENT_COUNTS),
}

# The same rows by another way.
ORACLE.update({name: ORACLE[sql] for name, sql in ORACLE.items() if sql in ORACLE})
