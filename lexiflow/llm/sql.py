"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from lexiflow.llm import divergence as D


def _class_columns() -> str:
    """Characters of each class; no two classes share one, so each is counted in the whole text."""
    return ",\n    ".join(f"length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS c_{k}" for k, p in D.CLASSES.items())


def _js(p: str, q: str) -> str:
    return (f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) / 2 ELSE 0 END"
            f" + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) / 2 ELSE 0 END)")


def quality_rules() -> str:
    names = [f"c_{k}" for k in D.CLASSES] + ["c_rest"]
    whole = " + ".join(names)
    by_class = " + ".join(_js(f"(r.{c} / greatest(r.n_all, 1)::double)", f"(g.{c} / (g.n_all::double))") for c in names)
    chance = lambda bins, n: f"sqrt({bins - 1}::double / (8 * ln(2::double) * greatest({n}, 1)))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + {D.WINDOW - 1}], ' ') AS x
    FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - {D.WINDOW - 1})) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
again AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(generate_series(0, {D.WINDOW - 1})) AS k) GROUP BY r),
c AS (SELECT w.r, doc_id, lang, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '{D.SYMBOLS}', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(again.n, 0) AS n_repeat_words, length(t) AS n_all,
    {_class_columns()} FROM w LEFT JOIN again USING (r)),
b AS (SELECT *, n_all - ({" + ".join(names[:-1])}) AS c_rest, n_words < {D.FEWEST} OR 100 * n_repeat_words > {D.MOST_REPEATED} * n_words AS base_failed
    FROM c),
g AS (SELECT lang, sum(n_words) AS n_words, {", ".join(f"sum({c}) AS {c}" for c in names)}, greatest(sum({whole}), 1) AS n_all FROM b GROUP BY lang),
e AS (SELECT r, lang, unnest(list_filter(regexp_split_to_array(lower(t), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word FROM d),
top AS (SELECT lang, word, n FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS bin
    FROM e GROUP BY lang, word) WHERE bin <= {D.COMMON}),
q AS (SELECT top.lang, word, n / g.n_words::double AS q FROM top JOIN g USING (lang)),
h AS (SELECT r, lang, word, count(*) AS n FROM e SEMI JOIN q USING (lang, word) GROUP BY r, lang, word),
s AS (SELECT h.r, sum({_js("(h.n / (b.n_words::double))", "q.q")}) AS d, sum(h.n / b.n_words::double) AS p, sum(q.q) AS q
    FROM h JOIN q USING (lang, word) JOIN b ON b.r = h.r GROUP BY h.r),
z AS (SELECT lang, sum(q) AS q FROM q GROUP BY lang),
j AS (SELECT b.*, sqrt(greatest({by_class}, 0)) AS class_distance, g.n_words AS reference,
    coalesce(s.d, 0) + greatest(coalesce(z.q, 0) - coalesce(s.q, 0), 0) / 2 AS inside,
    greatest(1 - coalesce(s.p, 0), 0) AS p, greatest(1 - coalesce(z.q, 0), 0) AS q
    FROM b AS r JOIN b ON b.r = r.r JOIN g ON g.lang = r.lang LEFT JOIN s ON s.r = r.r LEFT JOIN z ON z.lang = r.lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND NOT (n_words >= {D.LEAST_WORDS} AND reference >= {D.LEAST_REFERENCE} AND (
        class_distance > {D.CLASS_LIMIT} + {chance(len(names), "n_words")}
        OR sqrt(greatest(inside + {_js("p", "q")}, 0)) > {D.WORD_LIMIT} + {chance(D.COMMON + 1, "n_words")})) AS kept
FROM j"""


def lexical_search() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT r, unnest(regexp_extract_all({low.format("text")}, '{term}')) AS term FROM d),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM t GROUP BY r, term),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
b AS (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT i, term, count(*)::BIGINT AS times FROM (SELECT i, unnest(regexp_extract_all({low.format("text")}, '{term}')) AS term FROM b) GROUP BY i, term),
m AS (SELECT r, 75 + (25 * n * n_docs) // n_terms AS m FROM n, s),
z AS (SELECT i, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM z JOIN d USING (r) JOIN b USING (i) WHERE score > 0)
WHERE rank <= 20"""


def collocations() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({low}, '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (SELECT unnest(generate_series(1, 5)) AS k))),
f AS (SELECT lang, phrase, k, count(*)::BIGINT AS a FROM g GROUP BY lang, phrase, k HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, k, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail
    FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c)),
s AS (SELECT cut.*, l.a AS l, r.a AS r, n.n, (1000 * cut.a::HUGEINT * n.n) // (l.a::HUGEINT * r.a) AS score
    FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = head JOIN f r ON r.lang = cut.lang AND r.phrase = tail JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM s) WHERE o = 1),
sub AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM c)) GROUP BY 1, 2)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
    FROM best LEFT JOIN sub ON sub.lang = best.lang AND sub.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
WHERE rank <= 2000"""
