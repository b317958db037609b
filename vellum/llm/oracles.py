"""DuckDB SQL with the results of the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from . import decontaminate, secrets

_WORDS = r"regexp_extract_all(lower({0}), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+')"


def op1_decontaminate() -> str:
    n = decontaminate.SPAN
    return f"""
    WITH d AS (SELECT doc_id, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' AS t FROM documents WHERE doc_id IS NOT NULL),
    b AS (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
    r AS (SELECT DISTINCT item_id, array_to_string(w[k:k + {n - 1}], ' ') AS run
          FROM b, unnest(generate_series(1, greatest(1, len(w) - {n - 1}))) AS g(k) WHERE len(w) > 0)
    SELECT doc_id, item_id, count(DISTINCT run) AS n_runs FROM d JOIN r ON contains(t, ' ' || run || ' ') GROUP BY ALL"""


def op10_secrets() -> str:
    first, step = secrets.model()
    firsts = ", ".join(f"('{c}', {v})" for c, v in zip(secrets.CHARS, first.tolist()))
    steps = ", ".join(f"('{a}{b}', {step[i, j]})" for i, a in enumerate(secrets.CHARS) for j, b in enumerate(secrets.CHARS))
    return f"""
    WITH f(c, v) AS (VALUES {firsts}), s(c, v) AS (VALUES {steps}),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_-]{{{secrets.MIN_LENGTH},}}')) AS token FROM documents WHERE doc_id IS NOT NULL),
    found AS (SELECT token FROM runs WHERE regexp_matches(token, '[A-Za-z]') AND regexp_matches(token, '[0-9]') GROUP BY token),
    steps AS (SELECT token, substr(token, k, 2) AS c FROM found, unnest(generate_series(1, length(token) - 1)) AS g(k)),
    scored AS (SELECT steps.token, any_value(f.v) + sum(s.v) AS score FROM steps JOIN s USING (c) JOIN f ON f.c = steps.token[1] GROUP BY steps.token)
    SELECT doc_id, token, CAST(score AS BIGINT) AS score, count(*) AS n FROM runs JOIN scored USING (token)
    WHERE score >= {secrets.THRESHOLD} * length(token) GROUP BY ALL"""


def op6_lm_scores() -> str:
    from . import ngrams

    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format('text')}, []) AS words FROM documents),
    t AS (SELECT rid, k, words[k] AS w, CASE WHEN k > 1 THEN words[k - 1] END AS v FROM d, unnest(generate_series(1, len(words))) AS g(k)),
    u AS (SELECT w, count(*) AS c FROM t GROUP BY w), b AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w),
    own_u AS (SELECT rid, w, count(*) AS c FROM t GROUP BY rid, w), own_b AS (SELECT rid, v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY rid, v, w),
    j AS (SELECT t.rid, coalesce(b.c - own_b.c, 0) AS pairs, u.c - own_u.c AS singles, ctx.c AS context
          FROM t JOIN u ON u.w = t.w JOIN own_u ON own_u.rid = t.rid AND own_u.w = t.w LEFT JOIN u ctx ON ctx.w = t.v
          LEFT JOIN b ON b.v = t.v AND b.w = t.w LEFT JOIN own_b ON own_b.rid = t.rid AND own_b.v = t.v AND own_b.w = t.w),
    s AS (SELECT rid, sum(CASE WHEN pairs > 0 THEN ln(pairs) - ln(context) ELSE ln({ngrams.ALPHA}) + ln(greatest(singles, 0.5)) - ln((SELECT count(*) FROM t)) END) AS total,
          count(*) FILTER (WHERE pairs <= 0) AS n_backoff FROM j GROUP BY rid)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(total / len(words), 6) AS score
    FROM d LEFT JOIN s USING (rid) WHERE doc_id IS NOT NULL"""


def op9_repeated_spans(changed: bool = True) -> str:
    from . import spans

    if_changed = "HAVING count(*) FILTER (WHERE gone.s IS NOT NULL) > 0" if changed else ""
    rest = "" if changed else " UNION ALL SELECT doc_id, 0, 0, text FROM documents WHERE doc_id IS NULL OR coalesce(text, '') = ''"

    return f"""
    WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    p AS (SELECT doc_id, text, g.k, pieces[g.k] AS piece, {_WORDS.format('pieces[g.k]')} AS words
          FROM (SELECT *, regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]+|[^.!?\\n]+') AS pieces FROM d), unnest(generate_series(1, len(pieces))) AS g(k)),
    o AS (SELECT *, sum(CASE WHEN len(words) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, text ORDER BY k) AS s FROM p),
    n AS (SELECT doc_id, text, s, string_agg(piece, '' ORDER BY k) AS sentence, max(CASE WHEN len(words) > 0 THEN array_to_string(words, ' ') END) AS words, max(len(words)) AS n FROM o GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, text ORDER BY s) AS upto FROM n WHERE s > 0),
    l AS (SELECT doc_id, text, list(words ORDER BY s) AS words, list(upto ORDER BY s) AS upto FROM c GROUP BY ALL),
    r AS (SELECT doc_id, text, g.k AS s, words, len(list_filter(upto, lambda x: x < coalesce(upto[g.k - 1], 0) + {spans.WORDS})) + 1 AS stop FROM l, unnest(generate_series(1, len(words))) AS g(k)
          UNION SELECT doc_id, text, len(list_filter(upto, lambda x: x <= upto[g.k] - {spans.WORDS})) + 1 AS s, words, g.k AS stop FROM l, unnest(generate_series(1, len(words))) AS g(k) WHERE upto[g.k] >= {spans.WORDS}),
    v AS (SELECT doc_id, text, s, stop, array_to_string(words[s:stop], ' ') AS span FROM r WHERE stop <= len(words)),
    f AS (SELECT *, rank() OVER (PARTITION BY span ORDER BY doc_id, s) AS place FROM v),
    gone AS (SELECT DISTINCT doc_id, text, unnest(generate_series(s, stop)) AS s FROM f WHERE place > 1)
    SELECT n.doc_id, count(*) FILTER (WHERE s > 0) AS n_sentences, count(*) FILTER (WHERE gone.s IS NOT NULL) AS n_removed,
           coalesce(string_agg(sentence, '' ORDER BY s) FILTER (WHERE gone.s IS NULL), '') AS text
    FROM n LEFT JOIN gone USING (doc_id, text, s) GROUP BY n.doc_id, n.text {if_changed}{rest}"""


def op9_cleaned() -> str:
    return op9_repeated_spans(False)


def op5_url_filters() -> str:
    from . import urls

    host, path = urls._HOST.replace("'", "''"), urls._PATH.replace("'", "''")

    def key(column: str, rule: bool) -> str:
        h = f"regexp_replace(lower(regexp_extract({column}, '{host}', 1)), '\\.+$', '')"
        labels = f"array_to_string(list_reverse(string_split({h}, '.')), ',') || ','"
        rest = f"regexp_extract({column}, '{path}', 1)"
        return f"CASE WHEN {h} <> '' THEN {labels} || " + (rest if rule else f"CASE WHEN {rest} LIKE '/%' THEN {rest} ELSE '/' || {rest} END") + " END"

    rules = ", ".join(f"({n}, '{act}', '{prefix}')" for n, act, prefix in urls.RULES)
    return f"""
    WITH r AS (SELECT min(id) AS id, arg_min(act, id) AS act, key FROM (SELECT id, act, {key('prefix', True)} AS key FROM (VALUES {rules}) v(id, act, prefix)) GROUP BY key),
    p AS (SELECT row_number() OVER () AS rid, page_id, {key('url', False)} AS key FROM pages),
    m AS (SELECT rid, count(*) AS n, arg_max(r.id, length(r.key)) AS id, arg_max(r.act, length(r.key)) AS act FROM p JOIN r ON starts_with(p.key, r.key) GROUP BY rid)
    SELECT page_id, key, CAST(m.id AS BIGINT) AS rule_id, coalesce(m.act, 'allow') AS action, CAST(coalesce(m.n, 0) AS INTEGER) AS n_rules FROM p LEFT JOIN m USING (rid)"""


def op7_licenses() -> str:
    from . import licenses

    rows = ", ".join(f"('{name}', '{' '.join(licenses.normal(text))}')" for name, text in sorted(set(licenses.TEMPLATES)))
    t = licenses.THRESHOLD
    return f"""
    WITH v(license, words) AS (VALUES {rows}), t AS (SELECT license, words, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1])) AS grams FROM (SELECT *, string_split(words, ' ') AS w FROM v)),
    s AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split_regex(text, '\n\n+'), string_split(text, chr(10)), string_split_regex(text, '[.!?] |\n'))) AS part FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    w AS (SELECT DISTINCT doc_id, array_to_string({_WORDS.format('part')}, ' ') AS words FROM s),
    n AS (SELECT words, string_split(words, ' ') AS w FROM (SELECT DISTINCT words FROM w)),
    u AS (SELECT words, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1])) AS grams FROM n WHERE len(w) > 1 AND len(list_intersect(w, (SELECT list(DISTINCT x) FROM (SELECT unnest(string_split(words, ' ')) AS x FROM v)))) > 1),
    d AS (SELECT u.words, license, 2 * len(list_intersect(u.grams, t.grams)) / (len(u.grams) + len(t.grams)) AS dice FROM u JOIN t ON len(u.grams) BETWEEN {t / (2 - t)} * len(t.grams) - 1e-9 AND {(2 - t) / t} * len(t.grams) + 1e-9),
    b AS (SELECT words, max(dice) AS best FROM d WHERE dice >= {t} - 1e-12 GROUP BY words),
    f AS (SELECT words, best, min(license) AS license FROM b JOIN d USING (words) WHERE dice = best GROUP BY ALL)
    SELECT doc_id, license, round(max(best), 6) AS dice, count(DISTINCT words) AS n_passages FROM w JOIN f USING (words) GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {f.__name__: f() for f in (op1_decontaminate, op5_url_filters, op6_lm_scores, op7_licenses, op9_repeated_spans, op9_cleaned, op10_secrets)}
