"""DuckDB SQL for the queries of the engine."""

from __future__ import annotations

from .functions.analyze import tokens_sql
from .functions.normalize import PROFILES
from .queries import _NULLED

_CONV = "(SELECT conv_id * 1000 + turn AS id, * FROM conversations)"


def _hits(tokens: str, leaf: str, prefix: bool = False) -> str:
    words = leaf.split()
    if len(words) == 1:
        test = f"starts_with(x, '{words[0]}')" if prefix else f"x = '{words[0]}'"
        return f"len(list_filter({tokens}, lambda x: {test}))"
    test = " AND ".join(f"{tokens}[k + {i}] = '{w}'" for i, w in enumerate(words))
    return f"len(list_filter(generate_series(1, len({tokens}) - {len(words) - 1}), lambda k: {test}))"


def bm25(leaves: list[tuple], where: str, table: str = "documents", key: str = "doc_id", fields: dict[str, float] | None = None) -> str:
    """leaves: (words, prefix, field); where: over h0, h1, ... and the table's columns."""
    fields = fields or {"text": 1}
    leaves = [(*leaf, *(False, None)[len(leaf) - 1 :]) for leaf in leaves]
    tokens = ", ".join(f"{tokens_sql(f)} AS tok_{f}" for f in fields)
    size = " + ".join(f"len(tok_{f})" for f in fields)
    hits = ", ".join(" + ".join(f"{w} * {_hits(f'tok_{f}', words, prefix)}" for f, w in fields.items() if only in (None, f)) + f" AS h{i}" for i, (words, prefix, only) in enumerate(leaves))
    counts = ", ".join(f"count(*) FILTER (WHERE h{i} > 0) AS n{i}" for i in range(len(leaves)))
    idf = [f"ln((rows - n{i} + 0.5) / (n{i} + 0.5))" for i in range(len(leaves))]
    score = " + ".join(f"(CASE WHEN {idf[i]} > 0 THEN {idf[i]} ELSE 1e-6 END) * (h{i} * 2.2 / (h{i} + 1.2 * (0.25 + 0.75 * dl / (total / rows))))" for i in range(len(leaves)))
    return f"""
    WITH t AS (SELECT *, {tokens} FROM {table}), h AS (SELECT *, {size} AS dl, {hits} FROM t),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(sum(dl) AS DOUBLE) AS total, {counts} FROM h)
    SELECT {key} AS id, round({score}, 6) AS score FROM h, s WHERE {where}"""


_PART = {"table": "part", "key": "p_partkey", "fields": {"p_name": 5, "p_type": 1}}
_FILTERS = {
    "filter_compare": "p_size > 5 AND p_size < 40 AND p_retailprice >= 950 AND p_retailprice <= 1800",
    "filter_eq": "p_brand = 'Brand#12'",
    "filter_neq": "p_brand <> 'Brand#12'",
    "filter_in": "p_brand IN ('Brand#12', 'Brand#23', 'Brand#34')",
    "filter_not_in": "p_brand NOT IN ('Brand#12', 'Brand#23')",
    "filter_null": "p_brand IS NULL",
    "filter_not_null": "p_brand IS NOT NULL AND p_retailprice IS NOT NULL",
    "filter_not": "NOT (p_brand = 'Brand#12' OR p_retailprice > 1500)",
    "filter_between": "p_size BETWEEN 10 AND 20",
    "filter_nested": "(p_size = 10 AND NOT p_brand IS NULL) OR (p_size IN (1, 2, 3) AND (p_brand IS NULL OR p_retailprice < 1000))",
}


def _page(order: str, limit: int, offset: int = 0, table: str = "part", key: str = "p_partkey", more: str = "") -> str:
    return f"SELECT * FROM (SELECT row_number() OVER (ORDER BY {order}, {key}) AS rank, {key} AS id{more} FROM {table}) WHERE rank > {offset} AND rank <= {offset + limit + 1}"


def _normal(name: str) -> str:
    pairs = sorted(PROFILES[name].mapping, key=lambda m: not m[1])
    text = "Ａ " + "".join(a for a, _ in PROFILES[name].mapping) + " ة ؤ ئ ۱ "
    return f"SELECT p_partkey, translate('{text}' || p_name, '{''.join(a for a, _ in pairs)}', '{''.join(b for _, b in pairs)}') AS after FROM part"




def _best(matches: str, limit: int, offset: int = 0) -> str:
    """A page of matches by score. Scores of equal hits and lengths are equal in either engine; then the id decides."""
    return f"SELECT * FROM (SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score, false AS fuzzy FROM ({matches})) WHERE rank > {offset} AND rank <= {offset + limit + 1}"


#: Of the first 200 parts that share a gram with `widgte`, those within one edit; no part holds the word itself.
_NEAR = """SELECT p_partkey, p_brand, min(d) AS distance FROM (SELECT p_partkey, p_brand, damerau_levenshtein(w, 'widgte') AS d FROM
           (SELECT p_partkey, p_brand, unnest(string_split(t, ' ')) AS w FROM (SELECT p_partkey, p_brand, p_name || ' ' || p_type AS t FROM part
            WHERE contains(lower(t), 'wid') OR contains(lower(t), 'idg') OR contains(lower(t), 'dgt') OR contains(lower(t), 'gte') ORDER BY p_partkey LIMIT 200))) WHERE d <= 1 GROUP BY ALL"""
_NEAR_PAGE = f"SELECT row_number() OVER (ORDER BY distance, p_partkey) AS rank, p_partkey AS id, CAST(NULL AS DOUBLE) AS score, true AS fuzzy FROM ({_NEAR}) QUALIFY rank <= 101"


def oracle_sql() -> dict[str, str]:
    null = ", CAST(NULL AS DOUBLE) AS score, false AS fuzzy"
    nulled = "(SELECT p_partkey, p_size, " + ", ".join(f"{e} AS {c}" for c, e in _NULLED.items()) + " FROM part)"
    docs_tokens = f"(SELECT doc_id, {tokens_sql('text')} AS tok FROM documents)"
    return {
        "search_bm25_all": bm25([("apache",), ("license",)], "h0 > 0 AND h1 > 0"),
        "search_bm25_any": bm25([("idiot",), ("moron",), ("trash",)], "h0 > 0 OR h1 > 0 OR h2 > 0"),
        "search_last_prefix": bm25([("mit",), ("licen", True)], "h0 > 0 AND h1 > 0"),
        "search_phrase": bm25([("general public license",), ("version",)], "h0 > 0 AND h1 > 0"),
        "search_weighted_fields": bm25([("ring",)], "h0 > 0", **_PART),
        "search_conversations": bm25([("eine",), ("the",)], "h0 > 0 OR h1 > 0", _CONV, "id"),
        "search_filtered": bm25([("idiot",)], "h0 > 0 AND lang = 'en' AND n_chars > 500"),
        "search_fields": bm25([("ring", False, "p_name"), ("st", True, "p_type"), ("red", False, "p_name")], "h0 > 0 OR (h1 > 0 AND h2 > 0)", **_PART),
        "search_postings": bm25([("mit license",), ("idiot",)], "h0 > 0 OR h1 > 0"),
        "search_field_sort": _page("p_retailprice DESC NULLS LAST, p_size ASC NULLS FIRST", 100, more=null),
        "search_paged": _page("p_retailprice ASC NULLS FIRST", 20, 40, more=null),
        "browse_empty_query": _page("o_totalprice DESC NULLS LAST", 50, 0, "orders", "o_orderkey", ", CAST(NULL AS DOUBLE) AS score"),
        **{name: f"SELECT p_partkey AS id, p_brand, p_size, p_retailprice FROM {nulled} WHERE {test}" for name, test in _FILTERS.items()},
        "scope_and_filter": bm25([("idiot",)], "h0 > 0 AND lang = 'en' AND (lang = 'de' OR n_chars > 100)"),
        "facet_terms": f"SELECT lang AS value, count(*) AS count FROM documents WHERE list_contains({tokens_sql('text')}, 'idiot') AND lang IS NOT NULL GROUP BY lang",
        "facet_numeric": "SELECT CAST(p_size AS BIGINT) AS value, count(*) AS count FROM part WHERE p_size IS NOT NULL GROUP BY p_size ORDER BY count DESC, value LIMIT 100",
        "facet_on_filtered_field": "SELECT o_orderstatus AS value, count(*) AS count FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL",
        "facet_stats": "SELECT min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max FROM orders WHERE o_orderstatus = 'F'",
        "total_hits": f"SELECT count(*) AS total FROM documents WHERE list_contains({tokens_sql('text')}, 'idiot')",
        "synonyms_expand": bm25([("mit",), ("apache",), ("gnu",)], "h0 > 0 OR h1 > 0 OR h2 > 0"),
        "normalize_arabic": _normal("arabic-basic"),
        "normalize_numeric_arabic": _normal("numeric-arabic"),
        "trigrams": "SELECT DISTINCT p_partkey, substr(lower(p_name), k, 3) AS gram FROM part, unnest(generate_series(1, length(p_name) - 2)) AS g(k)",
        "fuzzy_distances": f"SELECT p_partkey AS id, CAST(min(damerau_levenshtein(w, 'widgte')) AS INTEGER) AS distance FROM (SELECT p_partkey, p_name || ' ' || p_type AS t, unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part) WHERE damerau_levenshtein(w, 'widgte') <= 1 AND (contains(t, 'wid') OR contains(t, 'idg') OR contains(t, 'dgt') OR contains(t, 'gte')) GROUP BY p_partkey",
        "hydrate_source": "SELECT * FROM (SELECT row_number() OVER (ORDER BY p_size ASC NULLS FIRST, p_retailprice DESC NULLS LAST, p_partkey) AS rank, p_partkey AS id, p_name, p_brand, p_size, p_retailprice FROM part) WHERE rank <= 101",
        "integrity_counts": f"SELECT * FROM (SELECT 'orphan-postings' AS code, count(*) AS n FROM part WHERE p_size < 10 UNION ALL SELECT 'orphan-doc', count(*) FROM part WHERE p_size > 40) WHERE n > 0",
        "upsert_last_wins": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "delete_docs": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
        "projection_migration": "SELECT d.doc_id, lang, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)",
        "linked_changes": """SELECT row_number() OVER (ORDER BY c_custkey) AS doc_id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey + 10000000 ELSE c_custkey END AS c_custkey,
                          CASE WHEN c_mktsegment = 'MACHINERY' THEN 'renamed ' || c_name ELSE c_name END AS c_name, c_acctbal FROM customer QUALIFY c_acctbal >= 0""",
        "search_stored_relevance": _best(bm25([("version",), ("license",), ("idiot",)], "h0 > 0 OR h1 > 0 OR h2 > 0"), 50, 10),
        "search_stored_phrase": _best(bm25([("general public license",), ("version",)], "h0 > 0 AND h1 > 0 AND lang = 'en'"), 100),
        "search_stored_prefix": _best(bm25([("mit",), ("licen", True)], "h0 > 0 AND h1 > 0"), 100),
        "fuzzy_page": _NEAR_PAGE,
        "fuzzy_stored": _NEAR_PAGE,
        "fuzzy_facets": f"SELECT p_brand AS value, count(*) AS count FROM ({_NEAR}) GROUP BY p_brand",
        "vocabulary": f"SELECT token, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (SELECT doc_id, unnest(tok) AS token FROM {docs_tokens}) GROUP BY token",
    }
