"""Searches over the test tables, one for each operator of the engine. Each runs over whole tables and returns all its rows; a
limit stands only where paging is what is shown."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .definition import define_index, table
from .engine import Handle, SearchEngine
from .functions.analyze import grams
from .functions.normalize import PROFILES
from .operators import fuzzy
from .operators.match import postings_frame
from .plans.filters import Filter, and_, between, bind_scope, check_filter, eq, filter_column, gt, gte, in_list, is_not_null, is_null, lt, lte, neq, not_, not_in, or_
from .plans.query import Group, Term, expand_synonyms, parse_index_query
from .plans.request import Request, asc, desc
from .plans.search import Index, hydrate, index_frame, ranked, search
from .limits import Limits

Query = Callable[[SparkSession, str], DataFrame]

DOCUMENTS = dict(name="documents", source=table("documents", "doc_id", "safe-integer"), searchable={"text": 1}, filterable={"lang": "text", "source": "text", "n_chars": "integer"}, sortable={"n_chars": "integer"}, facets=["lang", "source", "n_chars"])
PARTS = dict(name="parts", source=table("part", "p_partkey", "safe-integer"), searchable={"p_name": 5, "p_type": 1}, filterable={"p_brand": "text", "p_size": "integer", "p_retailprice": "number"}, sortable={"p_retailprice": "number", "p_size": "integer"}, facets=["p_brand", "p_size"], typo="fallback")
ORDERS = dict(name="orders", source=table("orders", "o_orderkey", "safe-integer"), searchable={"o_orderpriority": 1}, filterable={"o_orderstatus": "text", "o_totalprice": "number"}, sortable={"o_totalprice": "number"}, facets=["o_orderstatus", "o_totalprice"])
USERS = dict(name="users", mode="manual", source=table("events", "user_id", "safe-integer"), searchable=["event_type"], filterable={"event_id": "integer", "value": "number"})
CUSTOMERS = dict(name="customers", source=table("customer", "c_custkey", "safe-integer"), searchable={"c_name": 1}, filterable={"c_acctbal": "number"})
TALKS = dict(name="talks", source=table("talks", "id", "safe-integer"), searchable={"text": 1}, filterable={"role": "text", "turn": "integer"}, sortable={"turn": "integer"}, facets=["role"])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str, given: dict, **change: object) -> Index:
    d = define_index(**(given | change))
    df = read(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")) if d.source.name == "talks" else read(spark, sf_dir, d.source.name)
    return Index(d, index_frame(df, d))


def matches(ix: Index, text: str, where: Filter | None = None) -> DataFrame:
    """(id, score) of all matches."""
    d = ix.definition
    query = expand_synonyms(parse_index_query(text, d.normalization, d.strategy, Limits()), d.synonyms)
    found = ranked(ix, query)
    if where:
        check_filter(where, d.filterable)
        found = found.where(filter_column(where, d.filterable))
    return found.select(F.col("source_id").alias("id"), F.round("score", 6).alias("score"))


def _text(text: str, given: dict = DOCUMENTS, where: Filter | None = None, **change: object) -> Query:
    return lambda spark, sf_dir: matches(index(spark, sf_dir, given, **change), text, where)


def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase or a term by way of postings."""
    ix = index(spark, sf_dir, DOCUMENTS, strategy="any")
    return matches(Index(ix.definition, ix.docs, postings_frame(ix.docs, ["text"])), '"mit license" idiot')


def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with fields, which only an application can build."""
    ix = index(spark, sf_dir, PARTS)
    query = Group("or", (Term("ring", field="p_name"), Group("and", (Term("st", True, "p_type"), Term("red", field="p_name")))))
    return ranked(ix, query).select(F.col("source_id").alias("id"), F.round("score", 6).alias("score"))


#: Columns with nulls, as the tables have none: brands of the smallest parts, and prices of the parts of one size.
_NULLED = {"p_brand": "CASE WHEN p_size > 3 THEN p_brand END", "p_retailprice": "CASE WHEN p_size <> 7 THEN p_retailprice END"}

FILTERS = {
    "filter_compare": and_(gt("p_size", 5), lt("p_size", 40), gte("p_retailprice", 950.0), lte("p_retailprice", 1800.0)),
    "filter_eq": eq("p_brand", "Brand#12"),
    "filter_neq": neq("p_brand", "Brand#12"),
    "filter_in": in_list("p_brand", ["Brand#12", "Brand#23", "Brand#34"]),
    "filter_not_in": not_in("p_brand", ["Brand#12", "Brand#23"]),
    "filter_null": is_null("p_brand"),
    "filter_not_null": and_(is_not_null("p_brand"), is_not_null("p_retailprice")),
    "filter_not": not_(or_(eq("p_brand", "Brand#12"), gt("p_retailprice", 1500.0))),
    "filter_between": between("p_size", 10, 20),
    "filter_nested": or_(and_(eq("p_size", 10), not_(is_null("p_brand"))), and_(in_list("p_size", [1, 2, 3]), or_(is_null("p_brand"), lt("p_retailprice", 1000.0)))),
}


def _filter(node: Filter) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = define_index(**PARTS)
        check_filter(node, d.filterable)
        df = read(spark, sf_dir, "part").withColumns({c: F.expr(e) for c, e in _NULLED.items()})
        return df.where(filter_column(node, d.filterable)).select(F.col("p_partkey").alias("id"), "p_brand", "p_size", "p_retailprice")

    return run


def _page(text: str, given: dict, request: Request, **change: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = search(index(spark, sf_dir, given, **change), text, request).hits
        return hits.select("rank", "id", F.round("score", 6).alias("score"), "fuzzy")

    return run


def shared_dir(spark: SparkSession) -> str:
    """A folder for an index, under spark.checkpoint.dir, that goes with the application. Where that is unset and Spark is local, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", where)
    where = f"{where.rstrip('/')}/indexes-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return where


def stored(spark: SparkSession, given: dict, **change: object) -> Handle:
    return SearchEngine(spark, shared_dir(spark)).index(define_index(**(given | change)))


def source_of(spark: SparkSession, sf_dir: str, given: dict) -> DataFrame:
    return read(spark, sf_dir, given["source"].name)


def _stored_page(text: str, given: dict, request: Request, **change: object) -> Query:
    """A page from a stored index, by relevance."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        handle = stored(spark, given, **change)
        handle.create(source_of(spark, sf_dir, given))
        return handle.search(text, request).hits.select("rank", "id", F.round("score", 6).alias("score"), "fuzzy")

    return run


def browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(spark, sf_dir, ORDERS), "", Request(limit=50, sort=(desc("o_totalprice"),))).hits.select("rank", "id", "score")


def scope_and_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope says `en`; the filter asks for more, and gets no more."""
    found = search(index(spark, sf_dir, DOCUMENTS), "idiot", Request(scope=bind_scope({"lang": "en"}), filter=or_(eq("lang", "de"), gt("n_chars", 100)))).matched
    return found.select(F.col("source_id").alias("id"), F.round("score", 6).alias("score"))


def _facet(name: str, text: str, given: dict, where: Filter | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(index(spark, sf_dir, given), text, Request(facets=(name,), filter=where)).facets[name]

    return run


def facet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(spark, sf_dir, ORDERS), "", Request(facets=("o_totalprice",), filter=eq("o_orderstatus", "F"))).stats


def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(spark, sf_dir, DOCUMENTS), "idiot", Request(total=True)).total_of


def _normal(name: str) -> Query:
    text = "Ａ " + "".join(a for a, _ in PROFILES[name].mapping) + " ة ؤ ئ ۱ "

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(text), "p_name").alias("before"))
        return names.select("p_partkey", PROFILES[name].column(F.col("before")).alias("after"))

    return run


def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(grams(F.lower("p_name"))).alias("gram"))


def fuzzy_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts within one edit of `widgte`, by whichever word is nearest."""
    ix = index(spark, sf_dir, PARTS)
    query = Term("widgte")
    terms, wanted = fuzzy.query_terms(query, ())
    found = fuzzy.candidates(ix.docs, F.lit(True), wanted, ["p_name", "p_type"], (), 2**31 - 1)
    return fuzzy.survivors(found, terms, wanted, ["p_name", "p_type"], ()).select(F.col("source_id").alias("id"), "distance")


def fuzzy_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(spark, sf_dir, PARTS), "widgte", Request(facets=("p_brand",))).facets["p_brand"]


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.match import leaves_of
    from .functions.snippet import snippet_column

    ix = index(spark, sf_dir, DOCUMENTS)
    query = Term("idiot")
    found = ranked(ix, query)
    return found.select(F.col("source_id").alias("id"), snippet_column(F.col("text_source"), [(leaf.tokens, leaf.prefix) for leaf in leaves_of(query)], "**", "**", "…").alias("text"))


def hydrate_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(index(spark, sf_dir, PARTS, typo="off"), "", Request(limit=100, sort=(asc("p_size"), desc("p_retailprice")))).hits
    return hydrate(hits.select("rank", "id"), read(spark, sf_dir, "part"), "p_partkey").select("rank", "id", "p_name", "p_brand", "p_size", "p_retailprice")


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check finds in an index of which files were damaged: documents of small parts are lost, and the postings of large ones."""
    handle = stored(spark, PARTS, typo="off")
    handle.create(source_of(spark, sf_dir, PARTS))
    for name, lost in (("docs", F.col("p_size") < 10), ("postings", F.col("doc_id").isin([]))):
        path = handle.stored._at(handle.stored.registry()["segments"][0]["at"], name)
        rows = spark.read.parquet(path)
        if name == "postings":
            large = read_back(spark, handle, "docs").where("p_size > 40").select("doc_id")
            rows, lost = rows.join(large, "doc_id", "left_anti"), F.lit(False)
        rows.where(~lost).write.parquet(f"{path}-damaged")
        handle.engine.store.delete(f"{handle.stored.id}/s1/{name}")
        handle.engine.store.move(f"{handle.stored.id}/s1/{name}-damaged", f"{handle.stored.id}/s1/{name}")
    return spark.createDataFrame([(f["code"], f["n"]) for f in handle.doctor() if "n" in f], "code string, n long")


def read_back(spark: SparkSession, handle: Handle, table: str) -> DataFrame:
    """The live rows of a stored table."""
    return handle.stored._read(handle.stored.registry(), table)


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of their user's document: the last event of each user stays. A first batch holds every user, so that the second changes known documents."""
    events = read(spark, sf_dir, "events")
    handle = stored(spark, USERS)
    handle.create()
    rows = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("_place"), F.col("user_id").alias("source_id"), F.col("event_type").alias("event_type_source"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))
    handle.upsert(rows.withColumns({"event_type_source": F.lit("unknown"), "value": F.lit(0.0)}))
    handle.upsert(rows)
    return read_back(spark, handle, "docs").select(F.col("source_id").alias("user_id"), "event_id", F.col("event_type_source").alias("event_type"), "value")


def delete_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    handle = stored(spark, DOCUMENTS, mode="manual")
    handle.create()
    docs = read(spark, sf_dir, "documents")
    handle.upsert(docs.select(F.lit(0).cast("long").alias("_place"), F.col("doc_id").alias("source_id"), F.col("text").alias("text_source"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars")))
    handle.delete(read(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("source_id")))
    return search(handle.stored.open(), "").matched.select(F.col("source_id").alias("doc_id"), "lang", "n_chars")


def projection_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of documents that gets typed columns filled in from another table."""
    fresh = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = read(spark, sf_dir, "documents").join(fresh, "doc_id", "left")
    handle = stored(spark, DOCUMENTS)
    handle.create(docs)
    wider = handle.engine.index(define_index(**(DOCUMENTS | {"filterable": DOCUMENTS["filterable"] | {"quality": "integer", "toxic": "integer"}})))
    assert wider.migrate(docs) == "migration-only"
    found = search(wider.stored.open(), "").matched
    return found.select(F.col("source_id").alias("doc_id"), "lang", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))


def linked_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a source: customers of one segment get a new key, those in debt go, and the others of a second segment get a new text. doc_ids stay."""
    from .streaming.sync import apply

    customers = read(spark, sf_dir, "customer")
    handle = stored(spark, CUSTOMERS)
    handle.create(customers)
    moved = customers.where("c_mktsegment = 'BUILDING' AND c_acctbal >= 0").withColumns({"c_custkey_old": F.col("c_custkey"), "c_custkey": F.col("c_custkey") + 10_000_000, "op": F.lit("upsert")})
    gone = customers.where("c_acctbal < 0").withColumn("op", F.lit("delete"))
    renamed = customers.where("c_mktsegment = 'MACHINERY' AND c_acctbal >= 0").withColumns({"c_name": F.concat(F.lit("renamed "), "c_name"), "op": F.lit("upsert")})
    apply(handle, moved.unionByName(gone, True).unionByName(renamed, True).withColumn("seq", F.lit(1)), "seq")
    return read_back(spark, handle, "docs").select("doc_id", F.col("source_id").alias("c_custkey"), F.col("c_name_source").alias("c_name"), "c_acctbal")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with their documents and occurrences. A document brings each token once for each occurrence and once for itself, so both are sums with partial sums."""
    ix = index(spark, sf_dir, DOCUMENTS)
    both = F.concat(F.transform("text_tokens", lambda t: F.struct(t.alias("token"), F.lit(0).alias("own"))), F.transform(F.array_distinct("text_tokens"), lambda t: F.struct(t.alias("token"), F.lit(1).alias("own"))))
    return ix.docs.select(F.explode(both).alias("x")).groupBy("x.token").agg(F.sum("x.own").alias("documents"), F.sum(1 - F.col("x.own")).alias("occurrences"))


def queries() -> dict[str, Query]:
    return {
        "search_bm25_all": _text("apache license"),
        "search_bm25_any": _text("idiot moron trash", strategy="any"),
        "search_last_prefix": _text("mit licen", strategy="last-prefix"),
        "search_phrase": _text('"general public license" version'),
        "search_weighted_fields": _text("ring", PARTS),
        "search_conversations": _text("eine the", TALKS, strategy="any"),
        "search_filtered": _text("idiot", DOCUMENTS, and_(eq("lang", "en"), gt("n_chars", 500))),
        "search_fields": search_fields,
        "search_postings": search_postings,
        "search_field_sort": _page("", PARTS, Request(limit=100, sort=(desc("p_retailprice"), asc("p_size")))),
        "search_paged": _page("", PARTS, Request(limit=20, offset=40, sort=(asc("p_retailprice"),))),
        "browse_empty_query": browse,
        **{name: _filter(node) for name, node in FILTERS.items()},
        "scope_and_filter": scope_and_filter,
        "facet_terms": _facet("lang", "idiot", DOCUMENTS),
        "facet_numeric": _facet("p_size", "", PARTS),
        "facet_on_filtered_field": _facet("o_orderstatus", "", ORDERS, in_list("o_orderstatus", ["F", "O"])),
        "facet_stats": facet_stats,
        "total_hits": total_hits,
        "synonyms_expand": _text("mit", synonyms={"mit": ["apache", "gnu"]}),
        "normalize_arabic": _normal("arabic-basic"),
        "normalize_numeric_arabic": _normal("numeric-arabic"),
        "trigrams": trigrams,
        "fuzzy_distances": fuzzy_distances,
        "fuzzy_page": _page("widgte", PARTS, Request(limit=100)),
        "fuzzy_facets": fuzzy_facets,
        "highlights": highlights,
        "hydrate_source": hydrate_source,
        "integrity_counts": integrity,
        "upsert_last_wins": upsert_last_wins,
        "delete_docs": delete_docs,
        "projection_migration": projection_migration,
        "vocabulary": vocabulary,
        "linked_changes": linked_changes,
        "search_stored_relevance": _stored_page("version license idiot", DOCUMENTS, Request(limit=50, offset=10), strategy="any"),
        "search_stored_phrase": _stored_page('"general public license" version', DOCUMENTS, Request(limit=100, filter=eq("lang", "en"))),
        "search_stored_prefix": _stored_page("mit licen", DOCUMENTS, Request(limit=100), strategy="last-prefix"),
        "fuzzy_stored": _stored_page("widgte", PARTS, Request(limit=100)),
    }
