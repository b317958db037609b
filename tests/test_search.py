"""Search semantics on small catalogues, and against SQLite's FTS5."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from vellum import Highlight, Limits, Request, SearchEngine, SearchError, and_, asc, define_index, desc, eq, in_list, is_null, neq, not_in, or_, relevance, table
from vellum.operators.match import postings_frame
from vellum.plans.query import Group, Phrase, Term
from vellum.plans.search import Index, index_frame, ranked, search, search_raw

CATALOGUE = [
    ("a", "sqlite search", "portable query engine", "active", "t1", "acme", 10.0),
    ("b", "fts5 handbook", "manual mode", "active", "t1", "acme", 20.0),
    ("c", "other title", "unrelated", "draft", "t2", "beta", 5.0),
    ("d", "null status", "sqlite missing status", None, "t1", None, 15.0),
]


@pytest.fixture(scope="module")
def products(spark):
    d = define_index("products", source=table("products", "id"), searchable={"title": 5, "body": 1}, filterable={"status": "text", "tenant": "text", "brand": "text", "price": "number"}, sortable={"price": "number"}, facets=["brand", "price"], synonyms={"sqlite": ["fts5"]}, prefix=[2, 3])
    df = spark.createDataFrame(CATALOGUE, "id string, title string, body string, status string, tenant string, brand string, price double")
    return Index(d, index_frame(df, d))


def test_filters_and_nulls(products):
    assert search(products, "sqlite", Request(filter=neq("status", "active"))).ids() == []
    assert search(products, "sqlite", Request(filter=not_in("status", ["active"]))).ids() == []
    assert search(products, "sqlite", Request(filter=is_null("status"))).ids() == ["d"]


def test_browse_pages(products):
    first = search(products, "", Request(sort=(desc("price"),), limit=2))
    assert first.ids() == ["b", "d"] and first.has_more and all(r["score"] is None for r in first.rows())
    last = search(products, "", Request(sort=(desc("price"),), limit=2, offset=2))
    assert last.ids() == ["a", "c"] and not last.has_more
    assert search(products, "").ids() == ["a", "b", "c", "d"]


def test_total_facets_and_synonyms(products):
    r = search(products, "sqlite", Request(total=True))
    assert r.total == 3 and sorted(r.ids()) == ["a", "b", "d"]
    r = search(products, "", Request(filter=eq("tenant", "t1"), facets=("brand", "price")))
    assert r.facet("brand") == [("acme", 2)] and r.facet_stats() == {"price": (10.0, 20.0)}


def test_scope_is_not_widened(products):
    from vellum import bind_scope

    r = search(products, "", Request(scope=bind_scope({"tenant": "t2"}), filter=or_(eq("tenant", "t1"), eq("status", "draft")), facets=("brand",), total=True))
    assert (r.ids(), r.total, r.facet("brand")) == (["c"], 1, [("beta", 1)])


def test_fields_need_a_raw_query(products):
    assert search(products, 'title:"sqlite"').ids() == []
    assert search_raw(products, Phrase(("sqlite",), "title")).ids() == ["a"]
    with pytest.raises(SearchError):
        search_raw(products, Term("x", field="price"))


@pytest.mark.parametrize("request_", [Request(sort=(asc("status"),)), Request(sort=(relevance(),)), Request(facets=("status",)), Request(limit=0), Request(limit=101), Request(offset=10_001), Request(highlight=Highlight(("price",))), Request(highlight=Highlight(("title",), start="x" * 17)), Request(filter=eq("missing", 1)), Request(cancelled=lambda: True)])
def test_bad_requests(products, request_):
    with pytest.raises(SearchError):
        search(products, "", request_)


def test_highlight_and_documents(products):
    r = search(products, "sqlite", Request(highlight=Highlight(("title", "body")), hydrate=True))
    rows = {x["id"]: x for x in r.rows()}
    assert rows["a"]["formatted"] == {"title": "**sqlite** search", "body": "portable query engine"}
    assert rows["d"]["document"] == {"id": "d", "title": "null status", "body": "sqlite missing status", "status": None, "tenant": "t1", "brand": None, "price": 15.0}
    assert search(products, "", Request(highlight=Highlight(("title",)))).meta()["warnings"] == ["highlight-unavailable-empty-query"]


WORDS = "alpha beta gamma delta café ring red-ring widget the".split()


@pytest.fixture(scope="module")
def both(spark):
    """The same random rows in an index and in SQLite."""
    import random

    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 7))), " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for k in range(1, 41)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, body, tokenize='unicode61')")
    con.executemany("INSERT INTO f(rowid, title, body) VALUES (?, ?, ?)", rows)
    d = define_index("rows", source=table("rows", "id", "safe-integer"), searchable={"title": 5, "body": 1})
    docs = index_frame(spark.createDataFrame(rows, "id long, title string, body string"), d)
    return con, Index(d, docs), Index(d, docs, postings_frame(docs, ["title", "body"]))


CASES = [
    ('"alpha"', Term("alpha")),
    ('"alpha" AND "cafe"', Group("and", (Term("alpha"), Term("Café")))),
    ('"gamma" OR "widget"', Group("or", (Term("gamma"), Term("widget")))),
    ('"red ring"', Phrase(("red", "ring"))),
    ('"ring ring"', Term("ring-ring")),
    ('"wid" *', Term("wid", True)),
    ('"the" AND "red ri" *', Group("and", (Term("the"), Term("red-ri", True)))),
    ('title : "ring"', Term("ring", field="title")),
    ('"beta" AND ("ring" OR "delta")', Group("and", (Term("beta"), Group("or", (Term("ring"), Term("delta")))))),
    ('"alpha" AND "alpha"', Group("and", (Term("alpha"), Term("alpha")))),
]


@pytest.mark.parametrize("way", [1, 2])
@pytest.mark.parametrize(("match", "query"), CASES)
def test_same_as_fts5(both, match, query, way):
    want = {r: -s for r, s in both[0].execute("SELECT rowid, bm25(f, 5, 1) FROM f WHERE f MATCH ?", (match,))}
    got = {r["doc_id"]: r["score"] for r in ranked(both[way], query).select("doc_id", "score").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_terms_without_tokens(both):
    for ix in both[1:]:
        assert ranked(ix, Group("and", (Term("alpha"), Term("📱")))).count() == 0
        assert ranked(ix, Group("or", (Term("alpha"), Term("📱")))).count() > 0
        assert ranked(ix, Term("📱")).count() == 0


def _gadgets(spark, rows):
    d = define_index("gadgets", source=table("gadgets", "id"), searchable={"title": 1}, filterable={"status": "text", "tenant": "text", "brand": "text"}, facets=["brand"], typo="fallback")
    df = spark.createDataFrame([(i, t, "active", n, b) for i, t, n, b in rows], "id string, title string, status string, tenant string, brand string")
    return Index(d, index_frame(df, d))


def test_typo_fallback(spark):
    from vellum import bind_scope

    ix = _gadgets(spark, [("a", "iphone", "t1", "acme"), ("b", "the iphone", "t1", "acme"), ("c", "iphone case", "t1", "beta"), ("d", "iphone", "t2", "beta")])
    r = search(ix, "iphoen", Request(limit=1, total=True, facets=("brand",), scope=bind_scope({"tenant": "t1"}), filter=or_(eq("tenant", "t2"), eq("status", "active"))))
    assert (r.ids(), r.has_more, r.total, r.facet("brand"), r.fuzzy_used) == (["a"], True, 3, [("acme", 2), ("beta", 1)], True)
    assert not search(ix, "iphone").fuzzy_used
    assert search(ix, "IPHOEN").ids() == []  # case counts for near spellings


def test_exact_before_near(spark):
    ix = _gadgets(spark, [("exact", "iphone", "t1", "acme"), ("typo", "iphoen", "t1", "beta")])
    r = search(ix, "iphone", Request(total=True, highlight=Highlight(("title",))))
    assert r.ids() == ["exact", "typo"] and [x["score"] is None for x in r.rows()] == [False, True] and r.total == 2
    assert r.rows()[1]["formatted"] == {"title": None} and r.meta()["warnings"] == ["highlight-unavailable-fuzzy"]
    first, second = (search(ix, "iphone", Request(limit=1, offset=k)) for k in (0, 1))
    assert (first.ids(), first.has_more, second.ids(), second.has_more) == (["exact"], True, ["typo"], False)
    # one word of two, as written, is near too
    assert search(ix, "iphone zebra").ids() == ["exact", "typo"]


def test_arabic(spark):
    d = define_index("books", source=table("books", "id", "safe-integer"), searchable={"title": 1}, normalization=["arabic-basic"])
    ix = Index(d, index_frame(spark.createDataFrame([(0, "آيفون"), (1, "إلى الإدارة"), (2, "ايفون📱pro")], "id long, title string"), d))
    assert search(ix, "اَيفون").ids() == search(ix, "أيفون").ids() == [0, 2]
    assert search(ix, "الي الادارة").ids() == [1]
    assert search(ix, "ايفون📱pro").ids() == [2]
    assert search(ix, "أيفون", Request(hydrate=True)).rows()[0]["document"]["title"] == "آيفون"


def test_lifecycle(spark, tmp_path):
    seen = []
    engine = SearchEngine(spark, str(tmp_path / "indexes"), hook=seen.append)
    base = dict(name="notes", mode="manual", searchable={"title": 5, "body": 1}, filterable={"tenant": "text"}, sortable={"n": "integer"}, facets=["tenant"], typo="fallback")
    handle = engine.index(define_index(**base))
    with pytest.raises(SearchError) as e:
        handle.search("x")
    assert e.value.code == "SEARCH_INDEX_NOT_FOUND" and handle.doctor()[0]["code"] == "index-missing"
    assert handle.create() == "created" and handle.create() == "already-exists" and handle.search("x").ids() == []
    handle.upsert([{"id": "a", "title": "alpha"}, {"id": "a", "title": "omega", "tenant": "t1", "n": 3}, {"id": "b", "title": "beta omega", "tenant": "t2"}, {"id": "007", "body": "omega", "tenant": "t1"}])
    assert handle.search("omega").ids() == ["a", "b", "007"] and handle.search("alpha").ids() == []
    assert handle.scope({"tenant": "t1"}).search("omegq").ids() == ["007", "a"]
    assert handle.scope({"tenant": "t1"}).scope({"tenant": "t2"}).search("omega").ids() == []
    handle.upsert([{"id": "b", "title": "gamma"}])
    handle.delete(["a", "nobody"])
    assert handle.search("omega").ids() == ["007"] and handle.search("gamma").ids() == ["b"] and handle.check()
    assert seen and set(seen[0]) == {"hits", "seconds"}
    for bad in ([{"id": 1}], [{"id": "x", "title": 5}], [{"id": "x", "other": 1}], [{"id": "x", "n": 1.5}]):
        with pytest.raises(SearchError):
            handle.upsert(bad)
    # weights and synonyms are taken from the definition; a new layout is refused
    other = engine.index(define_index(**base, synonyms={"delta": ["gamma"]}))
    assert other.search("delta").ids() == ["b"] and [f["code"] for f in other.doctor()] == ["definition-drift"] and other.sync() == "updated" and other.check()
    with pytest.raises(SearchError) as e:
        engine.index(define_index(**(base | {"searchable": {"title": 1}}))).search("gamma")
    assert e.value.code == "SEARCH_INDEX_DRIFT"
    # what a crash leaves behind
    entry = handle.stored.registry()
    handle.stored._register(entry, "pending")
    with pytest.raises(SearchError) as e:
        handle.search("gamma")
    assert e.value.code == "SEARCH_MAINTENANCE_FAILED" and "registry-pending" in [f["code"] for f in handle.doctor()]
    handle.rebuild()
    assert handle.search("gamma").ids() == ["b"]
    handle.stored.store.delete(f"{handle.stored.id}/s{handle.stored.registry()['segments'][0]['at']}/grams")
    assert [f["code"] for f in handle.doctor()] == ["missing-trigram"]
    handle.drop()
    assert handle.doctor()[0]["code"] == "index-missing"


def test_linked_and_migration(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "indexes"), limits=Limits(max_limit=5, default_limit=5))
    rows = spark.createDataFrame([(0, "sqlite", "active", "db"), (5, "sqlite notes", None, "db"), (9, "other", "active", "web")], "id long, name string, status string, category string")
    base = dict(name="linked", source=table("products", "id", "safe-integer"), searchable={"name": 5})
    handle = engine.index(define_index(**base, filterable={"status": "text"}))
    handle.create(rows)
    assert handle.search("sqlite").ids() == [0, 5]
    with pytest.raises(SearchError) as e:
        handle.upsert([])
    assert e.value.code == "SEARCH_CAPABILITY_UNSUPPORTED"
    wider = engine.index(define_index(**base, filterable={"status": "text", "category": "text"}))
    with pytest.raises(SearchError) as e:
        wider.search("sqlite")
    assert e.value.code == "SEARCH_MIGRATION_REQUIRED"
    assert wider.migrate(rows) == "migration-only" and wider.search("", filter=and_(eq("category", "db"), in_list("status", ["active"]))).ids() == [0]
    assert wider.compact()["segments_after"] == 1 and wider.search("sqlite").ids() == [0, 5]


def test_stored_postings(spark, monkeypatch):
    """Rows as of the grouped occurrences, from each partition of documents alone, whatever the slices are."""
    from vellum.operators import match
    from vellum.plans.search import analyzed

    texts = ["", None, "b a b", "a", "Zoë zoe ZOE 漢字 b", "x " * 50, "c b a " * 7]
    d = define_index("rows", source=table("rows", "id", "safe-integer"), searchable={"title": 5, "body": 1})
    docs = analyzed(spark.createDataFrame([(k, texts[k % 7], texts[k * 3 % 5]) for k in range(40)], "doc_id long, title_source string, body_source string"), d)
    want = sorted(map(tuple, postings_frame(docs, ["title", "body"]).collect()))
    for size in (1, 60, 1_000_000):
        monkeypatch.setattr(match, "SLICE_TOKENS", size)
        found = match.stored_postings(docs, ["title", "body"])
        assert sorted(map(tuple, found.collect())) == want and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_migration_writes_only_docs(spark, tmp_path):
    """Of several segments, with documents that are gone; what is left of the old ones is found later too, and goes with a merge."""
    base = dict(mode="manual", searchable={"title": 1}, typo="fallback")
    handle = _notes(spark, tmp_path, **base)
    handle.upsert([{"id": f"k{k}", "title": f"alpha word{k}", "n": k} for k in range(4)])
    handle.upsert([{"id": "k1", "title": "beta"}, {"id": "k9", "title": "alpha"}])
    handle.delete(["k2"])
    wider = handle.engine.index(define_index(**(dict(name="notes", filterable={"n": "integer", "m": "integer"}) | base)))
    source = spark.createDataFrame([(f"k{k}", 10 + k, 20 + k) for k in range(9)], "id string, n long, m long")
    before = [s["at"] for s in handle.stored.registry()["segments"]]
    assert wider.migrate(source) == "migration-only" and wider.doctor() == []
    entry, store = wider.stored.registry(), wider.engine.store
    assert [s["homes"]["postings"] for s in entry["segments"]] == before and not any(store.exists(f"{wider.stored.id}/s{s['at']}/{t}") for s in entry["segments"] for t in ("postings", "grams", "gone"))
    assert wider.search("alpha", filter=eq("m", 23)).ids() == ["k3"] and wider.search("alpha").ids() == ["k9", "k0", "k3"] and sorted(wider.search("alphq").ids()) == ["k0", "k3", "k9"]
    for k in range(3):  # what a reader of the state before may read goes; what the segments share stays
        wider.upsert([{"id": f"new{k}", "title": "alpha", "m": k}])
        assert len(wider.search("alpha").ids()) == 4 + k and wider.doctor() == []
    assert not store.exists(f"{wider.stored.id}/s{before[1]}/docs") and store.exists(f"{wider.stored.id}/s{before[1]}/postings")
    wider.compact()
    wider.upsert([{"id": "new", "title": "alpha"}])
    assert len(wider.search("alpha").ids()) == 7 and not store.exists(f"{wider.stored.id}/s{before[1]}") and wider.doctor() == []


def test_merges_analyse_nothing_again(spark, tmp_path, monkeypatch):
    """A first batch is not written twice, a merge carries tokens over, and many documents that are gone are not broadcast."""
    from vellum.sources import store

    handle, analysed = _notes(spark, tmp_path), []
    real = store.analyzed
    monkeypatch.setattr(store, "analyzed", lambda docs, d: analysed.append(1) or real(docs, d))
    handle.upsert(spark.range(300).select(F.lit(0).cast("long").alias("_place"), F.format_string("k%03d", "id").alias("source_id"), F.lit("alpha beta").alias("title_source"), F.col("id").alias("n")))
    entry = handle.stored.registry()
    assert len(analysed) == 1 and [(s["at"], s["held"]) for s in entry["segments"]] == [(2, 300)] and entry["next_id"] == 301
    monkeypatch.setattr(store, "MERGE_ROWS", 5)
    handle.delete([f"k{k:03d}" for k in range(10)])
    assert len(analysed) == 2 and [s["held"] for s in handle.stored.registry()["segments"]] == [290]  # the second time for no documents
    handle.upsert([{"id": f"k{k:03d}", "title": "gamma"} for k in range(8, 18)])
    entry = handle.stored.registry()
    assert [s["held"] for s in entry["segments"]] == [292] and entry["next_id"] == 303 and handle.doctor() == []
    ids = {r["source_id"]: r["doc_id"] for r in read_docs(handle).where("title_source = 'gamma'").collect()}
    assert ids == {"k008": 301, "k009": 302} | {f"k{k:03d}": k + 1 for k in range(10, 18)} and handle.search("gamma", total=True).total == 10
    gone = entry | {"segments": [entry["segments"][0], entry["segments"][0] | {"gone": 6}, entry["segments"][0]]}
    monkeypatch.setattr(type(handle.stored), "_table", lambda self, s, table: spark.createDataFrame([(1,)], "doc_id long"))
    assert not handle.stored._read(gone, "docs")._jdf.queryExecution().analyzed().toString().count("ResolvedHint")


def read_docs(handle):
    return handle.stored._read(handle.stored.registry(), "docs")


def _notes(spark, tmp_path, **more):
    engine = SearchEngine(spark, str(tmp_path / "indexes"))
    handle = engine.index(define_index(**(dict(name="notes", mode="manual", searchable={"title": 1}, filterable={"n": "integer"}) | more)))
    handle.create()
    return handle


def test_readers_beside_a_writer(spark, tmp_path):
    """Searches never fail while documents are written, and see each batch whole; a response opened before a write can be read after it."""
    import threading

    handle = _notes(spark, tmp_path)
    handle.upsert([{"id": f"k{k}", "title": "word zero", "n": 0} for k in range(3)])
    early = handle.search("word")
    failed, seen, stop = [], set(), threading.Event()

    def read():
        while not stop.is_set():
            try:
                rows = handle.search("word", hydrate=True).rows()
                seen.add(tuple(sorted({r["document"]["n"] for r in rows})) + (len(rows),))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 5):
        handle.upsert([{"id": f"k{j}", "title": "word more", "n": k} for j in range(3)])
        if k == 1:
            assert early.ids() == ["k0", "k1", "k2"]
    stop.set()
    reader.join()
    assert not failed and all(len(x) == 2 and x[1] == 3 for x in seen)
    assert handle.search("more", filter=eq("n", 4)).ids() == ["k0", "k1", "k2"] and handle.search("zero").ids() == [] and handle.check()


def test_a_writer_that_dies(spark, tmp_path, monkeypatch):
    """At whatever step a write breaks off, the index opens as it was, and the next write is sound."""
    handle = _notes(spark, tmp_path)
    handle.upsert([{"id": "a", "title": "alpha"}])
    store = type(handle.stored)
    for step in ("_write", "_segment_findings", "_register"):
        with monkeypatch.context() as m:
            m.setattr(store, step, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                handle.upsert([{"id": "a", "title": "broken"}, {"id": "b", "title": "broken"}])
        assert handle.search("alpha").ids() == ["a"] and handle.search("broken").ids() == [] and handle.check()
    handle.upsert([{"id": "b", "title": "alpha beta"}])
    assert sorted(handle.search("alpha").ids()) == ["a", "b"] and handle.check()
    # of two writers that began at the same state one fails, and says so
    old = handle.stored.registry()
    handle.stored._register(old, "healthy")
    with pytest.raises(SearchError) as e:
        handle.stored._register(old, "healthy")
    assert e.value.details["reason"] == "concurrent-write"


def test_segments_merge(spark, tmp_path, monkeypatch):
    from vellum.sources import store

    monkeypatch.setattr(store, "MERGE_SEGMENTS", 3)
    handle = _notes(spark, tmp_path, typo="fallback")
    for k in range(3):
        handle.upsert([{"id": "a", "title": f"version{k} alpha"}, {"id": f"x{k}", "title": "other alpha"}])
        entry = handle.stored.registry()
        assert len(entry["segments"]) == (1 if k == 2 else k + 2) and entry["next_id"] == k + 3
        assert handle.search("version" + str(k)).ids()[0] == "a" and len(handle.search("alpha").ids()) == k + 2 and handle.doctor() == []
    handle.delete(["a"])
    assert handle.search("alphq").ids() == ["x0", "x1", "x2"]
    assert handle.compact() == {"segments_before": 2, "segments_after": 1, "work_remaining": False} and handle.search("alpha").ids() == ["x0", "x1", "x2"]


def test_damage_is_found(spark, tmp_path):
    handle = _notes(spark, tmp_path)
    handle.upsert([{"id": "a", "title": "alpha"}, {"id": "b", "title": "beta"}])
    docs = handle.stored._at(handle.stored.registry()["segments"][-1]["at"], "docs")
    spark.read.parquet(docs).withColumn("source_id", F.lit("a")).write.parquet(docs + "2")
    handle.engine.store.delete(docs[len(handle.engine.store.root) + 1 :])
    spark.read.parquet(docs + "2").write.parquet(docs)
    assert [f["code"] for f in handle.doctor()] == ["duplicate-source-id"]


def test_changes_of_a_linked_source(spark, tmp_path):
    from vellum.streaming.sync import apply

    engine = SearchEngine(spark, str(tmp_path / "indexes"))
    handle = engine.index(define_index("goods", source=table("goods", "id", "safe-integer"), searchable={"name": 1}, filterable={"n": "integer"}))
    handle.create(spark.createDataFrame([(1, "red ring", 1), (2, "blue ring", 2), (3, "green ring", 3), (4, "old ring", 4)], "id long, name string, n long"))
    before = {r["source_id"]: r["doc_id"] for r in handle.stored._stored(handle.stored.registry()).collect()}
    schema = "op string, id long, id_old long, name string, n long, seq long"
    # a new key, two keys that change places, one that goes, and ties: the same change twice, and a removal at the same place
    changes = [("upsert", 10, 1, "red ring", 1, 1), ("upsert", 3, 2, "blue ring", 2, 1), ("upsert", 2, 3, "green ring", 3, 1), ("delete", 4, None, None, None, 1), ("upsert", 7, None, "new ring", 7, 2), ("upsert", 7, None, "new ring", 7, 2), ("delete", 7, None, None, None, 2), ("delete", 99, None, None, None, 1)]
    apply(handle, spark.createDataFrame(changes, schema), "seq")
    after = {r["source_id"]: (r["doc_id"], r["name_source"]) for r in handle.stored._stored(handle.stored.registry()).collect()}
    assert after == {10: (before[1], "red ring"), 3: (before[2], "blue ring"), 2: (before[3], "green ring"), 7: (5, "new ring")} and handle.check()
    assert handle.search("blue").ids() == [3] and handle.search("old").ids() == []


def test_hydrator_and_cancellation(products):
    asked = []

    def documents(ids):
        asked.append(ids)
        return {"a": {"title": "from elsewhere"}}

    r = search(products, "sqlite", Request(hydrate=documents, limit=2))
    assert [x["document"] for x in r.rows()] == [{"title": "from elsewhere"} if i == "a" else None for i in r.ids()] and asked == [r.ids()]
    given_up = []
    r = search(products, "sqlite", Request(total=True, facets=("brand",), cancelled=lambda: bool(given_up)))
    given_up.append(1)
    for job in (r.rows, lambda: r.total, lambda: r.facet("brand"), r.facet_stats):
        with pytest.raises(SearchError) as e:
            job()
        assert e.value.details["reason"] == "aborted"


def test_plan_of_a_stored_search(spark, tmp_path):
    """Documents are read by their ids, without joins for the typo fallback; hits of texts are not read where nothing asks for them."""
    handle = _notes(spark, tmp_path, typo="fallback")
    handle.upsert([{"id": str(k), "title": "iphone" if k % 2 else "iphoen"} for k in range(6)])
    r = handle.search("iphone")
    exact, near = (x._jdf.queryExecution().executedPlan().toString() for x in (r.exact, r.near))
    assert "doc_id IN" in exact.replace("doc_id#", "doc_id IN #") and "title_source" not in exact and "In(doc_id" in exact
    assert near.count("Join") == near.count("LeftAnti") and "In(doc_id" in near  # only what later segments say is gone
    assert r.ids() == ["1", "3", "5", "0", "2", "4"]


def test_stream(spark, tmp_path):
    from vellum.streaming.sync import follow

    engine = SearchEngine(spark, str(tmp_path / "indexes"))
    handle = engine.index(define_index("live", mode="manual", searchable={"title": 1}, filterable={"n": "integer"}))
    handle.create()
    changes = [("upsert", "a", "alpha", 1, 1), ("upsert", "b", "beta", 2, 2), ("upsert", "a", "omega", 3, 3), ("delete", "b", None, None, 4)]
    path = str(tmp_path / "changes")
    spark.createDataFrame(changes, "op string, id string, title string, n long, seq long").write.parquet(path)
    follow(handle, spark.readStream.schema("op string, id string, title string, n long, seq long").parquet(path), "seq", str(tmp_path / "ck")).awaitTermination(120)
    assert handle.search("").ids() == ["a"] and handle.search("omega", filter=eq("n", 3)).ids() == ["a"]


def test_cli(spark, tmp_path, capsys):
    import json

    from vellum.cli import main

    spark.createDataFrame([("a", "red ring")], "id string, title string").write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "d.json").write_text(json.dumps({"name": "c", "source": {"name": "t", "key": "id"}, "searchable": {"title": 1}}))
    args = ["--root", str(tmp_path / "i"), "--definition", str(tmp_path / "d.json"), "--source", str(tmp_path / "t.parquet")]
    assert main(["init"]) == 0 and main(["backfill", *args], spark) == 2
    assert main(["backfill", *args, "--dry-run"], spark) == 0 and main(["check", *args], spark) == 1
    assert main(["backfill", *args, "--acknowledge"], spark) == 0 and main(["check", *args], spark) == 0
    assert main(["drop", *args, "--acknowledge"], spark) == 0
    assert "created" in capsys.readouterr().out


def test_queries_have_sql():
    from vellum.oracles import oracle_sql
    from vellum.queries import queries

    assert set(oracle_sql()) <= set(queries()) and set(queries()) - set(oracle_sql()) == {"highlights"}


def test_plan_reads_few_columns(products):
    assert F is not None and "CartesianProduct" not in search(products, "sqlite").hits._jdf.queryExecution().toString()


def test_postings_are_read_once(both):
    """Whatever the number of a query's tokens, one scan; made from texts as they are read, hits are kept for the jobs that read them."""
    from vellum.operators.match import from_postings, leaves_of

    query = Group("or", (Phrase(("red", "ring", "red")), Term("wid", True), Term("café", field="title")))
    found = from_postings(both[2].postings, leaves_of(query), both[2].definition.searchable)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == plan.count("regexp_extract_all") == 2  # one for each field
    assert "InMemoryTableScan" in ranked(Index(both[2].definition, both[2].docs, found_by_scan(both)), query)._jdf.queryExecution().executedPlan().toString()


def found_by_scan(both):
    """Postings with more documents than are read by their ids."""
    spark = both[2].docs.sparkSession
    return both[2].postings.unionByName(spark.range(100, 1200).select(F.lit("widget").alias("token"), F.lit("body").alias("field"), F.col("id").alias("doc_id"), F.array(F.lit(0)).alias("positions")))
