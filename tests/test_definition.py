import pytest

from vellum import SearchError, define_index, define_index_from, logical_hash, physical_hash, table
from vellum.codecs import SAFE, check_id, decode, encode, field_type
from vellum.definition import classify_change, manifest
from vellum.limits import Limits, TypoPolicy

BASE = dict(name="products", mode="manual", searchable={"title": 5, "body": 1}, filterable={"status": "text"}, sortable={"price": "number"}, facets=["status"])


@pytest.mark.parametrize(
    "change",
    [
        {"name": "Products"}, {"name": "p" * 49}, {"mode": "other"}, {"mode": "linked"}, {"searchable": {}}, {"searchable": {"title": 0}}, {"searchable": {"title": float("inf")}},
        {"searchable": {"doc_id": 1}}, {"searchable": {"Near": 1}}, {"filterable": {"status": "date"}}, {"filterable": {"at": "timestamp-integer"}}, {"filterable": {"title_source": "text"}},
        {"facets": ["color"]}, {"prefix": [0]}, {"prefix": [9]}, {"strategy": "some"}, {"typo": "on"}, {"synonyms": {"": ["a"]}}, {"synonyms": {"a": [""]}}, {"normalization": ["x"]},
        {"normalization": ["arabic-basic", "arabic-basic"]},
    ],
)
def test_bad_definitions(change):
    with pytest.raises(SearchError) as e:
        define_index(**(BASE | change))
    assert e.value.code == "SEARCH_CONFIG_INVALID" and e.value.details["reason"]


def test_hashes():
    a, b = define_index(**BASE, synonyms={"x": ["y"], "a": ["b"]}), define_index(**BASE, synonyms={"a": ["b"], "x": ["y"]})
    assert logical_hash(a) == logical_hash(b)
    other = define_index(**(BASE | {"searchable": {"body": 1, "title": 5}}))
    assert logical_hash(other) != logical_hash(define_index(**BASE)) and physical_hash(other) != physical_hash(define_index(**BASE))
    heavier = define_index(**(BASE | {"searchable": {"title": 9, "body": 1}}))
    assert physical_hash(heavier) == physical_hash(define_index(**BASE)) and logical_hash(heavier) != logical_hash(define_index(**BASE))


def test_changes():
    old = manifest(define_index(**BASE))
    assert classify_change(old, manifest(define_index(**BASE, synonyms={"a": ["b"]}))) == "runtime-only"
    assert classify_change(old, manifest(define_index(**(BASE | {"filterable": {"status": "text", "brand": "text"}})))) == "migration-only"
    assert classify_change(old, manifest(define_index(**BASE, normalization=["arabic-basic"]))) == "rebuild-required"


@pytest.mark.parametrize(
    ("kind", "value", "ok"),
    [
        ("text", "a", True), ("text", 1, False), ("text", None, False), ("integer", 5, True), ("integer", 5.0, True), ("integer", 5.5, False), ("integer", True, False), ("integer", SAFE + 1, False),
        ("number", 1.5, True), ("number", float("nan"), False), ("number", float("inf"), False), ("boolean", True, True), ("boolean", 1, False), ("number", [1], False),
    ],
)
def test_codecs(kind, value, ok):
    if ok:
        assert encode(field_type(kind), value) == value
    else:
        with pytest.raises(SearchError):
            encode(field_type(kind), value)


def test_decoding_and_ids():
    assert decode(field_type("integer"), "12") == 12 and decode(field_type("boolean"), 1) is True and decode(field_type("text"), None) is None
    for bad in ("012", "1.0"):
        with pytest.raises((SearchError, ValueError)):
            decode(field_type("integer"), bad)
    assert check_id("string", "0001") == "0001" and check_id("safe-integer", 0) == 0
    for kind, value in (("string", 1), ("safe-integer", "1"), ("safe-integer", True), ("string", None)):
        with pytest.raises(SearchError):
            check_id(kind, value)
    assert field_type({"kind": "timestamp-integer", "unit": "unix-seconds"}).unit == "unix-seconds"


def test_limits():
    for bad in ({"max_limit": 0}, {"max_terms": True}, {"default_limit": 200}):
        with pytest.raises(SearchError):
            Limits(**bad)
    with pytest.raises(SearchError):
        TypoPolicy(min_length=2)


def test_from_table(spark):
    df = spark.sql("SELECT 'a' AS id, 't' AS title, 1 AS n, 2.0D AS x, true AS b, current_timestamp() AS at")
    d = define_index_from(df, "things", source=table("things", "id"), searchable={"title": 1}, filterable=["n", "b"], sortable=["x"])
    assert [t.kind for t in d.projected.values()] == ["safe-integer", "boolean-integer", "finite-real"]
    with pytest.raises(SearchError):
        define_index_from(df, "things", source=table("things", "id"), searchable={"title": 1}, filterable=["at"])
    with pytest.raises(SearchError):
        define_index_from(df, "things", source=table("things", "n"), searchable={"title": 1})
