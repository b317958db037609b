import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum import Group, Limits, Phrase, SearchError, Term, looks_like_operator, parse_query
from vellum.functions.analyze import grams_of, tokens_of
from vellum.functions.distance import allowed, closest, osa
from vellum.functions.normalize import PROFILES, Normalizer, normalize_text
from vellum.functions.snippet import snippet
from vellum.plans.filters import Filter, Scope, and_, between, bind_scope, check_filter, eq, in_list, is_null, not_, or_
from vellum.plans.query import expand_synonyms, parse_index_query, terms_of
from vellum.codecs import field_type


def test_parsing():
    assert parse_query("") is None and parse_query("  ,; ") is None
    assert parse_query("iphone pro") == Group("and", (Term("iphone"), Term("pro")))
    assert parse_query("iphone pro", "any").op == "or"
    assert parse_query('"iphone pro"') == Phrase(("iphone", "pro"))
    assert parse_query('a"b c"d') == Group("and", (Term("a"), Phrase(("b", "c")), Term("d")))
    assert parse_query("red ip", "last-prefix").children[-1] == Term("ip", True)
    assert parse_query("red i", "last-prefix").children[-1] == Term("i")
    assert parse_query('ip "x"', "last-prefix").children[-1] == Phrase(("x",))
    assert terms_of(parse_query("SKU-آيفون-15")) == ["SKU", "آيفون", "15"]
    assert terms_of(parse_query("كتاب، قلم؟")) == ["كتاب", "قلم"]
    assert terms_of(parse_query("📱 x")) == ["📱", "x"]
    assert parse_query('title:"sqlite"') == Group("and", (Term("title"), Phrase(("sqlite",))))


@pytest.mark.parametrize(("text", "reason"), [('"open', "unclosed-phrase"), ('""', "empty-phrase"), ("a\0b", "nul"), ("x" * 513, "max-query-length"), ("a " * 33, "max-terms"), ('"' + "a " * 33 + '"', "max-terms")])
def test_bad_queries(text, reason):
    with pytest.raises(SearchError) as e:
        parse_query(text)
    assert e.value.details["reason"] == reason


def test_normalised_before_parsing():
    assert parse_index_query("كتـــاب", ("arabic-basic",), "all", Limits()) == Term("كتاب")


def test_no_operators_from_text():
    rng = random.Random(20260816)
    for _ in range(400):
        text = "".join(rng.choice('ab"*():^-+ ANDORNOTNEAR\'آي,') for _ in range(rng.randint(0, 40)))
        try:
            node = parse_query(text)
        except SearchError:
            continue
        leaves = node.children if isinstance(node, Group) else [node] if node else []
        assert all(isinstance(x, (Term, Phrase)) and x.field is None and not getattr(x, "prefix", False) for x in leaves)
    assert looks_like_operator("near") and looks_like_operator("a*") and not looks_like_operator("nearby")


def test_synonyms():
    got = expand_synonyms(parse_query("SQLite fast", "last-prefix"), {"sqlite": ("fts5", "FTS5", "sqlite")})
    assert got.children[0] == Group("or", (Term("SQLite"), Term("fts5"))) and got.children[1] == Term("fast", True)
    assert expand_synonyms(parse_query('"sqlite"'), {"sqlite": ("fts5",)}) == Phrase(("sqlite",))
    with pytest.raises(SearchError):
        expand_synonyms(parse_query("a"), {"a": tuple(f"b{k}" for k in range(65))})


@pytest.mark.parametrize(
    ("text", "profiles", "expected"),
    [
        ("كتـــاب", ["arabic-basic"], "كتاب"), ("الإِدَارَة", ["arabic-basic"], "الادارة"), ("إلى", ["arabic-basic"], "الي"), ("مدرسة", ["arabic-basic"], "مدرسة"), ("مؤمن", ["arabic-basic"], "مؤمن"),
        ("قارئ", ["arabic-basic"], "قارئ"), ("٣٥", ["arabic-basic"], "٣٥"), ("٣٥", ["numeric-arabic"], "35"), ("۳", ["numeric-arabic"], "۳"), ("أَ٣", ["arabic-basic", "numeric-arabic"], "ا3"),
    ],
)
def test_normalizers(spark, text, profiles, expected):
    from pyspark.sql import functions as F

    from vellum.functions.normalize import normalize_column

    assert normalize_text(text, tuple(profiles)) == expected
    assert spark.range(1).select(normalize_column(F.lit(text), tuple(profiles)).alias("x")).first()["x"] == expected


def test_normalizer_rules():
    assert PROFILES["arabic-basic"].text("أ") == "ا"
    for bad in ((), (("a", "b"), ("b", "c")), (("ab", "c"),), (("a", "b"), ("a", "c"))):
        with pytest.raises(SearchError):
            Normalizer("x", bad)


def test_tokens_and_grams():
    assert tokens_of("Café_İstanbul ß ² ٣ 汉字!") == ["cafe", "istanbul", "ß", "²", "٣", "汉字"]
    assert tokens_of("اَيفون") == ["ا", "يفون"] and tokens_of("📱") == []
    assert grams_of("iphone") == ["iph", "pho", "hon", "one"] and grams_of("ip") == [] and len(grams_of("a📱b")) == 1


def _osa_slow(a, b):
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d(i - 2, j - 2) + 1)
        return best

    return d(len(a), len(b))


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_distance(a, b):
    assert osa(a, b) == _osa_slow(a, b)


def test_distance_rules():
    assert osa("iphoen", "iphone") == 1 and osa("ca", "abc") == 3
    assert [allowed("a" * n) for n in (4, 5, 8, 9)] == [0, 1, 1, 2]
    assert closest(["iphoen"], "the iphone case") == 1 and closest(["iphoen"], "The IPHONE") is None and closest(["case"], "case!") is None


FIELDS = {"status": field_type("text"), "price": field_type("number")}


@pytest.mark.parametrize(
    "node",
    [Filter("raw", "status", ("x",)), eq("color", "x"), eq("price", "x"), eq("price", None), in_list("price", []), and_(), Filter("not", children=()), bind_scope({"status": "a"}), and_(eq("status", "a"), Scope((("status", "b"),))), "status = 1", in_list("price", list(range(101)))],
)
def test_bad_filters(node):
    with pytest.raises(SearchError):
        check_filter(node, FIELDS)


def test_filter_limits():
    node = eq("status", "a")
    for _ in range(7):
        node = not_(node)
    check_filter(node, FIELDS)
    with pytest.raises(SearchError):
        check_filter(not_(node), FIELDS)
    check_filter(or_(*[is_null("status")] * 63), FIELDS)
    with pytest.raises(SearchError):
        check_filter(or_(*[is_null("status")] * 64), FIELDS)
    check_filter(between("price", 1, 2), FIELDS)
    with pytest.raises(SearchError):
        bind_scope({})


def test_random_filters_stay_valid(spark):
    from vellum.plans.filters import filter_column

    rng = random.Random(99)

    def tree(depth):
        if depth and rng.random() < 0.6:
            return rng.choice([lambda: and_(tree(depth - 1), tree(depth - 1)), lambda: or_(tree(depth - 1), tree(depth - 1)), lambda: not_(tree(depth - 1))])()
        return rng.choice([eq("status", "a"), in_list("price", [1, 2.5]), is_null("price"), between("price", 0, 3)])

    df = spark.createDataFrame([("a", 1.0), (None, None), ("b", 2.5)], "status string, price double")
    for k in range(200):
        node = tree(3)
        check_filter(node, FIELDS)
        if k < 20:
            df.where(filter_column(node, FIELDS)).count()


def test_same_snippets_as_fts5():
    import random
    import sqlite3

    rng, con = random.Random(8), sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61')")
    words = "alpha beta gamma delta Café ring red-ring widget the. x. y: z; q".split() + ["fill"] * 30
    texts = [rng.choice(["", "  ", "("]) + rng.choice([" ", " ", "\n"]).join(rng.choices(words, k=rng.choice([3, 10, 20, 40, 80]))) + rng.choice(["", ".", "! "]) for _ in range(300)]
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    queries = {
        '"alpha"': [(("alpha",), False)], '"alpha" OR "cafe"': [(("alpha",), False), (("cafe",), False)], '"red ring"': [(("red", "ring"), False)], '"gam" *': [(("gam",), True)],
        '"beta" OR "gamma" OR "widg" *': [(("beta",), False), (("gamma",), False), (("widg",), True)], '"ring" OR "red ring"': [(("ring",), False), (("red", "ring"), False)], '"fill fill"': [(("fill", "fill"), False)],
    }
    number = 0
    for match, leaves in queries.items():
        for k, want in con.execute("SELECT rowid, snippet(f, 0, '**', '**', '…', 16) FROM f WHERE f MATCH ?", (match,)):
            assert snippet(texts[k], leaves, "**", "**", "…") == want
            number += 1
    assert number > 800


def test_snippets():
    text = " ".join(f"w{k}" for k in range(40))
    assert snippet(text, [(("w30",), False)], "[", "]", "…") == "…" + " ".join(f"w{k}" if k != 30 else "[w30]" for k in range(23, 39)) + "…"
    assert snippet("A Café day", [(("cafe",), False)], "**", "**", "…") == "A **Café** day"
    assert snippet("one two three", [(("two", "th"), True)], "<", ">", "…") == "one <two three>"
    assert snippet(text, [(("zzz",), False)], "[", "]", "…") == " ".join(f"w{k}" for k in range(16)) + "…"
    assert snippet("", [], "[", "]", "…") == ""
