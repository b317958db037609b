"""HTML extraction and URL filters against brute force."""

import re
from html import unescape
from html.parser import HTMLParser

import pytest

from vellum.llm import html, urls

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">One</a></li><li>Two</li></ul></nav><!-- <p>gone</p> -->
<div class="ad">Buy now.</div><article><h1>Heading &amp; more</h1><p>%s</p><p>%s</p></article><footer>&copy; foot</footer></body></html>"""
LONG = "Some words that are long enough to be text. " * 5


def test_main_text():
    text, n, dropped = html.extract(PAGE % (LONG, "Short <b>bold</b> end."))
    assert text == f"Heading & more\n{LONG.strip()}\nShort bold end." and n == 1 and dropped == len("OneTwoBuynow.©foot")
    assert html.extract(PAGE % ("Tiny but longest text of this page, by far.", ""))[0] == "Heading & more\nTiny but longest text of this page, by far."
    for page in (None, "", "<p></p>", "<script>x", "<!-- open"):
        assert html.extract(page) == ("", 0, 0)
    assert html.extract("plain text")[0] == "plain text" and html.extract("a < b &lt; c")[0] == "a < b < c"


@pytest.mark.parametrize("tag", ["<svg width='1'/>", "<svg>", "<select><option>", "<template>", "<textarea>", "<noscript>", "<iframe src='x'>"])
def test_unclosed_elements(tag):
    assert html.extract(f"<body>{tag}<p>{LONG}</p></body>")[0] == LONG.strip()


@pytest.mark.parametrize("rest", ["<body><p>%s</p>", "<p>%s</p>", "<body><p>%s</p><script>'</head>'</script>"])
def test_unclosed_head(rest):
    head = "<html><head><meta charset='x'><title>No <p></title><script>'<body><p>'</script><style>p{}</style><!-- <p> --><link href='y'>\n"
    assert html.extract(head + rest % LONG)[0] == LONG.strip()


class Reader(HTMLParser):
    """Lines by a parser of another kind."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [""], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        if re.fullmatch("p|div|li|ul|h[1-6]|br", tag):
            self.out.append("")
        if tag in ("nav", "article", "footer", "body", "html"):
            self.out += [""] * (html.WINDOW + 1)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip -= 1
        else:
            self.handle_starttag(tag, ())

    def handle_data(self, data):
        if not self.skip:
            self.out[-1] += data


def _brute(page):
    reader = Reader()
    reader.feed(page)
    lines = [x.strip() for part in reader.out for x in part.split("\n")]
    return [re.sub(r"\s+", " ", x) for x in lines if x]


def test_lines_of_whole_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for p in pages:
        assert [x for x in html.lines_of(p["html"]) if x] == _brute(p["html"])


def test_stretches_by_brute_force(rng):
    import numpy as np

    for _ in range(200):
        length = [rng.choice([0, 0, 0, 20, 60, 200]) for _ in range(rng.randint(0, 25))]
        n = len(length)
        block = [sum(length[i : i + html.WINDOW]) for i in range(n)]
        found, at = [], 0
        while at < n:
            if not block[at]:
                at += 1
                continue
            end = at
            while end < n and block[end]:
                end += 1
            found.append((at, end))
            at = end
        big = [(a, b) for a, b in found if max(block[a:b]) > html.SURGE]
        want = big or ([max(found, key=lambda x: (sum(length[x[0] : x[1]]), -x[0]))] if found else [])
        assert html.stretches(np.array(length, np.int64), html.WINDOW, html.SURGE) == want


# the rules of the docstring as substitutions one after the other: slow on hostile pages, and only for pages whose tags are whole
RAW = r"<!--.*?(?:-->|\Z)|<(?:script\b[^>]*>.*?(?:</script\s*>|\Z)|style\b[^>]*>.*?(?:</style\s*>|\Z)|svg\b[^>]*/>)|<(?P<{0}>noscript|template|svg|select|iframe|textarea|title)\b[^>]*>.*?</(?P={0})\s*>"
# a head ends at its tag, if that comes before <body>, else at what cannot stand in a head
HEAD = rf"<head\b[^>]*>(?:(?>{RAW.format('a')}|(?!</head\b|<body\b).)*+</head\s*>|(?>{RAW.format('b')}|\s+|<(?:meta|link|base)\b[^>]*>|<[!?][^>]*>)*+)"
DROP = re.compile(rf"{HEAD}|{RAW.format('c').replace('|title', '')}|<[!?][^>]*>", re.I | re.S)
SECTION = re.compile(r"</?(?:nav|header|footer|aside|article|main|section|form|menu|dialog|body|html)\b[^>]*>", re.I)
BLOCK = re.compile(r"\s*</?(?:p|div|li|ul|ol|dl|dt|dd|h[1-6]|br|hr|tr|td|th|table|thead|tbody|tfoot|caption|blockquote|pre|figure|figcaption|address|fieldset|legend|details|summary|option|title)\b[^>]*>(?:\s*</?(?:p|div|li|ul|ol|dl|dt|dd|h[1-6]|br|hr|tr|td|th|table|thead|tbody|tfoot|caption|blockquote|pre|figure|figcaption|address|fieldset|legend|details|summary|option|title)\b[^>]*>)*\s*", re.I)


def _substituted(page):
    text = SECTION.sub("\0", DROP.sub("\n", page.replace("\0", "")))
    text = unescape(re.sub("</?[a-zA-Z][^>]*>", "", BLOCK.sub("\n", text).replace("\0", "\n" * (html.WINDOW + 1))))
    return [re.sub(r"[ \t\r\f\v\xa0]+", " ", line).strip() for line in text.split("\n")]


PIECES = "<p>|</p>|<div class=x>| |\n|  |text|a b|<b>|</b>|<br/>|<script>|</script>|<style>|</style>|<!--|-->|<!doctype html>|<?x?>|<head>|</head>|<body>|</body>|<title>|</title>|<svg/>|<svg>|</svg>|<nav>|</nav>|<article>|<select>|</select>|<meta x>|&amp;|<template>|</template >|<HEAD>|</p x>|<link>|<h1>|<1>|\0".split("|")


def test_whole_extraction_by_brute_force(spark, rng):
    pages = [p["html"] for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    pages += ["".join(rng.choices([*PIECES, LONG], k=rng.randint(1, 14))) for _ in range(5000)]
    for page in pages:
        lines = _substituted(page)
        assert html.lines_of(page) == lines
        length = [len(x.replace(" ", "")) for x in lines]
        full = [any(length[i : i + html.WINDOW]) for i in range(len(lines))]
        found = [[]]
        for i, on in enumerate(full):
            if on:
                found[-1].append(i)
            elif found[-1]:
                found.append([])
        found = [f for f in found if f]
        big = [f for f in found if max(sum(length[i : i + html.WINDOW]) for i in f) > html.SURGE]
        kept = big or sorted(found, key=lambda f: -sum(length[i] for i in f))[:1]
        assert html.extract(page) == ("\n".join(lines[i] for f in kept for i in f if lines[i]), len(kept), sum(length) - sum(length[i] for f in kept for i in f))


HOSTILE = ["<script ", "<p ", " ", "<head>", "<head><meta x>", "<svg>", "<!-- ", "<p>", "&#", "<template>", "<noscript><svg>", "</head ", "</script ", "<head><svg>", "<a>", "<head> x <title>", "</textarea", "<", "<!", "\n", "\xa0"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_time_is_linear(piece):
    import time

    took = []
    for size in (150_000, 1_200_000):
        page = piece * (size // len(piece))
        t = time.process_time()
        html.extract(page)
        took.append(time.process_time() - t)
    assert took[1] < 30 * max(took[0], 0.05)  # eight times the length: by squares it would be 64


def test_extracted_rows(spark):
    df = spark.createDataFrame([(1, PAGE % (LONG, ""), "x"), (1, PAGE % (LONG, ""), "x"), (None, "<p>a</p>", None), (2, None, None), (3, "", None)], "page_id long, html string, text string")
    got = html.extracted(df).collect()
    assert sorted((r["page_id"] or 0, r["n_blocks"]) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0)] and html.extracted(df.limit(0)).count() == 0


def _key(url, rule=False):
    m = re.match(urls._HOST, url or "")
    host = m[1].lower().rstrip(".") if m else ""
    if not host:
        return None
    path = re.match(urls._PATH, url)[1]
    return "".join(f"{x}," for x in reversed(host.split("."))) + (path if rule or path.startswith("/") else "/" + path)


@pytest.mark.parametrize("hot", [False, True])
def test_url_filters(spark, rng, hot):
    hosts = ["example.com", "www.example.com", "a.b.example.com", "example.org", "xexample.com", "com"]
    pages = [(k, rng.choice(["http://", "https://user@", "", "HTTP://"]) + rng.choice(hosts).upper() + rng.choice(["", ":80", "."]) + rng.choice(["", "/", "/a", "/a/b?x=1", "?q", "/ab#y"])) for k in range(300)]
    pages += [(300, None), (301, ""), (302, "http:///path"), (None, "http://example.com/a"), (0, "http://example.com")] + [(1000 + k, "http://example.com/a") for k in range(400 * hot)]
    rules = [(5, "block", "example.com"), (4, "allow", "example.com/a"), (3, "block", "www.example.com"), (9, "allow", "www.example.com"), (2, "block", "com"), (7, "allow", "http://Example.org/a/"), (8, "block", None), (None, "block", "org"), (10, None, "org")]
    keys = {}
    for number, action, prefix in sorted((r for r in rules if None not in r), reverse=True):
        keys[_key(prefix, True)] = (number, action)
    want = []
    for page, url in pages:
        key = _key(url)
        hits = sorted((k for k in keys if key is not None and key.startswith(k)), key=len)
        want.append((page, key, *(keys[hits[-1]] if hits else (None, "allow")), len(hits)))
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, action string")
    got = urls.decisions(df, spark.createDataFrame(rules, "rule_id long, action string, prefix string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert urls.decisions(df.limit(0), urls.rules_table(spark)).count() == 0 and unescape("&amp;") == "&"
    assert urls.decisions(df, urls.rules_table(spark).limit(0)).where("action <> 'allow' or n_rules > 0").count() == 0
