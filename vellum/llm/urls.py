"""URL filters by a sort-merge range join.

A URL's canonical key is its host's labels in reverse, each with a comma behind it, then the path: `http://A.example.com:80/x#y` has
the key `com,example,a,/x`. Host and scheme are compared in lower case; user, port and fragment are dropped; an empty path is `/`.
A rule names a host, which stands for its subdomains too, or a host with the beginning of a path, which stands for that host alone:
either way it is a prefix of keys, and so an interval [prefix, next prefix). Two such intervals are nested or apart.

Keys and intervals are put into ranges of keys, an interval into all that it meets; each range is sorted, and a sweep over it
keeps the stack of the rules that hold at the present key. The innermost rule decides. The bounds of the ranges come from a
sample of the keys and only balance the work; a key that is several bounds at once is spread over all ranges between them.

Defined results: each row is returned once; a null URL or one without a host has no key, no rule and the action `allow`, as have
URLs that no rule meets; of rules with the same prefix the one with the smallest rule_id decides; rules that are null, without a host or
without an id are left out; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import parts

#: (rule_id, action, prefix)
RULES = [
    (1, "block", "spam-farm.example.org"),
    (2, "block", "cheap-pills.example.com"),
    (3, "block", "casino-win.example.org"),
    (4, "allow", "www.casino-win.example.org/en/9"),
    (5, "allow", "www.cheap-pills.example.com/en/"),
    (6, "block", "www.cheap-pills.example.com/en/4"),
    (7, "block", "blog.tionsh.example.net"),
    (8, "allow", "blog.tionsh.example.net/de/"),
    (9, "block", "m.ththth.example.net/fr/"),
    (10, "block", "ththble.example.net"),
    (11, "allow", "ththble.example.net/es/7"),
]

#: Keys that are sampled for each range to find its bounds.
SAMPLED_PER_RANGE = 200
_ROW = "part int, key string, kind int, id long, action string"
_OUT = "page_id long, key string, rule_id long, action string, n_rules int"
_NAMES, _TYPES = ["part", "key", "kind", "id", "action"], [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string()]
_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:\s]+)"
_PATH = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]*([^#]*)"


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")


def _labels(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","))


def key_of(url: Column) -> Column:
    """The canonical key, null where there is no host."""
    path = F.regexp_extract(url, _PATH, 1)
    return F.when(_host(url) != "", F.concat(_labels(_host(url)), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))


def prefix_of(rule: Column) -> Column:
    path = F.regexp_extract(rule, _PATH, 1)
    return F.when(_host(rule) != "", F.concat(_labels(_host(rule)), path))


def rules_table(spark: SparkSession, rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_id long, action string, prefix string")


def _route(bounds: list[str], rules: bool):
    """Puts each key into its range, and each rule into all the ranges that its interval meets. Range k holds what lies from bound
    k - 1 to bound k, both included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for number, key, act in zip(*(batch.column(k).to_pylist() for k in range(3))):
                low = bisect_left(bounds, key)
                if rules:
                    high = bisect_right(bounds, key)
                    while high < len(bounds) and bounds[high].startswith(key):
                        high += 1
                    rows += [(part, key, 0, number, act) for part in range(low, high + 1)]
                else:
                    wide = bisect_right(bounds, key) - low
                    rows.append((low + (hash(number) % (wide + 1) if wide else 0), key, 1, number, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], _NAMES)

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, key and kind: a rule (kind 0) comes before the keys (kind 1) that it meets."""
    stack: list[tuple[str, int, str]] = []
    at = None
    for batch in batches:
        out: list[tuple] = []
        for part, key, kind, number, act in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind:
                rule, act = stack[-1][1:] if stack else (None, "allow")
                out.append((number, key, rule, act, len(stack)))
            elif not stack or stack[-1][0] != key:  # sorted by id: of equal prefixes the smallest stays
                stack.append((key, number, act))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32()))], ["page_id", "key", "rule_id", "action", "n_rules"])


def decisions(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (page_id, key, rule_id, action, n_rules): the deciding rule, and how many nested ones hold."""
    n = parts(pages.sparkSession)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), key_of(F.col("url")).alias("key"), F.lit(None).cast("string").alias("action"))
    known = keyed.where("key is not null")
    share = min(1.0, n * SAMPLED_PER_RANGE / max(1, pages.count()))
    sample = sorted(r["key"] for r in known.select("key").sample(share, seed=1).collect())
    bounds = [sample[len(sample) * k // n] for k in range(1, n)] if sample else []
    given = rules.select(F.col("rule_id").cast("long").alias("rule_id"), prefix_of(F.col("prefix")).alias("key"), "action").where("key is not null and rule_id is not null and action is not null")
    routed = known.mapInArrow(_route(bounds, False), _ROW).unionByName(given.mapInArrow(_route(bounds, True), _ROW))
    swept = routed.repartition(n, "part").sortWithinPartitions("part", "key", "kind", "id").mapInArrow(_sweep, _OUT)
    none = keyed.where("key is null").select("page_id", "key", F.lit(None).cast("long").alias("rule_id"), F.lit("allow").alias("action"), F.lit(0).alias("n_rules"))
    return swept.unionByName(none)
