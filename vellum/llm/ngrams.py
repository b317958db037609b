"""Language-model scores of documents by stupid backoff over word bigrams counted in the corpus itself.

For a word w behind v in document D, with c the corpus counts and c' those without D's own:
S(w|v) = c'(vw) / c(v) where c'(vw) > 0, else ALPHA * max(c'(w), 1/2) / N; the first word of a document has no v and
takes the second form. The score is the mean of ln S over the document's words, rounded to six places. The order is 2.

The scores are computed relationally. Documents are exploded to rows (v, w, document, times in it); a table partitioned by the hash of
(v, w) holds each bigram's rows beside its count, so that counting and joining take one shuffle; the word counts are joined to what is left to divide by
or to back off to; values are summed by document. Sorts, joins and sums are Spark's own and spill.

Nothing is hot in that shuffle. Words are counted first, by partial sums, and the WORDS most frequent ones get short codes and are broadcast with
their counts. So are the GRAMS most frequent bigrams, with exact counts from a pass of their own: a document's share of them is scored where it is
exploded, and only rarer bigrams are sent. A bigram that stands more than SEEN - 1 times in a block of BLOCK words is a candidate for that table, so what is
left out of candidates stands at most (SEEN - 1) / BLOCK of all places, however skewed the corpus is. Both bounds only steer the plan; scores are the same without.

Defined results: texts without words, empty and null ones have no words, n_words 0 and a null score; every row is a document of its own, so repeated
rows count in each other's c'; rows with a null doc_id count in the corpus but are not reported; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import buffer, mix, run_hashes, sliced, text_of, words, written

ALPHA = 0.4
#: Words of a block of documents; longer documents are blocks of their own.
BLOCK = 500_000
#: Entries of the broadcast tables: 24 bytes for a word, 16 for a bigram.
WORDS = 1 << 20
GRAMS = 1 << 18
#: Places in a block from which a bigram is a candidate for the broadcast table.
SEEN = 4
#: In place of a first word: none, as w begins its document; a row that describes its document.
_FIRST, _DOC = 1 << 40, (1 << 40) + 1
_RARE = np.uint64(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROW = "v long, w long, doc long, n int, k int, doc_id long, value double"
_NAMES = ["v", "w", "doc", "n", "k", "doc_id", "value"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]


def _gram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v * _STEP + w)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
    """Hashes of the words, number of words of each document, ids of the documents."""
    hashes, counts, ids, total = [], [], [], 0
    for batch in sliced(batches):
        begin, end, doc = words(*(pair := buffer(batch.column(1))))
        h = run_hashes(pair[0], begin, end)
        size = len(h) + batch.num_rows
        if ids and total + size > BLOCK:
            yield np.concatenate(hashes), np.concatenate(counts), ids
            hashes, counts, ids, total = [], [], [], 0
        hashes.append(h)
        counts.append(np.bincount(doc, minlength=batch.num_rows))
        ids.append(batch.column(0))
        total += size
    if ids:
        yield np.concatenate(hashes), np.concatenate(counts), ids


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each stands there."""
    x = np.sort(x)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[start], np.diff(np.concatenate([start, [len(x)]]))


def _followed(count: np.ndarray) -> np.ndarray:
    """Places of the words that another word of the same document follows."""
    on = np.ones(int(count.sum()), bool)
    on[np.cumsum(count)[count > 0] - 1] = False
    return np.flatnonzero(on)


def _place(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x stands in a sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) and of candidate bigrams (kind 1), by block."""
    for h, count, _ in _blocks(batches):
        at = _followed(count)
        gram, times = _distinct(_gram(h[at], h[at + 1]))
        often = times >= SEEN
        for kind, key, n in ((0, *_distinct(h)), (1, gram[often], times[often])):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])


def _recount(shared):
    """Exact counts of the candidates, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        total = np.zeros(len(table), np.int64)
        for h, count, _ in _blocks(batches):
            at = _followed(count)
            place, there = _place(table, _gram(h[at], h[at + 1]))
            total += np.bincount(place[there], minlength=len(table))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(table[some].view(np.int64)), pa.array(total[some])], ["key", "n"])

    return run


def _explode(shared, tokens: int):
    """Documents to rows (v, w, doc, n, k): bigram, document, times in it, times of w in it; and one row for each document, with what is already scored."""
    lone = np.log(ALPHA) - np.log(max(tokens, 1))

    def block(base: int, h: np.ndarray, count: np.ndarray, ids: list[pa.Array], tables: tuple) -> Iterator[list[np.ndarray]]:
        hashes, codes, known, grams, often = tables
        docs = len(count)
        doc = np.repeat(np.arange(docs, dtype=np.int64), count)
        u, word = np.unique(h, return_inverse=True)
        m = np.int64(max(len(u), 1))
        at, there = _place(hashes, u)
        code = np.where(there, codes[at] if len(codes) else 0, (u | _RARE).view(np.int64))
        c = np.where(there, known[at] if len(known) else 0, 0)
        held, own = _distinct(doc * m + word)
        # what begins a document
        first = (np.cumsum(count) - count)[count > 0]
        w, d = word[first], doc[first]
        k = own[np.searchsorted(held, d * m + w)]
        sure = there[w]
        value = np.bincount(d[sure], lone + np.log(np.maximum(c[w[sure]] - k[sure], 0.5)), docs)
        backed = np.bincount(d[sure], minlength=docs)
        rest = ~sure
        yield [np.full(int(rest.sum()), _FIRST), code[w[rest]], base + d[rest], np.ones(int(rest.sum())), k[rest]]
        # bigrams of each document; the products stay below 2 ** 63, as a block has few words or one document
        at = _followed(count)
        key, n = _distinct((doc[at] * m + word[at]) * m + word[at + 1])
        rest, w = np.divmod(key, m)
        d, v = np.divmod(rest, m)
        k = own[np.searchsorted(held, d * m + w)]
        at, hot = _place(grams, _gram(u[v], u[w]))
        hot &= there[v] & there[w]
        left = np.where(hot, often[at] if len(often) else 0, 0) - n
        hit, miss = hot & (left > 0), hot & (left <= 0)
        value += np.bincount(d[hit], n[hit] * (np.log(left[hit]) - np.log(c[v[hit]])), docs)
        value += np.bincount(d[miss], n[miss] * (lone + np.log(np.maximum(c[w[miss]] - k[miss], 0.5))), docs)
        backed = backed + np.bincount(d[miss], n[miss], docs).astype(np.int64)
        cold = ~hot
        yield [code[v[cold]], code[w[cold]], base + d[cold], n[cold], k[cold]]
        valid = np.concatenate([x.is_valid().to_numpy(zero_copy_only=False) for x in ids])
        number = np.concatenate([x.fill_null(0).to_numpy(zero_copy_only=False) for x in ids])
        place = base + np.flatnonzero(valid)
        yield [np.full(len(place), _DOC), place, place, count[valid], backed[valid], number[valid], value[valid]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        for h, count, ids in _blocks(batches):
            for columns in block(base, h, count, ids, shared.value):
                for low in range(0, len(columns[0]), 1 << 16):
                    part = [pa.array(x[low : low + (1 << 16)].astype(t.to_pandas_dtype())) for x, t in zip(columns, _TYPES)]
                    part += [pa.nulls(len(part[0]), t) for t in _TYPES[len(part) :]]
                    yield pa.RecordBatch.from_arrays(part, _NAMES)
            base += len(count)

    return run


def _most(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent keys, not more than `most`: all those from a count on that is a power of 2 ** (1/8)."""
    level = F.floor(F.log2("n") * 8)
    total, cut = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("keys")).collect(), key=lambda r: -r["level"]):  # at most 512 rows
        total += r["keys"]
        if total > most:
            cut = r["level"] + 1
            break
    return counts.where(level >= cut)


def _tables(source: DataFrame, most_words: int, most_grams: int) -> tuple[DataFrame, DataFrame, object, int]:
    """Counts of all words; codes and counts of the frequent ones; these and the frequent bigrams, broadcast; the number of words."""
    spark = source.sparkSession
    counted = written(source.mapInArrow(_count, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    every = counted.where("kind = 0").select("key", "n")
    tokens = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = _most(every, most_words).toArrow()
    key, n = (often.column(c).combine_chunks().to_numpy() for c in ("key", "n"))
    order = np.lexsort((key, -n))  # codes by frequency: short where they stand often
    key, n = key[order], n[order]
    codes = np.arange(len(key))
    table = written(spark.createDataFrame(pa.table({"code": codes, "c": n})), "codes")
    order = np.argsort(key.view(np.uint64))
    grams = np.sort(_most(counted.where("kind = 1").select("key", "n"), most_grams).toArrow().column("key").combine_chunks().to_numpy().view(np.uint64))
    exact = source.mapInArrow(_recount(spark.sparkContext.broadcast(grams)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    gram, times = exact.column("key").combine_chunks().to_numpy().view(np.uint64), exact.column("n").combine_chunks().to_numpy()
    by = np.argsort(gram)
    return every, table, spark.sparkContext.broadcast((key.view(np.uint64)[order], codes[order], n[order], gram[by], times[by])), tokens


def _log(c: str | Column, k: str) -> Column:
    return F.log(F.greatest(F.col(c) - F.col(k), F.lit(0.5)))


def scores(docs: DataFrame, most_words: int = WORDS, most_grams: int = GRAMS) -> DataFrame:
    """Rows (doc_id, n_words, n_backoff, score), one for each row with a doc_id. The sizes of the broadcast tables do not change them."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_of()).alias("text"))
    every, table, shared, tokens = _tables(source, most_words, most_grams)
    rows = source.mapInArrow(_explode(shared, tokens), _ROW)
    # one shuffle by bigram: its count stands beside its rows
    left = F.sum("n").over(Window.partitionBy("v", "w")) - F.col("n")
    hit, miss = F.col("kind") == "hit", F.col("kind") == "miss"
    grams = rows.withColumn("left", left).withColumn("kind", F.when(F.col("v") == _DOC, "doc").when((F.col("v") < _FIRST) & (F.col("left") > 0), "hit").otherwise("miss"))
    # a hit is divided by c(v), a miss backs off to c'(w): both add weight * ln max(c - less, 1/2)
    grams = grams.select(
        "doc", "doc_id", F.when(hit, F.col("v")).when(miss, F.col("w")).alias("word"), F.when(hit, -F.col("n")).when(miss, F.col("n")).otherwise(0).alias("weight"), F.when(miss, F.col("k")).otherwise(0).alias("less"),
        F.when(hit, F.col("n") * F.log("left")).when(miss, F.col("n") * F.lit(float(np.log(ALPHA) - np.log(max(tokens, 1))))).otherwise(F.col("value")).alias("known"),
        F.when(hit, 0).when(miss, F.col("n")).otherwise(F.col("k")).alias("backed"), F.when(~hit & ~miss, F.col("n")).alias("n_words"),
    )
    # the broadcast side has WORDS rows at most
    coded = grams.join(F.broadcast(table), F.col("word") == F.col("code"), "left")
    # words without a code wait for their counts; all else of a document becomes one row. Its own number, never negative, stands where no word waits,
    # so that these rows are spread and meet no count
    waits = F.col("word") < 0
    known = F.col("known") + F.when(F.col("c").isNotNull(), F.col("weight") * _log("c", "less")).otherwise(0.0)
    part = coded.select("doc", "doc_id", "n_words", "backed", known.alias("known"), F.when(waits, F.col("word")).otherwise(F.col("doc")).alias("waits"), *(F.when(waits, F.col(c)).otherwise(0).alias(c) for c in ("weight", "less")))
    part = part.groupBy("doc", "waits", "less").agg(F.sum("weight").alias("weight"), F.sum("known").alias("known"), F.sum("backed").alias("backed"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    rare = every.select(F.col("key").bitwiseOR(F.lit(-(1 << 63))).alias("rare"), F.col("n").alias("c")).groupBy("rare").agg(F.sum("c").alias("c"))
    joined = part.join(rare, F.col("waits") == F.col("rare"), "left")
    value = F.col("known") + F.when(F.col("c").isNotNull(), F.col("weight") * _log("c", "less")).otherwise(0.0)
    total = joined.groupBy("doc").agg(F.sum(value).alias("total"), F.sum("backed").alias("n_backoff"), F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"))
    return total.where("n_words is not null").select("doc_id", "n_words", "n_backoff", F.when(F.col("n_words") > 0, F.round(F.col("total") / F.col("n_words"), 6)).alias("score"))
