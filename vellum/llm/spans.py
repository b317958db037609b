"""Substring dedup over sliding spans of sentences.

A sentence ends behind a run of `.`, `!`, `?` or line breaks; pieces without a word belong to the sentence before them. A span is a run of consecutive
sentences with at least WORDS words in all. Of equal spans in the whole corpus (compared by a 64-bit hash of their lower-case words) the first by (doc_id,
hash of the text, place) stays; every sentence that another one covers is removed.

Every span counts, but not every span is hashed: from each sentence the shortest one that begins there, and the shortest one that ends there. Both cover
all that any longer span covers: of a repeated span, the shortest spans within it repeat as well, and each of its sentences lies in one of them.

Spans meet in one shuffle by hash. Boilerplate may stand in a third of all documents, so spans that are seen SEEN times among the spans of a block of documents are
candidates for a broadcast table of at most HOT of them, with the first place of each from partial minima; their rows are judged where they are found. Of all other spans a
group holds less than SEEN rows for a block. Texts are shuffled only of documents that lose something, as long as the ids of these are few enough to broadcast.

Not found: passages that repeat only a part of a sentence, so of a text without `.!?` or line breaks only the whole; and passages of fewer than WORDS words, such as
single lines of boilerplate.

Defined results: null and empty texts have no spans; a document with fewer words than a span needs has none;
rows with a null doc_id give no spans and stay as they are; rows that share doc_id and text are one document and are
cleaned alike; other columns are returned as they are, and where n_sentences or n_removed is one of them, the new one gets a `_` more; n_chars, where there is such a column, follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ._arrow import BROADCAST_ROWS, buffer, mix, place_of, powers, run_hashes, sliced, strings, text_of, unused, words, written

WORDS = 20
#: Spans of a block of documents; longer documents are blocks of their own. Rows of a span in a block that make it a candidate; entries of the broadcast table.
BLOCK, SEEN, HOT = 100_000, 8, 1 << 16
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Starts of the sentences, their documents, the number of their first word (one more for the end), and the words."""
    begin, end, doc = words(raw, offsets)
    n = len(raw)
    mark = _END[raw]
    ends = np.zeros(n + 1, bool)
    ends[1:] = mark
    ends[:n] &= ~mark  # behind the last of a run of marks
    ends[offsets] = True
    piece = np.cumsum(ends)[begin] if len(begin) else begin
    first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(piece) else np.zeros(0, np.int64)
    # a sentence starts where its piece does
    cuts = np.flatnonzero(ends)
    starts = cuts[np.searchsorted(cuts, begin[first], "right") - 1] if len(first) else first
    return starts, doc[first] if len(first) else first, np.concatenate([first, [len(begin)]]), (begin, end)


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents, places of the first sentence in its document, and numbers of sentences, of all spans that are hashed."""
    starts, doc, first, (begin, end) = sentences(raw, offsets)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), doc, starts, starts
    low, stop = np.searchsorted(doc, doc), np.searchsorted(doc, doc, "right")
    at = np.arange(n)
    # the shortest span from each sentence on, and to each sentence: where it ends or begins
    ends = np.searchsorted(first, first[:-1] + WORDS)
    begins = np.searchsorted(first, first[1:] - WORDS, "right") - 1
    here, there = ends <= stop, (begins >= low) & (first[1:] >= WORDS)
    pairs = np.unique(np.concatenate([at[here] * (n + 1) + ends[here], begins[there] * (n + 1) + at[there] + 1]))
    at, to = np.divmod(pairs, n + 1)
    h = run_hashes(raw, begin, end)
    with np.errstate(over="ignore"):
        forward, inverse = powers(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * forward[: len(h)], out=total[1:])
        a, b = first[at], first[to]
        value = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
    return value, doc[at], at - low[at], to - at


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Blocks of spans: hash, doc_id, hash of the text, place, number of sentences."""
    held, size = [], 0
    for batch in sliced(batches):
        value, doc, place, number = spans(*buffer(batch.column(2)))
        ids, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if held and size + len(value) > BLOCK:
            yield [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
        held.append([value.view(np.int64), ids[doc], texts[doc], place, number])
        size += len(value)
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


_NAMES = ["span", "doc_id", "text_hash", "place", "size"]
_ROW = "span long, doc_id long, text_hash long, place int, size int"


def _rows(columns: list[np.ndarray], more: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.int32()] * 2
    arrays = [pa.array(x, t) for x, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays([*arrays, *map(pa.array, (more or {}).values())], [*_NAMES, *(more or {})])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns in _found(batches):
        key, n = np.unique(columns[0], return_counts=True)
        often = n >= SEEN
        yield pa.RecordBatch.from_arrays([pa.array(key[often]), pa.array(n[often])], ["span", "n"])


def _known(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, text_hash, spans): the non-first repeated spans of each document as (place, sentences). `hot` only steers the work."""
    spark = docs.sparkSession
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.lower(text_of()).alias("text"))
    often = source.mapInArrow(_frequent, "span long, n long").groupBy("span").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "span").limit(hot)
    shared = spark.sparkContext.broadcast(np.sort(often.toArrow().column("span").combine_chunks().to_numpy()))

    def of_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _found(batches):
            there = _known(shared.value, columns[0])[1]
            yield _rows([x[there] for x in columns])

    firsts = [np.zeros(0, np.int64)] * 4
    if len(shared.value):
        least = source.mapInArrow(of_hot, _ROW).groupBy("span").agg(F.min(F.struct("doc_id", "text_hash", "place")).alias("least")).select("span", "least.*").toArrow().sort_by("span")
        firsts = [least.column(c).combine_chunks().to_numpy() for c in ("span", "doc_id", "text_hash", "place")]
    first = spark.sparkContext.broadcast(firsts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = first.value
        for columns in _found(batches):
            at, there = _known(table[0], columns[0])
            second = there.copy()
            second[there] = (columns[1][there] != table[1][at[there]]) | (columns[2][there] != table[2][at[there]]) | (columns[3][there] != table[3][at[there]])
            keep = ~there | second
            # what is known to be a repeat needs no company: its own number spreads it
            columns[0] = np.where(second, mix((columns[1] ^ columns[2]).view(np.uint64) + columns[3].astype(np.uint64)).view(np.int64), columns[0])
            yield _rows([x[keep] for x in columns], {"again": second[keep]})

    every = source.mapInArrow(search, _ROW + ", again boolean")
    # one shuffle by span; rank keeps no rows in memory and gives repeated rows of one document the same rank
    order = Window.partitionBy("span", "again").orderBy("doc_id", "text_hash", "place")
    again = every.withColumn("_rank", F.rank().over(order)).where("again or _rank > 1")
    # of spans from one place the longest; repeated rows of a document count once, so a list is no longer than its text
    longest = again.groupBy("doc_id", "text_hash", "place").agg(F.max("size").alias("size"))
    return longest.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "size")).alias("spans"))


def _cut(raw: np.ndarray, offsets: np.ndarray, plain: tuple[np.ndarray, np.ndarray], listed: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts without their covered sentences, lengths, sentences, removed sentences. plain: starts and documents of the sentences."""
    starts, doc = plain
    n, docs = len(starts), len(offsets) - 1
    cover = np.zeros(n + 1, np.int64)
    base = np.searchsorted(doc, np.arange(docs))
    for d, spans_of in enumerate(listed):
        for s in spans_of or ():
            cover[base[d] + s["place"]] += 1
            cover[base[d] + s["place"] + s["size"]] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    stop = np.empty(n, np.int64)
    stop[:-1] = starts[1:]
    if n:
        stop[-1] = offsets[-1]
        stop = np.minimum(stop, offsets[doc + 1])
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, starts[gone], 1)
    np.add.at(edge, stop[gone], -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    return raw[keep], np.diff(kept[offsets]), np.bincount(doc, minlength=docs), np.bincount(doc[gone], minlength=docs)


def cleaned(docs: DataFrame, changed: bool = False) -> DataFrame:
    """The documents without repeated sentences, and the columns n_sentences and n_removed; with `changed` only those that lose something."""
    found = written(repeats(docs), "spans")
    number = found.count()
    ident, text_hash, listed = (unused(n, docs.columns) for n in ("_span_id", "_span_text", "_spans"))
    found = found.select(F.col("doc_id").alias(ident), F.col("text_hash").alias(text_hash), F.col("spans").alias(listed))
    same = (docs["doc_id"] == F.col(ident)) & (F.xxhash64(docs["text"]) == F.col(text_hash))
    columns = [docs[f"`{c}`"] for c in docs.columns]
    if number <= BROADCAST_ROWS:  # two numbers each: only texts that change are shuffled
        few = F.broadcast(found.select(ident, text_hash))
        joined = docs.join(few, same, "left_semi").join(found, same).select(*columns, listed)
        if not changed:
            rest = docs.join(few, same, "left_anti").select(*columns, F.lit(None).cast(found.schema[listed].dataType).alias(listed))
            joined = joined.unionByName(rest)
    else:
        joined = docs.join(found, same, "inner" if changed else "left").select(*columns, listed)
    at = place_of("text", docs)
    totals = [unused(n, docs.columns) for n in ("n_sentences", "n_removed")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            column, spans_of = batch.column(at), batch.column(batch.num_columns - 1)
            raw, offsets = buffer(column)
            starts, doc, _, _ = sentences(raw, offsets)
            fresh, lengths, total, gone = _cut(raw, offsets, (starts, doc), spans_of.to_pylist())
            if gone.any():
                text = strings(fresh, lengths)
                if column.null_count:
                    import pyarrow.compute as pc

                    text = pc.if_else(column.is_valid(), text, pa.scalar(None, pa.string()))
                batch = batch.set_column(at, batch.schema.field(at), text.cast(column.type))
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*batch.schema.names[:-1], *totals])

    schema = StructType([*docs.schema.fields])
    for name in totals:
        schema = schema.add(name, LongType())
    out = joined.mapInArrow(cut, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(totals[1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out
