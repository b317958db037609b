"""Secret scans by comparing two character Markov models.

A candidate is a maximal run of at least MIN_LENGTH characters of `A-Z a-z 0-9 + / _ -` that holds a letter and a digit.
One first-order model is trained from labelled random strings, another from labelled ordinary identifiers; a candidate
is a secret if the log-likelihood ratio of the two, divided by its length, reaches THRESHOLD thousandths of a nat.
Ratios are held in whole thousandths, so that sums are exact in any order.

The labelled samples are made here: random strings of six alphabets by a seeded generator, identifiers from a word list
in six spellings. Their numbers (SAMPLES each) are a parameter of `train`.

Defined results: null and empty texts hold no secret; a run that is repeated in a document is one row with its number of
occurrences; rows with a null doc_id are not reported by `secrets` but are redacted; rows that share a doc_id count as
one document; other columns are ignored (`secrets`) or returned as they are (`redacted`).
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import buffer, place_of, runs, sliced, strings, text_of

MIN_LENGTH = 16
THRESHOLD = 0
SAMPLES = 4000
MASK = "[SECRET]"
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_K = len(CHARS)
_CLASS = np.full(256, -1, np.int16)
_CLASS[[ord(c) for c in CHARS]] = np.arange(_K)
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])

_ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", CHARS[:62], CHARS[:64], CHARS[:62] + "_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789"]
_WORDS = """abstract access account action active adapter address agent align allocate amount analysis anchor angle apply archive argument array article
assert asset async attach audio author average background balance base batch binary binding block body boolean border bottom bound branch bridge browser
buffer build button cache call callback cancel capture card catalog category center chain change channel char check child circle class clean client clone
close cluster code collection color column command comment commit compare compile component compute condition config connect constant container content
context control convert copy count counter create cursor custom data date debug declare decode default delete deliver depth description detail device
dialog digest dimension direct directory disable display document domain double download driver duration dynamic edge edit element email enable encode
end engine entity entry enum environment equal error event example execute exist expand export expression extend external factor failure fetch field file
filter final find first flag float flush folder font format forward frame function gateway general generate global graph group guard handle handler hash
header health height help hidden history host icon identity image import include index info inline input insert instance integer interface internal
interval invalid item iterator join journal kernel key label language large last layer layout leaf left length level library license light limit line link
list listener load local location lock logger login long loop machine main manager mapping margin mask match matrix maximum member memory menu merge
message meta method metric middle minimum mobile mode model module monitor month mount multiple name native network next node normal notification number
object observer offset online open operator option order original output owner package page panel parameter parent parse partition password patch path
pattern payload pending permission person pipeline pixel platform player plugin point pointer policy pool popup position prefix prepare present preview
previous print priority process product profile program progress project property protocol provider proxy public publish query queue quick random range
ratio reader recent record recover reduce reference refresh region register relation release remote remove render repeat replace report request require
reset resize resolve resource response restore result retry return review right role root route router sample scale schedule schema scope score screen
script scroll search second section secret security segment select send sequence server service session setting shadow shape shard share sheet shift
signal simple single size slice socket sort source space split stack stage standard start state static status step storage store stream string style
submit suffix summary support switch symbol sync system table target task template test text theme thread time title toggle token toolbar topic total
trace track transaction transform translate transport trigger type unique unit update upload user utility valid value vector version view visible visitor
volume wait warning watch width window worker wrapper write zone
the and that this with from have for not are was were been which their would there about other after before between through during without
nicht eine einer und werden sich auch oder wenn schon haben sein unter gegen zwischen arbeit freundlich verantwortung entwicklung gesellschaft
pour dans avec sont mais comme plus cette leurs aussi entre toujours maintenant developpement information organisation environnement
para como pero desde sobre entre cuando donde tambien siempre informacion desarrollo organizacion responsable conocimiento mente cion""".split()


def labelled(n: int = SAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """n random strings (label 1) and n identifiers (label 0) of at least MIN_LENGTH characters."""
    rng, out = random.Random(seed), []
    for k in range(n):
        out.append(("".join(rng.choices(_ALPHABETS[k % len(_ALPHABETS)], k=rng.randint(MIN_LENGTH, 64))), 1))
    for k in range(n):
        parts: list[str] = []
        while sum(map(len, parts)) < MIN_LENGTH or rng.random() < 0.35:
            parts.append(rng.choice(_WORDS))
        if rng.random() < 0.4:
            parts.append(str(rng.choice([rng.randint(0, 9), rng.randint(1990, 2030), rng.randint(0, 9999)])))
        style = k % 7
        out.append(({0: "_".join(parts), 1: parts[0] + "".join(p.title() for p in parts[1:]), 2: "".join(p.title() for p in parts), 3: "-".join(parts), 4: "_".join(parts).upper(), 5: "/".join(parts), 6: "".join(parts)}[style], 0))
    return out


def train(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Thousandths of a nat by which each first character, and each transition, speaks for a random string."""
    first, step = np.full((2, _K), 0.5), np.full((2, _K, _K), 0.2)
    for text, label in rows:
        c = _CLASS[np.frombuffer(text.encode(), np.uint8)]
        first[label, c[0]] += 1
        np.add.at(step[label], (c[:-1], c[1:]), 1)
    first /= first.sum(1, keepdims=True)
    step /= step.sum(2, keepdims=True)
    return np.rint(1000 * np.log(first[1] / first[0])).astype(np.int64), np.rint(1000 * np.log(step[1] / step[0])).astype(np.int64)


@lru_cache(maxsize=2)
def model(samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    return train(labelled(samples))


def scan(raw: np.ndarray, offsets: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, documents and scores of the secrets in a buffer of texts."""
    c = _CLASS[raw]
    starts, ends, docs = runs(c >= 0, offsets)
    long = ends - starts >= MIN_LENGTH
    starts, ends, docs = starts[long], ends[long], docs[long]
    if not len(starts):
        return starts, ends, docs, starts
    total = np.zeros(len(raw) + 1, np.int64)
    pair = np.clip(c[:-1], 0, None) * np.int64(_K) + np.clip(c[1:], 0, None)
    np.cumsum(step.ravel()[pair], out=total[2:])
    score = first[c[starts]] + total[ends] - total[starts + 1]
    letters, digits = (np.concatenate([[0], np.cumsum(kind[raw])]) for kind in (_LETTER, _DIGIT))
    hit = (score >= THRESHOLD * (ends - starts)) & (letters[ends] > letters[starts]) & (digits[ends] > digits[starts])
    return starts[hit], ends[hit], docs[hit], score[hit]


def secrets(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Rows (doc_id, token, score, n): the secrets of each document with their number of occurrences."""
    first, step = model(samples)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw, offsets = buffer(batch.column(1))
            starts, ends, which, score = scan(raw, offsets, first, step)
            ids, data = batch.column(0).to_numpy(zero_copy_only=False), raw.tobytes()
            tokens = [data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[which], pa.int64()), pa.array(tokens, pa.string()), pa.array(score, pa.int64())], ["doc_id", "token", "score"])

    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(search, "doc_id long, token string, score long").groupBy("doc_id", "token", "score").agg(F.count("*").alias("n"))


def redacted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The documents with MASK in place of each secret and n_chars (where there is such a column) to match."""
    first, step = model(samples)
    mask = np.frombuffer(MASK.encode(), np.uint8)
    at = place_of("text", docs)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            column = batch.column(at)
            raw, offsets = buffer(column)
            starts, ends, which, _ = scan(raw, offsets, first, step)
            if len(starts):
                pieces, last = [], 0
                for a, b in zip(starts.tolist(), ends.tolist()):
                    pieces += [raw[last:a], mask]
                    last = b
                pieces.append(raw[last:])
                lengths = np.diff(offsets) + np.bincount(which, len(mask) - (ends - starts), len(offsets) - 1).astype(np.int64)
                fresh = strings(np.concatenate(pieces), lengths)
                if column.null_count:
                    import pyarrow.compute as pc

                    fresh = pc.if_else(column.is_valid(), fresh, pa.scalar(None, pa.string()))
                batch = batch.set_column(at, batch.schema.field(at), fresh.cast(column.type))
            yield batch

    out = docs.mapInArrow(replace, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out
