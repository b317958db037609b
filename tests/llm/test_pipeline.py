"""The pipeline on a small corpus with planted cases."""

import random

import __spark_entry__
from vellum.llm import secrets

from .conftest import WORDS

SECRET = "sk_9fQ2xLr7TzVb31KdMm8pWc5Y"


def prose(rng, n):
    """Near copies are told by their words, so the vocabulary is wide: pairs of the fixture's words."""
    words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    return " ".join(w.capitalize() + "." if k % 9 == 8 else w for k, w in enumerate(words)) + "."


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    texts = [prose(rng, rng.randint(40, 120)) for _ in range(260)]
    junk, copies, leaky, keyed = set(range(0, 40, 8)), {}, {50, 90}, {60, 70}
    passage = prose(rng, 40)
    for k in junk:
        texts[k] = texts[k].upper().replace(" ", "!!## ")
    for k in leaky:
        texts[k] = texts[k] + " " + passage
    for k in keyed:
        texts[k] = f'{texts[k]} token = "{SECRET}" end.'
    for k in range(100, 130):
        copies[len(texts)] = k
        texts.append(texts[k] if k % 2 else texts[k].replace(".", " also.", 1))
    spark.createDataFrame([(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    gone = [junk, set(copies), leaky, set()]
    left = set(range(len(texts)))
    for (name, stage), drop in zip(corpus_pipeline.STAGES[:-1], gone):
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        left -= drop
        assert {r["doc_id"] for r in docs.collect()} == left, name
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == left
    for k, r in final.items():
        assert r["decoded"] == texts[k].replace(SECRET, secrets.MASK) and r["n_pieces"] == len(r["ids"]) > 0


def _brute(texts, cells, passage):
    """What run() returns, by the brute-force versions of its stages: {doc_id: ids}."""
    import itertools

    import numpy as np
    import sentencepiece as sp

    from vellum.llm import quality, sentencepiece, simhash

    from .test_documents import _brute_fingerprint, _brute_quality, _brute_statistics, words

    vectors = np.rint(np.array([_brute_statistics(t) for t in texts])).astype(np.int64)
    left = [k for k, d in enumerate(_brute_quality(vectors, [c[0] for c in cells], cells)) if d <= quality.CUTOFF]
    prints = {k: _brute_fingerprint(texts[k] or "") for k in left}
    root = {k: k for k in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations([k for k in left if prints[k][1]], 2):
        d = [(x ^ y).bit_count() for x, y in zip(prints[i][0], prints[j][0])]
        if d[0] <= simhash.TAU and sum(d) <= simhash.TAU_ALL and find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
    left = [k for k in left if find(k) == k]
    runs = [" ".join(passage[k : k + 13]) for k in range(max(1, len(passage) - 12))]
    left = [k for k in left if not any(f" {r} " in f" {' '.join(words(texts[k]))} " for r in runs)]
    model = sp.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    return {k: None if texts[k] is None else model.encode(texts[k].replace(SECRET, secrets.MASK)) for k in left}


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    from .test_documents import words

    rng = random.Random(6)
    texts = [prose(rng, rng.randint(30, 90)) for _ in range(150)]
    passage = prose(rng, 30)
    for k in range(0, 150, 9):
        texts[k] = {0: texts[k].upper().replace(" ", "!!## "), 1: texts[k] + " " + passage, 2: f'{texts[k]} token = "{SECRET}" end.'}[k % 3 if k % 2 else (k // 9) % 3]
    texts += [texts[k].replace(".", " also.", 1) for k in range(1, 60, 7)] + [texts[5], texts[5], None, "", "one", "one"]
    cells = [("en" if k % 5 else "de", f"s{k % 2}") for k in range(len(texts))]
    rows = [(k, t, *cells[k], len(t) if t is not None else None, "x") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _copy string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = _brute(texts, cells, words(passage))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 100 < len(want) < len(texts) - 20


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
