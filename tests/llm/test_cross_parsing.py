"""Cross-parsing against longest matches found by hand, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import cross_parsing as cp

SF = "/root/testdata/sf0.01"


def model_of(samples):
    built = {k: cp.suffix_automaton(v) for k, v in sorted(samples.items())}
    return cp.Model(
        tuple(built), tuple(len(samples[k]) for k in built), tuple(b[0] for b in built.values()), tuple(b[1] for b in built.values())
    )


def by_hand(sample, text):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_automaton_has_all_substrings_and_no_other():
    rng = random.Random(1)
    for _ in range(30):
        s = bytes(rng.choice(b"abc") for _ in range(rng.randrange(40)))
        n, edges = cp.suffix_automaton(s)
        go = {(a, c): b for a, c, b in edges.tolist()}
        assert n <= max(2, 2 * len(s))
        for _ in range(200):
            t = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 7)))
            at = 0
            for c in t:
                at = go.get((at, c), -1)
            assert (at >= 0) == (t in s)


@pytest.mark.parametrize("stretch", [2048, 7])
def test_phrases(stretch, monkeypatch):
    monkeypatch.setattr(cp, "STRETCH", stretch)
    monkeypatch.setattr(cp, "LANES", 5)
    rng = random.Random(2)
    samples = {k: bytes(rng.choice(b"abcde ") for _ in range(size)) for k, size in (("x", 300), ("y", 40), ("z", 1))}
    texts = ["", "q", "qq a", *["".join(rng.choice("abcde fq") for _ in range(rng.randrange(90))) for _ in range(40)]]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    got = cp.Parser(model_of(samples)).phrases(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    for t, row in zip(raw, got.tolist()):
        parts = [t[i : i + stretch] for i in range(0, len(t), stretch)]
        assert row == [sum(by_hand(samples[k], p) for p in parts) for k in "xyz"]


def test_letters():
    got = cp.letters(pa.array(["Éa—B\n\n9 c", None, "", "123", "שלום  עולם"])).to_pylist()
    assert got == ["éa b c", "", "", " ", "שלום עולם"]


def test_rows(spark):
    rows = [(1, "aa ab aa ab", "x", 1), (2, "cc cd CC cd", "y", 2), (3, None, "x", 3), (None, "aa ab", None, 4), (5, "", "y", 5)]
    rows += [(6, " 12 -- ", "x", 6), (7, "cd cc " * 400_000, None, 7), (7, "cd cc", "y", 8), (7, "cd cc", "y", 8), (9, "éé", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrases int")
    model = cp.train(docs)
    assert model.langs == ("x", "y")
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["n_bytes"]) for r in cp.identify(docs, model).collect())
    assert [g[:2] for g in got] == [
        (0, "x"), (1, "x"), (2, "y"), (3, "und"), (5, "und"), (6, "und"), (7, "y"), (7, "y"), (7, "y"), (9, "x"),
    ]
    assert got[8][2] == 2_400_000
    scores = [r["score"] for r in cp.identify(docs, model).collect()]
    assert all(0 <= s <= 1 for s in scores)
    # nothing learned, nothing to judge
    none = cp.train(docs.filter("lang is null"))
    assert none.langs == () and {r["lang_pred"] for r in cp.identify(docs, none).collect()} == {"und"}
    assert cp.train(docs.limit(0)).langs == () and cp.identify(docs.limit(0), model).collect() == []


def test_sample_is_bounded(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("abc"), F.md5(F.col("id").cast("string"))).alias("text"), F.lit("x").alias("lang"))
    model = cp.train(docs, rows=50, size=600)
    assert model.symbols[0] <= 601
    assert cp.train(docs.repartition(5), rows=50, size=600).states == model.states


def test_held_out_accuracy(spark):
    from pixelmill.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op12_language_cross_parsing"](spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert 250 < len(held) < 420 and np.mean(held) > 0.97
