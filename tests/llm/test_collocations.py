"""Collocations against brute force and the check SQL, with streams cut into slices anywhere."""

import random
import re
from collections import Counter

import duckdb
import pytest

from check import TABLES, compare
from pixelmill.llm import collocations

SF = "/root/testdata/sf0.001"


def brute(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in cand.items():
        if any(
            la == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (la, q), b in cand.items()
        ):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return {
        (lang, i + 1, p.decode(), -a, l, r, n, -s)
        for lang, some in out.items()
        for i, (s, a, p, l, r, n) in enumerate(sorted(some)[:top])
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["the", "The", "of", "in", "spite", "é", "É", "a\x01", "a", "x y", "new", "york", "city", "\x00", "#"]
    out = [(None, None), ("en", ""), ("en", " \t.,;"), ("de", "a"), (None, "in spite of the. in spite of the"), ("en", "the the the the the the")]
    for k in range(150):
        w = []
        for _ in range(rng.randrange(60)):
            w += rng.choice([["in", "spite", "of"], ["new", "york", "city"], [rng.choice(vocab)], ["a\x01", "the"]])
            w[-1] += rng.choice(["", "", "", ".", ",", "\r", "\t", "!?"])
        out.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(w)))
    return out + out[20:30]


@pytest.mark.parametrize("block", [1 << 23, 50])
def test_collocations(spark, rows, block, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", block)
    docs = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "lang string, text string, n int, at int, phrase int")
    got = [tuple(r) for r in collocations.collocations(docs.repartition(3), min_count=5, top=30).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 5, 5, 30)
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.limit(2)).collect() == []


def test_blocks(rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "BLOCK", 40)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "text"]).slice(3)
    words = [w for b in collocations.blocks(batch) for w in b.words.take(pa.array(b.code)).to_pylist()]
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for _, t in rows[3:]]
    assert words == [w for t in low for w in re.findall("[^ \t.,;:!?\n\x0b\x0c\r]+", t)]
    long = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["word " * 3000])], ["lang", "text"])
    assert [len(b.code) for b in collocations.blocks(long)] == [3000]


@pytest.mark.parametrize("slices", [1, 2, 7, 40])
def test_walks_go_on_across_slices(spark, rows, slices, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", str(slices))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "lang string, text string")
        got = {tuple(r) for r in collocations.collocations(docs, min_count=4, top=2000).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(rows, 4, 5, 2000)


def test_scores_are_exact():
    big = 3**39
    assert collocations.lowest_cut(big, big + 1, [7, 7], [11, 11]) == (1000 * big * (big + 1) // 77, 7, 11)
    assert collocations.lowest_cut(10, 100, [20, 10], [50, 100])[1:] == (20, 50)


def test_smallest_tables(spark):
    from pixelmill.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    name = "op11_phrase_collocations"
    note, ok = compare(name, QUERIES[name](spark, SF), con, SQL[name])
    assert ok, note


@pytest.mark.parametrize("most", [1, 30, 10**6])
def test_pair_keys_are_summed_over_blocks(most):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows, all_keys = [], Counter()
    for k in (3, 3, 3, 7):
        keys = np.unique(rng.integers((k << 36) + 100 * k, (k << 36) + 100 * k + 40, 25).astype(np.uint64))
        n = rng.integers(1, 9, len(keys)).astype(np.uint64)
        all_keys.update(dict(zip(keys.tolist(), n.tolist())))
        steps = np.diff(keys, prepend=np.uint64(0))
        rows.append((k, collocations._planes(steps, 5), collocations._planes(n, 4)))
        assert (np.cumsum(collocations._from_planes(rows[-1][1], 5)) == keys).all()
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bucket", "keys", "counts"])
    bits = np.zeros(1 << 20, dtype=np.int64)
    for out in collocations.frequent_keys(10, most)(iter([batch])):
        np.bitwise_or.at(bits, out.column(0).to_numpy(), out.column(1).to_numpy())
    some = np.array(sorted(all_keys), dtype=np.uint64)
    assert collocations.passes(some, bits.view(np.uint64)).tolist() == [all_keys[k] >= 10 for k in some.tolist()]
