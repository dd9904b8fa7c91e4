"""The ten operators against brute force, and on nulls, ties, empty tables and clashing columns."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import (
    containment,
    factorisation,
    jaccard,
    line_frequency,
    packing,
    repeats,
    sharding,
    token_counts,
    token_files,
    transcripts,
)
from pixelmill.llm.encoding import encoded, kept, tokenizer
from pixelmill.session import scratch_dir

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    out = [None, "", " \n\t", "one two", "One  two", "a b c d e", "déjà vu — naïve", "<|endoftext|> it's x   y", "x " * 4000]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"x{rng.randrange(40)}"
        out.append(" ".join(w[: rng.choice([40, 120, 120])]) + "\nfooter line")
    out.append(out[-1])
    return [(i, t, f"s{i % 2}") for i, t in enumerate(out)] + [(None, "a b c d e", None), (5, "a b c d e", "s1")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [(i, t, s, 1, 2, 3) for i, t, s in rows]
    kinds = "doc_id long, text string, source string, k1 int, _row int, host int"
    return spark.createDataFrame(clash, kinds).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_line_frequency(docs, empty, rows):
    got = line_frequency.line_frequency(docs, min_docs=10, max_share=0.1).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, _ in rows[:-2]:
        w = words(t)
        g = Counter(zip(w, w[1:], w[2:]))
        cover = {j + k for j in range(len(w) - 2) if g[tuple(w[j : j + 3])] > 1 for k in range(3)}
        if i != 5:
            assert (by[i]["n_words"], by[i]["n_repeat_words"]) == (len(w), len(cover))
    assert sum(r["n_lines_removed"] for r in got) > 40
    assert not by[0]["kept"] and not by[8]["kept"]
    assert line_frequency.line_frequency(empty).count() == 0


def test_packing(docs, empty, rows):
    got = packing.pack(docs, BYTE, window=64).collect()
    want = Counter((i, tuple(tokenizer(BYTE).encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, _ in rows)
    assert sum(p["length"] for p in got) == sum(len(ids) * n for (_, ids), n in want.items())
    single = {i: ids for i, ids in want if i not in (None, 5)}
    for i, ids in single.items():
        mine = sorted((p for p in got if p["doc_id"] == i), key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in mine) == struct.pack(f"<{len(ids)}I", *ids)
    lengths = Counter()
    for p in got:
        lengths[p["sequence_id"]] += p["length"]
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths.values())
    assert packing.pack(empty, BYTE).count() == 0


def test_terms_outlive_kept_segments(monkeypatch):
    # kept segments start anew between two batches, as on a worker that has seen many
    known = kept(BYTE)
    monkeypatch.setattr(known, "limit", 0)
    seen = []
    for t in ("alpha beta", "gamma delta alpha beta"):
        seen.append(next(encoded(pa.RecordBatch.from_pydict({"text": [t]}), BYTE))[3].tolist())
        known.trim()
    (a, b), (c, d, e, f) = seen[0], seen[1]
    assert len({a, b, c, d, e}) == 5 and f == b


def test_packing_pages_through_all_neighbours(spark):
    # 40 documents share one rare word each with the seed and nothing with each other; 200 share nothing
    seed = "".join(f" rare{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(40))
    near = [(1000 + i, f" {w}") for i, w in enumerate(seed.split())]
    far = [(i, f"{i}") for i in range(1, 201)]
    docs = spark.createDataFrame([(0, seed), *far, *near], "doc_id long, text string").coalesce(1)
    pieces = sorted((p["sequence_id"], p["offset"], p["doc_id"]) for p in packing.pack(docs, BYTE).collect())
    assert {d for _, _, d in pieces[1:41]} == {d for d, _ in near}


def test_packing_scores_are_bm25_of_all_terms():
    rng = np.random.default_rng(5)
    texts = [rng.zipf(1.3, 80) % 300 for _ in range(90)]
    index = packing.Index(np.repeat(np.arange(90), 80), np.concatenate(texts).astype(np.uint64), 90)
    df = Counter(t for x in texts for t in set(x.tolist()))
    for seed in range(90):
        want = {}
        for d, x in enumerate(texts):
            tf = Counter(x.tolist())
            common = set(tf) & set(texts[seed].tolist())
            s = sum(np.log1p((90 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2) for t in common if df[t] > 1)
            want |= {d: s} if s else {}
        found, score = index.scores(seed)
        assert dict(zip(found.tolist(), score)) == pytest.approx(want)
        order = list(index.neighbours(seed, np.arange(90) == seed))
        assert sorted(order) == sorted(set(want) - {seed})
        assert all(want[a] >= want[b] - 1e-9 for a, b in zip(order, order[1:]))


def test_jaccard(docs, empty, rows):
    sets = []
    for _, t, _ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = label[i], label[j]
                label = [y if k == x else k for k in label]
    want = Counter()
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[k] and rows[m][0] is not None]
        want[(i, len(sets[k]), min(ids) if sets[k] else i)] += 1
    assert Counter(map(tuple, jaccard.jaccard_join(docs).collect())) == want
    assert jaccard.jaccard_join(empty).count() == 0


def test_jaccard_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(150)] = f"x{rng.randrange(60)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, jaccard.jaccard_join(df).collect()))
    links = jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda s, p: links(s, p, block=30, pivots=3))
    assert sorted(map(tuple, jaccard.jaccard_join(df).collect())) == whole


def test_repeats(docs, empty, rows):
    found = repeats.recurring_passages(docs, part_bytes=4000)
    cut = repeats.decide(found, docs)
    got = docs.select("doc_id", *repeats.keys()).join(cut, ["k1", "k2"])
    all_words = [words(t) for _, t, _ in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in all_words for i in range(len(w) - 34))
    want = Counter()
    for (i, _, _), w in zip(rows, all_words):
        gone = {j + k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(35)}
        want[(i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    kept = [(r["doc_id"], r["n_words"], r["n_removed"], "" if r["whole"] else r["kept_text"]) for r in got.collect()]
    assert Counter(kept) == want
    assert repeats.recurring_passages(empty).count() == 0


def test_transcripts(spark):
    rng = np.random.RandomState(0)
    turns = [
        (c, t, ["user", "assistant"][t % 2], "Why is that so?" if t % 2 == 0 else "Because. " * int(rng.randint(3, 9)))
        for c in range(200)
        for t in range(6)
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    lines = transcripts.as_transcripts(df)
    model = transcripts.train(lines.filter("conv_id % 4 != 2"))
    held = lines.filter("conv_id % 4 = 2")
    got = transcripts.recover_roles(held, model).select("conv_id", "pos", F.col("role").alias("r"))
    assert held.join(got, ["conv_id", "pos"]).filter("r = role").count() > 0.95 * held.count()
    long = transcripts.as_transcripts(spark.createDataFrame([(1, i, t[2], t[3]) for i, t in enumerate(turns)], df.schema))
    ends = sorted(map(tuple, transcripts.recover_roles(long, model).select("pos", "role", "opens").collect()))
    f = [tuple(r) for r in long.select("pos", *[c.cast("int") for c in transcripts.line_features(F.col("line")).values()]).orderBy("pos").collect()]
    path = transcripts.decode(model, np.array([r[1:] for r in f]), None, None)
    assert [e[1] for e in ends] == [transcripts.ROLES[s // 2] for s in path]
    nulls = spark.createDataFrame([(None, None, None, None), (1, 0, "user", None)], df.schema)
    some = transcripts.recover_roles(transcripts.as_transcripts(nulls), model)
    assert transcripts.render_turns(some).count() == 2
    assert transcripts.recover_roles(lines.limit(0), model).count() == 0


def test_token_files(spark, docs, empty, rows):
    folder = scratch_dir(spark, "t")
    token_files.write_tokens(docs, folder, WORD, end_id=2)
    got = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    want = Counter(
        zlib.crc32(struct.pack(f"<{len(x) + 1}I", *x, 2))
        for x in (tokenizer(WORD).encode(t or "", add_special_tokens=False).ids for _, t, _ in rows)
    )
    assert Counter(zlib.crc32(r["ids"]) for r in got) == want
    folder = scratch_dir(spark, "t")
    token_files.write_tokens(empty, folder, WORD, end_id=2)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_containment(spark, docs, empty, rows):
    texts = [(1, rows[12][1][30:200]), (2, None), (3, "no such words in any text"), (4, ""), (1, "a b c d e")]
    items = spark.createDataFrame(texts, "item_id long, text string")

    def sh(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    got = Counter((r["doc_id"], r["n_shared"], r["n_item"]) for r in containment.contained(docs, items.filter("text like 'w%' or text like ' w%' or item_id = 1")).collect())
    want = Counter()
    for _, t in (texts[0], texts[4]):
        q = sh(t)
        for i, x, _ in rows:
            if 100 * len(q & sh(x)) >= 75 * len(q):
                want[(i, len(q & sh(x)), len(q))] += 1
    assert sum((want & got).values()) >= 0.9 * sum(want.values()) and not got - want
    assert containment.contained(empty, items).count() == 0
    assert containment.contained(docs, items.limit(0)).count() == 0


def test_token_counts(docs, empty, rows):
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs, BYTE).collect())
    assert got == Counter((i, len(tokenizer(BYTE).encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert token_counts.token_counts(empty, BYTE).count() == 0


def test_classifier(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    all_, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = factorisation.train(all_, labels.filter(~held))
    x = factorisation.score(all_, model).join(labels.filter(held), "doc_id").toPandas()
    assert ((x.score >= 0.7) == (x.quality == 1)).mean() > 0.97
    # the linear-time pair term equals the sum over pairs
    f = factorisation.Features(np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0]), np.array([0, 3]))
    m = factorisation.Model(0.0, np.zeros(factorisation.N_FEATURES), np.random.RandomState(0).rand(factorisation.N_FEATURES, 4))
    pairs = sum(m.factors[a] @ m.factors[b] * u * v for a, b, u, v in ((1, 5, 0.5, 1), (1, 9, 0.5, 2), (5, 9, 1, 2)))
    assert abs(m.raw(f)[0][0] - pairs) < 1e-9
    assert factorisation.score(docs, model).count() == docs.count()
    assert factorisation.score(empty, factorisation.train(empty, labels.limit(0))).count() == 0


def test_sharding(docs, empty, rows):
    got = sharding.shard(docs, limit=4000).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in got:
        size[r["shard_id"]] += r["n_bytes"]
    assert all(r["shard_bytes"] == size[r["shard_id"]] for r in got)
    assert all(r["fits"] for r in got if r["shard_bytes"] <= 4000)
    assert all(r["shard_docs"] == 1 for r in got if not r["fits"])
    assert sharding.shard(empty, limit=10).count() == 0
