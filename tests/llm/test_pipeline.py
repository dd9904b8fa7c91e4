"""Each stage on its own input, against the operators' plain definitions."""

import re
from collections import Counter


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id < 3"))
    ins, outs = [], []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        ins.append(docs.collect())
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(docs.collect())
    assert {r["doc_id"] for r in ins[0]} >= {r["doc_id"] for r in outs[0]} and all(len(words(r["text"])) >= 50 for r in outs[0])
    kept = [shingles(r["text"]) for r in outs[1]]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(kept) for b in kept[:i] if a or b)
    seen = Counter(tuple(w[i : i + 35]) for r in ins[2] for w in [words(r["text"])] for i in range(len(w) - 34))
    after = {r["doc_id"]: words(r["text"]) for r in outs[2]}
    for r in ins[2]:
        w = words(r["text"])
        gone = {j + k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(35)}
        assert after[r["doc_id"]] == [x for j, x in enumerate(w) if j not in gone]
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {r["doc_id"] for r in ins[3] if any(100 * len(q & shingles(r["text"])) >= 75 * len(q) for q in items if q)}
    assert {r["doc_id"] for r in outs[3]} == {r["doc_id"] for r in ins[3]} - holds
    tokens = Counter()
    for r in outs[4]:
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == {r["doc_id"] for r in ins[4]} and all(r["doc_tokens"] == tokens[r["doc_id"]] for r in outs[4])


def test_quality_rules_take_frequent_lines_out(spark):
    import corpus_pipeline as p

    body = [" ".join(f"d{i}w{j}é" for j in range(60)) for i in range(30)]
    texts = [f"Site MENU here\n{b}\n\n  site menu  here" if i % 2 else f"{b}\r\n\nsite menu here\n \n" for i, b in enumerate(body[:20])]
    texts += [f"\n{b}\n\nown\n" for b in body[20:]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], rows[25]], "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted(map(tuple, p.quality_rules(spark, docs, "").collect()))
    want = []
    for i, t, *rest, n in [*rows, rows[5], rows[25]]:
        if i < 20:
            t = "\n".join(x for x in t.split("\n") if words(x.lower()) != ["site", "menu", "here"])
        want.append((i, t, *rest, len(t)))
    assert got == sorted(want) and p.quality_rules(spark, docs, "").schema == docs.schema
