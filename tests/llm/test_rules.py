"""Line frequency and benchmark containment where rules and short items decide."""

import random

from pixelmill.llm import containment, line_frequency

LONG = " ".join(f"own{i}" for i in range(60))


def judged(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return line_frequency.line_frequency(docs.repartition(3), **more).collect()


def test_lines_go_from_all_documents(spark):
    # copies count each, rows of one id once, rows without an id each
    rows = [(i, f"{LONG}\nCopied Footer", "a") for i in range(11)]
    rows += [(100, f"{LONG}\nonce", "a")] * 30
    rows += [(None, f"{LONG} {i}\nnobody", "a") for i in range(11)]
    got = judged(spark, rows, max_share=0.0)
    lost = {}
    for r in got:
        lost.setdefault(r["doc_id"], set()).add(r["n_lines_removed"])
    assert all(lost[i] == {2} for i in range(11)) and lost[100] == {1} and lost[None] == {1}


def test_a_count_decides_on_large_hosts(spark):
    rows = [(i, f"{LONG} {i}\n" + ("footer" if i < 101 else "foot") + f"\nline {i}", "big") for i in range(1300)]
    rows += [(5000 + i, f"{LONG} {i}\n" + ("small footer" if i < 11 else ""), "small") for i in range(120)]
    got = {r["doc_id"]: r["n_lines_removed"] for r in judged(spark, rows)}
    # 101 of 1300 are under a tenth but over the count; 11 of 120 are neither
    assert {got[i] for i in range(1300)} == {1} and {got[5000 + i] for i in range(120)} == {0}
    assert {r["n_lines_removed"] for r in judged(spark, rows[:101] + [(i, f"{LONG} {i}", "big") for i in range(2000, 3200)], max_docs=101)} == {0}


def test_short_items_are_all_found(spark):
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([300, 900, 3000]))] for _ in range(200)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for size in (1, 3, 5, 6, 7, 8, 9):
        items, want = [], set()
        for k in range(600):
            d = rng.randrange(200)
            at = rng.randrange(len(texts[d]) - size)
            part = texts[d][at : at + size]
            if size == 8 and k % 2:
                # three of four shingles are enough
                part = part[:-1] + ["changed"]
            items.append((k, " ".join(part)))
            want.add((d, k))
        if size < 5:
            # a short item is one shingle of fewer words, which only an equally short text has
            items += [(1000, " ".join(texts[0]))]
            want = {(0, 1000)}
        got = {(r["doc_id"], r["item_id"]) for r in containment.contained(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
        assert want <= got, (size, len(want - got))
