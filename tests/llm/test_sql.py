"""Queries against their check SQL: on the smallest tables, and on rows with every awkward case."""

import random

import duckdb
import pytest

from check import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = ["op1_line_frequency", "op3_jaccard_join", "op4_repeated_passages", "op7_benchmark_containment"]


def connected(folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    texts = [None, "", " \n\t\v", "one two", "Café  naïve — A B", "a a a a a a " * 30, "x y z " * 3000]
    for k in range(40):
        w = [f"x{rng.randrange(30)}" if rng.random() < 0.02 * (k % 4) else x for x in base]
        texts.append(" ".join(w) + "\nShared FOOTER # line\n\n" + f"end {k}")
    rows = [(i, t, f"s{i % 2}" if i % 9 else None, 1, 2) for i, t in enumerate(texts)]
    rows += [rows[9], rows[10], rows[10], (7, "one two", "s1", 1, 2), (None, texts[12], None, 1, 2)]
    folder = tmp_path_factory.mktemp("awkward")
    kinds = "doc_id long, text string, source string, row_key int, n int"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(0, " ".join(base[20:50])), (1, None), (2, ""), (3, "one two"), (3, texts[20]), (None, "no such words at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, awkward, name):
    from pixelmill.llm.queries import QUERIES, SQL

    con = connected(awkward, ["documents", "benchmark"])
    note, ok = compare(name, QUERIES[name](spark, awkward), con, SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", NAMES)
def test_smallest_tables(spark, name):
    from pixelmill.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    note, ok = compare(name, QUERIES[name](spark, SF), con, SQL[name])
    assert ok, note
