"""The prefix trie against a trie built turn by turn, and against the check SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from check import TABLES, compare
from pixelmill.llm import prefix_trie as pt

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string, key string, k int"


def own_turns(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), tie, (role, text)))
    return {c: [x[2] for x in sorted(some, key=lambda x: x[:2])] for c, some in convs.items()}


def rebuilt(rows):
    own, out = own_turns(rows), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for k, some in members.items():
        under = [u for u in members if u[: len(k)] == k]
        kids = [u for u in members if len(u) == len(k) + 1 and u[: len(k)] == k]
        leaves = [u for u in under if not any(len(v) == len(u) + 1 and v[: len(u)] == u for v in under)]
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in under if u)
        ends = ",".join(map(str, sorted(c for c in some if len(convs[c]) == len(k))))
        above = min(members[k[:-1]]) if k else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(some), len(k), above, len(some), len(kids), len(leaves), saved, sha))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(None, 0, "user", "nobody", "", 1)]
    for c in range(-6, 60):
        if c in (10, 25):
            continue
        for t in range(rng.randrange(1, 14)):
            text = f"say {t} é" if rng.random() < 0.8 else rng.choice([None, "", "x", f"own {c}"])
            out.append((c, t if rng.random() < 0.9 else rng.choice([None, 3]), rng.choice(["user", "user", None]), text, "", 1))
    return out + out[40:44]


def got(df):
    return sorted(((*r,) for r in df.collect()), key=str)


def test_rebuilt_conversations(spark, rows):
    turns = pt.turn_digests(spark.createDataFrame(rows, KIND).repartition(4))
    df = pt.prefix_trie(*pt.with_shared_heads(turns))
    assert got(df) == brute(rebuilt(rows))


@pytest.mark.parametrize("block", [1, 3, 4])
def test_plain_conversations(spark, rows, block, monkeypatch):
    monkeypatch.setattr(pt, "STRETCH", 2)
    monkeypatch.setattr(pt, "CHUNK", 3)
    turns = pt.turn_digests(spark.createDataFrame(rows, KIND))
    convs = turns.groupBy("conv_id").count().withColumnRenamed("count", "n_turns")
    df = pt.prefix_trie(convs, turns.join(convs, "conv_id"), block)
    assert got(df) == brute(own_turns(rows))


def test_hot_conversations(spark):
    """Copies of one conversation, one long conversation, and one turn that all begin with."""
    rows = [(c, t, "user", f"t{t}", "", 1) for c in range(300) for t in range(5)]
    rows += [(1000, t, "user", f"t{t}", "", 1) for t in range(200)]
    rows += [(c, t, "user", "t0" if t == 0 else f"{c}", "", 1) for c in range(2000, 2300) for t in range(2)]
    turns = pt.turn_digests(spark.createDataFrame(rows, KIND))
    convs = turns.groupBy("conv_id").count().withColumnRenamed("count", "n_turns")
    df = pt.prefix_trie(convs, turns.join(convs, "conv_id"))
    assert got(df) == brute(own_turns(rows))


def test_empty(spark, rows):
    for some in ([], rows[:1]):
        turns = pt.turn_digests(spark.createDataFrame(some, KIND))
        assert pt.prefix_trie(*pt.with_shared_heads(turns)).collect() == []


@pytest.mark.parametrize("sf", [SF, None])
def test_check_sql(spark, rows, sf, tmp_path):
    from pixelmill.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    if sf is None:
        sf, tables = str(tmp_path), ["conversations"]
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{sf}/conversations.parquet")
    else:
        tables = TABLES
    for t in tables:
        glob = "" if sf == SF else "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet{glob}')")
    name = "op13_conversation_trie"
    note, ok = compare(name, QUERIES[name](spark, sf), con, SQL[name])
    assert ok, note
