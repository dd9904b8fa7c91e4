"""Exact Jaccard join of documents on word shingles by filters under several token orders.

Two sets that are similar enough share a token among the first few of each under *any* order
of all tokens. Rare tokens come first here, so that most of these prefixes hold tokens no
other document has; the orders differ in how tokens of the same document frequency stand.
Candidates have to share a prefix token under every order; only those are verified.

1. ``token_sets``: distinct shingles per document; document frequencies are counted by hash
   buckets, and each document gets back its tokens that others have too.
2. Documents whose unique tokens fill their prefix can't be similar to any other. The rest
   are linked through the posting lists of the first order, one pivot per list, which gives
   clusters that hold all candidates.
3. Clusters are verified in groups of bounded size. A large cluster is cut into blocks, each
   compared with itself and the cluster's best pivots; then the documents not yet connected
   to the main part meet every block. Pairs already connected are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.arrays import mix, ranges, shingle_sets, texts
from pixelmill.operators.components import components
from pixelmill.session import cut_lineage

#: Stands for a null document id in packed columns.
NO_ID = -(1 << 63)
_FINGER = np.uint64((1 << 40) - 1)
_MAX_DF = 65535

#: Seeds of the token orders; each ranks tokens of equal frequency in its own way.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)

_PACKED = "bucket int, part long, a binary, b binary, c binary"
_SHARED = "part long, bucket int, a binary, b binary, c binary, df binary"
_SET = "doc_id long, n_shingles long, node long, shared long, tokens binary, dfs binary"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _rows(ddl: str, rows: Sequence[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    cols = zip(*rows) if rows else [[] for _ in ddl.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, kinds[c.split()[1]]) for v, c in zip(cols, ddl.split(", "))], _names(ddl)
    )


def _table(ddl: str, rows: Sequence[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(ddl, rows)])


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and the row of each value."""
    items = [np.frombuffer(b, dtype=kind) for b in column.to_pylist()]
    sizes = [len(x) for x in items]
    flat = np.concatenate(items) if items else np.empty(0, dtype=kind)
    return flat, np.repeat(np.arange(len(items)), sizes)


def _pack(buckets: int, words: int, chunk: int):
    """Per chunk of texts: a row of ids, sizes and set hashes, and a row of tokens per bucket."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, values, sizes, held = [], [], [], 0
        for batch in batches:
            for lo, hi, data, offsets in texts(batch, "text"):
                own = batch.column(0).slice(lo, hi - lo).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                v, bounds = shingle_sets(data, offsets, words)
                for a in range(0, hi - lo, 60000):
                    b = min(hi - lo, a + 60000)
                    n = int(bounds[b] - bounds[a])
                    rows = sum(map(len, ids))
                    if rows and (held + n > chunk or rows + b - a > 60000):
                        yield np.concatenate(ids), np.concatenate(values), np.concatenate(sizes)
                        ids, values, sizes, held = [], [], [], 0
                    ids.append(own[a:b])
                    values.append(v[bounds[a] : bounds[b]])
                    sizes.append(np.diff(bounds[a : b + 1]))
                    held += n
        if ids:
            yield np.concatenate(ids), np.concatenate(values), np.concatenate(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        for ids, values, sizes in chunks(batches):
            doc = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(ORDERS[0])))])
            ends = np.cumsum(sizes)
            node = mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64))
            head = (ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), node.astype("<u8").tobytes())
            rows = [(-1 - part % buckets, part, *head)]
            bucket = (values >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            values, doc = values[order], doc[order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                v, d = values[cuts[k] : cuts[k + 1]], doc[cuts[k] : cuts[k + 1]]
                low, high = v.astype("<u4"), (v >> np.uint64(32)).astype("u1")
                rows.append((k, part, low.tobytes(), high.tobytes(), _steps(d)))
            yield _rows(_PACKED, rows)
            part += 1

    return run


def _steps(ascending: np.ndarray) -> bytes:
    """Ascending small numbers as steps, which compress well: of a byte each if they fit."""
    steps = np.diff(ascending.astype(np.int64), prepend=0)
    return steps.astype("u1" if steps.max(initial=0) < 256 else "<u2").tobytes()


def _from_steps(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, dtype="u1" if len(raw) == n else "<u2"), dtype=np.int64).astype("<u2")


def _count(rows: pa.Table) -> pa.Table:
    """Of one bucket: the tokens that two documents or more have, with their frequency."""
    bucket = rows.column("bucket")[0].as_py()
    parts = rows.column("part").to_pylist()
    if bucket < 0:
        heads = zip(parts, rows.column("a").to_pylist(), rows.column("b").to_pylist(), rows.column("c").to_pylist())
        return _table(_SHARED, [(p, bucket, a, b, c, b"") for p, a, b, c in heads])
    low, row = _flat(rows.column("a"), "<u4")
    high, _ = _flat(rows.column("b"), "u1")
    sizes = np.bincount(row, minlength=len(parts)).tolist()
    doc = np.concatenate([_from_steps(c, n) for c, n in zip(rows.column("c").to_pylist(), sizes)])
    token = high.astype(np.uint64) << np.uint64(32) | low
    order = np.argsort(token, kind="stable")
    token = token[order]
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    df = np.repeat(np.diff(edge), np.diff(edge))
    order, df = order[df > 1], df[df > 1]
    back = np.argsort(row[order], kind="stable")
    order, df = order[back], np.minimum(df[back], _MAX_DF).astype("<u2")
    cuts = np.searchsorted(row[order], np.arange(len(parts) + 1))
    out = []
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        o, f = order[cuts[i] : cuts[i + 1]], df[cuts[i] : cuts[i + 1]]
        out.append((parts[i], bucket, low[o].tobytes(), high[o].tobytes(), doc[o].tobytes(), f.tobytes()))
    return _table(_SHARED, out)


def _prefix_length(n, percent: int):
    """How many first tokens of a set of n have to hold a token that a similar set has there too."""
    return n - -(-percent * n // 100) + 1


def _collect(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """Of one chunk: a row per document; tokens only if it may be similar to another."""
        bucket = rows.column("bucket").to_numpy()
        at = int(np.flatnonzero(bucket < 0)[0])
        ids, sizes, node = (
            np.frombuffer(rows.column(c)[at].as_py(), dtype=k) for c, k in (("a", "<i8"), ("b", "<u4"), ("c", "<u8"))
        )
        rest = rows.filter(pa.array(bucket >= 0))
        low, row = _flat(rest.column("a"), "<u4")
        high, _ = _flat(rest.column("b"), "u1")
        doc, _ = _flat(rest.column("c"), "<u2")
        df, _ = _flat(rest.column("df"), "<u2")
        token = rest.column("bucket").to_numpy().astype(np.uint64)[row] << np.uint64(40)
        token |= high.astype(np.uint64) << np.uint64(32) | low
        order = np.argsort(doc, kind="stable")
        token, doc, df = token[order], doc[order], df[order]
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        shared = np.diff(cuts)
        n = sizes.astype(np.int64)
        alive = (n > 0) & (n - shared < _prefix_length(n, percent))
        # one of the documents with the same set is enough
        first = np.zeros(len(ids), dtype=bool)
        first[np.unique(node, return_index=True)[1]] = True
        out = []
        for i, go in enumerate((alive & first).tolist()):
            a, b = cuts[i], cuts[i + 1]
            own = (token[a:b].tobytes(), df[a:b].tobytes()) if go else (None, None)
            out.append((int(ids[i]), int(n[i]), int(node[i].view(np.int64)), int(shared[i]), *own))
        return _table(_SET, out)

    return run


def token_sets(
    docs: DataFrame, words: int = 5, percent: int = 75, chunk: int = 1_000_000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, node, shared, tokens, dfs) of every row.

    ``node`` is a hash of the whole set. ``tokens`` are the shingles that another row has too,
    packed, with their frequencies; null where the row can't be similar to another one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = 8 * max(4, docs.rdd.getNumPartitions())
    packed = rows.mapInArrow(_pack(buckets, words, chunk), _PACKED)
    shared = packed.groupBy("bucket").applyInArrow(_count, _SHARED)
    sets = shared.groupBy("part").applyInArrow(_collect(percent), _SET)
    return cut_lineage(sets.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))))


class Sets:
    """Token sets of a group with their prefixes under every order."""

    def __init__(self, rows: pa.Table, percent: int):
        self.percent = percent
        self.node = rows.column("node").to_pylist()
        self.n = rows.column("n_shingles").to_pylist()
        self.shared = rows.column("shared").to_pylist()
        self.raw = rows.column("tokens").to_pylist()
        self.df = rows.column("dfs").to_pylist()
        self._sets: dict[int, set] = {}
        self._others: dict[int, list[set]] = {}

    def prefix(self, i: int, order: int) -> np.ndarray:
        token = np.frombuffer(self.raw[i], dtype="<u8")
        df = np.frombuffer(self.df[i], dtype="<u2")
        k = _prefix_length(self.n[i], self.percent) - (self.n[i] - self.shared[i])
        return token[np.lexsort((token, mix(token ^ np.uint64(ORDERS[order])), df))[:k]]

    def set(self, i: int) -> set:
        if i not in self._sets:
            self._sets[i] = set(np.frombuffer(self.raw[i], dtype="<u8").tolist())
        return self._sets[i]

    def others(self, i: int) -> list[set]:
        if i not in self._others:
            self._others[i] = [set(self.prefix(i, k).tolist()) for k in range(1, len(ORDERS))]
        return self._others[i]

    def similar(self, i: int, j: int) -> bool:
        """The filters one after the other, then the exact overlap."""
        both, t = self.n[i] + self.n[j], self.percent
        if (100 + t) * min(self.shared[i], self.shared[j]) < t * both:
            return False
        if any(x.isdisjoint(y) for x, y in zip(self.others(i), self.others(j))):
            return False
        same = len(self.set(i) & self.set(j))
        return 100 * same >= t * (both - same)


def _links(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """Links that connect what is similar in one group; not more than its documents."""
        s = Sets(rows, percent)
        start = rows.column("label").to_pylist()
        wanted = rows.column("wanted").to_pylist()
        root = list(range(len(s.node)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        seen: dict[int, int] = {}
        for i, name in enumerate(start):  # what is connected already, and a document given twice
            for key in (("label", name), ("node", s.node[i])):
                if key[1] is not None:
                    root[find(i)] = find(seen.setdefault(key, i))
        prefixes = [s.prefix(i, 0) for i in range(len(s.node))]
        token = np.concatenate(prefixes)
        owner = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
        # the best connected first: few unique tokens
        rank = np.argsort(np.argsort([(n - m) / n for n, m in zip(s.n, s.shared)], kind="stable"), kind="stable")
        order = np.lexsort((rank[owner], token))
        token, owner = token[order], owner[order]
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        failed: set[tuple[int, int]] = set()
        out = []
        for k in np.flatnonzero(np.diff(edge) > 1).tolist():
            members = owner[edge[k] : edge[k + 1]].tolist()
            for x, i in enumerate(members):
                for j in members[x + 1 :]:
                    if not (wanted[i] or wanted[j]) or find(i) == find(j):
                        continue
                    pair = (i, j) if i < j else (j, i)
                    if pair in failed:
                        continue
                    if s.similar(i, j):
                        root[find(i)] = find(j)
                        out.append((s.node[i], s.node[j]))
                    else:
                        failed.add(pair)
        return _table("a long, b long", out)

    return run


def _prefix_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Sets(pa.Table.from_batches([batch]), percent)
            found = [s.prefix(i, 0) for i in range(len(s.node))]
            sizes = [len(p) for p in found]
            token = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            node = np.repeat(np.array(s.node, dtype=np.int64), sizes)
            quality = np.repeat(np.array([m / n for n, m in zip(s.n, s.shared)], dtype=float), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(node), pa.array(quality)], ["token", "node", "quality"]
            )

    return run


_GROUPED = ["node", "n_shingles", "shared", "tokens", "dfs", "label", "wanted"]


def links(sets: DataFrame, percent: int = 75, block: int = 1000, pivots: int = 16) -> DataFrame:
    """(a, b): pairs of nodes that connect all nodes which chains of similar pairs connect."""
    alive = sets.filter(F.col("tokens").isNotNull()).dropDuplicates(["node"])
    alive = cut_lineage(alive.select("node", "n_shingles", "shared", "tokens", "dfs"))
    prefix = alive.mapInArrow(_prefix_rows(percent), "token long, node long, quality double")
    lists = prefix.groupBy("token").agg(
        F.max(F.struct("quality", "node")).alias("pivot"), F.count(F.lit(1)).alias("n")
    )
    lists = lists.filter(F.col("n") > 1).select("token", F.col("pivot.node").alias("pivot"))
    near = prefix.join(lists, "token").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    near = cut_lineage(near.filter(F.col("a") != F.col("b")))
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cluster = components(ends, near, [])
    sizes = cluster.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    quality = (F.col("shared") / F.col("n_shingles")).alias("quality")
    placed = cut_lineage(
        alive.select("node", quality)
        .join(cluster, "node")
        .join(sizes, "component")
        .withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    count = placed.agg(F.count(F.lit(1)), F.max("blocks")).first()
    groups = max(1, ceil((count[0] or 0) / (2 * block)))
    small = F.col("blocks") == 1
    own = F.when(small, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.col("component"))
    keyed = placed.select("node", small.alias("small"), own.alias("key"), "block")
    if (count[1] or 1) > 1:
        best = Window.partitionBy("component").orderBy(F.desc("quality"), "node")
        top = placed.filter(~small).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= pivots)
        top = cut_lineage(top.select("node", "component", "blocks", "rank"))
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        extra = top.select("node", F.lit(False).alias("small"), F.col("component").alias("key"), each)
        keyed = keyed.unionByName(extra).distinct()
    label, wanted = F.lit(None).cast("long").alias("label"), F.lit(True).alias("wanted")
    data = alive.join(keyed, "node").select("small", "key", "block", *_GROUPED[:5], label, wanted)
    first = cut_lineage(data.groupBy("small", "key", "block").applyInArrow(_links(percent), "a long, b long"))
    if (count[1] or 1) == 1:
        return first
    large = placed.filter(~small).select("node", "component", "blocks", "block")
    # what the first pass connected; the main part of a cluster is that of its best pivot
    inside = first.join(large.select(F.col("node").alias("a")), "a", "left_semi")
    part = components(large.select("node"), inside, []).withColumnRenamed("component", "label")
    large = cut_lineage(large.join(part, "node"))
    main = top.filter(F.col("rank") == 1).join(part, "node").select("component", F.col("label").alias("main"))
    off = large.join(main, "component").filter(F.col("label") != F.col("main"))
    off = cut_lineage(off.select("node", "component", "blocks", "label"))
    many = off.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / (block / 2)).cast("int").alias("chunks"))
    off = off.join(many, "component").withColumn("chunk", F.pmod(F.xxhash64("node", "label"), F.col("chunks")).cast("int"))
    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    each_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    key = ["node", "component", "block", "chunk", "label"]
    meet = off.select("*", each_block).select(*key, F.lit(True).alias("wanted"))
    meet = meet.unionByName(
        large.join(many, "component").select("*", each_chunk).select(*key, F.lit(False).alias("wanted"))
    )
    data = alive.join(meet, "node").select("component", "block", "chunk", *_GROUPED)
    second = data.groupBy("component", "block", "chunk").applyInArrow(_links(percent), "a long, b long")
    return first.unionByName(cut_lineage(second))


def jaccard_join(
    docs: DataFrame, words: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Rows are linked if the Jaccard similarity of their sets of distinct shingles, in lower
    case (A-Z), is ``percent`` hundredths or more; equal sets are. ``component_id`` is the
    smallest id that links reach. A text of fewer than ``words`` words is one shingle. Null,
    empty and wordless texts have no shingles and stay alone with their own id. Null ids link
    as others but never are a component's id; a component of null ids only has a null id.
    Repeated rows are in one component. Other columns are not looked at.
    """
    sets = token_sets(docs, words, percent, doc_id=doc_id, text=text)
    found = cut_lineage(links(sets, percent).distinct())
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    group = components(ends, found, []).withColumnRenamed("component", "group")
    nodes = sets.filter(F.col("n_shingles") > 0).groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = cut_lineage(nodes.join(group, "node", "left").withColumn("group", F.coalesce("group", "node")))
    smallest = nodes.groupBy("group").agg(F.min("first").alias("component_id"))
    by_node = nodes.join(smallest, "group").select("node", "component_id")
    out = sets.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    out = out.join(by_node, "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))
