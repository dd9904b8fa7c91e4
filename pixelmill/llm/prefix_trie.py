"""A trie of conversation prefixes by fixed-length block hashing.

Turns are digested, and every ``block`` successive turns of a conversation make one block
with a digest of its own. Conversations are grouped by their blocks so far, so a group of
copies is one row per block from there on. Only where a group goes on in more than one way
are the turns inside its next blocks told apart; everywhere else they have the block's
members. A node belongs to its smallest member. A conversation that owns a node owns all
deeper ones on its way, so sums over a subtree are sums over its members less what their
owner has above it, and no pass goes level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.ordered import row_index, running
from pixelmill.session import cut_lineage

#: Long conversations are joined in stretches of this many turns or blocks.
STRETCH = 4096
#: Ids that are written out as one string before hashing.
CHUNK = 512

ROOT = ""
_NOBODY = hashlib.sha256(b"").hexdigest()


def turn_digests(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, n_bytes) of each turn; pos counts from 0 within the conversation.

    Turns go in order, null first, then by digest; null roles and texts are empty, and turns
    without a conversation are left out.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t))
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(t).cast("long").alias("n_bytes")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    return row_index(rows, ["conv_id"], order, "pos").select("conv_id", "pos", "digest", "n_bytes")


def with_shared_heads(turns: DataFrame, span: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of another: (conversations, their turns).

    Conversation c takes its first h turns from conversation c - c % ``span``, with h its crc32
    modulo ``most``, and the others from itself; (conv_id, n_turns) has those without turns too.
    """
    turns = cut_lineage(turns)
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % span).alias("base"))
    bases = convs.filter(F.col("conv_id") % span == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shared = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("shared", shared)
    convs = cut_lineage(convs.withColumn("n_turns", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))

    first = turns.filter((F.col("conv_id") % span == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    heads = convs.drop("n").join(first, "base").filter("pos < h").select("conv_id", "n_turns", "pos", "digest", "n_bytes")
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH)))
    own = turns.withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    tails = own.join(convs.withColumn("stretch", stretch), ["conv_id", "stretch"]).filter("pos >= h")
    tails = tails.select("conv_id", "n_turns", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "digest", "n_bytes")
    return convs.select("conv_id", "n_turns"), heads.unionByName(tails)


def _parts(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def block_paths(turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, k, n_turns, digests, sizes, parent, chain): each block with the blocks before it.

    ``chain`` stands for all blocks up to this one and ``parent`` for those before. It comes
    from sums of the blocks' 32-bit parts, so it runs on across the slices of a long conversation.
    """
    rows = turns.withColumn("k", F.floor(F.col("pos") / block))
    some = F.array_sort(F.collect_list(F.struct("pos", "digest", "n_bytes")))
    rows = rows.groupBy("conv_id", "k", "n_turns").agg(some.alias("some"))
    rows = rows.withColumn("own", F.md5(F.concat_ws(",", F.col("k").cast("string"), F.col("some.digest"))))
    rows = rows.select("conv_id", "k", "n_turns", F.col("some.digest").alias("digests"), F.col("some.n_bytes").alias("sizes"), *[p.alias(f"p{i}") for i, p in enumerate(_parts(F.col("own")))])
    rows = running(rows, ["conv_id"], ["k"], {f"s{i}": ("sum", f"p{i}") for i in range(4)})
    chain = F.md5(F.concat_ws(",", F.col("k").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]))
    before = [(F.col(f"s{i}") - F.col(f"p{i}")).cast("string") for i in range(4)]
    parent = F.md5(F.concat_ws(",", (F.col("k") - 1).cast("string"), *before))
    parent = F.when(F.col("k") == 0, F.lit(ROOT)).otherwise(parent)
    return rows.select("conv_id", "k", "n_turns", "digests", "sizes", parent.alias("parent"), chain.alias("chain"))


def refine(blocks: DataFrame, block: int, aggs: list[Column], each: list[str]) -> DataFrame:
    """(key, parent_key, depth, n_bytes, end_chain, aggregates): nodes at all turn boundaries.

    ``blocks`` has one row per distinct chain. A block without siblings is taken apart without
    looking at its turns; among siblings, turns are told apart by the block's digests so far.
    """
    first = F.slice("digests", 1, F.col("j"))
    here = F.when(F.col("alone"), F.concat_ws(":", "chain", "j")).otherwise(F.md5(F.concat_ws(",", F.col("parent"), first)))
    at_end = F.col("j") == block
    rows = blocks.withColumn("j", F.explode(F.sequence(F.lit(1), F.size("digests"))))
    rows = rows.withColumn("key", F.when(at_end, F.col("chain")).otherwise(here))
    last = F.slice("digests", 1, F.col("j") - 1)
    above = F.when(F.col("alone"), F.concat_ws(":", "chain", (F.col("j") - 1).cast("string"))).otherwise(F.md5(F.concat_ws(",", F.col("parent"), last)))
    rows = rows.select(
        "key",
        F.when(F.col("j") == 1, F.col("parent")).otherwise(above).alias("parent_key"),
        (F.col("k") * block + F.col("j")).alias("depth"),
        F.get("sizes", F.col("j") - 1).alias("n_bytes"),
        F.when(F.col("j") == F.size("digests"), F.col("chain")).alias("end_chain"),
        "alone",
        *each,
    )
    keys = ["key", "parent_key", "depth", "n_bytes"]
    split = rows.filter(~F.col("alone")).groupBy(*keys).agg(F.max("end_chain").alias("end_chain"), *aggs)
    return split.unionByName(rows.filter("alone").select(*split.columns))


def id_digests(ends: DataFrame) -> DataFrame:
    """(chain, sha): SHA-256 of each chain's conv_ids, ascending, joined by commas.

    Ids are sorted and written out in slices wherever they lie; only then does one stream per
    chain go through them in order, as SHA-256 has to, in memory of a few strings.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chain", "first", "ids"]
        for batch in batches:
            chains, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, lo = [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or chains[i] != chains[lo] or i - lo == CHUNK:
                    rows.append((chains[lo], ids[lo], ",".join(map(str, ids[lo:i]))))
                    lo = i
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for chain, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if chain == now:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    done.append((now, sha.hexdigest()))
                now, sha = chain, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["chain", "sha"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["chain", "sha"])

    rows = ends.select("chain", "conv_id").repartitionByRange("chain", "conv_id").sortWithinPartitions("chain", "conv_id")
    written = rows.mapInArrow(write, "chain string, first long, ids string")
    return written.repartition("chain").sortWithinPartitions("chain", "first").mapInArrow(digest, "chain string, sha string")


def prefix_trie(convs: DataFrame, turns: DataFrame, block: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``convs`` is (conv_id, n_turns), one row per conversation; ``turns`` is (conv_id, n_turns, pos,
    digest, n_bytes) with pos from 0. A node is a distinct sequence of first turns, told apart by
    128-bit digests, and its conv_id the smallest that starts with it. Conversations without
    turns end at the root. saved_tokens is the bytes that members share below and at the node.
    An empty table has no nodes.
    """
    paths = cut_lineage(block_paths(turns, block))
    keys = ["parent", "chain", "k", "digests", "sizes"]
    groups = paths.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    groups = cut_lineage(groups)
    # keyed by the only child, so that the join has one row per key on both sides
    alone = groups.groupBy("parent").agg(F.min("chain").alias("chain"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    flag = F.coalesce("alone", F.lit(False)).alias("alone")
    groups = groups.join(alone.select("chain", F.lit(True).alias("alone")), "chain", "left")
    groups = cut_lineage(groups.select(*keys, "conv_id", "n_convs", flag))

    members = [F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")]
    top = convs.agg(*[F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")]).filter("n_convs > 0")
    long_null, text_null = F.lit(None).cast("long"), F.lit(None).cast("string")
    root = top.select(
        F.lit(ROOT).alias("key"), text_null.alias("parent_key"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"),
        F.lit(ROOT).alias("end_chain"), "conv_id", "n_convs",
    )
    nodes = cut_lineage(refine(groups, block, members, ["conv_id", "n_convs"]).unionByName(root))
    children = nodes.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    own = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own")
    nodes = cut_lineage(nodes.select("*", own))

    # what a conversation's own nodes give to each node it is a member of
    leaf = F.sum((F.col("n_children") == 0).cast("long")).alias("n_leaves")
    gives = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"), leaf, F.max("depth").alias("depth"))
    gives = cut_lineage(gives.filter("saved <> 0 or n_leaves <> 0"))
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("depth") / (block * STRETCH))))
    given = paths.select("conv_id", "chain", F.floor(F.col("k") / STRETCH).alias("stretch"))
    given = given.join(gives.withColumn("stretch", stretch), ["conv_id", "stretch"])
    given = given.groupBy("chain").agg(F.sum("saved").alias("saved"), F.sum("n_leaves").alias("n_leaves"))
    sums = [F.sum("saved").alias("saved"), F.sum("n_leaves").alias("n_leaves")]
    below = refine(groups.drop("conv_id", "n_convs").join(given, "chain"), block, sums, ["saved", "n_leaves"])
    everything = gives.agg(*sums).select(F.lit(ROOT).alias("key"), "saved", "n_leaves")
    below = below.select("key", "saved", "n_leaves").unionByName(everything)

    # the smallest member of the node above: carried along each node's children, however many
    up = nodes.select(F.col("key").alias("of"), F.lit(ROOT).alias("key"), "conv_id")
    down = nodes.filter("parent_key is not null").select(F.col("parent_key").alias("of"), "key", long_null.alias("conv_id"))
    down = down.withColumn("key", F.concat(F.lit("+"), "key"))
    parents = running(up.unionByName(down), ["of"], ["key"], {"parent_conv_id": ("max", "conv_id")}).filter("key <> ''")
    parents = parents.select(F.expr("substring(key, 2)").alias("key"), "parent_conv_id")

    last = F.floor((F.col("n_turns") - 1) / block)
    ends = paths.filter(F.col("k") == last).select("chain", "conv_id")
    ends = ends.unionByName(convs.filter("n_turns = 0").select(F.lit(ROOT).alias("chain"), "conv_id"))
    shas = id_digests(ends).withColumnRenamed("chain", "end_chain")

    above = running(nodes, ["conv_id"], ["depth"], {"above": ("sum", "own")}, exclusive=True)
    out = above.join(below, "key", "left").join(parents, "key", "left").join(shas, "end_chain", "left")
    saved = F.coalesce("saved", F.lit(0)) - F.col("above")
    return out.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"),
        F.coalesce("sha", F.lit(_NOBODY)).alias("ends_sha256"),
    )
