"""Roles of transcript lines by a hidden Markov model, and canonical turns.

A state is a role and whether a line opens a turn. What is seen of a line are its speaker
marker and a few features. Start, transition and emission chances are counted on labelled
transcripts. Viterbi decoding works on chunks: a chunk is a max-plus matrix from the state
before it to its last one, matrices of consecutive chunks multiply, and once the best states
between chunks are known each chunk is decoded alone. So one conversation of any length is
spread over many tasks and still gets its one best path.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.session import cut_lineage

ROLES = ("system", "user", "assistant")
#: 2 * role opens a turn, 2 * role + 1 continues it.
STATES = 2 * len(ROLES)
FEATURES = ("marker", "words", "ends", "case")
VALUES = 12

#: A line's place is turn << LINE_BITS | line; a chunk is this many turns.
LINE_BITS = 24
CHUNK_TURNS = 256

_SPEAKER = r"^[\s>#*\[<|]*(system|instructions?|user|human|question|q|customer|assistant|ai|bot|answer|a|agent|speaker ?1|speaker ?2)[\]>|*]*\s*[:\]>]"
#: The marker classes that speaker names stand for.
_NAMES = {
    1: ("system", "instruction", "instructions"),
    2: ("user", "human", "customer"),
    3: ("question", "q"),
    4: ("assistant", "ai", "bot", "agent"),
    5: ("answer", "a"),
    6: ("speaker 1", "speaker1"),
    7: ("speaker 2", "speaker2"),
}


def line_features(line: Column) -> dict[str, Column]:
    """What the model sees of a line, each a number below VALUES."""
    name = F.regexp_extract(F.lower(line), _SPEAKER, 1)
    marker = F.lit(0)
    for code, names in _NAMES.items():
        marker = F.when(name.isin(*names), code).otherwise(marker)
    words = F.size(F.regexp_extract_all(line, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    last = F.substring(F.rtrim(line), -1, 1)
    ends = F.when(last == "?", 0).when(last.isin(".", "!"), 1).when(last == ":", 2).when(last == "", 3).otherwise(4)
    first = F.substring(F.regexp_replace(line, r"^[^\p{L}]+", ""), 1, 1)
    case = F.when(first == "", 0).when(first == F.upper(first), 1).otherwise(2)
    return {
        "marker": marker,
        "words": F.least(F.floor(F.log2(F.greatest(words, F.lit(1)))), F.lit(VALUES - 1)).cast("int"),
        "ends": ends,
        "case": case,
    }


def strip_marker(line: Column) -> Column:
    """The line without its speaker marker."""
    return F.trim(F.regexp_replace(line, "(?i)" + _SPEAKER, ""))


class Model(NamedTuple):
    """Logarithms of chances."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    def seen(self, features: np.ndarray) -> np.ndarray:
        """Of each line, for each state, the chance of what is seen."""
        return sum(self.emit[:, k, features[:, k]].T for k in range(len(FEATURES)))


def train(lines: DataFrame) -> Model:
    """Count chances, each seen once more than it was, on (conv_id, pos, line, role, opens).

    Only tables of counts come to the driver, STATES squared and STATES by feature values.
    Lines of an unknown or null role are left out. Without lines all chances are even.
    """
    role = F.coalesce(*[F.when(F.col("role") == r, k) for k, r in enumerate(ROLES)])
    state = (2 * role + F.when(F.col("opens"), 0).otherwise(1)).cast("int").alias("state")
    rows = lines.select("conv_id", "pos", state, *[c.cast("int").alias(n) for n, c in line_features(F.col("line")).items()])
    rows = cut_lineage(rows.filter(F.col("state").isNotNull()))
    emit = np.ones((STATES, len(FEATURES), VALUES))
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(n).alias("v")) for k, n in enumerate(FEATURES)])).alias("x")
    for r in rows.select("state", values).groupBy("state", "x.k", "x.v").count().collect():
        emit[r["state"], r["k"], r["v"]] += r["count"]
    # a line follows the one before it in its turn, or the last line of the turn before
    turn = F.shiftright("pos", LINE_BITS)
    last = rows.groupBy("conv_id", turn.alias("turn")).agg(F.max_by("state", "pos").alias("before"))
    inside = F.col("pos").bitwiseAND((1 << LINE_BITS) - 1)
    steps = np.ones((STATES, STATES))
    within = rows.filter(inside > 0).select(F.when(inside == 1, F.col("state") - 1).otherwise(F.col("state")).alias("before"), "state")
    opening = rows.filter(inside == 0).select("conv_id", (turn - 1).alias("turn"), "state").join(last, ["conv_id", "turn"], "left")
    start = np.ones(STATES)
    for r in within.unionByName(opening.select("before", "state")).groupBy("before", "state").count().collect():
        if r["before"] is None:
            start[r["state"]] += r["count"]
        else:
            steps[r["before"], r["state"]] += r["count"]
    return Model(
        np.log(start / start.sum()),
        np.log(steps / steps.sum(axis=1, keepdims=True)),
        np.log(emit / emit.sum(axis=2, keepdims=True)),
    )


def chunk_matrix(model: Model, features: np.ndarray, first: bool) -> np.ndarray:
    """Best value from each state before the chunk to each last state; row 0 alone at a start."""
    seen = model.seen(features)
    m = np.where(np.arange(STATES)[:, None] == 0, model.start, -np.inf) if first else model.step.copy()
    m = m + seen[0]
    for s in seen[1:]:
        m = (m[:, :, None] + model.step[None]).max(axis=1) + s
    return m


def join_matrices(m: np.ndarray) -> np.ndarray:
    out = m[0]
    for x in m[1:]:
        out = (out[:, :, None] + x[None]).max(axis=1)
    return out


def between(m: np.ndarray, first: int, last: int) -> list[int]:
    """States between consecutive matrices on the best way from ``first`` to ``last``."""
    value, back = np.full(STATES, -np.inf), []
    value[first] = 0
    for x in m:
        ways = value[:, None] + x
        back.append(ways.argmax(axis=0))
        value = ways.max(axis=0)
    out = [last]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def decode(model: Model, features: np.ndarray, before: int | None, last: int | None) -> np.ndarray:
    """Best states of a chunk's lines, given those before it and at its end if they are known."""
    seen = model.seen(features)
    value = (model.start if before is None else model.step[before]) + seen[0]
    back = []
    for s in seen[1:]:
        ways = value[:, None] + model.step
        back.append(ways.argmax(axis=0))
        value = ways.max(axis=0) + s
    out = [int(value.argmax()) if last is None else last]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


def _groups(rows: pa.Table, keys: Sequence[str]):
    """Row ranges of equal keys in a sorted table."""
    if not rows.num_rows:
        return
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = np.asarray(rows.column(k).to_pylist(), dtype=object)
        new[1:] |= v[1:] != v[:-1]
    at = np.append(np.flatnonzero(new), rows.num_rows).tolist()
    yield from zip(at[:-1], at[1:])


def _floats(m: np.ndarray) -> bytes:
    return m.astype("<f8").tobytes()


def _matrix(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<f8").reshape(STATES, STATES)


_LEVEL = "conv_key long, chunk long, m binary"
_ENDS = "conv_key long, chunk long, before int, last int"


def recover_roles(lines: DataFrame, model: Model, bucket_turns: int = 2000) -> DataFrame:
    """(conv_id, pos, line, role, opens) for (conv_id, pos, line): the best path's states.

    ``pos`` orders lines and holds the turn of the transcript's source in its high bits, which
    only deals lines into chunks. Lines of equal place are ordered by their text. A null line
    is as empty, a null conv_id is one conversation, a null pos comes first. Other columns are
    not looked at. An empty table stays empty.
    """
    conv, pos = F.col("conv_id"), F.coalesce("pos", F.lit(0)).cast("long")
    line = F.coalesce("line", F.lit(""))
    rows = lines.select(
        "conv_id",
        F.xxhash64(conv).alias("conv_key"),
        pos.alias("pos"),
        line.alias("line"),
        *[c.cast("int").alias(n) for n, c in line_features(line).items()],
    ).withColumn("chunk", F.floor(F.shiftright("pos", LINE_BITS) / CHUNK_TURNS).cast("long"))
    rows = cut_lineage(rows)  # patterns are matched once
    top = rows.agg(F.max("chunk"), F.count(F.lit(1))).first()
    # chunks of many conversations share a group of bounded size
    groups = max(1, -(-(top[1] or 0) // (4 * bucket_turns)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("conv_key", "chunk"), F.lit(groups)))
    order = [("conv_key", "ascending"), ("chunk", "ascending"), ("pos", "ascending"), ("line", "ascending")]
    out = "conv_id {}, conv_key long, chunk long, pos long, line string, state int".format(
        rows.schema["conv_id"].dataType.simpleString()
    )

    def matrices(part: pa.Table) -> pa.Table:
        part = part.sort_by(order)
        f = np.stack([part.column(n).to_numpy() for n in FEATURES], axis=1)
        found = []
        for a, b in _groups(part, ["conv_key", "chunk"]):
            key, chunk, first = (part.column(c)[a].as_py() for c in ("conv_key", "chunk", "first"))
            found.append((key, chunk, _floats(chunk_matrix(model, f[a:b], chunk == first))))
        return _as_table(_LEVEL, found)

    def paths(part: pa.Table) -> pa.Table:
        part = part.sort_by(order)
        f = np.stack([part.column(n).to_numpy() for n in FEATURES], axis=1)
        state = np.empty(part.num_rows, dtype=np.int32)
        for a, b in _groups(part, ["conv_key", "chunk"]):
            before, last = part.column("before")[a].as_py(), part.column("last")[a].as_py()
            state[a:b] = decode(model, f[a:b], before, last)
        return part.select(["conv_id", "conv_key", "chunk", "pos", "line"]).append_column("state", pa.array(state))

    if (top[0] or 0) == 0:
        known = rows.withColumns({"before": F.lit(None).cast("int"), "last": F.lit(None).cast("int")})
    else:
        firsts = rows.groupBy("conv_key").agg(F.min("chunk").alias("first"))
        level = rows.join(firsts, "conv_key").groupBy("bucket").applyInArrow(matrices, _LEVEL)
        known = rows.join(_chunk_ends(cut_lineage(level), firsts), ["conv_key", "chunk"])
    states = cut_lineage(known.groupBy("bucket").applyInArrow(paths, out))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(F.col("state") / 2) + 1).cast("int"))
    return states.select("conv_id", "pos", "line", role.alias("role"), (F.col("state") % 2 == 0).alias("opens"))


def _as_table(ddl: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [c.split() for c in ddl.split(", ")]
    cols = zip(*rows) if rows else [[] for _ in names]
    return pa.table({n: pa.array(v, kinds[k]) for (n, k), v in zip(names, cols)})


def _chunk_ends(level: DataFrame, firsts: DataFrame, fan: int = 256) -> DataFrame:
    """(conv_key, chunk, before, last) of all chunks, by a tree of matrix products."""
    group = F.floor(F.col("chunk") / fan).cast("long").alias("up")

    def up(part: pa.Table) -> pa.Table:
        part = part.sort_by([("chunk", "ascending")])
        m = np.stack([_matrix(x) for x in part.column("m").to_pylist()])
        return _as_table(_LEVEL, [(part.column("conv_key")[0].as_py(), part.column("up")[0].as_py(), _floats(join_matrices(m)))])

    def down(part: pa.Table) -> pa.Table:
        part = part.sort_by([("chunk", "ascending")])
        m = np.stack([_matrix(x) for x in part.column("m").to_pylist()])
        first = part.column("before")[0].as_py()
        states = between(m, 0 if first is None else first, part.column("last")[0].as_py())
        keys, chunks = part.column("conv_key").to_pylist(), part.column("chunk").to_pylist()
        ends = [(k, c, s if i or first is not None else None, e) for i, (k, c, s, e) in enumerate(zip(keys, chunks, states, states[1:]))]
        return _as_table(_ENDS, ends)

    levels = [level]
    while levels[-1].agg(F.max("chunk")).first()[0]:
        levels.append(cut_lineage(levels[-1].withColumn("up", group).groupBy("conv_key", "up").applyInArrow(up, _LEVEL)))

    def end(part: pa.Table) -> pa.Table:
        # a whole conversation: it starts in row 0 of its matrix and may end in any state
        ends = [(k, c, None, int(_matrix(m)[0].argmax())) for k, c, m in zip(*(part.column(x).to_pylist() for x in ("conv_key", "chunk", "m")))]
        return _as_table(_ENDS, ends)

    known = levels[-1].mapInArrow(lambda it: (b for x in it for b in end(pa.Table.from_batches([x])).to_batches()), _ENDS)
    for below in reversed(levels[:-1]):
        above = known.withColumnRenamed("chunk", "up")
        known = below.withColumn("up", group).join(above, ["conv_key", "up"]).groupBy("conv_key", "up").applyInArrow(down, _ENDS)
    return cut_lineage(known)


def render_turns(lines: DataFrame) -> DataFrame:
    """(conv_id, pos, role, n_lines, turn_text) of (conv_id, pos, line, role, opens), a row per turn.

    A turn runs from a line that opens one to the next, without speaker markers and empty
    lines at its ends, as ``<|role|>``, its text and ``<|end|>`` on lines of their own.
    ``pos`` is that of its first line.
    """
    # the turn of a line is the last opening before it, found with sums per chunk of a conversation
    chunk = F.floor(F.shiftright("pos", LINE_BITS) / CHUNK_TURNS).cast("long")
    rows = lines.withColumn("chunk", chunk)
    inside = Window.partitionBy("conv_id", "chunk").orderBy("pos", "line").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True)
    rows = rows.withColumn("own", opened.over(inside))
    ends = rows.groupBy("conv_id", "chunk").agg(F.max("own").alias("last"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.max("last").over(before)).select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), "carried")
    rows = rows.join(carried, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k")))
    rows = rows.withColumn("turn_pos", F.coalesce("own", "carried", F.lit(0)))
    said = F.array_sort(F.collect_list(F.struct("pos", strip_marker(F.col("line")).alias("line"))))
    turns = rows.groupBy("conv_id", "turn_pos").agg(said.alias("said"), F.first("role").alias("role"), F.count(F.lit(1)).alias("n_lines"))
    text = F.regexp_replace(F.array_join(F.col("said.line"), "\n"), r"^\n+|\n+$", "")
    whole = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), text, F.lit("\n<|end|>"))
    return turns.select("conv_id", F.col("turn_pos").alias("pos"), "role", "n_lines", whole.alias("turn_text"))


def as_transcripts(turns: DataFrame, drop_percent: int = 15) -> DataFrame:
    """(conv_id, pos, line, role, opens): turns written as people write transcripts.

    A conversation has one of five styles: ``User:``, a heading line, ``Q:`` and ``A:``,
    numbered speakers, or no markers; some markers are missing. Choices follow hashes of the
    ids. A null text is an empty line, a null turn counts as 0, an unknown role has no marker.
    """
    role, turn = F.col("role"), F.coalesce("turn", F.lit(0)).cast("long")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    name = F.when(role == "user", "User").when(role == "assistant", "Assistant").when(role == "system", "System")
    short = F.when(role == "user", "Q").when(role == "assistant", "A").when(role == "system", "Instructions")
    number = F.when(role == "user", "Speaker 1").when(role == "assistant", "Speaker 2").when(role == "system", "System")
    said = F.coalesce("text", F.lit(""))
    marked = (
        F.when(style == 0, F.concat(name, F.lit(": "), said))
        .when(style == 1, F.concat(F.lit("### "), name, F.lit(":\n"), said))
        .when(style == 2, F.concat(short, F.lit(": "), said))
        .when(style == 3, F.concat(F.lit("["), number, F.lit("]: "), said))
    )
    missing = F.pmod(F.xxhash64("conv_id", "turn", F.lit("marker")), F.lit(100)) < drop_percent
    text = F.coalesce(F.when(~missing, marked), said)
    at = F.posexplode(F.split(text, "\n")).alias("k", "line")
    rows = turns.select("conv_id", turn.alias("turn"), "role", at)
    pos = F.shiftleft("turn", LINE_BITS) + F.col("k")
    return rows.select("conv_id", pos.alias("pos"), "line", "role", (F.col("k") == 0).alias("opens"))
