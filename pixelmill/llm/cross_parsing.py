"""Language identification by cross-parsing entropy.

A suffix automaton per language holds every substring of a bounded sample of its labelled
text. A text is parsed against each: a phrase is the longest match from where the last one
ended, and the language that needs the fewest phrases, weighed by the bits that a phrase of
its sample costs, wins. Parsing is a walk from state to state, so automaton, restarts and
phrase counts go into one table, and thousands of texts step through it side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.arrays import ranges, texts
from pixelmill.operators.ordered import first_n

#: A longer text is parsed in stretches of this many bytes; phrases end where a stretch does.
STRETCH = 2048
#: Stretches that are parsed side by side.
LANES = 4096
#: How much of a difference in bits counts for the score.
TEMPER = 0.25

_NOT_LETTERS = r"[^\p{L}\p{M}]+"


class Model(NamedTuple):
    """Suffix automata of all languages; languages ascend."""

    langs: tuple[str, ...]
    #: bytes of each language's sample
    symbols: tuple[int, ...]
    #: states of each language; state 0 is its root
    states: tuple[int, ...]
    #: (state, byte, next state) of each language
    edges: tuple[np.ndarray, ...]


def suffix_automaton(data: bytes) -> tuple[int, np.ndarray]:
    """(number of states, its edges as rows of (state, byte, next state)); the root is 0."""
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in data:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    edges = np.array([(s, c, t) for s, some in enumerate(follow) for c, t in some.items()], dtype=np.int32)
    return len(follow), edges.reshape(-1, 3)


def letters(column: pa.Array) -> pa.Array:
    """Lower-case letters, with one space for everything else between them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.replace_substring_regex(pc.utf8_lower(column), pattern=_NOT_LETTERS, replacement=" ")


def sample_text(pieces: list[str], size: int) -> bytes:
    """Distinct pieces of letters up to ``size`` bytes, none of them next to another."""
    clean = dict.fromkeys(p.strip() for p in letters(pa.array(pieces, pa.large_string())).to_pylist())
    out = bytearray()
    for p in clean:
        if p and len(out) < size:
            out += p.encode()[: size - len(out)] + b"\0"
    return bytes(out)


def train(docs: DataFrame, rows: int = 256, size: int = 131_072, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Automata of the languages that ``docs`` is labelled with.

    A language is learned from a random sample of at most ``rows`` of its rows: 8 pieces of 128
    characters from each, spread over the whole text, and equal pieces once. All languages
    together get ``size`` bytes in equal shares. Rows without a label or a letter teach nothing;
    a table without any such row gives a model without languages.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # every row of a language has the same chance, and twice as many as needed are looked at
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model((), (), (), ())
    chance = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, 2.0 * rows / n)])
    draw = F.xxhash64(F.col("doc_id").cast("string"), "text")
    drawn = known.withColumn("draw", draw).filter(F.pmod("draw", F.lit(1 << 40)) < chance[F.col("lang")] * float(1 << 40))
    step = F.floor(F.char_length("text") / 8).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring("text", i * step + 1, F.lit(128)))
    some = first_n(drawn.select("lang", "draw", pieces.alias("pieces")), rows, ["lang"], ["draw", "pieces"])
    share = size // len(counts)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("draw")
        data = sample_text([p for row in table["pieces"].to_pylist() for p in row], share)
        states, edges = suffix_automaton(data)
        cols = [table["lang"][:1], pa.array([len(data)]), pa.array([states]), pa.array([edges.tobytes()])]
        return pa.table(cols, names=["lang", "symbols", "states", "edges"])

    kind = "lang string, symbols long, states long, edges binary"
    found = sorted(some.groupBy("lang").applyInArrow(build, kind).filter("symbols > 0").collect(), key=lambda r: r["lang"])
    edges = tuple(np.frombuffer(bytes(r["edges"]), dtype=np.int32).reshape(-1, 3) for r in found)
    return Model(tuple(r["lang"] for r in found), tuple(r["symbols"] for r in found), tuple(r["states"] for r in found), edges)


class Parser:
    """All automata as one table of steps: next row and the phrases that end there."""

    def __init__(self, model: Model):
        self.langs = model.langs
        self.bits = np.log2(np.array(model.symbols, dtype=np.float64) + 1)
        seen = np.unique(np.concatenate([e[:, 1] for e in model.edges])) if model.edges else np.empty(0, np.int32)
        width = len(seen) + 1
        self.symbol = np.full(256, len(seen), dtype=np.uint8)
        self.symbol[seen] = np.arange(len(seen))
        first = np.concatenate([[0], np.cumsum(model.states)]).astype(np.int64)
        self.roots = first[:-1] * width
        step = np.empty((int(first[-1]), width), dtype=np.int64)
        for a, b, edges in zip(first[:-1], first[1:], model.edges):
            to = np.full((b - a, width), -1, dtype=np.int64)
            to[edges[:, 0], self.symbol[edges[:, 1]]] = (edges[:, 2] + a) * width
            # no match: the phrase ends, and a byte that the sample never has is one by itself
            start = to[0]
            again = np.where(start < 0, a * width, start) * 4 + 1
            unseen = (start < 0).astype(np.int64)
            step[a:b] = np.where(to < 0, again + unseen, to * 4)
            step[a] = np.where(start < 0, a * width * 4 + 1, start * 4)
        self.step = step.ravel().astype(np.int32 if step.size < 1 << 29 else np.int64)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language."""
        n = np.diff(offsets)
        parts = -(-n // STRETCH)
        text = np.repeat(np.arange(len(n)), parts)
        nth = ranges(np.zeros(len(n), dtype=np.int64), parts)
        start = offsets[:-1][text] + nth * STRETCH
        size = np.minimum(n[text] - nth * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        out = np.zeros((len(n), len(self.langs)), dtype=np.int64)
        coded = self.symbol[data]
        for i in range(0, len(order), LANES):
            some = order[i : i + LANES]
            np.add.at(out, text[some], self._walk(coded, start[some], size[some]))
        return out

    def _walk(self, coded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sizes descend, so the stretches that go on are always the first ones."""
        lanes = len(start)
        grid = np.zeros((int(size[0]), lanes), dtype=np.int32)
        lane = np.repeat(np.arange(lanes), size)
        grid[ranges(np.zeros(lanes, dtype=np.int64), size), lane] = coded[ranges(start, size)]
        live = np.searchsorted(-size, -np.arange(len(grid)), side="left")
        at = np.tile(self.roots.astype(self.step.dtype), (lanes, 1))
        count = np.zeros((lanes, len(self.langs)), dtype=np.int32)
        for row, a in zip(grid, live.tolist()):
            v = self.step.take(at[:a] + row[:a, None])
            count[:a] += v & 3
            np.right_shift(v, 2, out=at[:a])
        return count + (at != self.roots)


_parsers: dict[str, Parser] = {}


def _parser(key: str, model) -> Parser:
    """The last model's parser, built once per worker."""
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(model.value)
    return _parsers[key]


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_bytes, phrases) of every row.

    Whole texts are parsed, as letters in lower case with one space between words; n_bytes is
    their size as such and phrases has one count per language of the model. The score is the
    language's share of two to the power of minus the bits needed, tempered; of languages with
    equally many bits the first in order is taken.

    A null or empty text, one without a letter, and every text under a model without languages is
    ``und`` with score 0. Repeated rows and null ids are judged each; texts may be of any length;
    other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    names = ["doc_id", "lang_pred", "score", "n_bytes", "phrases"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for batch in batches:
            parser = parser or _parser(key, shared)
            plain = pa.RecordBatch.from_arrays([letters(batch.column(1))], ["text"])
            found = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in texts(plain):
                phrases = parser.phrases(data, offsets)
                bits = phrases * parser.bits
                pred = np.full(hi - lo, "und", dtype=object)
                score = np.zeros(hi - lo)
                if len(parser.langs):
                    best = bits.argmin(axis=1)
                    ok = found[lo:hi]
                    pred[ok] = np.array(parser.langs, dtype=object)[best[ok]]
                    gap = (bits - bits.min(axis=1, keepdims=True))[ok]
                    score[ok] = 1 / np.exp2(-TEMPER * gap).sum(axis=1)
                bounds = np.arange(hi - lo + 1) * len(parser.langs)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(phrases.ravel()))
                size = pa.array(np.diff(offsets))
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(score), size, lists]
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_bytes long, phrases array<long>")
