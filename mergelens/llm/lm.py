"""Scoring texts with an n-gram model as a weighted backoff automaton.

States are histories: the root, the start of a text and every word of the training
texts. The arcs of a state u are all bigrams seen in training, weighted

    (c(u, v) + m * P(v)) / (c(u) + m);

all other words leave by a failure arc of weight m / (c(u) + m) to the root, whose
arcs are the words with absolute discounting, P(w) = (c(w) - d) / N, and one class
for unknown words, P = d * V / N. So every state's probabilities sum to one, and a
word that was not seen in training is no state: what follows it is scored from the
root. A text is traversed once from left to right: the state is carried from token
to token and the log weights of the arcs taken are summed.

With ``state_share`` above 0 only words with at least that share of all training
tokens are states and only bigrams of such words are arcs, weighted

    (1 - rare(u)) * (c(u, v) + m * P(v) / P(frequent)) / (c(u) + m);

where c(u) counts only the frequent words after u; the failure arc's weight is
rare(u), the share of words that are not frequent after u, over P(not frequent) for
those, and the term with c(u, v) = 0 for frequent ones.

No task holds the model. Texts are dealt to blocks of bounded size; a block asks for
the counts of its distinct words and bigrams, sorted by hash and cut at fixed bounds
into parts of bounded size, each a packed row with the block's own training counts;
the answer to a row is the sums over all blocks, in its order. A word's count is also
its state's, as every word has a follower, if only the end. Words above
``known_share`` are a table with at most 1 / known_share rows and are broadcast.
Words are 64-bit hashes throughout.

A null text is empty: one token, its end. Rows with a null or repeated id are texts
of their own. With nothing to learn from every score is 0. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.llm.common import groups_for, text_bytes
from mergelens.llm.words import hashed_texts, mix
from mergelens.sources.staging import Staging

_U = np.uint64
_START, _END = _U(0x5374617274), _U(0x456E64)


def _tokens(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by its end, and the texts' bounds."""
    parts, counts = [], []
    for column in columns:
        for _, _, hashes, bounds in hashed_texts(column):
            parts.append(np.insert(hashes, bounds[1:], _END))
            counts.append(np.diff(bounds) + 1)
    tokens = np.concatenate(parts) if parts else np.zeros(0, _U)
    return tokens, np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 if it is not there."""
    at = np.searchsorted(table, keys)
    inside = at < len(table)
    found = np.full(len(keys), -1, np.int64)
    found[inside] = np.where(table[at[inside]] == keys[inside], at[inside], -1)
    return found


def _histories(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = _START
    return before


def _pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _U(0x9FB21C651E98DF25) + tokens)


def _pack(values: np.ndarray) -> bytes:
    """64-bit values, byte by byte place, compressed: what is small or repeats takes little."""
    return pa.compress(values.view(np.uint8).reshape(-1, 8).T.copy(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    data = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return data.reshape(8, n).T.copy().view(_U).reshape(n)


def _add_up(asked: pa.Table) -> pa.Table:
    """The sums over all blocks of one part's counts, for each block in the order of its keys."""
    sizes = asked.column("size").to_pylist()
    rows = zip(asked.column("keys").to_pylist(), asked.column("n").to_pylist(), sizes, strict=True)
    unpacked = [(np.cumsum(_unpack(keys, size), dtype=_U), _unpack(n, size)) for keys, n, size in rows]
    keys, of = np.unique(np.concatenate([u[0] for u in unpacked]), return_inverse=True)
    total = np.bincount(of, np.concatenate([u[1] for u in unpacked]), len(keys)).astype(np.int64)[of]
    totals = [_pack(x) for x in np.split(total, np.cumsum(sizes)[:-1])]
    columns = [asked.column("block"), asked.column("part"), asked.column("size"), pa.array(totals, pa.binary())]
    return pa.table(columns, names=["_block", "part", "size", "total"])


class _Block:
    """The distinct words and bigrams of some texts, with their counts in the training texts among them."""

    def __init__(self, columns: list[pa.Array], train: np.ndarray, model: dict):
        self.tokens, self.bounds = _tokens(columns)
        learned = np.repeat(train, np.diff(self.bounds))
        self.words, self.word_of = np.unique(self.tokens, return_inverse=True)
        self.word_counts = np.bincount(self.word_of, learned, len(self.words)).astype(np.int64)
        self.known = _find(model["known"], self.words)
        before = _histories(self.tokens, self.bounds)
        if model["states"] is None:
            self.arc = slice(None)
        else:
            self._place(model)
        self.pairs, self.pair_of = np.unique(_pairs(before[self.arc], self.tokens[self.arc]), return_inverse=True)
        self.pair_counts = np.bincount(self.pair_of, learned[self.arc], len(self.pairs)).astype(np.int64)

    def _place(self, model: dict) -> None:
        """States before and after each token, and the tokens between two states, where only some words are states."""
        state = _find(model["states"], self.words)
        own = state[self.word_of]
        last = np.empty_like(own)
        last[1:] = own[:-1]
        last[self.bounds[:-1]] = model["start"]
        self.own, self.state = own, last
        self.arc = np.flatnonzero((own >= 0) & (last >= 0))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the block asks for: rare words and bigrams by hash, their own counts, their places in that."""
        rare = self.known < 0
        keys = np.r_[self.words[rare], self.pairs]
        order = np.argsort(keys, kind="stable")
        return keys[order], np.r_[self.word_counts[rare], self.pair_counts][order], order

    def before(self, counts: np.ndarray, at_start: int) -> np.ndarray:
        """The count of each token's history, from those of the tokens."""
        out = np.empty_like(counts)
        out[1:] = counts[:-1]
        out[self.bounds[:-1]] = at_start
        return out


def _base_model(known: np.ndarray, counts: np.ndarray, stats: dict, state_share: float) -> dict:
    order = np.argsort(known)
    known, counts = known[order], counts[order]
    if not state_share:
        return {"known": known, "counts": counts, "states": None, **stats}
    frequent = counts >= max(1.0, stats["n"] * state_share)
    states = np.sort(np.r_[known[frequent], _START])
    return {"known": known, "counts": counts, "states": states, "start": int(np.searchsorted(states, _START)), **stats}


def _root(counts: np.ndarray, model: dict) -> np.ndarray:
    """P(w) at the root by training count."""
    if not model["n"]:
        return np.ones(len(counts))
    unknown = model["d"] * model["v"] / model["n"]
    return np.where(counts > 0, (counts - model["d"]) / model["n"], unknown)


def _followers(learned: DataFrame, shared: Broadcast) -> dict:
    """How often frequent words, and others, follow each of the few states."""
    model = shared.value

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        seen = np.zeros((2, len(held["states"])), np.int64)
        for batch in batches:
            tokens, bounds = _tokens([batch.column(0)])
            own = _find(held["states"], tokens)
            last = np.r_[held["start"], own[:-1]]
            last[bounds[:-1]] = held["start"]
            for at, which in enumerate((last >= 0, (last >= 0) & (own >= 0))):
                seen[at] += np.bincount(last[which], minlength=seen.shape[1])
        at = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_pydict({"state": at, "n": seen[0][at], "inner": seen[1][at]})

    followed = learned.mapInArrow(follow, "state long, n long, inner long").groupBy("state").agg(
        F.sum("n").alias("n"), F.sum("inner").alias("inner")
    ).toArrow()
    total, inner = np.zeros((2, len(model["states"])))
    total[followed.column("state").to_numpy()] = followed.column("n").to_numpy()
    inner[followed.column("state").to_numpy()] = followed.column("inner").to_numpy()
    frequent = _find(model["states"], model["known"]) >= 0
    in_states = float(_root(model["counts"][frequent], model).sum())
    smoothed = (total - inner + 0.5) / (total + 1)  # never 0 or 1, so every word can follow
    return {"inner": inner, "rare": smoothed, "in_states": in_states}


def score(
    docs: DataFrame, train: Column, stage: Staging, keep: list[Column], text: str = "text",
    known_share: float = 1e-6, state_share: float = 0.0, m: float = 100.0, block_bytes: int = 24_000_000,
) -> DataFrame:
    """The ``keep`` columns of every row with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    The model learns from the rows for which ``train`` holds.
    """
    spark = docs.sparkSession
    train = F.coalesce(train, F.lit(False))
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"), train.alias("_train"))
    learned = rows.filter("_train").select("_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.unique(_tokens([batch.column(0)])[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": n})

    counted = learned.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stage.table("words", counted)
    stats = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"),
        F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice"),
        F.coalesce(F.sum(F.when(F.col("word") == int(_END), F.col("n"))), F.lit(0)).alias("texts"),
    ).first().asDict()
    stats["d"] = min(0.9, max(0.1, stats["once"] / max(1, stats["once"] + 2 * stats["twice"])))
    often = counted.filter(F.col("n") >= max(1.0, stats["n"] * known_share)).toArrow()
    model = _base_model(
        often.column("word").to_numpy().view(_U), often.column("n").to_numpy(), stats, state_share
    )
    shared = spark.sparkContext.broadcast(model)

    full = shared if model["states"] is None else spark.sparkContext.broadcast(model | _followers(learned, shared))

    blocks = groups_for(text_bytes(rows, "_text"), block_bytes)
    block = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "_train"]), F.lit(blocks)).alias("_block")
    dealt = rows.select("*", block).repartition(blocks, "_block")

    def ask(table: pa.Table) -> pa.Table:
        held = shared.value
        train = table.column("_train").to_numpy()
        keys, n, _ = _Block(table.column("_text").chunks, train, held).keys()
        part = (keys >> _U(32)) * _U(blocks) >> _U(32)
        at = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(keys)] if len(keys) else [0]
        cuts = [slice(*c) for c in zip(at, at[1:], strict=False)]
        steps = [np.diff(keys[c], prepend=_U(0)) for c in cuts]
        block = table.column("_block")[0].as_py()
        columns = {
            "block": pa.array([block] * len(cuts), pa.int64()), "part": pa.array([int(part[c.start]) for c in cuts], pa.int64()),
            "size": pa.array(map(len, steps), pa.int64()), "keys": pa.array(map(_pack, steps), pa.binary()),
            "n": pa.array([_pack(n[c]) for c in cuts], pa.binary()),
        }
        return pa.table(columns)

    asked = dealt.groupBy("_block").applyInArrow(ask, "block long, part long, size long, keys binary, n binary")
    answers = asked.groupBy("part").applyInArrow(_add_up, "_block long, part long, size long, total binary")
    schema = rows.drop("_text", "_train").schema.add("n_tokens", "long").add("n_known", "long")
    schema = schema.add("train_tokens", "long").add("base_score", "double").add("score", "double")
    kept = [f.name for f in schema.fields[:-5]]

    def traverse(texts: pa.Table, answer: pa.Table) -> pa.Table:
        held = full.value
        own = _Block(texts.column("_text").chunks, texts.column("_train").to_numpy(), held)
        order = own.keys()[2]
        answer = answer.sort_by("part")
        rows = zip(answer.column("total").to_pylist(), answer.column("size").to_pylist(), strict=True)
        totals = np.empty(len(order), np.int64)
        totals[order] = np.concatenate([np.zeros(0, np.int64), *(_unpack(t, size).view(np.int64) for t, size in rows)])
        rare = own.known < 0
        word = np.zeros(len(own.words), np.int64)
        word[~rare] = held["counts"][own.known[~rare]]
        word[rare], pair = np.split(totals, [rare.sum()])

        root = _root(word, held)[own.word_of]
        if held["states"] is None:
            weight = (pair[own.pair_of] + m * root) / (own.before(word[own.word_of], held["texts"]) + m)
        else:
            weight = root.copy()
            from_state = own.state >= 0
            rare = from_state & (own.own < 0)
            weight[rare] *= held["rare"][own.state[rare]] / max(1e-300, 1 - held["in_states"])
            at, inner = own.arc, held["inner"]
            state = own.state[at]
            share = root[at] / max(1e-300, held["in_states"])
            weight[at] = (1 - held["rare"][state]) * (pair[own.pair_of] + m * share) / (inner[state] + m)
        if not held["n"]:
            weight[:] = 1
        base = np.log10((word + 1) / (held["n"] + held["v"] + 1))[own.word_of]
        starts = own.bounds[:-1]
        columns = [texts.column(c) for c in kept]
        columns += [pa.array(np.diff(own.bounds)), pa.array(np.add.reduceat((word > 0)[own.word_of].astype(np.int64), starts))]
        columns += [pa.array(np.full(len(starts), held["n"])), pa.array(np.add.reduceat(base, starts))]
        columns.append(pa.array(np.add.reduceat(np.log10(weight), starts)))
        return pa.table(columns, names=schema.names)

    return dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(traverse, schema)
