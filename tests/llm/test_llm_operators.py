"""Each operator against brute force, and on the awkward cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from llm_cases import LONG, no_docs, odd_docs, stage  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mergelens.llm import chat, idfile, langid, lm, minhash, mixing, packing, rangecoder, subspace, tokens, warc
from mergelens.llm import fingerprints as fp
from mergelens.llm.queries import QUERIES
from mergelens.llm.words import mix as mix_bits

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


@pytest.fixture(scope="module")
def documents():
    return duckdb.connect().execute(f"SELECT doc_id, text, lang, source FROM '{SMALL}/documents.parquet'").fetchall()


def rows_of(frame):
    return [row.asDict() for row in frame.collect()]


# --- language model ------------------------------------------------------------------


def by_hand(texts, learned, m=100.0, state_share=2e-5):
    """Base and model scores of texts, one token after another."""
    tokens = [[*words_of(t), "</s>"] for t in texts]
    c = Counter(w for t, on in zip(tokens, learned, strict=True) if on for w in t)
    n, v = sum(c.values()), len(c)
    once, twice = (sum(1 for x in c.values() if x == k) for k in (1, 2))
    d = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    states = {w for w, x in c.items() if x >= max(1.0, n * state_share)}
    inside = sum((c[w] - d) / n for w in states)
    after, inner, pairs = Counter(), Counter(), Counter()
    for t, on in zip(tokens, learned, strict=True):
        for u, w in zip(["<s>", *t[:-1]], t, strict=True):
            if on and (u in states or u == "<s>"):
                after[u] += 1
                if w in states:
                    inner[u] += 1
                    pairs[u, w] += 1
    out = []
    for t in tokens:
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)
        total = 0.0
        for u, w in zip(["<s>", *t[:-1]], t, strict=True):
            p = (c[w] - d) / n if c[w] else d * v / n
            if u in states or u == "<s>":
                rare = (after[u] - inner[u] + 0.5) / (after[u] + 1)
                if w in states:
                    p = (1 - rare) * (pairs[u, w] + m * p / inside) / (inner[u] + m)
                else:
                    p = rare * p / (1 - inside)
            total += np.log10(p)
        out.append((len(t), sum(1 for w in t if c[w]), n, base, total))
    return out


@pytest.mark.parametrize("share", [2e-5, 2e-3])
def test_scores_match_one_left_to_right_pass(spark, stage, documents, share):  # noqa: F811
    docs = spark.createDataFrame([(d[0], d[1]) for d in documents], "doc_id long, text string").repartition(5)
    learned = [d[0] % 3 != 0 for d in documents]
    got = lm.score(docs, F.col("doc_id") % 3 != 0, stage, ["doc_id"], state_share=share, known_share=share / 2, block_bytes=20_000)
    want = by_hand([d[1] for d in documents], learned, state_share=share)
    found = {r["doc_id"]: r for r in rows_of(got)}
    assert len(found) == len(documents)
    for (doc_id, *_), w in zip(documents, want, strict=True):
        r = found[doc_id]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3]) and r["score"] == pytest.approx(w[4])


def test_held_out_texts_score_better_than_the_base(spark):
    rows = [r for r in rows_of(QUERIES["op1_backoff_automaton"](spark, SMALL)) if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_score_odd_documents(spark, stage, odd_docs, no_docs):  # noqa: F811
    got = rows_of(lm.score(odd_docs, F.col("doc_id") != 2, stage, ["doc_id"]))
    assert len(got) == odd_docs.count()
    empty = [r for r in got if r["doc_id"] in (4, 5, 6)]
    assert {(r["n_tokens"], r["n_known"]) for r in empty} == {(1, 1)} and len({r["base_score"] for r in empty}) == 1
    assert lm.score(no_docs, F.lit(True), stage.__class__(spark), ["doc_id"]).count() == 0
    nothing = rows_of(lm.score(odd_docs, F.lit(False), stage.__class__(spark), ["doc_id"]))
    assert {(r["base_score"], r["score"], r["n_known"]) for r in nothing} == {(0.0, 0.0, 0)}


def test_every_seen_bigram_is_an_arc(spark, stage, documents):  # noqa: F811
    docs = spark.createDataFrame([(d[0], d[1]) for d in documents], "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r for r in rows_of(lm.score(docs, F.col("doc_id") % 3 != 0, stage, ["doc_id"], block_bytes=20_000))}
    tokens = {d[0]: ["<s>", *words_of(d[1]), "</s>"] for d in documents}
    learned = [t for doc_id, t in tokens.items() if doc_id % 3 != 0]
    c, pairs = Counter(w for t in learned for w in t), Counter(p for t in learned for p in zip(t, t[1:], strict=False))
    n, v = sum(x for w, x in c.items() if w != "<s>"), len(c) - 1
    once, twice = (sum(1 for w, x in c.items() if x == k and w != "<s>") for k in (1, 2))
    d, m = min(0.9, max(0.1, once / max(1, once + 2 * twice))), 100.0
    for doc_id, t in tokens.items():
        root = [(c[w] - d) / n if c[w] else d * v / n for w in t]
        want = sum(np.log10((pairs[t[i - 1], t[i]] + m * root[i]) / (c[t[i - 1]] + m)) for i in range(1, len(t)))
        assert found[doc_id]["score"] == pytest.approx(want)


def test_rare_words_have_arcs_at_any_size(spark, stage):  # noqa: F811
    common = spark.range(200).select("id", F.lit(" ".join(f"w{i}" for i in range(1000))).alias("text"))
    seen = [(1000, "alpha beta"), (1001, "alpha beta"), (2000, "alpha beta"), (2001, "beta alpha")]
    docs = common.unionByName(spark.createDataFrame(seen, "id long, text string"))
    got = {r["id"]: r["score"] for r in rows_of(lm.score(docs, F.col("id") < 2000, stage, ["id"]))}
    assert got[2000] > got[2001] + 2


# --- chats ----------------------------------------------------------------------------


def test_chats_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "", None, "\\e\\\\b[<]>", "a\nb", "é語", LONG]
    turns = [(1, i, role, s) for i, (role, s) in enumerate(zip(["user", "assistant"] * 4, said, strict=False))]
    turns += [(2, 0, "assistant", "x"), (3, None, None, None), (4, 0, "tool [<\\]", "y"), (4, 0, "tool [<\\]", "y")]
    turns += [(5, 0, "system", "s"), (5, 1, "user", "u"), (None, 0, "user", "u")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({"turns": F.lit(1), "state": F.lit(1), "segments": F.lit(1), "t": F.lit(1)}).repartition(4)
    out = chat.format_chats(frame).withColumn("formatted", chat.formatted_text()).withColumn("learned", chat.loss_text())
    got = {r["conv_id"]: r for r in out.withColumn("read", chat.parse_turns(F.col("formatted"))).collect()}
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True, None: True}
    for conv in got:
        want = [(t[2] or "", t[3] or "") for t in turns if t[0] == conv]
        assert [tuple(t) for t in got[conv]["read"]] == want
        assert got[conv]["learned"] == "".join(text for role, text in want if role == "assistant")
    assert chat.format_chats(frame.limit(0)).count() == 0


# --- token ids ------------------------------------------------------------------------


def ids_of(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_range_coder_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 65_536, n) for n in (0, 1, 2, 700, 4096)]
    blocks += [np.zeros(900, int), np.full(500, 65_535), rng.zipf(1.2, 3000) % 50_000, np.tile(np.arange(40), 60)]
    coded = rangecoder.encode(blocks)
    read, used = rangecoder.split(b"".join(coded), len(coded))
    assert used == sum(map(len, coded))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(rangecoder.decode(read), blocks, strict=True))
    assert [rangecoder.encode([b])[0] for b in blocks] == coded  # no block depends on another
    assert len(coded[-1]) < 400 and len(coded[5]) < 100
    damaged = bytearray(coded[4])
    damaged[500] ^= 1
    with pytest.raises(ValueError):
        rangecoder.split(bytes(damaged), 1)
    with pytest.raises(ValueError):
        rangecoder.encode([np.array([1 << 16])])


def test_segment_has_one_model():
    """Blocks share what the whole segment says: short blocks cost little more than long ones, a lane has no tables."""
    rng = np.random.default_rng(5)
    follows = rng.permutation(400)
    ids = np.zeros(40_000, np.int64)
    for at in range(1, len(ids)):
        ids[at] = follows[ids[at - 1]] if rng.random() < 0.9 else rng.integers(0, 400)
    doc_ids, counts = np.array([3, -(2**63)]), np.array([30_000, 10_000])
    sizes = {}
    for block_ids in (250, 4096):
        data = idfile.pack_segment(2, 1, doc_ids, counts, ids, block_ids)
        part, number, found, lengths, read = idfile.unpack_segment(memoryview(data))
        assert (part, number) == (2, 1) and (found == doc_ids).all() and (lengths == counts).all() and (read == ids).all()
        sizes[block_ids] = len(data)
    assert sizes[4096] < 12_000 and sizes[250] < sizes[4096] + 160 * 40
    damaged = bytearray(data)
    damaged[100] ^= 1  # in the model
    with pytest.raises(ValueError):
        idfile.unpack_segment(memoryview(bytes(damaged)))
    orders = rangecoder.Orders.learn(ids)
    state = [*vars(rangecoder._Mixer(1000, orders)).values()]
    state = [x for v in state for x in (v if isinstance(v, list) else [v]) if isinstance(x, np.ndarray)]
    assert sum(x.nbytes for x in state) <= 64 * 1000


def test_model_meets_other_ids():
    """Ids the model has not seen, more ids than it keeps, and a model of nothing."""
    rng = np.random.default_rng(6)
    blocks = [rng.integers(0, 65_536, 3000), rng.integers(0, 50, 1000), np.zeros(0, int), np.array([65_535])]
    for seen in (np.zeros(0, int), np.array([7]), np.arange(65_536), rng.integers(0, 50, 5000)):
        kept = rangecoder.Orders.learn(seen).to_bytes()
        orders, used = rangecoder.Orders.from_bytes(kept + b"more")
        coded = rangecoder.encode(blocks, orders)
        read, _ = rangecoder.split(b"".join(coded), len(coded))
        assert used == len(kept)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(rangecoder.decode(read, orders), blocks, strict=True))
        assert [rangecoder.encode([b], orders)[0] for b in blocks] == coded


def check_id_files(spark, stage, docs, texts):  # noqa: F811
    """``texts``: (id, text) in the order of the files."""
    path = f"{stage.path}/ids"
    idfile.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), block_ids=512, segment_ids=3000)
    got = rows_of(idfile.with_starts(idfile.read_documents(spark, path)).orderBy("start"))
    ids = [x + [2] for x in ids_of("word_bpe_49k.json", [t for _, t in texts])]
    assert [r["doc_id"] for r in got] == [i for i, _ in texts]
    starts = np.r_[0, np.cumsum([len(x) for x in ids])]
    assert [r["start"] for r in got] == starts[:-1].tolist()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (i, len(x), crc(x)) for (i, _), x in zip(texts, ids, strict=True)
    )


def test_id_files(spark, stage, documents):  # noqa: F811
    docs = spark.createDataFrame([d[:2] for d in documents[::-1]], "doc_id long, text string").repartition(3)
    check_id_files(spark, stage, docs, sorted((d[:2] for d in documents), key=lambda d: d[0]))


def test_id_files_of_odd_documents(spark, stage, odd_docs, no_docs):  # noqa: F811
    rows = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    check_id_files(spark, stage, odd_docs, rows)
    path = f"{stage.path}/none"
    idfile.write_ids(no_docs, path, public_tokenizers.path("word_bpe_49k.json"))
    assert idfile.with_starts(idfile.read_documents(spark, path)).count() == 0


# --- packing --------------------------------------------------------------------------


def test_runs_are_encoded_in_parts(monkeypatch):
    """A run's ids are those of its texts, worked out over bounded parts of it and batches of new pieces."""
    tokenizer = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"word{i} and word{i * 7}, " * 4 for i in range(300)] + [None, ""]
    plain = [tokenizer._tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]
    monkeypatch.setattr(tokens, "_PART_BYTES", 2_000)
    monkeypatch.setattr(tokens, "_BATCH", 50)
    sizes, whole = [], tokenizer.encode
    monkeypatch.setattr(tokenizer, "encode", lambda data, offsets: sizes.append(len(data)) or whole(data, offsets))
    ((first, stop, ids, counts),) = tokenizer.encode_column(pa.array(texts))
    assert (first, stop) == (0, len(texts)) and len(sizes) > 10 and max(sizes) <= 2_000
    assert counts.tolist() == [len(x) for x in plain] and ids.tolist() == [i for x in plain for i in x]


@pytest.mark.parametrize("limits", [(2048, 256, None), (100, 4, 30), (64, 1, 64)])
def test_pack_keeps_all_limits(limits):
    rng = np.random.default_rng(5)
    tokens = [int(x) for x in rng.integers(0, 300, 400)] + [5000, 1, 1]
    loss = [int(t * s) for t, s in zip(tokens, rng.random(len(tokens)), strict=True)]
    pieces = packing.pack(tokens, loss, *limits)
    most = (limits[0], limits[1], limits[2] or limits[0])
    held: dict = {}
    for example, start, length, sequence, offset in pieces:
        used = held.setdefault(sequence, [0, 0, 0])
        assert offset == used[0] and length > 0
        first_bearing = tokens[example] - loss[example]
        used[0] += length
        used[1] += 1
        used[2] += max(0, start + length - max(start, first_bearing))
        assert all(u <= m for u, m in zip(used, most, strict=True))
    covered = Counter()
    for example, start, length, *_ in pieces:
        covered.update((example, t) for t in range(start, start + length))
    assert covered == Counter((e, t) for e, n in enumerate(tokens) for t in range(n))
    assert packing.pack([], []) == []


def check_packed(got, texts):
    ids = [x + [1] for x in ids_of("byte_bpe_50k.json", [t for _, t in texts])]
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values(), default=0) <= 2048
    want = Counter((doc_id, len(x)) for (doc_id, _), x in zip(texts, ids, strict=True))
    assert Counter({k: v * k[1] for k, v in want.items()}) == sum(
        (Counter({(r["doc_id"], r["doc_tokens"]): r["length"]}) for r in got), Counter()
    )
    by_doc = {(doc_id, len(x)): x for (doc_id, _), x in zip(texts, ids, strict=True)}
    for r in got:
        x = by_doc[r["doc_id"], r["doc_tokens"]]
        assert r["ids_crc32"] == crc(x[r["start"] : r["start"] + r["length"]])
    return used


def test_packed_documents(spark, documents):
    used = check_packed(rows_of(QUERIES["op4_vector_packing"](spark, SMALL)), [d[:2] for d in documents])
    assert sum(used.values()) > 0.98 * 2048 * (len(used) - 1)


def test_packed_odd_documents(spark, odd_docs, no_docs):  # noqa: F811
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packed(rows_of(packing.pack_documents(odd_docs, path)), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert packing.pack_documents(no_docs, path).count() == 0


# --- mixing ---------------------------------------------------------------------------


def targets_by_hand(sizes, most=3):
    """Shares by weight, the excess over each cap shared again until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[n] for n in open_)
        above = [n for n in open_ if share * weight[n] > most * sizes[n]]
        for n in above or open_:
            target[n] = most * sizes[n] if above else share * weight[n]
            left -= target[n] if above else 0
        open_ = [n for n in open_ if n not in above] if above else []
    return target


def check_mix(got, documents):
    sizes = Counter()
    for _, text, source in documents:
        sizes[source] += len(words_of(text))
    want = targets_by_hand(sizes)
    by_row = Counter((d, len(words_of(t)), sizes[s], round(want[s], 6)) for d, t, s in documents)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == by_row
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    return sizes, want


def test_mix(spark, stage, documents):  # noqa: F811
    docs = [(d[0], d[1], d[3]) for d in documents]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    got = rows_of(mixing.mix(frame, stage))
    _, want = check_mix(got, docs)
    source_of, taken = {d[0]: d[2] for d in docs}, Counter()
    for r in got:
        taken[source_of[r["doc_id"]]] += r["taken"]
    for name, target in want.items():
        assert taken[name] == pytest.approx(target, rel=0.01, abs=20)
    again = rows_of(mixing.mix(frame.repartition(7), stage.__class__(spark)))
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_mix_odd_documents(spark, stage, odd_docs, no_docs):  # noqa: F811
    check_mix(rows_of(mixing.mix(odd_docs, stage)), [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()])
    assert mixing.mix(no_docs, stage.__class__(spark)).count() == 0
    silent = odd_docs.filter("doc_id in (4, 5, 6)")
    assert {r["taken"] for r in rows_of(mixing.mix(silent, stage.__class__(spark)))} == {0}


def test_small_sources_reach_their_targets(spark, stage):  # noqa: F811
    sizes = {"a": 4_000_000, "b": 1, "c": 5, "d": 40, None: 7} | {f"e{i:02}": i + 1 for i in range(30)}
    rows = [(f"{s}", n // 2000, 2000) if n > 2000 else (s, 1, n) for s, n in sizes.items()]
    frame = spark.createDataFrame(rows, "source string, copies int, n int")
    frame = frame.select("source", F.explode(F.sequence(F.lit(1), "copies")).alias("doc_id"), F.expr("repeat('w ', n)").alias("text"))
    taken = Counter()
    out = mixing.mix(frame.withColumn("doc_id", F.xxhash64("source", "doc_id")), stage)
    got = out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == frame.count()
    by_hand_targets = targets_by_hand(sizes)
    by_pair = Counter((sizes[s], round(by_hand_targets[s], 3)) for s in sizes)
    for r in got:
        taken[r["source_size"], round(r["target"], 3)] += r["taken"]
    assert taken == {(size, target): n * int(target + 0.5) for (size, target), n in by_pair.items()}


def test_schedule_is_settled_block_by_block(spark):
    sizes = {"a": 50_000, "b": 3, "c": 700, None: 1}
    targets = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), 3).cache()
    slots = -(-sum(sizes.values()) // 64)
    got = rows_of(mixing.settle(mixing.schedule(targets, slots), targets, slots, 64))
    assert len({r["slot"] for r in got}) == len(got)
    for t in targets.collect():
        own = sorted((r["block"], r["slot"], r["words"]) for r in got if r["rank"] == t["rank"])
        assert [b for b, _, _ in own] == list(range(len(own))) and [s for _, s, _ in own] == sorted(s for _, s, _ in own)
        assert sum(w for _, _, w in own) == int(t["target"] + 0.5) and {w for _, _, w in own[:-1]} <= {64}


def test_golden_points_of_late_slots(spark):
    slots = [0, 1, 2, 65_535, 65_536, 3_474_701_534, 3_600_000_000, 1 << 32, (1 << 32) + 5, 1 << 50, (1 << 62) + 77]
    frame = spark.createDataFrame([(s,) for s in slots], "slot long")
    got = [r["u"] for r in frame.select(mixing.golden_point("slot").alias("u")).collect()]
    assert got == [s * 2_654_435_769 % (1 << 32) / (1 << 32) for s in slots]


def test_the_mix_is_its_schedule(spark, stage, monkeypatch):  # noqa: F811
    docs = [(i, "w " * (i % 40 + 1), "abc"[min(i % 5, 2)]) for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    held = {}
    pieces_of = mixing.mixed_pieces

    def kept(placed, slots, most, block_words):
        held["slots"], held["pieces"] = rows_of(slots), rows_of(pieces_of(placed, slots, most, block_words))
        return pieces_of(placed, slots, most, block_words)

    monkeypatch.setattr(mixing, "mixed_pieces", kept)
    rows = rows_of(mixing.mix(frame, stage, block_words=16))
    source, size = {d[0]: d[2] for d in docs}, {r["doc_id"]: r["size"] for r in rows}
    by_slot = {r["slot"]: [] for r in held["slots"]}
    for p in held["pieces"]:
        by_slot[p["slot"]].append(p)
    words_in = {r["slot"]: r["words"] for r in held["slots"]}
    spans = {}
    for slot, pieces in by_slot.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):  # gapless from 0
            assert p["offset"] == at
            at += p["to"] - p["from"]
            spans.setdefault((p["doc_id"], p["copy"]), []).append((p["from"], p["to"]))
        assert at == words_in[slot] and len({source[p["doc_id"]] for p in pieces}) == 1
    for (doc, _), parts in spans.items():  # each word of a copy lies in one slot
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][1] <= size[doc]
    for r in rows:
        own = [p for p in held["pieces"] if p["doc_id"] == r["doc_id"]]
        assert r["taken"] == sum(p["to"] - p["from"] for p in own)
        assert r["first_slot"] == min((p["slot"] for p in own), default=None)
    # The first slots already have the shares of the whole.
    goal, order = Counter(), sorted(by_slot)
    for r in rows:
        goal[source[r["doc_id"]]] += r["taken"]
    total = sum(goal.values())
    for n in (50, 150, 400):
        seen = Counter()
        for slot in order[:n]:
            seen[source[by_slot[slot][0]["doc_id"]]] += 1
        assert all(abs(seen[s] / n - goal[s] / total) < 4 / n for s in goal)
    # Other points are another mix.
    monkeypatch.setattr(mixing, "golden_point", lambda slot: F.pmod(F.col(slot) * 7, F.lit(101)) / F.lit(101.0))
    other = rows_of(mixing.mix(frame, stage.__class__(spark), block_words=16))
    assert {r["doc_id"]: r["first_slot"] for r in other} != {r["doc_id"]: r["first_slot"] for r in rows}


def test_targets_when_many_sources_are_capped(spark):
    sizes = {"a": 1, "b": 1000, "c": 1, "d": 1, "e": 5, None: 2}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame, 3).collect()}
    assert got == pytest.approx(targets_by_hand(sizes))


# --- near-duplicate documents -----------------------------------------------------------


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_by_hand(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def check_near(got, docs, k, num, den):
    sets = [shingles(t, k) for _, t in docs]

    def linked(i, j):
        common = len(sets[i] & sets[j])
        return bool(sets[i] and sets[j]) and den * common >= num * (len(sets[i]) + len(sets[j]) - common)

    root = components_by_hand(len(docs), linked)
    low = {r: min(docs[i][0] for i in range(len(docs)) if root[i] == r) for r in set(root)}
    want = Counter((d[0], len(s), low[r], d[0] == low[r]) for d, s, r in zip(docs, sets, root, strict=True))
    assert Counter((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want


def edited(rng, words, edits):
    words = list(words)
    for at in rng.integers(0, len(words), edits):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_near_duplicates_of_one_large_group(spark, stage):  # noqa: F811
    """Copies with 0 to 12 edits of one text: many links, near misses on both sides of the threshold."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    docs = [(1000 - i, edited(rng, base, int(rng.integers(0, 13)))) for i in range(150)]
    docs += [(2000 + i, edited(rng, docs[i][1].split(), 2)) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check_near(rows_of(minhash.near_duplicates(frame, stage, shingle=3, similarity=(17, 20))), docs, 3, 17, 20)
    check_near(rows_of(minhash.near_duplicates(frame, stage.__class__(spark))), docs, 5, 4, 5)


def test_near_duplicates_of_odd_documents(spark, stage, odd_docs, no_docs):  # noqa: F811
    found = rows_of(minhash.near_duplicates(odd_docs, stage))
    assert len(found) == odd_docs.count()
    nameless = [r for r in found if r["id"] is None]
    assert [(r["component_id"], r["kept"]) for r in nameless] == [(None, True)]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] is not None]
    check_near([r for r in found if r["id"] is not None], docs, 5, 4, 5)
    assert minhash.near_duplicates(no_docs, stage.__class__(spark)).count() == 0


# --- near-duplicate vectors -------------------------------------------------------------


def check_vectors(got, rows, dim):
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else None)

    def linked(i, j):
        return unit[i] is not None and unit[j] is not None and float(unit[i] @ unit[j]) >= 0.95

    root = components_by_hand(len(rows), linked)
    low = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    counts = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    want = Counter((r[0], n, low[g], r[0] == low[g]) for r, n, g in zip(rows, counts, root, strict=True))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want


def test_near_vectors(spark, stage):  # noqa: F811
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((40, 32))
    rows = [(i, (centers[i % 40] + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.2, 0.25])).tolist()) for i in range(400)]
    rows += [(400 + i, (3 * np.array(rows[7][1])).tolist()) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    check_vectors(rows_of(subspace.near_vectors(frame, stage, strip=30)), rows, 32)


def test_near_odd_vectors(spark, stage):  # noqa: F811
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.1, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]),
        (7, [inf, 0.0, 0.0]), (8, [None, 1.0, 0.0]), (9, [1.0, 0.0]), (10, []), (11, [-1.0, 0.0, 0.0]), (12, [1e-30, 0.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame = frame.withColumns({c: F.lit(1) for c in ("key", "v", "weight", "label", "n", "component")})
    check_vectors(rows_of(subspace.near_vectors(frame, stage)), rows, 3)
    assert subspace.near_vectors(frame.limit(0), stage.__class__(spark)).count() == 0


def test_near_vectors_of_several_lengths(spark, stage):  # noqa: F811
    rng = np.random.default_rng(5)
    rows = []
    for dim, n in ((3, 60), (8, 90), (9, 1), (1, 12)):
        centers = rng.standard_normal((6, dim))
        near = [(centers[i % 6] + rng.standard_normal(dim) * 0.05).tolist() for i in range(n)]
        rows += [(len(rows) + i, v) for i, v in enumerate(near)]
    rows += [(len(rows) + i, rows[150][1]) for i in range(3)]  # copies of the only one of its length
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = rows_of(subspace.near_vectors(frame, stage, strip=20))
    assert len(got) == len(rows)
    for dim in (1, 3, 8, 9):
        own = [r for r in rows if len(r[1]) == dim]
        ids = {i for i, _ in own}
        check_vectors([r for r in got if r["vec_id"] in ids], own, dim)
    assert sum(r["n_links"] for r in got if r["vec_id"] < 60) > 0


# --- fingerprints -----------------------------------------------------------------------


def paragraphs(text):
    return {p for p in re.split(r"\n|(?<=[.!?]) ", text) if p}


def check_fingerprints(got, docs):
    """``docs``: (id, text) by descending id, without repeats."""
    texts = [t or "" for _, t in docs]
    found = {(r["doc_id"], r["n_chars"]): r for r in got}
    prints = {}
    for at, (doc_id, _) in enumerate(docs):
        text, after = texts[at], texts[(at + 1) % len(docs)]
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        r = found[doc_id, len(text)]
        assert r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()

        def jaccard(a, b):
            a, b = paragraphs(a), paragraphs(b)
            return len(a & b) / len(a | b) if a | b else 1.0

        assert r["near_edited"] == pytest.approx(jaccard(text, edit)) and r["near_next"] == pytest.approx(jaccard(text, after))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_fingerprints(spark, documents):
    got = rows_of(QUERIES["op8_invertible_sketch"](spark, SMALL))
    assert len(got) == len(documents)
    check_fingerprints(got, sorted((d[:2] for d in documents), key=lambda d: -d[0]))


def test_fingerprints_of_odd_documents(spark, stage, odd_docs, no_docs):  # noqa: F811
    got = rows_of(fp.fingerprint_edits(odd_docs, stage))
    assert len(got) == odd_docs.count()
    distinct = {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    check_fingerprints(got, sorted(distinct, key=lambda d: (d[0] is None, -(d[0] or 0))))
    assert fp.fingerprint_edits(no_docs, stage.__class__(spark)).count() == 0


@pytest.mark.parametrize("sizes", [(0, 0, 0), (3, 0, 0), (1, 2, 5), (40, 30, 200), (0, 600, 10), (900, 0, 0)])
def test_peeling_recovers_the_difference(spark, sizes):
    rng = np.random.default_rng(sum(sizes))
    left, right, both = ([int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)] for n in sizes)
    frame = spark.createDataFrame([(left + both, both + right)], "a array<long>, b array<long>")
    got = frame.select(fp.difference("a", "b").alias("d")).first()["d"]
    assert Counter(map(tuple, got)) == Counter([(x, 1) for x in left] + [(x, -1) for x in right])


def test_difference_of_sketches_made_once(spark):
    """Sketches subtract: with those of both texts the difference is the one worked out from the digests."""
    rng = np.random.default_rng(5)
    left, right, both = ([int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)] for n in (2, 1, 300))
    frame = spark.createDataFrame([(left + both, both + right), (both, both), ([], left)], "a array<long>, b array<long>")
    frame = frame.withColumns({"p": fp.sketch("a"), "q": fp.sketch("b")})
    rows = frame.select(fp.difference("a", "b", ("p", "q")).alias("d"), fp.difference("a", "b").alias("e")).collect()
    assert all(Counter(map(tuple, r["d"])) == Counter(map(tuple, r["e"])) for r in rows)
    assert [len(r["d"]) for r in rows] == [3, 0, 2]


# --- WARC -------------------------------------------------------------------------------


def test_odd_pages(spark, stage):  # noqa: F811
    body = "<p>é</p>" * 200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [
        (1, "http://a/\r\nX: y", body), (2, None, body), (2, None, body), (3, "u", body[:50]), (4, "u", body[:50]),
        (5, "", None), (6, "u", ""), (None, "u", body), (7, "http://b/", LONG),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in ("digest", "bytes", "body", "refers_to")}
    )
    warc.write_archives(pages, f"{stage.path}/w", stage, archive_bytes=500)
    got = Counter(
        (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
        for r in warc.read_archives(spark, f"{stage.path}/w").collect()
    )
    want = Counter()
    for page_id, _, html in rows:
        raw = (html or "").encode()
        again = page_id == 1
        want[page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 2 if again else None] += 1
    assert got == want
    empty = stage.__class__(spark)
    warc.write_archives(pages.limit(0), f"{empty.path}/w", empty)
    assert warc.read_archives(spark, f"{empty.path}/w").count() == 0


# --- language ID ------------------------------------------------------------------------


def test_language_id_held_out_accuracy(spark, documents):
    lang = {d[0]: d[2] for d in documents}
    rows = [r for r in rows_of(QUERIES["op10_language_id"](spark, SMALL)) if r["held_out"] and lang[r["doc_id"]]]
    assert rows and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.9


def test_language_model_by_hand(spark):
    labelled = [(1, "ab ab", "x"), (2, "cd", "y"), (3, "zz", None), (4, None, "x")]
    frame = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    model = langid.train(frame, order=2, buckets=64, alpha=0.5)
    assert model["langs"] == ["x", "y"] and np.exp(model["prior"]).tolist() == [0.5, 0.5]
    for at, text in enumerate(["ab ab", "cd"]):
        n = np.bincount(langid.ngram_buckets(text, 2, 64), minlength=64) + 0.5
        assert model["log"][:, at] == pytest.approx(np.log(n / n.sum()), abs=1e-5)


def test_language_id_of_odd_documents(spark, odd_docs, no_docs):  # noqa: F811
    kept = [F.struct(*odd_docs.columns).alias("row")]
    got = rows_of(langid.predict(odd_docs, langid.train(odd_docs), kept))
    assert len(got) == odd_docs.count()
    for r in got:
        text = r["row"]["text"]
        silent = text is None or not any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == silent and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in rows_of(langid.predict(odd_docs, langid.train(no_docs), ["doc_id"]))} == {"und"}
    assert langid.predict(no_docs, langid.train(odd_docs), ["doc_id"]).count() == 0


def test_byte_mixing_is_a_permutation_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(mix_bits(x))) == len(x)


def test_language_predictions_against_plain_computation(spark, documents):  # noqa: F811
    docs = [(d[0], d[1], ["en", "de", None, "fr"][d[0] % 4]) for d in documents] + [(10**6, None, "en"), (10**6 + 1, "12 !", "de")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    got = {r["doc_id"]: r for r in rows_of(langid.predict(frame, langid.train(frame, order=2, buckets=97, alpha=0.5), ["doc_id"]))}
    grams, rows = {}, Counter()
    for _, text, lang in docs:
        if lang is not None and text is not None:
            rows[lang] += 1
            held = grams.setdefault(lang, [0.5] * 97)
            for at in langid.ngram_buckets(text, 2, 97):
                held[at] += 1
    for ident, text, _ in docs:
        if not any(c.isalpha() for c in text or ""):
            assert (got[ident]["lang_pred"], got[ident]["score"]) == ("und", 0.0)
            continue
        logs = {}
        for lang, held in grams.items():
            total = sum(held)
            logs[lang] = np.log(rows[lang] / sum(rows.values())) + sum(np.log(held[at] / total) for at in langid.ngram_buckets(text, 2, 97))
        best = max(sorted(logs), key=logs.get)
        assert got[ident]["score"] == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), abs=1e-3)
        assert got[ident]["lang_pred"] == best or logs[best] - logs[got[ident]["lang_pred"]] < 1e-3
