"""Spelling variants, personal data and collocations against brute force, and their awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from llm_cases import LONG, no_docs, odd_docs, stage  # noqa: F401
from pyspark.sql import functions as F

from mergelens.llm import bloom, phrases, pii, queries
from mergelens.llm.common import table
from mergelens.llm.phrases import collocations, frequent_prefixes
from mergelens.llm.spelling import group_variants, near_pairs

# --- Bloom filters -----------------------------------------------------------


def test_bloom_filters_hold_their_members_at_any_size(spark):
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**64, 60_000, dtype=np.uint64)
    rows = [(i % 3, int(h)) for i, h in enumerate(hashes.view(np.int64).tolist())]
    df = spark.createDataFrame(rows, "shard int, h long").repartition(4)
    others = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    for most, rate in ((bloom.MAX_BYTES, 0.01), (20_000, 1.0)):
        filters = bloom.build(df, most)
        assert sum(b.nbytes for b in filters.shards.values()) <= max(most, 3 * 8 * bloom.LEAST_BLOCKS) + 24
        for shard in range(3):
            assert filters.contains(shard, hashes[shard::3]).all()
        assert filters.contains(0, others).mean() < rate
        assert not filters.contains(9, others).any()
    assert bloom.build(df.limit(0)).shards == {}


# --- spelling variants -------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio):
    out = {}
    for word, n in counts.items():
        near = [other for other in counts if one_edit(word, other)]
        best = min(near, key=lambda other: (-counts[other], other), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[word] = [n, len(near), form, counts[form] if form else None]
    for word, row in out.items():
        root = word
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {word: tuple(row) for word, row in out.items()}


def as_dict(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("max_bytes", [bloom.MAX_BYTES, 1500])
def test_variants_match_brute_force(spark, stage, max_bytes):  # noqa: F811
    rng = random.Random(3)
    letters = "abcé語😀"
    counts = {}
    for _ in range(500):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
        counts[word] = rng.choice([1, 2, 3, 30, 40, 500, 90_000])
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert as_dict(group_variants(df, stage, ratio=10, max_bytes=max_bytes)) == grouped(counts, 10)


def test_variants_pairs_come_once_and_chains_end(spark, stage):  # noqa: F811
    words = ["abcdefg", "abcdef", "abcdeff", "aabcdefg", "xbcdefg"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    found = Counter(frozenset((r.word, r.near)) for r in near_pairs(df).collect())
    expected = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert set(found) == expected and set(found.values()) == {1}
    chain = [("a" * 7 + "b" * i, 10**i) for i in range(12)]
    told = as_dict(group_variants(spark.createDataFrame(chain, "word string, n long"), stage))
    assert {row[4] for row in told.values()} == {chain[-1][0]}


def test_variants_awkward_rows(spark, stage):  # noqa: F811
    long = "ab" * 120_000
    rows = [(None, 5), ("", 5), ("word", None), ("word", 2), ("word", 1), ("ward", 40), (long, 1), (long + "c", 10)]
    df = spark.createDataFrame(rows, "word string, n long").withColumn("form", F.lit(1)).withColumn("root", F.lit(1))
    told = as_dict(group_variants(df, stage))
    assert told["word"] == (3, 1, "ward", 40, "ward") and told["ward"] == (40, 1, None, None, "ward")
    assert told[long] == (1, 1, long + "c", 10, long + "c") and set(told) == {"word", "ward", long, long + "c"}
    empty = group_variants(df.limit(0), queries.staging(spark))
    assert empty.columns == ["word", "n", "n_near", "form", "form_n", "root"] and empty.isEmpty()


def test_op11_words(spark, odd_docs, no_docs):  # noqa: F811
    def brute(rows):
        out = Counter()
        for doc_id, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 7:
                    out[run] += 1
        return {w: n for w, n in out.items() if n >= 2}

    for docs in (table(spark, SMALL, "documents"), odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert {r.word: r.n for r in queries.counted_words(docs).collect()} == brute(rows)
    assert queries.counted_words(no_docs).isEmpty()


# --- personal data -----------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for order, kind, pattern, low, high in ((2, "card", CARD, 12, 19), (3, "phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or passes_luhn(digits)):
                out.append((m.start(), order, kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out)]


def test_op12_base_spans(spark, odd_docs, tmp_path):  # noqa: F811
    rng = random.Random(11)
    parts = ["a@b.c", "x.y@d-e.f.g", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (212) 555-0100",
             "+", " ", "é", "😀", "12", "001.02.3.4.5", "a@b", "-", "5500005555555559", "\n", "x", "0"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/made/documents.parquet")
    for folder, docs in ((f"{tmp_path}/made", rows), (SMALL, None)):
        docs = docs or [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
        found = {r.doc_id: r for r in queries.QUERIES["op12_personal_data"](spark, folder).collect()}
        assert len(found) == len(docs)
        for doc_id, text in docs:
            base, row = base_spans(text or ""), found[doc_id]
            assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
                sum(s.startswith(f"{kind}:") for s in base) for kind in pii.BASE_KINDS
            ]
            told = row.spans.split(",") if row.spans else []
            assert [s for s in told if s.split(":")[0] in pii.BASE_KINDS] == base


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")

    def kinds(text):
        return [(kind, text[start:end], points) for kind, start, end, points in pii.text_spans(text)]

    assert kinds("IBAN: GB82 WEST 1234 5698 7654 32 thanks") == [("iban", "GB82 WEST 1234 5698 7654 32", 1.0)]
    assert kinds("GB82 WEST 1234 5698 7654 32 OK") == [("iban", "GB82 WEST 1234 5698 7654 32", 0.8)]
    assert kinds("GB83 WEST 1234 5698 7654 32") == []
    assert kinds("SSN 219-09-9999") == [("ssn", "219-09-9999", 0.8)] and kinds("part 219-09-9999") == []
    assert kinds("ssn 000-09-9999") == []
    secret = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    assert kinds(f'token = "{secret}"') == [("secret", secret, 0.8)] and kinds(f"commit {secret}") == []
    assert kinds("card 4111 1111 1111 1111")[0][2] == 1.0 and kinds("x 4111 1111 1111 1111")[0][2] == 0.8


def test_pii_long_runs_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "+1" + " " * 2_000_000, "1 " * 1_000_000, "a.b" * 700_000 + "@", "@a" * 900_000):
        assert all(kind == "x" for kind, *_ in pii.text_spans(text))
    assert pii.text_spans("a" * 300_000 + "@b.c") == [("email", 0, 300_004, 0.9)]


def test_pii_awkward_rows_and_mask(spark, odd_docs, no_docs):  # noqa: F811
    clash = odd_docs.withColumns({"spans": F.lit(1), "kept": F.lit(2), "kind": F.lit(3)})
    out = pii.find_spans(clash, [F.col(c) for c in clash.columns])
    assert sorted(out.columns) == sorted(clash.columns) and out.count() == clash.count()
    assert out.filter("text is null or text = ''").filter("size(spans) <> 0").isEmpty()
    assert pii.find_spans(no_docs).isEmpty()
    df = spark.createDataFrame([(1, "é x@y.zz or +49 30 1234567."), (2, None), (3, "none")], "doc_id long, text string")
    masked = pii.find_spans(df, ["doc_id", "text"]).select("doc_id", pii.mask("text").alias("m"))
    assert {r.doc_id: r.m for r in masked.collect()} == {1: "é [EMAIL] or [PHONE].", 2: None, 3: "none"}


# --- collocations ------------------------------------------------------------


def mined(rows, least, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    often = {key: c for key, c in f.items() if c >= least}
    inside = set()
    for (lang, p), c in often.items():
        for size in range(2, len(p)):
            inside.update((lang, p[i : i + size], c) for i in range(len(p) - size + 1))
    out = {}
    for (lang, p), a in often.items():
        if len(p) >= 2 and (lang, p, a) not in inside:
            cuts = [
                (1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                for k in range(1, len(p))
            ]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    rows = set()
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return rows


def told(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def random_texts(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "é", "語", "x", "-", "mat\x85", "on"]
    marks = [" ", " ", " ", "\t", ", ", ".", "\n", "!", "  "]
    return [
        ("".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "fr", None, "und"]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("rows_per_task, buffered", [(400_000, 1_000_000), (40, 100)])
def test_collocations_match_brute_force(spark, stage, monkeypatch, rows_per_task, buffered):  # noqa: F811
    monkeypatch.setattr(phrases, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(phrases, "BUFFERED", buffered)
    rows = random_texts(1) + [("one hot line of words " * 40, "en")] * 30 + [("a a a a a a a", None)] * 20
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for least, top in ((5, 2000), (20, 7)):
        assert told(collocations(df, queries.staging(spark), least=least, top=top)) == mined(rows, least, top)


def test_collocations_with_tiny_filters(spark, stage):  # noqa: F811
    """False positives of full filters only lengthen suffixes."""
    rows = random_texts(2)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert told(collocations(df, stage, least=4, max_bytes=8)) == mined(rows, 4, 2000)


def test_collocations_awkward_rows(spark, odd_docs, no_docs, monkeypatch):  # noqa: F811
    rows = [(r.text, r.lang) for r in odd_docs.collect()]
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("h", "p", "word", "w1", "f", "a", "rank", "phrase", "n", "total")})
    assert told(collocations(clash, queries.staging(spark), least=2)) == mined(rows, 2, 2000)
    empty = collocations(no_docs, queries.staging(spark))
    assert empty.isEmpty() and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations(odd_docs, queries.staging(spark), least=10**6).isEmpty()


def test_long_texts_are_cut_at_breaks_only():
    import pyarrow as pa

    text = (LONG + ". ") * 8 + "end"
    batch = pa.RecordBatch.from_arrays([pa.array(["", text, None, "a b"]), pa.array(["x", "x", "x", None])], ["text", "lang"])
    spelled = []
    for words, langs in phrases.batch_words(batch, 0):
        spelled += words.spelled(np.arange(len(words.hashes))).to_pylist()
        assert len(words.data) <= 3 * phrases.CHUNK_BYTES
        assert set(langs.to_pylist()) <= {"x", "und"}
    assert spelled == re.findall("[^ \t\n.]+", text.lower()) + ["a", "b"]


def test_quicksort_counts_prefixes_and_borders():
    rng = np.random.default_rng(2)
    rows = rng.integers(1, 4, (3000, 5))
    for depth in (3, 4):
        rows[rng.random(3000) < 0.2, depth:] = 0
    counts = rng.integers(1, 5, 3000)
    expected = Counter()
    for row, c in zip(rows.tolist(), counts.tolist()):
        for size in range(3, 6):
            if row[size - 1]:
                expected[tuple(row[:size])] += c
    for least in (1, 40, 200, 10**9):
        found = frequent_prefixes(rows, counts, least)
        assert all(expected[k] == n for k, n in found.items())
        assert {k for k, n in expected.items() if n >= least} <= set(found)
    first = tuple(min(rows.tolist()))
    assert all(first[:k] in found for k in (3, 4, 5) if first[k - 1])


def test_exact_scores(spark):
    big = 3 * 10**12
    row = spark.range(1).select(
        phrases._exact(F.lit(1000), F.lit(big), F.lit(7 * 10**13)).alias("x"), phrases._exact(F.lit(big + 1), F.lit(big)).alias("y")
    )
    assert row.selectExpr("x div y as s").first()["s"] == 1000 * big * 7 * 10**13 // ((big + 1) * big)
