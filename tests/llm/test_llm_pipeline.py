"""The pipeline, stage by stage, against brute force on the smallest tables."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import SMALL
from llm_cases import no_docs, odd_docs, stage  # noqa: F401
from pyspark.sql import functions as F
from test_llm_operators import check_mix, check_packed, components_by_hand, shingles, words_of

import corpus_pipeline as cp


def as_tuples(frame):
    return [tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.fixture(scope="module")
def steps(spark):
    from mergelens.sources.staging import Staging

    held, docs = Staging(spark), spark.read.parquet(f"{SMALL}/documents.parquet")
    frames = [docs]
    for name, apply in cp.STAGES:
        frames.append(held.table(name, apply(spark, frames[-1], SMALL)))
    return frames


def test_stages_keep_the_columns(steps):
    assert len({tuple(f.columns) for f in steps[:-1]}) == 1
    assert [name for name, _ in cp.STAGES] == ["language_id", "near_duplicates", "mix_sources", "packing"]


def test_language_stage_drops_texts_without_letters(steps):
    silent = [r for r in as_tuples(steps[0]) if not any(c.isalpha() for c in r[1] or "")]
    assert Counter(as_tuples(steps[0])) - Counter(as_tuples(steps[1])) == Counter(silent)


def test_language_stage_without_labels_keeps_texts_with_letters(spark, odd_docs):  # noqa: F811
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    kept = cp.identify_language(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 3, 8, 9, 10, 11]


def test_duplicate_stage_keeps_one_of_each_group(steps):
    rows = as_tuples(steps[1])
    sets = [shingles(r[1], 5) for r in rows]

    def linked(i, j):
        common = len(sets[i] & sets[j])
        return bool(sets[i] and sets[j]) and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common)

    root = components_by_hand(len(rows), linked)
    low = {}
    for row, r in zip(rows, root, strict=True):
        low[r] = min(low.get(r, row), row)
    assert Counter(as_tuples(steps[2])) == Counter(low.values())


def test_mix_stage_takes_what_the_operator_says(spark, steps, stage):  # noqa: F811
    before = {r[0]: r for r in as_tuples(steps[2])}
    rows = cp.numbered(steps[2], stage)
    of_key = {r["key"]: r["row"]["doc_id"] for r in rows.collect()}
    sizes = rows.select("key", "content", "row.text", "row.source")
    found = cp.mix(sizes, stage, id="key", order="content").collect()
    taken = {of_key[r["doc_id"]]: r.asDict() | {"doc_id": of_key[r["doc_id"]]} for r in found}
    check_mix(list(taken.values()), [(r[0], r[1], r[3]) for r in before.values()])
    words = {}
    for r in as_tuples(steps[3]):
        words.setdefault(r[0], []).append(words_of(r[1]))
        assert r[2:4] == before[r[0]][2:4] and r[4] == len(r[1])
    assert set(words) == {d for d, r in taken.items() if r["taken"]}
    for doc_id, copies in words.items():
        whole = words_of(before[doc_id][1])
        assert sum(map(len, copies)) == taken[doc_id]["taken"] and all(c == whole[: len(c)] for c in copies)


def test_packing_stage(steps):
    check_packed([r.asDict() for r in steps[4].collect()], [r[:2] for r in as_tuples(steps[3])])


def test_stages_on_odd_documents(spark, odd_docs, no_docs, stage):  # noqa: F811
    docs, extra = odd_docs, odd_docs.columns
    for name, apply in cp.STAGES:
        docs = stage.table(name, apply(spark, docs, SMALL))
        assert docs.columns == extra or name == "packing"
        if name == "near_duplicates":
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 8, 10, 11]
    for _, apply in cp.STAGES:
        assert apply(spark, no_docs, SMALL).count() == 0


def _rows(spark, rows):
    """Documents with a clashing and a dotted column."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, `a.b` long"
    full = [(i, t, "en", s, len(t or ""), "k", n) for n, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


ONE = " ".join(f"one{i}" for i in range(40))
TWO = " ".join(f"two{i}" for i in range(40))


def test_duplicates_are_judged_by_row(spark):
    # Null ids link by their text, and rows that share an id are apart.
    docs = _rows(spark, [
        (None, ONE, "a"), (7, ONE + " end", "a"), (7, TWO, "a"), (3, TWO + " end", "a"), (None, "alone", "a"),
        (None, "alone", "a"), (5, None, "a"), (5, None, "a"), (6, "", "a"),
    ])
    kept = cp.drop_near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    found = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert found == {(7, ONE + " end"): 1, (3, TWO + " end"): 1, (None, "alone"): 1, (5, None): 2, (6, ""): 1}


def test_mix_of_equal_rows_and_hot_source(spark):
    docs = _rows(spark, [(1, ONE, "hot")] * 300 + [(None, TWO, "b"), (1, TWO, None), (2, None, "b"), (3, " ", "hot")])
    once, again = (
        Counter((r["doc_id"], r["text"], r["source"]) for r in cp.mix_sources(spark, d, SMALL).collect())
        for d in (docs, docs.repartition(7))
    )
    assert once == again
    words = Counter()
    for (_, text, source), n in once.items():
        words[source] += n * len(text.split())
    # Weights 1 (b), 2 (hot), 3 (null); b and null stop at three times their 40 words.
    assert words == {"b": 120, None: 120, "hot": 302 * 40 - 240}
    assert cp.mix_sources(spark, docs, SMALL).columns == docs.columns
