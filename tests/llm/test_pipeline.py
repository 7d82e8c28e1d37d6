"""The pipeline's stages against plain Python, each on what the one before kept."""

import gc
import math
import os
import time

import pytest

import corpus_pipeline
from arbora.llm import langid
from arbora.llm.common import free_unused, stored
from tests.llm import brute

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def results(spark):
    rows = brute.corpus()
    docs = spark.createDataFrame(rows, brute.SCHEMA).select(*COLUMNS)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], "")))
    return [sorted(map(tuple, df.collect()), key=str) for df in out], out


def test_columns_stay_until_the_last(results):
    assert [df.columns for df in results[1][:-1]] == [COLUMNS] * 5


def test_language_drops_what_it_rejects(results):
    (before, after, *_), (docs, *_) = results
    model = langid.train(docs)
    sure = {}
    for r in before:
        if r[1] and any(map(str.isalpha, r[1])):
            # the share of the second best decides: losses closer than 0.05 are ambiguous
            _, score = brute.language(model, r[1])
            sure[r[1]] = math.log(score / (1 - score)) >= 0.05 if len(model.langs) == 2 else None
    assert len(model.langs) == 2 and len(after) < len(before)
    assert after == sorted((r for r in before if sure.get(r[1])), key=str)


def test_exact_keeps_the_longest_then_first(results):
    before, after = results[0][1:3]
    groups = {}
    for r in before:
        groups.setdefault(b"".join(brute.words(r[1])), []).append(r)
    want = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    assert after == sorted(want, key=str)


def test_near_keeps_one_of_each_group(results):
    before, after = results[0][2:4]
    want = {i for i, _, c in brute.near([(r[0], r[1]) for r in before]) if i == c}
    assert {r[0] for r in after} == want and len(after) == len(want)


def test_mix_repeats_by_what_is_taken(results):
    before, after = results[0][3:5]
    _, order = brute.mixing([(r[0], r[1], r[3]) for r in before])
    assert after == sorted((before[k] for _, _, k in order), key=str)
    assert [r.doc_id for r in results[1][4].collect()] == [before[k][0] for _, _, k in order]


def test_pack_fills_sequences(results):
    places = {}
    for r in results[1][5].collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_an_empty_table_runs_through(spark):
    docs = spark.createDataFrame([], brute.SCHEMA).select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""))
    assert docs.count() == 0


def test_stages_do_not_free_what_others_read(spark):
    rows = [r for r in brute.corpus() if r[1]]
    docs = spark.createDataFrame(rows, brute.SCHEMA).select(*COLUMNS).repartition(4)
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies, corpus_pipeline.mix):
        a, b = stage(spark, docs, ""), stage(spark, docs.limit(20), "")
        derived = a.select("doc_id")
        del a
        for _ in range(2):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
        free_unused()
        assert derived.count() > b.count() > 0


def test_tables_that_nothing_reads_are_freed(spark):
    a = stored(spark.range(10))
    path = a.inputFiles()[0].removeprefix("file://")
    kept = a.where("id > 3")
    del a
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    free_unused()
    assert os.path.exists(path) and kept.count() == 6
    del kept
    for _ in range(20):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        free_unused()
        if not os.path.exists(path):
            break
        time.sleep(0.2)
    assert not os.path.exists(path)


def test_nulls_and_repeats_in_every_column(spark):
    rows = [(None,) * 5] * 3 + [(1, "the same text of some words", "en", "s", 3)] * 3 + [(None, "another text of words", None, None, None)] * 2 + [(2, "der die das und nicht", "de", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""))
    assert docs.count() > 0 and docs.where("length > 2048").count() == 0
