"""Stages of the corpus pipeline on the smallest tables, each against its own input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from terraspark.llm import tables
from test_llm_operators import brute_components, brute_repeats, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in P.STAGES:
        docs = tables.written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    for df in stages[:-1]:
        assert list(df.columns) == P.COLUMNS


def test_quality_keeps_good_and_drops_bad(spark, stages):
    kept = set(stages[1].doc_id)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).toPandas()
    right = [(r.doc_id in kept) == (r.quality == 1) for r in labels.itertuples() if r.doc_id in set(stages[0].doc_id)]
    assert sum(right) >= 0.9 * len(right)


def test_one_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    components = brute_components(dict(zip(before.doc_id, before.text, strict=True)))
    assert set(after.doc_id) == {i for i, (_, c) in components.items() if i == c}


def test_repeats_go_and_others_stay(stages):
    before = dict(zip(stages[2].doc_id, stages[2].text, strict=True))
    want = brute_repeats(before)
    for r in stages[3].itertuples():
        _, gone, kept = want[r.doc_id]
        assert (r.text or "").encode() == (kept if gone else (before[r.doc_id] or "").encode())
        assert r.n_chars == len(r.text or "")
    assert sorted(stages[3].doc_id) == sorted(before)


def test_mix_has_the_wanted_words(stages):
    words = lambda df: sum(len(words_of(t)) for t in df.text)
    longest = max(len(words_of(t)) for t in stages[3].text)
    assert abs(words(stages[4]) - 1.5 * words(stages[3])) <= longest * stages[3].source.nunique() / 2
    assert stages[4].groupby("doc_id").size().max() <= 2


def test_every_word_is_packed(stages):
    assert stages[5].n_words.sum() == sum(len(words_of(t)) for t in stages[4].text)
    assert (stages[5].groupby("bin_id").n_words.sum() <= stages[5].groupby("bin_id").bin_length.first()).all()


def test_run_equals_the_stages(spark, stages):
    got = P.run(spark, SF).toPandas()
    assert got.n_words.sum() == stages[5].n_words.sum() and len(got) == len(stages[5]) and list(got.columns) == list(stages[5].columns)


HOSTILE = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, kept_text string, reps int"


def test_stages_on_hostile_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    a, passage = prose(60), prose(40)
    texts = [(1, a), (1, a), (1, a + " more"), (2, a), (3, None), (3, ""), (4, " \n"), (None, prose(30)), (None, None), (5, prose(20000)), (6, passage + " " + prose(9)), (7, prose(9) + " " + passage), (8, a), (8, prose(25)), (9, "x")]
    rows = [(i, t, "en", None if k % 4 == 0 else "s", 0, 0.5, 1, "t", 9) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, HOSTILE)
    spark.createDataFrame([(i, 1, 0) for i in range(1, 10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    kept = P.keep_quality(spark, docs, sf).collect()
    assert len(kept) == len(rows) and kept[0].asDict().keys() == set(P.COLUMNS)
    one = P.drop_near_duplicates(spark, docs, sf).collect()
    # Of the group of ids 1, 2 and 8 one row stays; 8 stays with its other text; rows without words and null ids stay.
    assert Counter(r.doc_id for r in one) == Counter([1, 3, 3, 4, None, None, 5, 6, 7, 8, 9])
    assert [len(r.text.split()) for r in one if r.doc_id == 8] == [25]
    less = P.drop_repeated_passages(spark, docs, sf).collect()
    assert len(less) == len(rows) and [r.n_chars for r in less if r.doc_id == 2] == [0]
    assert sorted(len((r.text or "").split()) for r in less if r.doc_id == 7) == [9]
    mixed = P.mix_sources(spark, docs, sf).collect()
    words = lambda rs: sum(len((r.text or "").split()) for r in rs)
    assert abs(words(mixed) - 1.5 * words(docs.collect())) <= 20000
    packed = P.pack_sequences(spark, docs, sf).collect()
    assert sum(r.n_words for r in packed) == words(docs.collect()) and {None} <= {r.doc_id for r in packed}
    none = docs.where("false")
    for _, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0
    assert P.drop_near_duplicates(spark, docs.where("doc_id in (2, 5, 9) and doc_id is not null"), sf).count() == 3
