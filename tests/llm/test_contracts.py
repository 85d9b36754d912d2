"""Every registered query of the subpackage: with its statement, or by brute force on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from oracle import DATA, agree
from terraspark.llm import language, media, packing, queries, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_its_statement(spark, name):
    agree(spark, name)


def test_sharding_contract(spark, documents):
    rows = entry.queries()["op4_sharding"](spark, DATA).collect()
    loads, slots, together = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (documents[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 16
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        together[documents[r.doc_id].text].add(r.shard)
    assert sorted(r.doc_id for r in rows) == sorted(documents) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in together.values())
    # Longest first: no shard is above the mean by more than the largest group.
    groups = Counter()
    for r in rows:
        groups[documents[r.doc_id].text] += r.size
    assert max(loads.values()) <= sum(loads.values()) / 16 + max(groups.values())


def test_packing_contract(spark, documents):
    rows = entry.queries()["op7_best_fit_packing"](spark, DATA).collect()
    words, bins = Counter(), defaultdict(list)
    for r in rows:
        words[r.doc_id] += r.n_words
        bins[r.bin_id].append(r)
    assert words == Counter({i: len(WORD.findall((d.text or "").encode())) for i, d in documents.items()})
    for pieces in bins.values():
        used = sum(p.n_words for p in pieces)
        assert pieces[0].bin_words == used and pieces[0].bin_length == next(c for c in packing.LENGTHS if c >= used)


def test_media_contract(spark, documents):
    for r in entry.queries()["op9_avi_media"](spark, DATA).collect():
        raw = (documents[r.doc_id].text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        avi = media.encode(np.frombuffer(payload, np.uint8))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(avi), hashlib.sha256(avi).hexdigest())
        blocks = -(-len(payload) // 63)
        wide = min(16, blocks)
        high = min(16, -(-blocks // wide))
        frames = -(-len(payload) // (wide * high * 63))
        assert r.feature.startswith(f"{8 * wide}x{8 * high} frames={frames} ms={frames * 40} ") and r.n_clips >= 1


def _plain_ftrl(texts, labels, alpha=8.0, beta=1.0, l1=4.0, l2=0.01, epochs=12):
    """The same learner on named features in dictionaries."""
    names = []
    for t in texts:
        w = re.findall(rb"(?:[A-Za-z0-9']|[\x80-\xff])+", (t or "").encode().lower())
        names.append({("w", x) for x in w} | {("b", *x) for x in zip(w, w[1:], strict=False)} | {("s", *x) for x in zip(w, w[2:], strict=False)} | {"bias"})
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(texts)).tolist():
            ws = {f: weight(f) for f in names[i]}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(ws.values()))))) - labels[i]
            for f, w in ws.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w
                n[f] += g * g
    return lambda t, k: 1 / (1 + math.exp(-sum(map(weight, names[k]))))


def test_toxicity_contract(spark, documents, monkeypatch):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.toxic is not None and r.doc_id in documents}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    learned = sorted(i for i in labels if not held(i))
    texts, wanted = [documents[i].text for i in learned], [labels[i] for i in learned]
    plain = _plain_ftrl(texts, wanted)
    scores = np.array([plain(None, k) for k in range(len(learned))])
    got = {r.doc_id: r for r in entry.queries()["op1_toxicity"](spark, DATA).collect()}
    assert got.keys() == documents.keys()
    assert all(r.held_out == held(i) and r.predicted == int(r.score >= toxicity.THRESHOLD) and 0 <= r.score <= 1 for i, r in got.items())
    # A few of the query's hashed slots collide; with more slots none do, and the two learners agree exactly.
    assert np.abs(scores - [got[i].score for i in learned]).max() < 0.02
    monkeypatch.setattr(toxicity, "SLOTS_BITS", 25)
    model = toxicity.fit(texts, np.array(wanted, dtype=float))
    assert np.abs(scores - model.score(pa.array(texts, pa.large_string()))).max() < 1e-9


def test_quality_contract(spark, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = entry.queries()["op5_quality"](spark, DATA).collect()
    assert Counter(r.doc_id for r in got) == Counter(documents.keys())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    right = [r.predicted == labels[r.doc_id] for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean(right) >= 0.9


def test_language_contract(spark, documents):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = sorted(i for i, d in documents.items() if not held(i) and d.lang is not None)
    model = language.fit([documents[i].text for i in learned], [documents[i].lang for i in learned])
    got = {r.doc_id: r for r in entry.queries()["op6_language_id"](spark, DATA).collect()}
    for i, d in documents.items():
        names, score = model.predict([d.text])
        assert (got[i].lang_pred, got[i].held_out) == (names[0], held(i)) and abs(got[i].score - score[0]) < 1e-5
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))


def test_marks_alone_are_no_word():
    model = language.fit(["abc abc", "déf déf"], ["xx", "yy"])
    names, score = model.predict(["́̀", " ́ 1", "\U0002ffff", "é", None, "7"])
    assert names[:3] == ["und"] * 3 and names[3] != "und" and names[4:] == ["und"] * 2 and score[0] == 0


def test_frames_have_the_contracts_columns(spark):
    want = {"op4_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op9_avi_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature"}
    for name, columns in want.items():
        assert isinstance(entry.queries()[name](spark, DATA).limit(0).toPandas(), pd.DataFrame)
        assert set(columns.split()) <= set(entry.queries()[name](spark, DATA).columns)
