"""Each operator on hostile rows, against brute force or an exact round trip."""

import hashlib
import math
import os
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


from terraspark.llm import bitsliced, components, language, media, mixing, near_dedup, packing, quality, samples, sharding, substring_dedup, tables, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, size int, shard int, score double, target int"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage, base = prose(rng, 60), prose(rng, 120)
    out = []

    def add(text, lang="en", source="a"):
        out.append((len(out), text, lang, source))

    for _ in range(30):
        add(prose(rng, rng.randrange(1, 200)), rng.choice(["en", "de"]), rng.choice(["a", "b", None]))
    for i in range(12):
        words = base.split()
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        add(" ".join(words))
    for _ in range(8):
        add(f"{prose(rng, 30)} {passage}\t{prose(rng, 10)}")
    add(base), add(base), add(base.upper())
    add(None), add(""), add(" \n\t "), add("one two"), add("ONE  two"), add("a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a")
    add("é ü ñ 漢字  x", None, None), add("!!! 123", None, "c"), add(prose(rng, 30_000), "en", "c")
    return out


@pytest.fixture(scope="module")
def documents(spark, rows):
    df = spark.createDataFrame([(*r, None, 7, 7, 7, 0.5, 7) for r in rows], SCHEMA)
    # A repeated row.
    return df.union(df.where("doc_id = 3"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


# --- near duplicates


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = words_of(t, True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(documents, rows, empty):
    want = brute_components({r[0]: r[1] for r in rows})
    got = near_dedup.near_duplicates(documents).collect()
    assert Counter(r.doc_id for r in got) == Counter([r[0] for r in rows] + [3])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_large_nodes_branch_and_lose_nothing(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 80, 10**6).split()
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    for small in ({"NODE_MAX": 24}, {"NODE_MAX": 16, "DEPTH_MAX": 2}):
        for k, v in small.items():
            monkeypatch.setattr(near_dedup, k, v)
        got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_several_texts_under_one_key(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 3)
    rng = random.Random(21)
    a, b = prose(rng, 40), prose(rng, 40)
    near = " ".join(a.split()[:-1] + ["other"])
    rows = [(5, a), (5, b), (9, b), (11, a), (3, near), (5, a), (12, prose(rng, 9)), (7, None), (7, "x"), (8, ""), (None, a)] + [(20 + i, a) for i in range(5)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # By brute force over rows, each a document of its own; their order makes the smallest key the smallest number.
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    want = brute_components({i: t for i, (_, t) in enumerate(known)})
    assert Counter(tuple(r) for r in got) == Counter((known[i][0], n, known[c][0], known[i][0] == known[c][0]) for i, (n, c) in want.items())
    assert {r.component_id for r in got if r.doc_id in (9, 11)} == {5, 3}


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 4)
    links = [(0, i) for i in range(1, 12)] + [(11, 30), (30, 31), (50, 51)]
    got = {r.id: r.component for r in components.smallest_reachable(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(1, 12), 30, 31]} | {51: 50}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 100), (7, 7)]
    got = {r.id: r.component for r in components.smallest_reachable(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100}


# --- substring dedup


def brute_repeats(texts):
    seen = {}
    for i in sorted(texts):
        w = words_of(texts[i])
        for s in range(len(w) - 19):
            seen.setdefault(tuple(w[s : s + 20]), (i, s))
    out = {}
    for i, t in texts.items():
        w = words_of(t)
        gone = {k for s in range(len(w) - 19) if seen[tuple(w[s : s + 20])] != (i, s) for k in range(s, s + 20)}
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring_dedup(documents, rows, empty):
    want = brute_repeats({r[0]: r[1] for r in rows})
    got = substring_dedup.remove_repeats(documents).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, gone)
        assert (r.kept_text is None) == (gone == 0)
        if gone:
            assert r.kept_text.encode() == kept
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_cover_brings_any_two_starts_together():
    for a in range(13):
        for b in range(13):
            assert any((a + s) % 13 in substring_dedup.COVER and (b + s) % 13 in substring_dedup.COVER for s in range(13))


# --- mixing


def test_mix(documents, rows, empty):
    got = mixing.mix(documents).select("doc_id", "source", "text", "source_size", "target", "reps").collect()
    assert len(got) == len(rows) + 1
    by = defaultdict(list)
    for r in got:
        by[r.source].append((len(words_of(r.text)), r.reps, r.target, r.source_size))
        assert 0 <= r.reps <= 2
    total = sum(x[0] for v in by.values() for x in v)
    for source, v in by.items():
        size, target = sum(x[0] for x in v), v[0][2]
        assert v[0][3] == size and target <= 2 * size + 1e-9, source
        assert abs(sum(x[0] * x[1] for x in v) - target) <= max(x[0] for x in v)
    targets = sum(v[0][2] for v in by.values())
    assert abs(targets - 1.5 * total) < 1e-6 * total
    again = mixing.mix(documents.repartition(5)).select("doc_id", "reps").collect()
    assert sorted((r.doc_id, r.reps) for r in got) == sorted((r.doc_id, r.reps) for r in again)
    assert mixing.mix(empty).count() == 0


def test_many_sources_take_the_other_way(spark, monkeypatch):
    rng = random.Random(31)
    rows = [(i, rng.choice([None, *"abcdefghij"]), prose(rng, rng.randrange(0, 30))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted(tuple(r) for r in mixing.mix(df).select("doc_id", "source_size", F.round("target", 6), "reps").collect())
    monkeypatch.setattr(mixing, "SOURCES_MOST", 2), monkeypatch.setattr(tables, "HOT_ROWS", 20)
    plain = tables.running
    monkeypatch.setattr(tables, "running", lambda df, order, sums: plain(df, order, sums, per_range=3))
    assert sorted(tuple(r) for r in mixing.mix(df).select("doc_id", "source_size", F.round("target", 6), "reps").collect()) == want


def test_water_fill_reshares(spark):
    df = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 1000, 1.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(df, 1.5, 2.0).collect()}
    assert got["a"] == 20 and got["b"] == 200 and abs(got["c"] - (1.5 * 1110 - 220)) < 1e-9


# --- sharding


def test_sharding(documents, rows, empty):
    got = sharding.shard(documents).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows) + 1
    together = defaultdict(set)
    slots = defaultdict(list)
    for r in got:
        t = texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 1
        together[t].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in together.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(empty).count() == 0


def test_longest_first_is_within_the_bound():
    rng = random.Random(1)
    units = [(rng.randrange(1, 1000), str(i)) for i in range(500)]
    loads = Counter()
    for (size, name), shard in ((u, sharding.longest_first(units, 16)[u[1]]) for u in units):
        loads[shard] += size
    assert max(loads.values()) - min(loads.values()) <= min(s for s, _ in units) + 20


# --- packing


def test_packing(documents, rows, empty):
    got = packing.pack(documents, lengths=(64, 128, 256)).collect()
    texts = {r[0]: len(words_of(r[1])) for r in rows}
    copies = Counter([r[0] for r in rows] + [3])
    words, bins = Counter(), defaultdict(list)
    for r in got:
        words[r.doc_id] += r.n_words
        bins[r.bin_id].append(r)
    assert words == Counter({i: n * copies[i] for i, n in texts.items()})
    for pieces in bins.values():
        used = sum(p.n_words for p in pieces)
        assert used == pieces[0].bin_words <= pieces[0].bin_length
        assert pieces[0].bin_length == min(x for x in (64, 128, 256) if x >= used)
        spans = sorted((p.bin_offset, p.n_words) for p in pieces if p.n_words)
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert packing.pack(empty).count() == 0


def _cheapest(sizes, lengths, price):
    """The least cost of any partition of the sizes into bins."""
    best = [float("inf")]

    def go(i, loads):
        now = sum(price(min(c for c in lengths if c >= x)) for x in loads)
        if now >= best[0]:
            return
        if i == len(sizes):
            best[0] = now
            return
        for k in range(len(loads)):
            if loads[k] + sizes[i] <= lengths[-1]:
                go(i + 1, [*loads[:k], loads[k] + sizes[i], *loads[k + 1 :]])
        go(i + 1, [*loads, sizes[i]])

    go(0, [])
    return best[0]


def test_best_fit_chooses_lengths_jointly():
    rng = random.Random(12)
    ratios = []
    for lengths, attention in (((5, 7, 12), None), ((8, 16, 32), 32.0), ((6, 10, 25), 40.0)):
        price = lambda n: float(packing.cost(n, 1, attention))
        for _ in range(40):
            sizes = [rng.randrange(1, lengths[-1] + 1) for _ in range(rng.randrange(1, 8))]
            bins, offsets, final = packing.best_fit(sizes, lengths, 1, attention)
            loads = np.bincount(bins, weights=sizes)
            assert (loads <= final).all() and set(final.tolist()) <= set(lengths)
            ratios.append(sum(map(price, final.tolist())) / _cheapest(sizes, lengths, price))
    assert min(ratios) > 1 - 1e-9 and np.mean(ratios) < 1.01 and max(ratios) < 1.25


def test_a_mix_of_lengths_is_opened_where_it_is_cheaper():
    sizes = np.concatenate([np.full(300, 500), np.full(100, 2000), np.random.default_rng(5).integers(3000, 8000, 100)])
    total = lambda final: packing.cost(final).sum()
    _, _, mixed = packing.best_fit(sizes)
    assert len(set(mixed.tolist())) >= 3
    assert total(mixed) <= total(packing.best_fit(sizes, (8192,))[2])
    for c in packing.LENGTHS:
        opens = [next(x for x in packing.LENGTHS if x >= max(n, c) or x == 8192) for n in range(8193)]
        used = packing._place(sorted(sizes.tolist(), reverse=True), opens)[3]
        assert total(mixed) <= total(np.array([next(x for x in packing.LENGTHS if x >= u) for u in used]))


def test_packing_null_ids(spark):
    rows = [(None, "a b c"), (None, "d"), (2**60 + 1, "e f"), (1, None), (None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), lengths=(4, 8)).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len(words_of(t))) for i, t in rows)


def test_best_fit_wastes_little():
    sizes = np.random.default_rng(3).integers(1, 3000, 4000)
    _, _, final = packing.best_fit(sizes)
    assert sizes.sum() / final.sum() > 0.97


# --- classifiers


def test_toxicity_learns_words(spark, empty):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randrange(5, 80), 50).split()
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["Vile,", "nasty", "RUDE!"])
        rows.append((i, " ".join(w))), labels.append((i, int(toxic)))
    rows += [(600, None), (601, ""), (602, "vile " * 5000)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (600, 1), (9999, 1), (5, None)], "doc_id long, toxic int")
    fold = samples.remainder("doc_id", 3)
    got = {r.doc_id: r for r in toxicity.score(docs, lab, fold != 1).withColumn("fold", fold).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].score >= 0.7) == bool(t) for i, t in labels if got[i].fold == 1]
    assert np.mean(held) > 0.97
    assert got[600].score == got[601].score
    assert toxicity.score(empty, lab, fold != 1).count() == 0
    assert toxicity.score(docs, lab.where("false"), fold != 1).first().score == 0.5


def test_weights_are_sparse():
    rng = random.Random(4)
    texts = [prose(rng, 40, 50) + (" bad" if i % 2 else "") for i in range(200)]
    model = toxicity.fit(texts, np.arange(200) % 2.0)
    assert 0 < len(model.slots) < 2000 and model.score(pa.array(["bad", "w1 w2"]))[0] > 0.9


def test_quality_learns_forms(spark, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, rng.randrange(20, 80)).split()
        good = i % 3 != 0
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w))), labels.append((i, int(good)))
    rows += [(400, None), (401, "")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    fold = samples.remainder("doc_id", 5)
    got = {r.doc_id: r for r in quality.score(docs, lab, fold != 0).withColumn("fold", fold).collect()}
    held = [(got[i].score >= 0.3) == bool(q) for i, q in labels if got[i].fold == 0]
    assert np.mean(held) > 0.97 and got[400].score == got[401].score and 0 <= got[400].score <= 1
    assert quality.score(empty, lab, fold != 0).count() == 0


def test_quality_learns_vocabulary(spark):
    rng = random.Random(8)
    # Equal layout: five lower-case letters a word, the two vocabularies drawn from one alphabet.
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(600)]
    rows, labels = [], []
    for i in range(400):
        rows.append((i, " ".join(rng.choices(vocabulary[i % 2 :: 2], k=rng.randrange(20, 80))))), labels.append((i, i % 2))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    fold = samples.remainder("doc_id", 5)
    got = {r.doc_id: r for r in quality.score(docs, lab, fold != 0).withColumn("fold", fold).collect()}
    held = [(got[i].score >= 0.5) == bool(q) for i, q in labels if got[i].fold == 0]
    assert np.mean(held) > 0.97


def test_quality_knows_words_by_whole_hash():
    rng = random.Random(9)
    texts = [prose(rng, 2000, 10**6) for _ in range(20)]
    model = quality.fit(texts, np.arange(20) % 2.0)
    words = {w for t in texts for w in t.split()}
    assert len(model.known) == len(words) > 1 << 15
    hashes, forms, _ = quality.tokens(*quality.K.texts_of(pa.array(["w1 never2seen", "w2 never3seen"])))
    assert model.rows_of(hashes, forms)[[1, 3]].tolist() == (len(words) + forms[[1, 3]]).tolist()


def test_sample_survives_a_repeated_key(spark):
    rows = [(0, f"copy {i:03d}") for i in range(400)] + [(i, f"text {i}") for i in range(1, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    lab = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    got = samples.labelled(docs, lab, "quality", samples.F.lit(True), 30)
    assert got.doc_id.tolist() == list(range(30)) and got.label.tolist() == [i % 2 for i in range(30)]
    assert got.text.tolist() == ["copy 399", *(f"text {i}" for i in range(1, 30))]
    assert len(samples.labelled(docs, lab, "quality", samples.F.lit(True), 7)) == 7


def test_language(spark, empty):
    rng = random.Random(7)
    parts = {"xx": ["the", "ing", "tion", "of", "er"], "yy": ["öß", "sch", "ung", "der", "ei"]}
    rows = [(i, " ".join("".join(rng.choices(parts[l], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))), l) for i in range(300) for l in [("xx", "yy")[i % 2]]]
    rows += [(300, None, "xx"), (301, "123 !?", "yy"), (302, "the of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = samples.remainder("doc_id", 4)
    got = {r.doc_id: r for r in language.identify(docs, fold != 2).withColumn("fold", fold).collect()}
    assert np.mean([got[i].lang_pred == l for i, _, l in rows[:300] if got[i].fold == 2]) > 0.97
    assert (got[300].lang_pred, got[301].lang_pred, got[302].lang_pred) == ("und", "und", "xx")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(empty, fold != 2).count() == 0


# --- top-k


def test_top_k(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 9)], 1) for i in range(130)]
    rows += [(130 + i, [0.5] * 9, 1) for i in range(30)]  # ties
    rows += [(200, None, 1), (220, [0.1, None], 1), (240, [float("nan")] * 9, 1), (260, [float("inf")] * 9, 1), (280, [], 1), (300, [1000.5, -2.0], 1), (None, [1.0], 1), (7, rows[7][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in sorted(bitsliced.top_k(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)
            good[i] = np.pad(q, (0, 9 - len(q)))
    want = {q: sorted(((i, int(good[q] @ v)) for i, v in good.items() if i != q), key=lambda x: (-x[1], x[0]))[:20] for q in good if q % 20 == 0}
    assert got == want
    assert bitsliced.top_k(df.where("false")).count() == 0


def test_large_vectors_and_repeated_keys(spark):
    rows = [(20, [3e6, 1.0]), (20, [-0.5, 2.0]), (1, [2.5e6, -1.0]), (1, [0.25, 0.25]), (1, [0.25, 0.25]), (2, [-3e6, 0.0]), (3, [1e-300, -1e-300]), (40, [1.0]), (60, [])]
    got = defaultdict(list)
    for r in bitsliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((-r.score, r.vec_id))
    distinct = [(i, [math.floor(64 * x) for x in v]) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows)]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    want = defaultdict(list)
    for n, (i, v) in enumerate(distinct):
        if i % 20 == 0:
            want[i] += [(-dot(v, w), j) for m, (j, w) in enumerate(distinct) if m != n]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    far = spark.createDataFrame([(20, [1e300]), (21, [1e308]), (22, [-1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        bitsliced.top_k(far).collect()


def test_blocks_and_groups_agree(spark, monkeypatch):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 0.2, 5)]) for i in range(300)], "vec_id long, embedding array<float>")
    one = sorted(bitsliced.top_k(df).collect())
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 50)
    monkeypatch.setattr(bitsliced, "QUERY_GROUP", 4)
    assert sorted(bitsliced.top_k(df).collect()) == one


# --- media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 4032, 40_000])
def test_payload_round_trip(n):
    payload = media.padded(np.random.default_rng(n).integers(0, 256, n).astype(np.uint8))
    avi = media.encode(payload)
    assert avi == media.encode(payload)
    assert media.payload_of(*media.read(avi)) == payload.tobytes()


def test_general_decoder_agrees_with_the_array_path():
    payload = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    frame = media.jpeg_frames(payload, 4, 2)[0]
    fast = media.decode(frame)
    # A restart interval longer than the frame changes nothing but the path.
    slow = media.decode(frame.replace(b"\xff\xda", b"\xff\xdd\x00\x04\x00\xff\xff\xda", 1))
    assert (fast.coefficients[0] == slow.coefficients[0]).all()


def _flat_frame(level, blocks=4):
    """A grey frame of one DC level, coded with a four-bit table."""
    size = int(abs(level)).bit_length()
    value = level if level > 0 else level + (1 << size) - 1
    bits = f"{size:04b}" + (f"{value:0{size}b}" if size else "") + "0" + "00000" * (blocks - 1)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    dht = bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)]) + bytes([0x10, 1, *[0] * 15, 0])
    seg = media._segment
    return (
        b"\xff\xd8" + seg(0xDB, bytes([0] + [8] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 16, 16, 1) + bytes([1, 0x22, 0])) + seg(0xC4, dht) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    )


def test_shots_and_clips(spark):
    frames = [_flat_frame(x) for x in [40] * 6 + [-60] * 5 + [100] * 4]
    assert abs(float(media.decode(frames[0]).luma().mean()) - (128 + 40)) < 1
    avi = media.avi(frames, 16, 16, 0)
    broken = avi[: len(avi) // 2]
    df = spark.createDataFrame([(1, avi, 5), (2, None, 5), (3, b"RIFF", 5), (4, b"", 5), (1, avi, 5), (5, bytearray(broken), 5)], "media_id long, avi binary, clip int")
    got = [r for r in media.clips(df).collect()]
    mine = sorted((r.clip, r.first_frame, r.n_frames, r.start_ms, r.end_ms) for r in got if r.media_id == 1)
    assert mine == sorted([(0, 0, 6, 0, 240), (1, 6, 5, 240, 440), (2, 11, 4, 440, 600)] * 2)
    assert {r.media_id for r in got} <= {1, 5}
    assert media.clips(df.where("false")).count() == 0


def _coded(rng, wide, high, tables=True):
    """A frame of random coefficients, coded with the standard tables by a plain coder, and its coefficients."""
    codes = {}
    for which in (0x00, 0x10):
        counts, symbols = media.STANDARD[which]
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                codes[which, symbols[at]] = f"{code:0{length}b}"
                code, at = code + 1, at + 1
            code <<= 1
    size = lambda v: abs(v).bit_length()
    value = lambda v: f"{v if v > 0 else v + (1 << size(v)) - 1:0{size(v)}b}" if v else ""
    bits, before, want = [], 0, np.zeros((high, wide, 64), int)
    for y in range(high):
        for x in range(wide):
            want[y, x, 0] = rng.randrange(-500, 500)
            for k in range(1, 64):
                want[y, x, k] = rng.choice([0, 0, 1, -3, 30, -200]) if rng.random() < 0.7 else 0
            d, before = int(want[y, x, 0]) - before, int(want[y, x, 0])
            bits.append(codes[0, size(d)] + value(d))
            run = 0
            last = max(np.flatnonzero(want[y, x, 1:]), default=-1) + 1
            for v in want[y, x, 1 : last + 1].tolist():
                if not v:
                    run += 1
                    continue
                bits.append(codes[0x10, 0xF0] * (run // 16) + codes[0x10, (run % 16) << 4 | size(v)] + value(v))
                run = 0
            if last < 63:
                bits.append(codes[0x10, 0])
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    scan = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = media._segment
    dht = b"".join(seg(0xC4, bytes([w]) + media.STANDARD[w][0] + media.STANDARD[w][1]) for w in (0x00, 0x10)) if tables else b""
    head = seg(0xDB, bytes([0] + [1] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + head + dht + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9", want


def test_standard_tables_are_implied():
    for which in (0x10, 0x11):
        counts, symbols = media.STANDARD[which]
        assert sum(counts) == len(symbols) == len(set(symbols)) == 162
    frame, want = _coded(random.Random(3), 5, 4)
    bare, _ = _coded(random.Random(3), 5, 4, tables=False)
    assert (media.decode(frame).coefficients[0] == want).all() and (media.decode(bare).coefficients[0] == want).all()
    with pytest.raises(ValueError):
        media.decode(frame[: len(frame) // 2])


def test_a_large_frame_takes_linear_time():
    import time

    frame, want = _coded(random.Random(4), 130, 170)
    begin = time.perf_counter()
    got = media.decode(frame)
    assert len(frame) > 1_000_000 and (got.coefficients[0] == want).all() and time.perf_counter() - begin < 30


def test_bad_frames_groups_and_segments(spark):
    frames = [_flat_frame(x) for x in [40] * 4 + [-60] * 4]
    frames[0], frames[2], frames[6] = b"junk", b"", b"\xff\xd8\xff"
    avi = media.avi(frames, 16, 16, 0)
    df = spark.createDataFrame([(1, avi)], "media_id long, avi binary")
    clips = lambda x: sorted((r.clip, r.first_frame, r.n_frames) for r in media.clips(x).collect())
    assert clips(df) == [(0, 0, 4), (1, 4, 4)]
    # The same frames in a rec group, and in a second segment.
    good = [_flat_frame(40), _flat_frame(-60)]
    whole = media.avi(good, 16, 16, 0)
    at = whole.index(b"LIST", whole.index(b"INFO"))
    group = media._chunk(b"LIST", b"rec " + b"".join(media._chunk(b"00dc", f) for f in good))
    more = media._chunk(b"RIFF", b"AVIX" + media._chunk(b"LIST", b"movi" + media._chunk(b"00dc", _flat_frame(90))))
    body = b"AVI " + whole[12:at] + media._chunk(b"LIST", b"movi" + group)
    movie = media.parse(media._chunk(b"RIFF", body) + more)
    assert len(movie.frames) == 3
    assert [(whole + b"").count(f) for f in good] == [1, 1]


def test_index_is_optional():
    frames = [_flat_frame(10), _flat_frame(20)]
    avi = media.avi(frames, 16, 16, 0)
    movie = media.parse(avi.replace(b"idx1", b"junk"))
    assert [avi[a : a + n] for a, n in movie.frames] == frames
    assert media.parse(avi).frames == movie.frames


def test_texts_as_media(documents, rows, empty):
    def digest(key, n, avi):
        return {"doc_id": key, "n": n, "sha": hashlib.sha256(media.payload_of(*media.read(avi))).hexdigest()}

    got = media.store_texts(documents, digest, "doc_id long, n long, sha string").collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        raw = texts[r.doc_id]
        assert r.n == len(raw) and r.sha == hashlib.sha256(raw + bytes(-len(raw) % 64 if raw else 64)).hexdigest()
    assert len(got) == len(rows) + 1
    assert media.store_texts(empty, digest, "doc_id long, n long, sha string").count() == 0


def test_clean_deletes_what_was_written(spark):
    df = tables.written(spark.range(3), "x")
    assert df.count() == 3 and tables.clean(spark) > 0 and tables.clean(spark) == 0
    path = df.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path)


def test_null_fold(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(samples.remainder("doc_id", 3).alias("x")).first().x == 0
