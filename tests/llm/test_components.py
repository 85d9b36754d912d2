"""Components by forests of bounded parts: the same groups as brute force, in few jobs."""

import numpy as np
import pytest

from terraspark.llm import components, tables


def _brute(links):
    low = {i: i for x in links for i in x}
    while any(low[u] != low[v] for u, v in links):
        for u, v in links:
            low[u] = low[v] = min(low[u], low[v])
    return {i: c for i, c in low.items() if i != c}


def _links(seed, ids, n):
    rng = np.random.default_rng(seed)
    return [tuple(map(int, x)) for x in rng.integers(0, ids, (n, 2)) * 3 - 50]


@pytest.mark.parametrize("links", [[(9, k) for k in range(9)], [(k, k + 1) for k in range(300)], [(k, 300 - k) for k in range(300)], [(-5, -9), (-9, -5), (4, 4)], [], *[_links(s, 400, n) for s, n in enumerate((50, 200, 300, 900))]])
def test_forest(links):
    u, v = (np.array([x[k] for x in links], np.int64) for k in range(2))
    i, low = components.forest(u, v)
    assert dict(zip(i.tolist(), low.tolist(), strict=True)) == _brute(links) and len(set(i.tolist())) == len(i)


@pytest.mark.parametrize("part", [5, 64, 100_000])
def test_parts_give_the_same_components(spark, monkeypatch, part):
    monkeypatch.setattr(components, "PART_LINKS", part)
    monkeypatch.setattr(tables, "HOT_ROWS", 4)
    links = _links(7, 300, 160) + [(5000, 5000 + k) for k in range(40)] + [(k, k + 1) for k in range(6000, 6030)] + [(8000, 8000)]
    got = components.smallest_reachable(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.id: r.component for r in got} == _brute(links) and len({r.id for r in got}) == len(got)


def test_links_of_one_part_take_few_jobs(spark):
    """Each job leaves its plan, stages and tasks in the driver's memory; by steps alone this took over thirty."""
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "u long, v long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert components.smallest_reachable(links).count() == 200
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 6
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
