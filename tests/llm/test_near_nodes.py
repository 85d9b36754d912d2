"""The signature filter before whole sets are sent, against every pair of a node."""

import numpy as np
import pyarrow as pa
import pytest

from terraspark.llm import near_dedup as N


def _table(rng, nodes, members, bases, changed):
    rows = []
    for node in range(nodes):
        base = rng.integers(0, 16, (bases, N.VALUES))
        for _ in range(int(rng.integers(2, members))):
            sig = base[rng.integers(bases)].copy()
            at = rng.permutation(N.VALUES)[: rng.integers(changed)]
            sig[at] = rng.integers(0, 16, len(at))
            packed = (sig[0::2] << 4 | sig[1::2]).astype(np.uint8).tobytes()
            rows.append((node % 3, node, len(rows), int(rng.integers(0, 3)) if node % 2 else 0, int(rng.integers(0, 40)), int(rng.integers(60, 120)), packed))
    rows = [rows[k] for k in rng.permutation(len(rows))]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["path", "node", "id", "side", "component", "n_shingles", "sig"]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})


def _brute(table):
    sigs, rows = N._unpacked(table["sig"]), table.to_pylist()
    stay = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i == j or (a["path"], a["node"]) != (b["path"], b["node"]) or a["component"] == b["component"]:
                continue
            if a["side"] and a["side"] == b["side"]:
                continue
            if 4 * min(a["n_shingles"], b["n_shingles"]) < 3 * max(a["n_shingles"], b["n_shingles"]):
                continue
            if N._estimate((sigs[i] == sigs[j]).mean()) >= N.ESTIMATE_MIN:
                stay.add(a["id"])
    return stay


@pytest.mark.parametrize("seed", range(4))
def test_rows_with_a_partner_stay_and_no_others(seed):
    rng = np.random.default_rng(seed)
    table = _table(rng, 6, 150, 12 if seed % 2 else 60, 120)
    out = N._near_in_nodes(table)
    assert set(out["id"].to_pylist()) == _brute(table)
    for r in out.to_pylist():
        mine = [x for x in out.to_pylist() if (x["path"], x["node"]) == (r["path"], r["node"])]
        assert (r["n"], r["shingles"]) == (len(mine), sum(x["n_shingles"] for x in mine))


def test_no_rows_and_unlike_rows():
    empty = _table(np.random.default_rng(0), 0, 3, 1, 1)
    assert N._near_in_nodes(empty).num_rows == 0
    unlike = _table(np.random.default_rng(1), 3, 12, 1000, 1)
    assert set(N._near_in_nodes(unlike)["id"].to_pylist()) == _brute(unlike)
