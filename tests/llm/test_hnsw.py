"""Embedding near duplicates row by row against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from resgraph.llm import common, hnsw


def brute(rows: list[tuple[int, list | None]]) -> list[tuple]:
    sound = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.linalg.norm(v) if ok else None for (_, v), ok in zip(rows, sound, strict=True)]
    near = [[i != j and sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95 for j in range(len(rows))] for i in range(len(rows))]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near[i][j] and top[i] != top[j]:
                old = top[i]
                top = [top[j] if t == old else t for t in top]
    least: dict[int, int] = {}
    for (i, _), t in zip(rows, top, strict=True):
        least[t] = min(i, least.get(t, i))
    return sorted((i, sum(n), least[t]) for (i, _), n, t in zip(rows, near, top, strict=True))


@pytest.mark.parametrize("part", [200_000, 40])
def test_rows_equal_brute_force(spark, monkeypatch, part):
    common.prepare(spark)
    monkeypatch.setattr(hnsw, "PART_ROWS", part)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 8))
    near = np.concatenate([base + 0.1 * rng.standard_normal((12, 8)) for _ in range(12)])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(near)]
    rows += [(500, [1.0, 0.0]), (500, [1.0, 0.01]), (501, [0.0, 1.0]), (502, [0.0, 2.0]), (3, rows[3][1]), (3, rows[40][1])]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None]), (904, [])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, component_id string")
    got = sorted((r.id, r.n_links, r.component_id) for r in hnsw.near_vectors(table, shards=2).collect())
    assert got == brute(rows)
    assert hnsw.near_vectors(table.where("false")).count() == 0


def test_large_group_of_near_copies():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal(16) + 0.01 * rng.standard_normal((6000, 16)), rng.standard_normal((500, 16))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    some = np.r_[0:40, 6000:6040]
    found = sum(len(a) for a, _ in hnsw.query(graph, x[some], some, 0.95))
    truth = int((x[some] @ x.T >= 0.95 - 1e-4).sum())
    assert found >= 0.98 * truth


def test_brute_force_where_no_beam_suffices(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((5, 8)), 20, axis=0) + 0.001 * rng.standard_normal((100, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.Graph(x)
    for layer in graph.layers:
        layer[:] = -1  # nodes that no link leads to
    pairs = {(int(i), int(j)) for a, b in hnsw.query(graph, x, np.arange(100), 0.95) for i, j in zip(a, b, strict=True)}
    assert pairs == set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.95 - 1e-4)), strict=True))
