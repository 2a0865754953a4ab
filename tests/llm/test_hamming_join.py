"""Near duplicates against brute force, with families in one task, in parts and in chunks."""

from __future__ import annotations

import random

import numpy as np
import pytest

from resgraph.llm import common, hamming_join


def brute(texts: dict[int, str | None], width: int, numer: int = 80, denom: int = 100) -> dict[int, int]:
    sets, top = {}, {i: i for i in texts}
    for i, t in texts.items():
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()

    def find(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and denom * both >= numer * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def family_texts(seed: int = 5) -> dict[int, str | None]:
    """Groups of copies of falling likeness, chains whose ends are unlike, a shared passage, and loners."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts: list[str | None] = [None, "", "  ", "one", "one", "One two"]
    for changes in (0, 1, 2, 3, 4, 6):
        base = [word() for _ in range(120)]
        for _ in range(18):
            own = base.copy()
            for _ in range(changes):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    chain = [word() for _ in range(150)]
    for _ in range(25):
        at = rng.randrange(len(chain))
        chain = [*chain[:at], word(), *chain[at + 1 :]]
        texts.append(" ".join(chain))
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(30)]) for _ in range(25)]
    texts += [" ".join(word() for _ in range(40)) for _ in range(30)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return dict(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("group", "weight"), [(4000, 2_000_000), (8, 2_000_000), (4000, 900), (2, 300)])
def test_equals_brute_force(spark, monkeypatch, group, weight):
    common.prepare(spark)
    monkeypatch.setattr(hamming_join, "GROUP", group)
    monkeypatch.setattr(hamming_join, "WEIGHT", weight)
    monkeypatch.setattr(hamming_join, "HUBS", 2)
    texts = family_texts()
    got = {r.id: r.component_id for r in hamming_join.near_duplicates(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), width=4).collect()}
    assert got == brute(texts, 4)


def test_repeated_rows_ids_and_names(spark):
    copy, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(7, copy, "x"), (7, copy, "x"), (3, copy + " end", "x"), (5, other, "x"), (5, copy, "x"), (9, other, "x"), (None, other, "x"), (11, "long " * 200_000, "x")]
    found = hamming_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string"), width=4)
    got = sorted((r.id if r.id is not None else -1, r.n_shingles, r.component_id) for r in found.collect())
    assert got == [(-1, 27, None), (3, 28, 3), (5, 27, 3), (5, 27, 5), (7, 27, 3), (7, 27, 3), (9, 27, 5), (11, 1, 11)]


def test_search_finds_a_spanning_forest():
    rng = np.random.default_rng(0)
    near = rng.random((60, 60)) < 0.02
    near |= near.T
    top = list(range(60))
    for x, y in hamming_join._search(60, lambda x, left: near[x, left]):
        assert near[x, y] and top[x] != top[y]  # an edge of the graph that joins two trees
        old = top[y]
        top = [top[x] if t == old else t for t in top]
    assert all(top[x] == top[y] for x, y in zip(*np.nonzero(near), strict=True))


def test_shared_keys_across_batches():
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 3, 4, 5, 5]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.int64()), pa.array(range(i, min(10, i + size)), pa.int64())], ["key", "node"]) for i in range(0, 10, size)]
        assert [n for b in hamming_join._shared(iter(batches)) for n in b.column(1).to_pylist()] == [0, 1, 3, 4, 5, 6, 8, 9]
