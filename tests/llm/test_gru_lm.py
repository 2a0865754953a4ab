"""The network's passes equal plain ones, and blocks do no work that isn't used."""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from resgraph.llm import blockdict, gru_lm

WORDS = ["a", "b", "é", "long", "zz"]


def _net(n: int, seed: int) -> gru_lm.Net:
    counts = [3 * n - i for i in range(n)]
    symbols = gru_lm.Symbols.of(list(zip(map(str, range(n)), counts, strict=True)), np.bincount([c.bit_length() for c in counts], weights=counts, minlength=blockdict.BANDS))
    net = gru_lm.Net(symbols)
    rng = np.random.default_rng(seed)
    net.w = {k: rng.standard_normal(v.shape) * 0.5 for k, v in net.w.items()}
    return net


def _plain(net: gru_lm.Net, said: list[int]) -> list[float]:
    """One document, one token at a time, as the formulas have it."""
    w, size, starts = net.w, gru_lm.HIDDEN, net.symbols.starts
    h, before, out = np.zeros(size), net.start, []
    for s in said:
        a, g = w["e"][before] @ w["x"] + w["b"], h @ w["h"]
        r, z = (1 / (1 + np.exp(-(a[i : i + size] + g[i : i + size]))) for i in (0, size))
        cand = np.tanh(a[2 * size :] + r * g[2 * size :])
        h = (1 - z) * cand + z * h
        c = net.cls[s]
        of_class, of_symbol = h @ w["c"] + w["cb"], (w["o"] @ h + w["ob"])[starts[c] : starts[c + 1]]
        out.append(of_class[c] - math.log(np.exp(of_class).sum()) + of_symbol[s - starts[c]] - math.log(np.exp(of_symbol).sum()))
        before = s
    return out


def test_scores_equal_a_plain_pass(monkeypatch):
    for k, v in {"SIDE": 4, "ROWS": 16, "COLUMNS": 8}.items():
        monkeypatch.setattr(gru_lm, k, v)
    net, rng = _net(120, 2), np.random.default_rng(3)
    docs = [rng.integers(0, 120, n).tolist() for n in (1, 50, 3, 3, 1, 17, 4, 4, 4, 2, 33)]
    got = net.score(np.concatenate(docs), np.array([len(d) for d in docs]))
    assert got == pytest.approx([x for d in docs for x in _plain(net, d)], rel=1e-9)
    assert len(net.score(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_gradients_stop_where_documents_start(monkeypatch):
    monkeypatch.setattr(gru_lm, "COLUMNS", 8)
    net, rng = _net(9, 4), np.random.default_rng(5)
    before, after = rng.integers(0, 9, (2, 5, 12))
    before[:, 3:] = 1  # more rows of one symbol than are added one by one
    keep, h = (rng.random((5, 12)) > 0.3).astype(float), rng.standard_normal((5, gru_lm.HIDDEN)) * 0.3
    g, _, _ = net.gradients(before, after, h, keep)
    for k in net.w:
        for at in ((np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)), tuple(x // 2 for x in g[k].shape)):
            kept, side = net.w[k][at], []
            for d in (1e-5, -1e-5):
                net.w[k][at] = kept + d
                side.append(net.gradients(before, after, h, keep)[2])
            net.w[k][at] = kept
            assert side[0] - side[1] == pytest.approx(2e-5 * g[k][at], rel=1e-3, abs=1e-13)


def _rows(monkeypatch, split, texts: list[str], ordered: bool) -> list[dict]:
    monkeypatch.setattr(blockdict, "staged", lambda made, name: made)
    monkeypatch.setattr(blockdict, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = blockdict.blocks(SimpleNamespace(mapInArrow=lambda run, schema: run), split, 3, counted=lambda i: i % 2 == 0, ordered=ordered)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    return [r for b in run(iter([batch])) for r in b.to_pylist()]


def test_ordered_blocks_pair_and_decode_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["", *(" ".join(rng.choice(WORDS, n)) for n in (1, 9, 30)), ""]
    for ordered in (True, False):
        plain = _rows(monkeypatch, str.split, texts, ordered)
        assert _rows(monkeypatch, lambda t: t.encode().split(), texts, ordered) == plain
        held = {}
        for r in plain[1:]:
            held |= dict(zip(blockdict.unpack_tokens(r["tokens"]), blockdict.unpack(r["counts"]).tolist(), strict=True))
        assert held == {w: sum(t.split().count(w) for t in texts[::2]) for w in WORDS}
        assert len(_rows(monkeypatch, str.split, ["", ""], ordered)) == 1

    def sort(*_, **__):
        raise AssertionError("pairs of document and token aren't read where the order is kept")

    with monkeypatch.context() as m:
        m.setattr(np, "unique", sort)
        _rows(m, str.split, texts, True)
