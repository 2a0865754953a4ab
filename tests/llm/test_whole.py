"""Corpus operators read all that they are given."""

from __future__ import annotations

import numpy as np
import pandas as pd

from resgraph.llm import blockdict, gru_lm, hamming_join


def test_pieces_hold_every_training_token_once():
    ids = [i for i in range(20) if not gru_lm.held_out(i)][:4]
    sizes = [1, gru_lm.PIECE - 1, gru_lm.PIECE, 3 * gru_lm.PIECE + 5]
    symbols = gru_lm.Symbols.of([("a", 10)], np.bincount([4], weights=[10], minlength=blockdict.BANDS))
    value = np.random.default_rng(0).integers(100, 4000, sum(sizes))
    made = gru_lm._pieces(4001, symbols)(pd.DataFrame({"id": ids}), value, np.repeat(np.arange(4), sizes), np.ones(len(value)))
    rows = [np.frombuffer(x, "<u2") for x in made["symbols"]]
    assert np.concatenate([r[1:] for r in rows]).tolist() == value.tolist()
    assert [r[0] == 4001 for r in rows] == [True, True, True, True, False, False, False]
    assert made["n"].tolist() == [len(r) - 1 for r in rows]


def test_training_reads_every_token(monkeypatch):
    symbols = gru_lm.Symbols.of([(str(i), 5) for i in range(50)], np.bincount([3], weights=[250], minlength=blockdict.BANDS))
    net = gru_lm.Net(symbols)
    rng = np.random.default_rng(1)
    pieces = [np.concatenate([[net.start], rng.integers(0, 50, n)]) for n in (700, 1, 2000, 33)]
    read, starts = np.zeros(len(symbols.mass), np.int64), 0
    plain = net.gradients

    def seen(before, symbol, h, keep):
        nonlocal starts
        read[:] += np.bincount(symbol.ravel(), minlength=len(read))
        starts += int((keep == 0).sum())
        return plain(before, symbol, h, keep)

    monkeypatch.setattr(net, "gradients", seen)
    net.train(pieces, 1)
    least = np.bincount(np.concatenate([p[1:] for p in pieces]), minlength=len(read))
    assert (read >= least).all() and read.sum() < least.sum() + gru_lm.STREAMS and starts >= len(pieces)


def test_base_scores_equal_counts(spark):
    import math
    import random
    import zlib

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["A", "a", "b", "c", "d e", "é", f"x{rng.randrange(9)}"]) for _ in range(rng.randrange(30))) for _ in range(120)] + [None, "", "new words only"]
    rows = [(i if i != 7 else None, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash")]
    got = sorted(gru_lm.scores(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect(), key=lambda r: (r.id is not None, r.id or 0))
    lower = [((t or "").lower().split() + [""]) for _, t, _ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _, _ in rows]
    counts: dict[str, int] = {}
    for words, out in zip(lower, held, strict=True):
        for w in words if not out else ():
            counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(((i is not None, i or 0), out, len(words), sum(w in counts for w in words), sum(math.log10((counts.get(w, 0) + 1) / (total + kinds + 1)) for w in words)) for (i, _, _), words, out in zip(rows, lower, held, strict=True))
    assert len(got) == len(want)
    for r, (key, out, n, known, base) in zip(got, want, strict=True):
        assert ((r.id is not None, r.id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (key, out, n, known, total)
        assert abs(r.base_score - base) < 1e-6 and np.isfinite(r.score) and r.score < 0
    assert gru_lm.scores(spark.createDataFrame(rows[:0], "doc_id long, text string, score string")).count() == 0


def test_link_that_no_star_has(spark):
    """The least class is in every key that two others share, and near neither."""
    base = [f"w{i}" for i in range(1000)]
    for seed in range(100):
        longer = base + [f"x{seed}_{i}" for i in range(8)]
        texts = [" ".join(w) for w in (base, longer, [*longer, "y"])]
        sig = hamming_join.signatures(hamming_join.shingle_sets(texts, 1))
        if (sig == sig[0]).all():
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in hamming_join.near_duplicates(docs, width=1, threshold=(995, 1000)).collect()}
    assert got == {0: 0, 1: 1, 2: 1}
