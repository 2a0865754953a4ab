"""Language-model scoring by a gated recurrent network in numpy.

Tokens are words (A-Z lower-cased) and one end per document. Counts over all training documents give the add-one base
score and the network's symbols: the SHORT most frequent tokens each have one, all others share one for each bit length
of their count. A token's probability is its symbol's under the network, times, within a shared symbol, the token's share
of the counts. So that the network meets unseen tokens in training, half of the documents read their tokens of count 1 as
unseen; an unseen token has one share among as many types as have count 1, so the probabilities sum to 1 at most.

The network embeds the symbol before, updates a gated recurrent unit, and has a class-factored softmax: a class, then a
symbol of the class. Training reads every token of every training document, in ROUNDS rounds of as many tokens: in each,
workers start from the same weights, lay their documents end to end in streams side by side, and pass over them by
truncated backpropagation through time with Adam. From one chunk of CHUNK tokens to the next the state is carried on, the
gradient is not; a document's start clears the state. Workers' weights are averaged by a tree of fixed fan-in. Scoring
runs over whole documents, SIDE of a block side by side, with the state carried from a document's start to its
end. Documents of more than PIECE tokens are several pieces in training, each from a cleared state; scoring never cuts.

Null and empty texts have the end token only. An empty training set gives N = V = 0 and the network's first weights.
Repeated rows are scored each and count each. A null id counts as empty text in the hash. Ties of counts go to the token
first in code point order. An empty table gives no rows. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resgraph.llm import blockdict
from resgraph.llm.common import staged

SHORT, CLASSES = 2000, 45
EMBED, HIDDEN = 24, 32
CHUNK, PIECE = 32, 4096
ROUNDS, STREAMS, RATE, LEAST_STEPS = 3, 256, 0.01, 30
WORKER_TOKENS = 1_500_000  # of a round
FAN_IN = 16
COLUMNS, ROWS, SIDE = 2048, 16_384, 512  # taken at once: rows of class logits, states whose symbols are scored, documents side by side
END = b""
BIT = 12  # of a packed value: symbol below, count above


def tokens(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass").lower()  # lowers A-Z alone
    return [*raw.split(), END]


def held_out(id: int | None, mod: int = 7, rest: int = 2) -> bool:
    return zlib.crc32(b"" if id is None else str(id).encode()) % mod == rest


@dataclass
class Symbols:
    """Symbols by falling count, in classes of like mass; share[s] is the log10 of 1 over the counts that share s."""

    names: dict[str, int]
    band: np.ndarray  # symbol of each bit length of a count
    mass: np.ndarray  # counts of each symbol
    own: int  # symbols below have one token each
    starts: np.ndarray  # first symbol of each class, and the end

    @classmethod
    def of(cls, top: list[tuple[str, int]], bands: np.ndarray) -> Symbols:
        rest = bands.astype(np.int64).copy()
        for _, n in top:
            rest[int(n).bit_length()] -= n
        mass = np.array([n for _, n in top] + rest.tolist(), np.int64)
        root = np.cumsum(np.sqrt(mass + 1.0))
        cut = np.searchsorted(root, np.linspace(0, root[-1], CLASSES + 1)[1:-1])
        starts = np.unique(np.concatenate([[0], cut, [len(mass)]]))
        return cls({t: i for i, (t, _) in enumerate(top)}, len(top) + np.arange(blockdict.BANDS), mass, len(top), starts)

    def packed(self, names: list[str], counts: np.ndarray) -> np.ndarray:
        bits = np.array([int(c).bit_length() for c in counts], np.int64)
        own = np.array([self.names.get(t, -1) for t in names], np.int64)
        return (counts.astype(np.int64) << BIT) | np.where(own >= 0, own, self.band[bits])

    def within(self, symbol: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of a token's share of its symbol; 0 for tokens with a symbol of their own."""
        all_ = np.where(count > 0, self.mass[symbol], self.mass[self.band[1]] + 1)
        return np.where(symbol >= self.own, np.log10(np.maximum(count, 1)) - np.log10(np.maximum(all_, 1)), 0.0)


class Net:
    def __init__(self, symbols: Symbols, seed: int = 9):
        rng = np.random.default_rng(seed)
        n, k = len(symbols.mass), len(symbols.starts) - 1
        self.symbols = symbols
        self.cls = np.repeat(np.arange(k), np.diff(symbols.starts))
        mass = symbols.mass.astype(np.float64)
        mass[symbols.band[:2]] = mass[symbols.band[:2]].sum() / 2  # as the pieces have them
        p = (mass + 0.5) / (mass.sum() + 0.5 * n)
        by_class = np.bincount(self.cls, weights=p, minlength=k)

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.w = {
            "e": (draw(n + 1, EMBED) * np.sqrt(n + 1) * 0.3).astype(np.float32), "x": draw(EMBED, 3 * HIDDEN), "h": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
            "c": draw(HIDDEN, k) * 0.1, "cb": np.log(by_class).astype(np.float32), "o": draw(n, HIDDEN) * 0.1, "ob": np.log(p / by_class[self.cls]).astype(np.float32),
        }
        self.start = n  # the symbol before a document's first

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.w.values()])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.w.items():
            self.w[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def gates(self, name: str) -> np.ndarray:
        """Weights to the gates, one block each, as step takes them: the two of a sigmoid with their sign turned."""
        blocks = self.w[name].reshape(-1, 3, HIDDEN).transpose(1, 0, 2).copy()
        np.negative(blocks[:2], out=blocks[:2])
        return blocks

    def inputs(self) -> np.ndarray:
        """What each symbol adds to each gate."""
        return np.matmul(self.w["e"], self.gates("x")) + self.gates("b")

    @staticmethod
    def step(a: np.ndarray, h: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after h with the inputs a, which become the gates, and what the candidate takes from h."""
        g = np.matmul(h, by)  # gates lie one behind the other, so that each is whole in memory
        said = a[:2]
        said += g[:2]
        np.exp(said, out=said)
        said += 1
        np.reciprocal(said, out=said)
        cand = a[2]
        cand += said[0] * g[2]
        np.tanh(cand, out=cand)
        new = h - cand
        new *= said[1]
        new += cand
        return new, g[2]

    def _softmax(self, a: np.ndarray, at: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of one row of each column of the logits a, which become exps, and the exps' sums."""
        said = a[at, np.arange(a.shape[1])]
        if bound > 60:  # states are within (-1, 1), so smaller weights can't overflow
            top = a.max(axis=0)
            said -= top
            a -= top
        np.exp(a, out=a)
        total = np.ones(len(a), a.dtype) @ a
        return said - np.log(total), total

    def log_prob(self, h: np.ndarray, symbol: np.ndarray, grad: bool = False):
        """Natural log of P(symbol | h); with grad, also the gradients of minus its sum."""
        w, starts = self.w, self.symbols.starts
        cls = self.cls[symbol]
        order = np.argsort(cls.astype(np.int16), kind="stable")  # rows of a class lie together
        h, cls, symbol = h.take(order, axis=0), cls[order], symbol[order]
        said, g = np.empty(len(h), h.dtype), {}
        if grad:
            dh = np.empty_like(h)
            g = {k: np.zeros_like(w[k]) for k in ("c", "cb", "o", "ob")}
        bound = float((np.abs(w["c"]).sum(axis=0) + np.abs(w["cb"])).max())
        for i in range(0, len(h), COLUMNS):
            at = slice(i, i + COLUMNS)
            hk, ck = h[at], cls[at]
            a = w["c"].T @ hk.T  # a column for each row of h, so that whole rows of logits are added and scaled
            a += w["cb"][:, None]
            said[at], total = self._softmax(a, ck, bound)
            if grad:
                a *= 1 / total
                a[ck, np.arange(len(ck))] -= 1
                np.matmul(a.T, w["c"].T, out=dh[at])
                g["c"] += hk.T @ a.T
                g["cb"] += a.sum(axis=1)
        sizes = np.abs(w["o"]).sum(axis=1) + np.abs(w["ob"])
        bounds = np.searchsorted(cls, np.arange(len(starts)))
        for k in np.flatnonzero(np.diff(bounds)):
            i, j, s, t = bounds[k], bounds[k + 1], starts[k], starts[k + 1]
            hk, at = h[i:j], symbol[i:j] - s
            a = w["o"][s:t] @ hk.T
            a += w["ob"][s:t, None]
            own, total = self._softmax(a, at, float(sizes[s:t].max()))
            said[i:j] += own
            if grad:
                a *= 1 / total
                a[at, np.arange(j - i)] -= 1
                dh[i:j] += a.T @ w["o"][s:t]
                g["o"][s:t], g["ob"][s:t] = a @ hk, a.sum(axis=1)
        out = np.empty_like(said)
        out[order] = said
        if not grad:
            return out
        back = np.empty_like(dh)
        back[order] = dh
        return out, back, g

    def gradients(self, before: np.ndarray, symbol: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of one chunk (streams by positions): mean gradients, the state after it, the mean loss; keep is 0 where a document starts."""
        w = self.w
        n, t = symbol.shape
        inputs, by = self.inputs(), self.gates("h")
        before = np.ascontiguousarray(before.T)
        if keep is not None:
            keep = np.ascontiguousarray(keep.T)[:, :, None]
        prev, states, gh = (np.empty((t, n, HIDDEN), inputs.dtype) for _ in range(3))
        gates = np.empty((t, 3, n, HIDDEN), inputs.dtype)
        for k in range(t):
            prev[k] = h if keep is None else h * keep[k]
            np.take(inputs, before[k], axis=1, out=gates[k], mode="clip")
            states[k], gh[k] = self.step(gates[k], prev[k], by)
            h = states[k]
        out, dflat, g = self.log_prob(states.reshape(n * t, HIDDEN), symbol.T.reshape(-1), True)
        d_all = dflat.reshape(t, n, HIDDEN)
        turned = w["h"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0).copy()
        dh = np.zeros((n, HIDDEN), inputs.dtype)
        for k in range(t - 1, -1, -1):  # gradients take the place of the gates, and those of gh the place of gh
            dh += d_all[k]
            (r, z, cand), gk = gates[k], gh[k]
            rest = 1 - z
            dz = prev[k] - cand
            dz *= rest
            dz *= z
            dz *= dh
            cand *= cand
            dcand = np.subtract(1, cand, out=cand)
            dcand *= rest
            dcand *= dh
            gk *= dcand
            dr = 1 - r
            dr *= r
            dr *= gk
            np.multiply(dcand, r, out=gk)
            dh *= z
            r[:], z[:] = dr, dz
            dh += r @ turned[0]
            dh += z @ turned[1]
            dh += gk @ turned[2]
            if keep is not None:
                dh *= keep[k]
        back = prev.transpose(0, 2, 1)
        g["h"] = np.concatenate([np.matmul(back, x).sum(axis=0) for x in (gates[:, 0], gates[:, 1], gh)], axis=1)
        # gradients of the inputs, summed by symbol, give those of the embedding and its weights
        at = np.arange(3 * n * t).reshape(t, 3, n).transpose(0, 2, 1).reshape(-1, 3)
        seen, d_in = _sums(before.reshape(-1), gates.reshape(-1, HIDDEN), at)
        g["b"], g["x"], g["e"] = d_in.sum(axis=0), w["e"][seen].T @ d_in, np.zeros_like(w["e"])
        g["e"][seen] = d_in @ w["x"].T
        return {k: v / (n * t) for k, v in g.items()}, h, -float(out.mean())

    def train(self, pieces: list[np.ndarray], steps: int, rate: float = RATE) -> float:
        """Adam over pieces (the symbol before, then symbols), one pass, or more until there are ``steps`` steps."""
        before = np.concatenate([p[:-1] for p in pieces]).astype(np.int64)
        symbol = np.concatenate([p[1:] for p in pieces]).astype(np.int64)
        keep = np.ones(len(symbol), np.float32)
        keep[np.cumsum([0, *(len(p) - 1 for p in pieces[:-1])])] = 0
        # streams side by side; few tokens make few streams, so that there are steps to take; the last is filled from the first
        streams = int(np.clip(len(symbol) // (steps * CHUNK), 16, STREAMS))
        long = -(-len(symbol) // streams)
        before, symbol, keep = (np.resize(x, (streams, long)) for x in (before, symbol, keep))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        per = -(-long // CHUNK)
        passes = max(1, -(-steps // per))
        done, loss = 0, 0.0
        for _ in range(passes):
            h = np.zeros((streams, HIDDEN), np.float32)
            for c in range(0, long, CHUNK):
                at = slice(c, c + CHUNK)
                g, h, loss = self.gradients(before[:, at], symbol[:, at], h, keep[:, at])
                done += 1
                now = rate * max(0.1, 1 - done / (per * passes))
                fix = now * (1 - 0.999**done) ** 0.5 / (1 - 0.9**done)
                for k, x in g.items():
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.001 * (x * x - v[k])
                    self.w[k] -= fix * m[k] / (np.sqrt(v[k]) + 1e-8)
        return loss

    def score(self, symbol: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol of documents laid end to end (each at least one symbol)."""
        out = np.zeros(len(symbol))
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
        inputs, by = self.inputs(), self.gates("h")
        held = np.empty((ROWS + SIDE, HIDDEN), inputs.dtype)
        where = np.empty(ROWS + SIDE, np.int64)
        total = 0

        def say() -> None:
            i = where[:total]
            out[i] = self.log_prob(held[:total], symbol[i])

        for i in range(0, len(sizes), SIDE):  # documents of like length side by side
            at, left = starts[i : i + SIDE].copy(), sizes[i : i + SIDE]
            alive = np.searchsorted(-left, -np.arange(left[0])).tolist()  # documents longer than each position
            h = np.zeros((len(at), HIDDEN), inputs.dtype)
            before = np.full(len(at), self.start)
            for n in alive:
                if n < len(at):
                    at, h, before = at[:n], h[:n], before[:n]
                h = self.step(inputs.take(before, axis=1), h, by)[0]
                before = symbol.take(at)
                held[total : total + n], where[total : total + n] = h, at
                at += 1
                total += n
                if total >= ROWS:
                    say()
                    total = 0
        if total:
            say()
        return out


def _sums(key: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and for each the sum of what it has, the rows numbered in ``at`` side by side."""
    order = np.argsort(key.astype(np.int16), kind="stable")
    seen, first, n = np.unique(key[order], return_index=True, return_counts=True)
    rows = rows.take(at[order], axis=0).reshape(len(key), -1)
    out = rows[first]
    few = n <= 8
    for k in range(1, 8):
        at = np.flatnonzero(few & (n > k))
        out[at] += rows[first[at] + k]
    for i in np.flatnonzero(~few):
        rows[first[i] : first[i] + n[i]].sum(axis=0, out=out[i])
    return seen, out


def _pieces(start: int, symbols: Symbols):
    """Training pieces of a block: every token of each training document once, PIECE at a time, after the symbol before."""
    once, unseen = int(symbols.band[1]), int(symbols.band[0])

    def make(docs: pd.DataFrame, value: np.ndarray, doc: np.ndarray, freq: np.ndarray) -> pd.DataFrame:
        symbol = (value & ((1 << BIT) - 1)).astype("<u2")
        n = np.bincount(doc, minlength=len(docs))
        first = np.cumsum(n) - n
        rows = []
        for i, (id, k, at) in enumerate(zip(docs["id"], n.tolist(), first.tolist(), strict=True)):
            id = None if pd.isna(id) else int(id)
            if held_out(id):
                continue
            said = np.concatenate([[start], symbol[at : at + k]]).astype("<u2")
            if zlib.crc32(f"unseen/{id}/{i}".encode()) & 1:
                said[said == once] = unseen
            for j in range(0, k, PIECE):
                cut = said[j : j + PIECE + 1]
                rows.append((zlib.crc32(f"{id}/{j}/{i}".encode()), len(cut) - 1, cut.tobytes()))
        return pd.DataFrame(rows, columns=["spot", "n", "symbols"]).astype({"spot": "int64", "n": "int64"})

    return make


def _average(group: pd.DataFrame) -> pd.DataFrame:
    """Weights of several workers, weighed by their tokens; in a fixed order, so that reruns agree."""
    group = group.sort_values("part", kind="stable")
    total = sum(np.frombuffer(f, np.float32).astype(np.float64) * n for f, n in zip(group["flat"], group["n"], strict=True))
    n = float(group["n"].sum())
    return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN_IN], "n": [n], "flat": [(total / n).astype(np.float32).tobytes()]})


def fit(table: DataFrame, values: DataFrame, symbols: Symbols) -> Net:
    """Train on all training documents, by averaging workers."""
    net = Net(symbols)
    pieces = staged(blockdict.finish(table, values, _pieces(net.start, symbols), "spot long, n long, symbols binary"), "pieces")
    n = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n:
        return net
    workers = max(1, -(-n // (WORKER_TOKENS * ROUNDS)))
    mixed = F.xxhash64("spot", "symbols")
    dealt = pieces.select("spot", "symbols", F.pmod(mixed, F.lit(workers)).cast("int").alias("worker"), F.pmod(F.shiftrightunsigned(mixed, 24), F.lit(ROUNDS)).cast("int").alias("round"))

    def worker(flat: np.ndarray, turn: int):
        def work(group: pd.DataFrame) -> pd.DataFrame:
            mine = Net(symbols)
            mine.set(flat)
            data = [np.frombuffer(x, "<u2") for x in group.sort_values(["spot", "symbols"])["symbols"]]
            mine.train(data, LEAST_STEPS, RATE * (1 - turn / (ROUNDS + 1)))
            return pd.DataFrame({"part": [int(group["worker"].iloc[0])], "n": [float(sum(len(x) - 1 for x in data))], "flat": [mine.flat().tobytes()]})

        return work

    for turn in range(ROUNDS):
        rows = staged(dealt.where(F.col("round") == turn).groupBy("worker").applyInPandas(worker(net.flat(), turn), "part int, n double, flat binary"), "weights")
        left = workers
        while left > 1:
            rows = staged(rows.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(_average, "part int, n double, flat binary"), "weights")
            left = -(-left // FAN_IN)
        best = rows.select("flat").first()
        if best is not None:
            net.set(np.frombuffer(best["flat"], np.float32))
    return net


def _most_frequent(counted: DataFrame, most: int) -> list[tuple[str, int]]:
    """The most frequent tokens of all buckets: buckets' lists are merged in groups, and the groups' lists here."""

    def best(lists) -> list[tuple[str, int]]:
        every = ((-t["n"], t["token"]) for held in lists if held is not None for t in held)
        return [(t, -n) for n, t in heapq.nsmallest(most, every)]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"top": [[{"token": t, "n": n} for t, n in best(group["top"])]]})

    groups = max(1, int(counted.count() ** 0.5))
    rows = counted.groupBy(F.pmod("bucket", F.lit(groups)).alias("part")).applyInPandas(merge, "top array<struct<token: string, n: long>>")
    return best(r["top"] for r in rows.collect())


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs; scores are log10."""
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    table = blockdict.blocks(rows, tokens, blockdict.buckets(rows), counted=lambda i: not held_out(i), ordered=True)
    counted = staged(blockdict.resolve(table, None, SHORT).select("bucket", "n_types", "n_counted", "top", "bands"), "counts")
    types, total = counted.agg(F.coalesce(F.sum("n_types"), F.lit(0)), F.coalesce(F.sum("n_counted"), F.lit(0))).first()
    top = _most_frequent(counted, SHORT)
    sums = dict(counted.select(F.posexplode("bands")).groupBy("pos").agg(F.sum("col")).collect())
    symbols = Symbols.of(top, np.array([sums.get(k, 0) for k in range(blockdict.BANDS)], np.int64))
    values = staged(blockdict.resolve(table, symbols.packed), "values")
    net = fit(table, values, symbols)
    flat = net.flat()
    below = np.log10(float(total + types + 1))

    def make(docs: pd.DataFrame, value: np.ndarray, doc: np.ndarray, freq: np.ndarray) -> pd.DataFrame:
        model = Net(symbols)
        model.set(flat)
        count, symbol = value >> BIT, value & ((1 << BIT) - 1)
        n = np.bincount(doc, minlength=len(docs))
        said = model.score(symbol, n) / np.log(10) + symbols.within(symbol, count)
        out = docs[["id"]].copy()
        out["held_out"] = [held_out(None if pd.isna(i) else int(i)) for i in docs["id"]]
        out["n_tokens"] = n
        out["n_known"] = np.bincount(doc, weights=count > 0, minlength=len(docs)).astype(np.int64)
        out["train_tokens"] = int(total)
        out["base_score"] = np.bincount(doc, weights=np.log10(count + 1.0) - below, minlength=len(docs))
        out["score"] = np.bincount(doc, weights=said, minlength=len(docs))
        return out

    return blockdict.finish(table, values, make, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
