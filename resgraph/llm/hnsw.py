"""Embedding near duplicates: a hierarchical navigable small-world graph for each shard, queried by every vector.

Equal vectors are one class, and classes are dealt to shards by hash. Each shard's graph (Malkov and
Yashunin, 2018) is built in one task, in growing batches: a batch searches the graph so far, links to diverse neighbours
(one that is closer to a chosen neighbour than to the new vector is left out while others remain), and nodes with too
many links keep their diverse ones. Then all classes query every shard: parts of them stream past a shard's graph, which
a task loads once. A query's beam doubles until the beam's worst member is below the threshold, so that groups larger than
a beam are found whole. Before that, some queries of each part are audited against brute force: the beam they start with
doubles until the mean share of the other vectors that each should find reaches RECALL; where the widest beam misses it,
the part is compared with the whole shard by matrix products.

Found pairs are verified by cosine in double precision. A task hands back, for its part and shard, the number of links
of each class and a spanning forest of the links, never the pairs; forests are joined to components.

Vectors that are null, empty, zero, or have null or non-finite components link with nothing; so do vectors of different
lengths. Repeated rows (same id and vector) count as other vectors; rows of one id with different vectors are vectors of
their own. Ties don't matter, as links are counted, not ranked. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resgraph.llm.common import components, staged

LINKS, BASE_LINKS, BUILD_BEAM, BEAM = 12, 24, 40, 32
SHARDS, SHARD_BYTES, PART_ROWS = 8, 200 << 20, 200_000
AUDITS, RECALL = 24, 0.98
QUERY_BATCH, PAIR_BATCH = 1024, 512


def _dots(vectors: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Dot products of each query with its own row of node numbers (negative: none, -2)."""
    out = np.einsum("bd,bkd->bk", q, vectors[np.maximum(at, 0)])
    out[at < 0] = -2.0
    return out


def search(vectors: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, floor: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Best nodes of each query in one layer by beam search: (nodes, dots), best first, -1 where there are fewer.

    All queries of the batch step together: each expands its best open node until its whole beam is expanded.
    """
    n, wide = len(q), links.shape[1]
    entry = entry.reshape(n, -1)
    node = np.full((n, beam), -1, np.int64)
    dot = np.full((n, beam), -2.0, np.float32)
    done = np.ones((n, beam), bool)
    k = min(beam, entry.shape[1])
    node[:, :k], dot[:, :k] = entry[:, :k], _dots(vectors, q, entry[:, :k])
    done[:, :k] = node[:, :k] < 0
    seen = np.zeros((n, (len(vectors) + 7) // 8), np.uint8)
    row = np.arange(n)
    for c in range(k):
        e = np.maximum(entry[:, c], 0)
        seen[row, e >> 3] |= (1 << (e & 7)).astype(np.uint8)
    active = row
    while len(active):
        open_ = np.where(done[active], -3.0, dot[active])
        best = open_.argmax(axis=1)
        alive = open_[np.arange(len(active)), best] > -2.5
        active, best = active[alive], best[alive]
        if not len(active):
            break
        done[active, best] = True
        near = links[node[active, best]]
        safe = np.maximum(near, 0)
        new = (near >= 0) & ((seen[active[:, None], safe >> 3] >> (safe & 7).astype(np.uint8)) & 1 == 0)
        near = np.where(new, near, -1)
        r, c = np.nonzero(new)
        np.bitwise_or.at(seen, (active[r], near[r, c] >> 3), (1 << (near[r, c] & 7)).astype(np.uint8))
        d = _dots(vectors, q[active], near)
        keep = d.max(axis=1) > dot[active].min(axis=1)
        if not keep.any():
            continue
        a, near, d = active[keep], near[keep], d[keep]
        every = np.concatenate([dot[a], d], axis=1)
        top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        i = np.arange(len(a))[:, None]
        dot[a] = every[i, top]
        node[a] = np.concatenate([node[a], near], axis=1)[i, top]
        done[a] = np.concatenate([done[a], near < 0], axis=1)[i, top]
        done[a] |= node[a] < 0
    order = np.argsort(-dot, axis=1, kind="stable")
    return node[row[:, None], order], dot[row[:, None], order]


def diverse(vectors: np.ndarray, cand: np.ndarray, dot: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first), up to most: those nearer to the row than to any chosen one, then the rest."""
    n, k = cand.shape
    v = vectors[np.maximum(cand, 0)]
    between = np.einsum("bid,bjd->bij", v, v)
    chosen = np.zeros((n, k), bool)
    for j in range(k):
        near = np.where(chosen, between[:, j, :], -2.0).max(axis=1)
        chosen[:, j] = (cand[:, j] >= 0) & (near < dot[:, j]) & (chosen.sum(axis=1) < most)
    rank = np.where(chosen, 0, np.where(cand >= 0, 1, 2)) * k + np.arange(k)
    order = np.argsort(rank, axis=1)[:, :most]
    out = cand[np.arange(n)[:, None], order]
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    """Layers of links over unit vectors (float32); layer 0 has every node."""

    def __init__(self, vectors: np.ndarray, seed: int = 4):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        rng = np.random.default_rng([seed, n])
        self.level = np.minimum((-np.log(1.0 - rng.random(n)) / np.log(LINKS)).astype(np.int64), 12)
        self.order = np.lexsort((np.arange(n), -self.level))  # upper nodes first, so the entry never changes
        self.layers = [np.full((n, BASE_LINKS if k == 0 else LINKS), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        at, size = 1, 1
        while at < n:
            batch = self.order[at : at + size]
            self._insert(batch)
            at += len(batch)
            size = min(max(1, at // 2), QUERY_BATCH)

    @property
    def entry(self) -> int:
        return int(self.order[0])

    def _insert(self, batch: np.ndarray) -> None:
        q = self.vectors[batch]
        where = np.full((len(batch), 1), self.entry, np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            here = self.level[batch] >= k
            beam = BUILD_BEAM if here.any() else 1
            node, dot = search(self.vectors, self.layers[k], q, where, beam)
            where = node[:, : BUILD_BEAM if k == 0 else 4]
            if here.any():
                mine, cand, d = batch[here], node[here], dot[here]
                if len(batch) > 1:  # the batch's own members are candidates for each other
                    inside = self.vectors[mine] @ self.vectors[mine].T
                    np.fill_diagonal(inside, -2.0)
                    few = min(8, len(mine) - 1)
                    if few:
                        own = np.argpartition(-inside, few - 1, axis=1)[:, :few]
                        cand = np.concatenate([cand, mine[own]], axis=1)
                        d = np.concatenate([d, np.take_along_axis(inside, own, axis=1)], axis=1)
                        order = np.argsort(-d, axis=1, kind="stable")
                        cand, d = np.take_along_axis(cand, order, axis=1), np.take_along_axis(d, order, axis=1)
                self.layers[k][mine, :LINKS] = diverse(self.vectors, cand, d, LINKS)
                self._back(k, mine)

    def _back(self, k: int, mine: np.ndarray) -> None:
        """Add the links' other directions, and let full nodes choose anew."""
        layer = self.layers[k]
        wide = layer.shape[1]
        src = np.repeat(mine, LINKS)
        dst = layer[mine, :LINKS].reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(min(count.max(), 4 * wide))
        slot = np.arange(len(dst)) - np.repeat(first, count)
        inside = slot < width  # beyond that a node chooses among the first; the new nodes keep their own links
        extra = np.full((len(nodes), width), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count)[inside], slot[inside]] = src[inside]
        for i in range(0, len(nodes), 512):
            part = nodes[i : i + 512]
            cand = np.concatenate([layer[part].astype(np.int64), extra[i : i + 512]], axis=1)
            d = _dots(self.vectors, self.vectors[part], cand)
            order = np.argsort(-d, axis=1, kind="stable")
            cand, d = np.take_along_axis(cand, order, axis=1), np.take_along_axis(d, order, axis=1)
            same = np.zeros_like(cand, bool)
            same[:, 1:] = (cand[:, 1:] == cand[:, :-1]) & (cand[:, 1:] >= 0)
            cand[same], d[same] = -1, -2.0
            order = np.argsort(-d, axis=1, kind="stable")
            cand, d = np.take_along_axis(cand, order, axis=1), np.take_along_axis(d, order, axis=1)
            layer[part] = diverse(self.vectors, cand[:, : 2 * wide], d[:, : 2 * wide], wide)

    def within(self, q: np.ndarray, floor: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(query number, node) of all found whose dot is at least floor; beams that are full of such double."""
        where = np.full((len(q), 1), self.entry, np.int64)
        for layer in self.layers[:0:-1]:
            where = search(self.vectors, layer, q, where, 4)[0]
        todo, out_q, out_n = np.arange(len(q)), [], []
        while len(todo):
            beam = min(beam, len(self.vectors))
            node, dot = search(self.vectors, self.layers[0], q[todo], where[todo], beam)
            full = (dot[:, -1] >= floor) & (beam < len(self.vectors))
            r, c = np.nonzero((dot >= floor) & ~full[:, None])
            out_q.append(todo[r])
            out_n.append(node[r, c])
            todo = todo[full]
            grown = np.full((len(q), min(beam, 64)), -1, np.int64)
            grown[todo] = node[full, : grown.shape[1]]
            where, beam = grown, beam * 2
        return np.concatenate(out_q or [todo]), np.concatenate(out_n or [todo])

    def dump(self) -> bytes:
        import io

        sink = io.BytesIO()
        np.savez(sink, vectors=self.vectors, level=self.level, order=self.order, **{f"l{k}": x for k, x in enumerate(self.layers)})
        return sink.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        import io

        held = np.load(io.BytesIO(data))
        out = cls.__new__(cls)
        out.vectors, out.level, out.order = held["vectors"], held["level"], held["order"]
        out.layers = [held[f"l{k}"] for k in range(len(held.files) - 3)]
        return out


def beam_for(graph: Graph, q: np.ndarray, own: np.ndarray, floor: float, recall: float = RECALL, audits: int = AUDITS) -> int:
    """A beam wide enough for the audited queries' mean recall; 0 if none is. own: each query's own node, or -1."""
    some = np.unique(np.linspace(0, len(q) - 1, min(audits, len(q))).astype(int)) if len(q) else np.zeros(0, int)
    truth = [np.setdiff1d(np.flatnonzero(graph.vectors @ q[i] >= floor), own[i : i + 1]) for i in some]
    asked = [(i, t) for i, t in zip(some.tolist(), truth, strict=True) if len(t)]
    beam = BEAM
    while asked:
        a, b = graph.within(q[[i for i, _ in asked]], floor, beam)
        shares = [len(np.intersect1d(b[a == k], t)) / len(t) for k, (_, t) in enumerate(asked)]
        if sum(shares) >= recall * len(shares):
            break
        if beam >= len(graph.vectors):
            return 0
        beam *= 2
    return beam


def query(graph: Graph, q: np.ndarray, own: np.ndarray, threshold: float):
    """Batches of pairs (query number, node) of cosine >= threshold - 1e-4, which the caller verifies."""
    floor = threshold - 1e-4  # dots are in single precision
    beam = beam_for(graph, q, own, floor)
    for i in range(0, len(q), PAIR_BATCH):
        part = q[i : i + PAIR_BATCH]
        a, b = graph.within(part, floor, beam) if beam else np.nonzero(part @ graph.vectors.T >= floor)
        yield a + i, b


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.frombuffer(v, "<f8") for v in column])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Forest:
    """Spanning forest of links told in batches."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (u := self.find(x)) != (v := self.find(y)):
                self.parent[max(u, v)] = min(u, v)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def _build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("cid", kind="stable")
    graph = Graph(_unit(group["vec"]))
    return pd.DataFrame({"shard": group["shard"].iloc[:1], "dim": group["dim"].iloc[:1], "graph": [graph.dump()], "cids": [group["cid"].to_numpy("<i8").tobytes()], "copies": [group["n"].to_numpy("<i8").tobytes()], "exact": [b"".join(group["vec"])]})


def _asked(threshold: float):
    """Rows sorted by (shard, dim, part, kind): the shard's graph, then its queries, streamed; links and forests of each part."""

    def told(shard: dict, ids: np.ndarray, vecs: list[bytes], forest: _Forest) -> list[tuple[int, int, int]]:
        q = _unit(pd.Series(vecs))
        cids, exact = shard["cids"], shard["exact"]
        at = np.minimum(np.searchsorted(cids, ids), len(cids) - 1)
        own = np.where(cids[at] == ids, at, -1)
        links = np.zeros(len(ids), np.int64)
        for a, b in query(shard["graph"], q.astype(np.float32), own, threshold):
            other = own[a] != b
            a, b = a[other], b[other]
            ok = np.concatenate([np.einsum("nd,nd->n", q[a[i : i + 50_000]], exact[b[i : i + 50_000]]) >= threshold for i in range(0, len(a), 50_000)] or [np.zeros(0, bool)])
            a, b = a[ok], b[ok]
            links += np.bincount(a, weights=shard["copies"][b], minlength=len(ids)).astype(np.int64)
            forest.add(ids[a], cids[b])
        return [(0, int(ids[i]), int(links[i])) for i in np.flatnonzero(links)]

    def run(batches):
        names = ["kind", "a", "b"]
        shard, now, forest, ids, vecs = None, None, _Forest(), [], []

        def done(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["dim"], row["part"]) != now:
                    if vecs and shard is not None:
                        yield done(told(shard, np.array(ids), vecs, forest))
                    yield done([(1, x, y) for x, y in forest.edges()])
                    shard, now, forest, ids, vecs = None, (row["shard"], row["dim"], row["part"]), _Forest(), [], []
                if row["kind"] == 0:
                    exact = np.frombuffer(row["exact"], "<f8").reshape(-1, row["dim"])
                    shard = {"graph": Graph.load(row["vec"]), "cids": np.frombuffer(row["cids"], "<i8"), "copies": np.frombuffer(row["copies"], "<i8"), "exact": exact / np.linalg.norm(exact, axis=1, keepdims=True)}
                elif shard is not None:  # a shard without vectors of this length has no graph
                    ids.append(row["cid"])
                    vecs.append(row["vec"])
                    if len(vecs) >= 8192:
                        yield done(told(shard, np.array(ids), vecs, forest))
                        ids, vecs = [], []
        if vecs and shard is not None:
            yield done(told(shard, np.array(ids), vecs, forest))
        yield done([(1, x, y) for x, y in forest.edges()])

    return run


def near_vectors(table: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, shards: int = SHARDS) -> DataFrame:
    """(id, n_links, component_id) of every row of table."""
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(f"`{id}`").cast("long").alias("id"), F.when(F.coalesce(sound, F.lit(False)), v).alias("v"))
    rows = staged(rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")), "vectors")
    sums = rows.where("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"))
    one = sums.withColumn("cid", F.monotonically_increasing_id()).select("h1", "h2", "low", "n", "cid", F.size("v").alias("dim"), _packed("v").alias("vec"))
    one = staged(one, "classes")
    n, size = one.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(shards, -(-8 * size // SHARD_BYTES))  # by the bytes of their vectors, so that a graph fits a task
    parts = max(1, -(-n // PART_ROWS))
    spot = F.xxhash64(F.lit("hnsw"), "h1", "h2")
    dealt = one.select("cid", "n", "dim", F.pmod(spot, F.lit(shards)).cast("int").alias("shard"), F.pmod(F.shiftrightunsigned(spot, 20), F.lit(parts)).cast("int").alias("part"), "vec")
    built = dealt.groupBy("shard", "dim").applyInPandas(_build, "shard int, dim int, graph binary, cids binary, copies binary, exact binary")
    built = staged(built, "graphs")
    none = F.lit(None).cast("binary")
    by = ("shard", "dim", "part")
    graphs = built.select("shard", "dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("cid"), F.col("graph").alias("vec"), "cids", "copies", "exact")
    asked = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", "part", F.lit(1).alias("kind"), "cid", "vec", none.alias("cids"), none.alias("copies"), none.alias("exact"))
    met = graphs.unionByName(asked).repartition(shards * parts, *by).sortWithinPartitions(*by, "kind", "cid")
    found = staged(met.mapInArrow(_asked(threshold), "kind long, a long, b long"), "links")
    comp = components(found.where("kind = 1").select("a", "b")).toDF("cid", "comp")
    links = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    named = staged(one.select("h1", "h2", "low", "cid", "n").join(links, "cid", "left").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "named")
    least = named.groupBy("comp").agg(F.min("low").alias("component"))
    out = rows.join(named.join(least, "comp").select("h1", "h2", "n", "links", "component"), ["h1", "h2"], "left")
    has = F.col("v").isNotNull()
    return out.select("id", F.when(has, F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(has & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"))


def _packed(name: str):
    """A double array column as packed little-endian doubles."""

    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, "<f8").tobytes() for v in vectors])

    return F.pandas_udf(run, "binary")(F.col(name))
