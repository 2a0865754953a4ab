"""Near duplicates: b-bit MinHash signatures, a multi-index Hamming join, and links confirmed on whole shingle sets.

A document's set is its distinct word shingles. POSITIONS MinHash values of BITS bits make its signature; the distance of
two signatures is the number of positions that differ. Signatures are cut into CHUNKS chunks. By the pigeonhole
principle, two signatures within DISTANCE = CHUNKS * (ERRORS + 1) - 1 have a chunk with at most ERRORS differing
positions, so one key for each chunk and each choice of ERRORS positions left out brings every such pair together. (At a
similarity of 0.8, DISTANCE 27 of 70 leaves out less than one pair in ten thousand; the expected distance is 14.)

No group is ever expanded to its pairs. Documents of equal sets are one class from the start.

1. Within each key a task searches for the spanning forest of its classes under DISTANCE, by signatures alone; a key of
   more than GROUP classes makes a star of all of them, which may join more than it has to but never less. The components
   of these forests are families: every pair within DISTANCE lies in one family.
2. A family's sets go to one task, once, which searches for the spanning forest of its links: pairs within DISTANCE whose
   full sets reach the threshold. A search compares a class only with classes that it has not yet reached, so that n near
   copies cost about n comparisons.
3. A family of more than GROUP classes or WEIGHT shingles is cut into parts, each searched together with HUBS classes that
   all parts share. Then each class outside the largest component found meets every part, once, and looks for links to
   other components. Every pair of two components has such a class, so no link between components is missed.

Tasks return forests: never more rows than classes. Every link is confirmed on full sets. The work of a family without
links among its classes grows with the square of its size, as all its pairs are within DISTANCE or share a key.

Sets hold 48 bits of each shingle's hash. Null, empty and blank texts have no shingles and stay alone. Fewer words than a
shingle has make one shingle of all; very long texts are sets like all others. Rows with a null id link with nothing and
have a null component. Repeated rows (same id and text) get the same component; rows of one id with different texts are
compared each. Ties don't arise, as components are named by their least id. An empty table gives no rows. Extra columns
aren't read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resgraph.llm.common import components, staged, unstage

POSITIONS, BITS, CHUNKS, ERRORS = 70, 16, 14, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
GROUP, WEIGHT, HUBS = 4000, 2_000_000, 8  # classes and shingles of a family that one task takes; classes all parts share
_rng = np.random.default_rng(8)
_mul = (_rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_add = _rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint64).astype(np.uint32)
_width = POSITIONS // CHUNKS
_patterns = [[c * _width + p for p in range(_width) if p not in out] for c in range(CHUNKS) for out in combinations(range(_width), ERRORS)]
_known: dict[bytes, int] = {}


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted 48-bit shingle hashes of each text."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # lowers A-Z alone
    if len(_known) > 400_000:
        _known.clear()
    for w in set().union(*split) - _known.keys() if split else ():
        _known[w] = xxhash.xxh3_64_intdigest(w)
    out = []
    for words in split:
        code = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
        n = min(width, len(words))
        if n:
            mixed = np.full(len(words) - n + 1, n, np.uint64)
            for k in range(n):
                mixed = (mixed ^ code[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(31)
            out.append(np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(16)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, BITS bits each."""
    flat = np.concatenate(sets)
    x = (flat ^ (flat >> np.uint64(20))).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), POSITIONS), np.uint32)
    for i in range(POSITIONS):
        out[:, i] = np.minimum.reduceat(x * _mul[i] + _add[i], starts)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint16)


def keys(sig: np.ndarray) -> np.ndarray:
    """Signatures by patterns: a 64-bit key of each chunk with each choice of positions left out."""
    out = np.empty((len(sig), len(_patterns)), np.uint64)
    wide = sig.astype(np.uint64)
    for k, pattern in enumerate(_patterns):
        h = np.full(len(sig), k + 1, np.uint64)
        for p in pattern:
            h = (h ^ wide[:, p]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, k] = h
    return out.view(np.int64)


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(0, len(ids), 200):
                sets = shingle_sets(texts.slice(i, 200).to_pylist(), width)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig = signatures([sets[k] for k in full]) if full else None
                at = dict(zip(full, range(len(full)), strict=True))
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, 200).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d and int.from_bytes(d[:8], "little", signed=True) for d in digest], pa.int64()),
                    pa.array([d and int.from_bytes(d[8:], "little", signed=True) for d in digest], pa.int64()),
                    pa.array([sig[at[k]].tobytes() if k in at else None for k in range(len(sets))], pa.binary()),
                ], ["id", "n", "d1", "d2", "sig"])

    return run


def _keyed(batches):
    """(node, sig) to (key, node)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            key = keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), key.shape[1]))], ["key", "node"])


def _shared(batches):
    """Of rows (key, node) sorted by key, those whose key has another row."""
    held, told = None, False  # the last row waits for the one after it, unless the one before has told it
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        key = table.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        out = keep.copy()
        out[0] &= not told
        yield from table.filter(pa.array(out)).to_batches()
        held, told = table.slice(len(key) - 1), bool(keep[-1])


def _groups(batches, names: list[str], by: list[str]):
    """(table, bounds) of whole groups, from batches sorted by the columns ``by``."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch]).rename_columns(names)
        table = part if held is None else pa.concat_tables([held, part])
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for c in by:
            code = table.column(c).to_numpy()
            change |= code[1:] != code[:-1]
        edges = np.flatnonzero(change) + 1
        if len(edges):
            yield table.slice(0, int(edges[-1])), [0, *edges.tolist()]
            table = table.slice(int(edges[-1]))
        held = table
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


def _search(size: int, near) -> list[tuple[int, int]]:
    """Spanning forest of the graph whose node x is linked with near(x, others); reached nodes are compared no more."""
    left, queue, edges = np.arange(size), [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        x = queue.pop()
        hit = near(x, left)
        found = left[hit].tolist()
        edges += [(x, y) for y in found]
        queue += found
        left = left[~hit]
    return edges


def _edges(pairs: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.sort(pairs.reshape(-1, 2), axis=1), axis=0) if len(pairs) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, k], pa.int64()) for k in (0, 1)], ["a", "b"])


def _signatures_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _close(batches):
    """Of rows (key, node, sig) sorted by key: forest edges of each key's classes under DISTANCE."""
    for table, bounds in _groups(batches, ["key", "node", "sig"], ["key"]):
        node, sig = table.column("node").to_numpy(), _signatures_of(table.column("sig"))
        starts, sizes = np.array(bounds[:-1]), np.diff(bounds)
        first = np.repeat(starts, sizes)
        close = (sig != sig[first]).sum(axis=1) <= DISTANCE  # with the first of its key, which decides most keys
        far = np.add.reduceat(~close, starts)
        star = close & np.repeat(far == 0, sizes) & (first != np.arange(len(node)))
        pairs = [np.stack([node[first[star]], node[star]], axis=1)]
        for g in np.flatnonzero((far > 0) & (sizes > 2)):
            mine, own = sig[bounds[g] : bounds[g + 1]], node[bounds[g] : bounds[g + 1]]
            found = _search(len(own), lambda x, left: (mine[left] != mine[x]).sum(axis=1) <= DISTANCE)
            if found:
                pairs.append(own[np.array(found)])
        yield _edges(np.concatenate(pairs))


class _Sets:
    """Signatures and shingle sets of the classes that one task compares."""

    def __init__(self, table: pa.Table, threshold: tuple[int, int]):
        self.numer, self.denom = threshold
        self.sig = _signatures_of(table.column("sig"))
        sets = [unpack(m) for m in table.column("members").to_pylist()]
        self.size = np.array([len(s) for s in sets])
        self.start = np.cumsum(self.size) - self.size
        names, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(names), bool)

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of others are within DISTANCE of x and reach the threshold with it, on full sets."""
        n = self.size[others]
        out = (self.sig[others] != self.sig[x]).sum(axis=1) <= DISTANCE
        out &= self.denom * np.minimum(n, self.size[x]) >= self.numer * np.maximum(n, self.size[x])
        at = np.flatnonzero(out)
        if len(at):
            own = self.flat[self.start[x] : self.start[x] + self.size[x]]
            self.mark[own] = True
            begin, n = self.start[others[at]], n[at]
            stops = np.cumsum(n)
            spots = np.arange(stops[-1]) + np.repeat(begin - (stops - n), n)
            both = np.add.reduceat(self.mark[self.flat[spots]].astype(np.int64), stops - n)
            self.mark[own] = False
            out[at] = self.denom * both >= self.numer * (n + self.size[x] - both)
        return out


def _links(threshold: tuple[int, int]):
    """Of rows (family, part, node, sig, members) sorted by the first two: forest edges of each group's links."""

    def run(batches):
        for table, bounds in _groups(batches, ["family", "part", "node", "sig", "members"], ["family", "part"]):
            node, pairs = table.column("node").to_numpy(), []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                sets = _Sets(table.slice(i, j - i), threshold)
                found = _search(j - i, sets.linked)
                if found:
                    pairs.append(node[i:j][np.array(found)])
            yield _edges(np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64))

    return run


def _across(threshold: tuple[int, int]):
    """Of rows (family, part, chunk, node, comp, asks, sig, members): links of asking rows to other components."""

    def run(batches):
        for table, bounds in _groups(batches, ["family", "part", "chunk", "node", "comp", "asks", "sig", "members"], ["family", "part", "chunk"]):
            pairs = []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                part = table.slice(i, j - i)
                node, comp, asks = (part.column(c).to_numpy().copy() for c in ("node", "comp", "asks"))
                sets, told = _Sets(part, threshold), np.flatnonzero(asks == 0)
                for x in np.flatnonzero(asks == 1).tolist():
                    others = told[comp[told] != comp[x]]
                    if not len(others):
                        continue
                    hits = others[sets.linked(x, others)]
                    for c, y in zip(*np.unique(comp[hits], return_index=True), strict=True):
                        pairs.append((node[x], node[hits[y]]))
                        comp[comp == c] = comp[x]  # so that no later class tells of the same two components
            yield _edges(np.array(pairs, np.int64).reshape(-1, 2))

    return run


def _large(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links of families cut into parts; rows (family, parts, node, n, sig, members)."""
    data = ("node", "sig", "members")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    hubs = rows.groupBy("family").agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(HUBS)])).alias("hubs"))
    hubs = rows.join(hubs.select(F.col("family").alias("of"), F.explode("hubs").alias("hub")), (F.col("family") == F.col("of")) & (F.col("node") == F.col("hub")))
    hubs = hubs.withColumn("own", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).where("part <> own")
    groups = rows.select("family", "part", *data).union(hubs.select("family", "part", *data))
    inside = staged(groups.repartition("family", "part").sortWithinPartitions("family", "part").mapInArrow(_links(threshold), "a long, b long"), "inside")
    comp = staged(components(inside), "parts")
    rows = rows.join(comp.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = staged(rows, "large")
    sizes = rows.groupBy("family", "comp").agg(F.count("*").alias("many"), F.sum("n").alias("weight"))
    most = sizes.groupBy("family").agg(F.max_by("comp", F.struct("many", "comp")).alias("most"), F.sum("many").alias("many"), F.sum("weight").alias("weight"), F.max(F.struct("many", "weight")).alias("top"))
    # the asking classes are cut into chunks as families are into parts
    chunks = F.greatest(F.ceil((F.col("many") - F.col("top.many")) / GROUP), F.ceil((F.col("weight") - F.col("top.weight")) / WEIGHT)).cast("int")
    rows = rows.join(staged(most.select("family", "most", chunks.alias("chunks")).where("chunks > 0"), "asking"), "family")
    told = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("family", "part", "chunk", "node", "comp", F.lit(0).alias("asks"), "sig", "members")
    asks = rows.where("comp <> most").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int"))
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).select("family", "part", "chunk", "node", "comp", F.lit(1).alias("asks"), "sig", "members")
    by = ("family", "part", "chunk")
    return inside.union(told.union(asks).repartition(*by).sortWithinPartitions(*by).mapInArrow(_across(threshold), "a long, b long"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """(id, n_shingles, component_id): component_id is the least id reachable by links of similarity threshold or more."""
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    sketch = staged(rows.mapInArrow(_sketch(width), "id long, n long, d1 long, d2 long, sig binary"), "sketches")
    classes = sketch.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", "sig").mapInArrow(_keyed, "key long, node long").repartition("key").sortWithinPartitions("key")
    members = staged(keyed.mapInArrow(_shared, "key long, node long"), "members")
    many = members.groupBy("key").agg(F.count("*").alias("many"), F.min("node").alias("hub")).where(F.col("many") > GROUP)
    hot = staged(many.select("key", "hub"), "hot")
    stars = members.join(hot, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    close = members.join(hot, "key", "left_anti").join(classes.select("node", "sig"), "node").select("key", "node", "sig")
    close = close.repartition("key").sortWithinPartitions("key").mapInArrow(_close, "a long, b long")
    family = staged(components(close.union(stars)).toDF("node", "family"), "families")
    unstage(members)

    mine = classes.join(family, "node").select("family", "node", "low", "d1", "d2", "n", "sig")
    sizes = mine.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / WEIGHT)).cast("int").alias("parts"))
    mine = staged(mine.join(sizes, "family"), "candidates")

    def set_rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                sets = shingle_sets(batch.column(0).slice(i, 200).to_pylist(), width)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                halves = [pa.array([int.from_bytes(d[k : k + 8], "little", signed=True) for d in digest], pa.int64()) for k in (0, 8)]
                yield pa.RecordBatch.from_arrays([*halves, pa.array([pack(s) for s in sets], pa.binary())], ["e1", "e2", "members"])

    # texts are dealt by id at every size of the candidates, and not sorted
    held = rows.join(mine.select(F.col("low").alias("id")).distinct().hint("shuffle_hash"), "id", "left_semi").select("text")
    sets = held.mapInArrow(set_rows, "e1 long, e2 long, members binary").dropDuplicates(["e1", "e2"])
    full = staged(mine.join(sets, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).select("family", "parts", "node", "n", "sig", "members"), "sets")
    small = full.where("parts = 1").select("family", F.lit(0).alias("part"), "node", "sig", "members")
    links = small.repartition("family").sortWithinPartitions("family").mapInArrow(_links(threshold), "a long, b long")
    large = full.where("parts > 1")
    if large.take(1):
        links = links.union(_large(large, threshold))
    comp = staged(components(links).toDF("node", "comp"), "components")
    unstage(full)

    named = classes.join(comp, "node", "left").select("d1", "d2", "low", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("low").alias("component"))
    out = sketch.join(staged(named.join(least, "comp").select("d1", "d2", "component"), "named"), ["d1", "d2"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
