"""Per-document token frequencies joined to a value of each distinct token, without a row for each occurrence.

Documents are taken in blocks of bounded text. A block keeps its distinct tokens once, dealt to buckets by hash, and its
documents' frequencies as compressed (token, count) lists. All blocks' lists of one bucket meet in one task, which
computes the value of each distinct token of the corpus exactly once; the values go back to their blocks, where each
document's sums are taken. However common, a token is one entry a block, so no key is hot.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resgraph.llm.common import staged

BLOCK_CHARS = 12_000_000
BUCKET_BYTES = 12 << 20  # of input to a bucket
SCHEMA = "block long, bucket int, tokens binary, counts binary"
VALUES = "block long, bucket int, values binary, n_types long, n_counted long, top array<struct<token: string, n: long>>, bands array<long>"
BANDS = 64  # counts by bit length
_squeeze = zstandard.ZstdCompressor(level=3).compress
_spread = zstandard.decompress


def pack(values: np.ndarray) -> bytes:
    """Integers, compressed: the low byte of all, then the next, as many as the largest needs."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + _squeeze(np.ascontiguousarray(raw[:, :width].T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(_spread(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1).astype(np.int64)


def _raw(token: str | bytes) -> bytes:
    return token if isinstance(token, bytes) else token.encode("utf-8", "surrogatepass")


def pack_tokens(tokens: list[str] | list[bytes]) -> bytes:
    raw = [_raw(t) for t in tokens]
    sizes = pack(np.array([len(r) for r in raw], np.int64))
    return len(sizes).to_bytes(4, "little") + sizes + _squeeze(b"".join(raw))


def unpack_tokens(data: bytes) -> list[str]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpack(data[4 : 4 + n])).tolist()
    flat = _spread(data[4 + n :])
    return [flat[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends, strict=False)]


def buckets(docs: DataFrame) -> int:
    """As many buckets as keep each near BUCKET_BYTES of the input, and no fewer than shuffle partitions."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, size // BUCKET_BYTES) if size < 1 << 55 else least


def blocks(docs: DataFrame, split: Callable[[str], Iterable[str] | Iterable[bytes]], n_buckets: int, counted: Callable[[int | None], bool] = lambda i: False, extra: Callable[[str], int] = len, ordered: bool = False) -> DataFrame:
    """The block table of docs (id long, text string).

    Rows with bucket >= 0 hold a block's tokens in it, with how often counted documents have each; the row with bucket -1
    holds the documents: ids, ``extra`` of the text, tokens of each (distinct), token numbers as gaps, frequencies; or, ordered,
    the tokens of each and their numbers in order of the text. ``split`` gives tokens, or their UTF-8 bytes.
    """

    def block(part: list[tuple[int | None, str]], number: int) -> pa.RecordBatch:
        code: dict[str | bytes, int] = defaultdict(count().__next__)  # a token's number is how many came before
        tok = [np.fromiter(map(code.__getitem__, split(text)), np.int64) for _, text in part]
        sizes = np.array([len(t) for t in tok], np.int64)
        doc = np.repeat(np.arange(len(part)), sizes)
        names = [_raw(t) for t in code]
        where = np.fromiter((xxhash.xxh64_intdigest(t) % n_buckets for t in names), np.int64, len(names))
        order = np.argsort(where, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        said = rank[np.concatenate(tok)]
        is_counted = np.array([counted(i) for i, _ in part], bool)
        bounds = np.searchsorted(where[order], np.arange(n_buckets + 1))
        if ordered:
            mass = np.bincount(said, weights=is_counted[doc], minlength=len(names)).astype(np.int64)
            counts = [pack(sizes), pack(said)]
        else:
            pairs, n = np.unique(doc * max(1, len(names)) + said, return_counts=True)
            d_of, t_of = np.divmod(pairs, max(1, len(names)))
            mass = np.bincount(t_of, weights=n * is_counted[d_of], minlength=len(names)).astype(np.int64)
            gap = np.diff(t_of, prepend=0)
            first = np.flatnonzero(np.diff(d_of, prepend=-1))
            gap[first] = t_of[first]
            counts = [pack(np.bincount(d_of, minlength=len(part))), pack(gap), pack(n)]
        rows = [(number, -1, _head(part, extra), b"".join(len(c).to_bytes(4, "little") + c for c in counts))]
        named = [names[i] for i in order]
        for b in range(n_buckets):
            i, j = int(bounds[b]), int(bounds[b + 1])
            if i < j:
                rows.append((number, b, pack_tokens(named[i:j]), pack(mass[i:j])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "bucket", "tokens", "counts"])

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        part, size = [], 0
        for batch in batches:
            for i, said in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = said.as_py() or ""
                if part and size + len(text) > BLOCK_CHARS:
                    yield block(part, number)
                    part, size, number = [], 0, number + 1
                part.append((i, text))
                size += len(text)
        if part:
            yield block(part, number)

    return staged(docs.mapInArrow(run, SCHEMA), "blocks")


def _head(part: list[tuple[int | None, str]], extra: Callable[[str], int]) -> bytes:
    ids = np.array([0 if i is None else i for i, _ in part], "<i8")
    none = np.array([i is None for i, _ in part], np.uint8)
    return len(part).to_bytes(4, "little") + _squeeze(ids.tobytes() + none.tobytes() + np.array([extra(t) for _, t in part], "<i8").tobytes())


def resolve(table: DataFrame, value: Callable[[list[str], np.ndarray], np.ndarray] | None, top: int = 0) -> DataFrame:
    """Once for each distinct token: value(tokens, counts over counted documents), sent back to every block that has it.

    On one row a bucket, n_types and n_counted sum up its tokens with a count and their counts, bands has the counts by
    bit length of the count, and top has its ``top`` most frequent tokens. Without value, only these.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block", kind="stable")
        code: dict[str, int] = {}
        mine, mass = [], []
        for tokens, counts in zip(group["tokens"], group["counts"], strict=True):
            mine.append(np.array([code.setdefault(t, len(code)) for t in unpack_tokens(tokens)], np.int64))
            mass.append(unpack(counts))
        total = np.bincount(np.concatenate(mine), weights=np.concatenate(mass), minlength=len(code)).astype(np.int64)
        bands = np.bincount([int(x).bit_length() for x in total], weights=total, minlength=BANDS).astype(np.int64).tolist()
        names = list(code)
        best = sorted(zip((-total).tolist(), names, strict=True))[:top] if top else []
        first = {"n_types": int((total > 0).sum()), "n_counted": int(total.sum()), "top": [{"token": t, "n": -c} for c, t in best if c], "bands": bands}
        if value is None:
            return pd.DataFrame([{"block": 0, "bucket": int(group["bucket"].iloc[0]), "values": b"", **first}])
        found = np.asarray(value(names, total), np.int64)
        out = pd.DataFrame({"block": group["block"].to_numpy(), "bucket": group["bucket"].to_numpy(), "values": [pack(found[m]) for m in mine], "n_types": 0, "n_counted": 0, "top": None, "bands": None})
        return out

    return table.where("bucket >= 0").groupBy("bucket").applyInPandas(run, VALUES)


def finish(table: DataFrame, values: DataFrame, make: Callable[[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """For each block, make(frame of id and extra, value of each token listed, its document's row, its frequency)."""
    head = table.where("bucket < 0").select("block", "bucket", F.col("tokens").alias("a"), F.col("counts").alias("b"))
    both = head.unionByName(values.select("block", "bucket", F.col("values").alias("a"), F.lit(None).cast("binary").alias("b")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bucket", kind="stable")
        data = group["a"].tolist()
        n = int.from_bytes(data[0][:4], "little")
        raw = _spread(data[0][4:])
        ids, none, extra = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<i8", n, 9 * n)
        packed, parts = group["b"].iloc[0], []
        while packed:
            k = int.from_bytes(packed[:4], "little")
            parts.append(unpack(packed[4 : 4 + k]))
            packed = packed[4 + k :]
        value = np.concatenate([unpack(v) for v in data[1:]]) if len(data) > 1 else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(n), parts[0])
        if len(parts) == 2:
            token, freq = parts[1], np.ones(len(parts[1]), np.int64)
        else:
            per, gap, freq = parts
            runs, first = np.cumsum(gap), (np.cumsum(per) - per)[per > 0]
            base = np.zeros(n, np.int64)
            base[per > 0] = (runs - gap)[first]
            token = runs - base[doc]
        return make(pd.DataFrame({"id": pd.Series(ids, dtype="Int64").mask(none.astype(bool)), "extra": extra}), value[token], doc, freq)

    return both.groupBy("block").applyInPandas(run, schema)
