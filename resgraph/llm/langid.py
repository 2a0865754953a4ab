"""Language identification with a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, ridge one-vs-rest.

A text is the set of its character 1- to 3-grams (lower case), each hashed to one of DIM bins. The kernel of two texts
is the number of bins that both have over the root of the product of their numbers of bins. LANDMARKS training texts
span the feature space; kernel ridge regression in it gives a +1/-1 output for each language, and a batch of texts is
scored by two matrix products: presence by landmarks, kernel by coefficients.

Null or empty texts and those without a letter get ``und`` and score 0, as do all texts where nothing could be learned.
The score is the winning output mapped from [-1, 1] to [0, 1]. Ties go to the language first in code point order.
Training takes at most ``per_language`` texts of each language, those of least hash of id, whole and one slice of each;
everything else is read once, whole, however long. Repeated rows are judged each and may be learned from each. An empty
table gives no rows. Extra columns aren't read; one of the result's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 1 << 14
LANDMARKS = 256
PER_LANGUAGE = 500
RIDGE = 1e-2
SLICE = 80
BLOCK = 128
BATCH_CHARS = 400_000
UNKNOWN = "und"


def presence(texts: list[str]) -> np.ndarray:
    """Texts by bins: 1 where a text has an n-gram of the bin."""
    raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    out = np.zeros((len(texts), DIM), np.uint8)
    if not texts:
        return out
    doc = np.repeat(np.arange(len(texts)), [len(r) for r in raw])
    points = np.concatenate(raw).astype(np.uint64)
    flat = out.reshape(-1)
    code = np.zeros(len(points), np.uint64)
    for n in range(1, 4):
        if len(points) < n:
            break
        code = code[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bins = (mixed >> np.uint64(50)).astype(np.int64)
        inside = doc[: len(code)] == doc[n - 1 :]
        flat[(doc[: len(code)] * DIM + bins)[inside]] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed presence of each landmark
    weights: np.ndarray  # landmarks by languages

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, np.unpackbits(self.landmarks, axis=1)) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text, in batches of bounded length."""
        said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return said, score
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        root = np.sqrt(marks.sum(axis=1))
        todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        while todo:
            part, size = [], 0
            while todo and len(part) < 64 and (not part or size + len(texts[todo[-1]]) <= BATCH_CHARS):
                part.append(todo.pop())
                size += len(texts[part[-1]])
            x = presence([texts[i] for i in part])
            k = x.astype(np.float32) @ marks.T / (np.sqrt(x.sum(axis=1, dtype=np.int64))[:, None] * root)
            f = k @ self.weights
            for i, best, top in zip(part, f.argmax(axis=1).tolist(), f.max(axis=1).tolist(), strict=True):
                said[i], score[i] = self.languages[best], min(1.0, max(0.0, (top + 1) / 2))
        return said, score


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = x.astype(np.float32), y.astype(np.float32)
    return a @ b.T / np.maximum(1e-9, np.sqrt(a.sum(axis=1))[:, None] * np.sqrt(b.sum(axis=1)))


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nystroem features over landmarks dealt evenly to the languages, and ridge regression to +1/-1 for each.

    bits holds the packed presence of each training text; it is unpacked BLOCK rows at a time.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, DIM // 8), np.uint8), np.zeros((0, 0), np.float32))
    at = {lang: [i for i, y in enumerate(labels) if y == lang] for lang in languages}
    each = max(1, landmarks // len(languages))
    chosen = [i for lang in languages for i in at[lang][:: max(1, len(at[lang]) // each)][:each]]
    marks = np.unpackbits(bits[chosen], axis=1)
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.concatenate([kernel(np.unpackbits(bits[i : i + BLOCK], axis=1), marks) @ root for i in range(0, len(bits), BLOCK)])
    y = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    balance = 1.0 / np.array([len(at[lab]) for lab in labels])  # languages weigh alike
    zw = z * balance[:, None]
    w = np.linalg.solve(z.T @ zw + ridge * np.trace(z.T @ zw) / z.shape[1] * np.eye(z.shape[1]), zw.T @ y)
    return Model(languages, np.packbits(marks, axis=1), (root @ w).astype(np.float32))


def remainder(id: Column, mod: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % mod


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from docs (all of them: leave held-out rows out beforehand) with a text and a language."""
    rows = docs.select(F.col(f"`{id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null and length(text) > 0")
    spot = F.xxhash64(F.lit("langid"), "id")
    # thin each language to about three times its share by hash before ranking, so no task ranks a whole language;
    # one count a language comes to the driver, as the model itself holds one column a language
    counts = dict(rows.groupBy("lang").count().collect())
    most = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, -(-3 * per_language * (1 << 20) // n))]) if counts else F.create_map(F.lit(""), F.lit(0))
    near = rows.select("lang", "text", spot.alias("spot")).where(F.pmod("spot", F.lit(1 << 20)) < most[F.col("lang")])
    first = near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("spot", "text"))).where(F.col("nth") <= per_language)

    def bits(batches):
        for part in batches:
            texts = part["text"].tolist()
            cut = [t[(k := s % max(1, len(t) - SLICE)) : k + SLICE] for t, s in zip(texts, part["spot"].tolist(), strict=True)]
            for kind, held in enumerate((texts, cut)):
                x = np.concatenate([np.packbits(presence([t]), axis=1) for t in held])
                yield pd.DataFrame({"lang": part["lang"], "spot": part["spot"], "kind": kind, "bits": [r.tobytes() for r in x]})

    got = first.select("lang", "text", "spot").mapInPandas(bits, "lang string, spot long, kind int, bits binary").toPandas()
    got = got.sort_values(["kind", "lang", "spot", "bits"], kind="stable")
    return fit(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(-1, DIM // 8), got["lang"].tolist())


def identify(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """docs with a struct column ``name``: lang_pred and score."""

    def run(texts: pd.Series) -> pd.DataFrame:
        said, score = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": said, "score": score})

    udf = F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()
    return docs.withColumn(name, udf(F.col(f"`{text}`").cast("string")))
