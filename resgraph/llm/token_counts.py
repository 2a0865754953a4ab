"""Token counts by distinct pre-token: pieces are counted once for each, joined to frequencies, and summed.

A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each, a null id stays null; extra columns are
not read. Very long texts are one block of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resgraph.llm import blockdict
from resgraph.llm.byte_bpe import byte_bpe


def token_counts(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of docs."""
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    table = blockdict.blocks(rows, lambda t: byte_bpe(vocabulary).pretokens(t), blockdict.buckets(rows), extra=lambda t: len(t.encode("utf-8", "surrogatepass")))

    def pieces(tokens: list[str], _: np.ndarray) -> np.ndarray:
        coder = byte_bpe(vocabulary)
        return np.fromiter(map(coder.count, tokens), np.int64, len(tokens))

    def sums(docs: pd.DataFrame, value: np.ndarray, doc: np.ndarray, freq: np.ndarray) -> pd.DataFrame:
        return docs.assign(n_tokens=np.bincount(doc, weights=value * freq, minlength=len(docs)).astype(np.int64))

    out = blockdict.finish(table, blockdict.resolve(table, pieces), sums, "id long, extra long, n_tokens long")
    return out.select("id", F.col("extra").alias("n_bytes"), "n_tokens")
