"""Quality rules as a bitmask ledger: each rule is evaluated once, policies and ablations are bit arithmetic.

Measurements of a text (null: as empty): words are runs of other than ASCII white space.
Empty text measures 0 everywhere and fails ``few_words``; very long texts are measured whole. Ties and repeated rows don't
matter: the ledger is a column of each row, no other column is read, and one of the ledger's name is replaced. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
WINDOW = 8
_every = bytes(range(256))
_not_symbols = bytes(c for c in _every if c not in SYMBOLS)
_no_point = WHITE + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a code point
_not_upper = bytes(c for c in _every if not 65 <= c <= 90)
_not_lower = bytes(c for c in _every if not 97 <= c <= 122)


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements (columns, or series) holds."""

    name: str
    fails: Callable


#: Bit i of the ledger belongs to rule i; rules are only ever appended, so stored ledgers stay readable.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_words", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 30),
    Rule("symbols", lambda m: m["n_symbols"] * 10 > m["n_words"]),
    Rule("short_words", lambda m: m["word_chars"] < m["n_words"] * 2),
    Rule("long_words", lambda m: m["word_chars"] > m["n_words"] * 25),
    Rule("repeated_lines", lambda m: m["n_dup_lines"] * 100 > m["n_lines"] * 40),
    Rule("shouting", lambda m: m["n_upper"] * 100 > (m["n_upper"] + m["n_lower"]) * 40),
)
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "v1": BASE,
    "v2": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    bit = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << bit[name] for name in POLICIES[policy])


def _repeats(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For documents laid end to end (word codes; words of each), words inside windows that their document has twice."""
    total = len(words)
    out = np.zeros(len(n), np.int64)
    if total < WINDOW:
        return out
    doc = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(total)  # words from here to the document's end
    code, size = words.astype(np.int64), 1
    while size < WINDOW:  # codes of windows of 2, 4 and 8 words; each step names pairs exactly
        nxt = np.roll(code, -size)
        code = pd.factorize(code * (int(code.max()) + 1) + nxt)[0]
        size *= 2
    code = pd.factorize(code * len(n) + doc)[0]
    full = left >= WINDOW
    often = np.bincount(code[full], minlength=int(code.max()) + 1)
    start = full & (often[code] > 1)
    change = np.zeros(total + WINDOW, np.int64)
    np.add.at(change, np.flatnonzero(start), 1)
    np.add.at(change, np.flatnonzero(start) + WINDOW, -1)
    covered = np.cumsum(change)[:total] > 0
    return np.bincount(doc[covered], minlength=len(n))


def measure(texts: list[str | None]) -> pd.DataFrame:
    """MEASURES of each text."""
    rows, words, code, counts = [], [], {}, []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        mine = raw.split()
        lines = [line for line in raw.split(b"\n") if line.strip(WHITE)]
        words += [code.setdefault(w, len(code)) for w in mine]
        counts.append(len(mine))
        rows.append((len(mine), len(raw.translate(None, _no_point)), len(raw.translate(None, _not_symbols)), len(lines) - len(set(lines)), 0, len(lines), len(raw.translate(None, _not_upper)), len(raw.translate(None, _not_lower))))
    out = pd.DataFrame(rows, columns=list(MEASURES), dtype="int64")
    out["n_repeat_words"] = _repeats(np.array(words, np.int64), np.array(counts, np.int64))
    return out


def _measured(texts: pd.Series) -> pd.DataFrame:
    held = texts.tolist()
    return pd.concat([measure(held[i : i + 250]) for i in range(0, len(held), 250)] or [measure([])], ignore_index=True)


def ledger(docs: DataFrame, text: str = "text", name: str = "quality") -> DataFrame:
    """docs with a struct column ``name``: the measurements and fail_bits (bit i: rule i fails)."""
    udf = F.pandas_udf(_measured, ", ".join(f"{m} long" for m in MEASURES)).asNondeterministic()
    measured = docs.withColumn(name, udf(F.col(f"`{text}`").cast("string")))
    fields = {m: F.col(f"`{name}`.{m}") for m in MEASURES}
    return measured.withColumn(name, F.struct(*(c.alias(m) for m, c in fields.items()), fail_bits(fields).alias("fail_bits")))


def fail_bits(fields: dict[str, Column]) -> Column:
    """The ledger's bits over the given measurement columns."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.fails(fields), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def passes(bits: Column, policy: str = "v2") -> Column:
    """True where no rule of the policy failed."""
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(bits: DataFrame, column: str = "fail_bits", policy: str = "v2") -> DataFrame:
    """For each rule of a policy: rows failing it, and rows that only it rejects (kept if it were dropped)."""
    chosen = bits.select(F.col(f"`{column}`").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    picks = [(r.name, 1 << i) for i, r in enumerate(RULES) if r.name in POLICIES[policy]]
    rows = chosen.select("b", "n", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in picks))).alias("r"))
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("failing"),
        F.coalesce(F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("only_this"),
    )
