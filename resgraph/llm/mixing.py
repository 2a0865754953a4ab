"""Mixing sources to target weights by cube-method balanced sampling (Deville and Tille, 2004).

A source with size S and target T takes each of its documents floor(T/S) times for certain and once more with
probability T/S - floor(T/S). The cube method turns these fractions into 0 or 1: inside blocks of bounded size it moves
the vector of fractions along the null space of two constraints (words taken, documents taken) until at most as many
fractions as constraints are left; those are gathered into new blocks, level by level, until one block a source is left.
Its landing problem, at most two small documents, is rounded to the nearest word total.

A null or empty text has size 0; a null source is a source of its own, last in order. A source of size 0 has target 0
and takes nothing. Repeated rows count as documents of their own. The same rows give the same result in any order: blocks
are salted by id, source and text, so null or repeated ids spread over blocks like others.
An empty table gives an empty result. Extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resgraph.llm.common import WORD, staged, unstage

WEIGHTS = (5, 2, 1)
MOST = 3.0
BLOCK = 1024
EPS = 1e-9
FLOWN = "id long, size long, part long, pi double, code long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_code(id: str, source: str, text: str) -> Column:
    """A hash of what the mix knows of a row; it deals rows to blocks and orders them there."""
    return F.xxhash64(F.lit("mix"), F.col(f"`{id}`").cast("long"), F.col(f"`{source}`"), F.col(f"`{text}`").cast("string"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Target of each source, from one row a source (source, source_size).

    Sources by code point, null last, weigh ``weights`` repeating; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight. A source is full at the level L (words a weight) where L * weight reaches
    its stop; with sources ordered by that level, running sums give the final L in one pass.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("stop", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("stop") / F.col("w"))
    # what is left, in words and in weights, once every source of a lower level is full
    low = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(low), F.lit(0.0)))
    rows = rows.withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(low), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left_words") / F.col("left_w"))
    rows = rows.withColumn("nth", F.row_number().over(Window.orderBy("full_at", F.col("source").asc_nulls_last())))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("nth", "level"))).over(every)["level"]  # the first that holds
    return rows.select("source", "source_size", F.least(F.col("stop"), F.col("w") * F.coalesce(level, F.lit(float("inf")))).alias("target"))


def fly(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: pi with at most two entries strictly between 0 and 1.

    The largest document still open leads each step: its unit vector, projected to the null space of the constraints
    over the open documents, is the direction, so the many small ones make up for the few large ones.
    """
    pi = pi.copy()
    order = np.argsort(-size, kind="stable")
    open_ = order[(pi[order] > EPS) & (pi[order] < 1 - EPS)]
    pi[(pi <= EPS)], pi[(pi >= 1 - EPS)] = 0, 1
    while len(open_) > 1:
        off = size[open_] - size[open_].mean()  # orthogonal to the constraint on numbers
        norm = float(off @ off)
        varied = norm > 1e-9 * max(1.0, float(size[open_[0]]) ** 2)
        if len(open_) <= 1 + varied:
            break
        for lead in range(len(open_)):  # almost always the first; a lone odd size can't move
            u = np.full(len(open_), -1.0 / len(open_))
            if varied:
                u -= off * (off[lead] / norm)
            u[lead] += 1.0
            if u[lead] > 1e-9:
                break
        p = pi[open_]
        up, down = u > 1e-12, u < -1e-12
        safe = np.where(up | down, u, 1.0)
        ahead = np.where(up, (1 - p) / safe, np.where(down, -p / safe, np.inf))
        back = np.where(up, p / safe, np.where(down, (p - 1) / safe, np.inf))
        first, last = int(ahead.argmin()), int(back.argmin())
        onward = rng.random() * (ahead[first] + back[last]) < back[last]
        stop = first if onward else last
        p = np.clip(p + (ahead[first] if onward else -back[last]) * u, 0, 1)
        p[stop] = np.round(p[stop])
        p[p < EPS], p[p > 1 - EPS] = 0, 1
        pi[open_] = p
        open_ = open_[(p > 0) & (p < 1)]
    return pi


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing phase: the rounding of the few open fractions whose words come nearest to what they expect."""
    open_ = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    out = np.round(pi)
    if len(open_):
        choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        off = np.abs((choices - pi[open_]) @ size[open_].astype(float))
        far = np.abs((choices - pi[open_]).sum(axis=1))
        out[open_] = choices[np.lexsort((far, off))[0]]
    return out


def _level(last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["code", "id", "size"], kind="stable")
        size = block["size"].to_numpy()
        seed = int(block["code"].iloc[0]) & 0xFFFFFFFF
        pi = fly(block["pi"].to_numpy(), size, np.random.default_rng([seed, len(block)]))
        return block.assign(pi=land(pi, size) if last else pi)[["id", "size", "part", "pi", "code"]]

    return run


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """(id, size, source_size, target, copies, code): how often the mix takes each row of docs; code is its row_code."""
    d = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`").cast("string")).alias("size"), row_code(id, source, text).alias("code"))
    d = staged(d, "sizes")
    sums = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sums.select("source", "source_size"), weights, most).join(sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.select("source", "source_size", "target", F.ceil(F.col("n") / block).alias("blocks"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long").alias("part"))
    plan = staged(plan, "plan")
    rows = d.join(plan.select(F.col("source").alias("s"), "part", "rate", "blocks"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select("id", "size", "part", "blocks", "code", (F.col("rate") - F.floor("rate")).alias("pi"))
    flown = staged(rows.groupBy("part", F.pmod(F.col("code"), F.col("blocks")).alias("b")).applyInPandas(_level(False), FLOWN), "flown")
    done, open_ = [flown.where("pi = 0 or pi = 1")], flown.where("pi > 0 and pi < 1")
    while True:
        widest = open_.groupBy("part").count().agg(F.max("count")).first()[0] or 0
        last = widest <= block
        held = open_.join(open_.groupBy("part").agg(F.ceil(F.count("*") / block).alias("blocks")), "part")
        flown = staged(held.groupBy("part", F.pmod(F.xxhash64("code"), F.col("blocks")).alias("b")).applyInPandas(_level(last), FLOWN), "flown")
        done.append(flown.where("pi = 0 or pi = 1"))
        if last:
            break
        open_ = flown.where("pi > 0 and pi < 1")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    out = out.join(plan, "part")
    return out.select("id", "size", "source_size", "target", (F.floor("rate") + F.col("pi")).cast("long").alias("copies"), "code")


def taken(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies say.

    Rows of one id, source and text share the copies drawn for them, which differ by one at most, in the order of a hash of
    all their columns.
    """
    drawn = mix(docs, id=id, text=text, source=source, **how).groupBy(F.col("id").alias("_mix_id"), F.col("code").alias("_mix_code"))
    drawn = drawn.agg(F.sum("copies").alias("_mix_copies"), F.count("*").alias("_mix_rows"))
    held = docs.withColumn("_mix_row", row_code(id, source, text))
    order = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    held = held.withColumn("_mix_nth", F.row_number().over(Window.partitionBy(F.col(f"`{id}`"), "_mix_row").orderBy(order)))
    held = held.join(drawn, F.col(f"`{id}`").cast("long").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_row") == F.col("_mix_code")))
    copies = F.floor(F.col("_mix_copies") / F.col("_mix_rows")) + (F.col("_mix_nth") <= F.col("_mix_copies") % F.col("_mix_rows")).cast("long")
    return held.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
