"""Corpus operators against brute force on small tables, and on empty tables, repeated rows and odd columns."""

from __future__ import annotations

import itertools
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from resgraph.llm import bitplane, blockdict, bpe_automaton, common, gru_lm, hnsw, langid, mixing, quality, token_counts, url_rules

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    common.prepare(spark)


def test_mined_rules_equal_enumerated_itemsets(spark):
    rng = random.Random(7)
    hosts, steps = ["a", "b", "c", "d"], ["x", "y", "z"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(steps)}/{rng.choice(steps)}" for _ in range(160)]
    bad = [("//a/" in u and "/x" in u) or rng.random() < 0.2 for u in urls]
    least, sure = 4, 0.6
    labelled = spark.createDataFrame(list(zip(urls, bad, strict=True)), "url string, bad boolean")
    words = {r.url: frozenset(r.t) for r in labelled.select("url", url_rules.tokens(F.col("url")).alias("t")).distinct().collect()}
    held, blocked = {}, {}
    for u, b in zip(urls, bad, strict=True):
        for n in range(1, len(words[u]) + 1):
            for items in itertools.combinations(sorted(words[u]), n):
                key = frozenset(items)
                held[key] = held.get(key, 0) + 1
                blocked[key] = blocked.get(key, 0) + b
    rules = {k: blocked[k] / held[k] for k in held if blocked[k] >= least and blocked[k] / held[k] >= sure}
    right = {k: c for k, c in rules.items() if not any(rules.get(k - {x}, -1) >= c for x in k)}
    mined = url_rules.mine(labelled, min_support=1e-6, min_confidence=sure, min_count=least)
    got = {frozenset(r.antecedent): (r.confidence, r.support, r.key) for r in mined.collect()}
    assert right and {k: pytest.approx(c) for k, c in right.items()} == {k: v[0] for k, v in got.items()}
    assert all(v[1] == blocked[k] and v[2] in k and held[frozenset([v[2]])] == min(held[frozenset([x])] for x in k) for k, v in got.items())
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    verdicts = {r.id: (r.verdict, r.confidence) for r in url_rules.judge(pages, mined, fixed=()).collect()}
    for i, u in enumerate(urls):
        best = max((c for k, c in right.items() if k <= words[u]), default=None)
        assert verdicts[i][0] == ("allow" if best is None else "block") and verdicts[i][1] == (None if best is None else pytest.approx(best))


def test_rules_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/en/", "clash")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = url_rules.mine(url_rules.labelled(pages, labels))
    assert rules.count() == 0
    assert [(r.id, r.host, r.verdict) for r in url_rules.judge(pages, rules).collect()] == [(1, "a.example.com", "block")]
    assert url_rules.judge(pages.where("false"), rules).count() == 0


def test_mix_of_repeated_and_null_ids(spark):
    rows = [(None, f"{'w ' * (i % 7)}{i}", "a") for i in range(300)] + [(5, "w " * (i % 11), "b") for i in range(300)] + [(6, "same row", None)] * 200
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, n int")
    mixed = mixing.mix(table, block=32).toPandas()
    for _, part in mixed.groupby("target"):
        assert abs((part["size"] * part["copies"]).sum() - part["target"].iloc[0]) <= 20
    size = (mixed["size"] * mixed["copies"]).sum()
    got = mixing.taken(table, block=32)
    assert got.columns == table.columns and got.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == size
    plan = mixed.groupby("code")["copies"].sum().to_dict()
    seen = {r.code: r["count"] for r in got.groupBy(mixing.row_code("doc_id", "source", "text").alias("code")).count().collect()}
    assert seen == {k: v for k, v in plan.items() if v}


def test_ablation_by_brute_force(spark):
    bits = [random.Random(3).randrange(128) if i % 3 else 1 << (i % 7) for i in range(200)]
    table = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    for policy in quality.POLICIES:
        chosen = quality.mask(policy)
        got = {r.rule: (r.failing, r.only_this) for r in quality.ablation(table, policy=policy).collect()}
        for i, rule in enumerate(quality.RULES):
            if rule.name in quality.POLICIES[policy]:
                assert got[rule.name] == (sum(b >> i & 1 for b in bits), sum(b & chosen == 1 << i for b in bits))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert bpe_automaton.encode(none, WORD).count() == token_counts.token_counts(none, BYTE).count() == gru_lm.scores(none).count() == 0
    assert langid.identify(none, langid.train(none)).count() == mixing.taken(none).count() == 0
    assert hnsw.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(i % 3, ["a b", "a b", None][i % 3], "en", 1, 2, "x") for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, id int, size string")
    each = len(Tokenizer.from_file(BYTE).encode("a b", add_special_tokens=False).ids)
    assert sorted(r.n_tokens for r in token_counts.token_counts(table, BYTE).collect()) == [0] * 3 + [each] * 6
    assert gru_lm.scores(table).count() == 9
    coded = bpe_automaton.encode(table, WORD)
    assert coded.count() == 9 and coded.select("n_tokens", "id", "size").distinct().count() == 1
    found = langid.identify(table, langid.train(table))
    assert found.count() == 9 and {r.lang_pred for r in found.where("text is null").select("language.lang_pred").collect()} == {"und"}


def test_documents_over_chunks_and_blocks(spark):
    """A text of more ids than a chunk holds, and more characters than a block, between short ones."""
    long = " ".join(random.Random(1).choice(["alpha", "beta", "12", "é"]) for _ in range(max(70_000, blockdict.BLOCK_CHARS // 4)))
    texts = ["first", long, None, "last"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(BYTE)
    sizes = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert sizes[1] > bitplane.CHUNK
    assert {r.id: r.n_tokens for r in token_counts.token_counts(table, BYTE).collect()} == dict(enumerate(sizes))
    got = {r.doc_id: (r.start, r.n_tokens) for r in bitplane.round_trip(table, BYTE).collect()}
    assert got == {i: (sum(sizes[:i]) + i, sizes[i] + 1) for i in range(len(texts))}
