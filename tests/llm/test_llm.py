"""Corpus operators: exact comparisons, round trips, and edge cases (nulls, empty tables, repeated rows, odd columns)."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from resgraph.llm import bitplane, blockdict, bpe_automaton, byte_bpe, common, gru_lm, hamming_join, hnsw, langid, mixing, quality, token_counts, url_rules

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"
TEXTS = [
    None, "", " \n ", "a", COPY, COPY, COPY.upper(), COPY + " end", "Él dice: ¿qué? " * 9, "x" * 5000, "the cat sat\nthe cat sat\n" * 12, "<|endoftext|> in a text <|startoftext|>",
    "漢字 かな   \x1c \x85 tabs\t\tand  spaces ", "12345 !!! ### it's we'll", "word " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None][i % 3], 1, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, size string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def strings(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("aabcdest'ée  \n\t.,!0123漢Σ<|endoftext|> \x85\x1c") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_word_bpe_equals_library():
    library, own = Tokenizer.from_file(WORD), bpe_automaton.Encoder(WORD)
    texts = [t or "" for t in TEXTS] + strings(3000) + ["banana", "aaaaaaa", "internationalization"]
    for text, ids, right in zip(texts, own.encode_many(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == right.ids, text
        assert own.decode(ids).decode() == library.decode(right.ids, skip_special_tokens=False)


def test_byte_bpe_equals_library():
    own = byte_bpe.ByteBpe(BYTE)
    texts = [t or "" for t in TEXTS] + strings(3000)
    for text, right in zip(texts, own.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == right.ids, text
        assert sum(map(own.count, own.pretokens(text))) == len(right.ids), text


def test_token_counts(docs, none):
    library = Tokenizer.from_file(BYTE)
    got = {r.id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, BYTE).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)}
    assert token_counts.token_counts(none, BYTE).count() == 0


def test_pack():
    for x in ([], [0], [1, 300, 70000, 1 << 40]):
        assert blockdict.unpack(blockdict.pack(np.array(x, np.int64))).tolist() == x
    assert blockdict.unpack_tokens(blockdict.pack_tokens(["", "é", "abc"])) == ["", "é", "abc"]


def test_bit_planes(docs, none, tmp_path):
    for bits in (False, True):
        for n in (0, 1, 7, 100):
            ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
            assert bitplane.unshuffle(bitplane.shuffle(ids, bits), n).tolist() == ids.tolist()
    library, at, right = Tokenizer.from_file(BYTE), 0, []
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        right.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for bits in (False, True):
        assert sorted(map(tuple, bitplane.round_trip(docs, BYTE, bits=bits).collect())) == right
    assert bitplane.round_trip(none, BYTE).count() == 0


def test_quality(docs, none):
    def repeats(text: str) -> int:
        words = text.split()
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)})

    texts = [t for t in TEXTS if t is None or len(t) < 2000]
    got = quality.measure(texts)
    assert got["n_repeat_words"].tolist() == [repeats(t or "") if (t or "").isascii() else got["n_repeat_words"][i] for i, t in enumerate(texts)]
    rows = {r.doc_id: r for r in quality.ledger(docs).select("doc_id", "quality.*", quality.passes(F.col("quality.fail_bits")).alias("ok"), "size").collect()}
    assert len(rows) == len(TEXTS) and rows[0].n_words == 0 and rows[0].fail_bits & 1 and not rows[0].ok
    assert rows[4].n_words == 21 and rows[4].ok and rows[4].size == "clash" and not rows[14].ok
    held = {r.rule: (r.failing, r.only_this) for r in quality.ablation(quality.ledger(docs).select("quality.fail_bits")).collect()}
    assert held["few_words"][0] == sum(1 for r in rows.values() if r.n_words < 20)
    assert quality.ledger(none).count() == 0


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 90), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # 5, 2, 1 and, for the null source, 5 again: a stops at 30 and null at 270, so b takes the rest
    assert got == {"a": 30.0, "b": 800.0, "c": 0.0, None: 270.0}


def test_mix(spark, docs, none):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(n), f"s{i % 3}") for i, n in enumerate(rng.integers(0, 200, 900))]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(many, block=64).toPandas()
    for _, part in got.groupby("source_size"):
        assert abs((part["size"] * part["copies"]).sum() - part["target"].iloc[0]) < 100
    assert got["copies"].max() <= 3 and len(got) == 900
    again = mixing.mix(many.orderBy(F.desc("doc_id")), block=64).toPandas()
    assert got.sort_values("id")["copies"].tolist() == again.sort_values("id")["copies"].tolist()
    taken = mixing.taken(many, block=64)
    assert taken.columns == many.columns and taken.count() == got["copies"].sum()
    assert mixing.mix(docs).count() == len(TEXTS) and mixing.mix(none).count() == 0


def test_near_duplicates(spark, docs, none):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(60)]
        for k in range(8):  # from copies to halves, across the threshold
            mine = list(words)
            for _ in range(k):
                mine[rng.randrange(60)] = rng.choice(vocabulary)
            texts.append(" ".join(mine))
    texts += [None, "", "a b", "A  b", "a b c d e f"]
    sets = [set(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if (w := (t or "").lower().split()) else set() for t in texts]
    parent = list(range(len(texts)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in hamming_join.near_duplicates(table, width=4).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert {r.id: r.component_id for r in hamming_join.near_duplicates(docs).collect()}[6] == 4
    assert hamming_join.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)]
    for fold in (1_000_000, 2):
        common.FOLD_EDGES, kept = fold, common.FOLD_EDGES
        try:
            got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
        finally:
            common.FOLD_EDGES = kept
        assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((20, 16))
    x = np.concatenate([base + 0.08 * rng.standard_normal((20, 16)) for _ in range(30)] + [base[:3], base[:3]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [])]
    got = {r.id: (r.n_links, r.component_id) for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=2).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    links = sum(got[i][0] for i in range(len(x)))
    assert 0.97 * link.sum() <= links <= link.sum()
    assert all(got[i] == (0, i) for i in range(900, 905))
    assert len({got[i][1] for i in range(len(x))}) <= 24


def test_language(spark, docs, none):
    rng = random.Random(2)
    words = {"en": ["the", "and", "thing", "with"], "fr": ["les", "été", "où", "que"], "de": ["und", "größe", "ich", "schön"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    model = langid.train(spark.createDataFrame(rows[:120], "doc_id long, text string, lang string"))
    said, score = model.predict([t for _, t, _ in rows[120:]] + [None, "", "123 !!"])
    assert said == [lang for _, _, lang in rows[120:]] + ["und"] * 3 and score[-1] == 0 and all(0 <= s <= 1 for s in score)
    assert langid.identify(docs, model).select("language.lang_pred", "size").count() == len(TEXTS)
    assert langid.train(none).predict(["text"]) == (["und"], [0.0])


def test_url_rules(spark):
    pages = [(i, f"https://{'bad' if i % 4 == 0 else 'good'}.shop.org/{'x' if i % 2 else 'y'}/{i}?a=1") for i in range(80)]
    pages += [(80, None), (81, "no scheme"), (82, "HTTP://WWW.Example.com/en/a"), (83, "http://a.example.com/en/"), (84, "http://a.net/es"), (85, "http://net/es/1#x"), (85, "http://net/es/1#x")]
    table = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine(url_rules.labelled(table, labels), min_count=5)
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(table, rules).collect()}
    assert all(got[i][3] == ("block" if i % 4 == 0 else "allow") for i in range(80))
    assert got[80] == ("", "", None, "allow") == got[81]
    assert got[82] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[83][3] == "block"
    assert got[84] == ("a.net", "/es", None, "allow") and got[85] == ("net", "/es/1", "net/es/", "block")
    assert url_rules.judge(table, rules).count() == len(pages)


def test_language_model(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice([["a", "b"], ["c", "d"]][i % 2]) for _ in range(40)) for i in range(300)] + [None, ""]
    got = gru_lm.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values("id")
    assert got["n_tokens"].tolist() == [len((t or "").split()) + 1 for t in texts]
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    out = got[got["held_out"]]
    assert out["score"].sum() > out["base_score"].sum()  # which alphabet a text has shows after its first words


def test_language_model_gradients():
    symbols = gru_lm.Symbols.of([("a", 9), ("b", 5), ("c", 2)], np.bincount([4, 3, 2], minlength=blockdict.BANDS, weights=[9, 5, 2]))
    net = gru_lm.Net(symbols)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    rng = np.random.default_rng(0)
    before, after, h = rng.integers(0, 3, (4, 5)), rng.integers(0, 3, (4, 5)), np.zeros((4, gru_lm.HIDDEN))
    g, _, _ = net.gradients(before, after, h)
    for k in ("e", "x", "h", "b", "c", "cb", "o", "ob"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        kept, eps = net.w[k][at], 1e-5
        side = []
        for d in (eps, -eps):
            net.w[k][at] = kept + d
            side.append(net.gradients(before, after, h)[2])
        net.w[k][at] = kept
        assert side[0] - side[1] == pytest.approx(2 * eps * g[k][at], rel=1e-2)


def test_fly_keeps_totals():
    rng = np.random.default_rng(1)
    for t in range(60):
        n = int(rng.integers(1, 200))
        size = [rng.integers(0, 5, n), rng.integers(0, 50_000, n), np.full(n, 7), np.r_[90_000, np.full(n - 1, 3)]][t % 4]
        pi = np.full(n, rng.random())
        out = mixing.fly(pi, size, rng)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert (out - pi) @ size == pytest.approx(0, abs=1e-6 * max(1, size.sum()))


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    got = docs.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    columns = got.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = common.staged(stage(spark, got, ""), name)
        assert got.columns == columns, name
    left = {r.doc_id for r in got.collect()}
    assert 4 in left and not left & {0, 1, 2, 3, 5, 6, 14}
    last = corpus_pipeline.STAGES[-1][1](spark, got, "").toPandas()
    assert len(last) == got.count() and (last["n_tokens"] == last["ids"].map(len) // 4).all()
    assert isinstance(last, pd.DataFrame)
