"""BPE encoding by a deterministic tokenization automaton (Berglund, Martens and van der Merwe, 2024), and decoding.

The automaton reads tokens: its language is exactly the token sequences that BPE produces. It starts with one state and
a loop for every byte symbol. Each merge (u, v), in order of rank, adds one gadget: a new state q', a copy of the target
q of the arcs labelled u, without the arc v; the arcs u now lead to q', and wherever u could be read there is an arc uv to
the old target of v. So all arcs of one label lead to one state, a state is its parent less one arc, and the table of arcs
is never written out: ``arc`` answers one entry from the gadgets, and a direct-mapped table keeps the entries in use.

Every prefix of a word has one path. ``encode_words`` advances all words of a batch together, one symbol at a time: of the
tokens that end at a position, exactly one has an arc from the state where it begins.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from os.path import commonprefix

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed values of the vocabulary file's pre-tokenizer: contractions, runs of letters, digits, runs of the rest.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
_split = regex.compile(SPLIT)
#: Control characters that Python alone takes for white space, and all outside blocks whose letters have long been settled.
_unsure = re.compile("[^\x00-\x1b\x20-\u052f\u2000-\u206f\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3]")
SLOTS = 1 << 21
CACHE_WORDS = 300_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "</w>"):
        symbols = byte_symbols()
        size = max(vocab.values()) + 1
        self.size = size
        self.labels = [""] * size
        for token, i in vocab.items():
            self.labels[i] = token
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        none = len(merges)
        self.target = [0] * size  # the state that arcs of a label lead to
        self.born = [0] * size  # and the state they led to when the label was made
        self.left, self.made = [-1] * size, [none] * size
        self.owner = [-1]  # of each state: the label whose arcs were turned to it; state k + 1 is the gadget of merge k
        self.gadget: dict[int, int] = {}  # label of the arc's source * size + label removed -> rank
        parts: dict[int, tuple[int, int]] = {}
        for k, (u, v) in enumerate(merges):
            a, b, t = vocab[u], vocab[v], vocab[u + v[: len(v)]]
            after = self.target[b]
            self.owner.append(a)
            self.target[a] = k + 1
            self.gadget[a * size + b] = k
            self.target[t] = self.born[t] = after
            self.left[t], self.made[t] = a, k
            parts[t] = (a, b)
        self._trie(parts)
        self._keys = np.full(SLOTS, -1, np.int64)
        self._arcs = np.zeros(SLOTS, bool)

    def _trie(self, parts: dict[int, tuple[int, int]]) -> None:
        """Tokens as paths of base symbols, in one sorted array of (node, symbol) keys."""
        spelled: dict[int, tuple[int, ...]] = {int(i): (int(i),) for i in [*self.inner, *self.final]}
        for t, (a, b) in parts.items():  # merges come in order, so both parts are known
            spelled[t] = spelled[a] + spelled[b]
        child: dict[int, int] = {}
        token = [-1]
        for t, path in spelled.items():
            node = 0
            for s in path:
                node = child.setdefault(node * self.size + s, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = t
        keys = np.array(sorted(child), np.int64)
        self._child_key, self._child = keys, np.array([child[int(k)] for k in keys], np.int64)
        self._token = np.array(token, np.int64)

    def arc(self, before: int, token: int) -> bool:
        """Is there an arc labelled token from the state that arcs labelled before lead to?"""
        state = self.target[before]
        while state:
            owner, until = self.owner[state], state - 1
            y, made = token, len(self.owner)
            while y >= 0:  # the token, and each token that it was made from by adding to its right
                k = self.gadget.get(owner * self.size + y, -1)
                if 0 <= k <= until and k <= made:
                    return False
                y, made = self.left[y], self.made[y]
            state = self.born[owner]
        return True

    def arcs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The table of arcs at many entries; before -1 is the start state, which has every arc."""
        key = before * self.size + token
        slot = (key ^ (key >> 13)) % SLOTS
        out = self._arcs[slot]
        miss = np.flatnonzero((self._keys[slot] != key) & (before >= 0))
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            size = self.size
            found = np.fromiter((self.arc(k // size, k % size) for k in new.tolist()), bool, len(new))
            out[miss] = found[back]
            at = (new ^ (new >> 13)) % SLOTS
            self._keys[at] = new
            keep = self._keys[at] == new
            self._arcs[at[keep]] = found[keep]
        out[before < 0] = True
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words end to end, and the number of tokens of each; no word is empty."""
        n = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        stop = np.repeat(ends, n)
        # tokens that begin at each position, by the trie
        begin = np.arange(len(raw))
        node = np.zeros(len(raw), np.int64)
        froms, tos, tokens = [], [], []
        depth = 0
        while len(begin):
            key = node * self.size + symbol[begin + depth]
            at = np.minimum(np.searchsorted(self._child_key, key), len(self._child_key) - 1)
            ok = self._child_key[at] == key
            begin, node = begin[ok], self._child[at[ok]]
            depth += 1
            token = self._token[node]
            whole = token >= 0
            froms.append(begin[whole])
            tos.append(begin[whole] + depth)
            tokens.append(token[whole])
            more = begin + depth < stop[begin]
            begin, node = begin[more], node[more]
        frm, to, tok = np.concatenate(froms), np.concatenate(tos), np.concatenate(tokens)
        word_start = np.repeat(starts, n)
        step = to - word_start[frm]
        order = np.argsort(step, kind="stable")
        frm, to, tok, step = frm[order], to[order], tok[order], step[order]
        bounds = np.searchsorted(step, np.arange(1, int(n.max()) + 2))
        # last[p]: the last token of the path over the word up to position p; came[p]: where it begins
        last = np.full(len(raw) + 1, -1, np.int64)
        came = np.zeros(len(raw) + 1, np.int64)
        first = np.zeros(len(raw), bool)
        first[starts] = True
        for k in range(int(n.max())):
            a, b = bounds[k], bounds[k + 1]
            f, t = frm[a:b], tok[a:b]
            ok = self.arcs(np.where(first[f], -1, last[f]), t)
            last[to[a:b][ok]], came[to[a:b][ok]] = t[ok], f[ok]
            # the end of one word is the start of the next; 'first' keeps them apart
        out_word, out_tok = [], []
        at, word = ends.copy(), np.arange(len(words))
        while len(at):
            out_word.append(word)
            out_tok.append(last[at])
            at = came[at]
            more = at > starts[word]
            at, word = at[more], word[more]
        w, t = np.concatenate(out_word[::-1]), np.concatenate(out_tok[::-1])
        back = np.argsort(w, kind="stable")
        return t[back], np.bincount(w, minlength=len(words))


class Encoder:
    """Texts to ids as the vocabulary file's library does, by the automaton; an id list back to text by arc labels."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.labels = list(self.automaton.labels) + [""] * (max([0, *self.special.values()]) + 1 - self.automaton.size)
        for content, i in self.special.items():
            self.labels[i] = content
        self._raw = [x.encode() for x in self.labels]
        self._special_ids = {c: np.array([i], "<u4").tobytes() for c, i in self.special.items()}
        self._opening = commonprefix(list(self.special))  # a text without it has no special string
        self._runs: dict[str, bytes] = {}
        self._library = Tokenizer.from_file(path)  # splits texts with rare characters, whose classes differ by Unicode version

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case of each character by itself; white space is never part of a word, so it stays."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _pieces(self, words: set[str]) -> dict[str, bytes]:
        """Ids of pre-split words, by the automaton in batches of like length."""
        new, out, i = sorted(words, key=len), {}, 0
        while i < len(new):
            part, total = [], 0
            while i < len(new) and (not part or total < 200_000):
                part.append(new[i])
                total += len(new[i])
                i += 1
            ids, n = self.automaton.encode_words([w.encode() for w in part])
            packed, at = ids.astype("<u4").tobytes(), 0
            for w, k in zip(part, n.tolist(), strict=True):
                out[w] = packed[4 * at : 4 * (at + k)]
                at += k
        return out

    def _learn(self, runs: set[str]) -> None:
        """Keep the ids of runs between white space; a run's words are pre-split by the pattern."""
        new = [r for r in runs if r not in self._runs]
        if len(self._runs) + len(new) > CACHE_WORDS:
            self._runs.clear()
            new = list(runs)
        split = [_split.findall(r) for r in new]
        known = self._pieces(set().union(*split)) if split else {}
        for r, words in zip(new, split, strict=True):
            self._runs[r] = b"".join([known[w] for w in words])

    def _odd_runs(self, text: str) -> list[str]:
        """Words of a text with characters that libraries may class differently: split as the vocabulary's library does."""
        whole = self._library.normalizer.normalize_str(text)
        return [whole[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(whole)]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Of each text: ids as little-endian 32-bit integers."""
        plain: list[list[str]] = []
        parts: list[list[tuple[int, list[str]]]] = []  # of each text: runs of plain text, words of odd text, special strings
        odd: set[str] = set()
        for text in texts:
            mine: list[tuple[int, list[str]]] = []
            for i, piece in enumerate(self._cut.split(text or "") if self._cut and self._opening in (text or "") else [text or ""]):
                if i % 2:
                    mine.append((2, [piece]))
                elif _unsure.search(piece):
                    mine.append((1, self._odd_runs(piece)))
                    odd.update(mine[-1][1])
                elif piece:
                    plain.append(self.normal(piece).split())
                    mine.append((0, plain[-1]))
            parts.append(mine)
        self._learn(set().union(*plain))
        where = (self._runs, self._pieces(odd), self._special_ids)
        return [b"".join([x for kind, what in mine for x in map(where[kind].__getitem__, what)]) for mine in parts]

    def decode(self, ids: bytes) -> bytes:
        """The arc labels of ids in order, parted by single spaces as the library does where a vocabulary names no decoder."""
        return b" ".join(map(self._raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def chunks(texts: list[str | None], most: int = 4_000_000):
    """Runs of texts of about that many characters at most; a longer text is a run of its own."""
    part, size = [], 0
    for t in texts:
        n = len(t or "")
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "bpe", ids: bool = True) -> DataFrame:
    """docs with a struct column ``name``: n_tokens, ids (binary: little-endian 32-bit; if asked for), decoded text's and ids' sha256.

    A null text is encoded as an empty one: no ids. Very long texts are encoded whole, by themselves. Repeated rows are coded
    each; ties can't arise. An empty table gives no rows. No other column is read; one called ``name`` is replaced.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        e = encoder(path)
        rows = []
        for part in chunks(texts.tolist()):
            for i in e.encode_many(part):
                rows.append((len(i) // 4, i if ids else None, hashlib.sha256(i).hexdigest(), hashlib.sha256(e.decode(i)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    udf = F.pandas_udf(run, "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string").asNondeterministic()
    return docs.withColumn(name, udf(F.col(f"`{text}`").cast("string")))
