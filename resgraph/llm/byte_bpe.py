"""Byte-level BPE of whole texts through the tokenizers library, with ids kept for each distinct run of text.

A text falls into pre-tokens by the vocabulary's pattern, and ids depend on the pre-token alone. A single space between
other characters always begins a pre-token, so texts are cut there first and the ids of each run are kept.
"""

from __future__ import annotations

import re
from array import array
from os.path import commonprefix

import public_tokenizers
import regex
from tokenizers import Tokenizer

from resgraph.llm.bpe_automaton import byte_symbols

#: The pattern of the vocabulary file, with white space by its Unicode property.
PATTERN = public_tokenizers.PATTERN.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s+(?!\S)|\s+", r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_every = regex.compile(PATTERN)
#: The same for texts of ASCII and Latin-1 letters.
_latin = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\x09-\x0d A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[\x09-\x0d ]+(?![^\x09-\x0d ])|[\x09-\x0d ]+")
_not_latin = re.compile("[^\x00-\x1b\x20-~À-ÖØ-öø-ÿ]")
_unsure = re.compile("[^\x00-\x1b\x20-ԯ -⁯぀-ヿ一-鿿가-힣]")
_spaces = re.compile(r"[\x09-\x0d\x85\xa0 -⁯] | [\x09-\x0d\x85\xa0 -⁯]|  ")
CACHE_RUNS = 1_000_000


def split(text: str) -> list[str]:
    """The pre-tokens of a text without special strings, by the pattern."""
    return (_every if _not_latin.search(text) else _latin).findall(text)


class ByteBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._opening = commonprefix(list(self.special)) if self.special else None  # a text without it has no special string
        self._model = self.library.model
        self._bytes = dict(enumerate(byte_symbols()))
        self._runs: dict[str, bytes] = {}

    def ids(self, pretoken: str) -> list[int]:
        """The ids of one pre-token."""
        return [t.id for t in self._model.tokenize(pretoken.encode().decode("latin-1").translate(self._bytes))]

    def count(self, pretoken: str) -> int:
        """How many ids a pre-token has; a special string has one."""
        return 1 if pretoken in self.special else len(self._model.tokenize(pretoken.encode().decode("latin-1").translate(self._bytes)))

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a whole text; special strings stand for themselves."""
        out: list[str] = []
        for i, piece in enumerate(self._cut.split(text) if self._cut and self._opening in text else [text]):
            if i % 2:
                out.append(piece)
            elif _unsure.search(piece):  # classes differ by Unicode version: as the library splits
                out += [piece[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(piece)]
            else:
                out += split(piece)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        if (self._cut and self._opening in text) or _unsure.search(text) or _spaces.search(text):
            out = array("I")
            for p in self.pretokens(text):
                out.extend([self.special[p]] if p in self.special else self.ids(p))
            return out.tobytes()
        first, *rest = text.split(" ")
        runs = self._runs
        try:
            return b"".join([self._run(first), *map(runs.__getitem__, rest)])
        except KeyError:
            if len(runs) > CACHE_RUNS:
                runs.clear()
            for r in rest:
                if r not in runs:
                    runs[r] = self._run(" " + r)
            return b"".join([self._run(first), *map(runs.__getitem__, rest)])

    def _run(self, text: str) -> bytes:
        return array("I", [i for p in split(text) for i in self.ids(p)]).tobytes()


_known: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _known:
        _known[path] = ByteBpe(path)
    return _known[path]
