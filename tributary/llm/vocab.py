"""Token ids of whole texts through the ``tokenizers`` library, with a memo of pretokens.

A BPE pretoken's ids don't depend on its neighbours, so each distinct pretoken needs the
library once.  Texts of Latin letters, whose pretokens a plain pattern finds, go through the
memo; every other text (other scripts, control characters, special strings) goes to the
library whole, and so does every text where the tokenizer's file states other rules than
those that the patterns follow.  Both ways give the library's ids.  The memo is bounded:
when it is full it starts anew.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import heavy, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters, digits and white space up to U+024F, as Unicode has them.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
#: Anything but white space that all libraries agree on and characters up to U+024F.
UNSAFE = re.compile("[^\t-\r -įı-ɏ]")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_LEVEL = re.compile(rf"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
JOINED = 4096

# What a file must state for the patterns to hold.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_BYTE_RULES = {"normalizer": None, "pre_tokenizer": _BYTES, "end_of_word_suffix": None}
_WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            _BYTES | {"use_regex": False},
        ],
    },
    "end_of_word_suffix": "</w>",
}


def _rules(stated: dict) -> str | None:
    """Which pattern fits a tokenizer's file: bytes, words or none."""
    model = stated["model"]
    if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or any(t["normalized"] for t in stated["added_tokens"]):
        return None
    mine = {"normalizer": stated["normalizer"], "pre_tokenizer": stated["pre_tokenizer"], "end_of_word_suffix": model.get("end_of_word_suffix") or None}
    return "bytes" if mine == _BYTE_RULES else "words" if mine == _WORD_RULES else None


class _Numbers(dict):
    """Pretoken to number; an unseen pretoken gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.unseen: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.unseen.append(word)
        return n


class MemoTokenizer:
    def __init__(self, path: str, capacity: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.capacity = capacity
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        with open(path, encoding="utf-8") as f:
            self.rules = _rules(json.load(f))
        self.word_level = self.rules == "words"
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self.newline = vocabulary.get("Ċ", -1)
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.at = np.zeros(1 << 16, np.int64)
        self.long = np.zeros(1 << 16, np.int64)

    def pretokens(self, text: str) -> list[str] | None:
        """None where only the library itself can tell."""
        if self.rules is None or UNSAFE.search(text) or any(s in text for s in self.specials):
            return None
        return WORD_LEVEL.findall(text.lower()) if self.word_level else BYTE_LEVEL.findall(text)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Library ids of the pretokens noted since the last call."""
        words, self.numbers.unseen = self.numbers.unseen, []
        if not words:
            return
        pieces: list[np.ndarray] = [None] * len(words)
        if self.word_level:
            plain, odd, glue = list(range(len(words))), [], " "
        else:
            plain = [i for i, w in enumerate(words) if w[-1].isalpha() and w[0] != "'"]
            odd, glue = sorted(set(range(len(words))) - set(plain)), "\n"
        for i in range(0, len(plain), JOINED):
            part = plain[i : i + JOINED]
            (ids,) = self._ids([glue.join(words[k] for k in part) + glue])
            ends = np.flatnonzero(self.last[ids]) + 1 if self.word_level else np.flatnonzero(ids == self.newline)
            if len(ends) != len(part):  # never seen; each on its own is right in any case
                odd += part
                continue
            begins = np.concatenate(([0], ends[:-1] + (not self.word_level)))
            for k, a, b in zip(part, begins.tolist(), ends.tolist()):
                pieces[k] = ids[a:b]
        for k, ids in zip(odd, self._ids([words[k] for k in odd]) if odd else []):
            pieces[k] = ids
        n, first = len(self.numbers), len(self.numbers) - len(words)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.concatenate(pieces)
        while n > len(self.at):
            self.at, self.long = np.concatenate([self.at, self.at]), np.concatenate([self.long, self.long])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.long[first:n] = lengths
        self.at[first:n] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _numbered(self, texts: list[str]) -> tuple[list[np.ndarray | None], dict[int, np.ndarray]]:
        if len(self.numbers) > self.capacity:
            self._clear()
        found: list[np.ndarray | None] = []
        get = self.numbers.__getitem__
        for text in texts:
            words = self.pretokens(text)
            found.append(None if words is None else np.fromiter(map(get, words), np.int64, len(words)))
        self._learn()
        odd = [i for i, x in enumerate(found) if x is None]
        return found, dict(zip(odd, self._ids([texts[i] for i in odd]) if odd else []))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        found, whole = self._numbered(texts)
        return [whole[i] if x is None else self.pool[ragged(self.at[x], self.long[x])] for i, x in enumerate(found)]

    def count(self, texts: list[str]) -> list[int]:
        found, whole = self._numbered(texts)
        return [len(whole[i]) if x is None else int(self.long[x].sum()) for i, x in enumerate(found)]


def tokenizer(path: str, capacity: int = 400_000) -> MemoTokenizer:
    """One for each Python worker and file, until the worker goes on to another stage."""
    return heavy((path, capacity), lambda: MemoTokenizer(path, capacity))
