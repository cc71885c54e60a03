"""Byte-pair encoding in batched numpy merge rounds, and decoding.

The symbols of all new words of a batch lie in one flat array. A round forms the key
``left * size + right`` of every adjacent pair inside a word, finds ranks by binary search in the
sorted pair keys, takes each word's lowest rank and merges that pair. Words without a mergeable pair
leave the array. Results are kept for later texts, as words repeat.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import map_rows

#: The white space and the word pattern that the vocabulary file's rules name.
_WHITE = "\t-\r \x85\xa0  -     　"
_NOT_FINAL = "σ"
_LATIN_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_LATIN_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Text within this range needs no general Unicode tables.
PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞]*")
#: Words remembered at most by a task.
REMEMBERED = 300_000


def _word_pattern(white: str, letter: str, digit: str) -> str:
    return f"[{letter}]+|[{digit}]|'(?:[stmd]|re|ve|ll)|[^{white}{letter}{digit}]+"


_FAST = re.compile(_word_pattern(_WHITE, _LATIN_L, _LATIN_N))
_GENERAL = regex.compile(_word_pattern(_WHITE, r"\p{L}", r"\p{N}"))


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in shown}
    for k, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


def split_words(text: str) -> list[str]:
    """Words of one text without special tokens, after the vocabulary's normalisation."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", _NOT_FINAL)
    low = text.lower()
    return (_FAST if PLAIN.fullmatch(low) else _GENERAL).findall(low)


class WordBpe:
    """Encoder and decoder of a vocabulary whose words end in a suffix and stand alone."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = token
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self._inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self._final = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)
        self._size = len(self.names)
        keys, ranks, made = [], [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[a] * self._size + vocab[b])
            ranks.append(rank)
            made.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self._keys = np.array(keys, np.int64)[order]
        self._ranks = np.array(ranks, np.int64)[order]
        self._made = np.array(made, np.int64)
        # a rank is calm if no merge that uses its product comes before it: then all its pairs of a
        # word can merge in one round, as one by one from the left would give the same
        first = np.full(self._size, len(made), np.int64)
        at = np.array(keys, np.int64)
        np.minimum.at(first, at // self._size, np.arange(len(made)))
        np.minimum.at(first, at % self._size, np.arange(len(made)))
        self._calm = first[self._made] > np.arange(len(made))
        self._known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self._size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], len(self._made))

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each non-empty word."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        sym = self._inner[raw]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self._final[raw[ends]]
        word, sym = word[sym >= 0], sym[sym >= 0]
        done_word, done_sym = [], []
        none = len(self._made)
        while len(sym):
            rank = np.full(len(sym), none, np.int64)
            if len(sym) > 1:
                same = word[1:] == word[:-1]
                rank[:-1] = np.where(same, self._rank(sym[:-1], sym[1:]), none)
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, heads)
            per = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(sym)]))
            idle = (best == none)[per]
            if idle.any():
                done_word.append(word[idle])
                done_sym.append(sym[idle])
                word, sym, rank, per = word[~idle], sym[~idle], rank[~idle], per[~idle]
                if not len(sym):
                    break
            hit = rank == best[per]
            at = np.flatnonzero(hit)
            # overlapping pairs (a run of one symbol) merge at every second place from the left
            run = np.r_[True, (np.diff(at) != 1)]
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            hurried = ~self._calm[rank[at]]
            if hurried.any():
                first = np.r_[True, word[at][1:] != word[at][:-1]]
                at = at[~hurried | first]
            sym[at] = self._made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            word, sym = word[keep], sym[keep]
        if not done_word:
            return [np.empty(0, np.int64) for _ in words]
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return np.split(sym[order], np.searchsorted(word[order], np.arange(1, len(words))))

    def _learn(self, words: set[str]) -> None:
        if len(self._known) + len(words) > REMEMBERED:
            self._known.clear()
        todo = list(words)
        for word, ids in zip(todo, self.merge([w.encode("utf-8", "surrogatepass") for w in todo]), strict=True):
            self._known[word] = ids.astype("<u4").tobytes()

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[str]] = []
        for text in texts:
            if self._cut and "<|" in text and self._cut.search(text):
                words: list[str] = []
                for k, piece in enumerate(self._cut.split(text)):
                    # specials stand in the word list behind a character that no word starts with
                    words += ["\n" + piece] if k % 2 else split_words(piece)
                parts.append(words)
            else:
                parts.append(split_words(text))
        every = set().union(*parts) if parts else set()
        new = {w for w in every if w not in self._known and w[0] != "\n"}
        if len(self._known) + len(new) > REMEMBERED:
            self._known.clear()
            new = {w for w in every if w[0] != "\n"}
        if new:
            self._learn(new)
        for w in self.special:
            self._known["\n" + w] = np.array([self.special[w]], "<u4").tobytes()
        take = self._known.__getitem__
        return [b"".join(map(take, words)) for words in parts]

    def decode(self, ids: bytes) -> str:
        """The tokens' names, joined by a space: the file names no decoder, so suffixes and byte letters stay."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode each row's whole text and decode the ids again; one row out for each row in, no shuffle.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``with_ids``, ids (array<int>) and
    decoded. Null and empty texts have no tokens; null ids and repeated rows stay; other columns are not
    read. ``vocabulary`` is a path that executors can read.
    """

    def make():
        bpe = WordBpe(vocabulary)

        def work(ids: list, texts: list) -> dict:
            coded = bpe.encode_bytes([t or "" for t in texts])
            back = [bpe.decode(x) for x in coded]
            out = {
                "doc_id": ids,
                "n_tokens": [len(x) // 4 for x in coded],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back],
            }
            if with_ids:
                out |= {"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in coded], "decoded": back}
            return out

        return work

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    more = ", ids array<int>, decoded string" if with_ids else ""
    return map_rows(plain, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more, make)
