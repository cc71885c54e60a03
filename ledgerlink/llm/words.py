"""Encoding of whole texts with the ids that the tokenizers library gives.

Words go to tiktoken's merge loop, which keeps no memory of words. It needs merges in the order of their
products, no product twice; the byte-level and the suffix vocabulary have that. Other vocabularies, and
texts that this can't take, go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from ledgerlink.llm.bpe import PLAIN, byte_letters, split_words

#: The word pattern and the splitting rule of the byte-level vocabulary.
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_RULE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Ends each word that a suffix vocabulary is asked for; texts that hold it go to the library.
_END = "\0"


def _little_endian(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


class Coder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self.size = self._library.get_vocab_size()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._suffix = spec["model"].get("end_of_word_suffix") or ""
        tokens, ids = self._products(spec["model"]) if self._known_rules(spec) else ([], [])
        self._merge = None
        if tokens and len(set(tokens)) == len(tokens):
            pattern = rf"[^{_END}]+{_END}" if self._suffix else _BYTE_WORDS
            names = {t: len(tokens) + k for k, t in enumerate(special)}
            self._ids = np.array([*ids, *special.values()], np.int64)
            self._merge = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens=names)

    @staticmethod
    def _known_rules(spec: dict) -> bool:
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return False
        if model.get("end_of_word_suffix"):
            return spec["normalizer"] is not None and "ByteLevel" in json.dumps(spec["pre_tokenizer"])
        return spec["normalizer"] is None and spec["pre_tokenizer"] == _BYTE_RULE

    def _products(self, model: dict) -> tuple[list[bytes], list[int]]:
        """Tokens as bytes in the order that they merge, and their ids: bytes, word ends, products of merges."""
        vocab, letters, suffix, end = model["vocab"], byte_letters(), self._suffix, _END.encode()
        byte = {c: bytes([b]) for b, c in enumerate(letters)}
        plain = lambda t: b"".join([byte[c] for c in t])
        own = lambda t: plain(t[: -len(suffix)]) + end if suffix and t.endswith(suffix) else plain(t)
        singles = [b for b in range(256) if not suffix or bytes([b]) != end]
        tokens, ids = [bytes([b]) for b in singles], [vocab[letters[b]] for b in singles]
        if suffix:
            tokens += [end, *(bytes([b]) + end for b in singles)]
            ids += [-1, *(vocab[letters[b] + suffix] for b in singles)]
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            tokens.append(own(a) + own(b))
            ids.append(vocab[a + b])
        return tokens, ids

    def _words(self, text: str) -> str:
        """Normalised words, each with its end; special tokens stand between them as they are."""
        if not self._cut or "<|" not in text or not self._cut.search(text):
            return "".join([w + _END for w in split_words(text)])
        return "".join([piece if k % 2 else "".join([w + _END for w in split_words(piece)]) for k, piece in enumerate(self._cut.split(text))])

    def _encode(self, text: str) -> bytes:
        if self._merge is None or self._suffix and (_END in text or not PLAIN.fullmatch(text)):
            return _little_endian(np.array(self._library.encode(text, add_special_tokens=False).ids, np.int64))
        return _little_endian(self._ids[self._merge.encode_to_numpy(self._words(text) if self._suffix else text, allowed_special="all")])

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._encode(t) for t in texts]


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The process's coder of a vocabulary, kept for a worker's next task."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]
