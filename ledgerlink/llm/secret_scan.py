"""Secret scan: fixed patterns, and strings that a primed zstandard compressor finds novel.

A candidate is a run of token characters behind a word that holds a sensitive one (such as ``key``, ``pwd`` or
``auth``). Its marginal size is what it adds to the compressed size of the text just
before it, with a dictionary of common identifiers and that text already known. A name, a path or a
word that occurs nearby costs few bytes; a random string costs its entropy. Candidates whose marginal
bytes reach ``NOVEL`` of their length are reported as kind ``novel``.
"""

from __future__ import annotations

import hashlib
import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import map_rows

#: The base patterns.
_ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so asking for 32 characters at once drops exactly the shorter runs.
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

#: A candidate stands behind a whole word that holds a sensitive one and behind any separators, on the same
#: line. Words are tried at their start only, so a scan is linear however long they are.
_PLACED = re.compile(r"(?<![A-Za-z0-9_])([A-Za-z0-9_]++)[\x20\"':=(>,-]++(?=[A-Za-z0-9+/_.=~-]{16})", re.ASCII)
_RUN = re.compile(r"[A-Za-z0-9+/_.=~-]+")
_SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|credential|bearer|private|signature|session", re.I)
#: Marginal bytes per character above which a string counts as random: hex holds 0.5, base64 0.75.
NOVEL = 0.5
#: Characters of text before and after a candidate that prime the compressor with it.
CONTEXT = 400

#: Words common in source code and settings, as the compressor's dictionary.
_IDENTIFIERS = (
    "public static final void string return import package class function const let var async await self this null none true false "
    "username password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret session_id "
    "authorization bearer signature certificate credential config settings environment default example placeholder changeme "
    "your_token_here insert_key_here localhost http https www com org net index.html main.py src/main/java com.example.service "
    "get_value set_value create_user delete_user update_account request response header content_type application/json utf-8 "
    "connection_string database_url host port timeout retry logger warning error exception test_data sample_value abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1111111111111111 xxxxxxxxxxxxxxxx 1234567890abcdef deadbeef"
)


class Novelty:
    """Marginal compressed bytes of a string in its context."""

    def __init__(self) -> None:
        shared = zstandard.ZstdCompressionDict(_IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(19, write_checksum=False, write_content_size=False, write_dict_id=False)
        self._zip = zstandard.ZstdCompressor(dict_data=shared, compression_params=params)

    def __call__(self, before: str, candidate: str, after: str) -> float:
        around = (after + "\n" + before).encode("utf-8", "surrogatepass")
        own = candidate.encode()
        return (len(self._zip.compress(around + own)) - len(self._zip.compress(around))) / len(own)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans in order of start, then kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def novel_spans(text: str, novelty: Novelty) -> list[tuple[str, int, int]]:
    found = []
    at = 0
    while m := _PLACED.search(text, at):
        # behind another word, what stands there may itself be the word before a candidate
        at = start = m.end()
        if not _SENSITIVE.search(m[1]):
            continue
        at = end = _RUN.match(text, start).end()
        # a long candidate is judged in pieces, each against the text before it, so cost is linear
        step = 256
        costs = [novelty(text[max(0, a - CONTEXT) : a], text[a : min(end, a + step)], text[end : end + CONTEXT]) * (min(end, a + step) - a) for a in range(start, end, step)]
        if sum(costs) >= NOVEL * (end - start):
            found.append(("novel", start, end))
    return found


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _make():
    novelty = Novelty()

    def work(ids: list, texts: list) -> dict:
        out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")}
        for text in texts:
            base = base_spans(text or "")
            every = sorted(base + novel_spans(text or "", novelty), key=lambda s: (s[1], KINDS.index(s[0])))
            kinds = [k for k, _, _ in every]
            for k in KINDS:
                out[f"n_{k}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(_join(base).encode()).hexdigest())
            out["spans"].append(_join(every))
        return {"doc_id": ids} | out

    return work


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in each row's whole text; one row out for each row in, no shuffle.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end`` by start, then
    kind; code points, end exclusive), n_novel. Null and empty texts have no spans (the digest is that
    of the empty string), null ids and repeated rows stay, other columns are not read.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(plain, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long", _make)
