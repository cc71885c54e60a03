"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Fit: a bounded sample of labelled rows (``EXAMPLES`` of each class by hash) gives the terms whose
presence differs between the classes (chi-square), their document frequencies, the examples' TF-IDF
vectors and an inverted index of them in blocks with the largest weight of each term in each block.
A text's similarity to all examples of a block is at most the sum of its weights times these, so blocks
are visited by falling bound, some at a time, until no block can hold a nearer example than the
``NEIGHBOURS`` found: the search is exact. Neighbours vote with weights that fall with distance, scaled to the classes' shares
among all labelled rows; an isotonic map fitted on the examples themselves (each without its own vote)
turns votes into calibrated scores. The nearest examples are the evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import fresh, map_rows, slim

#: Labelled rows of each class that the fit may use.
EXAMPLES = 2_000
#: Terms of the index at most, and the chi-square that a term needs at least.
TERMS = 1_024
LEAST_CHI = 15.0
#: Documents of the sample that a term must occur in.
LEAST_DOCS = 4
NEIGHBOURS = 15
BLOCK = 64
#: Rows of the index (a term's weights in a block) that a search takes at a time; one block at least.
ROWS = 512
#: Words whose terms a task remembers at most.
REMEMBERED = 150_000
#: Lengths of the beginnings of words that are terms too.
BEGINNINGS = (3, 4, 5, 6)
_TERM = re.compile(r"\w+")
#: Blanks for the ASCII characters that no word has; other bytes stay.
_BLANKS = bytes(b if b > 127 or _TERM.match(chr(b)) else 32 for b in range(256))
_ASCII = bytes(range(128))
#: Other characters that no word has.
_BEYOND = re.compile(r"[^\w\x00-\x7f]+")


def held_out(doc_id: Column) -> Column:
    """Rows that labels are not learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(text: str | None) -> Counter:
    """Words of a whole text and, behind a mark that no word has, the beginnings of longer words.

    Beginnings let inflected forms of a word meet, as ``idiot`` and ``idiots`` do.
    """
    out: Counter = Counter()
    for word, n in Counter(_TERM.findall((text or "").lower())).items():
        for t in _of_word(word):
            out[t] += n
    return out


def words(text: str | None) -> list[bytes]:
    """The words that ``_TERM`` finds in a lower-cased text, in UTF-8."""
    low = (text or "").lower()
    coded = low.encode("utf-8", "surrogatepass")
    if not low.isascii():
        beyond = coded.translate(None, _ASCII).decode("utf-8", "surrogatepass")
        if not beyond.isalnum():
            coded = _BEYOND.sub(" ", low).encode("utf-8", "surrogatepass")
    return coded.translate(_BLANKS).split()


def _of_word(word: str) -> list[str]:
    return [word, *["^" + word[:k] for k in BEGINNINGS if len(word) > k]]


class Index:
    """Exact nearest examples by cosine, blocks visited by falling bound."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, vectors: list[dict[int, float]], toxic: np.ndarray, ids: list[int], shares: tuple[float, float]) -> None:
        self.at = {t: k for k, t in enumerate(vocabulary)}
        self.idf = idf
        # a word that holds a term of the index begins as one does
        self.starts = {t.removeprefix("^").encode()[:3] for t in vocabulary}
        # similar examples side by side make tight bounds
        order = sorted(range(len(ids)), key=lambda i: (max(vectors[i], key=vectors[i].get, default=-1), toxic[i], ids[i]))
        self.toxic, self.ids = toxic[order], [ids[i] for i in order]
        self.blocks = max(1, -(-len(order) // BLOCK))
        self.most = np.zeros((len(vocabulary), self.blocks))
        postings = [(t, place, w) for place, i in enumerate(order) for t, w in vectors[i].items()]
        self._postings = (np.array([p[0] for p in postings], np.int64), np.array([p[1] for p in postings], np.int64), np.array([p[2] for p in postings]))
        np.maximum.at(self.most, (self._postings[0], self._postings[1] // BLOCK), self._postings[2])
        self._tiles = None
        self._seen: dict[bytes, tuple[int, ...]] = {}
        # a vote counts as many labelled rows as its example stands for
        counts = np.bincount(toxic, minlength=2)
        self.weight = np.array([shares[c] / max(1, counts[c]) * len(ids) for c in (0, 1)])
        self.prior = shares[1]
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.blank = shares[1]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tiles": None, "_seen": {}}

    def tiles(self) -> np.ndarray:
        """The postings, block by block: a row for each term with its weights in the block's examples. Built where they are used."""
        if self._tiles is None:
            self._tiles = np.zeros((self.blocks * len(self.at), BLOCK))
            term, place, w = self._postings
            self._tiles[place // BLOCK * len(self.at) + term, place % BLOCK] = w
        return self._tiles

    def _of_word(self, word: bytes) -> tuple[int, ...]:
        if len(self._seen) > REMEMBERED:
            self._seen.clear()
        got = self._seen[word] = tuple(self.at[t] for t in _of_word(word.decode("utf-8", "surrogatepass")) if t in self.at)
        return got

    def counts(self, text: str | None) -> Counter:
        """How often each of the index's terms occurs in a whole text."""
        starts, seen, out = self.starts, self._seen, Counter()
        for word, n in Counter([w for w in words(text) if w[:3] in starts]).items():
            at = seen.get(word)
            for k in self._of_word(word) if at is None else at:
                out[k] += n
        return out

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the index in a text and their weights in its unit vector (over the index's terms)."""
        if not counts:
            return np.empty(0, np.int64), np.empty(0)
        at = np.array(sorted(counts))
        w = self.idf[at] * (1 + np.log([counts[k] for k in at.tolist()]))
        return at, w / np.sqrt((w * w).sum())

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, place) of the ``k`` nearest, nearest first, ties to the smaller place; cosine 0 never counts."""
        bound, tiles, step = w @ self.most[at], self.tiles(), max(1, ROWS // max(1, len(at)))
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound > 0)]
        scores, places = np.empty(0), np.empty(0, np.int64)
        for first in range(0, len(order), step):
            blocks = order[first : first + step]
            if len(scores) == k:
                # equal bounds may hold ties at smaller places, so only a smaller bound ends the search
                blocks = blocks[bound[blocks] >= scores[-1] - 1e-12]
                if not len(blocks):
                    break
            got = (w @ tiles.take(blocks[:, None] * len(self.at) + at, axis=0)).ravel()
            where = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            got[where == without] = 0
            # the k-th best of these alone or of those before: nothing below it is among the nearest
            least = scores[-1] if len(scores) == k else np.partition(got, -k)[-k] if len(got) > k else 0
            hits = np.flatnonzero(got >= least if least > 0 else got)
            scores, places = np.concatenate([scores, got[hits]]), np.concatenate([places, where[hits]])
            best = np.lexsort((places, -scores))[:k]
            scores, places = scores[best], places[best]
        return list(zip(scores.tolist(), places.tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic votes; a vote's weight falls with the distance, one prior vote stands against certainty."""
        total, toxic = 0.2, 0.2 * self.prior
        for cosine, place in near:
            c = self.toxic[place]
            x = self.weight[c] / (0.05 + 1 - min(1.0, cosine))
            total += x
            toxic += x * c
        return toxic / total

    def calibrate(self, rows: list[tuple[float, int, float]]) -> None:
        """Isotonic regression of labels on votes: pools of falling means merge."""
        pools: list[list[float]] = []
        for v, y, x in sorted(rows):
            pools.append([v, v, y * x, x])
            while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
                _, hi, s, n = pools.pop()
                pools[-1][1:] = [hi, pools[-1][2] + s, pools[-1][3] + n]
        if pools:
            # a pool is flat between its first and last vote; between pools the map is linear
            means = [(s + 0.5 * self.prior) / (n + 0.5) for _, _, s, n in pools]
            self.steps = (np.array([e for p in pools for e in p[:2]]), np.maximum.accumulate(np.repeat(means, 2)))

    def score(self, text: str | None) -> tuple[float, list[int]]:
        at, w = self.vector(self.counts(text))
        if not len(at):
            return self.blank, []
        near = self.nearest(at, w)
        value = float(np.interp(self.vote(near), *self.steps)) if near else self.blank
        return min(1.0, max(0.0, value)), [self.ids[p] for _, p in near]


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> Index:
    """Index of a bounded sample of the labelled rows that are not held out.

    The sample is the ``examples`` ids of each class with the smallest hash, at all sizes; equal texts among
    them are one example, toxic if one is, and an id with several texts stands for the least. Class shares are counted over all labelled rows. What reaches the driver are term counts of
    at most twice ``examples`` texts, restricted on the executors to terms of several sample texts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(share.values())
    shares = (share.get(0, 0) / total, share.get(1, 0) / total) if total else (1.0, 0.0)
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        chosen = part if chosen is None else chosen.unionAll(part)
    # bounded by twice ``examples`` ids, so the join broadcasts
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    # copies of a text are one example, so that no example is judged by its own copy
    texts = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))

    def make():
        def work(ids: list, texts: list, toxic: list) -> dict:
            got = [terms(t) for t in texts]
            return {"doc_id": ids, "toxic": toxic, "words": [list(c) for c in got], "times": [list(c.values()) for c in got]}

        return work

    drawn = map_rows(texts.select("doc_id", "text", "toxic"), "doc_id long, toxic int, words array<string>, times array<int>", make).persist()
    try:
        sizes = {r.toxic: r["count"] for r in drawn.groupBy("toxic").count().collect()}
        n, n1 = sum(sizes.values()), sizes.get(1, 0)
        per = drawn.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("df1")).where(F.col("df") >= LEAST_DOCS)
        a, b = F.col("df1").cast("double"), (F.col("df") - F.col("df1")).cast("double")
        c, d = F.lit(float(n1)) - a, F.lit(float(n - n1)) - b
        chi = n * (a * d - b * c) ** 2 / F.greatest(F.lit(1e-9), (a + b) * (c + d) * F.lit(float(max(n1, 1))) * F.lit(float(max(n - n1, 1))))
        picked = per.withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "word").limit(TERMS).collect()
        vocabulary = [r.word for r in picked]
        idf = np.array([math.log((1 + n) / (1 + r.df)) + 1 for r in picked])
        at = {t: k for k, t in enumerate(vocabulary)}
        pairs = F.arrays_zip("words", "times")
        kept = F.filter(pairs, lambda p: F.array_contains(F.lit(vocabulary).cast("array<string>"), p["words"]))
        rows = sorted(drawn.select("doc_id", "toxic", kept.alias("kept")).collect(), key=lambda r: r.doc_id)
    finally:
        drawn.unpersist()
    vectors = []
    for r in rows:
        w = {at[x.words]: idf[at[x.words]] * (1 + math.log(x.times)) for x in r.kept}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        vectors.append({k: x / norm for k, x in w.items()})
    toxic = np.array([r.toxic for r in rows], np.int64)
    index = Index(vocabulary, idf, vectors, toxic, [r.doc_id for r in rows], shares)
    # each example is scored without its own vote; vectors by their place in the index
    mine = dict(zip([r.doc_id for r in rows], vectors, strict=True))
    votes, blank = [], [0.0, 0.0]
    for place, doc in enumerate(index.ids):
        v, y = mine[doc], int(index.toxic[place])
        if not v:
            blank[0] += y * index.weight[y]
            blank[1] += index.weight[y]
            continue
        near = index.nearest(np.array(list(v)), np.array(list(v.values())), neighbours, without=place)
        votes.append((index.vote(near), y, float(index.weight[y])))
    index.calibrate(votes)
    index.blank = (blank[0] + shares[1]) / (blank[1] + 1)
    return index


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_on: DataFrame | None = None) -> DataFrame:
    """Score of each row's whole text; one row out for each row in.

    Returns doc_id, held_out, score, predicted, evidence (ids of the nearest examples, nearest first).
    Only terms of the text enter a score. Null and empty texts, and texts without a term of the index,
    get the share of toxic rows among such examples. Null ids and repeated rows stay. Several labels of
    an id: toxic if one is. Without labels every score is 0. Other columns are not read. ``fit_on``
    holds the labelled texts if they are not among ``docs``.
    """
    plain = lambda d: d.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    index = fit(plain(docs if fit_on is None else fit_on), slim(labels, doc_id="doc_id", toxic="toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by EXAMPLES and TERMS

    def make():
        own = shared.value

        def work(ids: list, out: list, texts: list) -> dict:
            got = [own.score(t) for t in texts]
            return {"doc_id": ids, "held_out": out, "score": [s for s, _ in got], "predicted": [int(s >= 0.5) for s, _ in got], "evidence": [e for _, e in got]}

        return work

    rows = plain(docs)
    return map_rows(rows.select("doc_id", held_out(F.col("doc_id")).alias(fresh(["doc_id", "text"], "held_out")), "text"), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>", make)
