"""Approximate nearest neighbours by inner product: probed lists, scanned adaptively by dimension.

Rows get a further dimension that makes all norms equal, so the largest inner product is the smallest
distance. Lists come from k-means on a bounded sample; every row is in the list of its nearest centre.
Vectors are rotated at random and stored in column blocks. In a probed list the partial distance over
the first blocks, scaled to all dimensions, estimates the distance; a candidate whose estimate exceeds
what the hypothesis test allows for the query's bound is abandoned, the rest go on to the next block.
Survivors get their exact score from the original vectors in double precision.

Equal vectors are one candidate that carries its smallest ids (as many as an answer can use), and equal
queries are one search, so a vector that very many rows share costs no more than one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlink.llm.common import map_rows
from ledgerlink.runtime import materialise

#: Rows of the fit's sample at most (chosen by hash); centres, rotation and probes come from it.
SAMPLE = 8_192
MOST_LISTS = 1_024
LIST_ROWS = 512
#: Share of true neighbours, in the sample, whose lists must be probed.
COVER = 0.97
#: Rows of a list, and searches, that one task step meets: larger lists and larger crowds are split.
CHUNK_ROWS = 4_096
CHUNK_QUERIES = 1_024
BLOCK = 16
#: Pairs of a query and a row that are looked at together; bounds a step's memory.
PAIRS = 200_000
#: Of the test: a partial estimate may exceed the bound by so many standard errors.
EPSILON = 2.5


class Fitted:
    """Centres, rotation and probe count; ``bound`` holds sample rows that bound a query's distance."""

    def __init__(self, sample: np.ndarray, rows: int, top_norm: float, k: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.top = top_norm
        self.k = k
        x = self.lift(sample)
        d = x.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        lists = max(1, min(MOST_LISTS, -(-rows // LIST_ROWS), len(x)))
        centres = x[rng.permutation(len(x))[:lists]].copy()
        for _ in range(8):
            at = self._nearest(x, centres, 1)[:, 0]
            count = np.bincount(at, minlength=lists)
            total = np.zeros_like(centres)
            np.add.at(total, at, x)
            full = count > 0
            centres[full] = total[full] / count[full, None]
        self.centres = centres
        self.bound_rows = x
        self.probes = self._probes(x, rng)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.top**2 - (x * x).sum(1))
        return np.hstack([x, np.sqrt(rest)[:, None]])

    @staticmethod
    def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T)

    def _nearest(self, x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
        out = []
        for lo in range(0, len(x), 2048):
            d = self._distances(x[lo : lo + 2048], centres)
            out.append(np.argsort(d, axis=1, kind="stable")[:, :n])
        return np.vstack(out) if out else np.empty((0, n), np.int64)

    def _probes(self, x: np.ndarray, rng: np.random.Generator) -> int:
        """Probes that reach the lists of ``COVER`` of the sample's own neighbours.

        Neighbours as many as the sample's share of the answer would be nearer the real ones, but the
        larger number asked here lies further out and so needs more probes: the choice is safe.
        """
        asked = rng.permutation(len(x))[:256]
        own = self._nearest(x, self.centres, 1)[:, 0]
        q = self.queries(x[asked, :-1])
        d = self._distances(q, x)
        d[np.arange(len(asked)), asked] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : min(self.k, max(1, len(x) - 1))]
        order = np.argsort(self._distances(q, self.centres), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        need = np.sort(place[np.arange(len(asked))[:, None], own[near]].ravel())
        return int(need[min(len(need) - 1, math.ceil(COVER * len(need)) - 1)]) + 1

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))])

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.lift(x), self.centres, 1)[:, 0]

    def probed(self, q: np.ndarray) -> np.ndarray:
        return self._nearest(self.queries(q), self.centres, self.probes)

    def bounds(self, q: np.ndarray, need: int) -> np.ndarray:
        """A distance within which each query has ``need`` sample rows; infinite if there are not as many."""
        if len(self.bound_rows) < need:
            return np.full(len(q), np.inf)
        out = []
        for lo in range(0, len(q), 512):
            d = self._distances(self.queries(q[lo : lo + 512]), self.bound_rows)
            out.append(np.partition(d, need - 1, axis=1)[:, need - 1])
        return np.concatenate(out) * (1 + 1e-9) + 1e-12


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, rotation: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places whose distance may be within ``bound``, by blocks of rotated dimensions."""
    q, x = q @ rotation, x @ rotation
    step = max(1, PAIRS // max(1, len(x)))
    if len(q) > step:
        parts = [(lo, _scan(q[lo : lo + step], x, bound[lo : lo + step], epsilon)) for lo in range(0, len(q), step)]
        return np.concatenate([lo + a for lo, (a, _) in parts]), np.concatenate([b for _, (_, b) in parts])
    return _scan(q, x, bound, epsilon)


def _scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    d = q.shape[1]
    ends = [*range(BLOCK, d, BLOCK), d]
    part = Fitted._distances(q[:, : ends[0]], x[:, : ends[0]])
    qi, xi = np.nonzero(part <= (bound * ends[0] / d * (1 + epsilon / math.sqrt(ends[0])) ** 2)[:, None] if ends[0] < d else part <= bound[:, None])
    seen = part[qi, xi]
    for lo, hi in zip(ends, ends[1:], strict=False):
        diff = q[qi, lo:hi] - x[xi, lo:hi]
        seen = seen + np.einsum("ij,ij->i", diff, diff)
        stretch = (hi / d) * (1 + epsilon / math.sqrt(hi)) ** 2 if hi < d else 1.0
        alive = seen <= bound[qi] * stretch + 1e-9
        qi, xi, seen = qi[alive], xi[alive], seen[alive]
    return qi, xi


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a finite, non-zero vector without null components, as doubles."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists("v", lambda c: c != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """(vid, v, ids): each distinct vector with its smallest ids, ``most`` at most.

    Two steps by salt, so a vector that a third of all rows hold is first cut down within salts.
    """
    keyed = rows.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    small = F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("id"))
    cut = keyed.dropDuplicates(["h", "id"]).withColumn("rn", small).where(F.col("rn") <= most)
    return cut.groupBy("h", "v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, most).alias("ids")).select(F.element_at("ids", 1).alias("vid"), "v", "ids")


def fit(spark: SparkSession, distinct: DataFrame, k: int) -> Fitted | None:
    facts = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("top")).first()
    if not facts.n:
        return None
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    return Fitted(np.array([r.v for r in sample]), facts.n, math.sqrt(facts.top), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product with each row of ``queries``.

    Returns query_id, rank, vec_id, score; a row is no candidate of the query with its id. Rows with a
    null id or an unusable vector take no part; repeated rows of one id and vector count once; vectors
    must have one length (that of the most rows; others take no part). Fewer candidates than ``k``: all
    of those found. No usable row: no result. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = length.n if length else 0
    rows = rows.where(F.size("v") == width)
    asked = usable(queries, id_col, vector_col).where(F.size("v") == width)
    need = k + 1
    distinct = materialise(_distinct(rows, need), "ann-rows")
    searches = materialise(asked.groupBy(F.xxhash64("v").alias("h"), "v").agg(F.min("id").alias("sid")).select("sid", "v"), "ann-searches")
    model = fit(spark, distinct, k)
    out = "query_id long, rank int, vec_id long, score double"
    if model is None:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(model)
    rows_known = distinct.count()

    def assign():
        m = shared.value

        def work(ids: list, vs: list) -> dict:
            at = m.lists_of(np.array(vs)) if vs else []
            return {"vid": ids, "v": vs, "list": np.asarray(at, np.int32)}

        return work

    listed = materialise(map_rows(distinct.select("vid", "v"), "vid long, v array<double>, list int", assign), "ann-lists")
    sizes = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
    split = listed.join(F.broadcast(sizes), "list").withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int"))

    def probe():
        m = shared.value

        def work(ids: list, vs: list) -> dict:
            q = np.array(vs)
            lists, bounds = m.probed(q), m.bounds(q, 2 * need)
            n = lists.shape[1]
            return {"sid": np.repeat(ids, n), "v": [v for v in vs for _ in range(n)], "bound": np.repeat(bounds, n), "list": lists.ravel().astype(np.int32)}

        return work

    probes = materialise(map_rows(searches, "sid long, v array<double>, bound double, list int", probe), "ann-probes")
    best = materialise(_search(probes, split, sizes, shared, need), "ann-best")
    # searches that found too few look through all lists, nothing abandoned
    enough = best.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(need, rows_known))
    short = searches.join(enough, "sid", "left_anti").withColumn("bound", F.lit(float("inf"))).withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(model.centres) - 1))))
    again = materialise(_search(short, split, sizes, shared, need), "ann-again")
    best = best.join(again.select("sid").distinct(), "sid", "left_anti").unionByName(again)
    # a vector's further rows: ids of one vector tie, in order of id
    wide = materialise(best.join(distinct.select("vid", "ids"), "vid").select("sid", "score", F.explode("ids").alias("vec_id")), "ann-found")
    tight = wide.withColumn("rn", F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("score"), "vec_id"))).where(F.col("rn") <= need).drop("rn")
    ids = asked.select("id", "v").dropDuplicates(["id"]).join(searches, "v").select(F.col("id").alias("query_id"), "sid")
    each = ids.join(tight, "sid").where(F.col("vec_id") != F.col("query_id"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(probes: DataFrame, split: DataFrame, sizes: DataFrame, shared, need: int) -> DataFrame:
    """(sid, vid, score): the ``need`` best of each search in its probed lists.

    A step meets one chunk of a list's rows and one part of its searches, both bounded.
    """
    crowds = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK_QUERIES).cast("int").alias("crowds"))
    # at most MOST_LISTS rows each
    plan = materialise(sizes.join(crowds, "list"), "ann-plan")
    plan = F.broadcast(plan)
    left = probes.join(plan, "list").withColumn("crowd", F.pmod(F.xxhash64("sid"), F.col("crowds")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("list", "chunk", "crowd", "sid", "v", "bound")
    right = split.join(plan.select("list", "crowds"), "list").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).select("list", "chunk", "crowd", "vid", "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"sid": np.empty(0, np.int64), "vid": np.empty(0, np.int64), "score": np.empty(0)})
        if a.empty or b.empty:
            return empty
        m = shared.value
        q, x = np.vstack(a["v"].to_numpy()), np.vstack(b["v"].to_numpy())
        qi, xi = scan(m.queries(q), m.lift(x), a["bound"].to_numpy(), m.rotation)
        score = np.einsum("ij,ij->i", q[qi], x[xi])
        sid, vid = a["sid"].to_numpy()[qi], b["vid"].to_numpy()[xi]
        order = np.lexsort((vid, -score, qi))
        rank = np.arange(len(order)) - np.searchsorted(qi[order], qi[order])
        keep = order[rank < need]
        return pd.DataFrame({"sid": sid[keep], "vid": vid[keep], "score": score[keep]})

    found = left.groupBy("list", "chunk", "crowd").cogroup(right.groupBy("list", "chunk", "crowd")).applyInPandas(meet, "sid long, vid long, score double")
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("score"), "vid"))).where(F.col("rn") <= need).drop("rn")
