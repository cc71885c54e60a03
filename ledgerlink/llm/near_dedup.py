"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Each document's set of distinct word shingles is hashed once; its smallest values are its sketch.
   Documents with equal sets become one class.
2. Inverted lists map a retained value to the classes that hold it. Two sets of Jaccard 0.75 share at
   least ``SHARED`` of their ``HEADS`` smallest values but for a chance below 1e-7, so each class is
   listed only under the rarest of these (all but ``SHARED - 1``): two such classes still meet, and values
   that very many texts hold (a common passage) drop out.
3. In each list the classes are compared with one pivot, the class whose values are held most. Links join
   classes to components; a list of one component is settled. A second round takes a pivot outside the
   first one's component.
4. Classes of lists that still mix components are listed anew, by their full sets: values that one
   component alone holds cannot be shared across, which with the sizes rules out most of a drifting group.
   What is left meets in blocks of bounded size; sketches choose the pairs, and a block returns no more
   links than join its components.
5. Exact Jaccard of full sets, hashed again from the texts, decides on every pair. A shingle stands in a
   set as a 64-bit hash of its words: two different shingles of a pair take one value with a chance of
   about 1e-15 for texts of 100 words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import map_rows, slim
from ledgerlink.operators.graph import connected_components
from ledgerlink.runtime import materialise

#: Retained values by which classes are listed, and those that two linked sets share at least.
HEADS = 48
SHARED = 20
#: Retained values of the sketch that estimates a union's Jaccard, 31 bits each.
K = 128
#: The estimate may lie so many standard errors below 0.75.
SIGMAS = 5.0
WORDS = 5
#: Classes of one list that are compared at once, and their shingles.
BLOCK = 1_024
BLOCK_SHINGLES = 1_000_000
#: Words whose hashes a task remembers at most.
REMEMBERED = 200_000
#: At most so many ids are broadcast to fetch the texts of compared classes; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, known: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer words than a shingle: the whole
    sequence is the one shingle. Null, empty or without words: no shingles.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, n)
    w = min(n, words)
    acc = np.full(n - w + 1, w, np.uint64)
    for j in range(w):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : n - w + 1 + j])
    return np.unique(acc)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, heads, sketch) of (doc_id, text); set_id is null for an empty set."""

    def make():
        known = _WordHashes()

        def work(ids: list, texts: list) -> dict:
            sets = [shingle_hashes(t, known) for t in texts]
            return {
                "doc_id": ids,
                "n_shingles": [len(s) for s in sets],
                "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "heads": [s[:HEADS].view(np.int64) for s in sets],
                "sketch": [(s[:K] >> np.uint64(33)).astype(np.int32) for s in sets],
            }

        return work

    return map_rows(docs, "doc_id long, n_shingles long, set_id binary, heads array<long>, sketch array<int>", make)


def _least_shared(n: Column) -> Column:
    """Heads that two linked sets share at least, the smaller of ``n`` values."""
    return F.greatest(F.lit(1), F.least(F.lit(SHARED), F.ceil(n / 2)))


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(value, id, support): the classes to compare under each value, from (id, n, heads).

    ``support`` counts the classes that hold a class's values: it is largest at the centre of a group.
    """
    held = classes.select("id", "n", F.size("heads").alias("k"), F.explode("heads").alias("value"))
    often = held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = held.join(often, "value")
    # values of one class alone are the rarest and use up its places
    places = F.first("k") - _least_shared(F.floor(F.first("n") * 0.75)) + 1 - (F.first("k") - F.count(F.lit(1)))
    rare = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"), places.cast("int").alias("places"), F.sum("df").alias("support")).where("places > 0")
    return rare.select("id", "support", F.explode(F.expr("slice(held, 1, places)")).alias("x")).select(F.col("x.value").alias("value"), "id", "support")


def _bar(overlap, union, n_a, n_b):
    """Whether a Jaccard of 0.75 is possible, given the sketches' overlap and union below the smaller of their ends.

    The values below that end are a sample without replacement of the whole union, so the error is
    hypergeometric; it vanishes where sketches hold the whole sets.
    """
    whole = np.maximum((n_a + n_b) / 1.75, union)
    error = np.sqrt(0.75 * 0.25 / np.maximum(union, 1) * np.maximum(whole - union, 0) / np.maximum(whole - 1, 1))
    return (overlap >= (0.75 - SIGMAS * error - 1e-9) * union) & (4 * np.minimum(n_a, n_b) >= 3 * np.maximum(n_a, n_b))


def _end(sketch: np.ndarray, n: int) -> int:
    """Up to which value a sketch knows its set: its last one, or all if it holds the whole set."""
    return int(sketch[-1]) if n > len(sketch) else 1 << 31


def possible_pairs(n_a: np.ndarray, s_a: list, n_b: np.ndarray, s_b: list) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of two blocks' pairs: whether they may have a Jaccard of 0.75, and its estimate.

    Overlaps are products of presence matrices over the values that the blocks share, some columns at
    a time.
    """
    values_a, values_b = np.concatenate(s_a), np.concatenate(s_b)
    both = np.intersect1d(values_a, values_b)
    overlap = np.zeros((len(s_a), len(s_b)), np.float32)
    row_a, row_b = np.repeat(np.arange(len(s_a)), [len(s) for s in s_a]), np.repeat(np.arange(len(s_b)), [len(s) for s in s_b])
    for lo in range(0, len(both), 4096):
        part = both[lo : lo + 4096]

        def presence(values: np.ndarray, row: np.ndarray, rows: int, part: np.ndarray = part) -> np.ndarray:
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            out = np.zeros((rows, len(part)), np.float32)
            out[row[hit], at[hit]] = 1
            return out

        overlap += presence(values_a, row_a, len(s_a)) @ presence(values_b, row_b, len(s_b)).T
    ends_a = np.array([_end(s, n) for s, n in zip(s_a, n_a, strict=True)])
    ends_b = np.array([_end(s, n) for s, n in zip(s_b, n_b, strict=True)])
    ends = np.minimum(ends_a[:, None], ends_b[None, :])
    below_a = np.vstack([np.searchsorted(s, e, side="right") for s, e in zip(s_a, ends, strict=True)])
    below_b = np.vstack([np.searchsorted(s, e, side="right") for s, e in zip(s_b, ends.T, strict=True)]).T
    union = below_a + below_b - overlap
    return _bar(overlap, union, n_a[:, None], n_b[None, :]), overlap / np.maximum(union, 1)


def _allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) that sizes and sketches allow."""
    side = lambda s: classes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))

    def make():
        def work(a: list, b: list, n_a: list, n_b: list, s_a: list, s_b: list) -> dict:
            keep = []
            for k in range(len(a)):
                x, y = np.array(s_a[k]), np.array(s_b[k])
                end = min(_end(x, n_a[k]), _end(y, n_b[k]))
                overlap = len(np.intersect1d(x, y))
                keep.append(bool(_bar(overlap, np.searchsorted(x, end, "right") + np.searchsorted(y, end, "right") - overlap, n_a[k], n_b[k])))
            pick = lambda c: [v for v, f in zip(c, keep, strict=True) if f]
            return {"a": pick(a), "b": pick(b), "n_a": pick(n_a), "n_b": pick(n_b)}

        return work

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b"))
    return map_rows(both.select("a", "b", "n_a", "n_b", "s_a", "s_b"), "a long, b long, n_a long, n_b long", make)


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, hashes) of the rows of ``docs`` that ``ids`` names, hashed again from their whole texts."""
    # the count is the check: beyond it the join shuffles both sides
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def make():
        known = _WordHashes()

        def work(doc_ids: list, texts: list) -> dict:
            return {"doc_id": doc_ids, "hashes": [shingle_hashes(t, known).view(np.int64) for t in texts]}

        return work

    return map_rows(texts, "doc_id long, hashes array<long>", make)


def links(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of (a, b, n_a, n_b) whose exact Jaccard is at least 0.75."""
    asked = materialise(asked, "dedup-asked")
    full = materialise(_full_sets(docs, materialise(asked.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "dedup-ids")), "dedup-sets")
    side = lambda s: full.select(F.col("doc_id").alias(s), F.col("hashes").alias(f"h_{s}"))
    both = asked.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("h_a", "h_b"))
    return both.select("a", "b", "n_a", "n_b", shared.alias("i")).where("100 * i >= 75 * (n_a + n_b - i)").select("a", "b")


def _pivots(lists: DataFrame, outside: bool) -> DataFrame:
    """Each list's classes of other components paired with its pivot. lists: (value, id, support, comp).

    The pivot has the largest support, or the largest outside the component of that one.
    """
    best = lambda name: F.max(F.struct("support", (-F.col("id")).alias("id"), "comp")).alias(name)
    pick = lists.groupBy("value").agg(best("p"))
    if outside:
        first = pick.select("value", F.col("p.comp").alias("first"))
        pick = lists.join(first, "value").where("comp != first").groupBy("value").agg(best("p"))
    both = lists.join(pick.select("value", (-F.col("p.id")).alias("pivot"), F.col("p.comp").alias("pivot_comp")), "value").where("comp != pivot_comp")
    return both.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _mixed(lists: DataFrame) -> DataFrame:
    """The rows of lists that hold more than one component."""
    both = lists.groupBy("value").agg((F.min("comp") != F.max("comp")).alias("mixed")).where("mixed").select("value")
    return lists.join(both, "value")


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """One list of each set of members: a group's classes share many values, so most lists are repeats."""
    sign = lists.groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s1"), F.sum(F.xxhash64(F.lit("other"), "id").cast("decimal(20,0)")).alias("s2"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    chosen = sign.groupBy("m", "s1", "s2", "lo", "hi").agg(F.min("value").alias("value"))
    return lists.join(chosen.select("value"), "value", "left_semi")


def unsettled_lists(full: DataFrame) -> DataFrame:
    """(value, id, n, comp): who may still link across components, from full sets (id, comp, hashes).

    A value that one component alone holds is in no overlap of two components. Of a set's ``n`` values let
    ``s`` be the others, rarest first. If its partner's first shared value is the one at place ``r``, they
    share at most ``o = s - r + 1``, and 7 * o >= 3 * (n + m) bounds the partner's size ``m``. So a set is
    listed only while that leaves a size of at least 3/4 of its own, and only where the list's smallest
    member is small enough. Every link between components has a list that holds both ends.
    """
    held = full.select("id", "comp", F.size("hashes").alias("n"), F.explode("hashes").alias("value"))
    across = held.groupBy("value").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 != c2").select("value", "df")
    rare = held.join(across, "value").groupBy("id").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    rare = rare.withColumn("s", F.size("held")).withColumn("places", F.expr("s - ceil(3 * n / 4) + 1").cast("int")).where("places > 0")
    at = rare.select("id", "comp", "n", "s", F.posexplode(F.expr("slice(held, 1, places)")).alias("r", "x"))
    rows = materialise(at.select(F.col("x.value").alias("value"), "id", "n", "comp", F.expr("floor(7 * (s - r) / 3) - n").alias("largest")), "dedup-rare")
    least = rows.groupBy("value").agg(F.min("n").alias("least"))
    return _mixed(rows.join(least, "value").where("largest >= least").select("value", "id", "n", "comp"))


def _meet(g: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join the components of two blocks: a spanning forest of the exact links."""
    none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    first = g["b1"].iloc[0]
    left = g[g["block"] == first]
    right = left if first == g["b2"].iloc[0] else g[g["block"] != first]
    if left.empty or right.empty or g["comp"].nunique() == 1:
        return none
    ia, ib, ca, cb = (x[c].to_numpy() for c in ("id", "comp") for x in (left, right))
    fine, estimate = possible_pairs(left["n"].to_numpy(), left["sketch"].tolist(), right["n"].to_numpy(), right["sketch"].tolist())
    x, y = np.nonzero(fine & (ca[:, None] != cb[None, :]))
    order = np.argsort(-estimate[x, y], kind="stable")
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while (above := up.get(c, c)) != c:
            c = above
        return c

    sets_a, sets_b = left["hashes"].tolist(), right["hashes"].tolist()
    found = []
    for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
        s, t = top(int(ca[i])), top(int(cb[j]))
        if s == t:
            continue
        shared = len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True))
        if 7 * shared >= 3 * (len(sets_a[i]) + len(sets_b[j])):
            up[s] = t
            found.append((min(ia[i], ib[j]), max(ia[i], ib[j])))
    return pd.DataFrame(found, columns=["a", "b"]) if found else none


def unsettled_links(lists: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join different components of ``lists``, by their full sets.

    Sizes and sketches choose what is compared. A task step meets two blocks of bounded rows and shingles;
    of the links it finds it returns those that join components it has not joined yet.
    """
    member = lists.select("id").distinct()
    comp = lists.groupBy("id").agg(F.first("comp").alias("comp"))
    full = materialise(_full_sets(docs, materialise(member.withColumnRenamed("id", "doc_id"), "dedup-ids")).select(F.col("doc_id").alias("id"), "hashes").join(comp, "id"), "dedup-sets")
    left = materialise(_distinct_lists(materialise(unsettled_lists(full), "dedup-lists")), "dedup-lists")
    weight = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    placed = left.join(left.groupBy("value").agg(F.ceil(weight).cast("int").alias("blocks")), "value").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("value", "id", "block", other).select("value", "id", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    rows = spread.join(full, "id").join(classes.select("id", "n", "sketch"), "id")
    return rows.groupBy("value", "b1", "b2").applyInPandas(_meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of each row among all rows of ``docs``, linked at Jaccard 0.75 of 5-word shingles.

    Returns doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id = component_id).
    Null, empty and wordless texts link with nothing. A null id is never linked: its component is null
    and it is kept. Repeated rows stay and get the same component. Ids are taken to name one text; rows
    that share an id with different texts share its component's fate only where their own sets link.
    Other columns are not read.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    drawn = materialise(sketches(plain), "dedup-sketches")
    named = drawn.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    # sketches of equal sets are equal: the first will do
    classes = materialise(named.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("heads").alias("heads"), F.first("sketch").alias("sketch")), "dedup-classes")
    body = classes.select("id", "n", "sketch")
    lists = materialise(inverted_lists(classes.select("id", "n", "heads")).withColumn("comp", F.col("id")), "dedup-lists")
    found = None
    parts = None
    for step in ("centre", "outside", "rest"):
        new = materialise(unsettled_links(lists, body, plain) if step == "rest" else links(_allowed(_pivots(lists, step == "outside"), body), plain), "dedup-links")
        found = new if found is None else found.unionAll(new)
        parts = materialise(connected_components(found), "dedup-components")
        if step != "rest":
            fresh = lists.drop("comp").join(parts.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").select("value", "id", "support", F.coalesce("c", "id").alias("comp"))
            lists = materialise(_mixed(fresh), "dedup-lists")
            if lists.isEmpty():
                break
    by_set = classes.select("set_id", "id").join(parts.select(F.col("node").alias("id"), "component"), "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id"))
    out = slim(drawn, doc_id="doc_id", n_shingles="n_shingles", set_id="set_id").join(by_set, "set_id", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
