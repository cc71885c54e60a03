"""Labelled pairs: positives, clusters, split, hard negatives, variants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.functions import names as N
from ledgerlink.functions.similarity import jaro_winkler
from ledgerlink.operators.graph import connected_components
from ledgerlink.plans.blocking import attach
from ledgerlink.runtime import materialise

#: Share of clusters held out, and what sets this split apart from others.
HOLDOUT_SHARE = 0.20
SALT = "ledgerlink/holdout/v1"
BUILDER_VERSION = "1"
#: Steps of similarity by which hard negatives are counted.
STEPS = 10_000
#: What a labelled corpus must reach before it is evaluated.
KILL_FLOORS = {"pairs": 1000, "positives": 500, "negatives": 500, "recall": 0.90}
CLAIMED_VARIANTS = ("legal_form_variance", "diacritic_or_casing_drift", "distinct_registration_authority")
PROVENANCE = ("pair_id", "left_key", "right_key", "label", "label_basis", "source_revision")
#: Pairs of each decision in the demonstration sample.
DEMO_QUOTA = {"review": 150, "match": 40, "no_match": 40}


def adjudicated_positives(duplicates: DataFrame, successors: DataFrame) -> DataFrame:
    """(left_key, right_key): duplicates joined to their successors; missing successors and self-pairs drop out.

    ``duplicates`` has record_key and successor_key.
    """
    known = successors.select(F.col("record_key").alias("right_key")).distinct()
    return duplicates.select(F.col("record_key").alias("left_key"), F.col("successor_key").alias("right_key")).where("left_key != right_key").join(known, "right_key", "left_semi").select("left_key", "right_key")


def clusters(pairs: DataFrame) -> DataFrame:
    """(node, cluster): components over positive pairs; nodes of other pairs alone stand for themselves.

    ``pairs`` has left_id, right_id, label. A cluster is named by its smallest id.
    """
    ids = pairs.select("left_id").unionAll(pairs.select("right_id")).distinct().toDF("node")
    found = connected_components(pairs.where("label = 'match'"), "left_id", "right_id")
    return ids.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def ordered_roots(pairs: DataFrame) -> DataFrame:
    """(node, root): the root that merging positives in order of column ``pos`` leaves, left over right.

    The component is found first; each one's few edges are then replayed in order. Use only where roots
    must equal those of an edge-ordered build; a component must fit one task.
    """
    nodes = clusters(pairs)
    edges = pairs.where("label = 'match'").join(nodes, F.col("left_id") == F.col("node")).select("cluster", "pos", "left_id", "right_id")

    def replay(g: pd.DataFrame) -> pd.DataFrame:
        up: dict[str, str] = {}

        def top(x: str) -> str:
            while up.get(x, x) != x:
                x = up[x]
            return x

        for r in g.sort_values("pos").itertuples():
            a, b = top(r.left_id), top(r.right_id)
            up.setdefault(a, a)
            if a != b:
                up[b] = a
        members = sorted({*g["left_id"], *g["right_id"]})
        return pd.DataFrame({"node": members, "root": [top(m) for m in members]})

    replayed = edges.groupBy("cluster").applyInPandas(replay, "node string, root string")
    return nodes.join(replayed, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def side(root: Column, share: float = HOLDOUT_SHARE, salt: str = SALT) -> Column:
    """``holdout`` or ``development``, from a digest of the root."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "|"), root.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return F.when(head / F.lit(4294967295.0) < share, "holdout").otherwise("development")


def split_pairs(pairs: DataFrame, roots: DataFrame | None = None, share: float = HOLDOUT_SHARE, salt: str = SALT) -> DataFrame:
    """``pairs`` with assigned: its records' side, or ``dropped`` if they lie on different sides."""
    nodes = (clusters(pairs) if roots is None else roots).toDF("node", "root").select("node", side(F.col("root"), share, salt).alias("side"))
    a = nodes.toDF("left_id", "left_side")
    b = nodes.toDF("right_id", "right_side")
    return pairs.join(a, "left_id").join(b, "right_id").withColumn("assigned", F.when(F.col("left_side") == F.col("right_side"), F.col("left_side")).otherwise("dropped")).drop("left_side", "right_side")


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("assigned").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("label") == "match").alias("positives"), F.count_if(F.col("label") == "no_match").alias("negatives"))


def cluster_counts(nodes: DataFrame, share: float = HOLDOUT_SHARE, salt: str = SALT) -> DataFrame:
    roots = nodes.toDF("node", "root").select("root").distinct().select(side(F.col("root"), share, salt).alias("side"))
    return roots.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("side") == "holdout").alias("holdout"), F.count_if(F.col("side") == "development").alias("development"))


def variant_types() -> Column:
    """Which kinds of drift an attached pair shows."""
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    city = lambda c: F.lower(F.trim(c))
    order = lambda c: F.array_sort(N.words(c))
    checks = {
        "legal_form_variance": N.differs_only_by_legal_form(l("name_norm"), r("name_norm")),
        "diacritic_or_casing_drift": N.differs_only_by_diacritics_or_case(l("legal_name"), r("legal_name"), l("name_norm"), r("name_norm")),
        "distinct_registration_authority": (l("ra_up") != "") & (r("ra_up") != "") & (l("ra_up") != r("ra_up")),
        "token_order_or_abbreviation": (l("name_norm") != r("name_norm")) & (order(l("name_norm")) == order(r("name_norm"))),
        "address_drift": (city(l("city")) != "") & (city(r("city")) != "") & (city(l("city")) != city(r("city"))),
    }
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))


def quotas(positives: DataFrame, per_positive: float = 1.0) -> DataFrame:
    """(side, quota) from positives with a ``side``."""
    return positives.groupBy("side").agg(F.floor(F.count(F.lit(1)) * per_positive).alias("quota"))


def hard_negatives(candidates: DataFrame, prepared: DataFrame, sides: DataFrame, quota: DataFrame) -> DataFrame:
    """The most name-similar candidates between clusters on each side, as many as its quota.

    ``candidates`` has left_key and right_key, ``sides`` record_key, cluster and side. Slim keys are scored
    once; counts by similarity, at most ``STEPS`` a side, tell where a side's quota ends, so only pairs
    above that are ranked, each among those of its step. The caller attaches records to what it needs.
    """
    at = lambda s: sides.select(F.col("record_key").alias(f"{s}_key"), F.col("cluster").alias(f"{s}_cluster"), F.col("side").alias(f"{s}_side"))
    named = attach(candidates.select("left_key", "right_key"), prepared.select("record_key", "name_norm"))
    fit = named.join(at("left"), "left_key").join(at("right"), "right_key").where("left_cluster != right_cluster and left_side = right_side")
    scored = materialise(fit.select("left_key", "right_key", F.col("left_side").alias("side"), jaro_winkler(F.col("l_name_norm"), F.col("r_name_norm")).alias("similarity")), "negatives-scored")
    scored = scored.withColumn("step", F.floor((1 - F.col("similarity")) * STEPS))
    sizes = scored.groupBy("side", "step").agg(F.count(F.lit(1)).alias("n"))
    above = sizes.withColumn("above", F.sum("n").over(Window.partitionBy("side").orderBy("step")) - F.col("n")).join(quota, "side").where("above < quota").drop("n")
    place = F.row_number().over(Window.partitionBy("side", "step").orderBy(F.desc("similarity"), "left_key", "right_key"))
    return scored.join(above, ["side", "step"]).withColumn("rank", F.col("above") + place).where("rank <= quota").drop("step", "above")


def assemble(positives: DataFrame, negatives: DataFrame, revision: str) -> DataFrame:
    """Attached positives and ranked negatives as labelled pairs with the basis of each label."""
    ident = lambda label: N.pair_id(F.col("left_key"), F.col("right_key"), F.lit(label))
    cols = ["pair_id", "left_key", "right_key", "label", "label_basis", "source_revision", "blocking_keys", "variant_types"]
    keys = F.array_sort(F.array_intersect("l_keys", "r_keys"))
    p = positives.select(ident("match").alias("pair_id"), "left_key", "right_key", F.lit("match").alias("label"), F.lit("the registrar names the successor").alias("label_basis"), F.lit(revision).alias("source_revision"), keys.alias("blocking_keys"), variant_types().alias("variant_types"))
    basis = F.concat(F.lit("blocked together, in different clusters, name similarity "), F.format_string("%.3f", "similarity"))
    n = negatives.select(ident("no_match").alias("pair_id"), "left_key", "right_key", F.lit("no_match").alias("label"), basis.alias("label_basis"), F.lit(revision).alias("source_revision"), keys.alias("blocking_keys"), variant_types().alias("variant_types"))
    return p.select(cols).unionByName(n.select(cols))


def corpus_counts(pairs: DataFrame) -> DataFrame:
    """One row: pairs, positives, negatives, distinct records."""
    ids = pairs.select("left_key").unionAll(pairs.select("right_key")).agg(F.count_distinct("left_key").alias("distinct_records"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("label") == "match").alias("positives"), F.count_if(F.col("label") == "no_match").alias("negatives")).join(F.broadcast(ids), F.lit(True))


def variant_histogram(attached: DataFrame) -> DataFrame:
    return attached.select(F.explode(variant_types()).alias("variant")).groupBy("variant").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("pairs"), "variant")


def demo_sample(resolved: DataFrame, quota: dict[str, int] | None = None) -> DataFrame:
    """The first pairs of each decision by pair id, ordered by score, then pair id."""
    quota = quota or DEMO_QUOTA
    most = F.lit(0)
    for decision, n in quota.items():
        most = F.when(F.col("decision") == decision, n).otherwise(most)
    ranked = resolved.withColumn("rank", F.row_number().over(Window.partitionBy("decision").orderBy("pair_id")))
    return ranked.where((F.col("rank") <= max(quota.values())) & (F.col("rank") <= most)).drop("rank").orderBy(F.desc("score"), "pair_id")


def kill_checks(pairs: DataFrame, variants: DataFrame, report: DataFrame, arms: DataFrame) -> DataFrame:
    """(criterion, measured, floor, holds): whether a labelled corpus and its evaluation may be trusted.

    Enough pairs of each label, each variant that the positives are said to show, provenance on every pair,
    candidate recall, and a precision over that of every baseline. ``pairs`` are those of ``assemble``,
    the others the results of ``variant_histogram``, ``candidate_report`` and ``arm_report``; a few rows each.
    """
    row = lambda name, value, floor, above=False: F.struct(F.lit(name).alias("criterion"), value.cast("double").alias("measured"), F.lit(float(floor)).alias("floor"), (value > floor if above else value >= floor).alias("holds"))
    spread = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    size = spread(corpus_counts(pairs), *[row(n, F.col(c), KILL_FLOORS[c]) for n, c in (("labelled pairs", "pairs"), ("positives", "positives"), ("negatives", "negatives"))])
    seen = variants.agg(*[F.coalesce(F.sum(F.when(F.col("variant") == v, F.col("pairs"))), F.lit(0)).alias(v) for v in CLAIMED_VARIANTS])
    lacking = pairs.agg(F.count_if(F.greatest(*[F.coalesce(F.col(c), F.lit("")) == "" for c in PROVENANCE])).alias("n"))
    bare = lacking.select(F.lit("pairs without provenance").alias("criterion"), F.col("n").cast("double").alias("measured"), F.lit(0.0).alias("floor"), (F.col("n") == 0).alias("holds"))
    lead = arms.agg((F.max(F.when(F.col("method") == "system", F.col("precision"))) - F.max(F.when(F.col("method") != "system", F.col("precision")))).alias("lead"))
    parts = [spread(seen, *[row(f"variant {v}", F.col(v), 1) for v in CLAIMED_VARIANTS]), bare, spread(report, row("candidate recall", F.col("recall"), KILL_FLOORS["recall"])), spread(lead, row("precision over best baseline", F.col("lead"), 0, above=True))]
    for part in parts:
        size = size.unionByName(part)
    return size
