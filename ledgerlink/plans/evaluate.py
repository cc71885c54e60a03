"""Metrics with abstention, baselines, sweeps and the candidate report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions.similarity import jaro_winkler
from ledgerlink.plans import blocking, resolve
from ledgerlink.runtime import materialise

#: The fuzzy baseline's bar and the cut-offs of both sweeps.
FUZZY = 0.90
MATCH_SWEEP = [0.86, 0.88, 0.90, 0.92, 0.94, 0.96, 0.98, None]
REVIEW_SWEEP = [0.55, 0.62, 0.66, 0.70, 0.74, 0.78, 0.82]
MOST_MISSED = 25


def _share(n: Column, d: Column, places: int = 4) -> Column:
    return F.when(d > 0, F.round(n / d, places)).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, by: list[str] | None = None, label: str = "label", decision: str = "decision") -> DataFrame:
    """Counts and rates of decisions against labels, one row for each group of ``by``.

    Review on a positive counts against recall; review never counts against precision; a missing label is
    no match. Rates are 0 where nothing is to divide by.
    """
    positive = F.coalesce(F.col(label), F.lit("no_match")) == "match"
    count = lambda c: F.count_if(c)
    said = lambda d: F.col(decision) == d
    counts = rows.groupBy(*(by or [])).agg(
        count(positive & said("match")).alias("tp"), count(~positive & said("match")).alias("fp"), count(~positive & said("no_match")).alias("tn"), count(positive & said("no_match")).alias("fn"),
        count(positive & said("review")).alias("review_positive"), count(~positive & said("review")).alias("review_negative"), F.count(F.lit(1)).alias("pairs"),
    )
    tp, reached = F.col("tp"), F.col("tp") + F.col("fn") + F.col("review_positive")
    p = F.when(tp + F.col("fp") > 0, tp / (tp + F.col("fp"))).otherwise(0.0)
    r = F.when(reached > 0, tp / reached).otherwise(0.0)
    return counts.select(*(by or []), "pairs", "tp", "fp", "tn", "fn", "review_positive", "review_negative", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.when(p + r > 0, F.round(2 * p * r / (p + r), 4)).otherwise(0.0).alias("f1"), _share(F.col("review_positive") + F.col("review_negative"), F.col("pairs")).alias("review_rate"))


def exact_name() -> Column:
    return (F.col("l_name_norm") != "") & (F.col("l_name_norm") == F.col("r_name_norm"))


def fuzzy_name() -> Column:
    return jaro_winkler(F.col("l_name_norm"), F.col("r_name_norm")) >= FUZZY


def identifier_first() -> Column:
    """Numbers decide where one authority gave both, as they stand; else exact names."""
    known = (F.col("l_ra_up") != "") & (F.col("l_ra_up") == F.col("r_ra_up")) & F.col("l_id_norm").isNotNull() & F.col("r_id_norm").isNotNull()
    return F.when(known, F.col("l_id_norm") == F.col("r_id_norm")).otherwise(exact_name())


BASELINES: dict[str, Callable[[], Column]] = {"exact_normalized_name": exact_name, "fuzzy_name_only_0.90": fuzzy_name, "identifier_first": identifier_first}


def score_baseline(pairs: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    said = pairs.withColumn("decision", F.when(BASELINES[name](), "match").otherwise("no_match"))
    return confusion(said, by).withColumn("method", F.lit(name))


def score_system(pairs: DataFrame, match: float | None = resolve.THRESHOLD_MATCH, no_match: float = resolve.THRESHOLD_NO_MATCH, by: list[str] | None = None) -> DataFrame:
    return confusion(resolve.resolve(pairs, match, no_match, everywhere=False), by).withColumn("method", F.lit("system"))


def arm_report(pairs: DataFrame) -> DataFrame:
    """The baselines and the system over the same pairs, in one pass: each pair has a row for each method."""
    rows = resolve.resolve(pairs, everywhere=False)
    said = [F.struct(F.lit(n).alias("method"), F.when(f(), "match").otherwise("no_match").alias("decision")) for n, f in BASELINES.items()]
    said.append(F.struct(F.lit("system").alias("method"), F.col("decision").alias("decision")))
    return confusion(rows.select("label", F.explode(F.array(*said)).alias("s")).select("label", "s.method", "s.decision"), ["method"])


def _at_each(scored: DataFrame, cuts: list[float | None], match: Callable[[Column], Column], no_match: Callable[[Column], Column]) -> DataFrame:
    """Scored pairs at every cut-off: each row becomes as many as there are cut-offs, scored once."""
    at = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(c).cast("double").alias("threshold")) for k, c in enumerate(cuts)])
    wide = scored.select("label", "hard_signal", "score", F.explode(at).alias("at")).select("label", "hard_signal", "score", "at.step", "at.threshold")
    return wide.withColumn("decision", resolve.decide(F.col("hard_signal"), F.col("score"), match(F.col("threshold")), no_match(F.col("threshold"))))


def match_sweep(scored: DataFrame, no_match: float = resolve.THRESHOLD_NO_MATCH) -> DataFrame:
    rows = _at_each(scored, MATCH_SWEEP, lambda t: t, lambda t: F.lit(no_match))
    return confusion(rows, ["step", "threshold"]).select("step", "threshold", "precision", "recall", "f1", "fp", "review_rate")


def review_sweep(scored: DataFrame, match: float | None = resolve.THRESHOLD_MATCH) -> DataFrame:
    rows = _at_each(scored, REVIEW_SWEEP, lambda t: F.lit(match).cast("double"), lambda t: t)
    queue = F.col("review_positive") + F.col("review_negative")
    return confusion(rows, ["step", "threshold"]).select("step", "threshold", "precision", "recall", "review_rate", queue.alias("queue_size"), _share(F.col("review_positive"), queue).alias("queue_yield"))


def sweeps(scored: DataFrame) -> DataFrame:
    """Both sweeps in one table, with the shipped points marked."""
    a = match_sweep(scored).select(F.lit("match").alias("sweep"), "threshold", "precision", "recall", "review_rate")
    b = review_sweep(scored).select(F.lit("review").alias("sweep"), "threshold", "precision", "recall", "review_rate")
    shipped = F.when(F.col("sweep") == "match", F.col("threshold").eqNullSafe(F.lit(resolve.THRESHOLD_MATCH).cast("double"))).otherwise(F.col("threshold") == resolve.THRESHOLD_NO_MATCH)
    return a.unionByName(b).withColumn("shipped", shipped)


def candidate_report(prepared: DataFrame, positives: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One row: how many labelled positives (left_key, right_key) the candidates surface, and at what cost."""
    prepared = materialise(prepared.select("record_key", "keys"), "report-records")
    found = (blocking.candidate_pairs(prepared) if candidates is None else candidates).select("left_key", "right_key")
    order = positives.select(F.least("left_key", "right_key").alias("left_key"), F.greatest("left_key", "right_key").alias("right_key"))
    hit = order.join(found.withColumn("hit", F.lit(1)), ["left_key", "right_key"], "left")
    keys = lambda s: prepared.select(F.col("record_key").alias(f"{s}_key"), F.col("keys").alias(f"{s}_keys"))
    marked = hit.join(keys("left"), "left_key").join(keys("right"), "right_key").withColumn("shares", F.arrays_overlap("left_keys", "right_keys"))
    a = marked.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("surfaced"), F.count_if("shares").alias("share_a_key"))
    b, c = found.agg(F.count(F.lit(1)).alias("candidates")), prepared.agg(F.count(F.lit(1)).alias("records"))
    one = a.join(F.broadcast(b), F.lit(True)).join(F.broadcast(c), F.lit(True))
    n, possible = F.col("records"), F.expr("records * (records - 1) div 2")
    return one.select(
        "records", "true_pairs", "surfaced", _share(F.col("surfaced"), F.col("true_pairs")).alias("recall"), "share_a_key", _share(F.col("share_a_key"), F.col("true_pairs")).alias("recall_unbounded"),
        (F.col("share_a_key") - F.col("surfaced")).alias("dropped_by_ceiling"), "candidates", possible.alias("possible_pairs"),
        F.when(possible > 0, F.round(1 - F.col("candidates") / possible, 6)).otherwise(0.0).alias("reduction_ratio"), _share(F.col("candidates"), n, 2).alias("per_record"),
    )


def recall_by_family(prepared: DataFrame, positives: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Shared keys of surfaced positives by family, most first."""
    found = blocking.candidate_pairs(prepared) if candidates is None else candidates
    order = positives.select(F.least("left_key", "right_key").alias("left_key"), F.greatest("left_key", "right_key").alias("right_key"))
    keys = lambda s: prepared.select(F.col("record_key").alias(f"{s}_key"), F.col("keys").alias(f"{s}_keys"))
    both = order.join(found.select("left_key", "right_key"), ["left_key", "right_key"], "left_semi").join(keys("left"), "left_key").join(keys("right"), "right_key")
    shared = both.select(F.explode(blocking.shared_keys(F.col("left_keys"), F.col("right_keys"))).alias("k"))
    return shared.groupBy(blocking.family(F.col("k")).alias("family")).agg(F.count(F.lit(1)).alias("recovered")).orderBy(F.desc("recovered"), "family")


def missed_examples(prepared: DataFrame, positives: DataFrame, candidates: DataFrame | None = None, most: int = MOST_MISSED) -> DataFrame:
    """The first positives that no candidate surfaces, and why."""
    found = (blocking.candidate_pairs(prepared) if candidates is None else candidates).select("left_key", "right_key")
    order = positives.select(F.least("left_key", "right_key").alias("left_key"), F.greatest("left_key", "right_key").alias("right_key"))
    side = lambda s: prepared.select(F.col("record_key").alias(f"{s}_key"), F.col("keys").alias(f"{s}_keys"), F.col("legal_name").alias(f"{s}_name"))
    lost = order.join(found, ["left_key", "right_key"], "left_anti").join(side("left"), "left_key").join(side("right"), "right_key")
    why = F.when(F.arrays_overlap("left_keys", "right_keys"), "oversize block").otherwise("no shared key")
    return lost.select("left_key", "right_key", "left_name", "right_name", why.alias("why")).orderBy("left_key", "right_key").limit(most)


def label_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, change) of labels that were added, removed or changed."""
    a, b = before.select("pair_id", F.col("label").alias("old")), after.select("pair_id", F.col("label").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "pair_id", "full_outer").select("pair_id", "old", "new", change.alias("change")).where(F.col("change").isNotNull())
