"""Facts, features, scores and decisions of attached pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions import names as N
from ledgerlink.functions.similarity import jaccard, jaro_winkler, token_sort_ratio

#: Weights of the features, bands, and limits of the facts.
WEIGHTS = {"name_similarity": 0.22, "identifying_name_similarity": 0.16, "distinctive_token_agreement": 0.32, "token_overlap": 0.08, "acronym_match": 0.04, "country_agreement": 0.08, "address_similarity": 0.10}
THRESHOLD_MATCH: float | None = None
THRESHOLD_NO_MATCH = 0.66
MOST_HOLDERS = 2
LEAST_SHARED = 2
ORDER = ("name_similarity", "identifying_name_similarity", "token_overlap", "distinctive_token_agreement", "acronym_match", "country_agreement", "address_similarity")
FACT_MATCH = ("identifier_agreement", "identifying_name_agreement")


def _same_registrar() -> Column:
    both = F.col("l_id_norm").isNotNull() & F.col("r_id_norm").isNotNull()
    return F.coalesce(both & (F.col("l_ra_norm") == F.col("r_ra_norm")), F.lit(False))


def _same_number() -> Column:
    bare = lambda c: F.ltrim(F.col(c), F.lit("0"))
    return (F.col("l_id_norm") == F.col("r_id_norm")) | (bare("l_id_norm") == bare("r_id_norm"))


def _own_tokens(side: str) -> Column:
    return F.array_except(f"{side}_tok", F.array(*[F.lit(f) for f in N.CANONICAL_FORMS]))


def discriminator_conflict() -> Column:
    """Much shared, and all that differs are designators, at least one on each side."""
    left, right = _own_tokens("l"), _own_tokens("r")
    only_left, only_right = F.array_except(left, right), F.array_except(right, left)
    return (F.size(F.array_intersect(left, right)) >= LEAST_SHARED) & (F.size(only_left) > 0) & (F.size(only_right) > 0) & F.forall(F.concat(only_left, only_right), N.is_discriminator)


def hard_signal() -> Column:
    """The first fact that holds, or null: the registrar's word, then designators, then the whole name."""
    return (
        F.when(_same_registrar() & _same_number() & (F.col("l_id_df") <= MOST_HOLDERS), "identifier_agreement")
        .when(_same_registrar() & ~_same_number(), "identifier_conflict")
        .when(discriminator_conflict(), "discriminator_conflict")
        .when((F.col("l_name_norm") == F.col("r_name_norm")) & (F.col("l_name_norm") != ""), "identifying_name_agreement")
    )


def signal_detail() -> Column:
    left, right = _own_tokens("l"), _own_tokens("r")
    differing = F.array_join(F.array_sort(F.concat(F.array_except(left, right), F.array_except(right, left))), ", ")
    return (
        F.when(F.col("hard_signal") == "identifier_agreement", F.format_string("registered at %s as %s and %s, a number of %d record(s)", "l_ra_norm", "l_registered_as", "r_registered_as", "l_id_df"))
        .when(F.col("hard_signal") == "identifier_conflict", F.format_string("registrar %s lists %s and %s: different numbers", "l_ra_norm", "l_registered_as", "r_registered_as"))
        .when(F.col("hard_signal") == "discriminator_conflict", F.concat(F.lit("alike but for designators: "), differing))
        .when(F.col("hard_signal") == "identifying_name_agreement", F.concat(F.lit("same normalised name: "), F.col("l_name_norm")))
        .otherwise("")
    )


def acronym_match() -> Column:
    left, right = F.col("l_acr"), F.col("r_acr")
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    hit = (left == right) | (bare("l_core") == right) | (bare("r_core") == left)
    return F.when((left != "") & (right != "") & hit, 1.0).otherwise(0.0)


def country_agreement() -> Column:
    return F.when(F.col("l_ctry_up").isNull() | F.col("r_ctry_up").isNull(), 0.5).when(F.col("l_ctry_up") == F.col("r_ctry_up"), 1.0).otherwise(0.0)


def with_features(pairs: DataFrame, everywhere: bool = True) -> DataFrame:
    """Adds hard_signal and the seven features, unrounded.

    Without ``everywhere`` the similarities that need Python are computed only where no fact decides;
    they are null elsewhere.
    """
    pairs = pairs.withColumn("hard_signal", hard_signal())
    ask = (lambda c: F.col(c)) if everywhere else (lambda c: F.when(F.col("hard_signal").isNull(), F.col(c)))
    return pairs.withColumns({
        "name_similarity": jaro_winkler(ask("l_name_norm"), ask("r_name_norm")),
        "identifying_name_similarity": jaro_winkler(ask("l_core"), ask("r_core")),
        "token_overlap": jaccard(F.col("l_tok"), F.col("r_tok")),
        "distinctive_token_agreement": jaccard(F.col("l_rare_tok"), F.col("r_rare_tok")),
        "acronym_match": acronym_match(),
        "country_agreement": country_agreement(),
        "address_similarity": F.coalesce(token_sort_ratio(ask("l_addr"), ask("r_addr")), F.lit(0.5)),
    })


def round4(c: Column) -> Column:
    """Four places, halves away from zero; what is a half is judged at ten places, so that engines agree."""
    return F.round(F.round(c, 10), 4)


def contribution(feature: str) -> Column:
    return round4(F.col(feature) * F.lit(WEIGHTS[feature]))


def score() -> Column:
    total = contribution(ORDER[0])
    for f in ORDER[1:]:
        total = total + contribution(f)
    return F.round(total, 4)


def band(score: Column, match: Column | float | None, no_match: Column | float) -> Column:
    """At or above ``match``: match (never, if null); below ``no_match``: no match; else review."""
    match = F.lit(match).cast("double") if not isinstance(match, Column) else match
    return F.when(score >= match, "match").when(score < no_match, "no_match").otherwise("review")


def decide(signal: Column, score: Column, match: Column | float | None = THRESHOLD_MATCH, no_match: Column | float = THRESHOLD_NO_MATCH) -> Column:
    return F.when(signal.isin(*FACT_MATCH), "match").when(signal.isNotNull(), "no_match").otherwise(band(score, match, no_match))


def resolve(pairs: DataFrame, match: float | None = THRESHOLD_MATCH, no_match: float = THRESHOLD_NO_MATCH, everywhere: bool = True) -> DataFrame:
    """Adds hard_signal, features, score and decision."""
    return with_features(pairs, everywhere).withColumn("score", score()).withColumn("decision", decide(F.col("hard_signal"), F.col("score"), match, no_match))


def evidence(resolved: DataFrame) -> DataFrame:
    """Adds signal_detail and contributions: feature, value, weight, contribution and what was seen."""
    shared = F.array_sort(F.array_intersect("l_tok", "r_tok"))
    details = {
        "name_similarity": F.concat_ws(" vs ", "l_name_norm", "r_name_norm"),
        "identifying_name_similarity": F.concat_ws(" vs ", "l_core", "r_core"),
        "token_overlap": F.format_string("%d of %d tokens shared: %s", F.size(shared), F.size(F.array_union("l_tok", "r_tok")), F.array_join(F.slice(shared, 1, 6), ", ")),
        "distinctive_token_agreement": F.format_string("shared: %s; left: %s; right: %s", *[F.array_join(F.array_sort(x), ", ") for x in (F.array_intersect("l_rare_tok", "r_rare_tok"), F.array_except("l_rare_tok", "r_rare_tok"), F.array_except("r_rare_tok", "l_rare_tok"))]),
        "acronym_match": F.concat_ws(" vs ", "l_acr", "r_acr"),
        "country_agreement": F.concat_ws(" vs ", F.coalesce("l_ctry_up", F.lit("missing")), F.coalesce("r_ctry_up", F.lit("missing"))),
        "address_similarity": F.concat_ws(" vs ", F.coalesce(F.left("l_addr", F.lit(44)), F.lit("missing")), F.coalesce(F.left("r_addr", F.lit(44)), F.lit("missing"))),
    }
    parts = [F.struct(F.lit(f).alias("feature"), round4(F.col(f)).alias("value"), F.lit(WEIGHTS[f]).alias("weight"), contribution(f).alias("contribution"), details[f].alias("detail")) for f in ORDER]
    return resolved.withColumn("signal_detail", signal_detail()).withColumn("contributions", F.array(*parts))
