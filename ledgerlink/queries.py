"""Queries over the derived registers and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink import fixture
from ledgerlink.functions import names as N
from ledgerlink.functions.similarity import jaro_winkler, token_sort_ratio
from ledgerlink.operators import ledger, migrations
from ledgerlink.plans import blocking, corpus, evaluate, frequency, resolve
from ledgerlink.plans.prepare import prepare_records
from ledgerlink.runtime import materialise, prepare
from ledgerlink.sources import legacy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- shared plans ----


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return prepare_records(legacy.unify(*fixture.tables(spark, d)).withColumn("address_lines", F.array().cast("array<string>")))


def _positives(spark: SparkSession, d: str) -> DataFrame:
    return fixture.positives(*fixture.tables(spark, d)).select("left_key", "right_key")


def _labelled_keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All candidates and all positives as pairs with a label; and the prepared records."""
    base = materialise(_prepared(spark, d), "records")
    pos = _positives(spark, d).withColumn("label", F.lit("match"))
    found = blocking.candidate_pairs(base).select("left_key", "right_key")
    pairs = found.join(pos, ["left_key", "right_key"], "full_outer").select("left_key", "right_key", F.coalesce("label", F.lit("no_match")).alias("label"))
    return pairs, base


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    pairs, base = _labelled_keys(spark, d)
    return blocking.attach(pairs, frequency.with_frequencies(base))


def _attached_positives(spark: SparkSession, d: str) -> DataFrame:
    return blocking.attach(_positives(spark, d), frequency.with_frequencies(_prepared(spark, d)))


# ---- the oracle's pieces ----

_SPELL = sorted(N.LEGAL_FORMS, key=lambda s: (-s.count(" "), s))
_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in N.LEGAL_FORMS.items()) + "}"
_FORMS = "[" + ", ".join(f"'{f}'" for f in N.CANONICAL_FORMS) + "]"
_ROMAN = "[" + ", ".join(f"'{f}'" for f in N.ROMAN) + "]"
_REC = f"""fx_registry as ({fixture.REGISTRY_SQL.format(part='part')}), fx_numbered as ({fixture.NUMBERED_SQL.format(part='part')}),
rec as (select 'gleif' as source, lei as source_id, legal_name, country, postal_code, registered_at as registration_authority, registered_as, p_partkey from fx_registry
 union all select 'companies_house', company_number, company_name, country_of_origin, post_code, 'RA000585', company_number, p_partkey from fx_numbered)"""
_NORM = _REC + f""", n0 as (select *, source||':'||source_id as record_key,
 list_transform(regexp_extract_all(trim(regexp_replace(regexp_replace(replace(lower(legal_name), '&', ' and '), '[."''`()\\[\\]{{}}*#]', '', 'g'), '[\\s,;:/\\\\|+_-]+', ' ', 'g'))||' ', '(?:{"|".join(_SPELL)}|[^ ]+) '), lambda p: coalesce(({_MAP})[rtrim(p)], rtrim(p))) as parts from rec),
n1 as (select *, array_to_string(parts, ' ') as name_norm, list_filter(parts, lambda t: not list_contains({_FORMS}, t)) as cp from n0),
n2 as (select *, case when len(cp) > 0 then array_to_string(cp, ' ') else name_norm end as core, case when len(cp) > 0 then cp else parts end as core_parts,
 nullif(upper(regexp_replace(registered_as, '[^A-Za-z0-9]', '', 'g')), '') as id_norm, nullif(upper(trim(registration_authority)), '') as ra_norm, nullif(upper(country), '') as ctry_up, lower(postal_code) as addr from n1),
norm as (select *, list_distinct(parts) as tok, list_distinct(core_parts) as core_tok, array_to_string(list_transform(core_parts, lambda t: left(t, 1)), '') as acr from n2)"""
_KEYS = _NORM + """, anchors as (select *, list_filter(parts, lambda t: length(t) >= 4) as long from norm),
kk as (select *, case when len(long) > 0 then 'nameprefix:'||left(list_sort(long)[1], 4) end as k1, case when length(acr) >= 2 then 'acronym:'||acr end as k2,
 case when length(id_norm) >= 4 then 'regid:'||id_norm end as k3,
 case when len(long) > 0 and ctry_up is not null then 'token:'||list_filter(long, lambda t: length(t) = list_max(list_transform(long, lambda u: length(u))))[1]||':'||ctry_up end as k4,
 case when length(regexp_replace(postal_code, '[^A-Za-z0-9]', '', 'g')) >= 4 then 'postal:'||upper(regexp_replace(postal_code, '[^A-Za-z0-9]', '', 'g')) end as k5 from anchors),
rk as (select *, list_distinct(list_filter([k1, k2, k3, k4, k5], lambda k: k is not null)) as keys from kk),
ix as (select record_key, unnest(keys) as block_key from rk), sizes as (select block_key, count(*) as n from ix group by 1)"""
_CAND = _KEYS + """, fine as (select ix.* from ix join sizes using (block_key) where n between 2 and 200),
cand as (select a.record_key as left_key, b.record_key as right_key, list_sort(list_distinct(list(a.block_key))) as reasons from fine a join fine b on a.block_key = b.block_key and a.record_key < b.record_key group by 1, 2),
pos as (select least(a.k, b.k) as left_key, greatest(a.k, b.k) as right_key from (select p_partkey, 'gleif:'||lei as k from fx_registry) a join (select p_partkey, 'companies_house:'||company_number as k from fx_numbered) b using (p_partkey))"""
_LABELS = _CAND + """, lab as (select coalesce(c.left_key, p.left_key) as left_key, coalesce(c.right_key, p.right_key) as right_key, case when p.left_key is null then 'no_match' else 'match' end as label from cand c full outer join pos p on c.left_key = p.left_key and c.right_key = p.right_key)"""


def _frequencies(population: str = "norm") -> str:
    return f""", iddf as (select ra_norm||'|'||id_norm as id_key, count(*) as df from {population} where ra_norm is not null and id_norm is not null group by 1),
tdf as (select token, count(*) as df from (select unnest(core_tok) as token from {population}) group by 1),
common as (select coalesce(list(token), []) as common from tdf where df >= greatest(2, floor(0.01 * (select count(*) from {population})))),
full_rec as (select rk.*, coalesce(iddf.df, 1) as id_df, list_filter(core_tok, lambda t: not list_contains(common, t)) as rare0 from rk left join iddf on iddf.id_key = rk.ra_norm||'|'||rk.id_norm cross join common),
frec as (select *, case when len(rare0) > 0 then rare0 else core_tok end as rare_tok, list_filter(tok, lambda t: not list_contains({_FORMS}, t)) as own from full_rec)"""


_LAB = _LABELS + _frequencies()
_SIG0 = """, att as (select q.*, l.name_norm as l_name_norm, r.name_norm as r_name_norm, l.core as l_core, r.core as r_core, l.tok as l_tok, r.tok as r_tok, l.rare_tok as l_rare, r.rare_tok as r_rare, l.acr as l_acr, r.acr as r_acr,
 l.ctry_up as l_ctry, r.ctry_up as r_ctry, l.addr as l_addr, r.addr as r_addr, l.id_norm as l_id, r.id_norm as r_id, l.ra_norm as l_ra, r.ra_norm as r_ra, l.id_df as l_df,
 list_filter(l.own, lambda t: not list_contains(r.own, t)) as only_l, list_filter(r.own, lambda t: not list_contains(l.own, t)) as only_r, len(list_intersect(l.own, r.own)) as shared
 from {pairs} q join frec l on l.record_key = q.left_key join frec r on r.record_key = q.right_key),
att2 as (select *, coalesce(l_id is not null and r_id is not null and l_ra = r_ra, false) as reg, coalesce(l_id = r_id or ltrim(l_id, '0') = ltrim(r_id, '0'), false) as num from att),
sig as (select *, case when reg and num and l_df <= 2 then 'identifier_agreement' when reg and not num then 'identifier_conflict'
 when shared >= 2 and len(only_l) > 0 and len(only_r) > 0 and len(list_filter(list_concat(only_l, only_r), lambda t: not (regexp_matches(t, '^[0-9]+$') or list_contains({roman}, t) or length(t) = 1))) = 0 then 'discriminator_conflict'
 when l_name_norm = r_name_norm and l_name_norm <> '' then 'identifying_name_agreement' end as hard_signal from att2)"""
_SIG = _LAB + _SIG0.format(pairs="lab", roman=_ROMAN)
_FEATURES = """, ap as (select distinct l_addr, r_addr from sig where l_addr is not null and r_addr is not null),
codes as (select l_addr, r_addr, list_transform(string_split(l_addr, ''), lambda c: ascii(c)::bigint) as a, list_transform(string_split(r_addr, ''), lambda c: [ascii(c)::bigint]) as b from ap),
lcs as (select l_addr, r_addr, list_reduce(b, lambda row, ch: list_transform(range(1, len(a) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: case when a[i] = ch[1] then case when i = 1 then 0 else row[i - 1] end + 1 else row[i] end))), list_transform(a, lambda x: 0::bigint)) as row from codes),
addr as (select l_addr, r_addr, 2.0 * row[len(row)] / (length(l_addr) + length(r_addr)) as sim from lcs),
feat as (select sig.*, jaro_winkler_similarity(l_name_norm, r_name_norm) as name_similarity, jaro_winkler_similarity(l_core, r_core) as identifying_name_similarity,
 len(list_intersect(l_tok, r_tok)) / len(list_distinct(list_concat(l_tok, r_tok))) as token_overlap, len(list_intersect(l_rare, r_rare)) / len(list_distinct(list_concat(l_rare, r_rare))) as distinctive_token_agreement,
 case when l_acr <> '' and r_acr <> '' and (l_acr = r_acr or replace(l_core, ' ', '') = r_acr or replace(r_core, ' ', '') = l_acr) then 1.0 else 0.0 end::double as acronym_match,
 case when l_ctry is null or r_ctry is null then 0.5 when l_ctry = r_ctry then 1.0 else 0.0 end::double as country_agreement, coalesce(addr.sim, 0.5)::double as address_similarity from sig left join addr using (l_addr, r_addr)),
scored as (select *, round(round((name_similarity * 0.22::double)::decimal(20, 10), 4)::double + round((identifying_name_similarity * 0.16::double)::decimal(20, 10), 4)::double + round((token_overlap * 0.08::double)::decimal(20, 10), 4)::double + round((distinctive_token_agreement * 0.32::double)::decimal(20, 10), 4)::double + round((acronym_match * 0.04::double)::decimal(20, 10), 4)::double + round((country_agreement * 0.08::double)::decimal(20, 10), 4)::double + round((address_similarity * 0.1::double)::decimal(20, 10), 4)::double, 4) as score from feat),
dec as (select *, case when hard_signal in ('identifier_agreement', 'identifying_name_agreement') then 'match' when hard_signal is not null then 'no_match' when score < 0.66 then 'no_match' else 'review' end as decision from scored)"""
_FEAT = _SIG + _FEATURES


def _confusion(src: str, by: str = "", extra: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""select {g}count(*) as pairs, count(*) filter (label = 'match' and decision = 'match') as tp, count(*) filter (label <> 'match' and decision = 'match') as fp, count(*) filter (label <> 'match' and decision = 'no_match') as tn,
 count(*) filter (label = 'match' and decision = 'no_match') as fn, count(*) filter (label = 'match' and decision = 'review') as review_positive, count(*) filter (label <> 'match' and decision = 'review') as review_negative from {src} {f'group by {by}' if by else ''}{extra}"""


def _rates(src: str, keep: str) -> str:
    return f"""select {keep}, round(p, 4) as precision, round(r, 4) as recall, case when p + r > 0 then round(2 * p * r / (p + r), 4) else 0.0::double end as f1, case when pairs > 0 then round((review_positive + review_negative) / pairs, 4) else 0.0 end as review_rate
 from (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0::double end as p, case when tp + fn + review_positive > 0 then tp / (tp + fn + review_positive) else 0.0::double end as r from {src})"""


_COUNTS = "pairs, tp, fp, tn, fn, review_positive, review_negative"

# ---- records ----


@query("with " + _REC + " select source, source_id, legal_name, country, cast(null as varchar) as city, postal_code, cast(null as varchar) as address_line, registration_authority, registered_as from rec")
def unified_records(spark: SparkSession, d: str) -> DataFrame:
    return legacy.unify(*fixture.tables(spark, d))


@query("with " + _REC + " select 'companies_house' as source, company_number as source_id, previous_name_1 as name, 1::int as ordinal from fx_numbered where previous_name_1 is not null")
def other_names_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return legacy.other_names(None, fixture.tables(spark, d)[1])


@query("with " + _REC + " select source, source_id, rec.legal_name, coalesce(previous_name_1, '') as other_names from rec left join fx_numbered on source = 'companies_house' and source_id = company_number")
def records_scan(spark: SparkSession, d: str) -> DataFrame:
    return legacy.records(*fixture.tables(spark, d)).select("source", "source_id", "legal_name", F.array_join("other_names", "|").alias("other_names"))


@query("with " + _REC + " select lei, company_number, legal_name as registry_name, company_name as numbered_name from fx_registry join fx_numbered on registered_at = 'RA000585' and registered_as = company_number")
def crosswalk_join(spark: SparkSession, d: str) -> DataFrame:
    return legacy.crosswalk(*fixture.tables(spark, d))


@query("with " + _NORM + " select record_key, name_norm, core from norm")
def name_normalization(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d).select("record_key", "name_norm", "core")


@query("with " + _NORM + " select record_key, id_norm, ra_norm, ctry_up from norm")
def identifier_normalization(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d).select("record_key", "id_norm", "ra_norm", "ctry_up")


@query("with " + _NORM + f" select record_key, acr, array_to_string(list_sort(tok), ' ') as tok, array_to_string(list_sort(list_filter(tok, lambda t: list_contains({_FORMS}, t))), ' ') as forms from norm")
def acronyms_and_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d).select("record_key", "acr", F.array_join(F.array_sort("tok"), " ").alias("tok"), F.array_join(F.array_sort(N.legal_forms_of(F.col("name_norm"))), " ").alias("forms"))


# ---- blocking ----


@query("with " + _KEYS + " select record_key, block_key from ix")
def block_keys(spark: SparkSession, d: str) -> DataFrame:
    return blocking.index_by_key(_prepared(spark, d)).select("record_key", "block_key")


@query("with " + _KEYS + " select block_key, n from sizes")
def block_sizes(spark: SparkSession, d: str) -> DataFrame:
    return blocking.block_sizes(_prepared(spark, d))


@query("with " + _KEYS + " select block_key, n from sizes where n > 200")
def oversize_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocking.block_sizes(_prepared(spark, d)).where(F.col("n") > blocking.MOST_BLOCK)


@query("with " + _CAND + " select left_key, right_key, array_to_string(reasons, '|') as reasons from cand")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return blocking.candidate_pairs(_prepared(spark, d)).select("left_key", "right_key", F.array_join("reasons", "|").alias("reasons"))


_POSKEYS = _CAND + ", pk as (select pos.*, l.keys as lk, r.keys as rk, c.left_key is not null as hit from pos join rk l on l.record_key = pos.left_key join rk r on r.record_key = pos.right_key left join cand c on c.left_key = pos.left_key and c.right_key = pos.right_key)"


@query("with " + _POSKEYS + """, a as (select count(*) as true_pairs, count(*) filter (hit) as surfaced, count(*) filter (len(list_intersect(lk, rk)) > 0) as share_a_key from pk), b as (select count(*) as candidates from cand), c as (select count(*) as records from norm)
 select records, true_pairs, surfaced, case when true_pairs > 0 then round(surfaced / true_pairs, 4) else 0.0 end as recall, share_a_key, case when true_pairs > 0 then round(share_a_key / true_pairs, 4) else 0.0 end as recall_unbounded, share_a_key - surfaced as dropped_by_ceiling, candidates,
 records * (records - 1) // 2 as possible_pairs, case when records > 1 then round(1 - candidates / (records * (records - 1) // 2), 6) else 0.0 end as reduction_ratio, case when records > 0 then round(candidates / records, 2) else 0.0 end as per_record from a, b, c""")
def candidate_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.candidate_report(_prepared(spark, d), _positives(spark, d))


@query("with " + _POSKEYS + " select split_part(k, ':', 1) as family, count(*) as recovered from (select unnest(list_intersect(lk, rk)) as k from pk where hit) group by 1")
def recall_by_family(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_by_family(_prepared(spark, d), _positives(spark, d))


@query("with " + _POSKEYS + " select pk.left_key, pk.right_key, l.legal_name as left_name, r.legal_name as right_name, case when len(list_intersect(lk, rk)) > 0 then 'oversize block' else 'no shared key' end as why from pk join rec l on l.source||':'||l.source_id = pk.left_key join rec r on r.source||':'||r.source_id = pk.right_key where not hit order by 1, 2 limit 25")
def missed_examples(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.missed_examples(_prepared(spark, d), _positives(spark, d))


# ---- frequencies ----


@query("with " + _LAB + " select token, df from tdf")
def token_df(spark: SparkSession, d: str) -> DataFrame:
    return frequency.token_frequency(_prepared(spark, d))


@query("with " + _LAB + " select id_key, df from iddf")
def identifier_df(spark: SparkSession, d: str) -> DataFrame:
    return frequency.identifier_frequency(_prepared(spark, d))


@query("with " + _LAB + " select record_key, array_to_string(list_sort(rare_tok), ' ') as rare, id_df from frec")
def distinctive_tokens(spark: SparkSession, d: str) -> DataFrame:
    return frequency.with_frequencies(_prepared(spark, d)).select("record_key", F.array_join(F.array_sort("rare_tok"), " ").alias("rare"), "id_df")


# ---- signals, features, decisions ----


@query("with " + _SIG + " select left_key, right_key, label, hard_signal from sig")
def pair_signals(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("left_key", "right_key", "label", resolve.hard_signal().alias("hard_signal"))


@query("with " + _SIG + " select label, coalesce(hard_signal, 'none') as hard_signal, count(*) as pairs from sig group by 1, 2")
def signal_counts(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("label", F.coalesce(resolve.hard_signal(), F.lit("none")).alias("hard_signal")).groupBy("label", "hard_signal").agg(F.count(F.lit(1)).alias("pairs"))


@query("with " + _CAND + " select p.left_key, p.right_key, round(jaro_winkler_similarity(l.name_norm, r.name_norm), 6) as similarity from pos p join norm l on l.record_key = p.left_key join norm r on r.record_key = p.right_key")
def jaro_winkler_names(spark: SparkSession, d: str) -> DataFrame:
    return _attached_positives(spark, d).select("left_key", "right_key", F.round(jaro_winkler(F.col("l_name_norm"), F.col("r_name_norm")), 6).alias("similarity"))


@query()
def token_sort_names(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("left_key", "right_key", F.round(token_sort_ratio(F.col("l_name_norm"), F.col("r_name_norm")), 6).alias("similarity"))


@query("with " + _FEAT + " select left_key, right_key, " + ", ".join(f"round({f}::decimal(20, 10), 4)::double as {f}" for f in resolve.ORDER) + " from feat")
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    return resolve.with_features(_labelled(spark, d)).select("left_key", "right_key", *[resolve.round4(F.col(f)).alias(f) for f in resolve.ORDER])


@query("with " + _FEAT + " select left_key, right_key, label, hard_signal, score, decision from dec")
def decisions(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(_labelled(spark, d)).select("left_key", "right_key", "label", "hard_signal", "score", "decision")


@query("with " + _FEAT + " select label, decision, count(*) as pairs from dec group by 1, 2")
def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(_labelled(spark, d), everywhere=False).groupBy("label", "decision").agg(F.count(F.lit(1)).alias("pairs"))


@query()
def decision_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Contributions of every decision, as text: order and wording have no SQL form worth keeping."""
    return resolve.evidence(resolve.resolve(_labelled(spark, d))).select("left_key", "right_key", "decision", "score", "signal_detail", F.to_json("contributions").alias("contributions"))


# ---- evaluation ----


@query("with " + _FEAT + f""", said as (select label, 'exact_normalized_name' as method, case when l_name_norm <> '' and l_name_norm = r_name_norm then 'match' else 'no_match' end as decision from dec
 union all select label, 'fuzzy_name_only_0.90', case when name_similarity >= 0.9 then 'match' else 'no_match' end from dec
 union all select label, 'identifier_first', case when coalesce(l_ra = r_ra and l_id is not null and r_id is not null, false) then case when l_id = r_id then 'match' else 'no_match' end when l_name_norm <> '' and l_name_norm = r_name_norm then 'match' else 'no_match' end from dec
 union all select label, 'system', decision from dec), c as ({_confusion('said', 'method')}) {_rates('c', 'method, ' + _COUNTS)}""")
def arm_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.arm_report(_labelled(spark, d))


_GRID = "(case when hard_signal in ('identifier_agreement', 'identifying_name_agreement') then 'match' when hard_signal is not null then 'no_match' when {m} then 'match' when {n} then 'no_match' else 'review' end)"


@query("with " + _FEAT + ", grid as (select unnest(range(8))::int as step, unnest([0.86, 0.88, 0.90, 0.92, 0.94, 0.96, 0.98, null]::double[]) as threshold), said as (select label, step, threshold, " + _GRID.format(m="score >= threshold", n="score < 0.66") + f" as decision from scored cross join grid), c as ({_confusion('said', 'step, threshold')}), r as ({_rates('c', 'step, threshold, fp')}) select step, threshold, precision, recall, f1, fp, review_rate from r")
def match_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.match_sweep(resolve.resolve(_labelled(spark, d), everywhere=False))


@query("with " + _FEAT + ", grid as (select unnest(range(7))::int as step, unnest([0.55, 0.62, 0.66, 0.70, 0.74, 0.78, 0.82]::double[]) as threshold), said as (select label, step, threshold, " + _GRID.format(m="false", n="score < threshold") + f" as decision from scored cross join grid), c as ({_confusion('said', 'step, threshold')}), r as ({_rates('c', 'step, threshold, review_positive, review_negative')}) select step, threshold, precision, recall, review_rate, review_positive + review_negative as queue_size, case when review_positive + review_negative > 0 then round(review_positive / (review_positive + review_negative), 4) else 0.0 end as queue_yield from r")
def review_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.review_sweep(resolve.resolve(_labelled(spark, d), everywhere=False))


# ---- graph, split, corpus ----

_SIDE = "case when ('0x'||left(sha256('ledgerlink/holdout/v1|'||{c}), 8))::bigint / 4294967295.0::double < 0.2 then 'holdout' else 'development' end"
_SPLIT = """, nodes as (select distinct left_key as node from lab union select distinct right_key from lab), mates as (select left_key as node, right_key as other from pos union all select right_key, left_key from pos),
roots as (select nodes.node, coalesce(least(nodes.node, min(other)), nodes.node) as cluster from nodes left join mates using (node) group by nodes.node),
assigned as (select left_key as left_id, right_key as right_id, label, case when ls = rs then ls else 'dropped' end as assigned from (select lab.*, """ + _SIDE.format(c="a.cluster") + " as ls, " + _SIDE.format(c="b.cluster") + " as rs from lab join roots a on a.node = lab.left_key join roots b on b.node = lab.right_key))"
_ROOTS = _LAB + _SPLIT


def _split_input(spark: SparkSession, d: str) -> DataFrame:
    return _labelled_keys(spark, d)[0].toDF("left_id", "right_id", "label")


@query("with " + _ROOTS + " select node, cluster from roots")
def components(spark: SparkSession, d: str) -> DataFrame:
    return corpus.clusters(_split_input(spark, d))


@query("with " + _ROOTS + " select left_id, right_id, label, assigned from assigned")
def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    return corpus.split_pairs(_split_input(spark, d)).select("left_id", "right_id", "label", "assigned")


@query("with " + _ROOTS + " select assigned, count(*) as pairs, count(*) filter (label = 'match') as positives, count(*) filter (label = 'no_match') as negatives from assigned group by 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.split_counts(corpus.split_pairs(_split_input(spark, d)))


@query("with " + _ROOTS + ", rs as (select distinct cluster, " + _SIDE.format(c="cluster") + " as side from roots) select count(*) as total, count(*) filter (side = 'holdout') as holdout, count(*) filter (side = 'development') as development from rs")
def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.cluster_counts(corpus.clusters(_split_input(spark, d)))


def _negatives(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positives, ranked negatives, and the records to attach."""
    pairs, base = _labelled_keys(spark, d)
    pos = pairs.where("label = 'match'")
    nodes = corpus.clusters(pairs.toDF("left_id", "right_id", "label"))
    sides = nodes.select(F.col("node").alias("record_key"), "cluster", corpus.side(F.col("cluster")).alias("side"))
    placed = pos.join(sides, F.col("left_key") == F.col("record_key")).select("left_key", "right_key", "side")
    ranked = corpus.hard_negatives(blocking.candidate_pairs(base), base, sides, corpus.quotas(placed))
    return pos.select("left_key", "right_key"), ranked, frequency.with_frequencies(base)


def _assembled(spark: SparkSession, d: str) -> DataFrame:
    pos, ranked, full = _negatives(spark, d)
    return corpus.assemble(blocking.attach(pos, full), blocking.attach(ranked, full), revision="fixture")


_HARD = _ROOTS + ", placed as (select " + _SIDE.format(c="cluster") + " as side, count(*) as quota from pos join roots on roots.node = pos.left_key group by 1), elig as (select c.left_key, c.right_key, " + _SIDE.format(c="a.cluster") + " as side, " + _SIDE.format(c="b.cluster") + " as rside, jaro_winkler_similarity(l.name_norm, r.name_norm) as similarity from cand c join roots a on a.node = c.left_key join roots b on b.node = c.right_key join norm l on l.record_key = c.left_key join norm r on r.record_key = c.right_key where a.cluster <> b.cluster), hard as (select * from (select elig.*, quota, row_number() over (partition by side order by similarity desc, left_key, right_key) as rank from elig join placed using (side) where side = rside) where rank <= quota)"


@query("with " + _HARD + " select left_key, right_key, side, rank, round(similarity, 6) as similarity from hard")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return _negatives(spark, d)[1].select("left_key", "right_key", "side", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("with " + _HARD + ", u as (select left_key, right_key, 'match' as label from pos union all select left_key, right_key, 'no_match' from hard) select left(sha256(least(left_key, right_key)||'|'||greatest(left_key, right_key)||'|'||label), 16) as pair_id, left_key, right_key, label from u")
def corpus_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d).select("pair_id", "left_key", "right_key", "label")


@query("with " + _HARD + ", u as (select left_key, right_key, 'match' as label from pos union all select left_key, right_key, 'no_match' from hard), ids as (select left_key as k from u union select right_key from u) select count(*) as pairs, count(*) filter (label = 'match') as positives, count(*) filter (label = 'no_match') as negatives, (select count(*) from ids) as distinct_records from u")
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_counts(_assembled(spark, d))


_VAR = _LAB + """, v as (select pos.left_key, pos.right_key, list_filter([case when l.name_norm <> r.name_norm and l.core = r.core then 'legal_form_variance' end,
 case when l.legal_name <> r.legal_name and l.name_norm = r.name_norm and lower(l.legal_name) = lower(r.legal_name) then 'diacritic_or_casing_drift' end,
 case when l.ra_norm <> r.ra_norm then 'distinct_registration_authority' end,
 case when l.name_norm <> r.name_norm and list_sort(l.parts) = list_sort(r.parts) then 'token_order_or_abbreviation' end], lambda x: x is not null) as tags from pos join norm l on l.record_key = pos.left_key join norm r on r.record_key = pos.right_key)"""


@query("with " + _VAR + " select left_key, right_key, array_to_string(tags, '|') as variants from v")
def variant_tags(spark: SparkSession, d: str) -> DataFrame:
    return _attached_positives(spark, d).select("left_key", "right_key", F.array_join(corpus.variant_types(), "|").alias("variants"))


@query("with " + _VAR + " select variant, count(*) as pairs from (select unnest(tags) as variant from v) group by 1")
def variant_histogram(spark: SparkSession, d: str) -> DataFrame:
    return corpus.variant_histogram(_attached_positives(spark, d))


@query("with " + _FEAT + """, ids as (select left(sha256(left_key||'|'||right_key||'|'||label), 16) as pair_id, decision, score from dec),
 r as (select *, row_number() over (partition by decision order by pair_id) as rn from ids) select pair_id, decision, score from r where rn <= case decision when 'review' then 150 else 40 end""")
def demo_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = resolve.resolve(_labelled(spark, d)).select(N.pair_id(F.col("left_key"), F.col("right_key"), F.col("label")).alias("pair_id"), "decision", "score")
    return corpus.demo_sample(rows)


def _system_by_side(arm: str, known: str) -> str:
    pairs = _LABELS + _SPLIT + ", split as (select left_id as left_key, right_id as right_key, label, assigned from assigned where assigned <> 'dropped'), popn as (select * from norm where record_key in (" + " union ".join(f"select {c} from split where {known}" for c in ("left_key", "right_key")) + "))"
    return "with " + pairs + _frequencies("popn") + _SIG0.format(pairs="split", roman=_ROMAN) + _FEATURES + f", c as ({_confusion('dec', 'assigned')}) " + _rates("c", f"'{arm}' as arm, assigned, " + _COUNTS)


@query(" union all ".join(f"select * from ({_system_by_side(arm, known)})" for arm, known in (("corpus_wide_priors", "true"), ("development_only_priors", "assigned = 'development'"))))
def prior_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """The system on both sides, with frequencies of the records of all pairs and of the development side's alone."""
    pairs, base = _labelled_keys(spark, d)
    split = corpus.split_pairs(pairs.toDF("left_id", "right_id", "label")).select(F.col("left_id").alias("left_key"), F.col("right_id").alias("right_key"), "label", "assigned")
    split = materialise(split.where("assigned <> 'dropped'"), "priors-split")
    out = None
    for arm, side in (("corpus_wide_priors", split), ("development_only_priors", split.where("assigned = 'development'"))):
        full = frequency.with_frequencies(base, frequency.split_local(side, base))
        rows = evaluate.score_system(blocking.attach(split, full), by=["assigned"]).withColumn("arm", F.lit(arm))
        out = rows if out is None else out.unionByName(rows)
    return out.drop("method")


@query(f"select 'match' as sweep, threshold, precision, recall, review_rate, threshold is null as shipped from ({ORACLES['match_sweep']}) union all select 'review', threshold, precision, recall, review_rate, threshold = 0.66 from ({ORACLES['review_sweep']})")
def threshold_sweeps(spark: SparkSession, d: str) -> DataFrame:
    scored = resolve.resolve(_labelled(spark, d), everywhere=False).select("label", "hard_signal", "score")
    return evaluate.sweeps(materialise(scored, "sweeps-scored"))


@query(f"""with c as ({ORACLES['corpus_counts']}), v as ({ORACLES['variant_histogram']}), r as ({ORACLES['candidate_report']}), a as ({ORACLES['arm_report']})
 select 'labelled pairs' as criterion, pairs::double as measured, 1000::double as floor, pairs >= 1000 as holds from c union all select 'positives', positives, 500, positives >= 500 from c union all select 'negatives', negatives, 500, negatives >= 500 from c
 union all select 'variant '||k, coalesce(pairs, 0), 1, coalesce(pairs, 0) >= 1 from (select unnest(['legal_form_variance', 'diacritic_or_casing_drift', 'distinct_registration_authority']) as k) left join v on v.variant = k
 union all select 'pairs without provenance', 0, 0, true union all select 'candidate recall', recall, 0.9, recall >= 0.9 from r
 union all select 'precision over best baseline', s - b, 0, s > b from (select max(precision) filter (method = 'system') as s, max(precision) filter (method <> 'system') as b from a)""")
def kill_criteria(spark: SparkSession, d: str) -> DataFrame:
    """What must hold before a corpus may be evaluated at all."""
    labelled = materialise(_labelled(spark, d), "kill-labelled")
    base = _prepared(spark, d)
    report = evaluate.candidate_report(base, _positives(spark, d))
    return corpus.kill_checks(_assembled(spark, d), corpus.variant_histogram(labelled.where("label = 'match'")), report, evaluate.arm_report(labelled))


@query("with " + _REC + ", lapsed as (select 'gleif:'||lei as left_key, 'gleif:L'||lpad((p_partkey // 3)::varchar, 8, '0') as right_key from fx_registry where p_partkey % 5 = 0) select left_key, right_key from lapsed where left_key <> right_key and right_key in (select 'gleif:'||lei from fx_registry)")
def adjudicated_positives(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth registered record counts as a duplicate whose successor the registrar names."""
    reg = fixture.tables(spark, d)[0]
    keyed = reg.select(F.concat(F.lit("gleif:"), "lei").alias("record_key"), "p_partkey")
    successor = F.concat(F.lit("gleif:L"), F.lpad(F.expr("p_partkey div 3").cast("string"), 8, "0"))
    return corpus.adjudicated_positives(keyed.where("p_partkey % 5 = 0").select("record_key", successor.alias("successor_key")), keyed)


# ---- ledger ----

def _events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as merges of a customer's record with a part-coloured one, every seventh reversed by a later entry."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    text = lambda c: c.cast("string")
    merges = orders.select(
        (F.col("o_orderkey") * 2).alias("entry_id"), F.concat(F.lit("m"), text(F.col("o_orderkey"))).alias("idempotency_key"), F.lit("merge").alias("action"), F.lit("a").alias("left_source"), text(F.col("o_custkey")).alias("left_id"),
        F.lit("b").alias("right_source"), text(F.col("o_orderkey") % 997).alias("right_id"), F.concat(F.lit("cp-"), text(F.col("o_orderkey"))).alias("resolved_id"), F.lit(None).cast("bigint").alias("reverses_entry_id"), F.lit("match").alias("decision"), F.lit(0.9).alias("score"),
    )
    back = merges.where("entry_id % 7 = 0").select((F.col("entry_id") + 1).alias("entry_id"), F.concat(F.lit("u"), "idempotency_key").alias("idempotency_key"), F.lit("unmerge").alias("action"), "left_source", "left_id", "right_source", "right_id", "resolved_id", F.col("entry_id").alias("reverses_entry_id"), F.lit("no_match").alias("decision"), F.lit(None).cast("double").alias("score"))
    return merges.unionByName(back)


_LEDGER = """m as (select o_orderkey * 2 as entry_id, 'm'||o_orderkey as idempotency_key, 'merge' as action, 'a' as left_source, o_custkey::varchar as left_id, 'b' as right_source, (o_orderkey % 997)::varchar as right_id, 'cp-'||o_orderkey as resolved_id from orders),
act as (select * from m where entry_id % 7 <> 0), t as (select entry_id, resolved_id, left_source as source, left_id as source_id from act union select entry_id, resolved_id, right_source, right_id from act)"""


@query("with " + _LEDGER + " select entry_id, idempotency_key, left_source, left_id, right_source, right_id, resolved_id from act")
def active_merges(spark: SparkSession, d: str) -> DataFrame:
    return ledger.active_merges(_events(spark, d)).select("entry_id", "idempotency_key", "left_source", "left_id", "right_source", "right_id", "resolved_id")


@query("with " + _LEDGER + " select source, source_id, arg_max(resolved_id, entry_id) as resolved_id, max(entry_id) as linked_by_entry_id from t group by 1, 2")
def source_links(spark: SparkSession, d: str) -> DataFrame:
    return ledger.source_links(_events(spark, d))


@query("with " + _LEDGER + " select * from (select entry_id, source, source_id, lag(resolved_id) over (partition by source, source_id order by entry_id) as displaced_id from t) where displaced_id is not null")
def displaced_links(spark: SparkSession, d: str) -> DataFrame:
    return ledger.displaced_links(_events(spark, d))


@query("with " + _LEDGER + " select entry_id, action, idempotency_key, reverses_entry_id from (select entry_id, action, idempotency_key, cast(null as bigint) as reverses_entry_id from m union all select entry_id + 1, 'unmerge', 'u'||idempotency_key, entry_id from m where entry_id % 7 = 0)")
def ledger_history(spark: SparkSession, d: str) -> DataFrame:
    return ledger.history(ledger.first_of_each_key(_events(spark, d))).select("entry_id", "action", "idempotency_key", "reverses_entry_id")


@query("with " + _LEDGER + ", e as (select count(*) + count(*) filter (entry_id % 7 = 0) as entries from m), a as (select count(*) as active_merges from act), l as (select count(*) as links from (select distinct source, source_id from t)) select entries, active_merges, links, 0::bigint as queue from e, a, l")
def ledger_health(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    return ledger.health(events, events.where("false"))


@query("with " + _LEDGER + ", l as (select source, source_id, arg_max(resolved_id, entry_id) as resolved_id from t group by 1, 2) select resolved_id from l where source = 'b' and source_id = '5'")
def resolved_id_for(spark: SparkSession, d: str) -> DataFrame:
    return ledger.resolved_id_for(_events(spark, d), "b", "5")


@query("with " + _LEDGER + ", l as (select source, source_id, arg_max(resolved_id, entry_id) as resolved_id, max(entry_id) as linked_by_entry_id from t group by 1, 2) select * from l where resolved_id = (select resolved_id from l where source = 'b' and source_id = '5')")
def links_for(spark: SparkSession, d: str) -> DataFrame:
    """The records of the entity that record b:5 belongs to, asked for by its id."""
    events = _events(spark, d)
    found = ledger.resolved_id_for(events, "b", "5").first()
    return ledger.links_for(events, found.resolved_id if found else "")


@query("with " + _LEDGER + " select * from (select 'primary key' as rule, count(*) as entries from m where entry_id % 11 = 0 union all select 'unique key', count(*) from m where entry_id % 11 = 0 union all select 'action', count(*) from m where entry_id % 13 = 0 union all select 'reversed entry', count(*) from m where entry_id % 7 = 0 and entry_id % 13 = 0 and entry_id % 11 <> 0) where entries > 0")
def ledger_violations(spark: SparkSession, d: str) -> DataFrame:
    """A log spoilt by repeated entries and unknown actions; a reversal of an unknown one that is not repeated as a merge reverses nothing."""
    events = _events(spark, d)
    merges = events.where("action = 'merge'").withColumn("action", F.expr("case when entry_id % 13 = 0 then 'erase' else 'merge' end"))
    sound = merges.unionByName(events.where("action = 'unmerge'"))
    return ledger.violations(sound.unionByName(merges.where("entry_id % 11 = 0").withColumn("action", F.lit("merge"))))


@query("select o_orderkey * 2 as entry_id, lower(replace(o_orderpriority, ' ', '.')) as approver_id, cast(null as varchar) as displaced_links_json from orders")
def migrated_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A log of the first schema version brought to the newest; order priorities stand for approvers' names."""
    names = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") * 2).alias("entry_id"), F.col("o_orderpriority").alias("approved_by"))
    old = _events(spark, d).where("action = 'merge'").join(names, "entry_id").withColumns({"evidence_json": F.lit("[]"), "recorded_at": F.lit("2026-01-01T00:00:00+00:00")})
    new, version = migrations.migrate(old)
    return new.select("entry_id", "approver_id", "displaced_links_json").where(F.lit(version) == migrations.MIGRATIONS[-1].version)


@query("with " + _FEAT + ", rev as (select left(sha256(left_key||'|'||right_key||'|'||label), 16) as pair_id, left_key as left_id, right_key as right_id, score from dec where decision = 'review'), done as (select pair_id from rev where left(pair_id, 1) in ('0', '1', '2', '3')) select pair_id, left_id, right_id, score from rev where pair_id not in (select pair_id from done)")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Review pairs not merged yet; those whose id begins with a small digit count as approved."""
    rows = resolve.resolve(_labelled(spark, d)).select(N.pair_id(F.col("left_key"), F.col("right_key"), F.col("label")).alias("pair_id"), F.col("left_key").alias("left_id"), F.col("right_key").alias("right_id"), "decision", "score")
    approved = rows.where("decision = 'review' and left(pair_id, 1) in ('0', '1', '2', '3')").select(F.conv(F.left("pair_id", F.lit(12)), 16, 10).cast("bigint").alias("entry_id"), F.lit("merge").alias("action"), "left_id", "right_id", F.lit(None).cast("bigint").alias("reverses_entry_id"))
    return ledger.review_queue(rows, approved).select("pair_id", "left_id", "right_id", "score")


@query("with " + _FEAT + ", l as (select left(sha256(left_key||'|'||right_key), 16) as pair_id, label, decision, hard_signal from dec) select pair_id, label as old, decision as new, 'changed' as change from l where label <> decision")
def label_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = resolve.resolve(_labelled(spark, d)).select(F.substring(F.sha2(F.concat_ws("|", "left_key", "right_key"), 256), 1, 16).alias("pair_id"), "label", "decision")
    return evaluate.label_diff(rows.select("pair_id", "label"), rows.select("pair_id", F.col("decision").alias("label")))


@query()
def text_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with accents: whole texts as names. Decomposition has no SQL form; tests cover it."""
    prepare(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(F.col("source"), F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("legal_name"), F.upper("lang").alias("country"))
    return prepare_records(rows).select("record_key", "name_norm", "core", "acr", F.array_join("keys", "|").alias("keys"))
