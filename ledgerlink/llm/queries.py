"""Thin queries over the operators, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlink.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlink.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlink.llm.secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlink.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlink.llm.ann import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


def op5_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlink.llm.sstable import token_tables

    return token_tables(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlink.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlink.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlink.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlink.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlink.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_bpe": op3_bpe,
    "op4_ann": op4_ann,
    "op5_token_tables": op5_token_tables,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
}

ORACLES: dict[str, str] = {
    "op6_minhash_dedup": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as sh from w),
        n as (select doc_id, len(sh)::bigint as n_shingles from s), e as (select doc_id, unnest(sh) as x from s),
        hits as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
        links as (select a, b from hits join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n_shingles + nb.n_shingles - c)),
        edges as (select a, b from links union all select b, a from links),
        reach as (select doc_id as a, doc_id as b from n union select reach.a, edges.b from reach join edges on reach.b = edges.a)
        select n.doc_id, any_value(n_shingles) as n_shingles, min(b) as component_id, n.doc_id = min(b) as kept from n join reach on reach.a = n.doc_id group by n.doc_id""",
    "op8_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as b from pages),
        d as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
        f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first from d)
        select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type,
            case when first <> page_id then first end as refers_to from f""",
}
