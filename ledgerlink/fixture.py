"""Two registers derived from the ``part`` table: the same recipe in Spark and, as SQL text, in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SQL = """
select 'L'||lpad(cast(p_partkey as varchar(12)),8,'0') as lei,
 p_name||' '||translate(lpad(cast(p_partkey % 1500 as varchar(9)),5,'0'),'0123456789','kabelinoru')||case when p_partkey%13=0 then ' Fund I' else '' end||case p_partkey%4 when 0 then ' Limited' when 1 then ' AG' when 2 then ' L.P.' else ' Incorporated' end as legal_name,
 case p_size%4 when 0 then 'GB' when 1 then 'DE' when 2 then 'US' else null end as country,
 case when p_partkey%5=4 then 'RA000602' else 'RA000585' end as registered_at,
 case when p_partkey%6=5 then null when p_partkey%2=0 then lpad(cast(p_partkey as varchar(12)),8,'0') else cast(p_partkey as varchar(12)) end as registered_as,
 'P'||lpad(cast(p_partkey%300 as varchar(9)),4,'0') as postal_code, p_partkey from {part}"""
NUMBERED_SQL = """
select case when p_partkey%11=0 then '5'||lpad(cast(p_partkey as varchar(12)),7,'0') else lpad(cast(p_partkey as varchar(12)),8,'0') end as company_number,
 upper(p_name||' '||translate(lpad(cast(p_partkey % 1500 as varchar(9)),5,'0'),'0123456789','kabelinoru')||case when p_partkey%13=0 then ' Fund II' else '' end||case p_partkey%4 when 0 then ' LTD.' when 1 then ' Aktiengesellschaft' when 2 then ' Limited Partnership' else ' Inc' end) as company_name,
 case p_size%4 when 0 then 'GB' when 1 then 'DE' when 2 then 'FR' else null end as country_of_origin,
 'P'||lpad(cast(p_partkey%300 as varchar(9)),4,'0') as post_code,
 case when p_partkey%7=0 then p_name||' Old' end as previous_name_1, p_partkey from {part} where p_partkey%3<>0"""


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(REGISTRY_SQL, part=part), spark.sql(NUMBERED_SQL, part=part)


def positives(registry: DataFrame, numbered: DataFrame) -> DataFrame:
    """(left_key, right_key, p_partkey): both records of a part, the smaller key left."""
    a = registry.select("p_partkey", F.concat(F.lit("gleif:"), "lei").alias("k1"))
    b = numbered.select("p_partkey", F.concat(F.lit("companies_house:"), "company_number").alias("k2"))
    return a.join(b, "p_partkey").select(F.least("k1", "k2").alias("left_key"), F.greatest("k1", "k2").alias("right_key"), "p_partkey")
