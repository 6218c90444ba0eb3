"""The registered queries of these operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pactframe.llm.common import table


#: Host, path prefix, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactframe.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), min_bytes=0).drop("url")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactframe.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, size=5).drop("set_key")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactframe.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactframe.llm.mil import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cutoff=0.7)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactframe.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pactframe.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactframe.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from pactframe.llm.secrets import scan

    found = scan(table(spark, sf_dir, "documents"), path_col="source")
    return found.withColumn("value_sha256", F.sha2("value", 256)).drop("value")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactframe.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), length=4096, end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as n, sha1(body) as hex, min(page_id) over (partition by body) as first_id from p),
b as (select *, [('0x' || substr(hex, 5 * i + 1, 5))::bigint for i in range(8)] as g from d)
select page_id, n::bigint as payload_bytes,
  array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31)::int + 1, 1) for s in [15, 10, 5, 0]] for x in g]), '') as payload_digest,
  case when page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from first_id then first_id end as refers_to
from b
"""

OP9_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 50 = 0),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op9_top_k": OP9_SQL}
