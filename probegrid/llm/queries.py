"""The registered queries of this subpackage, each over whole tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from probegrid.llm.archives import archive_pages
from probegrid.llm.collocations import mine_phrases, phrases_sql
from probegrid.llm.common import table
from probegrid.llm.decontamination import decontaminate
from probegrid.llm.exact_dedup import exact_duplicates
from probegrid.llm.html_blocks import extract_text
from probegrid.llm.licenses import license_scan, license_sql
from probegrid.llm.near_dedup import near_duplicates
from probegrid.llm.packing import pack
from probegrid.llm.pii import find_pii
from probegrid.llm.simhash import simhash_duplicates
from probegrid.llm.suffix_dedup import remove_repeats
from probegrid.llm.toxicity import classify
from probegrid.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return classify(documents, documents, table(spark, sf_dir, "labels"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Query]:
    named = [
        op1_html_blocks, op2_near_dedup, op3_licenses, op4_warc, op5_decontamination,
        op6_exact_dedup, op7_suffix_dedup, op8_packing, op9_pii, op10_toxicity,
        op11_simhash, op12_whitening, op13_collocations,
    ]
    return {q.__name__: q for q in named}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NIBBLE = "(strpos('0123456789abcdef', substr(h, {0}, 1)) - 1)"
_BASE32 = f"""array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((({_NIBBLE.format('5 * i // 4 + 1')} * 16 + {_NIBBLE.format('5 * i // 4 + 2')}) >> (3 - 5 * i % 4)) & 31), 1)), '')"""

LLM_ORACLE = {
    "op2_near_dedup": rf"""
        with recursive words as (select doc_id, row_number() over () as r, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
        sets as (select distinct doc_id, r, array_to_string(w[i:i + 4], ' ') as g from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)),
        sizes as (select r, count(*) as n from sets group by r),
        shared as (select a.r as x, b.r as y, any_value(a.doc_id) as a, any_value(b.doc_id) as b, count(*) as c from sets a join sets b on a.g = b.g and a.r <> b.r group by 1, 2),
        links as (select distinct a, b from shared join sizes m on m.r = x join sizes n on n.r = y where 100 * c >= 85 * (m.n + n.n - c)),
        reached as (select doc_id as a, doc_id as b from documents union select p.a, l.b from reached p join links l on l.a = p.b),
        groups as (select a as doc_id, min(b) as component_id from reached group by 1)
        select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from words left join sizes using (r) join groups using (doc_id)""",
    "op4_warc": f"""
        with payloads as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages)
        select page_id, strlen(t)::bigint as payload_bytes, {_BASE32} as payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type,
            case when first <> page_id then first end as refers_to from payloads""",
    "op5_decontamination": rf"""
        with words as (select doc_id, row_number() over () as r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        items as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        sized as (select item_id, w, least(10, len(w)) as k from items where len(w) > 0),
        windows as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as s from (select *, unnest(range(1, len(w) - k + 2)) as i from sized)),
        grams as (select r, k, i, array_to_string(w[i:i + k - 1], ' ') as s from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select distinct k from windows) where len(w) >= k)),
        hits as (select distinct r, i, k, item_id from grams join windows using (k, s)),
        covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from hits) group by r),
        named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from hits) group by r)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
            sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from words left join covered using (r) left join named using (r)""",
    "op13_collocations": phrases_sql(),
    "op3_licenses": license_sql(),
    "op6_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
            doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
}
