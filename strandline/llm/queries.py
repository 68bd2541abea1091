"""The registered query of each operator, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm.byte_bpe import round_trip
from strandline.llm.chat import format_conversations
from strandline.llm.common import table
from strandline.llm.exact_dedup import exact_dedup
from strandline.llm.near_dedup import near_duplicates
from strandline.llm.ngram import score_documents
from strandline.llm.packing import pack_documents
from strandline.llm.quality_model import classify
from strandline.llm.quality_rules import judged
from strandline.llm.substring_dedup import removal_digest
from strandline.llm.warc import archive_round_trip


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_bpe, op4_substring_dedup, op5_chat_formatting, op6_minhash_near_dedup, op7_quality_classifier, op8_warc, op9_quality_rules, op10_lm_scoring)
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as sha from documents),
        g as (select sha, min(doc_id) as keep_id, count(*) as group_size from t group by sha)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, t.sha as text_sha256 from t join g using (sha)
    """,
    "op9_quality_rules": r"""
        with t as (select doc_id, coalesce(text, '') as text from documents),
        w as (select doc_id, text,
                     list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
        tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
                from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
        again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from tri) where n > 1),
        rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id),
        m as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
                     (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
                     len(l)::bigint as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_capitals
              from w left join rep on w.doc_id = rep.doc_id),
        f as (select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (100 * n_dup_lines > 30 * n_lines)::bigint
                     + 8 * (10 * n_symbols > n_words)::bigint + 16 * (word_chars < 2 * n_words)::bigint + 32 * (word_chars > 20 * n_words)::bigint
                     + 64 * (100 * n_capitals > 60 * word_chars)::bigint as fail_bits from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits % 4 <> 0 as base_failed, fail_bits = 0 as kept,
               fail_bits, n_lines, n_capitals from f
    """,
    "op4_substring_dedup": r"""
        with t as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from t)),
        src as (select g, min(doc_id) as s from win group by g),
        gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from win join src using (g) where s < doc_id)),
        word as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as x from t),
        kept as (select doc_id, string_agg(x, ' ' order by p) as k, count(*) as n from word anti join gone using (doc_id, p) group by doc_id)
        select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256 from t left join kept using (doc_id)
    """,
    "op8_warc": r"""
        with t as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages),
        d as (select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
              1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::bigint >> (15 - 5 * (k % 4)))::bigint & 31), 1)), '') as payload_digest from t),
        f as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from d)
        select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id <> first then first end as refers_to from f
    """,
}
