"""The registered queries ``opN_<name>`` and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, lm_score, near_dedup, packing, pii, quality_model, quality_rules, token_files, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -7L as conv_id, t.turn, t.role, '{said}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_FITS = "((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
_ORDERED = sorted(url_filter.RULES, key=lambda r: -len(r[0]))


def _case(k: int, default: str) -> str:
    tests = (f"when {_FITS.format(h=r[0].split('/')[0], p='/' + r[0].split('/', 1)[1])} then '{r[k]}'" for r in _ORDERED)
    return f"case {' '.join(tests)} else {default} end"


def _low(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": rf"""
            with d as (
                select row_number() over () as rid, doc_id, coalesce(regexp_extract_all({_low("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
            ), b as (
                select cast(item_id as varchar) as item, regexp_extract_all({_low("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null
            ), windows as (
                select distinct item, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as gram
                from b, unnest(range(1, greatest(1, len(w) - 12) + 1)) as t(i) where len(w) > 0
            ), grams as (
                select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as gram
                from d, (select distinct n from windows) as s, unnest(range(1, len(w) - n + 2)) as t(i) where len(w) >= n
            ), hits as (
                select distinct rid, i, n, item from grams join windows using (n, gram)
            ), words as (
                select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hits) group by rid
            ), names as (
                select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by rid
            )
            select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
                sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
            from d left join words using (rid) left join names using (rid)
        """,
        "op5_near_dedup": rf"""
            with recursive d as (
                select doc_id, coalesce(regexp_extract_all({_low("text")}, '[^\x20\x09-\x0D]+'), []) as w from documents
            ), s as (
                select distinct doc_id, array_to_string(w[i : i + 1], ' ') as gram from d, unnest(range(1, greatest(1, len(w) - 1) + 1)) as t(i) where len(w) > 0
            ), n as (
                select doc_id, count(*) as n from s group by doc_id
            ), shared as (
                select a.doc_id as a, b.doc_id as b, count(*) as c from s as a join s as b using (gram) where a.doc_id <> b.doc_id group by 1, 2
            ), links as (
                select a, b from shared join n as x on x.doc_id = a join n as y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
            ), reach as (
                select doc_id as a, doc_id as b from d union select r.a, l.b from reach as r join links as l on r.b = l.a
            ), least as (
                select a as doc_id, min(b) as component_id from reach group by a
            )
            select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from d join least using (doc_id) left join n using (doc_id)
        """,
        "op6_chat_format": r"""
            with t as (
                select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
            ), m as (
                select *, length(role) + length(text) + 20
                    + len(regexp_extract_all(role, '[<\[]\\*/?(?:s>|INST\]|IMAGE:|AUDIO:|DOCUMENT:)'))
                    + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|IMAGE:|AUDIO:|DOCUMENT:)')) as chars
                from t
            ), whole as (
                select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
                    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss, sum(chars) as chars
                from m group by conv_id
            )
            select conv_id, n_turns, sha256(said) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars
            from whole
        """,
        "op4_url_filter": f"""
            with cut as (
                select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
            ), named as (
                select page_id,
                    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
                from cut
            )
            select page_id, host, path, {_case(0, "null")} as rule, {_case(1, "'allow'")} as verdict from named
        """,
    }
