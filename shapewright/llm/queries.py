"""The registered queries of this subpackage, with SQL where SQL can tell."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hilbert, jpeg_media, licenses, line_dedup, mixture, ngram_rules, periodic_runs, piece_codec, pivot_links, quality_net, simhash, suffix_dedup, whitening
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "paragraph_ids", "licenses")])


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_net.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixed(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed_lines", "text")


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.text_media(table(spark, sf_dir, "documents"))


def op10_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ngram_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")


def op11_pivot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_links.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.with_digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_piece_codec, op3_quality_net, op4_hilbert_shards, op5_simhash, op6_source_mixture, op7_suffix_dedup, op8_line_dedup, op9_jpeg_media, op10_ngram_rules, op11_pivot_links, op12_periodic_runs, op13_whitening)}

ORACLES = {
    "op6_source_mixture": """
with d as (
  select doc_id, coalesce(source, '') as source, doc_id % 512 as block,
    len(list_filter(string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> '')) as n_tokens
  from documents),
s as (select source, sum(n_tokens)::bigint as tokens from d group by source),
a as (select max(tokens) as most, min(tokens) as least, sum(tokens) as total from s where tokens > 0),
x as (select most, total, case when most::double / least <= 2 then 0 else round(1 - ln(2.0) / ln(most::double / least), 12) end as x from a),
z as (select x.*, (select sum(pow(tokens::double / x.total, x.x)) from s where tokens > 0) as norm from x),
b as (select source, tokens, round(pow(tokens::double / total, x) / norm, 9) as weight,
    floor(round(tokens * pow(most::double / tokens, 1 - x), 3))::bigint as budget from s, z),
k as (select d.source, block, sum(n_tokens)::bigint as in_block, any_value(weight) as weight, any_value(budget // tokens) as whole, any_value(budget % tokens) as rest
  from d join b using (source) group by d.source, block),
p as (select *, row_number() over (partition by source order by md5(concat_ws('|', source, whole, block)), block) as place, rest - (sum(in_block) over (partition by source order by md5(concat_ws('|', source, whole, block)), block) - in_block) as left_over from k),
t as (select d.*, p.weight, p.place, p.whole, p.in_block, p.left_over, p.rest,
    sum(n_tokens) over (partition by d.source, d.block order by doc_id rows unbounded preceding) as run from d join p on d.source = p.source and d.block = p.block)
select doc_id, source, n_tokens, block::int as block, weight, place::int as place,
  (whole + case when left_over >= in_block and rest > 0 then 1 when left_over > 0 and left_over < in_block and run <= left_over then 1 else 0 end)::int as epochs
from t
""",
    "op8_line_dedup": """
with l as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
w as (select doc_id, unnest(range(0, len(lines) - 2)) as place, lines from l where len(lines) >= 3),
k as (select doc_id, place, lines[place + 1] || chr(10) || lines[place + 2] || chr(10) || lines[place + 3] as window_text from w),
r as (select doc_id, place, row_number() over (partition by window_text order by doc_id, place) as nth from k),
c as (select distinct doc_id, unnest([place, place + 1, place + 2]) as place from r where nth > 1),
g as (select doc_id, list(place) as gone from c group by doc_id)
select l.doc_id, len(lines)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed_lines,
  case when gone is null then text else array_to_string(list_transform(list_filter(range(0, len(lines)), lambda i: not list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)) end as text
from l left join g using (doc_id)
""",
}


#: The licence lines that the oracle knows, typed here: it is another's opinion of the scan.
_LINES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
}


def _license_sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in _LINES.items())
    cut = r"regexp_split_to_array(regexp_replace(regexp_replace(v, '\b([Vv])\.\s+', '\1 ', 'g'), '([.?!:;])\s+', '\1' || chr(1), 'g'), chr(1))"
    normal = "trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g'), ' ')"

    def found(units: str) -> str:
        return f"list_filter(list_transform(flatten(list_transform({units}, lambda v: {cut})), lambda u: {normal}), lambda s: names[s] is not null)"

    bare = r"regexp_replace(coalesce(text, ''), '(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+)?[ \t]*', '', 'g')"
    return rf"""
with m as (select map_from_entries(list((k, v))) as names from (values {known}) as t(k, v)),
f as (select doc_id, names, {found("string_split(coalesce(text, ''), chr(10))")} as a, {found(rf"regexp_split_to_array({bare}, '\n(?:[^\p{{L}}\p{{N}}\n]*\n)+')")} as b from documents, m)
select doc_id, array_to_string(list_transform(a, lambda s: replace(s, ' ', '-')), ',') as sentence_ids, array_to_string(list_transform(b, lambda s: replace(s, ' ', '-')), ',') as paragraph_ids,
  array_to_string(list_sort(list_distinct(list_transform(list_concat(a, b), lambda s: names[s] || '/' || replace(s, ' ', '-')))), ',') as licenses
from f
"""


ORACLES["op1_license_scan"] = _license_sql()
