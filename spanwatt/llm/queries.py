"""A query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontamination, jaccard_join, kd_sharding, language_id, line_dedup, nearest, quality_rules, spelling, substring_dedup, suffix_dedup, token_files

#: Folder of the vocabulary files; a parameter of the deployment.
TOKENIZERS = os.environ.get("TOKENIZER_DIR") or os.path.dirname(public_tokenizers.path("x"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    made = bpe.encode(_docs(spark, sf_dir).select("doc_id", "text"), path, pattern, decoded="decoded")
    return bpe.digest(made).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumns({"n_chars": F.length("text"), "n_lines": F.length("text") - F.length(F.translate("text", "\n", "")), "n_spaces": F.length("text") - F.length(F.translate("text", " ", ""))})
    placed = kd_sharding.kd_shards(docs, 8, ("n_chars", "n_lines", "n_spaces"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup.dedup(_docs(spark, sf_dir))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality_rules.judged(_docs(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontamination.mark(_docs(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_join(F.sort_array(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return marked.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.dedup(_docs(spark, sf_dir))
    return made.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.dedup(_docs(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_lines_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(spark, _docs(spark, sf_dir).select("doc_id", "text"), os.path.join(TOKENIZERS, "word_bpe_49k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_docs(spark, sf_dir))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_docs(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(_docs(spark, sf_dir))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_byte_bpe, op3_kd_sharding, op4_substring_dedup, op5_quality_rules, op6_decontamination, op7_suffix_dedup, op8_line_dedup, op9_token_files, op10_jaccard_join, op11_phrase_mining, op12_spelling_variants, op13_nearest_neighbours)
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')"

SQL: dict[str, str] = {}

SQL["op5_quality_rules"] = rf"""
with d as (
    select doc_id, coalesce(text, '') as text, {_WORDS} as w, string_split(coalesce(text, ''), chr(10)) as l from documents
), win as (
    select doc_id, i, list_aggregate(w[i : i + 7], 'string_agg', ' ') as v from d, unnest(range(1, greatest(len(w) - 6, 1))) as u(i)
), twice as (
    select doc_id, v from win group by 1, 2 having count(*) > 1
), covered as (
    select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from win join twice using (doc_id, v)) group by 1
), lines as (
    select doc_id, x, length(regexp_replace(x, '[ \t-\r]', '', 'g')) as size  from (select doc_id, unnest(l) as x from d)
), judged as (
    select *, size > 0 and (
        length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > size * 0.4::double
        or (len(regexp_extract_all(x, '[^ \t-\r]+')) >= 4 and not regexp_matches(x, '\pL'))
        or len(regexp_extract_all(x, '[|»›•·]| > | :: ')) >= 3
        or regexp_matches(lower(x), 'javascript|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|lorem ipsum|click here|sign up for our')
    ) as fails from lines
), lost as (
    select doc_id, coalesce(sum(size) filter (fails), 0) as lost, count(*) filter (size > 0) - count(distinct x) filter (size > 0) as dup from judged group by 1
), base as (
    select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[ \t-\r]', '', 'g'))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, dup::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, lost
    from d join lost using (doc_id) left join covered using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and lost <= word_chars * 0.5::double as kept
from base
"""

SQL["op6_decontamination"] = r"""
with d as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), b as (
    select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), pat as (
    select distinct item_id, least(len(w), 13) as n, w[i : i + least(len(w), 13) - 1] as v from b, unnest(range(1, greatest(len(w) - 11, 2))) as u(i) where len(w) > 0
), win as (
    select doc_id, i, n, w[i : i + n - 1] as v from d, (select distinct n from pat), unnest(range(1, greatest(len(w) - n + 2, 1))) as u(i)
), hit as (
    select doc_id, i, n, item_id from win join pat using (n, v)
), words as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)) group by 1
), found as (
    select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from hit group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (doc_id) left join found using (doc_id)
"""

SQL["op4_substring_dedup"] = rf"""
with d as (
    select doc_id, {_WORDS} as w from documents
), win as (
    select doc_id, i, md5(list_aggregate(w[i : i + 49], 'string_agg', ' ')) as v from d, unnest(range(1, greatest(len(w) - 48, 1))) as u(i)
), first as (
    select v, min(doc_id) as f from win group by 1
), gone as (
    select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from win join first using (v) where f < doc_id)
), left_ as (
    select doc_id, string_agg(x, ' ' order by p) as kept from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d) anti join gone using (doc_id, p) group by 1
), n as (
    select doc_id, count(*) as n from gone group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join n using (doc_id) left join left_ using (doc_id)
"""

SQL["op7_suffix_dedup"] = r"""
with d as (
    select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
), win as (
    select doc_id, p, md5(substr(h, 2 * p + 1, 200)) as v from d, unnest(range(0, greatest(n - 99, 0))) as u(p)
), later as (
    select doc_id, p from (select *, row_number() over (partition by v order by doc_id, p) as k from win) where k > 1
), gone as (
    select distinct doc_id, b from (select doc_id, unnest(range(p, p + 100)) as b from later)
), kept as (
    select doc_id, string_agg(substr(h, 2 * b + 1, 2), '' order by b) as k from (select doc_id, h, unnest(range(0, n)) as b from d) anti join gone using (doc_id, b) group by 1
), counts as (
    select doc_id, count(*) as n_removed, count(*) filter (b - 1 <> coalesce(prev, -9)) as n_spans from (select *, lag(b) over (partition by doc_id order by b) as prev from gone) group by 1
)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256
from d left join counts using (doc_id) left join kept using (doc_id)
"""

SQL["op11_phrase_mining"] = r"""
with d as (
    select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), p as (
    select row_number() over () as id, lang, piece from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\n-\r]')) as piece from d)
), w as (
    select id, lang, unnest(regexp_split_to_array(piece, '[ \t]+')) as w, generate_subscripts(regexp_split_to_array(piece, '[ \t]+'), 1) as i from p
), next as materialized (
    select lang, w as w1, lead(w, 1) over o as w2, lead(w, 2) over o as w3, lead(w, 3) over o as w4, lead(w, 4) over o as w5 from w where w <> '' window o as (partition by id order by i)
), grams as (
    select lang, 1 as m, w1 as phrase from next union all select lang, 2, w1 || ' ' || w2 from next where w2 is not null union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from next where w3 is not null
    union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from next where w4 is not null union all select lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 from next where w5 is not null
), f as materialized (
    select lang, m, phrase, count(*) as f from grams group by all
), total as materialized (
    select lang, sum(f) as n from f where m = 1 group by 1
), cand as materialized (
    select * from f where m > 1 and f >= 100
), cut as materialized (
    select c.lang, c.m, c.phrase, c.f as a, k, array_to_string(string_split(c.phrase, ' ')[1 : k], ' ') as head, array_to_string(string_split(c.phrase, ' ')[k + 1 :], ' ') as rest
    from cand c, unnest(range(1, c.m)) as u(k)
), scored as materialized (
    select cut.*, h.f as l, r.f as r, n::bigint as n, ((1000::hugeint * a * n::hugeint) // (h.f::hugeint * r.f))::bigint as score
    from cut join f h on h.lang = cut.lang and h.phrase = head join f r on r.lang = cut.lang and r.phrase = rest join total on total.lang = cut.lang
), low as materialized (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), held as materialized (
    select distinct lang, array_to_string(string_split(phrase, ' ')[i : i + k - 1], ' ') as phrase, f as longer from cand, unnest(range(2, m)) as a(k), unnest(range(1, m - k + 2)) as b(i)
), alone as (
    select * from low where not exists (select 1 from held where held.lang = low.lang and held.phrase = low.phrase and 100 * longer >= 100 * a)
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from alone
)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""

SQL["op12_spelling_variants"] = r"""
with recursive bits(v, c, k) as (
    select v, v, 0 from range(256) as r(v)
    union all
    select v, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k + 1 from bits where k < 8
), crc as materialized (
    select list(c order by v) as t from bits where k = 8
), runs as materialized (
    select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as w from documents
), counted as materialized (
    select id, w, count(*) as n from runs where length(w) >= 5 group by all
), bytes as (
    select id, w, n, flatten(list_transform(string_split(id || ':' || w, ''), lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [195, ord(x)::bigint - 64] end)) as b from counted
), hashed as (
    select id, w, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) as h from bytes, crc
), spelt as (
    select case when h % 97 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from hashed
), v as materialized (
    select word, sum(n)::bigint as n from spelt where length(word) >= 5 group by 1 having sum(n) >= 3
), less as materialized (
    select word, n, i, left(word, i - 1) || substr(word, i + 1) as d from (select word, n, unnest(range(1, length(word) + 1)) as i from v)
), near as materialized (
    select a.word, b.word as near, b.n from less a join less b on a.i = b.i and a.d = b.d and a.word <> b.word and length(a.word) = length(b.word)
    union select a.word, v.word, v.n from less a join v on a.d = v.word
    union select v.word, a.word, a.n from less a join v on a.d = v.word
), best as materialized (
    select v.word, v.n, count(near.near) as n_near, arg_min(near.near, (-near.n, near.near)) as best, max(near.n) as best_n from v left join near on near.word = v.word group by all
), forms as materialized (
    select word, n, n_near, case when best_n >= 2 * n then best end as form, case when best_n >= 2 * n then best_n end as form_n from best
), chain(word, root, k) as (
    select word, word, 0 from forms union all select chain.word, forms.form, k + 1 from chain join forms on forms.word = chain.root where forms.form is not null
), ends as (
    select word, arg_max(root, k) as root from chain group by 1
)
select word, form, root, n::bigint as n, n_near::bigint as n_near, form_n::bigint as form_n from forms join ends using (word)
"""
