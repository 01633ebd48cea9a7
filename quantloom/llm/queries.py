"""The corpus queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .common import BLANK_CLASS, ascii_lower, blank_words, let, table
from .decontaminate import report_contamination
from .html import extract_main_text
from .languages import identify_languages
from .lines import dedup_lines
from .manifest import prove
from .mixing import mix_sources
from .packing import pack
from .periodic import find_runs
from .personal import KINDS, find_personal
from .quality import judge_quality
from .simhash import hex_mark, near_duplicates
from .tokens import count_tokens
from .urls import judge_urls, rule_frame

#: The rules of the URL query, (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "__mix.size", "__mix.source_size", "__mix.target", "__mix.taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_frame(spark, URL_RULES))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.array(*map(F.lit, KINDS))
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    counts = [of(k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines_left"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), F.array_join("__gone", ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", hex_mark(F.col("mark")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _crc_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def plant_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic end in every tenth document, as the query's definition has it."""
    h = _crc_of_id()

    def periodic(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = blank_words(F.col("text"))
    planted = (h % 10 == 0) & F.col("text").rlike(f"[^{BLANK_CLASS}]")
    return docs.select("doc_id", F.when(planted, let(words, periodic)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(plant_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)  # noqa: E731  runs are sorted, so ties keep the first
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), longer)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prove(table(spark, sf_dir, "documents"), _crc_of_id() % 5 == 0, {"text": ascii_lower(F.col("text"))})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_mix_sources": op2_mix_sources,
    "op3_language_id": op3_language_id,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op6_url_filter": op6_url_filter,
    "op7_personal_data": op7_personal_data,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_pack_sequences": op11_pack_sequences,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op2_mix_sources": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, md5('0:' || coalesce(doc_id::varchar, '')) k from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source asc nulls last) place from d group by source),
w as (select *, [5, 2, 1][((place - 1) % 3 + 1)::int]::bigint weight, 2 * source_size cap, 1.5::double * (sum(source_size) over ())::double budget from s),
r as (select *, budget - (sum(cap) over o - cap)::double remaining, (sum(weight) over () - (sum(weight) over o - weight))::bigint share from w
      window o as (order by cap::double / weight, place rows between unbounded preceding and current row)),
f as (select *, cap * share <= remaining * weight is_full from r),
t as (select source, source_size, budget, case when is_full then cap::double
      else (budget - coalesce(sum(case when is_full then cap end) over (), 0)::double) * weight / (sum(case when not is_full then weight end) over ())::double end target from f),
q as (select d.*, t.source_size, t.target, t.budget, sum(d.size) over (partition by d.source order by k, doc_id nulls first, d.size) upto
      from d join t on d.source is not distinct from t.source),
c as (select *, (e * source_size + upto)::double / target finish from q cross join (values (0), (1)) v(e) where target > 0),
m as (select *, sum(size) over (order by finish, k, doc_id nulls first, size, e) served from c),
x as (select source, e, max((k, coalesce(doc_id, -9223372036854775808), size)) last from m where served <= budget group by source, e)
select q.doc_id, q.size, q.source_size::bigint source_size, q.target,
       (q.size * (select count(*) from x where x.source is not distinct from q.source and (q.k, coalesce(q.doc_id, -9223372036854775808), q.size) <= x.last))::bigint taken
from q""",
    "op4_decontaminate": r"""
with d as (select row_number() over () row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
i as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
p as (select item_id, w, least(len(w), 10) m, unnest(generate_series(1, greatest(len(w) - 9, 1))) pos from i where len(w) > 0),
iw as (select distinct item_id, m, array_to_string(w[pos:pos + m - 1], ' ') win from p),
dp as (select row, w, m, unnest(generate_series(1, len(w) - m + 1)) pos from d cross join (select distinct m from iw)),
dw as (select row, m, pos, array_to_string(w[pos:pos + m - 1], ' ') win from dp),
h as (select distinct row, dw.m, pos, item_id from dw join iw on dw.win = iw.win and dw.m = iw.m),
c as (select row, count(distinct place) n_hit from (select row, unnest(generate_series(pos, pos + m - 1)) place from h) group by row),
n as (select row, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct row, item_id from h) group by row)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c using (row) left join n using (row)""",
    "op6_url_filter": r"""
with u as (select page_id,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
f as (select *, ('.' || host) like '%.example.org' eo, ('.' || host) like '%.org' o, ('.' || host) like '%.com' c from u),
r as (select *, case when eo and path like '/en/1%' then 'example.org/en/1' when eo and path like '/es/%' then 'example.org/es/'
  when o and path like '/%' then 'org/' when c and path like '/fr/%' then 'com/fr/' when c and path like '/de/%' then 'com/de/' end rule from f)
select page_id, host, path, rule, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' else 'allow' end verdict from r""",
    "op12_periodic_runs": r"""
with d as (select row_number() over () id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, coalesce(xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295), 1) h from documents),
g as (select *, len(w) n, h // 10 g, case when len(w) > 0 then (h // 10) % len(w) end a from d),
q as (select id, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end w from g),
p as (select id, n, unnest(w) word, unnest(range(n)) i from q),
m as (select x.id, x.i - y.i lag, x.i from p x join p y on x.id = y.id and x.word = y.word and y.i < x.i and 3 * (x.i - y.i) <= x.n),
k as (select id, lag, min(i) - lag start, count(*) + lag length from (select *, i - row_number() over (partition by id, lag order by i) part from m) group by id, lag, part having count(*) + lag >= greatest(24, 3 * lag)),
r as (select * from k where not exists (select 1 from k s where s.id = k.id and s.lag < k.lag and s.start <= k.start and s.start + s.length >= k.start + k.length)),
x as (select distinct r.id, i from r join p on p.id = r.id and p.i >= start + lag and p.i < start + length),
t as (select p.id, string_agg(word, ' ' order by p.i) left_over from p anti join x on p.id = x.id and p.i = x.i group by p.id),
b as (select id, count(*) n_runs, string_agg(start || ',' || length || ',' || lag || chr(10), '' order by start, lag) lines, first({'start': start, 'length': length, 'lag': lag} order by length::double / lag desc, start, lag) best from r group by id)
select doc_id, coalesce(n_runs, 0)::bigint n_runs, best.start::bigint start, best.length::bigint length, best.lag::bigint as period, (1000 * best.length // best.lag)::bigint exponent_milli, sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(left_over, '')) collapsed_sha256
from q left join b using (id) left join t using (id)""",
    "op13_merkle_manifest": r"""
with recursive
d as (select *, coalesce(xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 5 = 0, false) tampered,
  case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end || case when source is null then '-' else strlen(source) || ':' || source end || case when lang is null then '-' else strlen(lang) || ':' || lang end
  || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end head,
  case when text is null then '-' else strlen(text) || ':' || text end own, case when text is null then '-' else strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end lowered from documents),
l as (select doc_id, source, sha256(head || own) leaf, case when tampered then sha256(head || lowered) else sha256(head || own) end changed from d),
p as (select *, row_number() over () id, dense_rank() over (order by source nulls first) - 1 tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by source) n from l),
lv as (select tree, 0 level, pos, n, leaf hash from p union all select tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' order by pos)) from lv where n > 1 group by tree, level, pos // 16, n),
s as (select tree, hash, count(*) over () n from lv where n = 1),
tv as (select 0 level, tree pos, n, hash from s union all select level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' order by pos)) from tv where n > 1 group by level, pos // 16, n),
r as (select tree, level, pos // 16 run, list(hash order by pos) hs from lv where n > 1 group by all), tr as (select level, pos // 16 run, list(hash order by pos) hs from tv where n > 1 group by all),
c as (select id, tree, 0 level, pos, n, '' sib, changed folded from p
  union all select id, c.tree, c.level + 1, pos // 16, (n + 15) // 16, sib || array_to_string(hs[:pos % 16], '') || array_to_string(hs[pos % 16 + 2:], ''), sha256(array_to_string(hs[:pos % 16], '') || folded || array_to_string(hs[pos % 16 + 2:], ''))
  from c join r on c.tree = r.tree and c.level = r.level and c.pos // 16 = r.run where n > 1),
t as (select id, 0 level, c.tree pos, s.n, sib, folded from c join s on c.tree = s.tree where c.n = 1
  union all select id, t.level + 1, pos // 16, (n + 15) // 16, sib || array_to_string(hs[:pos % 16], '') || array_to_string(hs[pos % 16 + 2:], ''), sha256(array_to_string(hs[:pos % 16], '') || folded || array_to_string(hs[pos % 16 + 2:], ''))
  from t join tr on t.level = tr.level and t.pos // 16 = tr.run where n > 1)
select doc_id, leaf, s.hash subroot, root.hash root, sha256(sib) proof_sha256, folded folded_root, folded = root.hash verified
from p join s using (tree) join t on p.id = t.id and t.n = 1 cross join (select hash from tv where n = 1) root""",
}
