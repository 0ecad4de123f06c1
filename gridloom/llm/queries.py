"""The registered queries of this subpackage: thin forms with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import divergence, language, mixing, neardup, ngram, pieces, quality, quotes, repeats, resampling, topk, toxicity, urls
from gridloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int):
    """crc32(doc_id as text) mod parts; 2 is the held-out part, a null doc_id is in none (-1): not held out, so it teaches."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.measure(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.train_profiles(docs.filter(fold(4) != 2))
    return language.identify(docs, profiles).withColumn("held_out", fold(4) == 2).select("doc_id", "held_out", "lang_pred", "score")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram.train(docs.filter(fold(7) != 2), order=2)
    found = ngram.score(docs, model).withColumn("held_out", fold(7) == 2)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_totals(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold(4) != 2)
    found = toxicity.score(table(spark, sf_dir, "documents"), labels)
    return found.withColumn("held_out", fold(4) == 2).select("doc_id", "held_out", "score", "predicted", "n_hits")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


RULES = [urls.Rule("allow", "org"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


# What SQL can tell of operators whose whole result it can't: the same rows, fewer columns.

def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def kneser_ney_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8_kneser_ney(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk_search, op2_minhash_neardup, op3_sentencepiece, op4_quality_rules, op5_quotation_linking, op6_suffix_dedup, op7_language_id, op8_kneser_ney, op9_mixing, op10_toxicity, op11_resampling, op12_divergence, op13_url_filters, quality_base, kneser_ney_base, mixing_targets)
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 byte by byte, from a table of 256 steps made bit by bit.
OP11_SQL = rf"""with recursive bits(i, k, v) as (select i, 0, i from range(256) t(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
steps as (select list(v order by i) as step from bits where k = 8),
d as (select doc_id, row_number() over () as row, unnest(regexp_extract_all({_LOW.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents),
b as (select unnest(regexp_extract_all({_LOW.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
h as (select w, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::bigint, 2))::bigint)), lambda c, x: xor(c >> 8, step[(xor(c & 255, x) + 1)::bigint]))) % 10000 as bucket from (select w from d union select w from b), steps),
s as (select bucket, count(*) as s from d join h using (w) group by 1), t as (select bucket, count(*) as t from b join h using (w) group by 1),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from d) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select count(*) from b) + 10000)::double)))::bigint as gain from s full join t using (bucket)),
f as (select row, count(*) as n, sum(gain)::bigint as total from d join h using (w) join g using (bucket) group by 1),
e as (select doc_id, coalesce(n, 0)::bigint as n_features, case when n is null then 0 else (total - ((total % n) + n) % n) // n end::bigint as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as u from (select doc_id, row_number() over () as row from documents) left join f using (row)),
z as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((u + 0.5::double) / 4294967296::double)))::bigint as score from e),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from z where n_features >= 20 qualify rank <= (select count(*) from z where n_features >= 20) * 10 // 100)
select doc_id, n_features as n_words, n_features, weight, score, rank from z left join r using (doc_id)"""

OP12_SQL = rf"""with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
w as (select row, lang, source, unnest(words) as term from d), c as (select lang, source, term, count(*) as n from w group by all),
kept as (select lang, term from w group by all having count(distinct row) >= 10),
groups as (select distinct lang, source from d), langs as (select distinct lang from d),
v as (select lang, count(kept.term) as v from langs left join kept using (lang) group by 1),
counts as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from groups g join kept k using (lang) left join c using (lang, source, term)),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v) as p from counts join v using (lang)),
lang_counts as (select lang, term, sum(n) as n from counts group by all),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * v) as q from lang_counts join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce(x.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
left join (select p.lang, p.source, o.source as item, sum((p.p - o.p) * (p.p - o.p) // (p.p + o.p)) as value from p join p o on p.lang = o.lang and p.term = o.term and p.source <> o.source group by all) x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q),
a as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms)
select lang, source, part, item, value::bigint as value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from a qualify part = 'pair' or rank <= 10"""

#: Rules and links of absolute, host-relative and scheme-relative form, without dot segments, comments or scripts; aliases by the closure of links.
OP13_SQL = r"""with recursive u as (select page_id, url, html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages),
h as (select page_id, url, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path, regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) as query from u),
rules(verdict, rule_host, rule_path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
links as (select url, host, regexp_extract(url, '^([^:/?#]*)://', 1) as scheme, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\srel\s*=\s*["'']?canonical["'']?[^>]*>'), '(?is)\shref\s*=\s*["'']([^"'']*)', 1) as link from h where contains(lower(html), 'canonical')),
whole as (select url, case when contains(link, '://') then link when starts_with(link, '//') then scheme || ':' || link else scheme || '://' || host || link end as link from links where link <> ''),
n as (select url, regexp_extract(x.link, '://([^/?#]*[^#]*)', 1) as b, regexp_extract(url, '://([^/?#]*[^#]*)', 1) as a from whole x),
both_ as (select a, b from n union select b, a from n),
reach(a, b) as (select a, b from both_ union select r.a, e.b from reach r join both_ e on r.b = e.a),
judged as (select h.*, r.verdict as own, case when r.verdict is not null then rule_host || rule_path end as rule from h left join rules r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) qualify row_number() over (partition by page_id, url order by length(rule_host || rule_path) desc) = 1),
named as (select *, host || case when path = '' then '/' else path end || coalesce(query, '') as node from judged),
touched as (select m.page_id, m.url, bool_or(o.own = 'block') and not coalesce(bool_or(o.own = 'allow'), false) as hit from named m join reach on reach.a = m.node join named o on o.node = reach.b where m.own is null group by all)
select page_id, host, path, rule, case when own is not null then own when coalesce(hit, false) then 'block' else 'allow' end as verdict, own is null and coalesce(hit, false) as inherited from named left join touched using (page_id, url)"""

QUALITY_SQL = r"""with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents), w as (select row, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
lines as (select row, sum(n - 1) as dup from (select row, line, count(*) as n from (select row, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1, 2) group by 1),
win as (select row, i, array_to_string(list_slice(ws, i, i + 7), ' ') as s from w, unnest(range(1, len(ws) - 6)) u(i)),
rep as (select row, count(distinct p) as n from (select row, unnest(range(i, i + 8)) as p from win qualify count(*) over (partition by row, s) > 1) group by 1),
m as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(dup, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words from w left join lines using (row) left join rep using (row))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m"""

#: The CRC-32 of the ids by the steps of OP11_SQL.
KNESER_NEY_SQL = rf"""with recursive bits(i, k, v) as (select i, 0, i from range(256) t(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
steps as (select list(v order by i) as step from bits where k = 8),
d as (select row_number() over () as row, doc_id, coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(doc_id::varchar)), lambda i: ('0x' || substr(hex(encode(doc_id::varchar)), (2 * i + 1)::bigint, 2))::bigint)), lambda c, x: xor(c >> 8, step[(xor(c & 255, x) + 1)::bigint]))) % 7 = 2, false) as held_out, {_LOW.format("coalesce(text, '')")} as t from documents, steps),
k as (select row, held_out, unnest(list_append(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), ' end ')) as w from d),
c as (select w, count(*) as c from k where not held_out group by 1), n as (select sum(c)::bigint as n, count(*) as v from c),
s as (select row, count(*) as n_tokens, count(c.c) as n_known, sum(log10((coalesce(c.c, 0) + 1)::double / (n.n + n.v + 1))) as base from k left join c using (w), n group by 1)
select doc_id, held_out, n_tokens, n_known, n.n as train_tokens, round(base, 6) as base_score from d join s using (row), n"""

MIXING_SQL = r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::bigint as source_size, [3.0, 1.0, 2.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight from d group by 1),
o as (select *, 2.0 * source_size as cap, sum(source_size) over () * 1.5 as budget, row_number() over (order by 2.0 * source_size / weight, source) as i from s),
l as (select *, (budget - coalesce(sum(cap) over (order by i rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by i rows between current row and unbounded following) as level from o),
f as (select min(i) as i from l where level * weight <= cap), t as (select source, source_size, case when f.i is null or l.i < f.i then cap else (select level from l m where m.i = f.i) * weight end as target from l, f)
select doc_id, size::bigint as size, source_size, round(target, 6) as target from d join t on d.source is not distinct from t.source"""

ORACLE_SQL: dict[str, str] = {"op11_resampling": OP11_SQL, "op12_divergence": OP12_SQL, "op13_url_filters": OP13_SQL, "quality_base": QUALITY_SQL, "kneser_ney_base": KNESER_NEY_SQL, "mixing_targets": MIXING_SQL}
