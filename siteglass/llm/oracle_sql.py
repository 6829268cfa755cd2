"""SQL for the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from . import licenses, quality
from .integrity_sql import OP11_SQL, OP13_SQL

# Words and languages are the query's parameters.
_VOCABULARY = ", ".join(f"'{word}'" for word in quality.QualityRules().vocabulary)
_LANGUAGES = ", ".join(f"'{language}'" for language in quality.COMMON_WORDS)
OP1_SQL = r"""
with w as materialized (
  select doc_id, lang, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents),
counted as materialized (
  select doc_id, lang, words, length(text) as chars, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as upper_case, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) as letters,
    length(regexp_replace(text, '[^0-9]+', '', 'g')) as digits, length(regexp_replace(text, '[^.,;:!?''"()\-]+', '', 'g')) as punctuation,
    list_filter(list_transform(words, lambda w: lower(w)), lambda w: list_contains([{vocabulary}], w)) as hits,
    row_number() over () as r
  from w),
windows as (
  select r, unnest(list_transform(range(1, len(words) - 1), lambda i: struct_pack(i := i, win := words[i:i + 2]))) as x from counted),
twice as (select r, x.i as i from windows qualify count(*) over (partition by r, x.win) > 1),
repeated as (select r, count(distinct i + j)::bigint as n from twice, range(0, 3) t(j) group by r),
f as materialized (
  select c.*, len(lines) - len(list_distinct(lines)) as dup_lines, coalesce(n, 0) as n_repeat_words,
    [chars - word_chars, upper_case, letters - upper_case, digits, punctuation, n_symbols,
     chars - (chars - word_chars) - letters - digits - punctuation - n_symbols] as class_counts,
    list_transform([{vocabulary}], lambda v: len(list_filter(hits, lambda h: h = v))) || [n_words - len(hits)] as word_counts
  from counted c left join repeated using (r)),
bins as materialized (
  select r, lang, n_words, 'class' as kind, unnest(range(1, 8)) as i, unnest(class_counts) as x, chars as total from f
  union all
  select r, lang, n_words, 'word', unnest(range(1, len(word_counts) + 1)), unnest(word_counts), n_words from f),
languages as (select lang from f where lang in ({languages}) group by lang having sum(n_words) >= 1000),
reference as (
  select lang, kind, i, sum(x) / greatest(sum(sum(x)) over (partition by lang, kind), 1) as q
  from bins where lang in (select lang from languages) group by lang, kind, i),
terms as (
  select r, kind, b.lang, x / total as p, q, (x / total + q) / 2 as m from bins a join reference b using (kind, i) where total > 0),
distances as (
  select r, kind, lang, round(sqrt(least(greatest(sum(
    case when p > 0 then p * log2(p / m) else 0 end / 2 + case when q > 0 then q * log2(q / m) else 0 end / 2), 0), 1)), 6) as distance
  from terms group by r, kind, lang),
nearest as (
  select r, min(distance) filter (kind = 'class') as class_distance, min(distance) filter (kind = 'word') as word_distance
  from distances group by r)
select doc_id, n_words, word_chars, n_symbols, dup_lines::bigint as n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
    and not (n_words >= 50 and chars >= 200 and (coalesce(class_distance > 0.27, false) or coalesce(word_distance > 0.4, false))) as kept,
  class_distance, word_distance
from f left join nearest using (r)
""".replace("{vocabulary}", _VOCABULARY).replace("{languages}", _LANGUAGES)

# Distinct sets, pairs of them that share a shingle, and what is reachable by links.
OP2_SQL = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
s as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end as shingles
  from d),
classes as materialized (
  select min(doc_id) as rep, shingles, len(shingles) as n from s where len(shingles) > 0 group by shingles),
e as materialized (select rep, n, unnest(shingles) as shingle from classes),
links as materialized (
  select a.rep as u, b.rep as v from e a join e b on a.shingle = b.shingle and a.rep < b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways as (select u, v from links union all select v, u from links),
reach as (
  with recursive r as (select rep as node, rep as seen from classes union select r.node, b.v from r join both_ways b on b.u = r.seen)
  select node, min(seen) as component_id from r group by node)
select s.doc_id, len(s.shingles)::bigint as n_shingles, coalesce(r.component_id, s.doc_id) as component_id
from s left join classes c on c.shingles = s.shingles and len(s.shingles) > 0 left join reach r on r.node = c.rep
"""

# Sums over all documents in hash order, where the operator refines histograms.
OP3_SQL = r"""
with sized as (
  select doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint as size,
    substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 12) as hash
  from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, 1 + (row_number() over (order by source is null, encode(source)) - 1) % 3 as weight from totals),
-- A level at which every source not yet full gets level * weight; the sum of all shares is that of all sizes.
levels as (
  select a.source_size * 3 / a.weight as level, sum(least(3.0 * b.source_size, a.source_size * 3 / a.weight * b.weight)) as shared
  from weighed a, weighed b group by a.source, a.source_size, a.weight),
needed as (select coalesce(sum(source_size), 0) as words from weighed),
last_full as (select coalesce(max(level), 0) as level from levels, needed where shared <= words),
open_level as (
  select (words - coalesce((select sum(3 * source_size) from weighed, last_full where source_size * 3 / weight <= level), 0))
    / (select sum(weight) from weighed, last_full where source_size * 3 / weight > level) as level
  from needed),
targets as (
  select source, source_size, least(3.0::double * source_size, coalesce(level * weight, 3.0 * source_size)::double)::double as target
  from weighed, open_level),
plan as (
  select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end as copies from targets),
-- Words by place, summed in the order of the hash; rows of one place are taken together.
places as (select source, hash, sum(size) as words from sized group by source, hash),
summed as (select *, sum(words) over (partition by source order by hash) as upto from places),
ends as (
  select p.source, min_by(struct_pack(hash := hash, words := words, rest := target - copies * source_size - (upto - words)), hash) as e
  from plan p join summed s on p.source is not distinct from s.source
  where copies < 3 and upto > target - copies * source_size group by p.source)
select d.doc_id, d.size, p.source_size, p.target,
  (d.size * (p.copies + case when d.hash < e.hash or (d.hash = e.hash and abs(e.words - e.rest) < abs(e.rest)) then 1 else 0 end))::bigint as taken
from sized d join plan p on d.source is not distinct from p.source left join ends x on d.source is not distinct from x.source
"""

# Notices are the query's parameter; grams are compared as words, not by hash.
_NOTICES = ", ".join(
    "({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(licenses.TEMPLATES)
)
OP5_SQL = r"""
with d as materialized (
  select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from documents),
phrases as (
  select *,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' and w[i + 1] = 'license') as mit,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' and w[i + 1] = 'license') as apache,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license') as gpl
  from d),
base as (
  select r, doc_id, len(w)::bigint as n_words, (len(mit) + len(apache) + len(gpl))::bigint as n_base,
    list_min(mit || apache || gpl)::bigint - 1 as first_word, list_max(mit || apache || gpl)::bigint - 1 as last_word,
    list_filter([case when len(apache) > 0 then 'apache' end, case when len(gpl) > 0 then 'gpl' end, case when len(mit) > 0 then 'mit' end],
      lambda x: x is not null) as base
  from phrases),
notices(template, label, notice) as (values {notices}),
t as (
  select template, label, list_filter(regexp_split_to_array(lower(notice), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from notices),
template_grams as (
  select template, label, len(w) - 3 as n_grams,
    unnest(list_transform(range(1, len(w) - 2), lambda i: struct_pack(place := i - 1, gram := array_to_string(w[i:i + 3], ' ')))) as g
  from t),
grams as (
  select r, unnest(list_transform(range(1, len(w) - 2), lambda i: struct_pack(at := i - 1, gram := array_to_string(w[i:i + 3], ' ')))) as g
  from d),
votes as (
  select r, template, label, n_grams, a.g.at - b.g.place as diagonal, list(distinct b.g.place) as places, min(a.g.at) as first, max(a.g.at) as last
  from grams a join template_grams b on a.g.gram = b.g.gram group by all),
apart as (
  select *, coalesce(diagonal - lag(diagonal) over (partition by r, template order by diagonal) > 3, false)::int as new from votes),
merged as (select *, sum(new) over (partition by r, template order by diagonal) as span from apart),
spans as (
  select r, label, n_grams, len(list_distinct(flatten(list(places)))) / n_grams as coverage, max(last) + 4 - min(first) as stretch
  from merged group by r, template, label, n_grams, span),
found as (
  select r, list(distinct label) as labels, max(round(coverage, 6)) as best from spans
  where coverage >= 0.6 and stretch <= 2.0 * (n_grams + 3) group by r)
select doc_id, n_words, n_base, first_word, last_word, array_to_string(base, ',') as base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') as labels,
  greatest(coalesce(best, 0.0), case when n_base > 0 then 0.5 else 0.0 end)::double as score
from base left join found using (r)
""".replace("{notices}", _NOTICES)

ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op2_jaccard_join": OP2_SQL,
    "op3_source_mix": OP3_SQL,
    "op5_license_scan": OP5_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_conversation_trie": OP13_SQL,
}
