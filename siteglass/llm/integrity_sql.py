"""SQL for the rows of the Merkle manifest and of the conversation trie."""

from __future__ import annotations


def crc32(value: str) -> str:
    """Unsigned crc32 of a number's decimal text, byte by byte and bit by bit."""
    byte = "list_transform(string_split({v}::varchar, ''), lambda c: ascii(c)::ubigint)"
    bit = "case when b % 2 = 1 then xor(b >> 1, 3988292384::ubigint) else b >> 1 end"
    eight = f"list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: {bit})"
    return f"xor(list_reduce([4294967295::ubigint] || {byte.format(v=value)}, lambda s, x: {eight}), 4294967295::ubigint)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP11_SQL = rf"""
with recursive leaves as materialized (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf, claim) - 1 as pos, count(*) over (partition by lang) as n
  from (select doc_id, lang, {_leaf("n_chars")} as leaf,
    case when {crc32("doc_id")} % 7 = 0 then {_leaf("(n_chars + 1)")} else {_leaf("n_chars")} end as claim from documents)),
inner_nodes(lang, level, pos, n, node) as (
  select lang, 0, pos, n, leaf from leaves
  union all
  select lang, level + 1, pos // 2, (n + 1) // 2, sha256(node || coalesce(partner, ''))
  from (select *, lead(node) over (partition by lang order by pos) as partner from inner_nodes) where n > 1 and pos % 2 = 0),
subroots as materialized (
  select lang, node as subroot, row_number() over (order by lang is not null, encode(lang)) - 1 as pos, count(*) over () as n
  from inner_nodes where n = 1),
upper_nodes(level, pos, n, node) as (
  select 0, pos, n, subroot from subroots
  union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(node || coalesce(partner, ''))
  from (select *, lead(node) over (order by pos) as partner from upper_nodes) where n > 1 and pos % 2 = 0),
placed as materialized (
  select l.*, row_number() over () as r, s.subroot, s.pos as lang_pos
  from leaves l join subroots s on l.lang is not distinct from s.lang),
steps as (
  select r, 0 as tree, o.level, own % 2 as odd, node as sibling
  from (select r, lang, level, pos >> level as own from placed
    join (select distinct lang, level from inner_nodes where n > 1) v using (lang)
    union all
    select r, p.lang, level, pos >> level from placed p
    join (select distinct level from inner_nodes where n > 1 and lang is null) v on p.lang is null) o
  left join inner_nodes i on i.lang is not distinct from o.lang and i.level = o.level and i.pos = xor(own, 1)
  union all
  select r, 1, o.level, own % 2, node
  from (select r, level, lang_pos >> level as own from placed, (select distinct level from upper_nodes where n > 1)) o
  left join upper_nodes u on u.level = o.level and u.pos = xor(own, 1)),
paths as materialized (
  select r, string_agg(sibling, '' order by tree, level) as siblings,
    list(case when sibling is null then '-' when odd = 1 then 'L' || sibling else 'R' || sibling end order by tree, level) as path
  from steps group by r),
done as (
  select doc_id, leaf, subroot, (select node from upper_nodes where n = 1) as root, sha256(coalesce(siblings, '')) as proof_sha256,
    list_reduce([claim] || coalesce(path, []),
      lambda x, s: sha256(case s[1] when 'L' then s[2:] || x when 'R' then x || s[2:] else x end)) as folded_root
  from placed left join paths using (r))
select *, folded_root = root as verified from done
"""

OP13_SQL = f"""
with own as materialized (
  select conv_id as conv, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as pos, role, text
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
convs as materialized (
  select conv, {crc32("conv")}::bigint % 9 as h, conv - conv % 5 as base, max(pos) as n from own group by conv),
lengths as materialized (
  select c.*, least(h, coalesce(b.n, 0)) as taken from convs c left join (select conv as base, n from convs) b using (base)),
turns as materialized (
  select l.conv, o.pos, role, text from lengths l join own o on o.conv = l.base where o.pos <= h
  union all
  select l.conv, o.pos - h + taken, role, text from lengths l join own o on o.conv = l.conv where o.pos > h),
prefixes as materialized (
  select conv, pos as depth, strlen(text) as bytes,
    list({{'role': role, 'text': text}}) over (partition by conv order by pos) as prefix from turns
  union all select conv, 0, 0, [] from convs),
members as materialized (
  select conv, depth, bytes, min(conv) over (partition by depth, prefix) as node, max(depth) over (partition by conv) as length from prefixes),
nodes as materialized (
  select node, depth, count(*) as n_convs, any_value(bytes) as bytes,
    string_agg(case when depth = length then conv end, ',' order by conv) as ends
  from members group by node, depth),
parents as materialized (
  select n.node, n.depth, p.node as parent from nodes n left join members p on p.conv = n.node and p.depth = n.depth - 1),
children as (select parent as node, depth - 1 as depth, count(*) as n_children from parents where parent is not null group by all),
known as materialized (
  select n.*, parent, coalesce(n_children, 0) as n_children from nodes n join parents using (node, depth) left join children using (node, depth)),
below as (
  select m.node, m.depth, count(*) filter (n_children = 0) as n_leaves,
    sum(case when k.depth > 0 then (n_convs - 1) * k.bytes else 0 end)::bigint as saved_tokens
  from known k join members m on m.conv = k.node and m.depth <= k.depth group by all)
select node as conv_id, depth, parent as parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from known join below using (node, depth)
"""
