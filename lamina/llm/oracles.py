"""SQL (of another engine) for the text queries whose results it can state."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP11 = """
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as u, sha256('7:' || coalesce(cast(doc_id as varchar), 'null')) as s from documents),
h as (select *, len(u) as n, cast('0x' || s[1:8] as bigint) as h1, cast('0x' || s[9:16] as bigint) as h2, cast('0x' || s[25:32] as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:n], '') as suf from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256 from p"""


def _field(c: str) -> str:
    text = f"cast({c} as varchar)"
    return f"case when {c} is null then '-' else octet_length(encode({text})) || ':' || {text} end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _crc32(text: str) -> str:
    """Bit by bit, least significant first; texts of single-byte characters."""
    byte = f"list_transform(string_split({text}, ''), lambda q: cast(ord(q) as bigint))"
    bits = "list_reduce(list_prepend(xor(c, b), [cast(k as bigint) for k in range(8)]), lambda x, k: xor(x >> 1, cast(3988292384 as bigint) * (x & 1)))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {byte}), lambda c, b: {bits}), cast(4294967295 as bigint))"


OP12 = f"""
with recursive d as (select *, translate(text, '{UPPER}', '{UPPER.lower()}') as low from documents),
leaf as materialized (select doc_id, lang, {_leaf('text')} as leaf, case when {_crc32('cast(doc_id as varchar)')} % 3 = 0 then {_leaf('low')} else {_leaf('text')} end as fold,
  row_number() over (partition by lang order by doc_id nulls first) - 1 as idx, count(*) over (partition by lang) as n from d),
node(lvl, lang, idx, n, h) as (
  select 0, lang, idx, n, leaf from leaf
  union all
  select lvl + 1, lang, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' order by idx)) from node where n > 1 group by lvl, lang, idx // 8, n),
sub as materialized (select lang, h as subroot, lvl as height, row_number() over (order by lang nulls first) - 1 as g, count(*) over () as m from node where n = 1),
top(lvl, idx, n, h) as (
  select 0, g, m, subroot from sub
  union all
  select lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' order by idx)) from top where n > 1 group by lvl, idx // 8, n),
root as (select h as root from top where n = 1),
row_ as materialized (select l.*, s.subroot, s.height, s.g, row_number() over () as r from leaf l join sub s on l.lang is not distinct from s.lang),
side as (
  select r, lvl, t.idx as pos, t.h, t.idx < a.own as is_left from (select r, lang, k as lvl, idx // cast(8 ** k as bigint) as own from row_, range(20) q(k) where k < height) a
    join node t using (lvl) where t.lang is not distinct from a.lang and t.idx // 8 = a.own // 8 and t.idx <> a.own
  union all
  select r, height + lvl, t.idx, t.h, t.idx < a.own from (select r, height, k as lvl, g // cast(8 ** k as bigint) as own from row_, range(20) q(k) where k < (select max(lvl) from top)) a
    join top t using (lvl) where t.idx // 8 = a.own // 8 and t.idx <> a.own),
step as materialized (select r, lvl, coalesce(string_agg(h, '' order by pos) filter (where is_left), '') as lh, coalesce(string_agg(h, '' order by pos) filter (where not is_left), '') as rh from side group by all),
proof as (select r, sha256(string_agg(lh || rh, '' order by lvl)) as proof_sha256 from step group by r),
path as materialized (select r, height + (select max(lvl) from top) as len from row_),
fold(r, lvl, h) as (
  select r, 0, fold from row_
  union all
  select f.r, f.lvl + 1, sha256(coalesce(s.lh, '') || f.h || coalesce(s.rh, '')) from fold f join path p using (r) left join step s on s.r = f.r and s.lvl = f.lvl where f.lvl < p.len),
done as (select r, h as folded_root from fold join path using (r) where lvl = len)
select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from row_ join done using (r) left join proof using (r), root"""

OP13 = f"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as materialized (select distinct r, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[k:k + 3], ' ') end as g
  from (select r, w, unnest(generate_series(1, greatest(1, len(w) - 3))) as k from d where len(w) > 0)),
n as materialized (select r, count(*) as n from s group by r),
i as (select a.r as p, b.r as q, count(*) as c from s a join s b on a.g = b.g and a.r < b.r group by all),
l as materialized (select p, q from i join n x on x.r = p join n y on y.r = q where 100 * c >= 85 * (x.n + y.n - c)),
e as materialized (select p, q from l union all select q, p from l),
cc(r, lab) using key (r) as (
  select r, r from n
  union
  select e.q, min(cc.lab) from cc join e on e.p = cc.r join recurring.cc o on o.r = e.q where cc.lab < o.lab group by e.q),
least_ as (select lab, min(doc_id) as component_id from cc join d using (r) group by lab)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id
from d left join n using (r) left join cc using (r) left join least_ using (lab)"""

ORACLE: dict[str, str] = {"op11_fill_in_middle": OP11, "op12_merkle": OP12, "op13_prefix_tree": OP13}
