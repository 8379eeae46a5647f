"""The queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> module and function of this subpackage
_WHERE = {
    "op1_mix": "mixing",
    "op2_ngram_join": "ngram_join",
    "op3_fingerprints": "fingerprints",
    "op4_shard": "sharding",
    "op5_quality": "quality",
    "op6_knn": "knn",
    "op7_packing": "packing",
    "op8_pii": "pii",
    "op9_urls": "urls",
    "op10_language": "language",
    "op11_licenses": "licenses",
    "op12_merkle": "merkle",
    "op13_runs": "runs",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f".{_WHERE[name]}", __package__), name)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in _WHERE}


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_NEAR = f"""with recursive w as (select doc_id, coalesce({_WORDS}, []) as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from w union select r.a, l.b from reach r join link l on l.a = r.b)
select w.doc_id, coalesce(n.n, 0) as n_shingles, (select min(b) from reach r where r.a = w.doc_id) as component_id from w left join n using (doc_id)"""
_TOP = """with v as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.row, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on q.row <> c.row where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by row order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
_HOST, _PATH = r"translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", r"regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
#: Links of plain absolute addresses; a resolver in the tests covers references, bases and ports as well.
_NODE = _HOST + r" || regexp_extract({0}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
_RULE = "case when ({h} = 'example.org' or {h} like '%.example.org') and starts_with({p}, '/en/1') then 'example.org/en/1' when ({h} = 'example.org' or {h} like '%.example.org') and starts_with({p}, '/es/') then 'example.org/es/' when ({h} = 'com' or {h} like '%.com') and starts_with({p}, '/fr/') then 'com/fr/' when ({h} = 'com' or {h} like '%.com') and starts_with({p}, '/de/') then 'com/de/' when ({h} = 'org' or {h} like '%.org') and starts_with({p}, '/') then 'org/' end"
_URLS = f"""with recursive p as (select page_id, url, html, coalesce({_HOST.format("url")}, '') as host, coalesce({_PATH.format("url")}, '') as path, {_NODE.format("url")} as node from pages),
t as (select url, node, unnest(list_concat(regexp_extract_all(html, '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), regexp_extract_all(html, '(?is)<meta[^>]*http-equiv="refresh"[^>]*content="[0-9]+;\\s*url=([^"]*)"', 1))) as target from p),
e as (select distinct node as a, {_NODE.format("target")} as b, url as a_url, target as b_url from t where target like '%://%'),
link as (select a, b from e union select b, a from e),
reach as (select a, a as b from link union select r.a, l.b from reach r join link l on l.a = r.b),
said as (select node, {_RULE.format(h=_HOST.format("url"), p=_PATH.format("url"))} as rule from (select a as node, a_url as url from e union select b, b_url from e)),
felt as (select r.a as node, bool_or(s.rule in ('org/', 'com/fr/')) as allowed, bool_or(s.rule in ('example.org/es/', 'example.org/en/1', 'com/de/')) as blocked from reach r join said s on s.node = r.b group by 1)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when blocked and not coalesce(allowed, false) then 'block' else 'allow' end as verdict
from (select *, {_RULE.format(h="host", p="path")} as rule from p) left join felt using (node)"""

#: DuckDB has no crc32: a byte at a time, its eight shifts.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0])))::bigint[], lambda a, e: case when xor(a, e) & 1 = 1 then xor(xor(a, e) >> 1, 3988292384) else xor(a, e) >> 1 end), 4294967295)"


def _tree(name: str, nodes: str, by: str) -> str:
    """All levels of the trees of `nodes` (by, idx, h, m), and every node's siblings in its run."""
    return f"""{name} as (select 0 as lvl, * from ({nodes})
 union all select lvl + 1, {by}, idx // 3, sha256(string_agg(h, '' order by idx)), (m + 2) // 3 from {name} where m > 1 group by lvl, {by}, idx // 3, m),
{name}_run as (select lvl, {by}, idx // 3 as run, list(h order by idx) as hs from {name} where m > 1 group by 1, 2, 3),
{name}_side as (select t.lvl, t.{by}, t.idx, array_to_string(hs[1:(t.idx % 3)::int], '') as l, array_to_string(hs[(t.idx % 3)::int + 2:], '') as r from {name} t join {name}_run n on n.lvl = t.lvl and n.{by} is not distinct from t.{by} and n.run = t.idx // 3 where t.m > 1)"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"


_MERKLE = f"""with recursive d as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as idx, count(*) over (partition by source) as m, {_leaf("text")} as h,
  case when {_CRC} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as other from documents),
{_tree("t", "select source, idx, h, m from d", "source")},
s as (select source, h, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as m, 0 as one from t where m = 1),
{_tree("u", "select one, idx, h, m from s", "one")},
step as (select d.doc_id, 0 as tier, lvl, l, r from d join t_side x on x.source is not distinct from d.source and x.idx = d.idx // (3 ** lvl)::bigint
 union all select d.doc_id, 1, lvl, l, r from d join s on s.source is not distinct from d.source join u_side x on x.idx = s.idx // (3 ** lvl)::bigint),
path as (select doc_id, list({{'l': l, 'r': r}} order by tier, lvl) as p from step group by 1),
f as (select d.doc_id, d.h as leaf, s.h as subroot, (select h from u where m = 1) as root, sha256(coalesce(array_to_string(list_transform(p, lambda x: x.l || x.r), ''), '')) as proof_sha256,
  list_reduce(list_prepend({{'l': d.other, 'r': ''}}, coalesce(p, [])), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l as folded_root
 from d join s on s.source is not distinct from d.source left join path using (doc_id))
select *, folded_root = root as verified from f"""
_RUNS = rf"""with c as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w, {_CRC} as h from documents),
g as (select doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as here, h // 10 % greatest(len(w), 1) as a, h // 10 % 8 as k from c),
d as materialized (select doc_id, n, case when here then list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + k)) end + 1]) else w end as w from g),
x as materialized (select doc_id, n, i, hash(w[i + 1:i + 16]) as x, w[i + 1:i + 16] as v from (select *, unnest(range(n - 15)) as i from d where n >= 24)),
e as (select a.doc_id, a.i, b.i - a.i as q from x a join x b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and 3 * (b.i - a.i) <= a.n where a.v = b.v),
l as (select doc_id, q, min(i) as start, count(*) + 15 + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as isle from e) group by doc_id, q, isle having count(*) + 15 + q >= greatest(24, 3 * q)),
r as (select doc_id, start, length, min(q) as period from l group by all),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
o as (select doc_id, unnest(range(n)) as i, unnest(w) as word from d),
k as (select doc_id, string_agg(word, ' ' order by i) as t from o anti join gone using (doc_id, i) group by 1),
b as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as t,
  arg_min({{'s': start, 'l': length, 'p': period}}, {{'e': -(length::double / period), 's': start, 'p': period}}) as top from r group by 1)
select doc_id, coalesce(n_runs, 0) as n_runs, top.s as start, top.l as length, top.p as period, 1000 * top.l // top.p as exponent_milli, sha256(coalesce(b.t, '')) as runs_sha256, sha256(coalesce(k.t, '')) as collapsed_sha256
from d left join b using (doc_id) left join k using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The other operators draw, learn, pack or map spans back, which SQL cannot express; tests hold them to brute force."""
    return {"op2_ngram_join": _NEAR, "op6_knn": _TOP, "op9_urls": _URLS, "op12_merkle": _MERKLE, "op13_runs": _RUNS}
