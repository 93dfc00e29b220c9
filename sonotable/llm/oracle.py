"""DuckDB SQL for the queries that SQL can express."""

_A_TO_Z = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op10_exact_dedup": f"""
with t as (select doc_id, sha256({_A_TO_Z}) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id as kept, t.text_sha256
from t join g on t.text_sha256 = g.text_sha256
""",
}


def _spans(name: str, pattern: str, group: int, keep: str) -> str:
    """CTEs ``name``(rid, kind, s, e): spans of a pattern, offsets from running sums of the lengths before and in each match."""
    p = pattern.replace("'", "''")
    return f"""
{name}_m as (select rid, unnest(regexp_extract_all(text, '(?s:(.*?))({p})', 1)) as g, unnest(regexp_extract_all(text, '(?s:(.*?))({p})', 2)) as w,
  unnest(regexp_extract_all(text, '(?s:(.*?))({p})', {group})) as v, generate_subscripts(regexp_extract_all(text, '(?s:(.*?))({p})', 1), 1) as k from d),
{name}_p as (select rid, w, v, sum(length(g) + length(w)) over (partition by rid order by k) as e from {name}_m),
{name} as (select rid, '{name}' as kind, cast(e - length(w) as bigint) as s, cast(e as bigint) as e from {name}_p where {keep})"""


def secrets_sql(scope: int = 200) -> str:
    from sonotable.llm import secrets as S

    ids = "^(?:AKIA|ASIA|AIDA|AGPA)[A-Z0-9]+$"
    ctes = [
        "d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents)",
        _spans("assign", S.ASSIGN, 3, f"length(v) >= {S.ASSIGN_VALUE}"),
        _spans("access", S.ACCESS, 2, "true"),
        _spans("hex", S.HEX, 2, "true"),
        _spans("linked_id", S.KEY_ID, 2, "true"),
        _spans("linked_key", S.KEY_RUN, 3, f"regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') and not regexp_matches(v, '{ids}')"),
        _spans("linked_endpoint", S.ENDPOINT, 2, "true"),
        f"""linked as (
select k.* from linked_key k where exists (select 1 from (select * from linked_id union all select * from linked_endpoint) o where o.rid = k.rid and abs(o.s - k.s) <= {scope})
union all select o.* from (select * from linked_id union all select * from linked_endpoint) o where exists (select 1 from linked_key k where o.rid = k.rid and abs(o.s - k.s) <= {scope}))""",
        "base as (select * from assign union all select * from access union all select * from hex)",
        "every as (select * from base union all select * from linked)",
        "ranked as (select *, list_position(['" + "', '".join(S.KINDS) + "'], kind) as r, kind || ':' || s || ':' || e as t from every)",
        """g as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(t, ',' order by s, r) filter (r <= 3) as b, string_agg(t, ',' order by s, r) as a from ranked group by rid)""",
    ]
    return "with " + ",\n".join(ctes) + """
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans
from d left join g on d.rid = g.rid"""


ORACLE["op1_secret_scans"] = secrets_sql()


#: CRC-32 in SQL: its table by rule, then one step per byte.
_CRC_TABLE = """crc as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) as t)"""


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``, an expression; ``crc.t`` must be in scope."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: cast('0x' || x as bigint))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)])), 4294967295)"


ORACLE["op11_histogram_sharding"] = f"""
with {_CRC_TABLE},
d as (select doc_id, coalesce(text, '') as text, cast('0x' || substr(md5(coalesce(text, '')), 1, 15) as bigint) as k from documents),
s as (select *, strlen(text) + 8 as size from d),
g as (select k, doc_id, sum(size) as held from s group by k, doc_id),
b as (select k, doc_id, sum(held) over (order by k, doc_id nulls first) - held as before, sum(held) over () as total from g),
p as (select s.doc_id, s.size, s.text, s.k, cast((24 * b.before) // b.total as integer) as shard
      from s join b on s.k = b.k and s.doc_id is not distinct from b.doc_id)
select doc_id, size, {_crc32("text")} as text_crc32, 'bytes' as law, shard,
  row_number() over (partition by shard order by k, doc_id nulls first) - 1 as slot, cast(null as integer) as grown_shard
from p, crc
"""


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, base: str) -> str:
    """CTE ``name``(grp, lvl, idx, digest, n): all levels of the trees of ``base`` (grp, lvl, idx, digest, n)."""
    return f"""{name} as ({base} union all
  select grp, lvl + 1, idx // 2, sha256(string_agg(digest, '' order by idx)), (n + 1) // 2 from {name} where n > 1 group by grp, lvl, idx // 2, n)"""


def _way(nodes: str) -> str:
    """Siblings of every node of level 0 of ``nodes``, from below: side and digest, or -."""
    return f"""select b.grp, b.idx, list(coalesce(case when (b.idx >> v.lvl) & 1 = 1 then 'L' else 'R' end || s.digest, '-') order by v.lvl) as way
  from {nodes} b join (select distinct grp, lvl from {nodes} where n > 1) v on b.grp is not distinct from v.grp
  left join {nodes} s on s.grp is not distinct from b.grp and s.lvl = v.lvl and s.idx = xor(b.idx >> v.lvl, 1) where b.lvl = 0 group by b.grp, b.idx"""


ORACLE["op12_merkle_manifest"] = f"""
with recursive {_CRC_TABLE},
d as (select doc_id, lang, {_leaf("n_chars")} as leaf, {_leaf("(n_chars::hugeint + 1)")} as altered, {_crc32("cast(doc_id as varchar)")} % 7 = 0 as hit from documents, crc),
r as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n from d),
{_tree("nodes", "select lang as grp, 0 as lvl, idx, leaf as digest, n from r")},
sub as (select grp as lang, digest as subroot, row_number() over (order by grp nulls first) - 1 as idx, count(*) over () as n from nodes where n = 1),
{_tree("top", "select 0 as grp, 0 as lvl, idx, subroot as digest, n from sub")},
w as ({_way("nodes")}),
t as ({_way("top")}),
p as (select r.doc_id, r.leaf, sub.subroot, case when r.hit then r.altered else r.leaf end as claimed, list_concat(coalesce(w.way, []), coalesce(t.way, [])) as way
  from r join sub on r.lang is not distinct from sub.lang left join w on w.grp is not distinct from r.lang and w.idx = r.idx left join t on t.idx = sub.idx),
f as (select *, list_reduce(list_concat([claimed], way), lambda a, s: case when s = '-' then sha256(a) when s[1] = 'L' then sha256(s[2:] || a) else sha256(a || s[2:]) end) as folded_root from p)
select f.doc_id, leaf, subroot, top.digest as root, sha256(array_to_string(list_transform(list_filter(way, lambda s: s <> '-'), lambda s: s[2:]), '')) as proof_sha256,
  folded_root, folded_root = top.digest as verified
from f, top where top.n = 1
"""

ORACLE["op13_phrase_collocations"] = f"""
with d as (select row_number() over () as rid, coalesce(lang, 'und') as lang, {_A_TO_Z} as text from documents),
p as (select rid, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece, generate_subscripts(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]'), 1) as pid from d),
w as (select lang, rid, pid, unnest(regexp_extract_all(piece, '[^\\x20\\x09]+')) as w, generate_subscripts(regexp_extract_all(piece, '[^\\x20\\x09]+'), 1) as nr from p),
g as (select lang, w as w1, lead(w, 1) over s as w2, lead(w, 2) over s as w3 from w window s as (partition by lang, rid, pid order by nr)),
n as (select lang, count(*) as n from w group by lang),
f1 as (select lang, w1, count(*)::hugeint as f from g group by lang, w1),
f2 as (select lang, w1, w2, count(*)::hugeint as f from g where w2 is not null group by lang, w1, w2),
f3 as (select lang, w1, w2, w3, count(*)::hugeint as f from g where w3 is not null group by lang, w1, w2, w3 having count(*) >= 10),
c2 as (select b.lang, b.w1 || ' ' || b.w2 as phrase, b.f as a, x.f as l, y.f as r from f2 b join f1 x on x.lang = b.lang and x.w1 = b.w1 join f1 y on y.lang = b.lang and y.w1 = b.w2
  where b.f >= 10 and not exists (select 1 from f3 t where t.lang = b.lang and 100 * t.f >= 50 * b.f and ((t.w1 = b.w1 and t.w2 = b.w2) or (t.w2 = b.w1 and t.w3 = b.w2)))),
c3 as (select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 as phrase, t.f as a, x.f as l1, yz.f as r1, xy.f as l2, z.f as r2 from f3 t
  join f1 x on x.lang = t.lang and x.w1 = t.w1 join f1 z on z.lang = t.lang and z.w1 = t.w3
  join f2 xy on xy.lang = t.lang and xy.w1 = t.w1 and xy.w2 = t.w2 join f2 yz on yz.lang = t.lang and yz.w1 = t.w2 and yz.w2 = t.w3),
s as (select lang, phrase, a, l, r, (1000000 * a * a) // (l * r) as score from c2
  union all select lang, phrase, a, case when k1 <= k2 then l1 else l2 end, case when k1 <= k2 then r1 else r2 end, least(k1, k2)
  from (select *, (1000000 * a * a) // (l1 * r1) as k1, (1000000 * a * a) // (l2 * r2) as k2 from c3)),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from s)
select o.lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from o join n on n.lang = o.lang where rank <= 2000
"""


#: Words of a text, an expression: runs without the six ASCII white-space characters.
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

# Windows that two documents have, and their doublings; rows that share a doc_id are one document.
ORACLE["op2_substring_dedup"] = f"""
with recursive d as (select row_number() over () as rid, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
x as (select rid, doc_id, unnest(range(1, len(w) - 11)) as pos, w from d where doc_id is not null and len(w) >= 13),
s as (select rid, doc_id, pos, array_to_string(w[pos:pos + 12], ' ') as run from x),
m as (select run, min(doc_id) as least from s group by run having min(doc_id) < max(doc_id)),
hit as (select rid, list(pos) as starts from s join m using (run) where doc_id > least group by rid),
gone as (select rid, unnest(list_distinct(flatten(list_transform(starts, lambda a: range(a, a + 13))))) as pos from hit),
one as (select rid, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
kept as (select rid, string_agg(word, ' ' order by pos) as kept, count(*) as n from one anti join gone using (rid, pos) group by rid),
same as (select rid, len(w) as n, min(doc_id) over (partition by w) < doc_id as copied from d where doc_id is not null and len(w) >= 13),
levels as (
  select 13 as length, rid, doc_id, pos, md5(run) as run, doc_id > least as later from s join m using (run) where rid not in (select rid from same where copied)
  union all
  select length, rid, doc_id, pos, run, doc_id > least from (
    select 2 * a.length as length, a.rid, a.doc_id, a.pos, md5(a.run || b.run) as run, min(a.doc_id) over (partition by md5(a.run || b.run)) as least, max(a.doc_id) over (partition by md5(a.run || b.run)) as most
    from levels a join levels b on a.rid = b.rid and b.pos = a.pos + a.length) where least < most),
longest as (select rid, max(length) filter (later) as longest from levels group by rid)
select doc_id, len(w)::bigint as n_words, case when hit.rid is null then 0 else len(w) - coalesce(n, 0) end as n_removed,
  sha256(case when hit.rid is null then array_to_string(w, ' ') else coalesce(kept, '') end) as kept_sha256,
  coalesce((select any_value(same.n) from same where same.rid = d.rid and copied), longest, 0)::bigint as longest
from d left join kept using (rid) left join hit using (rid) left join longest using (rid)
"""

# Every 100-byte string of every text, as hex digits; the first by (doc_id, start) stays.
ORACLE["op3_suffix_array_dedup"] = f"""
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents),
x as (select rid, doc_id, h, unnest(range(0, n - 99)) as pos from d where n >= 100),
s as (select rid, doc_id, pos, md5_number(substr(h, 2 * pos + 1, 200)) as k from x),
later as (select rid, pos from (select rid, pos, row_number() over (partition by k order by doc_id, pos) as r from s) where r > 1),
e as (select rid, pos, pos - 100 > coalesce(lag(pos) over (partition by rid order by pos), -1000) as opens from later),
r as (select rid, pos, sum(opens::int) over (partition by rid order by pos) as run from e),
runs as (select rid, run, min(pos) as a, max(pos) + 100 as z from r group by rid, run),
k as (select rid, a, z, coalesce(lag(z) over (partition by rid order by a), 0) as p from runs),
g as (select d.rid, sum(z - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) || substr(any_value(h), 2 * max(z) + 1) as kept from k join d on d.rid = k.rid group by d.rid)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join g on d.rid = g.rid
"""

# Sets that are equal are one class; classes are paired by their prefixes in rarest-first order and verified whole.
ORACLE["op4_ngram_jaccard_join"] = f"""
with recursive d as (select row_number() over () as rid, doc_id, {_WORDS.format(_A_TO_Z)} as w from documents),
sets as (select rid, doc_id, case when len(w) >= 5 then list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from d),
classes as (select s, min(doc_id) as c, len(s) as n from sets where len(s) > 0 and doc_id is not null group by s),
one as (select c, n, unnest(s) as x from classes),
df as (select x, count(*) as df from one group by x),
ranked as (select c, n, x, row_number() over (partition by c order by df, x) as r from one join df using (x)),
prefix as (select * from ranked where r <= n - (75 * n + 99) // 100 + 1),
pairs as (select distinct a.c as a, b.c as b from prefix a join prefix b on a.x = b.x and a.c < b.c and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
links as (select a, b from pairs p
  join classes p1 on p1.c = a join classes p2 on p2.c = b
  where 100 * len(list_intersect(p1.s, p2.s)) >= 75 * (p1.n + p2.n - len(list_intersect(p1.s, p2.s)))),
sides as (select a, b from links union all select b, a from links),
reach as (select a, a as b from sides union select r.a, l.b from reach r join sides l on r.b = l.a),
root as (select a, min(b) as root from reach group by a)
select doc_id, len(sets.s)::bigint as n_shingles, coalesce(root, c, doc_id) as component_id
from sets left join classes on sets.s = classes.s left join root on root.a = classes.c
"""
