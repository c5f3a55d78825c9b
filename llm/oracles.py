"""SQL that must give the rows of the queries, where SQL can say it."""

from __future__ import annotations

from .imatch import COMMONEST, RAREST, RATES, REPEATS
from .secrets import _ENDPOINT, _IDENTIFIER, _SECRET, KINDS, STRONG
from .sharding import SLOTS, slot_table


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _kind_rows(rank: int) -> str:
    """Matches of one kind: the text before each and the match itself, in order."""
    _, pattern, group, _ = KINDS[rank]
    p = _text(pattern)
    return f"""
select doc_id, {rank} as rank, unnest(range(1, len(m) + 1)) as i, unnest(m) as m, unnest(c) as c,
       unnest(gaps[1:len(m)]) as gap
from (select doc_id, regexp_extract_all(t, {p}) as m, regexp_extract_all(t, {p}, {group}) as c,
             string_split_regex(t, {p}) as gaps from docs)
where len(m) > 0"""


def _rank_list(ranks) -> str:
    return "(" + ", ".join(map(str, ranks)) + ")"


_LEAST = " ".join(f"when {k} then {kind[3]}" for k, kind in enumerate(KINDS))
_NAME = " ".join(f"when {k} then '{kind[0]}'" for k, kind in enumerate(KINDS))
_CREDENTIAL = [kind[0] for kind in KINDS].index("credential")

OP2 = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(_kind_rows(k) for k in range(len(KINDS)))}),
placed as (
  select doc_id, rank, m, c,
         sum(length(gap)) over upto + coalesce(sum(length(m)) over before, 0) as start
  from found
  window upto as (partition by doc_id, rank order by i rows between unbounded preceding and current row),
         before as (partition by doc_id, rank order by i rows between unbounded preceding and 1 preceding)),
parts as (
  select doc_id, rank, start, start + length(m) as stop from placed
  where length(c) >= case rank {_LEAST} end
    and (rank <> {_CREDENTIAL} or (regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')))),
met as (
  select w.doc_id, w.rank, w.start, w.stop,
         max(case when p.rank in {_rank_list(_IDENTIFIER)} then 1 else 0 end) as identifier,
         max(case when p.rank in {_rank_list(_SECRET)} then 1 else 0 end) as secret
  from parts w join parts p
    on p.doc_id = w.doc_id and p.start <= w.stop + 200 and p.stop >= w.start - 200
  where w.rank >= {len(STRONG)} and p.rank <> {_ENDPOINT}
  group by all),
spans as (
  select doc_id, rank, start, stop from parts where rank < {len(STRONG)}
  union all
  select doc_id, rank, start, stop from met
  where case when rank = {_ENDPOINT} then identifier = 1 and secret = 1
             when rank in {_rank_list(_IDENTIFIER)} then secret = 1 else identifier = 1 end),
named as (select *, (case rank {_NAME} end) || ':' || start || ':' || stop as name from spans)
select d.doc_id,
       count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
       sha256(coalesce(string_agg(name, ',' order by start, rank) filter (rank < {len(STRONG)}), '')) as base_sha256,
       coalesce(string_agg(name, ',' order by start, rank), '') as spans
from docs d left join named n on n.doc_id = d.doc_id
group by d.doc_id
"""

OP3 = """
with vectors as (
  select vec_id, label, cast(embedding as double[]) as v,
         label is not null and embedding is not null and len(embedding) > 0
           and list_dot_product(cast(embedding as double[]), cast(embedding as double[])) > 0 as ok
  from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b
  from vectors a join vectors b on a.label = b.label and a.vec_id <> b.vec_id
  where a.ok and b.ok
    and list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reached as (
  with recursive r as (
    select vec_id, vec_id as other from vectors
    union
    select r.vec_id, l.b from r join links l on l.a = r.other)
  select vec_id, min(other) as component_id from r group by vec_id),
degree as (select a as vec_id, count(*) as n from links group by a)
select v.vec_id, coalesce(n, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept
from vectors v join reached using (vec_id) left join degree using (vec_id)
"""

OP7 = """
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as l from documents),
windows as (
  select doc_id, p, array_to_string(l[p:p + 19], ' ') as k
  from (select doc_id, l, unnest(range(1, len(l) - 18)) as p from words)),
late as (
  select doc_id, p, row_number() over (partition by k order by doc_id, p) > 1 as late from windows),
each as (select doc_id, unnest(l) as word, unnest(range(1, len(l) + 1)) as p from words),
marked as (
  select e.doc_id, e.word, e.p,
         max(case when late then 1 else 0 end)
           over (partition by e.doc_id order by e.p rows between 19 preceding and current row) = 1 as gone
  from each e left join late w on w.doc_id = e.doc_id and w.p = e.p)
select d.doc_id, count(word) as n_words, count(*) filter (gone) as n_removed,
       sha256(coalesce(string_agg(word, ' ' order by p) filter (not gone), '')) as kept_sha256
from documents d left join marked m on m.doc_id = d.doc_id
group by d.doc_id
"""

_SUBSETS = ", ".join(f"({1 + k}, {rate}, {n})" for k, (rate, n) in enumerate((r, n) for r in RATES for n in range(REPEATS)))
_PARTS = 1 + len(RATES) * REPEATS


def _likeness(other: str) -> str:
    rates = []
    for k in range(len(RATES)):
        inside = f"a.part between {1 + k * REPEATS} and {(k + 1) * REPEATS}"
        some = f"(a.digest <> '00000000' or {other}.digest <> '00000000')"
        rates.append(
            f"count(*) filter ({inside} and {some} and a.digest = {other}.digest)"
            f" / greatest(1, count(*) filter ({inside} and {some}))"
        )
    return f"greatest(max(case when a.part = 0 and a.digest = {other}.digest then 1.0::double else 0.0::double end), {', '.join(rates)})"


OP9 = f"""
with docs as (
  select doc_id, coalesce(text, '') as t,
         coalesce(lead(doc_id) over w, first_value(doc_id) over w) as next_id
  from documents window w as (order by doc_id desc rows between unbounded preceding and unbounded following)),
forms as (
  select d.doc_id, d.next_id, d.t,
         substring(d.t, 1, length(d.t) - length(d.t) // 3) || substring(n.t, 1, length(d.t) // 3) as edited
  from docs d join docs n on n.doc_id = d.next_id),
terms as (
  select doc_id, form, unnest(list_distinct(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'))) as term
  from (select doc_id, 0 as form, t from forms union all select doc_id, 1, edited from forms)),
band as (
  select term from terms where form = 0 and term <> '' group by term
  having count(*) between greatest(2, (select count(*) from docs) * {RAREST!r}) and greatest(2, (select count(*) from docs) * {COMMONEST!r})),
subsets(part, rate, n) as (values {_SUBSETS}),
members as (
  select term, 0 as part from band
  union all
  select term, part from band, subsets
  where substr(md5(rate || '.' || n || ':' || term), 1, 4) < printf('%04x', 65536 >> rate)),
digests as (
  select doc_id, form, part, substr(md5(string_agg(term, ' ' order by term)), 1, 8) as digest
  from terms join members using (term) group by all),
parts as (
  select f.doc_id, x.form, r.part,
         coalesce(digest, case when r.part > 0 then '00000000' when x.form = 0 then substr(md5(f.t), 1, 8)
                               else substr(md5(f.edited), 1, 8) end) as digest
  from forms f cross join (values (0), (1)) x(form) cross join range(0, {_PARTS}) r(part)
  left join digests d on d.doc_id = f.doc_id and d.form = x.form and d.part = r.part)
select f.doc_id, any_value(length(f.t)) as n_chars, any_value(sha256(f.edited)) as edited_sha256,
       string_agg(a.digest, '' order by a.part) as fingerprint, string_agg(e.digest, '' order by a.part) as edited_fingerprint,
       {_likeness("e")} as near_edited, {_likeness("n")} as near_next
from forms f
join parts a on a.doc_id = f.doc_id and a.form = 0
join parts e on e.doc_id = f.doc_id and e.form = 1 and e.part = a.part
join parts n on n.doc_id = f.next_id and n.form = 0 and n.part = a.part
group by f.doc_id
"""



def op8_sql(shards: list[str]) -> str:
    """Slot by hash, shard by the table; the table itself is held to brute force in the tests."""
    owners = "[" + ", ".join(map(str, slot_table(shards).tolist())) + "]"
    return f"""
    SELECT doc_id, slot::INTEGER AS slot, list_extract({shards}, list_extract({owners}, slot + 1) + 1) AS shard
    FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot
          FROM documents)
    """


OP11 = """
with recursive
field as (
  select doc_id, text, coalesce('=' || source, '') as tree,
         strlen(doc_id::varchar) || ':' || doc_id
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(length(n_chars::varchar) || ':' || n_chars, '-') as head,
         -- the last bit of CRC-32, which is inverted at the end
         list_reduce(
           list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
           lambda crc, c: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384::bigint), xor(crc, c)),
           4294967295::bigint) % 2 = 1 as tampered
  from documents),
forms as (select *, case when tampered then replace(text, chr(10), '') else text end as claim from field),
leaves as (
  select doc_id, tree,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         sha256(head || coalesce(strlen(claim) || ':' || claim, '-')) as claimed
  from forms),
placed as (
  select *, row_number() over (partition by tree order by doc_id) - 1 as idx, count(*) over (partition by tree) as n from leaves),
up as (
  select tree, 0 as level, idx, n, leaf as node from placed
  union all
  select tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' order by idx)) from up
  where n > 1 group by tree, level, idx // 3, n),
subroots as (
  select tree, node as subroot, row_number() over (order by tree) - 1 as place, count(*) over () as n from up where up.n = 1),
over_all as (
  select '*' as tree, 0 as level, place as idx, n, subroot as node from subroots
  union all
  select tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' order by idx)) from over_all
  where n > 1 group by tree, level, idx // 3, n),
nodes as (select * from up union all select * from over_all),
steps as (
  select nodes.tree, level, idx,
         coalesce(lag(node, 2) over run, '') || coalesce(lag(node, 1) over run, '') as l,
         coalesce(lead(node, 1) over run, '') || coalesce(lead(node, 2) over run, '') as r,
         nodes.n <= 3 and nodes.tree <> '*' as last, place
  from nodes left join subroots s on s.tree = nodes.tree
  where nodes.n > 1
  window run as (partition by nodes.tree, level, idx // 3 order by idx)),
walk as (
  select doc_id, 0 as step, case when p.n = 1 then '*' else p.tree end as tree, 0 as level,
         case when p.n = 1 then place else idx end as idx, claimed as digest, '' as way
  from placed p join subroots s on s.tree = p.tree
  union all
  select doc_id, step + 1, case when last then '*' else w.tree end, case when last then 0 else w.level + 1 end,
         case when last then place else w.idx // 3 end, sha256(l || digest || r), way || l || r
  from walk w join steps s on s.tree = w.tree and s.level = w.level and s.idx = w.idx),
ends as (select doc_id, arg_max(digest, step) as folded_root, arg_max(way, step) as way from walk group by doc_id)
select p.doc_id, leaf, subroot, root, sha256(way) as proof_sha256, folded_root, folded_root = root as verified
from placed p join subroots s on s.tree = p.tree join ends e on e.doc_id = p.doc_id
cross join (select node as root from over_all where n = 1)
"""

OP12 = r"""
with texts as (
  select doc_id, length(coalesce(text, '')) as n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t
  from documents),
grouped as (
  select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, sha256(t) as text_sha256
  from texts window w as (partition by t order by n_chars desc, doc_id))
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from grouped
"""

OP13 = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
counts as (select doc_id, term, count(*) as tf from words group by all),
sizes as (select doc_id, sum(tf)::bigint as n from counts group by doc_id),
totals as (select count(*) as docs, sum(n)::bigint as terms from sizes),
weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counts cross join totals group by term),
asked as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
scored as (
  select item_id, c.doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * docs) // terms)))))::bigint as score
  from asked a join counts c on c.term = a.term join weights x on x.term = a.term
  join sizes s on s.doc_id = c.doc_id cross join totals
  group by item_id, c.doc_id),
placed as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from placed where rank <= 20
"""

ORACLE = {
    "op2_secrets": OP2,
    "op3_cosine_groups": OP3,
    "op7_repeats": OP7,
    "op9_imatch": OP9,
    "op11_merkle": OP11,
    "op12_exact": OP12,
    "op13_search": OP13,
}
