"""The same results as ``queries`` in SQL, for a single-node check."""

from __future__ import annotations

from ..config import CHARS_PER_TOKEN, CHUNK_CHARS, CHUNK_OVERLAP, PACK_TOKEN_BUDGET
from ..operators.chunking import NOTHING_FOUND, SEPARATORS

DIM = 128
EPS = "1e-6"


def fnv(expr: str) -> str:
    units = f"list_transform(range(1, length({expr}) + 1), lambda i: unicode(substr({expr}, i, 1))::bigint)"
    return (
        f"format('{{:08x}}', case when length({expr}) = 0 then 2166136261::bigint else "
        f"list_reduce({units}, lambda h, u: (xor(h, u) * 16777619) & 4294967295, 2166136261::bigint) end)"
    )


UTF16 = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def tokens(expr: str) -> str:
    return f"cast(ceil({UTF16.format(expr)} / 4.0) as bigint)"


LINES = """
lines as materialized (
  select c_mktsegment as store_id, o_orderkey as passage_seq, l_linenumber::bigint as line,
         lower(c_name) as customer, lower(p_name) as part, lower(s_name) as supplier
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey),
tri as materialized (
  select store_id, passage_seq, line * 2 as ord, customer as subject, 'bought' as predicate, part as object from lines
  union all select store_id, passage_seq, line * 2 + 1, part, 'supplied by', supplier from lines),
seen as materialized (
  select store_id, passage_seq, subject as entity, ((passage_seq << 25) + ord) << 1 as seq from tri
  union all select store_id, passage_seq, object, (((passage_seq << 25) + ord) << 1) + 1 from tri)"""

FACT_EDGES = """
fe as materialized (
  select store_id, src, dst, count(*)::double as w from (
    select store_id, 'entity:' || subject as src, 'entity:' || object as dst from tri
    union all select store_id, 'entity:' || object, 'entity:' || subject from tri) group by all)"""

PASSAGE_EDGES = """
men as materialized (select distinct store_id, entity, passage_seq from seen),
pe as materialized (
  select store_id, 'passage:' || passage_seq as src, 'entity:' || entity as dst, 1.0::double as w from men
  union all select store_id, 'entity:' || entity, 'passage:' || passage_seq, 1.0 from men)"""


def keyword_tables(source: str) -> str:
    """Extraction of the keyword stand-in over ``source(store_id, passage_seq, text)``."""
    return f"""
w as (select store_id, passage_seq, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{4,}}')) as w from {source}),
wc as (select store_id, passage_seq, w, count(*) as c from w group by all),
rk as materialized (
  select *, row_number() over (partition by store_id, passage_seq order by c desc, w) as r,
         sum(c) over (partition by store_id, passage_seq) as total from wc),
tri as materialized (
  select a.store_id, a.passage_seq, a.r - 1 as ord, a.w as subject, 'relates to' as predicate, b.w as object
  from rk a join rk b on a.store_id = b.store_id and a.passage_seq = b.passage_seq and b.r = a.r + 1
  where a.r <= 5),
seen as materialized (
  select store_id, passage_seq, subject as entity, ((passage_seq << 25) + ord) << 1 as seq from tri
  union all select store_id, passage_seq, object, (((passage_seq << 25) + ord) << 1) + 1 from tri),
ent as materialized (
  select store_id, entity, min(seq) as entity_seq, min(passage_seq) as first_passage_seq from seen group by all),
fact as materialized (
  select store_id, subject || ' ' || predicate || ' ' || object as fact,
         min((passage_seq << 25) + ord) as fact_seq, min(passage_seq) as owner_seq,
         any_value(subject) as subject, any_value(predicate) as predicate, any_value(object) as object
  from tri group by store_id, fact)"""


DOCS = """
doc as materialized (
  select lang as store_id, doc_id, text, row_number() over (partition by lang order by doc_id) - 1 as passage_seq
  from documents)"""

PASSAGES = r"""
pas as materialized (
  select d.store_id, d.passage_seq, coalesce(s.summary, '') as text,
         case when regexp_matches(d.text, '[0-9]') and contains(d.text, '?') then ['event', 'goal']
              when regexp_matches(d.text, '[0-9]') then ['event']
              when contains(d.text, '?') then ['goal'] else ['fact'] end as types,
         coalesce(s.topics, []) as topics,
         coalesce(s.words, 0) / greatest(1, coalesce(s.total, 0)) as salience
  from doc d left join (
    select store_id, passage_seq, string_agg(w, ' ' order by r) filter (where r <= ceil(total / 4.0)) as summary,
           list(w order by r) filter (where r <= 5) as topics, count(*) as words, sum(c) as total
    from rk group by all) s on d.store_id = s.store_id and d.passage_seq = s.passage_seq)"""


def vectors(texts: str) -> str:
    """Sparse trigram vectors ``v(k, dim, x)`` and norms ``nv(k, n)`` of ``texts(k, text)``."""
    return f"""
tw as (select k, unnest(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ')) as w from {texts}),
tg as (select k, unnest(list_transform(range(1, length(w) + 1), lambda i: substr('#' || w || '#', i, 3))) as g from tw where w <> ''),
slot as materialized (
  select g, ('0x' || substr(md5(g), 1, 4))::int % {DIM} as dim,
         case when ('0x' || substr(md5(g), 5, 1))::int < 8 then 1.0 else -1.0 end as s
  from (select distinct g from tg)),
v as materialized (select k, dim, sum(s) as x from tg join slot using (g) group by k, dim having sum(s) <> 0),
nv as materialized (select k, sqrt(sum(x * x)) as n from v group by k)"""


DOC_TEXTS = """
vt as materialized (
  select 'q' || item_id as k, text from benchmark
  union all select distinct 'p' || text, text from pas
  union all select distinct 'f' || fact, fact from fact
  union all select distinct 'e' || entity, entity from ent)"""

QUERY_ROWS = """
lg as (select distinct lang as store_id from documents),
qs as materialized (
  select store_id, item_id as query_id, text as query_text, 'q' || item_id as k from benchmark cross join lg
  where text <> '')"""


def scores(name: str, items: str, key: str) -> str:
    """Cosine of every query with every item of its store."""
    return f"""
{name}_q as materialized (select v.* from v where k in (select k from qs)),
{name}_i as materialized (select v.* from v where k in (select {key} from {items})),
{name}_d as materialized (select a.k as qk, b.k as ik, sum(a.x * b.x) as dot from {name}_q a join {name}_i b using (dim) group by all),
{name} as materialized (
  select q.store_id, q.query_id, i.*exclude(store_id),
         case when coalesce(nq.n * ni.n, 0) > 0 then coalesce(d.dot, 0) / (nq.n * ni.n) else 0.0 end as score
  from qs q join {items} i on q.store_id = i.store_id
  left join nv nq on nq.k = q.k left join nv ni on ni.k = i.{key}
  left join {name}_d d on d.qk = q.k and d.ik = i.{key})"""


MEMORY = ",".join([DOCS, keyword_tables("doc"), PASSAGES, DOC_TEXTS, vectors("vt"), QUERY_ROWS])
FACT_SCORES = (
    "fi as (select *, 'f' || fact as ik from fact)," + scores("fs", "fi", "ik")
)
PASSAGE_SCORES = (
    "pi as (select store_id, passage_seq, 'p' || text as ik from pas)," + scores("ps", "pi", "ik")
)
SIMILAR = """
ei as (select *, 'e' || entity as ik from ent),
ev as materialized (
  select e.store_id, e.entity, e.entity_seq, e.first_passage_seq as born, v.dim, v.x, nv.n from ei e join v on v.k = e.ik join nv on nv.k = e.ik),
ed as materialized (
  select a.store_id, a.entity as a, b.entity as b, any_value(a.born) as a_born, any_value(b.born) as b_born,
         any_value(b.entity_seq) as b_seq, sum(a.x * b.x) / (any_value(a.n) * any_value(b.n)) as score
  from ev a join ev b on a.store_id = b.store_id and a.dim = b.dim
  where a.entity <> b.entity and length(regexp_replace(a.entity, '[^A-Za-z0-9]', '', 'g')) > 2
  group by a.store_id, a.entity, b.entity)"""


def ledger(threshold: float, k: int) -> str:
    """Edge weights with every similarity edge set at its last time among the best ``k``."""
    return f"""{SIMILAR},
near as materialized (select * from ed where score >= {threshold}),
gone as materialized (
  select x.store_id, x.a, x.b, list_sort(list(y.b_born) filter (where y.b is not null))[{k}] as left_at
  from near x left join near y on x.store_id = y.store_id and x.a = y.a
    and (y.score > x.score or (y.score = x.score and y.b_seq < x.b_seq))
  group by x.store_id, x.a, x.b),
syn as materialized (
  select n.store_id, n.a, n.b, any_value(n.score) as score, max(i.t) as set_at
  from near n join gone g using (store_id, a, b)
  join (select distinct store_id, first_passage_seq as t from ent) i on i.store_id = n.store_id
    and i.t >= greatest(n.a_born, n.b_born) and (g.left_at is null or i.t < g.left_at)
  group by n.store_id, n.a, n.b),
ends as materialized (
  select store_id, 'entity:' || subject as src, 'entity:' || object as dst, passage_seq from tri
  union all select store_id, 'entity:' || object, 'entity:' || subject, passage_seq from tri),
sets as materialized (
  select store_id, src, dst, max(score) as s, max(set_at) as t from (
    select store_id, 'entity:' || a as src, 'entity:' || b as dst, score, set_at from syn
    union all select store_id, 'entity:' || b, 'entity:' || a, score, set_at from syn) group by all),
late as (select store_id, src, dst, count(*) as late from ends join sets using (store_id, src, dst) where passage_seq > t group by all),
adds as (select store_id, src, dst, count(*)::double as n from ends group by all),
led as materialized (
  select store_id, src, dst, case when s is not null then s + coalesce(late, 0) else n end as w
  from adds full join sets using (store_id, src, dst) left join late using (store_id, src, dst))"""


LEDGER = ledger(0.8, 10)


def rolling(source: str) -> str:
    """Fold of ``source(store_id, session_index, exchange_index, exchange_text)`` with the keyword stand-in as summarizer."""
    prev = "case when starts_with(peak, '[Summary]') then string_split(substr(peak, 11), chr(10) || chr(10))[1] else '' end"
    ws = r"regexp_extract_all(lower(peak), '[\p{L}\p{Nl}\p{No}]{4,}')"
    short = (
        f"array_to_string(list_concat(list_filter(string_split({prev}, ' ')[1:10], lambda w: w <> ''), "
        f"list_filter({ws}, lambda w, i: list_position({ws}, w) = i)[1:greatest(8, {UTF16.format('peak')} // 64)]), ' ')"
    )
    return f"""
walk as (
  select store_id, session_index, -1::bigint as exchange_index, ''::varchar as held, ''::varchar as peak, ''::varchar as buffer, false as summarized, 0::bigint as events, null::varchar as summary
  from (select distinct store_id, session_index from {source})
  union all
  select store_id, session_index, exchange_index, held, peak, case when over then '[Summary]' || chr(10) || summary else peak end, over, events, case when over then summary end
  from (select *, case when over then {short} else '' end as summary from (
    select *, {UTF16.format('peak')} > 4096 as over from (
      select s.store_id, s.session_index, s.exchange_index, w.buffer as held, case when w.buffer = '' then s.exchange_text else w.buffer || chr(10) || chr(10) || s.exchange_text end as peak,
             w.events + w.summarized::bigint as events
      from walk w join {source} s on s.store_id = w.store_id and s.session_index = w.session_index and s.exchange_index = w.exchange_index + 1)))),
rolled as materialized (
  select store_id, session_index, exchange_index, {tokens('held')} as tokens_before, {tokens('peak')} as tokens_peak, {tokens('buffer')} as tokens_after,
         summarized, events as events_before, summary from walk where exchange_index >= 0)"""


def lives(capacity: int) -> str:
    """``held`` after each flush and ``life`` of every passage of ``pp(store_id, passage_seq, flush, flush_ms, salience, since, acc_ms)``."""
    return f"""
fl as materialized (
  select store_id, flush, any_value(flush_ms) as flush_ms, row_number() over (partition by store_id order by flush) as n from pp group by store_id, flush),
pn as materialized (select pp.*, n from pp join fl using (store_id, flush)),
held(n, store_id, passage_seq, flush, flush_ms, salience, since, acc_ms) as (
  select distinct 0::bigint, store_id, null::bigint, null::bigint, null::bigint, null::double, null::bigint, null::bigint from pp
  union all
  select n, store_id, passage_seq, flush, flush_ms, salience, since, acc_ms from (
    select c.*, row_number() over (partition by c.store_id order by
        (1.0 - salience) * ln(1.0 + (f.flush_ms - since) / 3600000.0)
        - case when acc_ms > c.flush_ms and acc_ms <= f.flush_ms then 1.0 / (1.0 + (f.flush_ms - acc_ms) / 3600000.0) else 0.0 end,
        passage_seq desc) as r
    from (
      select n + 1 as n, store_id, passage_seq, flush, flush_ms, salience, since, acc_ms from held where passage_seq is not null
      union all
      select p.n, p.store_id, p.passage_seq, p.flush, p.flush_ms, p.salience, p.since, p.acc_ms
      from pn p join (select distinct store_id, n from held) h on p.store_id = h.store_id and p.n = h.n + 1) c
    join fl f on f.store_id = c.store_id and f.n = c.n)
  where r <= {capacity}),
last as (select store_id, passage_seq, max(n) as n from held where passage_seq is not null group by all),
life as materialized (
  select p.store_id, p.passage_seq, p.flush as born, case when l.n is null then p.flush else f.flush end as died
  from pn p left join last l on l.store_id = p.store_id and l.passage_seq = p.passage_seq
  left join fl f on f.store_id = p.store_id and f.n = l.n + 1)"""


def lived(name: str, rows: str, key: str) -> str:
    """Lives of ``key`` as unions of the lives of the passages in ``rows(store_id, key, passage_seq, seq)``."""
    return f"""
{name}_s as (select r.store_id, {key}, seq, passage_seq, born, coalesce(died, 9223372036854775807) as died from {rows} r join life using (store_id, passage_seq)),
{name}_n as (select *, case when born > max(died) over (partition by store_id, {key} order by born, seq rows between unbounded preceding and 1 preceding) then 1 else 0 end as fresh from {name}_s),
{name}_p as (select *, sum(fresh) over (partition by store_id, {key} order by born, seq rows unbounded preceding) as part from {name}_n),
{name} as materialized (
  select store_id, {key}, min(born) as born, nullif(max(died), 9223372036854775807) as died, min(seq) as seq, min(passage_seq) as since
  from {name}_p group by store_id, {key}, part)"""


ORDER_LIVES = """
pp as materialized (
  select c_mktsegment as store_id, o_orderkey as passage_seq, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 as flush,
         epoch_ms(date_trunc('month', o_orderdate) + interval 1 month) as flush_ms, least(1.0, o_totalprice / 1000000)::double as salience,
         epoch_ms(o_orderdate) as since, case when o_orderstatus = 'F' then epoch_ms(o_orderdate) + 2592000000 end as acc_ms
  from orders join customer on o_custkey = c_custkey),""" + lives(200)

DOC_LIVES = """
pp as materialized (
  select store_id, passage_seq, passage_seq // 10 as flush, (passage_seq // 10 + 1) * 36000000 as flush_ms, salience::double as salience,
         (passage_seq // 10 + 1) * 36000000 as since, null::bigint as acc_ms from pas),""" + lives(40) + "," + lived("el", "seen", "entity")

ALIASES = ",".join([
    DOCS, keyword_tables("doc"), PASSAGES,
    """
uses as materialized (select store_id, topic, count(*) as n from (select store_id, lower(unnest(topics)) as topic from pas) where topic <> '' group by all),
vt as materialized (select distinct topic as k, topic as text from uses)""",
    vectors("vt"),
    """
alike as materialized (
  select x.k as a, y.k as b from v x join v y on x.dim = y.dim join nv nx on nx.k = x.k join nv ny on ny.k = y.k
  where x.k <> y.k group by x.k, y.k having sum(x.x * y.x) / (any_value(nx.n) * any_value(ny.n)) >= 0.7),
reach as (
  select s.store_id, a as topic, b as other from alike join uses s on s.topic = a join uses t on t.topic = b and t.store_id = s.store_id
  union
  select r.store_id, r.topic, l.b from reach r join alike l on l.a = r.other join uses t on t.topic = l.b and t.store_id = r.store_id),
part as (select store_id, topic, least(topic, min(other)) as root from reach group by store_id, topic),
best as (
  select store_id, root, first(topic order by n desc, length(topic), topic) as canonical from part join uses using (store_id, topic) group by store_id, root),
alias as materialized (select store_id, topic as alias, canonical from part join best using (store_id, root) where topic <> canonical)""",
])

REMOVALS = SIMILAR + """,
uel as materialized (
  select el.*, m.last as until from el left join (select store_id, born as died, max(passage_seq) as last from life group by all) m using (store_id, died)),
intro as (select distinct store_id, since as t from uel),
ranked as (
  select e.store_id, e.a, e.b, e.score, i.t, la.since as a_since, lb.since as b_since, lb.died as b_died,
         row_number() over (partition by e.store_id, e.a, i.t order by e.score desc, lb.seq) as r
  from ed e join uel la on la.store_id = e.store_id and la.entity = e.a and la.died is null
  join uel lb on lb.store_id = e.store_id and lb.entity = e.b
  join intro i on i.store_id = e.store_id and i.t >= greatest(la.since, lb.since) and (lb.until is null or i.t <= lb.until)
  where e.score >= 0.5),
syn as materialized (select store_id, a, b, any_value(score) as score, max(t) as set_at from ranked where r <= 2 and b_died is null group by all),
sets as materialized (
  select store_id, src, dst, max(score) as s, max(set_at) as t from (
    select store_id, a as src, b as dst, score, set_at from syn union all select store_id, b, a, score, set_at from syn) group by all),
ends as materialized (
  select store_id, subject as src, object as dst, passage_seq from tri union all select store_id, object, subject, passage_seq from tri),
adds as (
  select e.store_id, e.src, e.dst, count(*)::double as n
  from ends e join uel x on x.store_id = e.store_id and x.entity = e.src and x.died is null
  join uel y on y.store_id = e.store_id and y.entity = e.dst and y.died is null
  left join sets s on s.store_id = e.store_id and s.src = e.src and s.dst = e.dst
  where e.passage_seq >= greatest(x.since, y.since) and (s.t is null or e.passage_seq > s.t) group by all),
led as materialized (
  select store_id, 'entity:' || src as src, 'entity:' || dst as dst, coalesce(s, 0) + coalesce(n, 0) as w from adds full join sets using (store_id, src, dst))"""

RECALL = """
ext as (select store_id, query_id, min(score) as lo, max(score) as hi from fs group by all),
cand as materialized (select * from {cand} ),
es as materialized (
  select store_id, query_id, node, avg(f / coalesce(c, 1)) as p from (
    select c.store_id, c.query_id, 'entity:' || unnest([c.subject, c.object]) as node,
           case when e.hi = e.lo then 0.0 else (c.score - e.lo) / (e.hi - e.lo) end as f
    from cand c join ext e using (store_id, query_id))
  left join (select store_id, 'entity:' || entity as node, count(distinct passage_seq) as c from seen group by all)
    using (store_id, node)
  group by all)"""

PPR = """
ot as (select store_id, src, sum(w) as t from g group by all),
tr as materialized (select store_id, src, dst, w / t as share from g join ot using (store_id, src)),
p0 as materialized (
  select store_id, query_id, node, case when t > 0 then p / t else 0 end as p
  from seeds join (select store_id, query_id, sum(p) as t from seeds group by all) using (store_id, query_id)),
it as (
  select 0 as i, store_id, query_id, node, p as x, p, 1.0::double as step from p0
  union all
  select i + 1, store_id, query_id, node, x, p, max(abs(x - old)) over (partition by store_id, query_id) from (
    select i, store_id, query_id, node, sum(a) as x, sum(p) as p, sum(old) as old from (
      select i, it.store_id, query_id, t.dst as node, 0.5 * x * share as a, 0.0 as p, 0.0 as old
      from it join tr t on it.store_id = t.store_id and it.node = t.src where step >= 1e-6 and i < 100 and x > 0
      union all
      select i, store_id, query_id, node, 0.5 * p, p, x from it where step >= 1e-6 and i < 100)
    group by all)),
ppr as materialized (
  select store_id, query_id, node, x as score from (select *, max(i) over (partition by store_id, query_id) as mi from it) where i = mi and x <> 0)"""
OPEN_CANDIDATES = (
    "(select * from (select *, row_number() over (partition by store_id, query_id order by score desc, fact_seq) as rank from fs) where rank <= 25)"
)
FILTERS = """
qf as materialized (
  select store_id, query_id, case when query_id % 2 = 0 then list_distinct(regexp_extract_all(lower(query_text), '[a-z]{8,}')) else [] end as topic_filter from qs),
qt as (select store_id, query_id, unnest(topic_filter) as f from qf),
ok as materialized (
  select qf.store_id, qf.query_id, pas.passage_seq from qf join pas using (store_id)
  where list_has_any(pas.types, ['event', 'plan'])
    and (len(topic_filter) = 0 or exists (
      select 1 from (select unnest(topic_filter) as f) a, (select unnest(pas.topics) as t) b
      where (least(length(f), length(t)) < 3 and f = t) or (least(length(f), length(t)) >= 3 and left(f, 3) = left(t, 3)))))"""
LIMITED_CANDIDATES = (
    "(select * from (select fs.*, row_number() over (partition by fs.store_id, fs.query_id order by score desc, fact_seq) as rank "
    "from fs join ok on fs.store_id = ok.store_id and fs.query_id = ok.query_id and fs.owner_seq = ok.passage_seq) where rank <= 25)"
)
SEEDS = """
pn as materialized (
  select store_id, query_id, passage_seq, 'passage:' || passage_seq as node,
         case when hi = lo then 0.0 else (score - lo) / (hi - lo) end * 0.05 as p
  from (select *, min(score) over (partition by store_id, query_id) as lo, max(score) over (partition by store_id, query_id) as hi from ps)
  where (store_id, query_id) in (select distinct store_id, query_id from cand)),
seeds as (select store_id, query_id, node, p from es union all select store_id, query_id, node, p from pn),
men as (select distinct store_id, entity, passage_seq from seen),
g as materialized (
  select * from led
  union all select store_id, 'passage:' || passage_seq, 'entity:' || entity, 1.0 from men
  union all select store_id, 'entity:' || entity, 'passage:' || passage_seq, 1.0 from men)"""


def ranked(allowed: str) -> str:
    return f"""
rp as (select pn.store_id, pn.query_id, pn.passage_seq, coalesce(ppr.score, 0) as score
  from pn left join ppr using (store_id, query_id, node)),
rt as (select *, max(score) over (partition by store_id, query_id) as top from rp),
rr as (select *, row_number() over (partition by store_id, query_id order by round(score, 12) desc, passage_seq) as rank from rt {allowed})
select store_id, query_id, passage_seq, rank, round(score, 7) as score from rr
where rank <= 10 and (rank = 1 or score >= top * 0.2)"""


def recall_sql(candidates: str, filters: str, allowed: str) -> str:
    parts = [MEMORY, FACT_SCORES, PASSAGE_SCORES, LEDGER, *([filters] if filters else []),
             RECALL.format(cand=candidates), SEEDS, PPR, ranked(allowed).lstrip("\n")]
    body = ",".join(parts[:-1]) + "," + parts[-1]
    return "with recursive " + body


DENSE = """
dp as materialized (
  select * from (select store_id, query_id, passage_seq, score,
    row_number() over (partition by store_id, query_id order by score desc, passage_seq) as rank from ps) where rank <= 3)"""

NOTES = """
notes as materialized (
  select source as store_id, doc_id as seq,
         case when n_chars % 7 = 0 then '' else '2024-' || lpad((n_chars % 12 + 1)::varchar, 2, '0') || '-' || lpad((n_chars % 28 + 1)::varchar, 2, '0') end as date,
         text as content, doc_id::varchar as cite from documents),
numbered as materialized (
  select *, row_number() over (partition by store_id order by date, seq) as ordinal from notes),
note_lines as materialized (
  select store_id, seq, ordinal, ordinal || '. [' || date || '] ' || content || ' [exchange:' || cite || ']' as line from numbered)"""

TURNS = """
turns as materialized (
  select conv_id // 10 as store_id, conv_id % 10 as session_index, turn as pos, role, text as content, 'day ' || conv_id as d from conversations)"""


def pairs(source: str, dated: bool) -> str:
    head = "'[Session: ' || max(d) || ']' || chr(10) || " if dated else ""
    return f"""
pairs as materialized (
  select store_id, session_index, pos // 2 as exchange_index,
         {head}'User: ' || coalesce(max(case when pos % 2 = 0 then content end), '')
         || coalesce(chr(10) || 'Assistant: ' || max(case when pos % 2 = 1 then content end), '') as exchange_text
  from {source} group by store_id, session_index, pos // 2)"""


SPACE_SQL = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def split_sql(text: str, level: int = 0) -> str:
    """List of chunks of ``text``: the recursive splitter, its five separators unrolled level by level."""
    size, over, t = CHUNK_CHARS, CHUNK_OVERLAP, f"t{level}"
    if level == len(SEPARATORS):
        body = f"[substr({t}, i + 1, {size}) for i in range(0, length({t}), {size - over})]"
    else:
        glue = "chr(10) || chr(10)" if SEPARATORS[level] == "\n\n" else "chr(10)" if SEPARATORS[level] == "\n" else f"'{SEPARATORS[level]}'"
        grown = f"case when a.held <> '' then a.held || {glue} || x.held else x.held end"
        done = "a.done || case when a.held <> '' then [a.held] else [] end"
        packed = (
            f"list_transform([list_reduce(list_transform(string_split({t}, {glue}), lambda p: {{'held': p, 'done': []::varchar[]}}), lambda a, x: "
            f"case when length({grown}) <= {size} then {{'held': {grown}, 'done': a.done}} "
            f"when length(x.held) > {size} then {{'held': '', 'done': {done} || [x.held]}} "
            f"else {{'held': x.held, 'done': {done}}} end, {{'held': '', 'done': []::varchar[]}})], lambda a: {done})[1]"
        )
        finer = f"flatten(list_transform(case when contains({t}, {glue}) then {packed} else [{t}] end, lambda b{level}: {split_sql(f'b{level}', level + 1)}))"
        body = (
            f"list_transform([{finer}], lambda l: case when not contains({t}, {glue}) then l else "
            f"list_transform(range(1, len(l) + 1), lambda i: case when i = 1 then l[1] else right(l[i - 1], {over}) || l[i] end) end)[1]"
        )
    return f"list_transform([{text}], lambda {t}: case when length({t}) <= {size} then [{t}] else {body} end)[1]"


def chunk_tables(source: str) -> str:
    """``chunks(owner, role, chunk_idx, chunk)`` of ``source(owner, text)``; characters beyond the basic plane do not occur."""
    mark = "chr(10) || 'Assistant:'"
    return f"""
halves as materialized (
  select owner, 0 as half, 'user' as role, case when instr(text, {mark}) > 0 then left(text, instr(text, {mark}) - 1) else text end as body from {source}
  union all select owner, 1, 'assistant', substr(text, instr(text, {mark}) + 1) from {source} where instr(text, {mark}) > 0),
cut as materialized (select owner, half, role, {split_sql('body')} as pieces from halves where body is not null),
chunks as materialized (
  select owner, role, (half::bigint << 40) + place - 1 as chunk_idx, regexp_replace(piece, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') as chunk
  from (select owner, half, role, unnest(pieces) as piece, generate_subscripts(pieces, 1) as place from cut)
  where regexp_replace(piece, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') <> '')"""


def fold(source: str, keys: str, pos: str, compressed: int) -> str:
    """Recursive buffer-length fold over ``source(keys, pos, size)``."""
    on = " and ".join(f"f.{k} = s.{k}" for k in keys.split(", "))
    sk = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""
fold as (
  select {keys}, {pos}, 0::bigint as before_len, size as peak_len, case when size > 4096 then {compressed} else size end as after_len
  from {source} where {pos} = 0
  union all
  select {sk}, s.{pos}, f.after_len, f.after_len + 2 + s.size, case when f.after_len + 2 + s.size > 4096 then {compressed} else f.after_len + 2 + s.size end
  from fold f join {source} s on {on} and s.{pos} = f.{pos} + 1)"""


TRACE = (
    "cast(ceil(before_len / 4.0) as bigint) as tokens_before, cast(ceil(peak_len / 4.0) as bigint) as tokens_peak, "
    "cast(ceil(after_len / 4.0) as bigint) as tokens_after, peak_len > 4096 as summarized"
)
SNAPSHOTS = "with recursive " + ",".join([
    TURNS, pairs("turns", True),
    f"""
ex as materialized (select *, row_number() over (partition by store_id order by session_index, exchange_index) - 1 as passage_seq,
  {UTF16.format('exchange_text')} as size from pairs)""",
    fold("ex", "store_id, session_index", "exchange_index", 10 + len("earlier turns compressed")),
    """
held as materialized (
  select ex.store_id, ex.session_index, ex.passage_seq, before_len, peak_len, after_len,
    coalesce(max(case when peak_len > 4096 then ex.passage_seq + 1 end) over (partition by ex.store_id, ex.session_index order by ex.passage_seq),
             min(ex.passage_seq) over (partition by ex.store_id, ex.session_index)) as passages
  from ex join fold on ex.store_id = fold.store_id and ex.session_index = fold.session_index and ex.exchange_index = fold.exchange_index)""",
    keyword_tables("(select store_id, passage_seq, exchange_text as text from ex)"),
    f"""
snap as (
  select h.store_id, h.session_index, h.passage_seq as turn_index, {TRACE}, h.passages,
    (select count(*) from ent e where e.store_id = h.store_id and e.first_passage_seq < h.passages) as entities,
    (select count(*) from fact f where f.store_id = h.store_id and f.owner_seq < h.passages) as facts
  from held h)""",
])

ROLLED = TURNS + "," + pairs("turns", True) + "," + rolling("pairs")

REMEMBERED = "with recursive " + ",".join([
    ROLLED,
    """
ex as materialized (select *, row_number() over (partition by store_id order by session_index, exchange_index) - 1 as passage_seq from pairs),
unit as materialized (
  select store_id, session_index, events_before, row_number() over (partition by store_id order by session_index, events_before) - 1 as flush, max(passage_seq) as newest
  from rolled join ex using (store_id, session_index, exchange_index) group by store_id, session_index, events_before),
turn as materialized (select * from rolled join ex using (store_id, session_index, exchange_index) join unit using (store_id, session_index, events_before))""",
    keyword_tables("(select store_id, passage_seq, exchange_text as text from ex)"),
    """
pp as materialized (
  select t.store_id, t.passage_seq, t.flush, (t.newest + 1) * 60000 as flush_ms, coalesce(s.salience, 0)::double as salience, (t.newest + 1) * 60000 as since, null::bigint as acc_ms
  from turn t left join (select store_id, passage_seq, count(*) / sum(c) as salience from rk group by all) s using (store_id, passage_seq))""",
    lives(12),
    """
kept as materialized (select h.store_id, fl.flush, h.passage_seq from held h join fl using (store_id, n) where h.passage_seq is not null),
size as materialized (
  select k.store_id, k.flush, count(distinct k.passage_seq) as passages, count(distinct s.entity) as entities,
         count(distinct t.subject || ' ' || t.predicate || ' ' || t.object) as facts
  from kept k left join seen s using (store_id, passage_seq) left join tri t using (store_id, passage_seq) group by all),
snap as (
  select t.store_id, t.session_index, t.passage_seq as turn_index, tokens_before, tokens_peak, tokens_after, summarized, t.summary,
         coalesce(z.passages, 0) as passages, coalesce(z.entities, 0) as entities, coalesce(z.facts, 0) as facts
  from turn t left join size z on z.store_id = t.store_id and z.flush = t.flush - case when t.summarized then 0 else 1 end)""",
])

PARTS = """
pp as materialized (select p_partkey as passage_seq, lower(p_type) as type, p_name, p_brand, lower(p_type) as t from part),
pt as materialized (select passage_seq, unnest([replace(p_name, ' ', '-'), p_brand, t]) as topic from pp),
pw as materialized (select distinct passage_seq, unnest(regexp_split_to_array(regexp_replace(lower(topic), '[-_]', ' ', 'g'), '\\s+')) as w from pt),
fl as materialized (select min(p_partkey) as query_id, lower(p_type) as type, p_name from part group by p_name, p_type),
fw as materialized (select query_id, unnest(regexp_split_to_array(lower(p_name), '\\s+')) as w from fl)"""

EVENT_PASSAGES = """
ep as materialized (
  select event_type as store_id, event_id as passage_seq, least(1.0, value / 500) as salience, epoch_us(ts) // 1000 as t0,
         (props->>'$.k')::bigint as k from events),
fscore as materialized (
  select store_id, passage_seq, (1.0 - salience) * ln(1.0 + (1706745600000 - t0) / 3600000.0)
    - case when k % 4 > 0 then 1.0 / (1.0 + (1706745600000 - (t0 + k * 600000)) / 3600000.0) else 0.0 end as forget_score from ep)"""

CASCADE = "with " + ",".join([
    LINES,
    """
op as materialized (
  select c_mktsegment as store_id, o_orderkey as passage_seq, least(1.0, o_totalprice / 1000000) as salience,
         epoch_ms(o_orderdate) as t0, o_orderstatus = 'F' as acc
  from orders join customer on o_custkey = c_custkey),
sc as (
  select store_id, passage_seq, (1.0 - salience) * ln(1.0 + (1104537600000 - t0) / 3600000.0)
    - case when acc then 1.0 / (1.0 + (1104537600000 - (t0 + 2592000000)) / 3600000.0) else 0.0 end as s from op),
kept as materialized (
  select store_id, passage_seq from (select *, row_number() over (partition by store_id order by s, passage_seq desc) as rn from sc) where rn <= 200),
gone as (select op.store_id, op.passage_seq from op anti join kept using (store_id, passage_seq)),
men as materialized (select distinct store_id, entity, passage_seq from seen),
kmen as materialized (select men.* from men join kept using (store_id, passage_seq)),
kent as materialized (select distinct store_id, entity from kmen),
kfact as (select distinct store_id, subject || ' ' || predicate || ' ' || object as fact from tri join kept using (store_id, passage_seq)),
ke as (
  select store_id, src, dst, count(*)::double as w from (
    select store_id, subject as src, object as dst from tri union all select store_id, object, subject from tri)
  where (store_id, src) in (select store_id, entity from kent) and (store_id, dst) in (select store_id, entity from kent)
  group by all
  union all select store_id, entity, passage_seq::varchar, 1.0 from kmen
  union all select store_id, passage_seq::varchar, entity, 1.0 from kmen),
cnt as (
  select store_id, count(*) as passages from kept group by all)
select cnt.store_id, passages, entities, facts, entities + passages as graph_nodes, edges, weight
from cnt join (select store_id, count(*) as entities from kent group by all) using (store_id)
join (select store_id, count(*) as facts from kfact group by all) using (store_id)
join (select store_id, count(*) as edges, sum(w) as weight from ke group by all) using (store_id)""",
])

KEYWORDS = r"""
bk as materialized (select item_id, list_filter(list_distinct(regexp_split_to_array(text, '\s+')), lambda w: w <> '') as raw,
  regexp_split_to_array(text, '\s+') as all_words from benchmark),
bw as (select item_id, word, min(i) as i from (select item_id, unnest(all_words) as word, unnest(range(1, len(all_words) + 1)) as i from bk) where word <> '' group by all),
ka as materialized (
  select doc_id, text, lang, n_chars, doc_id % (select count(*) from benchmark) as item_id from documents),
kr as materialized (
  select ka.doc_id, ka.lang, case when n_chars < 800 then 'easy' when n_chars < 3000 then 'medium' else 'hard' end as difficulty,
    coalesce(string_agg(word, ' ' order by i) filter (where contains(lower(text), lower(word))), '') as matched,
    count(*) filter (where not contains(lower(text), lower(word)))::bigint as missed,
    count(*) filter (where contains(lower(text), lower(word))) / count(*) as score
  from ka join bw using (item_id) group by all)"""

PROGRESS = """
pe0 as materialized (
  select user_id as run_id, event_id as seq, (props->>'$.k')::bigint as k,
    case event_type when 'signup' then 'start' when 'view' then 'question_start' when 'click' then 'turn'
      when 'purchase' then 'question_done' else 'error' end as type
  from events)"""

RESULTS = """
res as materialized (
  select lang as question_type, quality = 1 as correct, n_chars as indexing_ms, n_chars * 2 + 1 as retrieval_ms,
         n_chars % 97 as entities, n_chars % 89 as facts from documents join labels using (doc_id))"""

SIMS = """
sim as materialized (
  select a.vec_id as query_id, b.vec_id as item_id, a.label as la, b.label as lb,
    list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) as score
  from (select vec_id, label, embedding::double[] as e from embeddings) a, (select vec_id, label, embedding::double[] as e from embeddings) b)"""

_names = "select c_name as name from customer union select s_name from supplier union select p_name from part"

ORACLES: dict[str, str] = {
    "entity_ids": f"""with n as ({_names}) select name, lower(name) as entity, 'entity-' || {fnv('lower(name)')} as entity_id,
        length(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) > 2 as significant from n""",
    "passage_ids": f"""with {DOCS}, h as (select *, 'passage-' || passage_seq || '-' || left(text, 50) as raw from doc)
        select store_id, doc_id, passage_seq, 'passage-' || {fnv('raw')} as passage_id from h""",
    "token_estimates": f"""with t as (select 'document' as kind, doc_id as id, {tokens('text')} as tokens from documents
        union all select 'page', page_id, {tokens('html')} from pages)
        select kind, id, tokens, greatest(30, floor(tokens / 4.0 + 0.5)::bigint)::bigint as target_tokens from t""",
    "dataset_loaded": """select row_number() over (order by doc_id) - 1 as pos, doc_id::varchar as question_id, lang as question_type,
        md5(text) as content_md5 from documents""",
    "text_previews": "select doc_id, left(text, 60) || case when length(text) > 60 then '...' else '' end as preview from documents",
    "json_replies": """select event_id, case when event_id % 3 = 2 then 'no json here' else props end as body,
        case when event_id % 3 = 2 then null else (props->>'$.k')::bigint end as k from events""",
    "verdicts": "select doc_id, quality::int as correct from labels",
    "fact_dedupe": f"""with {LINES}, f as (
        select store_id, subject || ' ' || predicate || ' ' || object as fact, min((passage_seq << 25) + ord) as fact_seq,
          any_value(subject) as subject, any_value(predicate) as predicate, any_value(object) as object from tri group by store_id, fact)
        select store_id, fact, 'fact-' || {fnv('fact')} as fact_id, subject, predicate, object, fact_seq >> 25 as owner_seq, fact_seq from f""",
    "entity_first_seen": f"""with {LINES}, e as (select store_id, entity, min(seq) as entity_seq, min(passage_seq) as first_passage_seq from seen group by all)
        select *, 'entity-' || {fnv('entity')} as entity_id from e""",
    "entity_mentions": f"with {LINES} select store_id, entity, count(distinct passage_seq) as passages from seen group by all",
    "new_facts": f"""with {LINES}, t as (select *, subject || ' ' || predicate || ' ' || object as fact from tri),
        o as (select o_orderkey as passage_seq, o_orderdate < timestamp '1998-01-01' as old from orders)
        select t.store_id, t.fact, min(t.passage_seq) as owner_seq from t join o using (passage_seq)
        group by t.store_id, t.fact having not bool_or(old)""",
    "id_collisions": f"""with {LINES}, f as (select distinct subject || ' ' || predicate || ' ' || object as fact from tri)
        select 'fact-' || {fnv('fact')} as hash_id, count(*) as texts from f group by all having count(*) > 1""",
    "document_extraction": f"""with {DOCS}, {keyword_tables('doc')}, {PASSAGES},
        h as (select store_id, passage_seq, 'passage-' || passage_seq || '-' || left(text, 50) as raw from doc)
        select store_id, passage_seq, 'passage-' || {fnv('raw')} as passage_id, text, array_to_string(types, ',') as types,
          array_to_string(topics, ',') as topics, round(salience, 9) as salience from pas join h using (store_id, passage_seq)""",
    "fact_edges": f"with {LINES}, {FACT_EDGES} select * from fe",
    "passage_edges": f"with {LINES}, {PASSAGE_EDGES} select * from pe",
    "graph_nodes": f"""with {LINES} select distinct store_id, 'entity:' || entity as node, 'entity' as type from seen
        union all select c_mktsegment, 'passage:' || o_orderkey, 'passage' from orders join customer on o_custkey = c_custkey""",
    "out_weights": f"""with {LINES}, {FACT_EDGES}, {PASSAGE_EDGES}
        select store_id, src, sum(w) as out_weight from (select * from fe union all select * from pe) group by all""",
    "store_stats": f"""with {LINES}
        select *, passages + entities as graph_nodes from (
          select c_mktsegment as store_id, count(*) as passages from orders join customer on o_custkey = c_custkey group by all)
        join (select store_id, count(distinct entity) as entities from seen group by all) using (store_id)
        join (select store_id, count(distinct subject || ' ' || predicate || ' ' || object) as facts from tri group by all) using (store_id)""",
    "edge_ledger": f"with {MEMORY}, {LEDGER} select store_id, src, dst, round(w, 9) as w from led",
    "crowded_ledger": f"with {MEMORY}, {ledger(0.5, 2)} select store_id, src, dst, round(w, 9) as w from led",
    "synonym_edges": f"""with {MEMORY}, {SIMILAR} select store_id, a, b, rank, round(score, 9) as score from (
        select *, row_number() over (partition by store_id, a order by score desc, b_seq) as rank from ed where score >= 0.8) where rank <= 10""",
    "cosine_topk": f"""with {SIMS} select query_id, item_id, rank, round(score, 9) as score from (
        select *, row_number() over (partition by query_id order by score desc, item_id) as rank from sim) where rank <= 10""",
    "knn_synonyms": f"""with {SIMS} select query_id, item_id, rank, round(score, 9) as score from (
        select *, row_number() over (partition by query_id order by score desc, item_id) as rank from sim
        where score >= 0.3 and query_id <> item_id) where rank <= 10""",
    "similar_pairs": f"with {SIMS} select query_id, item_id, round(score, 9) as score from sim where score >= 0.3 and query_id <> item_id",
    "minmax_scores": f"""with {SIMS} select la as store_id, query_id, item_id,
        round(case when hi = lo then 0.0 else (score - lo) / (hi - lo) end, 7) as scaled from (
        select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from sim where la = lb)""",
    "candidate_facts": f"with {MEMORY}, {FACT_SCORES}, cand as {OPEN_CANDIDATES} select store_id, query_id, fact, rank, round(score, 9) as score from cand",
    "filtered_candidates": f"with {MEMORY}, {FACT_SCORES}, {FILTERS}, cand as {LIMITED_CANDIDATES} select store_id, query_id, fact, rank, round(score, 9) as score from cand",
    "recognized_triples": f"""with {MEMORY}, {FACT_SCORES}, cand as {OPEN_CANDIDATES},
        hit as (select c.*, list_has_any(regexp_split_to_array(lower(query_text), '\\s+'), string_split(fact, ' ')) as hit from cand c join qs using (store_id, query_id))
        select store_id, query_id, row_number() over (partition by store_id, query_id order by rank) - 1 as pos, subject, predicate, object
        from hit where hit""",
    "carried_seeds": f"""with {MEMORY}, {FACT_SCORES}, cand as {OPEN_CANDIDATES},
        hit as (select c.*, list_has_any(regexp_split_to_array(lower(query_text), '\\s+'), string_split(fact, ' ')) as hit from cand c join qs using (store_id, query_id)),
        rt as (select store_id, query_id, row_number() over (partition by store_id, query_id order by rank) - 1 as pos, subject, predicate, object from hit where hit),
        ops as (select store_id, 3 * query_id as op_no, case when query_id % 3 <> 0 then 'recognize' else 'recall' end as kind from qs
          union all select store_id, 3 * query_id + 1, 'recall' from qs),
        sourced as (select *, max(case when kind = 'recognize' then op_no end) over (partition by store_id order by op_no) as source_op from ops)
        select s.store_id, op_no, source_op, pos, subject, predicate, object
        from sourced s join rt on rt.store_id = s.store_id and rt.query_id * 3 = source_op where kind = 'recall'""",
    "entity_seed_weights": f"with {MEMORY}, {FACT_SCORES}, {RECALL.format(cand=OPEN_CANDIDATES)} select store_id, query_id, node, round(p, 7) as p from es",
    "retrieved_passages": recall_sql(OPEN_CANDIDATES, "", ""),
    "filtered_retrieval": recall_sql(LIMITED_CANDIDATES, FILTERS, "join ok using (store_id, query_id, passage_seq)"),
    "dense_passages": f"with {MEMORY}, {PASSAGE_SCORES}, {DENSE} select store_id, query_id, passage_seq, rank, round(score, 9) as score from dp",
    "answer_contexts": f"""with {MEMORY}, {PASSAGE_SCORES}, {DENSE}
        select store_id, query_id, coalesce(string_agg('[Memory ' || rank || '] [' || array_to_string(types, ',') || '] [' || array_to_string(topics, ',') || ']: ' || text,
          chr(10) || chr(10) order by rank), 'No relevant memories found.') as context
        from dp join pas using (store_id, passage_seq) group by store_id, query_id""",
    "associations": f"""with {MEMORY}, {FACT_SCORES}, cand as {OPEN_CANDIDATES},
        hit as (select c.*, list_has_any(regexp_split_to_array(lower(query_text), '\\s+'), string_split(fact, ' ')) as hit from cand c join qs using (store_id, query_id)),
        listed as (select *, row_number() over (partition by store_id, query_id order by rank) as n from hit where hit)
        select store_id, query_id, coalesce(string_agg(n || '. (' || subject || ', ' || predicate || ', ' || object || ')', chr(10) order by n), 'No associations found.') as associations
        from qs left join listed using (store_id, query_id) group by all""",
    "accessed_passages": f"""with {MEMORY}, {PASSAGE_SCORES}, {DENSE}
        select pas.store_id, pas.passage_seq, count(dp.query_id) as access_count,
          case when count(dp.query_id) > 0 then 1706745600000 else 0 end::bigint as last_accessed_ms
        from pas left join dp using (store_id, passage_seq) group by all""",
    "ppr_scores": f"""with recursive {LINES}, {FACT_EDGES}, g as (select * from fe),
        seeds as (select store_id, (regexp_extract(supplier, '([0-9]+)', 1)::bigint % 8) as query_id, 'entity:' || supplier as node, count(*)::double as p from lines group by all),
        {PPR} select store_id, query_id, node, round(score, 9) as score from ppr""",
    "passage_nodes": "select c_mktsegment as store_id, 'passage:' || o_orderkey as node from orders join customer on o_custkey = c_custkey",
    "supplier_neighbors": f"""with {LINES}, {FACT_EDGES}, {PASSAGE_EDGES}
        select store_id, dst, w from (select * from fe union all select * from pe) where src = 'entity:supplier#000000001'""",
    "tag_matches": f"""with {PARTS} select distinct f.query_id, p.passage_seq from fw f join pw p
        on (least(length(f.w), length(p.w)) < 3 and f.w = p.w) or (least(length(f.w), length(p.w)) >= 3 and left(f.w, 3) = left(p.w, 3))
        join fl on fl.query_id = f.query_id join pp on pp.passage_seq = p.passage_seq
        where f.query_id % 2 = 1 or fl.type = pp.type""",
    "topic_list": f"with {DOCS}, {keyword_tables('doc')}, {PASSAGES} select distinct store_id, unnest(topics) as topic from pas",
    "consolidated_topics": """with t as (
        select p_partkey as passage_seq, unnest([replace(p_name, ' ', '-'), 'family-' || (regexp_extract(p_brand, '([0-9]+)', 1)::int % 5), lower(p_type)]) as topic,
          unnest([1, 2, 3]) as i from part),
        d as (select passage_seq, topic, min(i) as i from t group by all)
        select passage_seq, string_agg(topic, '|' order by i) as topics from d group by all""",
    "topic_aliases": f"with recursive {ALIASES} select * from alias",
    "merged_topics": f"""with recursive {ALIASES},
        many as (select store_id from uses group by all having count(*) >= 3),
        t as (select store_id, passage_seq, unnest(topics) as topic, generate_subscripts(topics, 1) as i from pas),
        r as (select t.store_id, passage_seq, i, coalesce(case when m.store_id is not null then canonical end, topic) as topic
          from t left join alias a on a.store_id = t.store_id and a.alias = lower(topic) left join many m on m.store_id = t.store_id),
        d as (select store_id, passage_seq, topic, min(i) as i from r group by all)
        select pas.store_id, pas.passage_seq, coalesce(string_agg(topic, '|' order by i), '') as topics from pas left join d using (store_id, passage_seq) group by all""",
    "forget_candidates": f"""with {EVENT_PASSAGES} select store_id, passage_seq, round(forget_score, 9) as forget_score from (
        select *, row_number() over (partition by store_id order by forget_score, passage_seq desc) as rn from fscore) where rn > 200""",
    "forget_cascade": CASCADE,
    "passage_lifetimes": f"with recursive {ORDER_LIVES} select store_id, passage_seq, born, died from life",
    "entity_lifetimes": f"with recursive {MEMORY}, {DOC_LIVES} select store_id, entity, born, died, since as first_passage_seq from el",
    "memory_sizes": f"""with recursive {LINES}, {ORDER_LIVES},
        kept as materialized (select store_id, n, passage_seq from held where passage_seq is not null),
        men as materialized (select distinct store_id, entity, passage_seq from seen),
        ft as materialized (select distinct store_id, subject || ' ' || predicate || ' ' || object as fact, passage_seq from tri)
        select fl.store_id, fl.flush, p.passages, coalesce(e.entities, 0) as entities, coalesce(f.facts, 0) as facts from fl
        join (select store_id, n, count(*) as passages from kept group by all) p using (store_id, n)
        left join (select store_id, n, count(distinct entity) as entities from kept join men using (store_id, passage_seq) group by all) e using (store_id, n)
        left join (select store_id, n, count(distinct fact) as facts from kept join ft using (store_id, passage_seq) group by all) f using (store_id, n)""",
    "ledger_removals": f"with recursive {MEMORY}, {DOC_LIVES}, {REMOVALS} select store_id, src, dst, round(w, 9) as w from led",
    "paired_exchanges": f"with {TURNS}, {pairs('turns', True)} select * from pairs",
    "paired_without_system": f"""with {TURNS}, nt as (select * replace (row_number() over (partition by store_id, session_index order by pos) - 1 as pos) from turns where role <> 'system'),
        {pairs('nt', False)} select * from pairs""",
    "turn_pair_counts": f"""with {TURNS} select store_id, sum(ceil(n / 2.0))::bigint as turn_pairs, count(*) as sessions from (
        select store_id, session_index, count(*) as n from turns group by all) group by all""",
    "pressure_points": f"""with recursive {TURNS}, {pairs('turns', False)},
        ex as materialized (select store_id, row_number() over (partition by store_id order by session_index, exchange_index) - 1 as pos, {UTF16.format('exchange_text')} as size from pairs),
        {fold('ex', 'store_id', 'pos', 20)} select store_id, pos, {TRACE} from fold""",
    "pressure_points_one_store": f"""with recursive {TURNS}, {pairs('turns', False)},
        ex as materialized (select 0 as one, row_number() over (order by store_id, session_index, exchange_index) - 1 as pos, {UTF16.format('exchange_text')} as size from pairs),
        {fold('ex', 'one', 'pos', 20)} select pos, {TRACE} from fold""",
    "lint_points": f"""with recursive {TURNS}, {pairs('turns', False)},
        ex as materialized (select store_id, row_number() over (partition by store_id order by session_index, exchange_index) - 1 as pos, {UTF16.format('exchange_text')} as size from pairs),
        {fold('ex', 'store_id', 'pos', 20)}, ev as (select store_id, pos, row_number() over (partition by store_id order by pos) as n from fold where peak_len > 4096)
        select store_id, pos from ev where n % 3 = 0""",
    "previous_summaries": "select doc_id, case when doc_id % 2 = 0 then string_split(text, chr(10) || chr(10))[1] else '' end as summary from documents",
    "turn_snapshots": SNAPSHOTS + " select * from snap",
    "rolling_pressure": f"with recursive {ROLLED} select * from rolled",
    "remembered_snapshots": REMEMBERED + " select * from snap",
    "bounded_memories": REMEMBERED + f""", {lived('fl_', "(select store_id, subject || ' ' || predicate || ' ' || object as fact, passage_seq, ord as seq from tri)", 'fact')},
        {lived('el', 'seen', 'entity')}
        select store_id, passages, entities, facts, passages + entities as graph_nodes, owners from (
          select store_id, count(*) as passages from life where died is null group by all)
        join (select store_id, count(*) as entities from el where died is null group by all) using (store_id)
        join (select store_id, count(*) as facts, sum(since)::bigint as owners from fl_ where died is null group by all) using (store_id)""",
    "chart_scales": SNAPSHOTS + """ select store_id, greatest(1024, max(greatest(tokens_peak, tokens_after)))::bigint as max_tokens,
        greatest(1, max(greatest(entities, facts)))::bigint as max_graph from snap group by all""",
    "compact_summaries": f"""with {TURNS}, {pairs('turns', False)},
        xw as (select store_id, session_index, exchange_index, greatest(30, floor({tokens('exchange_text')} / 4.0 + 0.5))::bigint as target,
          regexp_extract_all(lower(exchange_text), '\\p{{L}}{{4,}}') as ws from pairs),
        xd as (select *, list_filter(ws, lambda w, i: list_position(ws, w) = i) as d from xw),
        sj as (select store_id, session_index, string_agg(array_to_string(d[1:target], ' '), chr(10) || chr(10) order by exchange_index) as joined from xd group by all),
        jw as (select *, greatest(30, floor({tokens('joined')} / 4.0 + 0.5))::bigint as target, regexp_extract_all(lower(joined), '\\p{{L}}{{4,}}') as ws from sj),
        jd as (select *, list_filter(ws, lambda w, i: list_position(ws, w) = i) as d from jw)
        select store_id, session_index, '[Summary of earlier conversation]' || chr(10) || array_to_string(d[1:target], ' ') as narrative from jd""",
    "exchange_chunks": f"""with {TURNS}, {pairs('turns', True)},
        texts as (select 'd' || doc_id as owner, text from documents
          union all select 'x-' || store_id || '-' || session_index || '-' || exchange_index, exchange_text from pairs),
        {chunk_tables('texts')} select owner, role, chunk_idx, chunk from chunks""",
    "packed_contexts": f"""with {MEMORY}, {PASSAGE_SCORES}, {DENSE},
        numbered_docs as (select lang as store_id, row_number() over (partition by lang order by doc_id) - 1 as passage_seq, text from documents),
        found as (select q.store_id || '/' || q.query_id as query_id, q.query_text from qs q),
        texts as (select store_id || '/' || query_id || '#' || rank as owner, text from dp join numbered_docs using (store_id, passage_seq)),
        {chunk_tables('texts')},
        sized as (select split_part(owner, '#', 1) as query_id, split_part(owner, '#', 2)::int as passage_idx, chunk_idx, chunk, {tokens('chunk')} as tokens from chunks),
        scored as (select *, sum(tokens) over (partition by query_id) <= {PACK_TOKEN_BUDGET} as fits,
          len(list_intersect(list_distinct(regexp_split_to_array(lower(query_text), '\\s+')), list_distinct(regexp_split_to_array(lower(chunk), '\\s+')))) as overlap
          from sized join found using (query_id)),
        ranked as (select *, row_number() over (partition by query_id order by case when fits then 0 else overlap end desc, passage_idx, chunk_idx) as rank from scored),
        running as (select *, sum(tokens) over (partition by query_id order by rank) as used from ranked),
        body as (select query_id, string_agg(chunk, chr(10) || chr(10) order by rank) filter (where used <= {PACK_TOKEN_BUDGET}) as context,
          left(min_by(chunk, rank), {PACK_TOKEN_BUDGET * CHARS_PER_TOKEN}) as best from running group by all)
        select query_id, coalesce(context, best, '{NOTHING_FOUND}') as context from found left join body using (query_id)""",
    "budget_pack": f"""with c as (select lang, doc_id, coalesce(quality, -1) as quality, {tokens('text')} as tokens from documents left join labels using (doc_id)),
        r as (select *, row_number() over w as rank, sum(tokens) over (w rows unbounded preceding) as used from c window w as (partition by lang order by quality desc, doc_id))
        select lang, doc_id, rank, tokens, used::bigint as used from r where used <= 20000""",
    "notes_format": f"with {NOTES} select store_id, ordinal, line from note_lines",
    "notes_index": f"""with {NOTES}, dk as (select *, case when date = '' then 'undated' else date end as date_key,
          left(content, 60) || case when length(content) > 60 then '...' else '' end as preview from notes)
        select store_id, date_key, date_seq, segment, notes, previews from (
          select store_id, date_key, seq // 20 as segment, count(*) as notes, string_agg(preview, '; ' order by seq) as previews from dk group by all)
        join (select store_id, date_key, min(seq) as date_seq from dk group by all) using (store_id, date_key)""",
    "notes_search": f"""with {NOTES}, b as (select 'src' || (item_id % 20) as store_id, item_id as query_id,
          list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') as terms from benchmark),
        m as (select n.*, b.query_id from numbered n join b using (store_id)
          where len(list_filter(terms, lambda t: contains(lower(date || ' ' || content), t))) > 0)
        select store_id, query_id, count(*) as notes, sum(ordinal)::bigint as ordinals, min(seq) as first_seq from m group by all""",
    "notepad_stats": f"""with {NOTES} select store_id, cast(ceil(chars / 4.0) as bigint) as notepad_tokens, exchange_count, note_count from (
        select store_id, sum({UTF16.format('line')}) + count(*) - 1 as chars, count(*) as note_count from note_lines group by all)
        join (select source as store_id, count(distinct md5(text)) as exchange_count from documents group by all) using (store_id)""",
    "notes_cited": "select source as store_id, doc_id as seq, case when l.doc_id is not null then length(text)::int end as found_chars from documents left join labels l using (doc_id)",
    "notes_edited": """with d as (select source as store_id, doc_id as edit_no, unnest([doc_id, -doc_id - 1]) as seq, l.doc_id is not null as was_read from documents left join labels l using (doc_id))
        select store_id, edit_no, seq, (seq >= 0 and was_read)::int as ok,
          case when seq < 0 then 'Note #' || seq || ' does not exist.' when not was_read then 'Cannot edit note #' || seq || ': read it first.' end as error from d""",
    "select_per_type": "select doc_id as pos, lang as question_type from (select *, row_number() over (partition by lang order by doc_id) as rn from documents) where rn <= 5",
    "question_types": "select lang as question_type, min(doc_id) as first_pos from documents group by all",
    "dataset_projection": f"""with {TURNS} select store_id::varchar as question_id, 'chat' as question_type, 'store ' || store_id as question,
        min_by(d, session_index) as answer, count(distinct session_index)::int as session_count from turns group by store_id""",
    "question_detail": f"""with {TURNS} select '0' as question_id, (select min_by(d, session_index) from turns where store_id = 0) as question_date,
        row_number() over (order by session_index) - 1 as session_index, n as turns from (select session_index, count(*) as n from turns where store_id = 0 group by all)""",
    "dataset_turns": f"""with {TURNS} select store_id::varchar as store_id, (dense_rank() over (partition by store_id order by session_index) - 1)::int as session_index,
        (row_number() over (partition by store_id, session_index order by pos) - 1)::int as pos, role, content, d as session_date from turns""",
    "dataset_summary": f"""with {TURNS} select store_id, count(distinct session_index) as session_count, count(*) as turns,
        arg_min(content, session_index * 1000000 + pos) as question from turns group by all""",
    "dataset_search": "select doc_id as pos, doc_id::varchar as question_id from documents where lang = 'en' and contains(lower(text), 'that') order by doc_id limit 50",
    "accuracy_by_type": f"with {RESULTS} select question_type, count(*) as total, count(*) filter (where correct) as correct, round(count(*) filter (where correct) * 100.0 / count(*), 9) as accuracy_pct from res group by all",
    "overview_stats": f"""with {RESULTS} select count(*) as total, count(*) filter (where correct) as correct, round(avg(correct::int) * 100, 9) as accuracy_pct,
        round(avg(indexing_ms) / 1000, 9) as avg_index_s, round(avg(retrieval_ms) / 1000, 9) as avg_retrieval_s,
        round(avg(entities), 9) as avg_entities, round(avg(facts), 9) as avg_facts from res""",
    "keyword_recall": f"""with {KEYWORDS} select doc_id, matched, missed, round(score, 9) as score,
        case when score >= 0.75 then 'PASS' when score >= 0.5 then 'PARTIAL' else 'FAIL' end as grade from kr""",
    "recall_report": f"""with {KEYWORDS} select dimension, value, count(*) as tests, round(avg(score), 9) as mean_score from (
        select 'overall' as dimension, 'all' as value, score from kr union all select 'test_type', lang, score from kr
        union all select 'difficulty', difficulty, score from kr) group by all""",
    "progress_frames": f"""with {PROGRESS} select seq as stream_id, case when seq % 4 = 0 then 2 else 0 end as frame, type, k as turns from pe0""",
    "progress_fold": f"""with {PROGRESS}, st as (select run_id,
          arg_max(k + 100, seq) filter (where type in ('start', 'turn')) as global_total_turns,
          coalesce(arg_max(k, seq) filter (where type = 'turn'), 0) as global_turns_done,
          coalesce(arg_max(k, seq) filter (where type = 'question_done'), 0) as questions_completed,
          case when max(seq) filter (where type = 'question_start') > coalesce(max(seq) filter (where type = 'question_done'), -1)
            then 'q' || arg_max(k, seq) filter (where type = 'question_start') end as active_question,
          arg_max('failed ' || k, seq) filter (where type = 'error') as error from pe0 group by all)
        select *, null::bigint as total_questions, 1 as running, round(coalesce(global_turns_done * 100.0 / nullif(global_total_turns, 0), 0), 9) as global_pct from st""",
}
ORACLES["ppr_scores_distributed"] = ORACLES["ppr_scores"]
ORACLES["ppr_scores_heavy"] = ORACLES["ppr_scores"]
ORACLES["knn_synonyms_blocks"] = ORACLES["knn_synonyms"]
ORACLES["passage_ids_ranged"] = ORACLES["passage_ids"]
ORACLES["progress_stream_frames"] = ORACLES["progress_frames"]
