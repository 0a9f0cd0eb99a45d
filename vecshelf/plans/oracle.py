"""The same queries written independently as SQL over the given tables."""

from __future__ import annotations

_BASE = """
with books as (
  select p.p_partkey work_key, p.p_name title, p.p_brand author,
         year(min(l.l_shipdate)) "year", count(*) editions
  from part p join lineitem l on l.l_partkey = p.p_partkey
  group by p.p_partkey, p.p_name, p.p_brand),
catalog as (select *, 'Book|' || author || '|' || title input_text from books where "year" is not null),
meta as (
  select input_text, work_key, author, title, "year", editions from catalog
  qualify row_number() over (partition by input_text
    order by editions desc, "year" asc nulls last, work_key) = 1),
vecs as (
  select c.input_text, e.embedding::double[] vec from embeddings e join catalog c on e.vec_id = c.work_key
  qualify row_number() over (partition by c.input_text order by e.vec_id) = 1),
corpus as (select m.*, v.vec from meta m join vecs v on v.input_text = m.input_text),
changes as (
  select event_id, ts, user_id "user", cast(json_extract_string(props, '$.k') as bigint) work_key,
         case event_type when 'purchase' then 2 when 'click' then 1 when 'view' then -1
                         when 'error' then -2 end rating
  from events),
folded as (
  select "user", work_key, rating::bigint rating, ts updated_at from (
    select *, row_number() over (partition by "user", work_key order by ts desc, event_id desc) rn
    from changes) where rn = 1 and rating is not null),
ratings as (
  select f.*, c.input_text from folded f join catalog c on c.work_key = f.work_key),
terms as (
  select r."user", r.rating::double w, v.vec from ratings r join vecs v on v.input_text = r.input_text),
sums as (
  select "user", pos, sum(w * x) s from (
    select "user", w, generate_subscripts(vec, 1) pos, unnest(vec) x from terms) group by "user", pos),
tastes as (select "user", list(s order by pos) vec from sums group by "user"),
labels as (
  select label::varchar label, list(m order by pos) vec from (
    select label, pos, avg(x) m from (
      select label, generate_subscripts(embedding, 1) pos, unnest(embedding)::double x from embeddings)
    group by label, pos) group by label)
"""

_SCORE = "list_cosine_similarity(c.vec, {q}.vec)"
_META = 'work_key, author, title, "year", editions'


def _top(scored: str, by: str, n: int, columns: str) -> str:
    """Rank ``scored`` rows per ``by``, best score first, then lowest key."""
    return f"""
select {columns}, round(score, 6) score, rank from (
  select *, row_number() over (partition by {by} order by round(score, 12) desc, work_key) rank
  from ({scored})) where rank <= {n}"""


def _signed(n: int, more: str = "") -> str:
    scored = f"""
  select t."user", c.* exclude (vec), {_SCORE.format(q='t')} score from tastes t, corpus c
  where not exists (select 1 from ratings r where r."user" = t."user" and r.work_key = c.work_key) {more}"""
    return _top(scored, '"user"', n, f'"user", {_META}')


_NEW_AUTHORS = """and not exists (select 1 from ratings r join catalog k on k.work_key = r.work_key
    where r."user" = t."user" and k.author = c.author)"""
_NEW_TEXTS = """and not exists (select 1 from ratings r
    where r."user" = t."user" and r.input_text = c.input_text)"""

_LIKED = """, liked as (
  select distinct r."user" qid, c.work_key, c.vec from ratings r join corpus c
  on c.input_text = r.input_text where r.rating > 0)"""


def _from_liked(aggregate: str, n: int, having: str = "") -> str:
    scored = f"""
  select l.qid, c.work_key, c.author, c.title, c."year", c.editions,
         {aggregate}({_SCORE.format(q='l')}) score
  from liked l, corpus c
  where not exists (select 1 from liked x where x.qid = l.qid and x.work_key = c.work_key)
  group by all {having}"""
    return _LIKED + _top(scored, "qid", n, f"qid, {_META}")


_BEST = 'order by editions desc nulls last, "year" asc nulls last, work_key limit 1'


def _similar(more: str) -> str:
    scored = f"""
  select 0 one, c.* exclude (vec), {_SCORE.format(q='b')} score from corpus c, best b
  where c.work_key <> b.work_key {more}"""
    return f""", best as (select * from corpus where title ilike '%widget%'
    or input_text ilike '%widget%' {_BEST})""" + _top(scored, "one", 20, _META)


_LINES = """, lines as (
  select p_brand pref_author, max(p_name) pref_title from part group by p_brand
  union all select n_name, 'atlas' from nation)"""


def _matched(source: str) -> str:
    return f"""
  select l.pref_author, l.pref_title, c.* from lines l join {source} c
    on c.title ilike '%' || l.pref_title || '%' and c.author ilike '%' || l.pref_author || '%'
  qualify row_number() over (partition by l.pref_author, l.pref_title
    order by c.editions desc nulls last, c."year" asc nulls last, c.work_key) = 1"""


def _from_preferences(aggregate: str, lines: str = "", more: str = "") -> str:
    scored = f"""
  select 0 one, c.work_key, c.author, c.title, c."year", c.editions,
         {aggregate}({_SCORE.format(q='h')}) score
  from corpus c, hits h where c.work_key not in (select work_key from hits) {more} group by all"""
    hits = f", hits as (select * from ({_matched('corpus')}) {lines})"
    return _LINES + hits + _top(scored, "one", 20, _META)


_SEARCH = """
select * from (
  select q.query, c.work_key, c.author, c.title, c."year", c.editions,
         exists (select 1 from corpus o where o.work_key = c.work_key) has_embedding,
         row_number() over (partition by q.query
           order by c.editions desc nulls last, c."year" asc nulls last, c.work_key) rank
  from (select distinct unnest(string_split(p_name, ' ')) query from part
        union select distinct upper(p_brand) from part) q
  join catalog c on contains(lower(c.title), lower(q.query)) or contains(lower(c.author), lower(q.query)))
where rank <= 10"""

_UNWANTED = """, unwanted as (
  select distinct r."user", k.author from ratings r join catalog k on k.work_key = r.work_key where r.rating = -2)"""
_NOT_UNWANTED = """and not exists (select 1 from unwanted x where x."user" = t."user" and x.author = c.author)"""

# Works, editions and authors as the dump describes them, without the detour over JSON.
_DUMP = """
with eds as (
  select l_partkey, count(*) edition_count,
         min(case when l_quantity > 5 then year(l_shipdate) end)::integer min_year,
         bool_or(l_quantity >= 50) ed_fiction,
         max('978' || lpad(l_orderkey::varchar, 10, '0')) isbn13,
         max(case l_returnflag when 'R' then l_linestatus || ' reprint'
                               when 'A' then 'a "quoted" note' end) ed_desc,
         min(l_suppkey) low, max(l_suppkey) high
  from lineitem group by l_partkey),
chosen as (
  select *, '/works/OL' || p_partkey || 'W' work_key from part join eds on l_partkey = p_partkey
  where edition_count >= 2 and (p_size <= 25 or ed_fiction)),
links as (
  select work_key, '/authors/OL' || low || 'A' author_key, 1::bigint "position" from chosen
  union all
  select work_key, '/authors/OL' || high || 'A', 3 from chosen),
named as (
  select '/authors/OL' || s_suppkey || 'A' author_key, s_name "name",
         case when s_acctbal > 0 then '1 January 1900' end birth_date, null::varchar death_date,
         case when s_acctbal < 1000 then 'A plain life.' when s_acctbal < 5000 then 'A told life.' end bio,
         lower(s_name) || '|S.' alternate_names
  from supplier where '/authors/OL' || s_suppkey || 'A' in (select author_key from links))
"""

_HASH_VEC = """list_transform(range(32), lambda i: ('0x' || substr(sha256({t}), 2 * i + 1, 2))::int - 127.5::double)"""




_TEXT_UNITS = f"""
with raw as (select distinct "text" t, {_HASH_VEC.format(t='"text"')} v from documents where "text" is not null),
scaled as (select t, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) n from raw),
units as (select sha256(t) input_sha256, list_transform(v, lambda x: (x / n)::float) vec from scaled)
"""


def _long(source: str, ids: str) -> str:
    return f"""
select {ids}, pos - 1 pos, round(x::double, 6) "value" from (
  select {ids}, generate_subscripts(vec, 1)::bigint pos, unnest(vec) x from {source})"""


_LABEL_TERMS = """, ordered as (select label, vec, row_number() over (order by label) i, count(*) over () m from labels),
lterms as (
  select 'from ' || a.label expr_id, a.label, 1.0 coef from ordered a where a.i < a.m
  union all select 'from ' || a.label, b.label, -1.0 from ordered a join ordered b on b.i = a.i + 1
  union all select 'from ' || a.label, b.label, 1.0 from ordered a join ordered b on b.i = b.m where a.i < a.m),
raw as (select expr_id, pos, sum(coef * x)::double s from (
  select t.expr_id, t.coef, generate_subscripts(l.vec, 1) pos, unnest(l.vec) x
  from lterms t join labels l on l.label = t.label) group by expr_id, pos),
lengths as (select expr_id, sqrt(sum(s * s)) len from raw group by expr_id),
exprs as (select r.expr_id, list(s order by pos) vec from raw r group by r.expr_id),
units as (select r.expr_id, list(s / len order by pos) vec
  from raw r join lengths n on n.expr_id = r.expr_id group by r.expr_id)"""


def _label_knn(score: str, n: int = 10, where: str = "true") -> str:
    scored = f"select l.label qid, c.work_key, {score} score from labels l, corpus c where {where}"
    return _top(scored, "qid", n, "qid, work_key")


_CONCEPTS = """, concepts as (
  select p.p_name || '/' || p.p_type concept_id, p.p_name title, p.p_type "type",
         case when min(p.p_size) > 2 then min(b."year") end::varchar "year",
         max(p.p_brand) expected_author, p.p_name expected_title
  from part p join books b on b.work_key = p.p_partkey group by p.p_name, p.p_type),
formats as (
  select concept_id, "type", "year", unnest([
    {'format': 'bare', 'text': title},
    {'format': 'paren', 'text': title || ' (' || lower("type") || ')'},
    {'format': 'pipe', 'text': "type" || coalesce('|' || "year", '') || '|' || title},
    {'format': 'pipe_no_year', 'text': "type" || '|' || title},
    {'format': 'colon_nl', 'text': 'category: ' || "type" || chr(10) || 'title: ' || title || coalesce(chr(10) || 'year: ' || "year", '')},
    {'format': 'json', 'text': '{"category": "' || "type" || '", "title": "' || title || coalesce('", "year": "' || "year", '') || '"}'},
    {'format': 'ini', 'text': '[item]' || chr(10) || 'category=' || "type" || chr(10) || 'title=' || title || coalesce(chr(10) || 'year=' || "year", '')},
    {'format': 'yaml', 'text': 'category: ' || "type" || chr(10) || 'title: ' || title || coalesce(chr(10) || 'year: ' || "year", '')},
    {'format': 'sentence', 'text': 'The ' || lower(coalesce("year" || ' ', '') || "type") || ' ' || title}
  ], recursive := true) from concepts)"""

_EVALUATED = (
    _CONCEPTS
    + f""", fterms as (
  select concept_id, format, 'marked' variant, "text" t, 1.0 coef from formats
  union all select f.concept_id, f.format, v.variant, f."text", 1.0 from formats f,
    (select unnest(['sub_bare', 'sub_explicit']) variant) v where f.format not in ('bare', 'paren')
  union all select f.concept_id, f.format, v.variant, v.t, -1.0 from formats f,
    lateral (select unnest(['sub_bare', 'sub_bare', 'sub_explicit', 'sub_explicit']) variant,
             unnest([f."type", f."year", 'category: ' || f."type", 'year: ' || f."year"]) t) v
    where f.format not in ('bare', 'paren') and v.t is not null),
strings as (select distinct t from (select t from fterms union all select input_text from catalog)),
hraw as (select t, {_HASH_VEC.format(t='t')} v from strings),
hlen as (select t, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) n from hraw),
hvecs as (select t, list_transform(v, lambda x: (x / n)::float::double) vec from hlen),
fraw as (select concept_id, format, variant, pos, sum(coef * x)::double s from (
  select f.concept_id, f.format, f.variant, f.coef, generate_subscripts(h.vec, 1) pos, unnest(h.vec) x
  from fterms f join hvecs h on h.t = f.t) group by all),
fvecs as (select concept_id, format, variant, list(s order by pos) vec from fraw group by all)"""
)

# Who may be changed: works from the catalog, deletes whatever it holds. Views are made
# to name no work, and errors to give no rating.
_JUDGED = """select event_id, case when ch.rating is null then 'ok' when ch.rating = -2 then 'bad_rating'
  when ch.rating = -1 or c.work_key is null then 'unknown_work' else 'ok' end reason
from changes ch left join catalog c on c.work_key = ch.work_key"""

# Spherical k-means for two clusters per user, written out over more rounds than it takes to settle.
_ROUNDS = 8
_CLUSTER = """, points as (
  select "user", r.input_text, max(rating) rating, any_value(v.vec) vec
  from ratings r join vecs v on v.input_text = r.input_text where rating > 0 group by all),
unit as (
  select "user", input_text, rating, vec, count(*) over (partition by "user") n from (
    select p."user", p.input_text, p.rating,
           list_transform(p.vec, lambda x: x / sqrt(list_dot_product(p.vec, p.vec))) vec from points p)),
seed0 as (select "user", 0::bigint "cluster", vec from unit
  qualify row_number() over (partition by "user" order by rating desc, input_text) = 1),
seed1 as (select u."user", 1::bigint "cluster", u.vec from unit u join seed0 s on s."user" = u."user"
  where u.n >= 4
  qualify row_number() over (partition by u."user"
    order by round(list_dot_product(u.vec, s.vec), 12), u.input_text) = 1),
c0 as (select * from seed0 union all select * from seed1)"""


def _assign(at: int) -> str:
    return f""", a{at} as materialized (
  select u."user", u.input_text, u.vec, c."cluster", round(list_dot_product(u.vec, c.vec), 12) score,
         row_number() over (partition by u."user", u.input_text
           order by round(list_dot_product(u.vec, c.vec), 12) desc, c."cluster") place
  from unit u join c{at} c on c."user" = u."user")"""


def _move(at: int) -> str:
    return f""", e{at} as (
  select "user", "cluster", pos, sum(x) s from (
    select "user", "cluster", generate_subscripts(vec, 1) pos, unnest(vec) x from a{at} where place = 1)
  group by all),
l{at} as (select "user", "cluster", sqrt(sum(s * s)) len from e{at} group by all),
n{at} as (select e."user", e."cluster", list(s / len order by pos) vec
  from e{at} e join l{at} l on l."user" = e."user" and l."cluster" = e."cluster" group by all),
c{at + 1} as materialized (select c."user", c."cluster", coalesce(n.vec, c.vec) vec
  from c{at} c left join n{at} n on n."user" = c."user" and n."cluster" = c."cluster")"""


def _rounds(n: int) -> str:
    return _CLUSTER + "".join(_assign(i) + _move(i) for i in range(n))


_MEMBERS = _rounds(_ROUNDS) + _assign(_ROUNDS) + f""", members as (
  select x."user", x."cluster", x.input_text, x.score, y.score next_score
  from a{_ROUNDS} x left join a{_ROUNDS} y on y."user" = x."user" and y.input_text = x.input_text and y.place = 2
  where x.place = 1)"""


def _clustered(n: int, score: str = _SCORE.format(q="t"), more: str = "", ctes: str = "") -> str:
    scored = f"""
  select t."user", t."cluster", c.work_key, {score} score from c{_ROUNDS} t, corpus c
  where not exists (select 1 from ratings r where r."user" = t."user" and r.work_key = c.work_key) {more}"""
    return _rounds(_ROUNDS) + ctes, _top(scored, '"user", "cluster"', n, '"user", "cluster", work_key')


def _clustered_sql(n: int, **parts) -> str:
    ctes, body = _clustered(n, **parts)
    return _BASE + ctes + body


_DISLIKED = """, disliked as (
  select distinct r."user", v.input_text, v.vec from ratings r join vecs v on v.input_text = r.input_text
  where r.rating < 0)"""
_PUSH = _DISLIKED + f""", push as (
  select d."user", c.work_key, max({_SCORE.format(q='d')}) worst from disliked d, corpus c group by all)"""
_PENALTY = """list_cosine_similarity(c.vec, t.vec) - 0.5 * coalesce((select p.worst from push p
    where p."user" = t."user" and p.work_key = c.work_key), 0)"""
_FAR = f"""and not exists (select 1 from disliked d where d."user" = t."user"
    and round({_SCORE.format(q='d')}, 12) >= 0.25)"""


def _merged(order: str) -> str:
    ctes, body = _clustered(10)
    return _BASE + ctes + f""", recs as ({body}),
claimed as (select * exclude (rank), row_number() over (partition by "user", "cluster"
    order by score desc, work_key) turn from (
  select * from recs qualify row_number() over (partition by "user", work_key
    order by score desc, "cluster") = 1))
select "user", "cluster", work_key, score, rank from (
  select *, row_number() over (partition by "user" order by {order}) rank from claimed) where rank <= 8"""


def _quality(k: int) -> str:
    more = "".join(
        f""", seed{i} as (select "user", {i}::bigint "cluster", vec from (
  select u."user", u.vec, u.input_text, max(round(list_dot_product(u.vec, s.vec), 12)) near
  from unit u join ({' union all '.join(f'select * from seed{j}' for j in range(i))}) s
    on s."user" = u."user" where u.n >= {2 * (i + 1)} group by all)
  qualify row_number() over (partition by "user" order by near, input_text) = 1)"""
        for i in range(1, k)
    )
    start = _CLUSTER[: _CLUSTER.index("seed1 as")].rstrip().rstrip(",")
    seeds = " union all ".join(f"select * from seed{j}" for j in range(k))
    rounds = "".join(_assign(i) + _move(i) for i in range(_ROUNDS)) + _assign(_ROUNDS)
    return (
        start + more + f", c0 as ({seeds})" + rounds + f""", widths as (
  select "user", "cluster", input_text, coalesce((b - a) / nullif(greatest(a, b), 0), 0) w from (
    select "user", "cluster", input_text, avg(d) filter (other = "cluster") a,
           min(m) filter (other <> "cluster") b from (
      select *, avg(d) over (partition by "user", input_text, other) m from (
        select x."user", x."cluster", x.input_text, y."cluster" other,
               case when x.input_text <> y.input_text then 1 - list_dot_product(x.vec, y.vec) end d
        from a{_ROUNDS} x join a{_ROUNDS} y on y."user" = x."user" where x.place = 1 and y.place = 1))
    group by all))
select "user", {k}::bigint k, min(size) smallest, sum(w) / sum(size) silhouette from (
  select "user", "cluster", count(*) size, sum(w) w from widths group by all) group by "user" """
    )


def _chosen_k() -> str:
    trials = " union all ".join(f"(select * from ({_BASE + _quality(k)}))" for k in (2, 3))
    return f"""select "user", k, round(silhouette, 6) silhouette from ({trials})
qualify row_number() over (partition by "user" order by smallest < 2, -round(silhouette, 12), k) = 1"""


# Eight cells of the whole corpus: four rounds of spherical k-means from the works with the smallest keys.
_CELL_ROUNDS = 4


def _in_cells(at: int) -> str:
    return f""", p{at} as materialized (
  select u.work_key, u.vec, k.cell, round(list_dot_product(u.vec, k.vec), 12) score,
         row_number() over (partition by u.work_key order by round(list_dot_product(u.vec, k.vec), 12) desc, k.cell) place
  from kunit u, k{at} k)"""


def _next_cells(at: int) -> str:
    return f""", s{at} as (
  select cell, pos, sum(x) s from (
    select cell, generate_subscripts(vec, 1) pos, unnest(vec) x from p{at} where place = 1) group by all),
k{at + 1} as materialized (
  select k.cell, coalesce(n.vec, k.vec) vec from k{at} k left join (
    select cell, list(s / len order by pos) vec from (
      select *, sqrt(sum(s * s) over (partition by cell)) len from s{at}) group by cell) n on n.cell = k.cell)"""


_CELLS = """, kunit as (select work_key, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) vec from corpus),
k0 as (select row_number() over (order by work_key) - 1 cell, vec from kunit qualify row_number() over (order by work_key) <= 8)""" + "".join(
    _in_cells(i) + _next_cells(i) for i in range(_CELL_ROUNDS)
) + _in_cells(_CELL_ROUNDS)


def _probed(cells: int) -> str:
    return f""", near as (
  select q.work_key qid, c.work_key, c.score, row_number() over (partition by q.work_key order by c.score desc, c.work_key) rank
  from (select * from p{_CELL_ROUNDS} where work_key % 50 = 0 and place <= {cells}) q
  join (select work_key, cell from p{_CELL_ROUNDS} where place = 1) h on h.cell = q.cell
  join exact_scores c on c.qid = q.work_key and c.work_key = h.work_key)"""


_EXACT = """, exact_scores as (
  select q.work_key qid, c.work_key, round(list_cosine_similarity(c.vec, q.vec), 12) score
  from corpus q, corpus c where q.work_key % 50 = 0),
exact as (select * from exact_scores qualify row_number() over (partition by qid order by score desc, work_key) <= 10)"""

_COVARIANCE = """, flat as (select work_key, generate_subscripts(vec, 1) pos, unnest(vec) x from corpus),
cov as materialized (
  select list(line order by i) m, sum(diagonal) total from (
    select i, list(c order by j) line, sum(c) filter (i = j) diagonal from (
      select a.pos i, b.pos j, avg(a.x * b.x) - avg(a.x) * avg(b.x) c
      from flat a join flat b on b.work_key = a.work_key group by all) group by i)),
power as (
  with recursive step(n, v) as (
    select 0, list_transform(m, lambda r, i: 1 + i / 100.0::double) from cov
    union all
    select n + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) from (
      select n, list_transform(m, lambda r: list_dot_product(r, v)) w from step, cov where n < 1500))
  select v from step where n = 1500)"""

ORACLE: dict[str, str] = {
    "near_duplicates_banded": _BASE + f""", heads as (select min(work_key) work_key, vec from corpus group by vec)
select a.work_key key_a, c.work_key key_b, round({_SCORE.format(q='a')}, 6) score
from heads a join heads c on a.work_key < c.work_key
where round({_SCORE.format(q='a')}, 12) >= 0.5""",
    "cluster_corpus": _BASE + _CELLS + f"""
select work_key, cell, round(score, 6) score from p{_CELL_ROUNDS} where place = 1""",
    "knn_approx": _BASE + _CELLS + _EXACT + _probed(7) + """,
share as (select e.qid, round(count(n.qid) / count(*), 6) recall
  from exact e left join near n on n.qid = e.qid and n.work_key = e.work_key and n.rank <= 10 group by e.qid)
select n.qid, n.work_key, round(n.score, 6) score, n.rank, s.recall
from near n join share s on s.qid = n.qid where n.rank <= 10""",
    "knn_approx_exact": _BASE + _EXACT + """
select qid, work_key, round(score, 6) score, row_number() over (partition by qid order by score desc, work_key) rank from exact""",
    "reduce_dims": _BASE + _COVARIANCE + """,
middle as (select list(m order by pos) vec from (select pos, avg(x) m from flat group by pos)),
centred as (select work_key, list_transform(c.vec, lambda x, i: x - m.vec[i]) vec from corpus c, middle m)
select a.work_key, round(list_cosine_similarity(a.vec, b.vec), 6) cosine,
  round((select list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) from power, cov), 6) "first",
  round((select total from cov), 6) total
from centred a join centred b on b.work_key = a.work_key + 1""",
    "fit_projection": _BASE + """, xy as (select work_key, vec[1] a, vec[2] b, vec[3] y, vec[4] z from corpus),
g as (
  select avg(a) ma, avg(b) mb, avg(y) my, avg(z) mz, count(*) * var_pop(a) + 1 aa, count(*) * var_pop(b) + 1 bb,
    count(*) * covar_pop(a, b) ab, count(*) * covar_pop(a, y) ay, count(*) * covar_pop(b, y) by_,
    count(*) * covar_pop(a, z) az, count(*) * covar_pop(b, z) bz from xy where work_key % 5 <> 0),
w as (
  select *, (bb * ay - ab * by_) / det w00, (bb * az - ab * bz) / det w01,
    (aa * by_ - ab * ay) / det w10, (aa * bz - ab * az) / det w11 from (select *, aa * bb - ab * ab det from g)),
seen as (
  select y, z, (a - ma) * w00 + (b - mb) * w10 + my p, (a - ma) * w01 + (b - mb) * w11 + mz q, w00, w01, w10, w11
  from xy, w where work_key % 5 = 0)
select count(*) n, round(avg((y * p + z * q) / (sqrt(y * y + z * z) * sqrt(p * p + q * q))), 6) mean_cosine,
  round(any_value(w00), 6) w00, round(any_value(w01), 6) w01, round(any_value(w10), 6) w10, round(any_value(w11), 6) w11
from seen""",
    "kept_snapshot": _BASE + "select * from folded",
    "recommend_signed": _BASE + _signed(5),
    "recommend_signed_new_authors": _BASE + _signed(5, _NEW_AUTHORS),
    "recommend_signed_new_texts": _BASE + _signed(5, _NEW_TEXTS),
    "user_status": _BASE + f""", served as (select distinct "user" from ({_signed(1, _NEW_AUTHORS)}))
select u."user", case when t."user" is null then 'no_ratings'
    when sqrt(list_dot_product(t.vec, t.vec)) <= 1e-9 or s."user" is null then 'degenerate' else 'ok' end status
from (select distinct "user" from ratings) u left join tastes t on t."user" = u."user"
left join served s on s."user" = u."user" """,
    "recommend_mean": _BASE + _from_liked("avg", 5),
    "recommend_nearest": _BASE + _from_liked("max", 5),
    "recommend_nearest_min_near": _BASE
    + _from_liked("max", 5, f"having count(*) filter (round({_SCORE.format(q='l')}, 12) >= 0.2) >= 2"),
    "weighted_centroid": _BASE + 'select "user", pos::bigint - 1 pos, round(s, 6) "value" from sums',
    "similar_to": _BASE + _similar(""),
    "similar_to_other_authors": _BASE + _similar("and c.author <> b.author"),
    "similar_between": _BASE + f"""select a.title book_a, b.title book_b,
  round(list_cosine_similarity(a.vec, b.vec), 6) sim
from (select * from corpus where title ilike '%widget%' {_BEST}) a,
     (select * from corpus where title ilike '%gear%' {_BEST}) b""",
    "find": _BASE + """select input_text, work_key, author, title, "year", editions from corpus
where title ilike '%brand#1|%' or input_text ilike '%brand#1|%'""",
    "best_match": _BASE + f"""select * exclude (vec) from corpus
where title ilike '%red%' or input_text ilike '%red%' {_BEST}""",
    "search_catalog": _BASE + _SEARCH,
    "search_catalog_by_grams": _BASE + _SEARCH,
    "lookup": _BASE + f"select {_META}, input_text from catalog where work_key in (select work_key from changes)",
    "read_preferences": """select p_brand author, max(p_name) title from part group by p_brand
union select n_name, 'atlas' from nation""",
    "pref_matches": _BASE + _LINES + f""" select l.pref_author, l.pref_title,
  m.author matched_author, m.title matched_title
from lines l left join ({_matched('corpus')}) m on m.pref_author = l.pref_author and m.pref_title = l.pref_title""",
    "recommend_from_preferences": _BASE + _from_preferences("avg"),
    "recommend_from_preferences_nearest": _BASE + _from_preferences("max"),
    "recommend_from_preferences_new_authors": _BASE
    + _from_preferences("avg", more="and c.author not in (select author from hits)").replace(
        _LINES, """, lines as (
  select arg_min(p_brand, p_partkey) pref_author, arg_min(p_name, p_partkey) pref_title from part group by p_type)"""
    ),
    "find_vector": _BASE + _LINES + f""", wanted as (select m.pref_author author, m.pref_title title, m.input_text, v.vec
from ({_matched('catalog')}) m left join vecs v on v.input_text = m.input_text)
select author, title, input_text, pos - 1 pos, round(x, 6) "value" from (
  select author, title, input_text, generate_subscripts(vec, 1)::bigint pos, unnest(vec) x from wanted)
union all select author, title, input_text, null, null from wanted where vec is null""",
    "book_meta": _BASE + "select * from meta",
    "build_catalog": _BASE + f"""select {_META}, input_text, lower(author) author_lc, lower(title) title_lc
from catalog""",
    "build_corpus": _BASE + _long("corpus", "work_key, input_text"),
    "popularity_tiers": _BASE + """select t.n min_editions, count(*) filter (d.doc_id is not null and b.editions >= t.n) n_with_description
from (select unnest([2, 10, 25, 30, 35])::bigint n) t, books b left join documents d on d.doc_id = b.work_key
group by t.n""",
    "table_counts": _BASE + """select 'catalog' t, count(*) n from catalog
union all select 'corpus', count(*) from corpus union all select 'ratings', count(*) from ratings""",
    "read_dump": """select '/type/work' "type", count(*) n, count(distinct p_partkey) n_keys from part
union all select '/type/edition', count(*), count(distinct l_orderkey || '-' || l_linenumber) from lineitem
union all select '/type/author', (select count(*) from supplier) + (select count(*) from nation),
  (select count(distinct s_suppkey) from supplier) + (select count(distinct n_nationkey) from nation)
union all select '/type/redirect', count(*), count(distinct n_name) from nation""",
    "dump_quarantine": """select '/type/work' || chr(9) || r_name || case when r_regionkey > 2 then '' else
  chr(9) || '1' || chr(9) || '2024-01-01T00:00:00' || chr(9) || '{"title":' end line,
  case when r_regionkey > 2 then 'missing_columns' else 'bad_json' end reason from region""",
    "split_by_type": """select '/works/OL' || l_partkey || 'W' work_key, '/authors/OL' || l_suppkey || 'A' author_key,
  count(*) n, 'Edition ' || max(l_linenumber) title from lineitem group by l_partkey, l_suppkey
union all select '/works/OL' || p_partkey || 'W', null, 1, p_name from part
union all select null, '/authors/OL' || s_suppkey || 'A', 1, s_name from supplier
union all select null, '/authors/N' || n_nationkey, 1, n_name from nation""",
    "edition_facets": """select '/works/OL' || l_partkey || 'W' work_key, facet, "value", count(*) n from (
  select l_partkey, 'language' facet, '/languages/' || lower(l_returnflag) "value" from lineitem where l_returnflag <> 'N'
  union all select l_partkey, 'genre', l_linestatus from lineitem where l_quantity > 25
  union all select l_partkey, 'genre', '1.0' from lineitem where l_quantity > 25) group by all""",
    "popularity_join": _BASE + """select c.work_key, c.editions, count(r.rating) n_ratings,
  count(*) filter (r.rating > 0) n_liked, round(avg(r.rating), 6) mean_rating
from catalog c left join ratings r on r.work_key = c.work_key group by c.work_key, c.editions""",
    "query_vectors": _BASE + _long("labels", "label"),
    "near_duplicates": _BASE + f""", heads as (select min(work_key) work_key, vec from corpus group by vec)
select a.work_key key_a, c.work_key key_b, round({_SCORE.format(q='a')}, 6) score
from heads a join heads c on a.work_key < c.work_key
where round({_SCORE.format(q='a')}, 12) >= 0.4""",
    "vector_classes": _BASE + """select work_key, min(work_key) over (partition by vec) class_key from corpus""",
    "knn_past_corpus": _BASE + _top(
        f'select t."user" qid, c.work_key, {_SCORE.format(q="t")} score from tastes t, corpus c',
        "qid", 10, "qid, work_key"),
    "random_control": _BASE + """, digests as (
  select q qid, p pos, sha256('42|' || q || '|' || p) h from range(20) a(q), range(64) b(p)),
normal as (select qid, pos,
  sqrt(-2 * ln((('0x' || substr(h, 1, 8))::bigint + 0.5::double) / 4294967296))
  * cos(2 * pi() * ((('0x' || substr(h, 9, 8))::bigint + 0.5::double) / 4294967296)) x from digests),
drawn as (select qid, list(x order by pos) vec from normal group by qid)""" + _top(
        f"select l.qid, c.work_key, {_SCORE.format(q='l')} score from drawn l, corpus c", "qid", 10, "qid, work_key"),
    "edition_aggregates": _DUMP + """select '/works/OL' || l_partkey || 'W' work_key, edition_count, min_year,
  ed_fiction, isbn13, ed_desc from eds""",
    "select_works": _DUMP + "select work_key, edition_count from chosen",
    "select_works_whole_word": _DUMP + """select '/works/OL' || p_partkey || 'W' work_key, edition_count
from part join eds on l_partkey = p_partkey
where edition_count >= 2 and (p_size <= 10 or (p_size > 20 and p_size <= 25) or ed_fiction)""",
    "build_books": _DUMP + """select work_key, 'OL' || p_partkey || 'W' ol_id, p_name title,
  case when p_size > 40 then p_type end subtitle,
  coalesce(case when p_size <= 20 then 1950 + p_size end, min_year) first_publish_year, edition_count,
  coalesce(case when p_size <= 30 then d."text" end, ed_desc) description,
  case when p_size <= 10 then p_type || '|Fiction, general' when p_size <= 20 then 'Historical Nonfiction|7'
       when p_size <= 25 then null when p_size <= 45 then p_type end subjects,
  '/authors/OL' || low || 'A' primary_author_key, case when p_size > 5 then p_size end cover_id, isbn13
from chosen left join documents d on d.doc_id = p_partkey""",
    "build_book_authors": _DUMP + "select * from links",
    "build_authors": _DUMP + "select * from named",
    "write_curated": _DUMP + """select 'books' t, count(*) n from chosen
union all select 'book_authors', count(*) from links union all select 'authors', count(*) from named""",
    "extract_year": """select '/books/OL-' || l_orderkey || '-' || l_linenumber "key",
  (case when l_quantity > 5 then year(l_shipdate) end)::integer "year" from lineitem""",
    "json_field": _DUMP + """select '/works/OL' || p_partkey || 'W' "key", case when p_size > 5 then p_size end cover,
  case when low is not null then 'editor' end role, '/authors/OL' || high || 'A' author_key, null::varchar other
from part left join eds on l_partkey = p_partkey""",
    "json_string_array": """select 'OL' || p_partkey || 'W' ol_id,
  case when p_size <= 10 then p_type || '|Fiction, general' when p_size <= 20 then 'Historical Nonfiction|7'
       when p_size <= 25 then null when p_size <= 45 then p_type end subjects from part""",
    "unwrap_text": """select '/works/OL' || p_partkey || 'W' "key", case when p_size <= 30 then d."text" end told
from part left join documents d on d.doc_id = p_partkey""",
    "subject_match": """select '/works/OL' || p_partkey || 'W' "key", p_size <= 25 anywhere,
  p_size <= 10 or (p_size > 20 and p_size <= 25) whole_word from part""",
    "text_match": """select doc_id, coalesce(contains(lower("text"), 'the'), false)
  or coalesce(contains(lower(source), 'the'), false) "found" from documents""",
    "materialize": _BASE + 'select work_key, author, "year" from catalog',
    "exclude_authors": _BASE + _UNWANTED + """select r."user", r.work_key, c.author, r.rating
from ratings r join catalog c on c.work_key = r.work_key
where not exists (select 1 from unwanted x where x."user" = r."user" and x.author = c.author)""",
    "content_key": 'select doc_id, sha256("text") sha from documents',
    "embedding_inputs": _BASE + """select distinct input_text, sha256(input_text) input_sha256 from catalog c
join documents d on d.doc_id = c.work_key where c.editions >= 10 and c."year" < 2025""",
    "missing_vectors": _BASE + """select distinct input_text, sha256(input_text) input_sha256 from catalog
where input_text not in (select input_text from vecs)""",
    "embed_missing": _TEXT_UNITS + _long("(select *, 0::bigint again from units)", "input_sha256, again"),
    "cache_profile": """select 'model-' || label model_id, count(*) n, count(distinct vec_id) n_texts,
  64::bigint dim from embeddings group by label""",
    "validate_vectors": """select vec_id, case when label = 0 then 'missing' when label > 1 then 'dimension'
  else 'ok' end reason from embeddings""",
    "all_vectors": _BASE + """select sha256(input_text) sha, 64::bigint dim from vecs
union all select distinct sha256("text"), 1::bigint from documents""",
    "ensure_rated_vectors": _BASE + """select distinct input_text, sha256(input_text) input_sha256
from lineitem join catalog on work_key = l_partkey
where input_text not in (select input_text from corpus)""",
    "fold_ratings": _BASE + "select * from folded",
    "validate_ratings": _BASE + f"select * from ({_JUDGED})",
    "stream_ratings_rejected": _BASE + f"select * from ({_JUDGED}) where reason <> 'ok'",
    "derive_users": 'select user_id "user", min(ts) created_at from events group by user_id',
    "list_ratings": _BASE + """select r."user", r.work_key, c.author, c.title, c."year", r.rating, r.updated_at
from ratings r left join catalog c on c.work_key = r.work_key""",
    "overlay_ratings": _BASE + f"""select h."user", h.work_key, h.score, h.rank, r.rating from (
{_top(f'select t."user", c.work_key, {_SCORE.format(q="t")} score from tastes t, corpus c', '"user"', 10, '"user", work_key')}
) h left join ratings r on r."user" = h."user" and r.work_key = h.work_key""",
    "filter_backfill": _BASE + _UNWANTED + f"""select "user", work_key, author, score, rank
from ({_signed(20, _NOT_UNWANTED)})""",
    "author_facet": _BASE + _UNWANTED + f"""select "user", author from ({_signed(5, _NOT_UNWANTED)})
union select "user", author from unwanted""",
    "relative_score": _BASE + f"""select r.* exclude (raw), round(raw / max(raw) over (partition by "user"), 6) relative from (
{_signed(5).replace("round(score, 6) score", "round(score, 6) score, score raw", 1)}) r""",
    "flag_near_duplicates": _BASE + _similar("").replace(
        "round(score, 6) score", "round(score, 6) score, score >= 0.3 near_duplicate"
    ),
    "l2_normalize": _BASE
    + """, units as (select label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) vec from labels)"""
    + _long("units", "label"),
    "vector_functions": _BASE + """select e.vec_id, round(list_dot_product(e.embedding::double[], l.vec), 6) dot,
  round(list_cosine_similarity(e.embedding::double[], l.vec), 6) cosine,
  round(list_distance(e.embedding::double[], l.vec), 6) l2
from embeddings e join labels l on l.label = e.label::varchar""",
    "pairwise_cosine": _BASE + """select a.label label_a, b.label label_b,
  round(list_cosine_similarity(a.vec, b.vec), 6) cosine from labels a, labels b""",
    "vector_arithmetic": _BASE + _LABEL_TERMS + _long("units", "expr_id"),
    "vector_arithmetic_unnormalized": _BASE + _LABEL_TERMS + _long("exprs", "expr_id"),
    "analogy_rank": _BASE + _LABEL_TERMS + """select expr_id, label, expected, round(score, 6) score, rank from (
  select *, row_number() over (partition by expr_id order by round(score, 12) desc, label) rank from (
    select t.expr_id, t.label, min(t.coef) < 0 expected, any_value(list_cosine_similarity(u.vec, l.vec)) score
    from lterms t join labels l on l.label = t.label join units u on u.expr_id = t.expr_id
    group by t.expr_id, t.label))""",
    "knn_batch": _BASE + _label_knn(_SCORE.format(q="l"), where="c.editions >= 25"),
    "knn_grid": _BASE + _label_knn(_SCORE.format(q="l")),
    "knn_l2": _BASE + _label_knn("-list_distance(c.vec, l.vec)"),
    "knn_dot": _BASE + _label_knn("list_dot_product(c.vec, l.vec)"),
    "topk_overlap": _BASE + f""", tops as ({_label_knn(_SCORE.format(q='l'), 20)})
select a.qid list_a, b.qid list_b, count(*) overlap from tops a join tops b on a.work_key = b.work_key
group by a.qid, b.qid""",
    "render_formats": _BASE + _CONCEPTS + 'select concept_id, format, "text" from formats',
    "evaluate_formats": _BASE + _EVALUATED + """, found as (
  select c.concept_id, k.input_text from concepts c left join catalog k
    on k.title ilike '%' || c.expected_title || '%' and k.author ilike '%' || c.expected_author || '%'
  qualify row_number() over (partition by c.concept_id
    order by k.editions desc nulls last, k."year" asc nulls last, k.work_key) = 1)
select f.concept_id, f.format, f.variant, c.expected_title, round(list_cosine_similarity(f.vec, h.vec), 6) score
from fvecs f join concepts c on c.concept_id = f.concept_id join found g on g.concept_id = f.concept_id
left join hvecs h on h.t = g.input_text""",
    "evaluate_formats_neighbours": _BASE + _EVALUATED + _top(
        f"""select f.concept_id, f.format, f.variant, c.work_key, {_SCORE.format(q='f')} score
  from fvecs f, (select m.work_key, h.vec from meta m join hvecs h on h.t = m.input_text) c""",
        "concept_id, format, variant", 3, "concept_id, format, variant, work_key"),
    "cluster_preferences": _BASE + _MEMBERS + """select "user", "cluster", input_text, round(score, 6) score,
  round(next_score, 6) next_score from members""",
    "label_clusters": _BASE + _MEMBERS + """select "user", "cluster",
  string_agg(title, ', ' order by place) filter (place <= 2) label, count(*) size from (
  select x.*, m.title, row_number() over (partition by "user", "cluster" order by score desc, input_text) place
  from members x left join meta m using (input_text)) group by "user", "cluster" """,
    "choose_k": _chosen_k(),
    "recommend_clustered": _clustered_sql(5),
    "recommend_clustered_new_authors": _clustered_sql(5, more=_NEW_AUTHORS),
    "apply_dislikes_penalty": _clustered_sql(5, score=_PENALTY, ctes=_PUSH),
    "apply_dislikes_filter": _clustered_sql(5, more=_FAR, ctes=_DISLIKED),
    "merge_clusters": _merged('turn, "cluster"'),
    "merge_clusters_by_score": _merged("score desc, work_key"),
    "stream_ratings_snapshot": _BASE + "select * from folded",
    "stream_embed_texts": _TEXT_UNITS + _long("units", "input_sha256"),
}

# The table functions answer what the operators of these names do.
ORACLE |= {
    "sql_find_book": ORACLE["find"],
    "sql_similar_to": ORACLE["similar_to"],
    "sql_similar_to_other_authors": ORACLE["similar_to_other_authors"],
    "sql_similar_between": ORACLE["similar_between"],
    "sql_recommend": _BASE + """, liked as (select * from corpus where lower(title) like '%widget%')""" + _top(
        f"""select 0 one, c.* exclude (vec), avg({_SCORE.format(q='l')}) score from liked l, corpus c
  where c.work_key not in (select work_key from liked) group by all""", "one", 5, _META),
    "sql_recommend_from_preferences": ORACLE["recommend_from_preferences"],
    "sql_pref_matches": ORACLE["pref_matches"],
}
