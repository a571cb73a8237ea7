"""SQL counterparts of the registered queries that SQL can express."""

_WORDS = r"[^\x20\x09-\x0D]+"
_TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
with w as (select doc_id, regexp_extract_all({_LOWERED}, '{_TERMS}') ws from documents),
b as (select item_id, regexp_extract_all({_LOWERED}, '{_TERMS}') ws from benchmark),
bi as (select item_id, ws, least(10, len(ws)) n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) i from b where len(ws) > 0),
win as (select distinct item_id, n, array_to_string(ws[i:i+n-1], ' ') k from bi),
lens as (select distinct n from win),
di as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from w join lens on len(ws) >= n),
dk as (select doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') k from di),
m as (select doc_id, dk.n, i, item_id from dk join win on dk.n=win.n and dk.k=win.k),
h as (select doc_id, count(*) n_hit from (
  select distinct doc_id, p from (select doc_id, unnest(range(i, i+n)) p from m) q) r group by 1),
it as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) l from (
  select distinct doc_id, cast(item_id as varchar) item from m) q group by 1)
select w.doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join h on h.doc_id=w.doc_id left join it on it.doc_id=w.doc_id"""

WARC = """
with p as (select page_id, coalesce(html, '') payload, sha1(coalesce(html, '')) h from pages),
last as (select payload, max(page_id) m from p group by 1)
select page_id, cast(strlen(p.payload) as bigint) payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((
    cast(concat('0x', substr(h, cast(5*(q//4)+1 as int), 5)) as int) >> cast(15-5*(q%4) as int)) & 31) as int), 1)), '') payload_digest,
  case when page_id = m then 'response' else 'revisit' end record_type,
  case when page_id <> m then m end refers_to
from p join last on last.payload=p.payload"""

SUBSTRINGS = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') ws from documents),
s as (select doc_id, ws, unnest(range(1, len(ws)-11)) i from w where len(ws) >= 13),
k as (select doc_id, i, array_to_string(ws[i:i+12], ' ') k from s),
m as (select k, min(doc_id) d from k group by 1),
c as (select distinct doc_id, p from (
  select doc_id, unnest(range(i, i+13)) p from k join m using (k) where d < doc_id) q),
u as (select doc_id, unnest(ws) word, unnest(range(1, len(ws)+1)) p from w where len(ws) > 0),
kept as (select u.doc_id, count(c.p) n_removed, string_agg(case when c.p is null then word end, ' ' order by u.p) t
  from u left join c on c.doc_id=u.doc_id and c.p=u.p group by 1)
select w.doc_id, cast(len(ws) as bigint) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
from w left join kept on kept.doc_id=w.doc_id"""

_CONTROL = r"[<\[]\\*/?(?:s>|INST\])"
_ESCAPED = r"[<\[]\\+/?(?:s>|INST\])"
CHAT = f"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, case when regexp_matches(concat(r, ' ', t), '<s>|</s>|\\[INST\\]|\\[/INST\\]|{_ESCAPED}')
  then len(regexp_extract_all(r, '{_CONTROL}')) + len(regexp_extract_all(t, '{_CONTROL}')) else 0 end added from c)
select conv_id, count(*) n_turns, sha256(string_agg(concat(r, chr(10), t, chr(10)), '' order by turn, r, t)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
  cast(sum(length(r) + length(t) + added + length('<s>[INST][/INST]</s>')) as bigint) formatted_chars
from e group by 1"""

JACCARD = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWERED}, '{_WORDS}') ws from documents),
sh as (select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ')
    else array_to_string(ws[i:i+4], ' ') end k
  from (select doc_id, ws, unnest(range(1, greatest(len(ws)-4, 1)+1)) i from w where len(ws) > 0) q),
n as (select doc_id, count(*) n from sh group by 1),
c as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.k=b.k and a.doc_id<b.doc_id group by 1, 2),
l as (select a, b, c = x.n and c = y.n same from c join n x on x.doc_id=a join n y on y.doc_id=b
  where 100*c >= 75*(x.n+y.n-c)),
both_ as (select a, b, same from l union all select b, a, same from l),
cls as (select doc_id, least(doc_id, coalesce((select min(b) from both_ where a=doc_id and same), doc_id)) class_id from w),
reach as (select doc_id a, doc_id b from w union select reach.a, both_.b from reach join both_ on both_.a=reach.b),
comp as (select a, min(b) component_id from reach group by 1),
lk as (select a, count(distinct class_id) n_links from both_ join cls on cls.doc_id=b where not same group by 1)
select w.doc_id, coalesce(n.n, 0) n_shingles, component_id, class_id, coalesce(n_links, 0) n_links
from w join cls on cls.doc_id=w.doc_id join comp on comp.a=w.doc_id left join n on n.doc_id=w.doc_id
left join lk on lk.a=w.doc_id"""

DIVERGENCE = f"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all({_LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') ws from documents),
t as (select r, lang, source, unnest(ws) term from d),
c as (select lang, source, term, count(*) c, count(distinct r) d from t group by 1, 2, 3),
kept as (select lang, term, sum(c) c from c group by 1, 2 having sum(d) >= 30),
l as (select lang, count(*) v, sum(c) n from kept group by 1),
g as (select distinct lang, source from d),
n as (select lang, source, sum(c.c) n from c join kept using (lang, term) group by 1, 2),
p as (select g.lang, g.source, kept.term, coalesce(c.c, 0) c, kept.c lang_c, l.n lang_n, l.v,
    cast(1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * l.v) as bigint) p,
    cast(1 + (1000000000::hugeint * (kept.c + 5)) // (l.n + 5 * l.v) as bigint) q
  from g join kept on kept.lang = g.lang join l on l.lang = g.lang
  left join n on n.lang = g.lang and n.source = g.source
  left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
far as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b
  on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pair as (select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(f, 0) as bigint) "value"
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
term as (select lang, source, 'term' part, term item, p - q "value" from p where c > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by "value" desc, item) as int) rank
  from (select * from pair union all select * from term) u)
select * from ranked where part = 'pair' or rank <= 50"""
