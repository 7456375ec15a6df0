"""SQL of the corpus queries whose whole result SQL can express: op5, op6, op7, op8 and op10.

Each statement states the definition plainly and shares no method with its operator: all windows are
compared as strings, all pairs by their shingles. The others learn, tile, solve flows, run dynamic
programs or commit files; the README says how tests hold each of them.
"""

from __future__ import annotations

from .quality_rules import STOP_WORDS, SYMBOLS, THRESHOLDS
from .url_filter import Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

#: Windows of 100 bytes as hexadecimal strings, so that byte positions are character positions.
OP5 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
w as (select doc_id, unnest(range(n - 99)) as i, h from d where n >= 100),
s as (select doc_id, i, substr(h, 2 * i + 1, 200) as s from w),
m as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from s) where k > 1),
g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as new from m),
r as (select doc_id, run, min(i) as a, max(i) + 100 as b from (select *, sum(new) over (partition by doc_id order by i) as run from g) group by all),
p as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from r
  union all select d.doc_id, coalesce(x.b, 0), d.n from d left join (select doc_id, max(b) as b from r group by 1) x using (doc_id)
),
k as (select p.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as h from p join d using (doc_id) group by 1)
select d.doc_id, d.n as n_bytes, coalesce(x.removed, 0)::bigint as n_removed, coalesce(x.spans, 0)::bigint as n_spans, sha256(unhex(k.h)) as kept_sha256
from d join k using (doc_id) left join (select doc_id, sum(b - a) as removed, count(*) as spans from r group by 1) x using (doc_id)
"""

_PREFIX = r"^[ \t]*(?:>[ \t]*)+"


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


OP6 = rf"""
with recursive m as (select conv_id, turn, role, text from conversations),
own as (
  select *, case when contains(text, '>') then trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '{_PREFIX}')), chr(10)))
    else coalesce(text, '') end as body from m
),
ql as (
  select distinct conv_id, turn, text, pos, length(p) - length(replace(p, '>', '')) as level, substr(line, length(p) + 1) as body from (
    select *, regexp_extract(line, '{_PREFIX}', 0) as p from (
      select conv_id, turn, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
      from m where contains(text, '>') and conv_id is not null and turn is not null)) where p <> ''
),
runs as (select *, pos - row_number() over (partition by conv_id, turn, text, level order by pos) as run from ql),
q as (
  select conv_id, turn, level, first, whole, {_norm('body')} as body from (
    select conv_id, turn, level, min(pos) as first, true as whole, string_agg(body, ' ' order by pos) as body from runs group by conv_id, turn, text, level, run
    union all select conv_id, turn, level, pos, false, body from ql) where {_norm('body')} <> ''
),
o as (
  select distinct conv_id, turn, {_norm('unit')} as body from (
    select conv_id, turn, body as unit from own union all select conv_id, turn, unnest(string_split(body, chr(10))) from own) where {_norm('unit')} <> ''
),
links as (
  select q.conv_id, q.turn, q.level, q.first, q.whole, q.body, q.copy, max(o.turn) as linked
  from (select *, row_number() over () as copy from q) q join o on q.conv_id = o.conv_id and q.body = o.body and o.turn < q.turn group by all
),
parents as (select conv_id, turn, arg_min(linked, (level, not whole, first)) as parent, count(*) filter (where whole) as n_linked from links group by 1, 2),
up as (
  select conv_id, turn, parent as root, 1 as depth, lpad(parent::varchar, 10, '0') || '/' || lpad(turn::varchar, 10, '0') as path from parents
  union all select up.conv_id, up.turn, p.parent, up.depth + 1, lpad(p.parent::varchar, 10, '0') || '/' || up.path from up join parents p on p.conv_id = up.conv_id and p.turn = up.root
),
top as (
  select *, row_number() over (partition by conv_id, root order by path) as position
  from (select conv_id, turn, arg_max(root, depth) as root, max(depth) as depth, arg_max(path, depth) as path from up group by 1, 2)
)
select own.conv_id, own.turn, own.role, p.parent::bigint as parent_turn, coalesce(t.root, own.turn)::bigint as root_turn, coalesce(t.depth, 0)::bigint as depth,
  coalesce(t.position, 0)::bigint as position, coalesce(p.n_linked, 0)::bigint as n_linked, own.body
from own left join parents p on own.conv_id = p.conv_id and own.turn = p.turn left join top t on own.conv_id = t.conv_id and own.turn = t.turn
"""


def op7(rules: list[Rule], listed_hosts: tuple[str, ...], listed_tag: str) -> str:
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    hosts = ", ".join(f"('{h}')" for h in listed_hosts)
    return rf"""
with r(verdict, host, path) as (values {values}), bad(h) as (values {hosts}),
u as (select page_id, contains(coalesce(regexp_extract(url, '\?([^#]*)', 1), ''), '{listed_tag}') as tagged, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages),
p as (
  select page_id, tagged, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u
),
c as (select *, case when host <> '' then regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') end as url, row_number() over () as id from p),
l as (select distinct url from c where (tagged or exists (select 1 from bad where c.host = h or ends_with(c.host, '.' || h))) and url is not null),
f as (
  select id, arg_min(r.host || r.path, (-length(r.host || r.path), r.verdict)) as rule, arg_min(r.verdict, (-length(r.host || r.path), r.verdict)) as verdict
  from c join r on (c.host = r.host or ends_with(c.host, '.' || r.host)) and starts_with(c.path, r.path) group by 1
)
select c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, case when l.url is not null then 'block' else 'allow' end) as verdict, l.url is not null as listed
from c left join f using (id) left join l on c.url = l.url
"""


OP8 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * shared >= 85 * (p.n + q.n - shared)),
reach as (select x, y from e union select r.x, e.y from reach r join e on r.y = e.x),
l as (select x, min(y) as y from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) as component_id, d.doc_id <= coalesce(l.y, d.doc_id) as kept
from d left join n using (doc_id) left join l on l.x = d.doc_id
"""


def _bounds() -> str:
    each = [f"{t.measure} {op} {x}" for t in THRESHOLDS for op, x in ((">=", t.low), ("<=", t.high)) if x is not None]
    return " and ".join(each)


def _ratio(a: str, b: str) -> str:
    return f"case when {b} > 0 then {a} / {b} else 0 end"


def _count_of(chars: str) -> str:
    return f"(length(text) - length(translate(text, '{chars}', '')))"


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP10 = rf"""
with w as (select doc_id, row_number() over () as id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words from documents),
g as (select id, i, array_to_string(words[i:i + 7], ' ') as s from (select id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
r as (select id, i from (select id, i, count(*) over (partition by id, s) as k from g) where k > 1),
x as (select id, sum(least(coalesce(lead - i, 8), 8)) as n from (select *, lead(i) over (partition by id order by i) as lead from r) group by 1),
l as (select id, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) as lines from w),
m as (
  select doc_id, text, len(words) as n_words, length(array_to_string(words, ''))::bigint as word_chars, {_count_of(SYMBOLS)}::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(x.n, 0)::bigint as n_repeat_words, len(lines) as n_lines,
    len(list_filter(words, lambda y: rtrim(lower(y), '.,;:!?#*$%&') in ({_STOP}))) as n_stop, {_count_of(_UPPER)} as n_upper, {_count_of('!')} as n_bang
  from w join l using (id) left join x using (id)
),
t as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {_ratio('word_chars', 'n_words')} as mean_word_length, {_ratio('n_symbols', 'word_chars')} as symbol_ratio,
    {_ratio('n_stop', 'n_words')} as stop_word_ratio, {_ratio('n_dup_lines', 'n_lines')} as dup_line_ratio, {_ratio('n_upper', 'word_chars')} as upper_ratio, {_ratio('n_bang', 'n_words')} as bang_ratio
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_bounds()} as kept from t
"""
