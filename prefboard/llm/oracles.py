"""SQL for the queries that SQL can express on whole tables."""

from prefboard.llm import license_scan

# Alphabets of ASCII letters, of base 32, and the blanks of word rules.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SPACES = r"[\x20\x09-\x0D]+"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(column):
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_UPPER.lower()}')"


def _words(column, between):
    return f"list_filter(string_split_regex({_lowered(column)}, '{between}'), lambda x: x <> '')"


def _components(nodes, links):
    """CTEs `reach` and `component (id, component_id)`; links stand in both directions."""
    return f"""
reach(id, other) as (
  select id, id from {nodes}
  union
  select r.id, l.b from reach r join {links} l on r.other = l.a
),
component as (select id, min(other) as component_id from reach group by id)"""


WARC = f"""
with p as (
  select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as first from pages
),
d as (select *, cast(unhex(sha1(html)) as bit)::varchar as bits from p)
select page_id, strlen(html) as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1
    + 16 * cast(substr(bits, 5 * i + 1, 1) as int) + 8 * cast(substr(bits, 5 * i + 2, 1) as int)
    + 4 * cast(substr(bits, 5 * i + 3, 1) as int) + 2 * cast(substr(bits, 5 * i + 4, 1) as int)
    + cast(substr(bits, 5 * i + 5, 1) as int), 1)), 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from d"""

NEAR_DUPLICATES = f"""
with recursive w as materialized (select doc_id as id, {_words('text', _SPACES)} as w from documents),
s as materialized (
  select distinct id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [md5('few ' || array_to_string(w, ' '))]
    else list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) end) as h from w
),
n as materialized (select w.id, count(h) as n from w left join s using (id) group by w.id),
both_sides as materialized (select a.id as a, b.id as b, count(*) as k from s a join s b on a.h = b.h and a.id <> b.id group by 1, 2),
links as materialized (
  select a, b from both_sides join n x on x.id = a join n y on y.id = b where 100 * k >= 75 * (x.n + y.n - k)
),{_components('n', 'links')}
select id as doc_id, n as n_shingles, component_id, component_id = id as kept from n join component using (id)"""

NEAR_VECTORS = f"""
with recursive v as materialized (select vec_id as id, label, embedding::double[] as e from embeddings),
u as materialized (
  select * from v where label is not null and e is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: abs(x))) > 0
),
links as materialized (
  select x.id as a, y.id as b from u x join u y on x.label = y.label and x.id <> y.id
  where len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.93
),{_components('v', 'links')}
select id as vec_id, (select count(*) from links where a = id) as n_links, component_id, component_id = id as kept
from v join component using (id)"""

DECONTAMINATION = f"""
with b as materialized (select item_id, {_words('text', _NO_WORD)} as w from benchmark),
windows as materialized (
  select distinct item_id, least(len(w), 13) as size,
    unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) as t
  from b where len(w) > 0
),
d as materialized (select doc_id, {_words('text', _NO_WORD)} as w from documents),
sizes as (select distinct size from windows),
runs as (
  select doc_id, size, unnest(range(1, len(w) - size + 2)) as i,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as t
  from d, sizes where len(w) >= size
),
found as materialized (select doc_id, item_id, size, i from runs join windows using (size, t)),
hits as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + size)) as p from found) group by 1),
items as (
  select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, item_id::varchar as id from found) group by 1
)
select doc_id, len(w) as n_words, coalesce(h.n, 0) as n_hit, coalesce(i.n, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) as contaminated
from d left join hits h using (doc_id) left join items i using (doc_id)"""


def _license_sql():
    """Templates as literal rows; phrases by lines and the words behind them, notices by every window that begins with one of their words."""
    rows = []
    for number, t in enumerate(license_scan.PHRASES + license_scan.NOTICES):
        words = [w.decode() for w in license_scan.alnum_words(t.text.encode())]
        distinct = sorted(set(words))
        needed = license_scan._at_least(t.threshold, len(distinct))
        rows.append(f"({number}, '{t.label}', {t.exact}, {words}, {distinct}, {needed})")
    tail = license_scan._tail(license_scan.PHRASES + license_scan.NOTICES)
    return f"""
with t(number, label, exact, words, distinct_words, needed) as (values {', '.join(rows)}),
lines as (
  select doc_id, unnest(l) as line, unnest(range(0, len(l))) as number
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
),
split as (select doc_id, number, {_words('line', _NO_WORD)} as w from lines),
placed as materialized (
  select *, coalesce(sum(len(w)) over (partition by doc_id order by number rows between unbounded preceding and 1 preceding), 0) as first
  from split
),
d as materialized (select doc_id, {_words('text', _NO_WORD)} as w from documents),
blocks as materialized (
  select p.doc_id, p.first, p.w as line, d.w[p.first + 1:p.first + len(p.w) + {tail}] as longer
  from placed p join d using (doc_id) where len(p.w) > 0
),
tried as (
  select doc_id, first, label, words, len(line) as size, longer as part from blocks, t
  where exact and len(list_filter(distinct_words, lambda x: list_contains(longer, x))) >= needed
),
own_words as (select number, needed, len(distinct_words) as own, len(words) + (len(words) + 1) // 2 as reach,
  unnest(distinct_words) as word from t where not exact),
noticed as materialized (
  select doc_id, place, number, needed, own, reach, word
  from (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as place from d) join own_words using (word)
),
possible as (select doc_id, number from noticed group by doc_id, number having count(distinct word) >= any_value(needed)),
windows as (
  select doc_id, number, needed, own, count(distinct word) over (
    partition by doc_id, number order by place range between current row and reach - 1 following) as shared
  from noticed join possible using (doc_id, number)
),
places as (
  select doc_id, label, first + i - 1 as start, 1.0::double as containment, true as base
  from (select *, unnest(range(1, size + 1)) as i from tried) where part[i:i + len(words) - 1] = words
  union all
  select doc_id, label, null, max(shared / own), false
  from windows join t using (number) where shared >= windows.needed group by doc_id, number, label
),
found as (
  select doc_id, count_if(base) as n_base, min(start) as first_word, max(start) as last_word,
    string_agg(distinct case when base then label end, ',' order by case when base then label end) as base_labels,
    string_agg(distinct label, ',' order by label) as labels, max(containment) as score
  from places group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join found using (doc_id)"""


LICENSES = _license_sql()

# The fixed polynomial and start of CRC-32, bit by bit; letters beyond ASCII are two bytes here.
_CRC_BYTE = "list_reduce(list_prepend(xor(c, b), range(8)), lambda k, _: case when k & 1 = 1 then xor(k >> 1, 3988292384) else k >> 1 end)"
SPELLING = f"""
with recursive runs as materialized (
  select id, run, count(*) as n from (
    select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all({_lowered('text')}, '[A-Za-zÀ-ÿ]+')) as run from documents
  ) group by id, run
),
byte as (
  select id, run, n, list_transform(string_split(id || ':', ''), lambda c: unicode(c)::bigint) || flatten(list_transform(
    string_split(run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195, unicode(c)::bigint - 64] end)) as bytes
  from runs
),
hashed as materialized (
  select run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: {_CRC_BYTE}), 4294967295) as h from byte
),
counted as (
  select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n
  from hashed
),
words as materialized (
  select word, sum(n)::bigint as n from counted group by word having sum(n) >= 5 and length(word) >= 6
),
cut as materialized (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
),
near as materialized (
  select a.word as u, b.word as v, b.n as v_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union
  select a.word, b.word, b.n from cut a join words b on a.rest = b.word
  union
  select b.word, a.word, a.n from cut a join words b on a.rest = b.word
),
best as (
  select u, count(*) as n_near, first(v order by v_n desc, v) as v, max(v_n) as v_n from near group by u
),
told as materialized (
  select word, n, coalesce(n_near, 0) as n_near, case when v_n >= 5 * n then v end as form, case when v_n >= 5 * n then v_n end as form_n
  from words left join best on u = word
),
chain(word, root, step) as (
  select word, word, 0 from told
  union all
  select c.word, t.form, step + 1 from chain c join told t on t.word = c.root where t.form is not null
),
ends as (select word, arg_max(root, step) as root from chain group by word)
select word, form, root, n, n_near, form_n from told join ends using (word)"""


COLLOCATIONS = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex({_lowered('text')}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents
),
split as materialized (
  select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') as w from pieces
),
totals as (select lang, sum(len(w))::bigint as n from split group by lang),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as p
  from split, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k
),
f as materialized (select lang, k, p, count(*) as f from grams group by all having count(*) >= 30),
cuts as (select lang, k, p, f as a, unnest(range(1, k)) as c from f where k >= 2),
scored as (
  select x.*, y.f as l, z.f as r, (2000000::hugeint * a) // (y.f + z.f) as score
  from cuts x join f y on y.lang = x.lang and y.p = x.p[:c] join f z on z.lang = x.lang and z.p = x.p[c + 1:]
),
worst as (
  select lang, k, p, a, arg_min(l, (score, c)) as l, arg_min(r, (score, c)) as r, min(score) as score from scored group by lang, k, p, a
),
inner_parts as (
  select lang, f, unnest([p[x[1]:x[1] + x[2] - 1] for x in [[1, 2], [2, 2], [3, 2], [1, 3], [2, 3]] if x[1] + x[2] - 1 <= k and x[2] < k]) as p
  from f where k >= 3
),
held as (select lang, p, max(f) as f from inner_parts group by lang, p),
kept as (
  select w.*, array_to_string(w.p, ' ') as phrase from worst w left join held h on h.lang = w.lang and h.p = w.p
  where h.f is null or 100::hugeint * h.f < 80::hugeint * a
),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000"""
