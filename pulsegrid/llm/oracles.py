"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

# --- fixed values: ASCII white space, and the words of the decontamination contract ---
SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
with lines as (
  select d.doc_id, t.i, t.line, {FOLD.format(f"trim(t.line, {SPACE})")} as key
  from documents d, lateral (
    select unnest(string_split(coalesce(d.text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) as i
  ) t
), repeated as (
  select key, max(doc_id) as keeper from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), kept as (
  select l.*, r.key is not null and l.doc_id <> r.keeper as gone from lines l left join repeated r on l.key = r.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from kept group by doc_id
"""

# SHA-1 as 160 binary digits, five at a time, in the base32 alphabet
OP2 = """
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
firsts as (select hex, min(page_id) as first from p group by hex),
coded as (
  select hex, list_reduce(list_transform(range(1, 41), lambda i: list_extract(
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
    strpos('0123456789abcdef', substr(hex, i, 1)))), lambda a, b: a || b) as bits
  from firsts
)
select p.page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(1, 6), lambda j: case when substr(bits, 5 * i + j, 1) = '1' then 32 >> j else 0 end))::int, 1)), lambda a, b: a || b) as payload_digest,
  case when p.page_id = first then 'response' else 'revisit' end as record_type,
  case when p.page_id = first then null else first end as refers_to
from p join firsts using (hex) join coded using (hex)
"""

OP4 = f"""
with w as (
  select doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '{WORD}') as words from documents
), b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '{WORD}') as words from benchmark
), patterns as (
  select distinct item_id, least(len(words), 10) as m, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') as pattern
  from (select item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from b where len(words) > 0)
), places as (
  select doc_id, m, i, array_to_string(words[i : i + m - 1], ' ') as pattern
  from (select doc_id, words, m, unnest(range(1, len(words) - m + 2)) as i from w, (select distinct m from patterns) where len(words) >= m)
), found as (
  select doc_id, p.i, p.m, item_id from places p join patterns using (m, pattern)
), hits as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from found) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from found) group by doc_id
)
select w.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hits using (doc_id) left join items using (doc_id)
"""

OP6 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked as (
  select *, row_number() over w as i, coalesce(lag(role) over w <> role, true) as opens,
    replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>') as safe,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>'), ':', '\:') as safe_role
  from rows window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(safe) + 8 + case when opens then 6 + length(safe_role) else 0 end) as bigint) as formatted_chars
from marked group by conv_id
"""

OP7 = f"""
with recursive w as (
  select doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '{WORD}') as words from documents
), grams as (
  select distinct doc_id, array_to_string(words[i : i + 4], ' ') as g
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 0)
), sizes as (
  select doc_id, count(*) as n from grams group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c * 5 >= 4 * (x.n + y.n - c)
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), lowest as (
  select a, min(b) as b from reach group by a
), degrees as (
  select a, count(*) as n from links group by a
)
select w.doc_id, coalesce(least(l.b, w.doc_id), w.doc_id) as class_id, coalesce(n, 0) as n_links
from w left join lowest l on l.a = w.doc_id left join degrees d on d.a = w.doc_id
"""

OP11 = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as t from documents
), drawn as (
  select *, len(t) as n, list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(h, 8 * i + 1, 8))::bigint) as u from d
), cuts as (
  select *, least(u[1] % (n + 1), u[2] % (n + 1)) as a, greatest(u[1] % (n + 1), u[2] % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or u[3] % 100 >= 90 then 'plain'
      when u[4] % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
), parts as (
  select *, array_to_string(t[1 : a], '') as p, array_to_string(t[a + 1 : b], '') as m, array_to_string(t[b + 1 :], '') as s from cuts
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""

OP12 = f"""
with recursive w as (
  select doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as words from documents
), grams as (
  select distinct doc_id, array_to_string(words[i : i + 1], ' ') as g
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 1, 1) + 1)) as i from w where len(words) > 0)
), sizes as (
  select doc_id, count(*) as n from grams group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  where 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by 1, 2
), links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), lowest as (
  select a, min(b) as b from reach group by a
)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(least(l.b, w.doc_id), w.doc_id) as component_id, coalesce(l.b, w.doc_id) >= w.doc_id as kept
from w left join sizes using (doc_id) left join lowest l on l.a = w.doc_id
"""

# crc32 of a feature byte by byte, with the table of its 256 remainders made by the rule
OP13 = f"""
with crc as (
  select list(list_reduce([b] || range(8), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) order by b) as tab from range(256) t(b)
), texts as (
  select 'd' as kind, doc_id as id, {FOLD.format("coalesce(text, '')")} as text from documents union all select 'b', null, {FOLD.format("coalesce(text, '')")} from benchmark
), w as (
  select kind, id, regexp_extract_all(text, '{WORD}') as words from texts
), f as (
  select kind, id, array_to_string(words[i : i + k - 1], ' ') as g
  from (select kind, id, words, k, unnest(range(1, len(words) - k + 2)) as i from w, (select unnest([1, 2, 3]) as k) where len(words) >= k)
), counted as (
  select kind, id, g, count(*) as c from f group by all
), bytes as (
  select g, hex(encode(g)) as x from (select distinct g from counted)
), hashed as (
  select g, xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint),
    lambda r, v: xor(r // 256, tab[1 + xor(r % 256, v)])), 4294967295) % 10000 as bucket from bytes, crc
), per as (
  select kind, bucket, sum(c) as n from counted join hashed using (g) group by 1, 2
), s as (select bucket, n from per where kind = 'd'), t as (select bucket, n from per where kind = 'b'),
gains as (
  select b as bucket, cast(floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double)
    / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double))) as bigint) as gain
  from range(10000) r(b) left join s on s.bucket = b left join t on t.bucket = b
), sums as (
  select id as doc_id, sum(c) as n_features, sum(c * gain) as weight from counted join hashed using (g) join gains using (bucket) where kind = 'd' group by 1
), scored as (
  select w.id as doc_id, cast(coalesce(n_features, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight, len(words) >= 20 as fit,
    cast(coalesce(weight, 0) as bigint) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::bigint + 0.5::double) / 4294967296))) as bigint) as score
  from w left join sums on sums.doc_id = w.id where kind = 'd'
), placed as (
  select *, row_number() over (partition by fit order by score desc, doc_id) as r from scored
)
select doc_id, n_features, weight, score, case when fit and r <= 5 * (select count(*) from scored where fit) // 100 then r end as rank from placed
"""

RULES_BASE = f"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), windows as (
  select doc_id, i, array_to_string(w[i : i + 2], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
), twice as (
  select doc_id, i from windows where (doc_id, g) in (select doc_id, g from windows group by all having count(*) > 1)
), covered as (
  select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 3)) as k from twice) group by 1
), counted as (
  select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: trim(x, {SPACE}) <> '') as lines, coalesce(n, 0) as n_repeat_words
  from d left join covered using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
from counted
"""

# the table of OP13 over the digits of the id
QUALITY_ROWS = """
with crc as (
  select list(list_reduce([b] || range(8), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) order by b) as tab from range(256) t(b)
)
select doc_id, xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
  lambda r, v: xor(r // 256, tab[1 + xor(r % 256, v)])), 4294967295) % 5 = 0 as held_out, true as follows
from documents, crc
"""

SHARD_FACTS = """
with crc as (
  select list(list_reduce([b] || range(8), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) order by b) as tab from range(256) t(b)
), d as (
  select hex(encode(coalesce(text, ''))) as x from documents
), whole as (
  select cast(sum(length(x) // 2 + 1) as bigint) as sizes, count(*) as total, cast(sum(xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2),
    lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint), lambda r, v: xor(r // 256, tab[1 + xor(r % 256, v)])), 4294967295)) as bigint) as checksums from d, crc
)
select t as shard, total // 8 + (t < total % 8)::bigint as n, 0::bigint as first_slot, total // 8 + (t < total % 8)::bigint - 1 as last_slot, total // 8 + (t < total % 8)::bigint as n_slots,
  sizes, checksums, 0::bigint as grown, 'rows' as law
from whole, range(8) r(t)
"""

TOKEN_TOTALS = "select doc_id, true as equal from documents"


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op2_warc": OP2, "op4_decontaminate": OP4, "op6_chat": OP6, "op7_ngram_join": OP7,
            "op11_fill_middle": OP11, "op12_near_dedup": OP12, "op13_importance": OP13,
            "rules_base": RULES_BASE, "quality_rows": QUALITY_ROWS, "shard_facts": SHARD_FACTS, "token_totals": TOKEN_TOTALS}
