"""DuckDB statements of the queries that SQL can express, over the given tables."""

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

MIXING = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
         ((((coalesce(doc_id, 0) % 2147483648) + 2147483648) % 2147483648) * 2654435761
           + ('0x' || substr(md5(coalesce(text, '')), 1, 8))::bigint) % 4294967296 as h
  from documents),
per as (
  select source, sum(size)::bigint as source_size,
         [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w,
         (row_number() over (order by source nulls last) - 1) % 3 as kind
  from sized group by source),
levels as (select *, 3.0::double * source_size as cap, 3.0::double * source_size / w as lvl from per),
capped as (
  select a.*, a.lvl <= 0 or (select sum(least(b.cap, a.lvl * b.w)) from levels b) <= (select sum(source_size) from levels) as is_capped
  from levels a),
goals as (
  select source, source_size, kind,
         case when is_capped then cap
              else w * ((select sum(source_size) from capped) - coalesce((select sum(cap) from capped where is_capped), 0))
                   / (select sum(w) from capped where not is_capped) end as target
  from capped),
placed as (
  select s.doc_id, s.size, g.source_size, g.target, g.kind, round(g.target)::bigint as goal,
         (sum(s.size) over (partition by s.source order by s.h, s.doc_id nulls first, s.size rows unbounded preceding) - s.size)::bigint as first
  from sized s join goals g on s.source is not distinct from g.source),
shares as (
  select *, case when size > 0 and first < goal then first::double / goal end as share from placed)
select doc_id, size, source_size, target,
  (case when size = 0 then 0 else greatest(0, least(size, goal - first)) + greatest(0, least(size, goal - first - source_size))
    + greatest(0, least(size, goal - first - 2 * source_size)) end)::bigint as taken,
  round(case kind
    when 0 then 2.0 * share / (1.5 + sqrt(greatest(2.25 - 2.0 * share, 0.0)))
    when 1 then case when share <= 0.5 then 2.0 * share / (0.75 + sqrt(0.5625 + 2.0 * share))
                     else 0.5 + 2.0 * (share - 0.5) / (1.25 + sqrt(greatest(1.5625 - 2.0 * (share - 0.5), 0.0))) end
    else 2.0 * share / (0.5 + sqrt(0.25 + 2.0 * share)) end, 6) as position
from shares
"""

LINE_DEDUP = """
with docs as (select row_number() over () as r, doc_id, text from documents),
lines as (
  select r, doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i
  from docs where text is not null),
hashed as (
  select *, (coalesce(doc_id, -9223372036854775808), text, i) as place, ('0x' || substr(md5(line), 1, 8))::bigint as h,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words
  from lines),
followed as (
  select *, lead(line) over w as next_line, (h * 31 + lead(h) over w) % 4294967296 % 2 = 0 as opens, lead(words) over w as next_words
  from hashed window w as (partition by r order by i)),
pairs as (select *, line || chr(10) || next_line as body from followed where next_line is not null),
firsts as (select body, min(place) as kept from pairs group by body),
again as (
  select p.*, p.i - row_number() over (partition by p.r order by p.i) as run
  from pairs p join firsts f on p.body = f.body where p.place <> f.kept),
runs as (
  select r, min(i) as first, max(i) + 1 as last from again group by r, run
  having sum(least(words, 1)) + least(arg_max(next_words, i), 1) >= 2 and (bool_or(opens) or sum(words) + arg_max(next_words, i) > 50)),
long_lines as (select r, i, place, min(place) over (partition by line) as kept from hashed where words > 50),
gone as (
  select h.r, h.i from hashed h join runs g on h.r = g.r and h.i between g.first and g.last
  union select r, i from long_lines where place <> kept),
rest as (
  select n.r, string_agg(n.line, chr(10) order by n.i) filter (where g.r is null) as text, count(*) as n_lines, count(g.r) as n_removed_lines
  from hashed n left join gone g on n.r = g.r and n.i = g.i group by n.r)
select d.doc_id, coalesce(s.n_lines, 0)::bigint as n_lines, coalesce(s.n_removed_lines, 0)::bigint as n_removed_lines,
  case when d.text is null then null else coalesce(s.text, '') end as text
from docs d left join rest s using (r)
"""

QUALITY = f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
split as (
  select r, doc_id, text, regexp_extract_all(text, '{WORD}') as w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from docs),
windows as (
  select r, unnest(range(1, len(w) - 1)) as i, w from split where len(w) >= 3),
grams as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from windows),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1),
covered as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from twice) group by r),
measured as (
  select s.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
         len(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ]'))::bigint as n_capitals
  from split s left join covered c using (r)),
judged as (
  select *, ((n_words < 50)::bigint | ((100 * n_repeat_words > 50 * n_words)::bigint << 1) | ((10 * n_symbols > 2 * n_words)::bigint << 2)
    | ((100 * n_dup_lines > 50 * n_lines)::bigint << 3) | ((100 * n_capitals > 30 * word_chars)::bigint << 4)
    | ((word_chars < 2 * n_words)::bigint << 5) | ((word_chars > 20 * n_words)::bigint << 6)) as failed
  from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed
from judged
"""

EXACT_DEDUP = f"""
with bodies as (select doc_id, regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
  row_number() over (partition by body order by doc_id nulls last) = 1 as kept, sha256(body) as text_sha256
from bodies
"""
