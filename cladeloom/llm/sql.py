"""DuckDB SQL of the operators' queries."""

import math

from cladeloom.llm import collocations, hyperminhash, license_scan, mixing, secret_scan

ORACLES: dict[str, str] = {}

ORACLES["op10_exact_dedup"] = """
with d as (select doc_id, coalesce(text, '') t from documents)
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size,
       doc_id = max(doc_id) over w kept, sha256(t) text_sha256
from d window w as (partition by t)
"""

#: The table of CRC-32.
_CRC = """tab as (select list(c order by n) t from (
  select n, list_reduce(list_prepend(n::bigint, range(8)),
                        lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c
  from range(256) r(n)))"""

#: CRC-32 by its table, byte by byte; shards by the chain of jumps.
ORACLES["op5_jump_shards"] = f"""
with recursive
{_CRC},
d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
b as (select doc_id, length(x) // 2 n, list_prepend(4294967295::bigint,
        list_transform(regexp_extract_all(x, '..'), lambda h: ('0x' || h)::bigint)) bytes from d),
c as (select doc_id, n + 16 size,
        xor(list_reduce(bytes, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) text_crc32
      from b, tab),
jump(doc_id, k, b, j) as (
  select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 16))::uhugeint::hugeint, -1::bigint, 0::bigint from documents
  union all
  select doc_id, k2, j, floor((j + 1)::double * (2147483648.0 / ((k2 // 8589934592)::double + 1.0)))::bigint
  from (select doc_id, j, ((k::uhugeint * 2862933555777941757::uhugeint + 1) % 18446744073709551616::uhugeint)::hugeint k2
        from jump where j < 40)),
s as (select c.*, jump.b::int shard, (case when jump.j = 40 then 40 else jump.b end)::int grown_shard,
        ('0x' || substr(md5(concat_ws('/', doc_id::varchar, text_crc32::varchar)), 1, 8))::bigint h
      from c join jump using (doc_id) where jump.j >= 40)
select doc_id, size::bigint size, text_crc32::bigint text_crc32, 'key' law, shard,
       row_number() over (partition by shard order by h % 1024, h, doc_id) - 1 slot, grown_shard
from s
"""

_WEIGHTS = ", ".join(map(str, mixing.WEIGHTS))
#: Slots are counted per source; a source's stream is taken up to its last slot.
ORACLES["op3_source_mix"] = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
             md5(doc_id::varchar) h from documents),
s0 as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 i from d group by source),
s1 as (select *, [{_WEIGHTS}][i % {len(mixing.WEIGHTS)} + 1]::double w, ({mixing.PASSES} * source_size)::double cap,
         sum(source_size) over ()::double * {mixing.SHARE} total from s0),
s2 as (select *, (total - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) r
       from s1 window b as (order by cap / w, i rows between unbounded preceding and 1 preceding)),
s3 as (select *, least(cap, max(r) over () * w) target from s2),
s4 as (select *, coalesce(sum(target) over (order by i) / nullif(sum(target) over (), 0), 0) high from s3),
s5 as (select *, lag(high, 1, 0) over (order by i) low from s4),
n as (select total, greatest(1, least({mixing.MOST}, floor(total)::bigint // {mixing.SLOTS})) words from s1 limit 1),
k as (select words, unnest(range(ceil(total / words)::bigint)) slot from n),
u as (select words, ((slot * {mixing.GOLDEN}) % 4294967296)::double / 4294967296.0 u from k),
m as (select i, count(u.u) * coalesce(max(words), 0) upto from s5 left join u on low <= u.u and u.u < high group by i),
t as (select d.*, s5.i, source_size, target, upto,
        sum(size) over (partition by s5.i order by h, doc_id rows unbounded preceding) - size start
      from d join s5 on d.source is not distinct from s5.source join m on m.i = s5.i)
select doc_id, size::bigint size, source_size, target,
       (greatest(0, least(size, upto - start)) + greatest(0, least(size, upto - source_size - start)))::bigint taken
from t
"""

_TEMPLATES = ",\n".join(
    f"({n}, '{name}', {license_scan.step(t)}, [{', '.join(repr(s) for s in license_scan.shingles(t))}])"
    for n, (name, t) in enumerate(license_scan.TEMPLATES)
)
#: Every shingle that stands in a template, counted in each of the three windows that hold its place.
ORACLES["op6_license_scan"] = rf"""
with t(template, license, step, wanted) as (values {_TEMPLATES}),
ts as (select template, license, step, len(wanted) size, unnest(wanted) sh from t),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') w from documents),
p as (select doc_id, w, unnest(range(len(w) - 4)) i from d where len(w) >= 5),
s as (select doc_id, i, array_to_string(w[i + 1:i + 5], ' ') sh from p),
x as (select doc_id, template, license, size, sh, unnest(range(greatest(0, i // step - 2), i // step + 1)) k from s join ts using (sh)),
z as (select doc_id, template, license, k, count(distinct sh) / any_value(size) containment from x group by all)
select doc_id, license, max(containment) containment from z where containment >= {license_scan.CONTAINED} group by all
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(kind: int, pattern: str) -> str:
    p = _quoted(pattern)
    return f"""select doc_id, {kind} kind, unnest(range(len(h))) i, unnest(h) hit, unnest(g[1:len(h)]) gap
  from (select doc_id, regexp_extract_all(t, {p}, 0) h, string_split_regex(t, {p}) g from d) where len(h) > 0"""


def _class_test(c: secret_scan.CharClass) -> str:
    """A class's own candidates among all runs of its widest alphabet; backreferences are spelt out."""
    tests = [f"regexp_matches(hit, {_quoted(p)})" for p in c.needs]
    tests += [f"not regexp_matches(hit, {_quoted(p)})" for p in c.allow if "\\1" not in p]
    tests.append("not list_bool_or(list_transform(range(1, length(hit) - 4), lambda j: substr(hit, j, 6) = repeat(substr(hit, j, 1), 6)))")
    if c.name == "entropy_hex":
        tests.append("length(hit) >= 32 and regexp_matches(hit, '^[0-9A-Fa-f]+$')")
    return " and ".join(tests)


def _hot_windows(c: secret_scan.CharClass) -> str:
    w, unit = c.window, secret_scan.UNIT
    table = [round(n * math.log2(n) * unit) if n else 0 for n in range(w + 1)]
    most = math.floor(w * (math.log2(w) - c.bits) * unit)
    return f"""select doc_id, {secret_scan.KINDS.index(c.name)} kind, start, {w} w, unnest(range({w}, length(hit) + 1)) stop, hit, {table} f, {most} most
  from pos where kind = {len(secret_scan.BASE)} and {_class_test(c)}"""


_NAMES = ", ".join(f"'{k}'" for k in secret_scan.KINDS)
_RUN = r"[A-Za-z0-9+/_=-]{20,}"
ORACLES["op1_secret_scan"] = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
raw as ({_matches(0, secret_scan.ASSIGN)} union all {_matches(1, secret_scan.ACCESS)}
  union all {_matches(2, secret_scan.HEX)} union all {_matches(3, _RUN)}),
pos as (select doc_id, kind, hit, sum(length(gap) + length(hit)) over (partition by doc_id, kind order by i) - length(hit) start from raw),
base as (select doc_id, kind, start, start + length(hit) stop from pos where kind = 1 or kind = 2
  or kind = 0 and length(regexp_extract(hit, {_quoted(secret_scan.ASSIGN)}, 2)) >= {secret_scan.LEAST_VALUE}),
win as ({" union all ".join(map(_hot_windows, secret_scan.CLASSES))}),
hot as (select doc_id, kind, start, w, stop from win
  where list_sum(list_transform(list_distinct(string_split(substr(hit, stop - w + 1, w), '')),
    lambda c: f[w - length(replace(substr(hit, stop - w + 1, w), c, '')) + 1])) <= most),
islands as (select *, sum(new) over (partition by doc_id, kind, start order by stop) island from (
  select *, case when stop - lag(stop) over (partition by doc_id, kind, start order by stop) <= w then 0 else 1 end as new from hot)),
more as (select doc_id, kind, start + min(stop) - any_value(w) start, start + max(stop) stop from islands group by doc_id, kind, islands.start, island),
spans as (select doc_id, true base, kind, start, stop from base union all select doc_id, false, kind, start, stop from more),
told as (select *, [{_NAMES}][kind + 1] || ':' || start || ':' || stop told from spans)
select d.doc_id, count(*) filter (where base and kind = 0) n_assign, count(*) filter (where base and kind = 1) n_access,
       count(*) filter (where base and kind = 2) n_hex,
       sha256(coalesce(string_agg(told, ',' order by start, kind, stop) filter (where base), '')) base_sha256,
       coalesce(string_agg(told, ',' order by start, kind, stop), '') spans
from d left join told on told.doc_id = d.doc_id group by d.doc_id
"""

#: Every window of 50 words by its MD5, and the smallest document it starts in.
ORACLES["op8_substring_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
h as (select doc_id, len(w) n, unnest(list_transform(range(len(w) - 49), lambda i: md5(array_to_string(w[i + 1:i + 50], ' ')))) h,
        unnest(range(len(w) - 49)) i from d where len(w) >= 50),
m as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) first from h) where first < doc_id),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) p from m)),
word as (select doc_id, unnest(range(len(w))) p, unnest(w) word from d),
kept as (select word.doc_id, string_agg(word, ' ' order by word.p) t from word anti join gone on gone.doc_id = word.doc_id and gone.p = word.p group by 1),
lost as (select doc_id, count(*) n from gone group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(lost.n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept on kept.doc_id = d.doc_id left join lost on lost.doc_id = d.doc_id
"""

#: All pairs that share a shingle, by full sets; labels sink along the links until they rest.
ORACLES["op11_hyperminhash_groups"] = rf"""
with recursive
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, list_distinct(list_transform(range(greatest(1, len(w) - {hyperminhash.SHINGLE - 1})),
        lambda i: array_to_string(w[i + 1:i + {hyperminhash.SHINGLE}], ' '))) held from d where len(w) > 0),
n as (select d.doc_id, coalesce(len(held), 0)::bigint n from d left join s using (doc_id)),
e as (select doc_id, unnest(held) h from s),
pair as (select a.doc_id a, b.doc_id b, count(*) x from e a join e b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from pair join n na on na.doc_id = a join n nb on nb.doc_id = b
         where 100 * x >= {hyperminhash.PERCENT} * (na.n + nb.n - x)),
reach(doc_id, root) as (select doc_id, doc_id from n union select b, root from reach join link on link.a = reach.doc_id)
select n.doc_id, n n_shingles, min(root) component_id, n.doc_id = min(root) kept
from n join reach using (doc_id) group by n.doc_id, n
"""

def _best(i: int, reroled: int, kept: list[tuple[str, int]]) -> str:
    """The least (cost, audit) of a row in grammar state ``i``, before insertions."""
    rows = [f"struct_pack(c := 2 + c[{i}], a := 'D' || a[{i}])",
            f"case when s <> 'd' then struct_pack(c := 1 + t + c[{reroled}], a := 'R' || a[{reroled}]) end"]
    rows += [f"case when s = '{x}' then struct_pack(c := t + c[{k}], a := 'K' || a[{k}]) end" for x, k in kept]
    return f"list_min([{', '.join(rows)}])"


def _insert(x: str, y: str) -> str:
    return f"least({x}, struct_pack(c := 5 + {y}.c, a := 'I' || {y}.a))"


#: Row by row from the end: cost and audit for nothing yet, after system, user and assistant; then the edits in order.
ORACLES["op13_conversation_repair"] = rf"""
with recursive
{_CRC},
k as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
        hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) x from conversations),
c as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::bigint,
        list_transform(regexp_extract_all(x, '..'), lambda h: ('0x' || h)::bigint)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 20 x
      from k, tab),
m as (select conv_id, turn, case when x = 4 then 'user' else role end role,
        case x when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text,
        unnest(range(case when x = 3 then 2 else 1 end)) again from c where x <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), again) i,
        row_number() over (partition by conv_id, role, text order by turn nulls first, again) nth,
        lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, md5(text), again) before from m),
f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when nth > 1 then 'duplicate'
        when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end fault from o),
y as (select *, case when fault in ('blank', 'duplicate') then 'd' when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end s,
        case fault when 'truncated' then 5 else 0 end t from f),
n as (select conv_id, max(i) n, count(*) filter (where fault = 'blank') blank, count(*) filter (where fault = 'duplicate') duplicate,
        count(*) filter (where fault = 'truncated') truncated, count(*) filter (where before || left(role, 1) not in ('su', 'ua', 'au')) illegal,
        coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps from f group by 1),
v as (select conv_id, n + 1 i, [0, 10, 5, 0]::bigint[] c, ['', 'II', 'I', ''] a from n
  union all
  select conv_id, i, [w1.c, w2.c, w3.c, w4.c], [w1.a, w2.a, w3.a, w4.a] from (
    select conv_id, i, {_insert('z1', 'w3')} w1, {_insert('z2', 'w3')} w2, w3, w4 from (
      select conv_id, i, z1, z2, {_insert('z3', 'z4')} w3, {_insert('z4', 'z3')} w4 from (
        select y.conv_id, y.i, {_best(1, 3, [('s', 2), ('u', 3)])} z1, {_best(2, 3, [('u', 3)])} z2,
               {_best(3, 4, [('a', 4)])} z3, {_best(4, 3, [('u', 3)])} z4
        from v join y on y.conv_id is not distinct from v.conv_id and y.i = v.i - 1)))),
r as (select conv_id, c[1] cost, a[1] audit from v where i = 1),
w as (select conv_id, audit, 1 p, 0 i, 'n' state, null::varchar line from r
  union all
  select w.conv_id, audit, p + 1, case e when 'I' then w.i else w.i + 1 end, z, case e when 'D' then null else x || ':' || case e when 'I' then '' else text end end
  from (select w.*, substr(audit, p::int, 1) e, y.role, y.text,
          case when e = 'K' then y.role when w.state = 'u' then 'assistant' else 'user' end x,
          case when e = 'D' then w.state when e = 'K' then left(y.role, 1) when w.state = 'u' then 'a' else 'u' end z
        from w left join y on y.conv_id is not distinct from w.conv_id and y.i = w.i + 1 where p <= length(audit)) w),
h as (select conv_id, sha256(coalesce(string_agg(line, chr(10) order by p), '')) repaired_sha256 from w group by 1)
select d.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
       coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(cost, 0)::bigint cost,
       coalesce(audit, '') audit, coalesce(repaired_sha256, sha256('')) repaired_sha256
from (select distinct conv_id from conversations) d left join n using (conv_id) left join r using (conv_id) left join h using (conv_id)
"""

#: Every phrase of one to four words of every piece, counted as text.
ORACLES["op12_phrase_collocations"] = rf"""
with d as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from d),
n as (select lang, sum(len(w))::bigint n from w group by 1),
g as (select lang, m, unnest(list_transform(range(len(w) - m + 1), lambda i: array_to_string(w[i + 1:i + m], ' '))) phrase
      from w, range(1, {collocations.LONGEST + 1}) r(m) where len(w) >= m),
f as (select lang, m, phrase, count(*) f from g group by all having count(*) >= {collocations.LEAST}),
c as (select lang, m, phrase, f a, string_split(phrase, ' ') p from f where m > 1),
cuts as (select *, array_to_string(p[:k], ' ') x, array_to_string(p[k + 1:], ' ') y from (select *, unnest(range(1, m)) k from c)),
s as (select cuts.lang, cuts.phrase, a, k, x.f l, y.f r, (2000000::hugeint * a // (x.f + y.f))::bigint score
      from cuts join f x on x.lang = cuts.lang and x.phrase = cuts.x join f y on y.lang = cuts.lang and y.phrase = cuts.y),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, a, unnest(list_transform(range(m - t + 1), lambda j: array_to_string(p[j + 1:j + t], ' '))) phrase
      from c, range(2, {collocations.LONGEST}) r(t) where t < m),
o as (select lang, phrase, max(a) longer from i group by all),
k as (select b.* from b left join o using (lang, phrase) where longer is null or 100 * longer < {collocations.HELD} * a)
select * from (select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score
               from k join n on n.lang = k.lang) where rank <= {collocations.TOP}
"""
