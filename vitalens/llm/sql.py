"""DuckDB SQL for the rows of op11 to op13, written from their contracts."""

from __future__ import annotations

#: CRC-32 by the table of all bytes; `crc` holds it as one list.
CRC_TABLE = """crc as materialized (
  select list(c order by i) as t
  from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from range(256) as bytes(i))
)"""


def crc_of(text: str) -> str:
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: cast('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2] as bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


OP11_SQL = r"""
with sized as materialized (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 12) as bigint) as k
  from documents
), sources as (
  select source, source_size, 3 * source_size as cap,
    cast([5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as hugeint) as weight
  from (select source, cast(sum(size) as hugeint) as source_size from sized group by source)
), levels as (
  -- By cap per weight, a source is clamped if its share of what is left behind the ones before it is above its cap.
  select *, sum(source_size) over () - coalesce(sum(cap) over before, 0) as behind, sum(weight) over () - coalesce(sum(weight) over before, 0) as weights
  from sources
  window before as (order by cast(cap as double) / cast(weight as double), source rows between unbounded preceding and 1 preceding)
), clamped as (
  select *, cap * weights < behind * weight as held from levels
), shares as (
  select *, sum(source_size) over () - coalesce(sum(cap) filter (held) over (), 0) as rest, coalesce(sum(weight) filter (not held) over (), 1) as others
  from clamped
), targets as (
  select source, source_size, case when held then cast(cap as double) else cast(rest * weight as double) / cast(others as double) end as target,
    case when held then cap else (2 * rest * weight + others) // (2 * others) end as words
  from shares
), filled as (
  select doc_id, size, t.source_size, target, case when t.source_size = 0 then 0 else words // t.source_size end as passes,
    case when t.source_size = 0 then 0 else words % t.source_size end as part,
    sum(size) over (partition by d.source order by k) as upto, sum(size) over (partition by d.source, k) as tie
  from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, cast(source_size as bigint) as source_size, target,
  cast(passes * size + case when upto <= part then size when upto - tie >= part then 0 else (part - (upto - tie)) * size // tie end as bigint) as taken
from filled
"""

OP12_SQL = (
    "with "
    + CRC_TABLE
    + r""", hashed as materialized (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w, """
    + crc_of("cast(doc_id as varchar)")
    + r""" as h
  from documents, crc
), planted as (
  select r, doc_id, len(w) as n, w, h % 10 = 0 and len(w) > 0 as p, h // 10 as g from hashed
), cycles as (
  select *, case when p then g % n end as a, case when p then 1 + (n - g % n) // (3 + g % 8) end as q from planted
), placed as materialized (
  select r, i, w[1 + case when p and i >= a then a + (i - a) % q else i end] as word
  from (select *, unnest(range(n)) as i from cycles)
), equal as (
  select x.r, x.i, y.i - x.i as q from placed x join placed y on x.r = y.r and x.word = y.word and y.i > x.i
), stretches as (
  select r, q, min(i) as start, count(*) + q as length
  from (select *, i - row_number() over (partition by r, q order by i) as island from equal)
  group by r, q, island having count(*) + q >= greatest(6, 4 * q)
), runs as materialized (
  -- A stretch that has a smaller period as well is as long by it.
  select r, start, length, min(q) as period from stretches group by r, start, length
), best as (
  select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
    list({'s': start, 'l': length, 'q': period} order by cast(length as double) / period desc, start, period)[1] as top
  from runs group by r
), dropped as (
  select distinct r, i from (select r, unnest(range(start + period, start + length)) as i from runs)
), collapsed as (
  select placed.r, string_agg(word, ' ' order by i) as text from placed anti join dropped using (r, i) group by placed.r
)
select doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(top.s as bigint) as start, cast(top.l as bigint) as length, cast(top.q as bigint) as period,
  cast(1000 * top.l // top.q as bigint) as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(text, '')) as collapsed_sha256
from planted left join best using (r) left join collapsed using (r)
"""
)

OP13_SQL = (
    "with "
    + CRC_TABLE
    + r""", worded as materialized (
  select kind, row_number() over () as r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from (select 'd' as kind, doc_id, text from documents union all select 'b', null, text from benchmark)
), held as materialized (
  select kind, r, word, count(*) as n from (select kind, r, unnest(w) as word from worded) group by all
), buckets as materialized (
  select word, """
    + crc_of("word")
    + r""" % 10000 as bucket from (select distinct word from held), crc
), counts as (
  select bucket, coalesce(sum(n) filter (kind = 'd'), 0) as s, coalesce(sum(n) filter (kind = 'b'), 0) as t
  from held join buckets using (word) group by bucket
), sums as (
  select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from counts
), gains as (
  select bucket, floor(1000 * ln((cast(t as double) + 1) * (cast(s_all as double) + 10000) / ((cast(s as double) + 1) * (cast(t_all as double) + 10000)))) as gain
  from counts, sums
), weights as (
  select r, sum(n * cast(gain as bigint)) as weight from held join buckets using (word) join gains using (bucket) where kind = 'd' group by r
), scored as (
  select doc_id, cast(len(w) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h
  from worded left join weights using (r) where kind = 'd'
), noisy as (
  select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from scored
), ranked as (
  select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) end as place from noisy
)
select doc_id, n_features, weight, score, cast(case when place <= 10 * (count(place) over ()) // 100 then place end as bigint) as rank
from ranked
"""
)

SQL = {"op11_source_mix": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_importance_resampling": OP13_SQL}
