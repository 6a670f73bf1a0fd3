"""The queries of the catalogue in SQL."""

from __future__ import annotations

from ..functions.tables import CHROMA, LUMA, permutation, quant_table, scale_of
from ..sources.rasters import HEIGHT, WIDTH


def _values(rows: list[tuple], name: str, columns: str) -> str:
    return f"{name} as (select * from (values {', '.join(str(r) for r in rows)}) as {name}_({columns}))"


BASIS = "ct as (select k, n, cos(pi() * (2 * n + 1) * k / 16.0) / 2 * case when k = 0 then 1 / sqrt(2.0) else 1.0 end as w from range(8) a(k), range(8) b(n))"
QUANT = _values([(int(not luma), p, q) for luma in (True, False) for p, q in enumerate(quant_table(50, luma))], "qm", "chroma, pos, q")
ORDER = _values(list(enumerate(permutation())), "zz", "i, pos")
EMBED = "px as (select vec_id::int as frame_idx, 0 as channel, 0 as block_id, unnest(range(64))::int as pos, unnest([least(255, greatest(0, round(e::double * 255) + 128)) for e in embedding])::double as v from embeddings)"
RGB = f"""seen as (select (l_linenumber - 1)::int as frame_idx, (l_orderkey % {HEIGHT})::int as y, (l_partkey % {WIDTH})::int as x,
  max(least(255, greatest(0, trunc(l_quantity * 5)::int))) as r, max(least(255, greatest(0, round(l_discount * 2000)::int))) as g, max(least(255, greatest(0, round(l_tax * 2000)::int))) as b
  from lineitem group by all),
rgb as (select f.frame_idx, y.y::int as y, x.x::int as x, coalesce(s.r, 0) as r, coalesce(s.g, 0) as g, coalesce(s.b, 0) as b
  from (select distinct frame_idx from seen) f cross join range({HEIGHT}) y(y) cross join range({WIDTH}) x(x) left join seen s on s.frame_idx = f.frame_idx and s.y = y.y and s.x = x.x)"""
YCC = f"""{RGB},
ycc as (select frame_idx, y, x, 0.299::double * r + 0.587::double * g + 0.114::double * b as luma,
  -0.168736::double * r - 0.331264::double * g + 0.5::double * b + 128 as cb, 0.5::double * r - 0.418688::double * g - 0.081312::double * b + 128 as cr from rgb)"""
PLANES = f"""{YCC},
planes as (select frame_idx, 0 as channel, y, x, luma as v from ycc union all
  select frame_idx, 1, y // 2, x // 2, cb from ycc where x % 2 = 0 and y % 2 = 0 union all
  select frame_idx, 2, y // 2, x // 2, cr from ycc where x % 2 = 0 and y % 2 = 0)"""
TILES = f"""{PLANES},
sizes as (select * from (values (0, 48, 40), (1, 24, 24), (2, 24, 24)) as t(channel, pw, ph)),
px as (select f.frame_idx, s.channel, ((y.y // 8) * (s.pw // 8) + x.x // 8)::int as block_id, ((y.y % 8) * 8 + x.x % 8)::int as pos, coalesce(p.v, 0.0)::double as v
  from (select distinct frame_idx from planes) f cross join sizes s cross join range(48) y(y) cross join range(48) x(x)
  left join planes p on p.frame_idx = f.frame_idx and p.channel = s.channel and p.y = y.y and p.x = x.x where y.y < s.ph and x.x < s.pw)"""


def _dct(source: str = "px", out: str = "co", shift: str = " - 128") -> str:
    return f"""{BASIS},
half as (select frame_idx, channel, block_id, pos // 8 as y, k as u, sum((v{shift}) * w) as s from {source} join ct on n = pos % 8 group by all),
{out} as (select frame_idx, channel, block_id, (ct.k * 8 + half.u)::int as pos, sum(s * w) as c from half join ct on ct.n = half.y group by frame_idx, channel, block_id, ct.k, half.u)"""


def _idct(source: str, out: str, shift: str = "") -> str:
    return f"""ihalf as (select frame_idx, channel, block_id, pos // 8 as u, n as x, sum(c * w) as s from {source} join ct on k = pos % 8 group by all),
{out} as (select frame_idx, channel, block_id, (ct.n * 8 + ihalf.x)::int as pos, sum(s * w){shift} as v from ihalf join ct on ct.k = ihalf.u group by frame_idx, channel, block_id, ct.n, ihalf.x)"""


def _n(pixels: str) -> str:
    return f"""{pixels}, {_dct()}, {QUANT},
nq as (select frame_idx, channel, block_id, co.pos, round(round(round(c, 6) / q, 9))::int as n, q from co join qm on qm.pos = co.pos and qm.chroma = (channel > 0)::int)"""


def _d(pixels: str) -> str:
    return f"{_n(pixels)}, res as (select frame_idx, channel, block_id, pos, n, n - coalesce(lag(n) over (partition by channel, block_id, pos order by frame_idx), 0) as d from nq)"


def _tokens(pixels: str) -> str:
    return f"""{_d(pixels)}, {ORDER},
sc as (select frame_idx, channel, (block_id::bigint * 64 + i) as seq, d as coef from res join zz using (pos)),
isl as (select *, seq - row_number() over (partition by frame_idx, channel, coef = 0 order by seq) as g from sc),
part as (select *, case when coef = 0 then (seq - min(seq) over (partition by frame_idx, channel, coef = 0, g)) // 32767 else seq end as p from isl),
runs as (select frame_idx, channel, min(seq) as seq, any_value(coef) as value, count(*) as n from part group by frame_idx, channel, coef = 0, g, p),
tok as (select frame_idx, channel, row_number() over (partition by frame_idx, channel order by seq) - 1 as tok, value, case when value = 0 then n::int end as run from runs)"""


_BLOCK = "frame_idx, channel, block_id, pos"
_HEX = "hexes as (select doc_id, hex(encode(text)) as h from documents where text is not null), bytes as (select doc_id, ('0x' || unnest(regexp_extract_all(h, '..')))::int as byte from hexes)"
_SCALED = "hist as (select byte, count(*) as n from bytes group by byte), sc as (select byte, n, case when max(n) over () <= 65535 then n else greatest(1, floor(n * (65535.0::double / max(n) over ()))) end::int as freq from hist)"
_PROFILE = "p as (select event_type as fn, value as duration, coalesce(try_cast(props->>'$.k' as double), 0) as k from events where event_type is not null and event_type not in ('', 'Function Name'))"
_TIMES = "t as (select o_orderpriority as backend, avg(o_totalprice) as avg_s, min(o_totalprice) as min_s, count(*) as runs from orders where o_totalprice is not null group by 1)"

ORACLES = {
    "rgb_to_ycbcr": f"with {YCC} select frame_idx, y, x, round(luma, 6) as luma, round(cb, 6) as cb, round(cr, 6) as cr from ycc",
    "chroma_subsample": f"with {YCC} select frame_idx, (y // 2)::int as y, (x // 2)::int as x, round(cb, 6) as cb, round(cr, 6) as cr from ycc where x % 2 = 0 and y % 2 = 0",
    "ycbcr_roundtrip": f"""with {YCC}, f as (select frame_idx, y, x, round(luma, 6) as luma, round(cb, 6) - 128 as cb, round(cr, 6) - 128 as cr from ycc)
select a.frame_idx, a.y, a.x, trunc(least(255.0, greatest(0.0, a.luma + 1.402::double * c.cr + 0.5)))::int as r,
  trunc(least(255.0, greatest(0.0, a.luma - 0.344136::double * c.cb - 0.714136::double * c.cr + 0.5)))::int as g, trunc(least(255.0, greatest(0.0, a.luma + 1.772::double * c.cb + 0.5)))::int as b
from f a join f c on c.frame_idx = a.frame_idx and c.y = a.y - a.y % 2 and c.x = a.x - a.x % 2""",
    "raw_planes": f"with {RGB} select frame_idx, 0 as channel, y, x, r::int as v from rgb union all select frame_idx, 1, y, x, g from rgb union all select frame_idx, 2, y, x, b from rgb",
    "pad_and_tile": f"with {TILES} select {_BLOCK}, round(v, 6) as v from px",
    "untile": f"with {PLANES} select frame_idx, channel, y::int as y, x::int as x, round(v, 6) as v from planes",
    "level_shift": f"with {EMBED} select {_BLOCK}, v - 128 as v from px",
    "dct_blocks": f"with {EMBED}, {_dct()} select {_BLOCK}, round(c, 5) + 0.0 as coef from co",
    "idct_roundtrip": f"with {EMBED}, {_dct()}, {_idct('co', 'back')} select {_BLOCK}, round(v, 5) + 0.0 as v from back",
    "quant_matrix": "with " + _values([("luma" if k else "chroma", p, b) for k, t in ((1, LUMA), (0, CHROMA)) for p, b in enumerate(t)], "base", "tbl, pos, b") + ", " + _values([(q, scale_of(q)) for q in (10, 50, 90, 100)], "s", "quality, s")
    + " select quality, tbl, pos, least(255, greatest(1, round(b * s::double)))::int as q from base, s",
    "quantize": f"with {_n(EMBED)} select {_BLOCK}, n from nq",
    "quantize_line": f"with {_n(TILES)} select {_BLOCK}, n from nq",
    "dequantize": f"with {_n(EMBED)} select {_BLOCK}, (n * q)::double as c from nq",
    "temporal_residual": f"with {_d(EMBED)} select {_BLOCK}, d::int as d from res",
    "temporal_residual_line": f"with {_d(TILES)} select {_BLOCK}, d::int as d from res",
    "temporal_reconstruct": f"with {_d(EMBED)} select {_BLOCK}, (sum(d) over (partition by channel, block_id, pos order by frame_idx))::int as n from res",
    "permute_scan": f"with {_n(EMBED)}, {ORDER} select frame_idx, channel, block_id, i::int as pos, n as coef from nq join zz using (pos)",
    "inverse_scan": f"with {_n(EMBED)} select {_BLOCK}, n from nq",
    "rle_tokens": f"with {_tokens(EMBED)} select frame_idx, channel, tok, value::int as value, run from tok",
    "rle_tokens_line": f"with {_tokens(TILES)} select frame_idx, channel, tok, value::int as value, run from tok",
    "rle_decode": f"with {_d(EMBED)}, {ORDER} select frame_idx, channel, block_id::bigint * 64 + i as seq, d::int as coef from res join zz using (pos)",
    "rle_stats": f"with {_tokens(EMBED)} select frame_idx, channel, count(*) as tokens, sum(case when run is null then 1 else 2 end)::bigint as numbers, sum(value)::bigint as total, coalesce(max(run), 0)::int as longest from tok group by all",
    "rle_bytes": f"""with {_tokens(EMBED)},
placed as (select *, coalesce(sum(case when run is null then 1 else 2 end) over (partition by frame_idx, channel order by tok rows between unbounded preceding and 1 preceding), 0) as start from tok),
nums as (select frame_idx, channel, start as pos, value as v from placed union all select frame_idx, channel, start + 1, run from placed where run is not null),
u as (select *, (v + 65536) % 65536 as u from nums)
select frame_idx, channel, (pos * 2)::bigint as pos, (u % 256)::int as byte from u union all select frame_idx, channel, (pos * 2 + 1)::bigint, (u // 256)::int from u""",
    "byte_histogram": f"with {_HEX} select byte, count(*) as n from bytes group by byte",
    "scaled_histogram": f"with {_HEX}, {_SCALED} select * from sc",
    "byte_entropy": f"with {_HEX}, c as (select doc_id, byte, count(*) as n from bytes group by all), t as (select *, sum(n) over (partition by doc_id) as total from c) select doc_id, round(-sum(n / total * log2(n / total)), 6) as bits from t group by doc_id",
    "huffman_roundtrip": "select doc_id, md5(text) as text_md5 from documents where length(text) > 0",
    "mse": f"with {_n(EMBED)}, deq as (select {_BLOCK}, (n * q)::double as c from nq), {_idct('deq', 'back', ' + 128')} select frame_idx, round(avg((a.v - round(b.v, 6)) * (a.v - round(b.v, 6))), 5) as mse from px a join back b using ({_BLOCK}) group by frame_idx",
    "psnr_by_frame": f"""with {_n(TILES)}, deq as (select {_BLOCK}, (n * q)::double as c from nq), {_idct('deq', 'back', ' + 128')},
m as (select frame_idx, avg((a.v - b.v) * (a.v - b.v)) as m from px a join back b using ({_BLOCK}) join sizes using (channel)
  where (block_id % (pw // 8)) * 8 + pos % 8 < case when channel = 0 then {WIDTH} else {-(-WIDTH // 2)} end and (block_id // (pw // 8)) * 8 + pos // 8 < case when channel = 0 then {HEIGHT} else {-(-HEIGHT // 2)} end group by frame_idx)
select frame_idx, round(m, 5) as mse, round(case when m < 1e-10 then 'inf'::double else 10 * log10(65025.0 / m) end, 5) as psnr from m""",
    "profile_summary": f"with {_PROFILE} select rpad(substr(fn, 1, 24), 25, ' ') as name, count(*) as calls, round(sum(duration), 4) as total, round(avg(duration), 4) as avg_duration, round(avg(k), 4) as avg_compute, 0.0::double as avg_memory, max(trunc(k)::int) as registers from p group by fn",
    "profile_total": f"with {_PROFILE} select round(sum(duration), 4) as total from p",
    "benchmark_summary": f"with {_TIMES} select backend, round(avg_s, 4) as avg_s, min_s, runs from t",
    "speedup": f"with {_TIMES} select backend, round((select avg_s from t where backend = '1-URGENT') / avg_s, 6) as speedup from t",
    "parse_float_tolerant": """with v as (select event_id, value, replace(printf('%.2f', value), '.', ',') as v from events),
r as (select event_id, case event_id % 7 when 0 then value::decimal(18, 4)::varchar when 1 then v when 2 then '" ' || v || ' "' when 3 then '1,' || v when 4 then 'n/a' when 5 then '1d' else '1_0' end as raw from v),
c as (select event_id, trim(replace(replace(raw, '"', ''), ',', '.')) as t from r),
n as (select event_id, case when regexp_full_match(t, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then t::double else 0.0 end as number from c)
select event_id, number, trunc(number)::int as whole from n""",
    "numeric_name_order": "with n as (select distinct p_brand as name from part union select distinct c_name from customer) select name, coalesce(try_cast(nullif(regexp_extract(name, '[0-9]+'), '') as bigint), -1) as number from n",
    "frame_manifest": """with f as (select url || '/' || page_id || case page_id % 3 when 0 then '.PNG' when 1 then '.jpeg' else '.txt' end as path from pages),
i as (select path, coalesce(try_cast(nullif(regexp_extract(regexp_extract(path, '[^/]*$'), '[0-9]+'), '') as hugeint), -1) as k from f where regexp_matches(lower(path), '\\.(png|jpg|jpeg)$'))
select (row_number() over (order by k, path) - 1)::int as frame_idx, path from i""",
}
