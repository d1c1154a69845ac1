"""SQL twins of the views in ``sources.tables``."""

from . import view

view("bars", """
 select l_suppkey symbol, cast(l_shipdate as date) d,
  arg_min(l_extendedprice/1e4, row(l_orderkey,l_linenumber,l_extendedprice,l_discount,l_tax)) open,
  max(l_extendedprice/1e4*(1+l_tax)) high, min(l_extendedprice/1e4*(1-l_discount)) low,
  arg_max(l_extendedprice/1e4, row(l_orderkey,l_linenumber,l_extendedprice,l_discount,l_tax)) as close,
  sum(l_quantity) volume
 from lineitem group by 1,2""")
view("ticks", """
 select event_type sensor, event_id seq, value v, cast(json_extract_string(props,'$.k') as int) k,
  case when cast(json_extract_string(props,'$.k') as int)>=15 then value end x from events""")
view("fx", """
 select cast(l_shipdate as date) d, avg(l_extendedprice)/1e4 as close, max(l_extendedprice)/1e4 high,
  min(l_extendedprice)/1e4 low from lineitem group by 1""")
view("macro_monthly", """
 select cast(date_trunc('month',l_shipdate) as date) d, avg(l_extendedprice)/1e4 v from lineitem group by 1""")
view("weather", """
 select event_type region, date '2000-01-01' + cast(date_diff('hour', timestamp '2024-01-01', date_trunc('hour',ts)) as integer) d,
  max(value) temp_max, min(value) temp_min, sum(case when value<20 then value else 0 end) precip,
  avg(value) et0, max(value)-min(value) vpd_max from events group by 1,2""")
view("spine", """
 select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) d from (select min(d) lo, max(d) hi from fx)""")
view("cal_coffee", """
 select d, cast(month(d) in (9,10,11) as int) is_flowering, cast(month(d) in (5,6,7,8) as int) is_harvest from spine""")
view("cal_corn", """
 select d, cast(month(d) in (4,5) as int) is_planting, cast(month(d) in (7) as int) is_pollination,
  cast(month(d) in (9,10,11) as int) is_harvest from spine""")
view("report_rows", """
 select cast(date_trunc('week',l_shipdate) as date)+5 week_ending,
  case l_returnflag when 'A' then 'US TOTAL' when 'N' then 'IOWA' else 'ILLINOIS' end state,
  l_linenumber measure, min(l_quantity) v from lineitem group by 1,2,3""")
view("rets", """
 select * from (select symbol tag, d, row_number() over (partition by symbol order by d) rn,
  lead(close,7) over (partition by symbol order by d)/close-1 r from bars) where r is not null""")
view("preds", """
 select tag, model, d, rn, r, cast(r>0.025e0 as int) y_true, p, dn/(dn+fl+up) p_down, fl/(dn+fl+up) p_flat,
  up/(dn+fl+up) p_up, (p-0.5e0)/5e0 y_hat, case when r>0.025e0 then 2 when r< -0.025e0 then 0 else 1 end cls
 from (select *, ((rn*7919*model+tag*31)%1000)::double/1000 p, ((rn*104729*model+tag*17)%997+1)::double dn,
  ((rn*1299709*model+tag*7)%991+1)::double fl, ((rn*15485863*model+tag*3)%983+1)::double up
  from rets cross join (select unnest([1,2,3,4]) model))""")


def sround(expr: str, digits: int = 6) -> str:
    return f"(round({expr},{digits})+0e0)"


def full(agg: str, c: str, n: int, part: str, order: str = "d") -> str:
    """Trailing aggregate which needs n known values."""
    w = f"over (partition by {part} order by {order} rows between {n - 1} preceding and current row)"
    return f"case when count({c}) {w} >= {n} then {agg}({c}) {w} end"
