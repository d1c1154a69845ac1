"""Section 2.9: labels, splits, sampling, window packing."""

from pyspark.sql import functions as F

from ..functions.nullsafe import rounded
from ..operators import labels as L
from ..operators import splits as S
from ..operators.ordered import over_rows, positions
from ..operators.packing import metadata_rows, pack_windows
from ..sources import tables as t
from . import query, view
from .evaluation import with_split
from .trading import KEYS
from .views import sround

CROP = "case when symbol%2=0 then 'coffee' else 'corn' end"
THETA = "case when symbol%2=1 then 0.015e0 else 0.025e0 end"
view("labelled_bars", f"""
 select *, 1/(1+exp((r+th)/0.02e0)) pd, 1/(1+exp(-(r-th)/0.02e0)) pu, greatest(0,1-1/(1+exp((r+th)/0.02e0))-1/(1+exp(-(r-th)/0.02e0))) pf
 from (select symbol, d, {THETA} th, lead(close,7) over (partition by symbol order by d)/close-1 r from bars)""")


def labelled(spark, sf):
    """Labels with the lower threshold for odd symbols, as for the weekly corn series."""
    b = over_rows(t.bars(spark, sf).select("symbol", "d", "close"), ["symbol"], "d", [L.forward_return("close", 7)], 0, 7)
    theta = F.when(F.col("symbol") % 2 == 1, L.threshold("corn", True)).otherwise(L.threshold("coffee", True))
    return b.withColumns(L.all_labels("return_future", theta))


def _r(df, keys, cols):
    return df.select(*keys, *[rounded(c).alias(c) for c in cols])


@query("forward_return", f"select symbol, d, {sround('r')} return_future from labelled_bars")
def forward_return(spark, sf):
    return _r(labelled(spark, sf), ["symbol", "d"], ["return_future"])


@query("label_binary", "select symbol, d, (r>th)::double target_binary from labelled_bars")
def label_binary(spark, sf):
    return labelled(spark, sf).select("symbol", "d", "target_binary")


@query("label_regression", f"select symbol, d, {sround('case when r is not null then greatest(least(r,0.3e0),-0.3e0) end')} target_reg from labelled_bars")
def label_regression(spark, sf):
    return _r(labelled(spark, sf), ["symbol", "d"], ["target_reg"])


SOFT = {c: f"case when r is not null then {p}/(pd+pf+pu) end" for c, p in (("target_mc_down", "pd"), ("target_mc_flat", "pf"), ("target_mc_up", "pu"))}


@query("label_multiclass_soft", "select symbol, d, " + ", ".join(f"{sround(e)} {c}" for c, e in SOFT.items()) + " from labelled_bars")
def label_multiclass_soft(spark, sf):
    return _r(labelled(spark, sf), ["symbol", "d"], list(SOFT))


@query("label_multiclass_hard", "select symbol, d, case when r is not null then case when pd>=pf and pd>=pu then 0e0 when pf>=pu then 1e0 else 2e0 end end target_multiclass from labelled_bars")
def label_multiclass_hard(spark, sf):
    return labelled(spark, sf).select("symbol", "d", "target_multiclass")


view("tick_pos", "select *, row_number() over (partition by sensor order by seq)-1 i, count(*) over (partition by sensor) n from ticks")


@query("chrono_split_embargo", """
 select sensor, seq, case when i<floor(n*0.7e0)-7 then 'train' when i>=floor(n*0.7e0) and i<floor(n*0.8e0)-7 then 'val' when i>=floor(n*0.8e0) then 'test' end split from tick_pos""")
def chrono_split_embargo(spark, sf):
    return S.chrono_split(t.ticks(spark, sf), ["sensor"], "seq", 7, keep_embargo=True).select("sensor", "seq", "split")


@query("chrono_split_plain", """
 select sensor, seq, case when i<floor(n*0.7e0) then 'train' when i<floor(n*0.7e0)+floor(n*0.1e0) then 'val' else 'test' end split from tick_pos""")
def chrono_split_plain(spark, sf):
    return S.chrono_split_plain(t.ticks(spark, sf), ["sensor"], "seq").select("sensor", "seq", "split")


@query("walkforward_windows", f"""
 with s as (select *, floor(n*0.8e0)::bigint st from tick_pos), b as (select sensor, unnest(range(0, ceil((n-st)/130e0)::bigint)) blk, st, n from (select distinct sensor, st, n from s))
 select b.sensor, blk as block, case when i>=b.st+blk*130 then 'test' else 'train' end role, count(*) rows_in, {sround('sum(v)', 3)} total
 from b join s on s.sensor=b.sensor and i>=b.st+blk*130-1000 and i<b.st+(blk+1)*130 group by 1,2,3""")
def walkforward_windows(spark, sf):
    p = positions(t.ticks(spark, sf), ["sensor"], "seq", "rn", "n")
    out = S.walkforward(p, train_rows=1000, step=130)
    return out.groupBy("sensor", "block", "role").agg(F.count(F.lit(1)).alias("rows_in"), rounded(F.sum("v"), 3).alias("total"))


@query("expanding_cv_folds", f"""
 select sensor, fold, case when i<n-(3-fold)*(n//4) then 'train' else 'test' end role, count(*) rows_in, {sround('sum(v)', 3)} total
 from tick_pos cross join (select unnest([0,1,2]) fold) where i<n-(3-fold)*(n//4)+n//4 group by 1,2,3""")
def expanding_cv_folds(spark, sf):
    p = positions(t.ticks(spark, sf), ["sensor"], "seq", "rn", "n")
    out = S.expanding_folds(p, 3)
    return out.groupBy("sensor", "fold", "role").agg(F.count(F.lit(1)).alias("rows_in"), rounded(F.sum("v"), 3).alias("total"))


@query("stride_sample", "select sensor, seq, v from tick_pos where i%7=0")
def stride_sample(spark, sf):
    return S.stride(t.ticks(spark, sf).select("sensor", "seq", "v"), ["sensor"], "seq", 7)


@query("sample_k", """
 select sensor, seq, v from (select sensor, seq, v, row_number() over (partition by sensor order by
 (((42*7919+seq*104729)%1000003)*((42*31+seq*17+7)%999983)+42*seq)%2147483647, seq) q from ticks) where q<=300""")
def sample_k(spark, sf):
    score = S.draw_key(F.lit(42).cast("long"), F.col("seq").cast("long"))
    return S.sample_rows(t.ticks(spark, sf).select("sensor", "seq", "v"), ["sensor"], ["seq"], 300, score=score)


view("shuffle_src", "select tag, r, row_number() over (partition by tag order by d)-1 j from (select * from strided where model=1)")


@query("permutation_draws", f"""
 with k as (select tag, b, j, r, ((b*7919+j*104729)%1000003)*((b*31+j*17+7)%999983)+b*j h from shuffle_src cross join (select i b from range(1,301) t(i)))
 select tag, b, row_number() over (partition by tag, b order by h%2147483647, j)-1 pos, {sround('r')} r from k""")
def permutation_draws(spark, sf):
    src = t.predictions(spark, sf).filter(F.col("model") == 1)
    # rounded once, not for each draw
    src = positions(S.stride(src, ["tag"], "d", 7).select("tag", "d", rounded("r").alias("r")), ["tag"], "d")
    pairs = F.array_sort(F.collect_list(F.struct("rn", "r")))
    arrays = src.groupBy("tag").agg(F.transform(pairs, lambda s: s["r"]).alias("x"))
    out = S.permuted_arrays(arrays, ["tag"], "x", 300).select("tag", "b", F.posexplode("shuffled").alias("pos", "r"))
    return out.select("tag", "b", F.col("pos").cast("long").alias("pos"), "r")


view("feature_split", """
 select b.symbol, b.d, close, volume, 1e0 const, s.split, s.r from bars b join tag_split s on b.symbol=s.tag and b.d=s.d""")
view("scaled", """
 select f.symbol, f.d, split, (close-cl)/(case when ch=cl then 1 else ch-cl end) as close, (volume-vl)/(case when vh=vl then 1 else vh-vl end) volume, 0e0 const, r
 from feature_split f join (select symbol, min(close) cl, max(close) ch, min(volume) vl, max(volume) vh from feature_split where split='train' group by 1) using (symbol)""")


def feature_split(spark, sf):
    """Inputs of bars with a return, and the split of their day; rows keep the layout of the bars."""
    rows = t.returns_split(spark, sf, ["close", "volume"])
    return rows.select(F.col("tag").alias("symbol"), "d", "close", "volume", F.lit(1.0).alias("const"), "split", "r")


def scaled(spark, sf):
    return S.minmax_scale(feature_split(spark, sf), ["symbol"], ["close", "volume", "const"])


@query("minmax_scale_train", f"select symbol, d, split, {sround('close')} as close, {sround('volume')} volume, const from scaled")
def minmax_scale_train(spark, sf):
    return scaled(spark, sf).select("symbol", "d", "split", rounded("close").alias("close"), rounded("volume").alias("volume"), "const")


def packed(spark, sf, rows=14):
    df = scaled(spark, sf)
    return pack_windows(df, ["symbol", "split"], "d", ["close", "volume"], ["const"], F.col("r"), rows)


@query("pack_windows", f"""
 select symbol, split, d, 14 win, 2 width, {sround('sum(close) over w', 5)} close_sum, {sround('first_value(volume) over w')} first_volume, {sround('last_value(volume) over w')} last_volume, {sround('r')} y
 from scaled window w as (partition by symbol, split order by d rows between 13 preceding and current row)
 qualify row_number() over (partition by symbol, split order by d)>=14""")
def pack_windows_query(spark, sf):
    total = F.aggregate("dynamic", F.lit(0.0), lambda s, v: s + v[0])
    return packed(spark, sf).select(
        "symbol", "split", "d", "win", F.size(F.get("dynamic", F.lit(0))).alias("width"), rounded(total, 5).alias("close_sum"),
        rounded(F.get("dynamic", F.lit(0))[1]).alias("first_volume"), rounded(F.element_at("dynamic", -1)[1]).alias("last_volume"), rounded("y").alias("y"))


@query("sink_parquet_windows", "select 14 win, split, count(*) n, cast(count(*)*28 as bigint) cells from (select split, row_number() over (partition by symbol, split order by d) q from scaled) where q>=14 group by 2")
def sink_parquet_windows(spark, sf):
    from ..sources import sinks

    path = sinks.scratch(spark, "windows")
    sinks.write_partitioned(packed(spark, sf), path, ["win", "split"])
    back = spark.read.parquet(path)
    return back.groupBy("win", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.flatten("dynamic"))).alias("cells"))


@query("select_window_metadata", "select symbol, split, d from (select *, row_number() over (partition by symbol, split order by d) q from feature_split) where q>=14")
def select_window_metadata(spark, sf):
    return metadata_rows(feature_split(spark, sf), ["symbol", "split"], "d", 14).select("symbol", "split", "d")


@query("class_weights_balanced", f"""
 with c as (select tag, model, cls, count(*) c from preds group by 1,2,3), w as (select tag, model, cls, sum(c) over p/(count(*) over p*c) weight from c window p as (partition by tag, model))
 select tag, model, d, cls, {sround('weight')} weight from preds join w using (tag, model, cls)""")
def class_weights_balanced(spark, sf):
    out = S.balanced_weights(t.predictions(spark, sf).select(*KEYS, "d", "cls"), KEYS, "cls")
    return out.select(*KEYS, "d", "cls", rounded("weight").alias("weight"))


@query("pos_weight_capped", f"select tag, model, split, {sround('case when sum(y_true)=0 then 1 else least(sum(1-y_true)/sum(y_true),10) end')} pos_weight from preds_split group by 1,2,3")
def pos_weight_capped(spark, sf):
    return with_split(spark, sf).groupBy(*KEYS, "split").agg(rounded(S.positive_weight("y_true")).alias("pos_weight"))
