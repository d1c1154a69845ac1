"""Section 2.7: sorts, limits, top-k, set operations."""

from pyspark.sql import functions as F

from ..functions.nullsafe import rounded
from ..functions.scalars import feature_group
from ..operators import backtest as B
from ..operators import metrics as M
from ..operators import splits
from ..plans import dashboard
from ..sources import tables as t
from . import query
from .trading import KEYS, ls_trades
from .views import sround


@query("sort_results", f"""
 select tag, model, {sround('case when count(*)>=2 then (avg(sr)-0.04e0/52)/nullif(stddev_pop(sr),0)*sqrt(52e0) end')} sharpe from ls_trades group by 1,2""")
def sort_results(spark, sf):
    out = B.summarize(ls_trades(spark, sf), KEYS).select(*KEYS, rounded("sharpe").alias("sharpe"))
    return dashboard.sorted_results(out)


NAME = "case when p_size<10 then 'usd_' when p_size<20 then 'cal_' when p_size<30 then 'temp_' else 'rsi_' end||p_partkey"
GROUP = "case when p_size<10 then 'macro' when p_size<20 then 'farming' when p_size<30 then 'weather' else 'market' end"


@query("top_k_features", f"""
 select * from (select p_brand tag, {NAME} feature, p_retailprice gain, row_number() over (partition by p_brand order by p_retailprice desc, {NAME}) rank, {GROUP} grp from part) where rank<=10""")
def top_k_features(spark, sf):
    p = t.read(spark, sf, "part")
    s = F.col("p_size")
    prefix = F.when(s < 10, "usd_").when(s < 20, "cal_").when(s < 30, "temp_").otherwise("rsi_")
    imp = p.select(F.col("p_brand").alias("tag"), F.concat(prefix, F.col("p_partkey").cast("string")).alias("feature"), F.col("p_retailprice").alias("gain"))
    return dashboard.top_features(imp, ["tag"], 10).withColumn("rank", F.col("rank").cast("long"))


@query("last_n_rows", "select sensor, seq, v from (select *, row_number() over (partition by sensor order by seq desc) q from ticks) where q<=1000")
def last_n_rows(spark, sf):
    return splits.last_rows(t.ticks(spark, sf).select("sensor", "seq", "v"), ["sensor"], "seq", 1000)


@query("best_by_metric", f"select tag, model, {sround('auc')} auc_roc from (select *, row_number() over (partition by tag order by auc desc, model) q from auc_table) where q=1")
def best_by_metric(spark, sf):
    auc = M.ranking_metrics(t.predictions(spark, sf), KEYS, "y_true", "p", bounded=True)
    return dashboard.best_by(auc, ["tag"], "model", "auc_roc").select("tag", "model", rounded("auc_roc").alias("auc_roc"))


@query("union_all", "select 'full' split, count(*) n from tag_split union all select split, count(*) from tag_split group by 1")
def union_all(spark, sf):
    s = splits.chrono_split(t.returns(spark, sf).select("tag", "d", "r"), ["tag"], "d", 7)
    return dashboard.with_full(s).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


