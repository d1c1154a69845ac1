"""Section 2.14: data-quality checks and report tables."""

from pyspark.sql import functions as F

from ..functions.nullsafe import flag, rounded
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import splits
from ..plans import dashboard
from ..sources import tables as t
from . import query, view
from .evaluation import with_split
from .labels import labelled, packed
from .trading import KEYS
from .trading import ls_trades
from ..operators import backtest as B
from .views import sround

OK = "case when {ok} then 'PASS' else '{bad}' end status"


def _row(name: str, subject: str, ok: str, detail: str, bad: str = "FAIL") -> str:
    return f"select '{name}' \"check\", {subject}::varchar subject, {OK.format(ok=ok, bad=bad)}, {sround(f'({detail})::double', 5)} detail"


def _out(df):
    return df.withColumn("detail", rounded("detail", 5))


view("chk_null", _row("no_null", "sensor", "count(x)=count(*)", "count(*)-count(x)") + " from ticks group by sensor")
view("chk_overlap", _row("split_overlap", "tag", "sum(n)=0", "sum(n)") + " from (select tag, d, count(distinct split)-1 n from tag_split group by 1,2) group by tag")
view("win_n", "select symbol, split, count(*) n from (select symbol, split, row_number() over (partition by symbol, split order by d) q from scaled) where q>=14 group by 1,2")
view("win_rows", "select *, row_number() over (partition by symbol, split order by d) q, count(*) over (partition by symbol, split) m from scaled")
view("chk_leak", _row("target_leak", "symbol", "true", "2") + " from win_n group by symbol union all "
     + _row("target_leak", "symbol||'/leaked'", "false", "2") + " from win_n group by symbol")
view("chk_shapes", _row("window_shapes", "symbol||'/'||split", "true", "n") + " from win_n union all "
     + _row("window_shapes", "symbol||'/'||split||'/no targets'", "false", "n") + " from win_n where split='test'")
view("chk_scaler", " union all ".join([
    _row("scaler_range_train", "symbol", "min(least(close,volume))>=-1e-6 and max(greatest(close,volume))<=1+1e-6", "max(greatest(close,volume))-min(least(close,volume))") + " from win_rows where split='train' and m>=14 group by symbol",
    # a row lies in min(q, 14, m-13, m-q+1) windows
    _row("scaler_range_test", "symbol", "sum(least(q,14,m-13,m-q+1)*((close<0 or close>1)::int+(volume<0 or volume>1)::int))=0", "sum(least(q,14,m-13,m-q+1)*((close<0 or close>1)::int+(volume<0 or volume>1)::int))", "WARN") + " from win_rows where split='test' and m>=14 group by symbol"]))
view("chk_rate", _row("base_rate", "tag", "avg(y_true) between 0.1e0 and 0.6e0", "avg(y_true)") + " from preds_split where model=1 and split='train' group by tag")
view("chk_mono", _row("monotonic", "event_type", "sum(b)=0", "sum(b)") + " from (select event_type, coalesce(ts<=lag(ts) over (partition by event_type order by event_id),false)::int b from events) group by event_type")
view("chk_dir", _row("forward_direction", "symbol", "corr(r,again)>0.8e0", "corr(r,again)") + " from (select symbol, r, lead(close,7) over (partition by symbol order by d)/close-1 again from bars join (select symbol, d, r from labelled_bars) using (symbol, d)) group by symbol")


def no_null(spark, sf):
    return Q.no_null(t.ticks(spark, sf).select("sensor", "seq", "x", "v"), ["sensor"])


def overlap(spark, sf):
    s = splits.chrono_split(t.returns(spark, sf).select("tag", "d"), ["tag"], "d", 7)
    return Q.split_overlap(s, ["tag"], "d")


def leak(spark, sf):
    """The packed features, and a broken list which holds a label: that one has to fail."""
    p = packed(spark, sf)
    broken = Q.target_leak(p, ["symbol"], ["close", "volume", "target_binary"])
    return Q.target_leak(p, ["symbol"], ["close", "volume"]).unionByName(marked(broken, "/leaked"))


def marked(checks, what):
    return checks.withColumn("subject", F.concat("subject", F.lit(what)))


def shapes(spark, sf):
    """The packed windows, and test windows without targets: these have to fail."""
    p = packed(spark, sf)
    broken = p.filter(F.col("split") == "test").withColumn("y", F.when(F.lit(False), F.col("y")))
    return Q.window_shapes(p, ["symbol", "split"]).unionByName(marked(Q.window_shapes(broken, ["symbol", "split"]), "/no targets"))


def scaler(spark, sf):
    return Q.scaler_range(packed(spark, sf), ["symbol"])


def rate(spark, sf):
    return Q.base_rate(with_split(spark, sf).filter(F.col("model") == 1), ["tag"], "y_true")


def mono(spark, sf):
    return Q.monotonic(t.read(spark, sf, "events"), ["event_type"], "event_id", "ts")


def direction(spark, sf):
    b = labelled(spark, sf).select("symbol", "d", "close", "return_future")
    return Q.forward_direction(b, ["symbol"], "d", "close", "return_future", 7)


CHECKS = {
    "check_no_null": (no_null, "chk_null"), "check_split_overlap": (overlap, "chk_overlap"), "check_target_leak": (leak, "chk_leak"),
    "check_window_shapes": (shapes, "chk_shapes"), "check_scaler_range": (scaler, "chk_scaler"), "check_base_rate": (rate, "chk_rate"),
    "check_monotonic": (mono, "chk_mono"), "check_forward_direction": (direction, "chk_dir"),
}
for _name, (_fn, _view) in CHECKS.items():
    query(_name, f"select * from {_view}")(lambda spark, sf, _fn=_fn: _out(_fn(spark, sf)))


@query("check_runner", "select status, count(*) n from (" + " union all ".join(f"select status from {v}" for _, v in CHECKS.values()) + ") group by 1")
def check_runner(spark, sf):
    return Q.status_counts(Q.run_all([fn(spark, sf) for fn, _ in CHECKS.values()]))


@query("report_tables", f"""
 with a as (select tag, model, max(case when split='train' then auc end) a, max(case when split='val' then auc end) b, max(case when split='test' then auc end) c from split_auc group by 1,2),
 s as (select tag, count(*) n, cast(sum((r>0.025e0)::int) as bigint) pos from tag_split where split='test' group by 1),
 t as (select tag, model, avg((sr>0)::int) filter (where s<>0) wr from ls_trades group by 1,2)
 select tag, model, {sround('a')} train_auc, {sround('b')} val_auc, {sround('c')} test_auc, n n_test_rows, pos test_positives, {sround('wr')} win_rate,
  case when pos=0 then 'no positives in test' when a-b>0.15e0 then 'overfit gap' end issue from a join s using (tag) left join t using (tag, model)""")
def report_tables(spark, sf):
    p = with_split(spark, sf)
    ranking = M.ranking_metrics(p, [*KEYS, "split"], "y_true", "p", bounded=True)
    base = splits.chrono_split(t.returns(spark, sf).select("tag", "d", "r"), ["tag"], "d", 7)
    stats = dashboard.split_stats(base.withColumn("target_binary", flag(F.col("r") > t.THETA)), ["tag"])
    trading = B.summarize(ls_trades(spark, sf), KEYS)
    out = dashboard.report_table(stats, ranking, trading, ["tag"])
    return out.select(*KEYS, *[rounded(c).alias(c) for c in ("train_auc", "val_auc", "test_auc")], "n_test_rows", "test_positives", rounded("win_rate").alias("win_rate"), "issue")


view("hurdle_src", """
 select a.tag, a.d, a.r, a.p_up, b.p_down, c.y_hat single, e.p/10 m_up, (1-e.p)/10 m_down from preds a join preds b on b.model=2 and a.tag=b.tag and a.d=b.d
 join preds c on c.model=3 and a.tag=c.tag and a.d=c.d join preds e on e.model=4 and a.tag=e.tag and a.d=e.d where a.model=1""")


@query("hurdle_comparison", f"""
 select tag, {sround('corr(r,single)')} single_r, {sround('corr(r,p_up*m_up)')} half_r, {sround('corr(r,p_up*m_up-p_down*m_down)')} full_r,
  {sround('case when count(*) filter (where r>0.025e0)>=5 then corr(r,m_up) filter (where r>0.025e0) end')} stage2a_r,
  {sround('case when count(*) filter (where r< -0.025e0)>=5 then corr(-r,m_down) filter (where r< -0.025e0) end')} stage2b_r,
  count(*) filter (where r>0.025e0) n_pos_test, count(*) filter (where r< -0.025e0) n_neg_test from hurdle_src group by 1""")
def hurdle_comparison(spark, sf):
    at = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    wide = t.predictions(spark, sf).groupBy("tag", "d").agg(
        at(1, "r").alias("r"), at(1, "p_up").alias("p_up"), at(2, "p_down").alias("p_down"), at(3, "y_hat").alias("single"),
        (at(4, "p") / 10).alias("m_up"), ((1 - at(4, "p")) / 10).alias("m_down"))
    out = dashboard.hurdle_comparison(wide, ["tag"], t.THETA)
    cols = ["single_r", "half_r", "full_r", "stage2a_r", "stage2b_r"]
    return out.select("tag", *[rounded(c).alias(c) for c in cols], "n_pos_test", "n_neg_test")
