"""Section 2.1: scans, sources, sinks. Files are written from the given tables, then read back."""

from pyspark.sql import functions as F

from ..functions.nullsafe import rounded
from ..sources import files, sinks
from ..sources import tables as t
from . import query, view
from .views import sround


@query("scan_bars_csv", f"""
 select symbol, d, {sround('open')} open, {sround('close')} as close, case when volume<40 then volume end volume from bars""")
def scan_bars_csv(spark, sf):
    b = t.bars(spark, sf)
    volume = F.when(F.col("volume") < 40, F.col("volume").cast("string")).otherwise("n/a")
    text = b.select(
        F.col("d").cast("string").alias("index"), *[F.col(c.lower()).cast("string").alias(c) for c in ("Close", "High", "Low", "Open")],
        volume.alias("Volume"), F.col("symbol").cast("string").alias("symbol"),
    )
    junk = b.select("symbol").distinct().select(
        F.lit("Ticker").alias("index"), *[F.lit("XX=F").alias(c) for c in ("Close", "High", "Low", "Open", "Volume")],
        F.col("symbol").cast("string"),
    )
    path = sinks.scratch(spark, "bars_csv")
    sinks.write_csv(text.unionByName(junk), path)
    out = files.read_bars_csv(spark, path, text.columns, extra=("symbol",))
    return out.select(F.col("symbol").cast("long").alias("symbol"), "d", rounded("open").alias("open"), rounded("close").alias("close"), "volume")


@query("scan_series_dir", "select 'coffee_'||region series, 'coffee' grp, d, temp_max, precip from weather where region<>'error' "
       "union all select 'corn_error', 'corn', d, temp_max, precip from weather where region='error'")
def scan_series_dir(spark, sf):
    w = t.weather(spark, sf)
    base = sinks.scratch(spark, "stations")
    crop = F.when(F.col("region") == "error", "corn_").otherwise("coffee_")
    named = w.select(F.concat(F.lit("clean_despiked_"), crop, "region").alias("series"), "d", "temp_max", "precip")
    sinks.write_csv(named, base, ["series"])
    out = files.read_series_dir(spark, base, {"d": "date", "temp_max": "double", "precip": "double"})
    return out.select("series", "grp", "d", "temp_max", "precip")


@query("flatten_series_json", f"select d, {sround('v')} \"value\" from macro_monthly where v>=5.25e0")
def flatten_series_json(spark, sf):
    m = t.macro_monthly(spark, sf)
    value = F.when(F.col("v") >= 5.25, F.col("v").cast("string")).otherwise("-")
    item = F.struct(
        F.year("d").cast("string").alias("year"),
        F.concat(F.lit("M"), F.lpad(F.month("d").cast("string"), 2, "0")).alias("period"),
        value.alias("value"),
    )
    # at most twelve months and one annual row per document
    annual = F.struct(F.first(F.year("d").cast("string")).alias("year"), F.lit("M13").alias("period"), F.avg("v").cast("string").alias("value"))
    docs = m.groupBy(F.year("d").alias("y")).agg(F.collect_list(item).alias("items"), annual.alias("annual"))
    data = F.struct(F.concat("items", F.array("annual")).alias("data"))
    payload = F.to_json(F.struct(F.struct(F.array(data).alias("series")).alias("Results")))
    out = files.flatten_statistics(docs.select(payload.alias("payload")), "payload")
    return out.select("d", rounded("value").alias("value"))


def _item(c):
    """Report item text of a measure number; numbers 3 and up have no listed item here."""
    return (
        F.when(c == 1, "CORN - PROGRESS, MEASURED IN PCT PLANTED")
        .when(c == 2, "CORN - CONDITION, MEASURED IN PCT GOOD")
        .when(c == 3, "CORN - CONDITION, MEASURED IN PCT EXCELLENT")
        .when(c == 4, "CORN - CONDITION, MEASURED IN PCT POOR")
        .when(c == 5, "CORN - CONDITION, MEASURED IN PCT VERY POOR")
        .when(c == 6, "CORN - PROGRESS, MEASURED IN PCT HARVESTED")
        .otherwise("CORN - YIELD, MEASURED IN BU / ACRE")
    )


NAMES = """case measure when 1 then 'planting_pct' when 2 then 'condition_good_pct' when 3 then 'condition_excellent_pct'
 when 4 then 'condition_poor_pct' when 5 then 'condition_very_poor_pct' when 6 then 'harvested_pct' end"""
view("report_named", f"select week_ending, state, {NAMES} measure, v from report_rows where measure<=6")


def named_reports(spark, sf):
    r = t.report_rows(spark, sf)
    return r.withColumn("measure", files.measure_name(_item(F.col("measure")))).filter(F.col("measure").isNotNull())


@query("flatten_report_rows", "select week_ending, state, measure, v*100 v from report_named")
def flatten_report_rows(spark, sf):
    r = t.report_rows(spark, sf)
    payload = F.to_json(F.struct(
        F.col("week_ending").cast("string").alias("week_ending_date"), F.col("state").alias("state_name"),
        _item(F.col("measure")).alias("short_desc"), F.format_number(F.col("v") * 100, 0).alias("Value")))
    return files.flatten_report(r.select(payload.alias("payload")), "payload")


@query("scan_export_csv", "select week_ending, state, measure, case when v>=3 then v*100 end v from report_named where state<>'ILLINOIS'")
def scan_export_csv(spark, sf):
    r = t.report_rows(spark, sf)
    state = F.when(F.col("state") == "ILLINOIS", "OHIO").otherwise(F.concat(F.lit(" "), F.initcap("state")))
    text = r.select(
        F.col("week_ending").cast("string").alias("Week Ending"), F.lit("STATE").alias("Geo Level"), state.alias("State"),
        _item(F.col("measure")).alias("Data Item"),
        F.when(F.col("v") < 3, " (D)").otherwise(F.format_number(F.col("v") * 100, 0)).alias("Value"))
    path = sinks.scratch(spark, "export_csv")
    sinks.write_csv(text, path)
    return files.parse_export(spark.read.csv(path, header=True))


@query("scan_numeric_rows", "select sensor, seq, v from ticks where k>=20")
def scan_numeric_rows(spark, sf):
    text = t.ticks(spark, sf).select("sensor", "seq", F.when(F.col("k") >= 20, F.col("v").cast("string")).otherwise("^VIX").alias("v"))
    return files.numeric_rows(text, "v")


@query("filter_extract", "select p_partkey, p_name, p_type from part where lower(p_name) like '%red%' and lower(p_type) like '%eco%'")
def filter_extract(spark, sf):
    return files.containing(t.read(spark, sf, "part"), {"p_name": "RED", "p_type": "Eco"}).select("p_partkey", "p_name", "p_type")


@query("scan_predictions", f"select tag, d, {sround('p')} p, y_true from preds where model=2 and d>=date '2000-01-01'")
def scan_predictions(spark, sf):
    p = t.predictions(spark, sf).select("tag", "model", "d", "p", "y_true")
    p = p.withColumn("split", F.when(F.col("d") >= "2000-01-01", "test").otherwise("train"))
    path = sinks.scratch(spark, "predictions")
    sinks.write_partitioned(p, path, ["model", "split"])
    out = files.read_predictions(spark, path, model=2, split="test")
    return out.select("tag", "d", rounded("p").alias("p"), "y_true")


@query("scan_results_json", f"""
 select tag::varchar tag, model::varchar model, 0.5e0 threshold, 0e0 auc, 0e0 pr_auc, {sround('avg(y_true)')} f1, count(*) n from preds group by 1,2""")
def scan_results_json(spark, sf):
    g = t.predictions(spark, sf).groupBy("tag", "model").agg(F.avg("y_true").alias("f1"), F.count(F.lit(1)).alias("n_samples"))
    doc = g.select(
        F.col("tag").cast("string").alias("tag"), F.col("model").cast("string").alias("model"),
        F.struct(F.struct("f1", "n_samples").alias("test")).alias("splits"))
    path = sinks.scratch(spark, "results")
    doc.write.json(path)
    out = files.read_results(spark, path, "test")
    return out.withColumn("f1", rounded("f1"))


@query("sink_csv", f"select symbol, d, {sround('close')} as close from bars")
def sink_csv(spark, sf):
    path = sinks.scratch(spark, "bars_out")
    sinks.write_csv(t.bars(spark, sf).select("symbol", "d", "close"), path)
    out = spark.read.schema("symbol long, d date, close double").csv(path, header=True)
    return out.select("symbol", "d", rounded("close").alias("close"))


@query("sink_json_documents", f"select model, {sround('avg(p)', 4)} mean_p, count(*) n from preds group by 1")
def sink_json_documents(spark, sf):
    g = t.predictions(spark, sf).groupBy("model").agg(F.avg("p").alias("mean_p"), F.count(F.lit(1)).alias("n"))
    path = sinks.scratch(spark, "documents")
    sinks.write_documents(g, path)
    return spark.read.schema("model int, mean_p double, n long").json(path)
