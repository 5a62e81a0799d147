"""Sheets, calibration and streams on small hand-made rows."""

from pyspark.sql import functions as F

from quillmark.operators import calibrate, sheets
from quillmark.streaming import landing

SCHEMA = """ipo_id int, company_name string, evaluation_id string, evaluated_at string, mode string, config_version string, final_score double, verdict string,
modules array<struct<module:string,score:double>>, criteria array<struct<criterion:string,kind:string,max:double,state:string,points:double>>, knockouts array<struct<id:string,status:string>>,
penalties array<struct<id:string,state:string>>, peers array<struct<name:string,status:string>>, blocks array<struct<block:string,status:string>>, evidence array<struct<path:string,source_id:string>>,
observations array<struct<horizon:string,listing_gain:double,absolute_return:double,benchmark_return:double>>"""


def evaluations(spark):
    def row(i, when, gain):
        criteria = [("c1", "criterion", 4.0, "SCORED", 4.0), ("c2", "criterion", 5.0, "UNKNOWN", None), ("c3", "criterion", 2.0, "SCORED", 0.0), ("p1", "penalty", 0.0, "SCORED", -2.0)]
        return (1, "X", f"e{i}", when, "FINAL", "1", 8.0, "NEUTRAL", [("A", 4.0)], criteria, [("K1", "UNVERIFIED"), ("K2", "CLEAR")], [("q", "UNKNOWN")], [("p", "STALE"), ("v", "VALID")], [("gmp", "FRESH"), ("anchor", "MISSING")], [("a.b", "s1"), ("a.c", "s9")], [("1W", gain, None, None), ("1M", 5.0, 2.0, None), ("6M", None, 9.5, 4.25)])

    return spark.createDataFrame([row(1, "2024-01-01", 0.0), row(2, "2024-02-01", None)], SCHEMA)


def test_workbook(spark):
    e = evaluations(spark)
    book = sheets.workbook(e, spark.createDataFrame([("s1", "filing")], "source_id string, source_type string"))
    assert list(book) == sheets.NAMES
    sizes = {n: d.count() for n, d in book.items()}
    assert sizes == {"IPO_Master": 1, "Evaluations": 2, "Module_Scores": 2, "Criteria_Detail": 8, "Knockouts": 4, "Penalties": 2, "Missing_Unverified": 10, "Evidence": 4, "Market_Snapshots": 4, "Peer_Snapshots": 4, "Post_Listing": 2, "Backtest": 2, "Config_Versions": 1, "Run_Log": 2}
    assert book["IPO_Master"].first()["evaluation_id"] == "e2"
    assert {r["evaluation_id"]: r["listing_gain"] for r in book["Post_Listing"].collect()} == {"e1": 0.0, "e2": 5.0}
    assert {(r["return_6m"], r["index_6m"], r["excess_6m"]) for r in book["Backtest"].collect()} == {(9.5, 4.25, 5.25)}
    assert book["Evidence"].where("source_type is null").count() == 2
    criteria = sheets.exploded(e, "criteria")
    assert [r["criterion"] for r in sheets.risks(criteria).where("evaluation_id = 'e1'").orderBy("rank").collect()] == ["p1", "c3", "c2"]
    assert [r["criterion"] for r in sheets.strengths(criteria).where("evaluation_id = 'e1'").orderBy("rank").collect()] == ["c1", "c3"]


def test_calibration(spark):
    rows = spark.range(120).select("id", (F.lit(2020) + F.col("id") % 4).cast("string").alias("year"), F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"), F.col("id").cast("double").alias("r"))
    assert calibrate.gate(rows, "year").first()["tier"] == "CALIBRATION_CANDIDATE"
    made = calibrate.tilted(rows, "id", {"a": 60.0, "b": 40.0}, "r", "year")
    assert made["status"] == "PROPOSED" and made["weights"] == {"a": 65.0, "b": 35.0}
    assert calibrate.gate(rows.limit(10), "year").first()["tier"] == "CALIBRATION_INELIGIBLE"
    assert calibrate.changed_paths({"a": {"b": 1}, "c": 2}, {"a": {"b": 3}}) == [("a.b", 1, 3), ("c", 2, None)]
    assert calibrate.frozen_kept({"a": {"b": 1}}, {"a": {"b": 2}}, ["a"]) == ["a.b"]


def test_stream_drops_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 00:10:00", 1.0), (2, "2024-01-01 00:40:00", 3.0)], "k int, t string, v double").select("k", F.col("t").cast("timestamp").alias("t"), "v")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = landing.landed(stream, ["k"], "t").writeStream.format("memory").queryName("landed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("landed").count() == 2
    assert landing.windowed(stream, "k", "t", "v").isStreaming
    assert {r["status"] for r in landing.classified(rows, "t", "v").collect()} == {"FRESH"}
