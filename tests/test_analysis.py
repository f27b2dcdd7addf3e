"""Frame cleaning, statistics, topics, files, streams, and every query against its SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tarnwell.operators import charts, frames, gold, layout, stats, topics
from tarnwell.plans import catalogue, pipeline
from tarnwell.sources import files
from tarnwell.streaming import windows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return float(v) if hasattr(v, "is_finite") else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_queries_match_their_sql(spark, duck, name):
    got = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    want = [tuple(map(plain, r)) for r in got.fetchall()]
    mine = [tuple(map(plain, r)) for r in catalogue.queries()[name](spark, SF).select(*[f"`{c}`" for c in columns]).collect()]
    key = lambda r: tuple(map(str, r))
    for a, b in zip(sorted(mine, key=key), sorted(want, key=key), strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9) if all(isinstance(x, (int, float)) for x in a) else tuple(map(str, a)) == tuple(map(str, b))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def test_impute(spark):
    take = lambda df: [r.x for r in df.orderBy("i").collect()]
    assert take(frames.impute(column(spark, [1.0, None, 3.0, None]), "x", "mean")) == [1, 2, 3, 2]
    gap = column(spark, [1.0, None, None, 4.0])
    assert take(frames.impute(gap, "x", "ffill", ["i"])) == [1, 1, 1, 4] and take(frames.impute(gap, "x", "bfill", ["i"])) == [1, 4, 4, 4]
    assert take(frames.impute(column(spark, [None, 1.0, None, 3.0, None]), "x", "interpolate", ["i"])) == [1, 1, 2, 3, 3]
    assert take(frames.impute(column(spark, [None, "x", "y", "x", None], "string"), "x", "mode")) == ["x", "x", "y", "x", "x"]
    with pytest.raises(ValueError):
        frames.impute(gap, "x", "ffill")


def test_outliers(spark):
    odd = lambda values, **k: [r.o for r in frames.outliers(column(spark, values), "x", out="o", **k).orderBy("i").collect()]
    assert odd([0.0, 1.0, 2.0, 100.0]) == [False, False, False, True]
    assert odd([1.0, 1.0, 2.0, 2.0, 2.0, 3.0, 3.0, 100.0], method="iqr") == [False] * 7 + [True]
    assert odd([5.0] * 6) == [False] * 6 and odd([1.0, 100.0]) == [False] * 2


def test_prune_quarantine_rare_and_anchor(spark):
    df = spark.createDataFrame([(i, None if i else 1, "x", None) for i in range(1, 11)], "keep_me int, mostly_null int, constant string, id string")
    pruned, why = frames.prune(df, 0.9, 0.2, ("id",))
    assert pruned.columns == ["keep_me", "id"] and why == {"mostly_null": "sparse", "constant": "constant"}
    assert frames.quarantine(frames.quarantine(df, ["id"]), ["id"]).columns == ["__quarantine__keep_me", "__quarantine__mostly_null", "__quarantine__constant", "id"]
    rare = frames.rare_categories(column(spark, ["A", "A", "B", "C", "C", "D", None, "A"], "string"), "x", 0.2)
    assert [r.x for r in rare.orderBy("i").collect()] == ["A", "A", "Other", "C", "C", "Other", None, "A"]
    anchored = frames.extract_anchor(column(spark, ["McDonals Store #4", "The McDonals", "Burger, McDonals", None], "string"), "x")
    assert [r.x for r in anchored.orderBy("i").collect()] == ["mcdonals", "mcdonals", "mcdonals", None]


def test_prune_keeps_few_values_on_many_rows_and_drops_one_value_on_few(spark):
    df = spark.range(8_000).select(F.col("id"), (F.col("id") % 5).alias("segment"), (F.col("id") == 7).alias("once"), F.when(F.col("id") % 2 == 0, "x").alias("constant"))
    kept, why = frames.prune(df)
    assert kept.columns == ["id", "segment"] and why == {"once": "constant", "constant": "constant"}
    assert frames.prune(df.limit(6).select("id", "segment", "constant"))[1] == {"constant": "constant"}


def test_statistics(spark):
    assert stats.trend_slope(column(spark, [0.0, 1.0, 2.0, 3.0, 4.0]), "x", ["i"]).first().slope == pytest.approx(0.5)
    assert stats.concentration(column(spark, [0.0, 2.0]), "i", "x").first().gini == pytest.approx(0.5)
    assert stats.concentration(column(spark, [1.0] * 4), "i", "x").first().gini == pytest.approx(0) and stats.concentration(column(spark, []), "i", "x").first().gini == 0
    table = spark.createDataFrame([("a", "x")] * 30 + [("a", "y"), ("b", "x")] + [("b", "y")] * 30, "p string, q string")
    v = stats.cramers_test(table, "p", "q")
    assert v["dof"] == 1 and v["n"] == 62 and v["v"] > 0.8 and v["chi2"] > 50 and v["p"] < 1e-9
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, x double")
    assert stats.anova_test(one, "x", "g")["p"] == 1 and stats.anova_test(one, "x", "g")["f"] == 0
    apart = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    assert stats.anova_test(apart, "x", "g")["f"] == float("inf") and stats.anova_test(apart, "x", "g")["p"] == 0
    seen = [("A", 1), ("A", 2), ("B", 1), ("B", 1), ("C", 2), ("C", 3)]
    got = {(r.first_seen.month, r.age): r.retention_pct for r in stats.cohorts(spark.createDataFrame([(u, dt.datetime(2024, m, 5)) for u, m in seen], "u string, t timestamp_ntz"), "u", "t").collect()}
    assert got == {(1, 0): 1, (1, 1): 0.5, (2, 0): 1, (2, 1): 1}


def test_topics_from_a_frame(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), i % 10, "ABC"[i % 3], float(i) + (i % 5), 2.0 * i + 1, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, user_id int, grp string, num1 double, num_corr double, num2 double")
    got = topics.candidates(df)
    assert {r.family for r in got.collect()} >= {"kpi", "trend", "correlation", "ranking", "part_to_whole", "distribution", "deviation", "cohort"}
    chosen = topics.select(topics.score(got))
    assert 0 < chosen.count() <= 12 and topics.select(topics.score(got).limit(0)).count() == 0
    done = pipeline.to_gold(df, "d", out=str(tmp_path / "gold"))
    assert len(done["layout"]["sections"]) == len(done["manifest"]["components"]) == chosen.count()
    assert "Topics" in layout.narrative("d", [], chosen.collect())


def test_files_round_trip_union_and_catalog(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    for fmt in ("parquet", "json", "csv"):
        files.write_any(a, str(tmp_path / f"one.{fmt}"))
        assert sorted(map(tuple, files.read_any(spark, str(tmp_path / f"one.{fmt}")).select("a", "b").collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "raw" / "My Set").mkdir(parents=True)
    (tmp_path / "raw" / "My Set" / "a.csv").write_text("id,amount\n1,2.5\n2,3\n")
    (tmp_path / "raw" / "My Set" / "b.json").write_text('[{"id": 3, "flag": true}]')
    (tmp_path / "raw" / "c.ndjson").write_text('{"id": "x"}\n')
    (tmp_path / "raw" / "bad.parquet").write_text("nothing")
    import pyarrow as pa
    import pyarrow.feather as feather

    feather.write_feather(pa.table({"id": [7], "amount": [1.5]}), str(tmp_path / "raw" / "d.feather"))
    union = files.read_union(spark, [str(p) for p in sorted((tmp_path / "raw").rglob("*.*"))])
    assert sorted(str(r.id) for r in union.collect()) == ["1", "2", "3", "7", "x"] and {"amount", "flag", "_source_uri"} <= set(union.columns)
    assert {(r.kind, r.slug) for r in files.catalog(spark, str(tmp_path / "raw")).collect()} == {("csv", "my-set"), ("json", "my-set"), ("ndjson", "c"), ("parquet", "bad"), ("feather", "d")}
    assert files.slugs(spark, str(tmp_path / "raw")) == ["bad", "c", "d", "my-set"]
    with pytest.raises(ValueError):
        files.read_union(spark, [str(tmp_path / "raw" / "bad.parquet")])


def test_raw_files_to_silver_and_back_from_a_frozen_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_id,price_usd,cake_type\n" + "".join(f"{i},${i}.50,{'pie' if i % 2 else ' Tart '}\n" for i in range(1, 40)))
    made = pipeline.to_silver(spark, [str(tmp_path / "a.csv")], "cakes", out=str(tmp_path / "silver"))
    assert made.df.count() == 39 and made.log and spark.read.parquet(str(tmp_path / "silver/dataset.parquet")).count() == 39
    frozen = type(made.schema).from_toml((tmp_path / "silver/schema.toml").read_text())
    assert pipeline.to_silver(spark, [str(tmp_path / "a.csv")], "cakes", frozen).df.count() == 39 and frozen.roles() == made.schema.roles()
    again = pipeline.to_silver(spark, [str(tmp_path / "a.csv"), str(tmp_path / "none.parquet")], "cakes", out=str(tmp_path / "silver"))
    assert len(again.log) == 1 and again.schema.roles() == frozen.roles() and [p for p, _ in again.failed] == [str(tmp_path / "none.parquet")]
    with pytest.raises(FileNotFoundError):
        pipeline.to_silver(spark, [str(tmp_path / "a.csv")], "cakes", mode="apply")


def test_charts_name_what_is_missing(spark):
    with pytest.raises(KeyError):
        charts.histogram(column(spark, [1.0]), "nope")
    assert charts.histogram(column(spark, [1.0, 1.0]), "x").collect()[0].n == 2


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    made = windows.windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "1 day", "60 days")
    q = made.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.start: r.n for r in spark.table("windowed").collect()}
    want = {r.start: r.n for r in windows.windowed(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "1 day").collect()}
    assert got == want and gold.kpi(events, "value").count() == 1
    out = windows.write_batches(windows.cleaned(stream, {"event_type": F.upper("event_type")}), str(tmp_path / "out"), str(tmp_path / "ck"))
    out.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
