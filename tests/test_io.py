"""Sinks, the remote source, upsert versions, streams against batches, model round trips."""

import datetime as dt

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from ticklane.operators import ml
from ticklane.plans import label_queries, ml_queries, trade_queries
from ticklane.sources import remote, sinks
from ticklane.sources.bars import bars_from_lineitem
from ticklane.streaming import events, incremental, positions

DAY = dt.date(2024, 1, 1)


def test_save_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "code string, x double")
    paths = sinks.save_tables({"trades": df, "none": None}, str(tmp_path), "csv")
    assert len(paths) == 1 and spark.read.option("header", True).csv(paths[0]).first().code == "a"


def test_upsert_versions(spark, tmp_path):
    kind = "code string, date date, close double"
    path = str(tmp_path / "bars")
    sinks.upsert_table(spark, path, spark.createDataFrame([("a", DAY, 1.0), ("b", DAY, 2.0)], kind))
    last = sinks.upsert_table(spark, path, spark.createDataFrame([("a", DAY, 9.0)], kind))
    assert last.endswith("/v2") and {(r.code, r.close) for r in spark.read.parquet(last).collect()} == {("a", 9.0), ("b", 2.0)}


def test_positions_round_trip(spark, tmp_path):
    kind = "code string, status string, entry_date date, entry_price double, out_counter int, last_signal_date date"
    sinks.save_positions(spark.createDataFrame([("a", None, DAY, 1.0, None, None)], kind), str(tmp_path / "p"))
    row = sinks.load_positions(spark, str(tmp_path / "p")).first()
    assert (row.status, row.out_counter) == ("OPEN", 0)


def test_remote_bars(spark):
    df = remote.remote_bars(spark, ["000001", "600000"], "2024-01-01", "2024-01-31")
    assert {(r.code, r.n) for r in df.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()} == {("000001", 23), ("600000", 23)}
    assert df.where("low > least(open, close) OR high < greatest(open, close)").count() == 0
    with pytest.raises(Exception, match="no_such"):
        remote.remote_bars(spark, ["1"], "2024-01-01", "2024-01-02", fetch="ticklane.sources.remote:no_such").count()


def test_stream_equals_batch(spark):
    batch = events.tumbling(events.scan(spark, SMALL))
    assert sorted(map(tuple, events.stream_tumbling(spark, SMALL).collect())) == sorted(map(tuple, batch.collect()))


def test_stream_upsert_keeps_one_row_a_key(spark):
    out = label_queries.QUERIES["stream_upsert"](spark, SMALL)
    assert out.count() == out.select("code", "date").distinct().count() == bars_from_lineitem(spark, SMALL).count()


def test_upsert_sink_goes_on_after_a_restart(spark, tmp_path):
    kind = "code string, date date, close double, seen int"
    row = lambda k, close, seen: (f"c{k}", DAY, close, seen)
    base = str(tmp_path / "t")
    incremental.UpsertSink(spark, ["code", "date"], base, ["seen"])(spark.createDataFrame([row(k, 1.0, 0) for k in range(5)], kind), 0)
    again = incremental.UpsertSink(spark, ["code", "date"], base, ["seen"])  # a new object, as after a restart
    fresh = spark.createDataFrame([row(4, 3.0, 1), row(4, 2.0, 2), *(row(k, 1.0, 0) for k in range(5, 10))], kind)
    for _ in range(2):  # a batch that is run again gives the same table
        again(fresh, 1)
        got = {r.code: r.close for r in spark.read.parquet(again.version(spark)).collect()}
        assert len(got) == 10 and got["c4"] == 2.0 and again.version(spark).endswith("/v1")


def test_new_samples_take_all_of_a_new_code(spark):
    rows = spark.createDataFrame([(c, DAY + dt.timedelta(days=k), float(k)) for c in "ab" for k in range(4)], "code string, date date, close double")
    have = rows.where("code = 'a' AND close <= 1").select("code", "date")
    got = sorted((r.code, r.close) for r in incremental.new_samples(rows, have).collect())
    assert got == [("a", 2.0), ("a", 3.0), ("b", 0.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)]
    made = sorted((r.code, r.date.day, r.label, r.day1_close) for r in incremental.new_windows(rows, have, ["close"], 2, 1, 0.5).collect())
    assert made == [("a", 3, 1, 1.0), ("b", 2, 1, 0.0), ("b", 3, 1, 1.0)]


def test_walk_forward_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5, 0.1), (2, "a", 0.7, 0.3), (1, "b", 0.9, 0.0)], "window_id int, variant string, hit_rate double, expectancy double")
    one, two = sinks.save_walk_forward(df, str(tmp_path))
    assert spark.read.parquet(one).count() == 3
    assert [(r.variant, round(r.hit_rate, 6)) for r in spark.read.parquet(two).orderBy(F.col("hit_rate").desc()).collect()] == [("b", 0.9), ("a", 0.6)]


PREDS = "code string, date date, open double, pred_mae double, on_top boolean"


def put(spark, folder, rows):
    spark.createDataFrame(rows, PREDS).coalesce(1).write.mode("append").parquet(str(folder))


def orders_of(spark, tmp_path, name, files, held=None):
    """Orders of the files, each taken by a run of its own from the same checkpoint; then of all of them in one run."""
    schema = spark.createDataFrame([], PREDS).schema
    found = []
    for way, parts in (("apart", [[f] for f in files]), ("whole", [files])):
        base = tmp_path / f"{name}-{way}"
        for part in parts:
            for rows in part:
                put(spark, base / "in", rows)
            out = positions.run_to_end(spark, str(base / "in"), schema, str(base / "orders"), str(base / "checkpoint"), held)
        found.append(sorted(((r.code, r.date, r.side, r.reason, r.price) for r in out.collect()), key=str))
    assert found[0] == found[1]
    return found[0]


def test_position_orders_follow_the_rules(spark, tmp_path):
    days = [DAY + dt.timedelta(days=k) for k in range(7)]
    tops = [True, True, False, False, True, True, False]
    mae = [-0.01, -0.01, -0.01, -0.01, -0.01, -0.01, -0.09]
    rows = [("a", d, 10.0 + k, m, t) for k, (d, m, t) in enumerate(zip(days, mae, tops, strict=True))]
    got = orders_of(spark, tmp_path, "rules", [rows[:3], rows[3:5], rows[5:]])
    assert [x[1:] for x in got] == [(days[1], "BUY", "enter_topcap", 11.0), (days[3], "SELL", "out_of_topcap", 13.0), (days[5], "BUY", "enter_topcap", 15.0), (days[6], "SELL", "risk_hard_stop", 16.0)]


def test_pending_entries_lapse(spark, tmp_path):
    at = lambda k: DAY + dt.timedelta(days=k)
    top = lambda code, k, on=True: (code, at(k), 10.0, -0.01, on)
    held = spark.createDataFrame([("p", "PENDING_ENTRY", at(0), 0), ("o", "OPEN", at(0), 1), ("q", "PENDING_ENTRY", at(0), 0)], "code string, status string, since date, out_counter int")
    files = [[top("b", 0), top("c", 0), top("z", 1, False), top("o", 1, False), top("q", 3, False)], [top("z", 9, False), top("c", 12)], [top("z", 20, False), top("c", 13), top("z", 21)]]
    got = orders_of(spark, tmp_path, "lapse", files, held)
    # b never comes again, c comes too late and is signalled anew, p is only in the table, z still waits at the end
    assert got == sorted([
        ("b", at(7), "CANCEL", "entry_lapsed", None), ("c", at(7), "CANCEL", "entry_lapsed", None), ("c", at(13), "BUY", "enter_topcap", 10.0), ("p", at(7), "CANCEL", "entry_lapsed", None),
        ("o", at(1), "SELL", "out_of_topcap", 10.0), ("q", at(3), "BUY", "enter_topcap", 10.0)], key=str)


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("data/**/*.parquet")}


def test_upserts_write_the_months_they_touch(spark, tmp_path):
    kind = "code string, date date, close double"
    path, rows = str(tmp_path / "t"), [(f"c{k}", dt.date(2023, m, 5), float(m)) for m in range(1, 13) for k in range(50)]
    assert sinks.upsert_months(spark, path, spark.createDataFrame(rows, kind)) == [202300 + m for m in range(1, 13)]
    before = files_of(tmp_path / "t")
    fresh = spark.createDataFrame([("c1", dt.date(2023, 3, 5), -1.0), ("new", dt.date(2023, 3, 9), -2.0), ("new", dt.date(2024, 1, 1), -3.0), ("none", None, 0.0)], kind)
    for _ in range(2):  # a run that is made again changes no row
        assert sinks.upsert_months(spark, path, fresh) == [None, 202303, 202401]
        after = files_of(tmp_path / "t")
        assert {f for f in before if before[f] == after.get(f)} == {f for f in before if "ym=202303" not in f}
        got = {(r.code, r.date): r.close for r in sinks.read_months(spark, path).collect()}
        assert len(got) == 603 and got["c1", dt.date(2023, 3, 5)] == -1.0 and got["c2", dt.date(2023, 3, 5)] == 3.0 and got["none", None] == 0.0
    assert sinks.upsert_months(spark, path, fresh.limit(0)) == []
    with pytest.raises(ValueError, match="must be one of the keys"):
        sinks.upsert_months(spark, path, fresh, ("code",))


def test_upserts_survive_a_run_that_dies(spark, tmp_path, monkeypatch):
    kind = "code string, date date, close double"
    path = str(tmp_path / "t")
    sinks.upsert_months(spark, path, spark.createDataFrame([("a", DAY, 1.0), ("b", DAY, 2.0)], kind))
    fresh = spark.createDataFrame([("a", DAY, 9.0)], kind)
    replace, calls = sinks._overwrite_months, []

    def dies(*args):
        calls.append(1)
        if len(calls) > 1:  # the journal is written
            raise RuntimeError("lost")
        return replace(*args)

    monkeypatch.setattr(sinks, "_overwrite_months", dies)
    with pytest.raises(RuntimeError, match="lost"):
        sinks.upsert_months(spark, path, fresh)
    monkeypatch.setattr(sinks, "_overwrite_months", replace)
    for f in (tmp_path / "t" / "data").rglob("*.parquet"):
        f.unlink()  # as if it died between deleting the old month and putting the new one
    assert {(r.code, r.close) for r in sinks.read_months(spark, path).collect()} == {("a", 9.0), ("b", 2.0)}
    spark.createDataFrame([("a", DAY, 5.0, 202401)], kind + ", ym int").write.partitionBy("ym").parquet(f"{path}/_journal")
    (tmp_path / "t" / "_journal" / "_SUCCESS").unlink()  # a journal that is not whole counts for nothing
    assert {(r.code, r.close) for r in sinks.read_months(spark, path).collect()} == {("a", 9.0), ("b", 2.0)}


def test_month_sink_goes_on_after_a_restart(spark, tmp_path):
    kind = "code string, date date, close double, seen int"
    row = lambda k, close, seen: (f"c{k}", DAY, close, seen)
    make = lambda: incremental.UpsertSink(spark, ["code", "date"], str(tmp_path / "t"), ["seen"], "date")
    make()(spark.createDataFrame([row(k, 1.0, 0) for k in range(5)], kind), 0)
    fresh = spark.createDataFrame([row(4, 3.0, 1), row(4, 2.0, 2), *(row(k, 1.0, 0) for k in range(5, 10))], kind)
    for _ in range(2):
        make()(fresh, 1)
        got = {r.code: r.close for r in sinks.read_months(spark, str(tmp_path / "t")).collect()}
        assert len(got) == 10 and got["c4"] == 2.0


def test_model_round_trip(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") > 100).cast("int").alias("y"))
    model = ml.train_classifier(df, ["a", "b"], "y", "logistic")
    sinks.save_model(model, str(tmp_path / "m"), ["a", "b"], {"auc": 1.0})
    loaded, features, report = sinks.load_model(spark, str(tmp_path / "m"))
    one, two = (sorted(map(tuple, ml.score(m, df, features, ["a"]).collect())) for m in (model, loaded))
    assert one == two and report == {"auc": 1.0} and one[0][1] < 0.5 < one[-1][1]


def test_quantile_model_covers(spark):
    df = spark.range(600).select((F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 50 + F.pmod(F.col("id") * 37, F.lit(100)) / 10).alias("y"))
    out = ml.predict_quantile(ml.train_quantile(df, ["a"], "y", 0.8), df, ["a"], "q")
    assert 0.72 < out.agg(F.avg((F.col("y") <= F.col("q")).cast("double"))).first()[0] < 0.88


def test_random_settings_are_seeded():
    assert ml.sample_configs(3) == ml.sample_configs(3) and ml.sample_configs(2, 1) != ml.sample_configs(2, 2)


def test_registered_names_do_not_clash():
    assert not set(ml_queries.QUERIES) & set(trade_queries.QUERIES) and not set(label_queries.QUERIES) & set(trade_queries.QUERIES)


def test_a_run_is_saved_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "runs")
    one = spark.createDataFrame([("a", 1.0)], "code string, x double")
    assert sinks.load_run(spark, folder) == {}
    assert sinks.save_run(spark, {"trades": one, "orders": one}, folder).endswith("/v1")
    dies = one.withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.save_run(spark, {"trades": one.withColumn("x", F.lit(2.0)), "orders": dies, "equity": one}, folder)
    assert sinks.version_numbers(spark, folder) == [1] and sinks.load_run(spark, folder)["trades"].first().x == 1.0
    assert sinks.save_run(spark, {"trades": one.withColumn("x", F.lit(3.0))}, folder).endswith("/v2")
    found = sinks.load_run(spark, folder)
    assert set(found) == {"trades"} and found["trades"].first().x == 3.0


def test_padded_days_do_not_change_results(spark, tmp_path):
    from ticklane.functions import lookback
    from ticklane.functions.base import lead, sma

    at = lambda k: DAY + dt.timedelta(days=k)
    rows = [(c, at(k), float(k * 7 % 11 + i)) for i, c in enumerate("abcd") for k in range(120) if not (c == "b" and 30 <= k < 58) and not (c == "c" and k < 62) and not (c == "d" and k > 40)]
    path = str(tmp_path / "bars")
    spark.createDataFrame(rows, "code string, date date, close double").repartitionByRange(12, "date").sortWithinPartitions("date").write.parquet(path)
    table = spark.read.parquet(path)
    make = lambda df: df.withColumns({"m": sma("close", 5), "next": lead("close", 3)})
    first, last = at(60), at(70)
    found = lookback.within(table, first, last, make, 4, 3)
    whole = make(table).where(F.col("date").between(F.lit(first), F.lit(last)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str) and whole.count() == 31
    part = lookback.padded(table, first, last, 4, 3)
    ends = part.agg(F.min("date"), F.max("date")).first()
    assert tuple(ends) == (at(28), at(73))  # b has its fourth row before the span at day 28
    assert "PushedFilters: [IsNotNull(date), " in part._jdf.queryExecution().executedPlan().toString()
    assert lookback.padded(table, first, last, None).agg(F.min("date")).first()[0] == at(0)
    assert lookback.padded(table, at(200), at(210), 4, 3).count() == 0
    assert lookback.reach("rsi", "ret_mae") == (14, 20) and lookback.reach("rsi", "indicator_panel") == (None, 0)
