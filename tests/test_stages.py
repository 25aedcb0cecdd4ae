import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelyard.plans.compile import align, over_blocks, union_keep_last
from panelyard.plans.nodes import DAILY, Language
from panelyard.plans.stages import run_stages
from panelyard.session import discard, shared_dir, shared_path, stored
from panelyard.sources import cleaning, panels, store
from panelyard.streaming.bars import stream_bars

SF = "/root/testdata/sf0.001"


def test_finished_stages_are_not_run_again(spark):
    folder, calls = shared_path(spark, "run"), []

    def make(name, value):
        def stage(done):
            calls.append(name)
            return spark.range(value if not done else done["a"].count() + value).withColumn("name", F.lit(name))

        return (name, {"value": value}, stage)

    first = run_stages(spark, folder, [make("a", 2), make("b", 3)])
    assert first["b"].count() == 5 and calls == ["a", "b"]
    assert run_stages(spark, folder, [make("a", 2), make("b", 3)])["b"].count() == 5 and calls == ["a", "b"]
    assert run_stages(spark, folder, [make("a", 1), make("b", 3)])["b"].count() == 4 and calls == ["a", "b", "a", "b"]


def test_absent_rows_take_no_place_in_windows_but_null_rows_do(spark):
    day = lambda i: dt.date(2021, 1, 1) + dt.timedelta(days=i)
    kind = "date date, code string, value double"
    x = spark.createDataFrame([(day(i), "A", None if i == 1 else float(i)) for i in range(8) if i != 4], kind)
    y = spark.createDataFrame([(day(i), "A", 1.0) for i in range(9)], kind)
    both = align({"x": x, "y": y})
    flags = {r.date: (r.present_x, r.present_y, r.x) for r in both.collect()}
    assert flags[day(4)] == (False, True, None) and flags[day(1)] == (True, True, None) and len(flags) == 9
    language = Language("blocks", ("x", "y"), frozenset({"daily"}), DAILY.ops)
    got = {r.date: r.factor for r in over_blocks(both, "ts_delay W5 x", language).collect()}
    assert day(4) not in got and got[day(6)] == 0.0 and got[day(7)] is None
    assert {r.date: r.factor for r in over_blocks(both, "add x y", language).collect()}[day(7)] == 8.0


def test_late_rows_replace_and_exposures_are_pruned(spark):
    kind = "date date, code string, value double"
    old = spark.createDataFrame([(dt.date(2020, 1, 1), "A", 1.0), (dt.date(2021, 1, 1), "A", 2.0)], kind)
    new = spark.createDataFrame([(dt.date(2021, 1, 1), "A", 9.0)], kind)
    both = union_keep_last(old, new)
    assert sorted(r.value for r in both.collect()) == [1.0, 9.0]
    path = shared_path(spark, "exposures")
    both.withColumn("year", F.year("date")).write.partitionBy("year").parquet(path)
    picked = store.exposures(spark, path, "2021-01-01", "2021-12-31")
    assert [r.value for r in picked.collect()] == [9.0] and "PartitionFilters: [isnotnull(year" in picked._jdf.queryExecution().executedPlan().toString()


def test_a_stream_gives_the_bars_of_a_batch(spark):
    path = shared_path(spark, "ticks")
    panels.ticks(spark, SF).write.parquet(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    run = stream_bars(source).writeStream.outputMode("append").format("memory").queryName("streamed").option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = {(r.start, r.code): r for r in stream_bars(panels.ticks(spark, SF)).collect()}
    rows = spark.table("streamed").collect()
    assert rows and all(batch[r.start, r.code] == r for r in rows)


def test_time_codes_and_grid(spark):
    one = spark.range(1).select(
        cleaning.minute_of_day(F.lit("2024-01-02 09:31:00"), "text").alias("a"), cleaning.minute_of_day(F.lit("9:31"), "text").alias("b"), cleaning.minute_of_day(F.lit("late"), "text").alias("c"),
        cleaning.minute_of_day(F.lit(34260000), "ms").alias("d"), cleaning.minute_of_day(F.lit(None).cast("long"), "s").alias("e"),
    )
    assert tuple(one.first()) == (571, 571, -1, 571, -1) and cleaning.session_grid(spark).count() == 241


def test_stored_tables_keep_their_schema(spark):
    frame = spark.createDataFrame([(1, None)], "a long, b string")
    assert stored(frame, "x").schema.simpleString() == frame.schema.simpleString() and stored(frame.where("false"), "x").collect() == []
    with pytest.raises(ValueError):
        cleaning.rename(frame)


def test_shared_folder_is_local_only_in_a_local_session(spark):
    path = shared_path(spark, "gone")
    spark.range(3).write.parquet(path)
    discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

    class Conf:
        get = staticmethod(lambda name: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(type("Session", (), {"sparkContext": Context}))
