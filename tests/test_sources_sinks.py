"""Round trips through files: landing, layers, CSV modes, months of a table, records."""

from __future__ import annotations

import datetime as dt
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from starpipe.operators.constraints import LoadRejected
from starpipe.session import shared_folder
from starpipe.sinks import csv as csv_sink
from starpipe.sinks import files, parquet, records, warehouse
from starpipe.sources import dictionaries, landing, layers
from starpipe.sources import records as record_source
from starpipe.spec import Layout


def test_landing_prefers_explicit_then_key_value_then_plain(spark, tmp_path):
    def put(folder, value):
        path = tmp_path / folder
        path.mkdir(parents=True)
        (path / "a.csv").write_text(f"x,y\n{value},\n")
        return str(path / "*.csv")

    def read(explicit=None):
        return landing.read_landing(spark, str(tmp_path), "t", 2021, 3, explicit).first()["x"]

    with pytest.raises(FileNotFoundError, match="2021/03"):
        read()
    put("landing/t/2021/03", "plain")
    assert read() == "plain"
    put("landing/t/year=2021/month=3", "keyed")
    assert read() == "keyed"
    other = put("elsewhere", "explicit")
    assert read(other) == "explicit"
    assert read(str(tmp_path / "nothing/*.csv")) == "keyed"


def test_raw_csv_is_text_and_parts_have_one_header_each(spark, tmp_path):
    (tmp_path / "1.csv").write_text("id,v\n1,1.0\n")
    (tmp_path / "2.csv").write_text("id,v\n2,x\n")
    df = landing.read_csv_text(spark, str(tmp_path))
    assert dict(df.dtypes) == {"id": "string", "v": "string"}
    assert sorted(tuple(r) for r in df.collect()) == [("1", "1.0"), ("2", "x")]


def test_month_is_half_open(spark):
    times = [dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 31, 23, 59, 59, 500000),
             dt.datetime(2021, 2, 1), dt.datetime(2020, 12, 31, 23, 59, 59), None]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    assert landing.month_slice(df, "ts", 2021, 1).count() == 2
    assert landing.month_slice(df, "ts", 2020, 12).count() == 1


def test_new_months(spark):
    df = spark.createDataFrame([(2021, 1, "a"), (2021, 2, "b"), (2022, 1, "c")],
                               "year int, month int, v string")
    seen = df.where("v = 'a'")
    assert {r["v"] for r in landing.new_months(df, seen).collect()} == {"b", "c"}
    assert landing.new_months(df, seen, force=True).count() == 3
    assert landing.select_months(df, [2021, 2022], [1]).count() == 2


def test_months_of_a_partitioned_table_are_pruned_by_a_list(spark, tmp_path):
    """Files of months that the list lacks are broken: reading any of them would fail."""
    df = spark.range(24).select("id", (2020 + F.col("id") % 2).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    root = tmp_path / "t"
    parquet.replace_months(df, str(root))
    for folder in root.glob("year=*/month=*"):
        if folder.name not in ("month=2", "month=4"):
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not parquet")
                (folder / f".{file.name}.crc").unlink()
    wanted = spark.range(6).select(F.lit(2021).alias("year"), (F.col("id") + 1).cast("int").alias("month"), "id").where("id % 2 = 1 AND id < 5")
    picked = landing.in_listed_months(spark.read.schema(df.schema).parquet(str(root)), wanted)
    assert {r["id"] for r in picked.collect()} == {1, 13, 3, 15}
    assert "dynamicpruning" in picked._jdf.queryExecution().executedPlan().toString()
    landed = landing.landed_months(spark, str(root))
    assert sorted(landed) == sorted({(r["year"], r["month"]) for r in df.collect()})
    assert landing.landed_months(spark, str(tmp_path / "nothing")) == []
    more = df.unionByName(spark.createDataFrame([(99, 2022, 1), (100, None, None)], df.schema))
    assert {r["id"] for r in landing.not_landed(more, landed).collect()} == {99, 100}
    assert landing.not_landed(more, landed, force=True).count() == 26
    plan = landing.not_landed(df, landed)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()


def test_layer_falls_back_to_the_folder_without_trial(spark, tmp_path):
    base, trial = Layout(str(tmp_path), "e"), Layout(str(tmp_path), "e", trial=2)
    with pytest.raises(FileNotFoundError, match="trial=2"):
        layers.read_layer(spark, trial, "silver", 2021, 1)
    df = spark.createDataFrame([(1, 1999, 7)], "id int, year int, month int")
    parquet.write_layer(df, base, "silver", 2021, 1)
    row = layers.read_layer(spark, trial, "silver", 2021, 1).first()
    assert tuple(row) == (1, 1999, 7)  # the stored month, not the folder's
    with pytest.raises(FileNotFoundError):
        layers.read_layer(spark, trial, "silver", 2021, 1, fallback=False)
    parquet.write_layer(df.withColumn("id", F.lit(2)), trial, "silver", 2021, 1)
    assert layers.read_layer(spark, trial, "silver", 2021, 1).first()["id"] == 2


def test_rerun_replaces_a_layer_month(spark, tmp_path):
    layout = Layout(str(tmp_path), "e")
    for n in (5, 3):
        path = parquet.write_layer(spark.range(n).toDF("id"), layout, "bronze", 2021, 1, files=2)
    assert spark.read.parquet(path).count() == 3
    assert record_source.file_stats(spark, path, ".parquet").first()["files"] == 2


def test_files_follow_the_argument_alone(spark, tmp_path):
    df = spark.range(100).repartition(4).toDF("id")
    for files, want in ((1, 1), (2, 2), (None, 4)):
        path = str(tmp_path / f"f{files}")
        parquet.write_parquet(df, path, files=files)
        assert record_source.file_stats(spark, path, ".parquet").first()["files"] == want
        assert spark.read.parquet(path).count() == 100


@pytest.mark.parametrize("mode, names", [
    ("single_csv", ("t_2021_01.csv",)),
    ("parallel_parts", ("t_2021_01_part001.csv", "t_2021_01_part002.csv", "t_2021_01_part003.csv")),
    ("parallel_write_then_merge", ("t_2021_01.csv",)),
])
def test_csv_modes(spark, tmp_path, mode, names):
    df = spark.range(90).select("id", F.concat(F.lit("a,\"b\" "), "id").alias("text"))
    for _ in range(2):  # a rerun overwrites
        done = csv_sink.export_csv(df, str(tmp_path / "out"), csv_sink.export_name("t", 2021, 1),
                                   mode, 3)
    assert (done.mode, done.files) == (mode, names)
    back = landing.read_csv_text(spark, done.folder)
    assert {tuple(r) for r in back.collect()} == {(str(i), f'a,"b" {i}') for i in range(90)}
    assert not (tmp_path / "out.__parts").exists()


def test_compressed_parts_hold_the_same_rows(spark, tmp_path):
    """parts may be compressed; a single file may not."""
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), F.col("id").cast("string").alias("id"))
    plain = csv_sink.export_csv(df, str(tmp_path / "plain"), "x", parts=2)
    small = csv_sink.export_csv(df, str(tmp_path / "small"), "x", parts=2, compression="gzip")
    assert small.files == ("x_part001.csv.gz", "x_part002.csv.gz")
    assert sorted(landing.read_csv_text(spark, small.folder).collect()) == sorted(landing.read_csv_text(spark, plain.folder).collect())
    assert files.files_mib(spark, small.folder, small.files) < 0.75 * files.files_mib(spark, plain.folder, plain.files)
    with pytest.raises(ValueError, match="cannot be compressed"):
        csv_sink.export_csv(df, str(tmp_path / "one"), "x", "single_csv", compression="gzip")


def test_unknown_csv_mode(spark, tmp_path):
    with pytest.raises(ValueError):
        csv_sink.export_csv(spark.range(1), str(tmp_path), "t", "zip")


def test_merge_reads_no_part_again(spark, tmp_path, monkeypatch):
    """Parts are joined by the file system, and by one text writer where it cannot; both give the same bytes."""
    df = spark.range(50).select("id", F.concat(F.lit('a,"b"\nsecond line '), "id").alias("te,xt"), F.lit(None).cast("string").alias("e"))

    def merged(folder, frame):
        done = csv_sink.export_csv(frame, str(tmp_path / folder), "t", "parallel_write_then_merge", 4)
        return (tmp_path / folder / done.files[0]).read_text()

    def unwanted(*_):
        raise AssertionError("parts are read as CSV")

    monkeypatch.setattr(landing, "read_csv_text", unwanted)
    joined = merged("joined", df)
    monkeypatch.setattr(csv_sink, "can_join_files", lambda *_: False)
    assert merged("texts", df) == joined and joined.startswith('id,"te,xt",e\n')
    assert merged("empty", df.where("false")) == 'id,"te,xt",e\n'
    monkeypatch.undo()
    assert merged("empty", df.where("false")) == 'id,"te,xt",e\n'
    back = spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "joined"))
    assert back.columns == ["id", "te,xt", "e"] and back.count() == 50


def test_ordered_files(spark, tmp_path):
    """One value holds a third of all rows: it is split over files, and the order still holds."""
    key = F.when(F.col("id") % 3 == 0, 500).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000))).cast("int")
    df = spark.range(30_000).select(key.alias("k"), "id", F.lit(0).alias("tie"))
    parquet.write_ordered(df, str(tmp_path / "o"), ("k",), files=8, group_rows=500)
    row = parquet.order_breaks(spark, str(tmp_path / "o"), ("k",)).first()
    assert tuple(row) == (30_000, 8, 0, 0)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "o")).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 30_000 / 4
    assert spark.read.parquet(str(tmp_path / "o")).columns == ["k", "id", "tie"]
    parquet.write_parquet(df.repartition(3), str(tmp_path / "u"))
    assert parquet.order_breaks(spark, str(tmp_path / "u"), ("k",)).first()["rows_out_of_order"] > 1000


def test_part_times_of_a_load(spark, sf_dir):
    from starpipe.catalog import registry

    whole = registry.load_part_times(spark, sf_dir).first()
    assert whole["parts"] > 0 and whole["copy_sec_max"] <= whole["copy_sec_sum"]


@pytest.fixture
def months(spark):
    return spark.createDataFrame(
        [(i, 2021, 1 + i % 2, "Y") for i in range(10)], "id int, year int, month int, flag string")


def test_load_replaces_one_month_or_nothing(spark, tmp_path, months):
    fact = month_table(spark, tmp_path, months)
    january = months.where("month = 1").withColumn("id", F.col("id") + 100)

    def load(df, month):
        return warehouse.load_month(df, fact, 2021, month, flag="flag", allowed=("Y", "N"))

    assert load(january, 1).rows_loaded == 5
    table = fact.read()
    assert {r["id"] for r in table.collect()} == {100, 102, 104, 106, 108, 1, 3, 5, 7, 9}
    assert table.select("trip_id").distinct().count() == 10
    assert table.where("load_dt IS NULL").count() == 0
    before = sorted(map(str, table.collect()))
    for stray in (months, january.withColumn("flag", F.lit("X"))):
        with pytest.raises(LoadRejected):
            load(stray, 1)
    assert sorted(map(str, fact.read().collect())) == before
    fact.drop()


def test_a_write_that_dies_leaves_the_month(spark, tmp_path, months):
    """Half of the new version is written when its other half fails; readers never see it."""
    fact = month_table(spark, tmp_path, months)
    before = sorted(map(str, fact.read().collect()))
    kept = fact.current(2021, 1)
    january = warehouse.stamp(months.where("month = 1").repartition(2, F.col("id") > 3))
    dying = january.withColumn("flag", F.when(F.col("id") > 3, F.raise_error(F.lit("killed"))).otherwise(F.lit("N")))
    with pytest.raises(Exception, match="killed"):
        fact.replace(dying, 2021, 1)
    assert sorted(map(str, fact.read().collect())) == before and fact.current(2021, 1) == kept
    written = fact.write_version(january, 2021, 1)  # a load that dies just before its switch
    assert sorted(map(str, fact.read().collect())) == before
    assert fact.complete(2021, 1) == [kept, written] and len(fact.versions(2021, 1)) == 3
    fact.drop()
    again = warehouse.open_months(spark, "fact_again", str(tmp_path / "fact"), warehouse.stamp(months).schema)
    assert again.current(2021, 1) == written  # without a catalogue the latest complete version counts
    again.drop()


def test_superseded_versions_go(spark, tmp_path, months):
    fact = month_table(spark, tmp_path, months)
    january = months.where("month = 1")
    reader, files = fact.read().where("month = 1"), None
    for n in range(3):
        if n == 1:
            reader = fact.read().where("month = 1")
            files = reader.inputFiles()
        fact.replace(warehouse.stamp(january.withColumn("id", F.col("id") + 10 * n)), 2021, 1)
    assert len(fact.versions(2021, 1)) == 2 and files
    assert {r["id"] for r in fact.read().where("month = 1").collect()} == {20, 22, 24, 26, 28}
    fact.drop()


def month_table(spark, tmp_path, months):
    stamped = warehouse.stamp(months)
    fact = warehouse.open_months(spark, f"fact_{abs(hash(str(tmp_path)))}", str(tmp_path / "fact"), stamped.schema)
    fact.replace_months(stamped)
    return fact


def test_month_scan_prunes_partitions(spark, tmp_path, months):
    path = str(tmp_path / "fact")
    parquet.replace_months(months, path)
    warehouse.register(spark, "months_table", path)
    try:
        df = layers.month_of_table(spark, "months_table", 2021, 2)
        assert df.count() == 5
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(year" in plan
        warehouse.analyze(spark, "months_table", 2021, 2)
    finally:
        spark.sql("DROP TABLE months_table")


def test_shared_folder_needs_a_shared_setting_on_a_cluster(spark, monkeypatch):
    assert shared_folder(spark, "a") != shared_folder(spark, "a")

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(), "a")


def test_details_keep_their_types(spark):
    record = {"step": "export", "rows_in": 5, "spark_conf": {"aqe": True}, "app_id": "x",
              "copy_times_sec": [1.5, 2], "wall_sec": None}
    df = spark.createDataFrame([(json.dumps(record),), ('{"step": "bronze"}',)], "record string")
    rows = {r["step"]: r for r in records.bench_rows(df, "e", "r").collect()}
    assert json.loads(rows["export"]["details"]) == {"app_id": "x", "copy_times_sec": [1.5, 2]}
    assert json.loads(rows["export"]["spark_conf"]) == {"aqe": True}
    assert rows["export"]["rows_in"] == 5 and rows["export"]["wall_sec"] is None
    assert rows["bronze"]["details"] is None and rows["bronze"]["experiment_id"] == "e"


def test_metrics_files_of_several_lines_and_the_fallback_path(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"step": "bronze", "k": 1}, indent=2))
    paths = [str(tmp_path / "absent.json"), str(tmp_path / "m.json")]
    assert record_source.read_metrics(spark, paths).first()["step"] == "bronze"
    texts = record_source.read_metric_texts(spark, paths)
    assert records.bench_rows(texts, "e", "r").first()["details"] == '{"k":1}'
    with pytest.raises(FileNotFoundError):
        record_source.read_metrics(spark, paths[:1])


def test_report_texts(spark):
    df = spark.createDataFrame([("s", "b", 1.5, None, "OK"), ("s", "a", 2.0, 1.0, "FAIL")],
                               "step string, rule string, value_num double, threshold double, status string")
    assert [tuple(r) for r in records.quality_report(df).collect()] == [
        ("s", "a", "2.000000", "1.0", "FAIL"), ("s", "b", "1.500000", "", "OK")]


def test_an_empty_month_empties_the_table_month(spark, tmp_path, months):
    fact = month_table(spark, tmp_path, months)
    done = warehouse.load_month(months.where("false"), fact, 2021, 1, flag="flag", allowed=("Y",))
    assert done.rows_loaded == 0
    assert {r["month"] for r in fact.read().collect()} == {2}
    fact.drop()


def test_surrogate_keys_have_no_task_limit(spark):
    """Row numbers are dense whatever the task, and months out of range are refused."""
    rows = warehouse.numbered(spark.range(1000).repartition(7).toDF("id"), "row").collect()
    assert sorted(r["row"] for r in rows) == list(range(1000))
    key = warehouse.surrogate_key(F.lit(2021), F.lit(1), F.col("id"))
    beyond = spark.range((1 << 51) - 1, 1 << 51).select(key.alias("k")).first()["k"]  # of task 2^18 and more before
    assert beyond >> 51 == (2021 - 1970) * 12 + 1
    for year, row in ((1969, 0), (2400, 0), (2021, 1 << 51)):
        with pytest.raises(Exception, match="surrogate"):
            spark.range(1).select(warehouse.surrogate_key(F.lit(year), F.lit(1), F.col("id") + F.lit(row))).collect()


def test_zones_with_a_byte_order_mark(spark, tmp_path):
    path = tmp_path / "zones.csv"
    path.write_bytes(b"\xef\xbb\xbf" + b'"LocationID","Borough","Zone","service_zone"\n7,"B","Z, west","N/A"\n')
    assert tuple(dictionaries.read_dictionary(spark, "zones", str(path)).first()) == (7, "B", "Z, west", "N/A")


def test_second_application_has_a_whole_log(spark, sf_dir, monkeypatch):
    """Reading both logs in place of one would double every figure."""
    from starpipe.catalog import registry

    roots, read = [], record_source.read_event_log
    monkeypatch.setattr(registry.record_source, "read_event_log", lambda s, root, app: roots.append(root) or read(s, root, app))
    registry.event_log_two_applications(spark, sf_dir)
    one, ten = (sorted(r["value"] for r in spark.read.text(f"{roots[0]}/{app}").collect()) for app in ("app-1", "app-10"))
    assert one == ten and len(one) > 5


def test_event_log_of_a_missing_application(spark, tmp_path):
    stats = record_source.event_log_stats(
        record_source.read_event_log(spark, str(tmp_path), "app-0")).first().asDict()
    assert stats.pop("skew_factor") is None
    assert set(stats.values()) == {0}


def test_files_are_sorted_each_by_itself(spark, tmp_path):
    df = spark.range(1000).select(F.pmod(F.hash("id"), F.lit(997)).alias("k"), "id").repartition(3)
    parquet.write_parquet(df, str(tmp_path / "s"), codec="zstd", sort_by=("k",))
    files = list((tmp_path / "s").glob("*.zstd.parquet"))
    assert len(files) == 3
    for file in files:
        keys = [r["k"] for r in spark.read.parquet(str(file)).collect()]
        assert keys == sorted(keys)


def test_large_ordered_files_come_in_pieces(spark, tmp_path, monkeypatch):
    """no task gets a whole file of a large table; files and order stay."""
    monkeypatch.setattr(parquet, "PIECE_ROWS", 1000)
    df = spark.range(30_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int").alias("k"), "id")
    parquet.write_ordered(df, str(tmp_path / "o"), ("k",), files=8)
    assert tuple(parquet.order_breaks(spark, str(tmp_path / "o"), ("k",)).first()) == (30_000, 8, 0, 0)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "o")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 32 and max(sizes) < 2000
    parquet.rename(spark, str(tmp_path / "o"), {"file-00000-piece-00000.parquet": "file-00009-piece-00000.parquet"})
    assert parquet.order_breaks(spark, str(tmp_path / "o"), ("k",)).first()["files_out_of_order"] == 1


def test_single_csv_is_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """the rows of a single file are not gathered by one task."""
    written = []
    monkeypatch.setattr(csv_sink, "join_files", lambda s, first, parts, f=csv_sink.join_files: (written.extend(parts), f(s, first, parts)))
    done = csv_sink.export_csv(spark.range(90).repartition(5), str(tmp_path / "out"), "t", "single_csv")
    assert (done.mode, done.files, len(written)) == ("single_csv", ("t.csv",), 5)
    assert sorted(int(r["id"]) for r in landing.read_csv_text(spark, done.folder).collect()) == list(range(90))


def test_places_of_rows_in_order(spark, sf_dir, tmp_path):
    """rows of an ordered folder get their places where they lie, not in one task."""
    from starpipe.catalog import frames

    ordered = spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id")
    parquet.write_parquet(ordered, str(tmp_path / "o"))
    placed = parquet.in_places(spark, str(tmp_path / "o"), "place")
    assert placed.where("place <> id + 1").count() == 0 and placed.count() == 1000
    assert record_source.partition_count(frames.metric_records(spark, sf_dir)) >= spark.sparkContext.defaultParallelism


def test_parts_of_a_layer_have_each_file_once(spark, tmp_path, monkeypatch):
    """F1 to F4: a large layer is worked on in a bounded number of parts of whole files."""
    path = f"{tmp_path}/a b%20c/month=1"
    spark.range(1000).repartition(20).write.parquet(path)
    whole = spark.read.parquet(path)
    assert layers.in_parts(whole) == [whole]  # small
    monkeypatch.setattr(layers, "PART_MIB", 1e-6)
    parts = layers.in_parts(whole)
    assert len(parts) == layers.PARTS and all(p.schema == whole.schema for p in parts)
    read = [f for p in parts for f in p.inputFiles()]
    assert sorted(read) == sorted(whole.inputFiles()) and len(set(read)) == 20
    assert sorted(r["id"] for p in parts for r in p.collect()) == list(range(1000))
    spark.range(0).write.parquet(f"{tmp_path}/none")
    assert len(layers.in_parts(spark.read.parquet(f"{tmp_path}/none"))) == 1


def test_frames_written_in_turn_appear_together(spark, tmp_path):
    """a write that dies after some of its parts leaves no folder that could be taken for the whole."""
    path = f"{tmp_path}/layer/month=1"
    spark.range(3).write.parquet(path)

    def parts(dies):
        yield spark.range(5)
        assert not Path(path).exists()
        yield spark.range(5, 9).withColumn("id", F.raise_error(F.lit("killed")).cast("long")) if dies else spark.range(5, 9)

    with pytest.raises(Exception, match="killed"):
        parquet.write_in_turn(spark, parts(True), path)
    assert os.listdir(tmp_path / "layer") == []
    parquet.write_in_turn(spark, parts(False), path, codec="zstd")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(9))
    assert os.listdir(tmp_path / "layer") == ["month=1"]
