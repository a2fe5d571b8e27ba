"""The monthly steps end to end over one month of trips, and the event log they leave."""

from __future__ import annotations

import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import pytest

from starpipe import trips
from starpipe.operators.constraints import LoadRejected
from starpipe.operators.quality import QualityGateError
from starpipe.plans import steps
from starpipe.sinks.parquet import write_layer
from starpipe.sources.layers import read_dictionaries
from starpipe.spec import GatePolicy, Layout, RunSettings

CSV = {
    "vendor": "vendor_id,vendor_name\n1,One\n2,Two\n99,None known\n",
    "ratecode": "ratecode_id,description\n1,Standard\n99,Unknown\n",
    "payment_type": "payment_type_id,description\n1,Card\n5,Unknown\n",
    "store_flag": "store_flag,description\nY,stored\nN,direct\nU,unknown",
    "zones": 'LocationID,Borough,Zone,service_zone\n1,B1,Z1,s\n2,B2,Z2,s\n',
}
TRIPS_CSV = """VendorID,tpep_pickup_datetime,tpep_dropoff_datetime,passenger_count,trip_distance,RatecodeID,store_and_fwd_flag,PULocationID,DOLocationID,payment_type,fare_amount,total_amount
1,2021-01-01 00:00:00,2021-01-01 00:10:00,1,2.5,1,N,1,2,1,10,12
2,2021-01-31 23:59:59,2021-02-01 00:10:00,2.0,0,1.0,Y,2,1,1,10,12
,2021-01-15 12:00:00,2021-01-15 12:00:00,,1,,,1,1,,5,-6
1,2021-01-01 00:00:00,2021-01-01 00:10:00,1,2.5,1,N,1,2,1,10,12
"""


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("month")
    paths = {}
    for name, text in CSV.items():
        paths[name] = str(root / f"{name}.csv")
        Path(paths[name]).write_text(text)
    folder = root / "landing" / "trips" / "2021" / "01"
    folder.mkdir(parents=True)
    (folder / "trips.csv").write_text(TRIPS_CSV)
    layout = Layout(str(root), "exp", trial=1)
    steps.init_dimensions(spark, layout, paths)
    month = steps.Run(spark, layout, 2021, 1, policy=GatePolicy(trips.GATE.limits, ()))
    assert steps.to_bronze(month, "trips").rows_out == 4
    assert steps.to_silver(month).rows_out == 4
    assert steps.to_wide(month).rows_out == 4
    return month


def test_layers(run):
    assert set(dict(run.layer("bronze").dtypes).values()) == {"string"}
    silver = run.layer("silver")
    assert silver.columns == list(trips.SILVER_COLUMNS)
    wide = run.layer("silver_wide")
    assert len(wide.columns) == 39
    row = wide.where("vendor_id = 2").first()
    assert (row["pu_zone_name"], row["do_borough"], row["pickup_iso_dow"], row["dropoff_iso_dow"],
            row["store_flag_desc"]) == ("Z2", "B1", 7, 1, "stored")


def test_quality_of_the_month(run):
    row = steps.silver_quality(run.layer("silver")).first()
    assert (row["rows_total"], row["duplicate_key_pct"], row["negative_total_pct"],
            row["zero_distance_pct"], row["zero_duration_pct"]) == (4, 25.0, 25.0, 25.0, 25.0)
    rules = list(trips.GATE.limits["dq_silver"])
    stored = steps.check(run, "dq_silver", steps.silver_quality(run.layer("silver")), rules)
    assert stored.count() == 10 and stored.where("status = 'FAIL'").count() == 4
    strict = steps.Run(run.spark, run.layout, 2021, 1, run_id="strict")
    with pytest.raises(QualityGateError, match="duplicate_key_pct"):
        steps.check(strict, "dq_silver", steps.silver_quality(run.layer("silver")), rules)
    join_rules = list(trips.GATE.limits["dq_join"])
    joined = steps.check(strict, "dq_join", steps.join_quality(run.layer("silver_wide")), join_rules)
    assert joined.where("value_num = 0").count() == 5


@pytest.mark.parametrize("mode, files", [
    ("single_csv", 1), ("parallel_parts", 3), ("parallel_write_then_merge", 3)])
def test_export_and_load(run, mode, files):
    month = steps.Run(run.spark, run.layout, 2021, 1,
                      settings=RunSettings(export_mode=mode, files_per_month=files))
    record, done = steps.to_export(month)
    assert record.rows_out == 4
    back = steps.read_export(run.spark, done.folder, trips.TRIPS)
    assert back.columns == list(trips.EXPORT_COLUMNS)
    dims = read_dictionaries(run.spark, run.layout, steps.DICTIONARIES)
    assert steps.load(month, done, dims).rows_loaded == 4
    fact = month.fact().read()
    quality = steps.load_quality(fact, steps.F.lit(4)).first()
    assert (quality["rowcount_mismatch_pct"], quality["negative_total_pct"]) == (0.0, 25.0)


def test_load_rejects_an_unknown_key(run):
    _, done = steps.to_export(run)
    dims = read_dictionaries(run.spark, run.layout, steps.DICTIONARIES)
    dims["vendor"] = dims["vendor"].where("vendor_id <> 99")
    with pytest.raises(LoadRejected, match="rows_unknown_vendor_id=1"):
        steps.load(run, done, dims)


def test_a_refused_load_writes_nothing(run, monkeypatch):
    """an export is checked where it lies, so that a load that is refused writes no rows."""
    from starpipe.sinks import warehouse

    _, done = steps.to_export(run)
    dims = read_dictionaries(run.spark, run.layout, steps.DICTIONARIES)
    steps.load(run, done, dims)
    before, written = run.fact().current(2021, 1), []
    monkeypatch.setattr(warehouse, "write_parquet", lambda *a, **k: written.append(a))
    dims["vendor"] = dims["vendor"].where("vendor_id <> 99")
    with pytest.raises(LoadRejected, match="rows_unknown_vendor_id=1"):
        steps.load(run, done, dims)
    assert not written and run.fact().current(2021, 1) == before and run.fact().read().count() == 4


def test_keys_of_the_trips_are_read_once(spark, sf_dir):
    """the dimensions of a load do not derive their keys from all trips whenever they are read."""
    from starpipe.catalog import frames

    dims = frames.known_dictionaries(spark, sf_dir)
    for name in ("payment_type", "ratecode", "vendor", "store_flag"):
        assert not [f for f in dims[name].inputFiles() if "lineitem" in f]


def test_presets_differ_only_in_how(run):
    rows = sorted(map(str, run.layer("silver_wide").collect()))
    for name, settings in trips.PRESETS.items():
        layout = Layout(run.layout.root, name)
        other = steps.Run(run.spark, layout, 2021, 1, settings=settings)
        steps.to_bronze(other, "trips")
        steps.to_silver(other)
        steps.to_wide(other)
        assert sorted(map(str, other.layer("silver_wide").collect())) == rows


def test_steps_apply_their_settings_and_restore_them(run, monkeypatch):
    seen = {}

    def spy(df, spec):
        seen.update({k: run.spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")})
        return df

    monkeypatch.setattr(steps, "to_silver_rows", spy)
    before = run.spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(steps, "write_layer", lambda df, layout, layer, *a, **k: write_layer(df, Layout(
        layout.root, "settings"), layer, *a, **k))
    steps.to_silver(replace(run, settings=RunSettings(aqe=False, shuffle_partitions=17)))
    assert seen == {"spark.sql.shuffle.partitions": "17", "spark.sql.adaptive.enabled": "false"}
    assert run.spark.conf.get("spark.sql.shuffle.partitions") == before


def test_dimension_keys_are_checked(spark, tmp_path):
    path = tmp_path / "vendor.csv"
    path.write_text("vendor_id,vendor_name\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="vendor"):
        steps.init_dimensions(spark, Layout(str(tmp_path), "e"), {"vendor": str(path)})


EVENT_LOG_JOB = """
import sys
from starpipe.session import build_session
spark = build_session("logged", "local[2]", event_log_dir="file://" + sys.argv[1],
                      extra={"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
spark.range(1000).selectExpr("xxhash64(id) AS k").groupBy("k").count().write.format("noop").mode("overwrite").save()
print("APP", spark.sparkContext.applicationId)
spark.stop()
"""


def test_statistics_of_a_real_event_log(spark, tmp_path):
    from starpipe.sources.records import event_log_stats, read_event_log

    done = subprocess.run([sys.executable, "-c", EVENT_LOG_JOB, str(tmp_path)], text=True,
                          capture_output=True, timeout=300, check=True,
                          cwd=Path(__file__).resolve().parents[1])
    app = next(line.split()[1] for line in done.stdout.splitlines() if line.startswith("APP"))
    stats = event_log_stats(read_event_log(spark, str(tmp_path), app)).first()
    assert stats["tasks_total"] >= 3 and stats["stages"] >= 2
    assert stats["executor_run_time_ms"] > 0 and stats["skew_factor"] >= 1
    assert stats["shuffle_write_mb"] > 0


def test_only_the_last_layer_stays_on_disk(spark, sf_dir, monkeypatch, tmp_path):
    """the layers that no later step reads go as soon as they are read, and so does what a load staged."""
    from starpipe.catalog import registry

    root = tmp_path / "pipe"
    monkeypatch.setattr(registry, "shared_folder", lambda _, purpose: str(root if purpose == "pipe" else tmp_path / f"{purpose}-x"))
    assert registry.pipe_gates(spark, sf_dir).count() == 21
    left = {p.relative_to(root).parts[0] for p in root.rglob("part-*.*")}
    assert left <= {"ref", "metrics", "warehouse"}
    assert not list((root / "warehouse" / "fact_trips").rglob("*.parquet"))


def test_a_loaded_month_is_read_without_a_copy(spark, sf_dir, monkeypatch, tmp_path):
    """F8: the result is read from the version's own files, also when the table has left the catalogue."""
    from starpipe.catalog import registry

    asked = []
    monkeypatch.setattr(registry, "shared_folder", lambda _, purpose: asked.append(purpose) or str(tmp_path / f"{purpose}-x"))
    out = registry.pipe_load(spark, sf_dir)
    assert asked == ["pipe"] and all("/v" in f for f in out.inputFiles())
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert out.where("year = 2021 AND month = 1").count() == lines


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A month of 400 trips in four files, all of other zones."""
    root = tmp_path_factory.mktemp("many")
    zones = "".join(f"{i},B{i % 5},Z{i},s\n" for i in range(300))
    paths = {}
    for name, text in {**CSV, "zones": "LocationID,Borough,Zone,service_zone\n" + zones}.items():
        paths[name] = str(root / f"{name}.csv")
        Path(paths[name]).write_text(text)
    folder = root / "landing" / "trips" / "2021" / "01"
    folder.mkdir(parents=True)
    for n in range(4):
        rows = "".join(f"1,2021-01-{i % 28 + 1:02d} 00:00:00,2021-01-05 00:10:00,1,2.5,1,N,{i},{399 - i},1,10,{i}\n"
                       for i in range(n, 400, 4))
        (folder / f"trips{n}.csv").write_text(TRIPS_CSV.splitlines()[0] + "\n" + rows)
    layout = Layout(str(root), "exp")
    steps.init_dimensions(spark, layout, paths)
    month = steps.Run(spark, layout, 2021, 1, settings=RunSettings(shuffle_partitions=2, max_partition_bytes=4096))
    steps.to_bronze(month, "trips")
    assert steps.to_silver(month).rows_out == 400
    return month


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_large_silver_is_joined_a_part_after_the_other(spark, many, monkeypatch, broadcast):
    """what a part of the month exchanged is gone before the next one begins."""
    from starpipe.operators import star
    from starpipe.sources import layers

    run = replace(many, settings=replace(many.settings, broadcast_small=broadcast))
    assert steps.to_wide(run).rows_out == 400
    whole = sorted(map(str, run.layer("silver_wide").collect()))
    assert sum("Z7" in r for r in whole) > 1
    monkeypatch.setattr(layers, "PART_MIB", 1e-6)
    monkeypatch.setattr(star, "BROADCAST_ROWS", 10)

    def exchanged():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    begun, keys = [], steps.join_keys
    monkeypatch.setattr(steps, "join_keys", lambda df: begun.append(exchanged()) or keys(df))
    done = steps.to_wide(run)
    assert (done.rows_in, done.rows_out) == (400, 400)
    assert sorted(map(str, run.layer("silver_wide").collect())) == whole
    assert len(begun) > 3 and not any(files - begun[0] for files in begun)
    record = steps.to_wide(replace(run, settings=replace(run.settings, files_per_month=3)))
    assert record.details["files_out"] == 3 and record.rows_out == 400


def test_a_large_merged_join_keeps_only_its_wide_rows(spark, sf_dir, monkeypatch, tmp_path):
    """joined a part after the other; the silver rows go when the wide ones stand."""
    from starpipe.catalog import registry
    from starpipe.sources import layers

    whole = sorted(map(str, registry.star_join_merge(spark, sf_dir).collect()))
    monkeypatch.setattr(layers, "PART_MIB", 1e-3)
    monkeypatch.setattr(registry, "shared_folder", lambda _, purpose: str(tmp_path / purpose))
    out = registry.star_join_merge(spark, sf_dir)
    assert sorted(map(str, out.collect())) == whole and len(whole) > 1000
    assert [p.name for p in tmp_path.iterdir()] == ["wide"]
