"""SQL that gives the same rows as each registered query, written for DuckDB."""

from __future__ import annotations

from starpipe import trips

RAW = """
raw AS (SELECT
  CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) END AS VendorID,
  CASE WHEN l_linenumber = 6 AND l_linestatus = 'O' THEN 'bad'
       ELSE CAST(l_shipdate AS VARCHAR) END AS tpep_pickup_datetime,
  CAST(l_shipdate + to_minutes(CAST(l_quantity AS BIGINT) - 5) AS VARCHAR)
    AS tpep_dropoff_datetime,
  CASE WHEN l_quantity > 45 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS passenger_count,
  CASE WHEN l_tax > 0.07 THEN NULL ELSE CAST(l_discount AS VARCHAR) END AS trip_distance,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE concat(l_linenumber, '.0') END AS RatecodeID,
  CASE l_returnflag WHEN 'A' THEN 'y' ELSE lower(l_returnflag) END AS store_and_fwd_flag,
  CAST(l_suppkey AS VARCHAR) AS PULocationID,
  CASE WHEN l_tax < 0.01 THEN NULL WHEN l_linenumber = 3 THEN CAST(l_partkey + 500000000 AS VARCHAR)
       ELSE CAST(l_partkey AS VARCHAR) END AS DOLocationID,
  CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS Payment_Type,
  CAST(l_extendedprice AS VARCHAR) AS fare_amount,
  CAST(l_tax AS VARCHAR) AS mta_tax,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - 3000 AS VARCHAR) AS total_amount
FROM lineitem)
"""

TYPED = RAW + """,
typed AS (SELECT
  TRY_CAST(trunc(TRY_CAST(VendorID AS DOUBLE)) AS INT) AS vendor_id,
  TRY_CAST(tpep_pickup_datetime AS TIMESTAMP) AS pickup_ts,
  TRY_CAST(tpep_dropoff_datetime AS TIMESTAMP) AS dropoff_ts,
  TRY_CAST(trunc(TRY_CAST(passenger_count AS DOUBLE)) AS INT) AS passenger_count,
  TRY_CAST(trip_distance AS DOUBLE) AS trip_distance,
  TRY_CAST(trunc(TRY_CAST(RatecodeID AS DOUBLE)) AS INT) AS ratecode_id,
  store_and_fwd_flag,
  TRY_CAST(PULocationID AS INT) AS pu_zone_id,
  TRY_CAST(DOLocationID AS INT) AS do_zone_id,
  TRY_CAST(trunc(TRY_CAST(Payment_Type AS DOUBLE)) AS INT) AS payment_type,
  TRY_CAST(fare_amount AS DOUBLE) AS fare_amount,
  CAST(NULL AS DOUBLE) AS extra,
  TRY_CAST(mta_tax AS DOUBLE) AS mta_tax,
  CAST(NULL AS DOUBLE) AS tip_amount,
  CAST(NULL AS DOUBLE) AS tolls_amount,
  CAST(NULL AS DOUBLE) AS improvement_surcharge,
  TRY_CAST(total_amount AS DOUBLE) AS total_amount,
  CAST(NULL AS DOUBLE) AS congestion_surcharge
FROM raw)
"""

FILLED = TYPED + """,
filled AS (SELECT * REPLACE (
  coalesce(vendor_id, 99) AS vendor_id,
  coalesce(passenger_count, 0) AS passenger_count,
  coalesce(ratecode_id, 99) AS ratecode_id,
  coalesce(payment_type, 5) AS payment_type,
  CASE WHEN upper(store_and_fwd_flag) IN ('Y', 'N') THEN upper(store_and_fwd_flag)
       ELSE 'U' END AS store_and_fwd_flag)
FROM typed)
"""

FLAGS = """
  coalesce(trip_distance, 0) <= 0 AS is_zero_distance,
  date_trunc('second', dropoff_ts) <= date_trunc('second', pickup_ts) AS is_zero_duration,
  coalesce(total_amount, 0) < 0 AS is_negative_total,
  coalesce(passenger_count, 0) <= 0 AS is_passenger_missing
"""

DATE_KEYS = """
  CAST(strftime(pickup_ts, '%Y%m%d') AS INT) AS pickup_date_id,
  CAST(strftime(dropoff_ts, '%Y%m%d') AS INT) AS dropoff_date_id,
  CAST(year(pickup_ts) AS INT) AS year,
  CAST(month(pickup_ts) AS INT) AS month
"""


def _hash(marker: str | None = None, pickup: str = "CAST(pickup_ts AS VARCHAR)",
          dropoff: str = "CAST(dropoff_ts AS VARCHAR)") -> str:
    texts = {"pickup_ts": pickup, "dropoff_ts": dropoff}
    parts = [texts.get(c, f"CAST({c} AS VARCHAR)") for c in trips.HASH_INPUTS]
    if marker is not None:
        parts = [f"coalesce({p}, '{marker}')" for p in parts]
    return f"sha256(concat_ws('|', {', '.join(parts)}))"


def _silver(marker: str | None = None) -> str:
    return FILLED + f""",
keyed AS (SELECT *, {DATE_KEYS}, {FLAGS} FROM filled),
silver AS (SELECT *, {_hash(marker)} AS row_hash FROM keyed)
"""


SILVER = _silver()
SILVER_LIST = ", ".join(trips.SILVER_COLUMNS)

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g')"
_EXPORT_HASH = _hash(None, _ISO.format("pickup_ts"), _ISO.format("dropoff_ts"))
_EXPORT_REST = ", ".join(c for c in trips.EXPORT_COLUMNS
                         if c not in ("pickup_ts", "dropoff_ts", "load_src", "row_hash"))
EXPORT = f"""WITH {SILVER} SELECT {_EXPORT_REST},
  {_ISO.format("pickup_ts")} AS pickup_ts, {_ISO.format("dropoff_ts")} AS dropoff_ts,
  'run1' AS load_src, {_EXPORT_HASH} AS row_hash FROM silver"""
READ_BACK = f"""WITH {SILVER} SELECT {_EXPORT_REST}, pickup_ts, dropoff_ts,
  'run1' AS load_src, {_EXPORT_HASH} AS row_hash FROM silver"""

LANDED = RAW.replace("raw AS (SELECT", "raw0 AS (SELECT", 1) + """,
raw AS (SELECT * REPLACE (
  '2021-01-' || coalesce(substr(tpep_dropoff_datetime, 9, 2), '01')
    || coalesce(nullif(substr(tpep_pickup_datetime, 11, 9), ''), ' 00:00:00') AS tpep_pickup_datetime,
  '2021-01-' || coalesce(substr(tpep_dropoff_datetime, 9, 2), '01')
    || coalesce(nullif(substr(tpep_dropoff_datetime, 11, 9), ''), ' 00:00:00') AS tpep_dropoff_datetime)
FROM raw0)
"""
LANDED_SILVER = SILVER.replace(RAW, LANDED)

ZONES = """
zones AS (
  SELECT CAST(p_partkey AS INT) AS zone_id, p_brand AS borough, p_name AS zone_name,
         p_type AS service_zone
  FROM part
  UNION ALL
  SELECT CAST(p_partkey AS INT), p_brand, 'alias of ' || p_name, p_type
  FROM part)
"""
ZONE_KEYS = "SELECT zone_id, min(zone_name) AS zone_name, min(borough) AS borough FROM zones GROUP BY zone_id"

DATES = """
days AS (
  SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE)
         AS d FROM orders),
dates AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_id, d AS date, CAST(year(d) AS INT) AS year,
         CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month,
         CAST(day(d) AS INT) AS day, CAST(weekofyear(d) AS INT) AS iso_week,
         CAST(isodow(d) AS INT) AS iso_dow, isodow(d) >= 6 AS is_weekend,
         day(d) = 1 AS is_month_start, d = last_day(d) AS is_month_end
  FROM days)
"""

WIDE = SILVER + "," + ZONES + "," + DATES + f""",
z AS ({ZONE_KEYS}),
wide AS (
  SELECT s.*, zp.zone_name AS pu_zone_name, zp.borough AS pu_borough,
         zd.zone_name AS do_zone_name, zd.borough AS do_borough,
         r_name AS payment_desc, n_name AS ratecode_desc, s_name AS vendor_name,
         CASE WHEN store_and_fwd_flag IN (SELECT upper(l_returnflag) FROM lineitem)
              THEN 'flag ' || store_and_fwd_flag END AS store_flag_desc,
         dp.iso_dow AS pickup_iso_dow, dp.is_weekend AS pickup_is_weekend,
         dd.iso_dow AS dropoff_iso_dow, dd.is_weekend AS dropoff_is_weekend
  FROM silver s
  LEFT JOIN z zp ON pu_zone_id = zp.zone_id
  LEFT JOIN z zd ON do_zone_id = zd.zone_id
  LEFT JOIN region ON payment_type = r_regionkey
  LEFT JOIN nation ON ratecode_id = n_nationkey
  LEFT JOIN supplier ON vendor_id = s_suppkey
  LEFT JOIN dates dp ON pickup_date_id = dp.date_id
  LEFT JOIN dates dd ON dropoff_date_id = dd.date_id)
"""
WIDE_LIST = SILVER_LIST + """, pu_zone_name, pu_borough, do_zone_name, do_borough, payment_desc,
  ratecode_desc, vendor_name, store_flag_desc, pickup_iso_dow, pickup_is_weekend,
  dropoff_iso_dow, dropoff_is_weekend"""


def _pct(predicate: str) -> str:
    return f"round(coalesce(avg(CASE WHEN {predicate} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 0), 6)"


SILVER_RULES = {
    "null_pickup_ts_pct": "pickup_ts IS NULL",
    "null_dropoff_ts_pct": "dropoff_ts IS NULL",
    "null_pu_zone_id_pct": "pu_zone_id IS NULL",
    "null_do_zone_id_pct": "do_zone_id IS NULL",
    "null_payment_type_pct": "payment_type IS NULL",
    "zero_distance_pct": "trip_distance <= 0",
    "zero_duration_pct": "dropoff_ts <= pickup_ts",
    "drop_lt_pickup_pct": "dropoff_ts < pickup_ts",
    "negative_total_pct": "total_amount < 0",
}
LOAD_RULES = {
    "null_zone_id_pct": "pu_zone_id IS NULL OR do_zone_id IS NULL",
    "null_payment_type_pct": "payment_type IS NULL",
    "null_ratecode_id_pct": "ratecode_id IS NULL",
    "null_vendor_id_pct": "vendor_id IS NULL",
    "negative_total_pct": "total_amount < 0",
}
UNMAPPED = ("vendor_name", "ratecode_desc", "payment_desc", "pu_zone_name", "do_zone_name")


def _rules(rules: dict[str, str]) -> str:
    return ", ".join(f"{_pct(p)} AS {n}" for n, p in rules.items())


def _duplicates(table: str, keys: str) -> str:
    return f"""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows,
      CAST(sum(n) AS BIGINT) AS rows_total,
      round(100.0::DOUBLE * sum(n - 1) / sum(n), 6) AS duplicate_key_pct
      FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys})"""


SILVER_QUALITY = f"""
metrics AS (SELECT {_rules(SILVER_RULES)}, count(*) AS rows_total FROM silver),
repeats AS ({_duplicates("silver", ", ".join(trips.DUPLICATE_KEYS))}),
quality AS (SELECT metrics.*, duplicate_key_pct FROM metrics, repeats)
"""


def _long(step: str, table: str, rules) -> str:
    limits = trips.GATE.limits[step]
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {rule} AS value_num, '{step}' AS step, "
        f"CAST({limits.get(rule, 'NULL')} AS DOUBLE) AS threshold FROM {table}" for rule in rules)


EVALUATED = f"""
long AS ({_long("dq_silver", "quality", trips.GATE.limits["dq_silver"])}),
evaluated AS (SELECT *, CASE WHEN value_num > threshold THEN 'FAIL' ELSE 'OK' END AS status
              FROM long)
"""

BENCH_RECORDS = """
records AS (
  SELECT event_type AS step, event_id AS rows_in, value AS wall_sec,
         '{"k":' || (props->>'$.k') || ',"owner":' || user_id || '}' AS details
  FROM events)
"""


def _bench(view: str) -> str:
    names = trips.EXPERIMENTS[view]
    hours = 24 // len(names)
    cases = " ".join(f"WHEN hour(ts) < {hours * (i + 1)} THEN '{n}'" for i, n in enumerate(names))
    return f"""WITH kept AS (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events),
bench AS (
  SELECT CASE {cases} END AS experiment_id,
    CASE event_type WHEN 'error' THEN 'bronze' WHEN 'click' THEN 'silver_prep'
      WHEN 'view' THEN 'silver_join' WHEN 'signup' THEN 'export'
      ELSE CASE WHEN k > 50 THEN 'dwh_parallel' ELSE 'dwh_single' END END AS step,
    CAST(value AS DECIMAL(18,2)) AS wall_sec, k AS tasks_total, length(event_type) AS stages,
    value * 1.5::DOUBLE AS shuffle_read_mb, value * 0.5::DOUBLE AS shuffle_write_mb,
    k * 0.25::DOUBLE AS disk_spill_mb, k * 0.5::DOUBLE AS memory_spill_mb,
    k * 10 AS gc_time_ms, CAST(round(value * 100) AS BIGINT) * 10 AS executor_run_time_ms,
    1 + value / 100 AS skew_factor, value / 10 AS copy_throughput_mib_s,
    k * 100.5::DOUBLE AS copy_throughput_rows_s, value * 2 AS table_bytes_mb,
    value / 4 AS index_bytes_mb, value * 3 AS bytes_out_mb, k AS files_out,
    value / 8 AS write_sec, k / 8.0::DOUBLE AS merge_sec
  FROM kept WHERE year(ts) = 2024 AND month(ts) = 1)
"""


def _r(expression: str, digits: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def _change(value: str, base: str) -> str:
    return _r(f"CAST({value} - {base} AS DOUBLE) * 100.0 / nullif(CAST({base} AS DOUBLE), 0)", 2)


def _walls(steps=None) -> str:
    where = f"WHERE step IN {tuple(steps)}" if steps else ""
    return ("walls AS (SELECT experiment_id, step, sum(wall_sec) AS wall_sec FROM bench "
            f"{where} GROUP BY experiment_id, step)")


def _case(experiment: str, column: str = "wall_sec") -> str:
    return f"max(CASE WHEN experiment_id = '{experiment}' THEN {column} END)"


def _pivoted(variants: dict[str, str]) -> str:
    cells = ", ".join(f"coalesce({_case(e)}, 0) AS {n}" for n, e in variants.items())
    return f"""{_walls()},
pivoted AS (
  SELECT step, {cells} FROM walls GROUP BY step
  UNION ALL
  SELECT 'pipeline_total', {cells}
  FROM (SELECT experiment_id, sum(wall_sec) AS wall_sec FROM walls GROUP BY experiment_id))"""


def _delta(view: str) -> str:
    off, on = trips.EXPERIMENTS[view]
    return f"""{_bench(view)}, {_pivoted({"off_sec": off, "on_sec": on})}
SELECT step, {_r("off_sec", 3)} AS off_sec, {_r("on_sec", 3)} AS on_sec,
       {_r("on_sec - off_sec", 3)} AS delta_sec, {_change("on_sec", "off_sec")} AS delta_pct
FROM pivoted"""


def _nullable(view: str) -> str:
    off, on = trips.EXPERIMENTS[view]
    return f"""{_bench(view)}, {_walls()}
SELECT step, {_r(_case(off), 3)} AS off_sec, {_r(_case(on), 3)} AS on_sec
FROM walls GROUP BY step"""


def _totals(view: str, value: str = "pipeline_sec", suffix: str = "base", steps=None) -> str:
    base = trips.EXPERIMENTS[view][0]
    where = f"WHERE step IN {tuple(steps)}" if steps else ""
    return f"""{_bench(view)}, totals AS (
  SELECT experiment_id, sum(wall_sec) AS sec FROM bench {where} GROUP BY experiment_id),
base AS (SELECT sec AS base_sec FROM totals WHERE experiment_id = '{base}')
SELECT experiment_id, {_r("sec", 3)} AS {value}, {_r("sec - base_sec", 3)} AS delta_vs_{suffix}_sec,
       {_change("sec", "base_sec")} AS delta_vs_{suffix}_pct
FROM totals CROSS JOIN base"""


def _step_table(view: str) -> str:
    return f"""{_bench(view)}, {_walls(trips.SPARK_STEPS)}
SELECT experiment_id, step, {_r("wall_sec", 3)} AS wall_sec FROM walls"""


_E2_OFF, _E2_ON = trips.EXPERIMENTS["v_e2"]
_E3 = {e.split("_", 1)[1]: e for e in trips.EXPERIMENTS["v_e3"]}
_E3_BASE = trips.EXPERIMENTS["v_e3"][0]
_SPILL = {"shuffle_read_mb": 1, "shuffle_write_mb": 1, "disk_spill_mb": 1, "memory_spill_mb": 1}


def _details(measures: dict[str, int]) -> str:
    return ", ".join(f"{_r(n, d)} AS {n}" for n, d in measures.items())


def _metric(name: str, expression: str) -> str:
    return f"""SELECT '{name}' AS metric, {_case(_E2_OFF, "v")} AS off_val,
  {_case(_E2_ON, "v")} AS on_val
FROM (SELECT experiment_id, CAST({expression} AS DOUBLE) AS v FROM bench
      WHERE step = 'silver_join' GROUP BY experiment_id)"""


_METRICS = " UNION ALL ".join([
    _metric("wall_sec", "sum(wall_sec)"),
    _metric("executor_sec", "sum(executor_run_time_ms) / 1000.0"),
    _metric("gc_sec", "sum(gc_time_ms) / 1000.0"),
    _metric("tasks_total", "sum(tasks_total)"),
    _metric("stages", "max(stages)"),
])

REPORTS = {
    "e1_steps": _delta("v_e1"),
    "e1_steps_nullable": _nullable("v_e1"),
    "e1_join_tasks": _bench("v_e1") + """SELECT experiment_id,
      CAST(sum(tasks_total) AS BIGINT) AS tasks_total
      FROM bench WHERE step = 'silver_join' GROUP BY experiment_id""",
    "e1_join_skew": _bench("v_e1") + f"""SELECT experiment_id,
      {_r("avg(skew_factor)", 3)} AS skew_factor_avg
      FROM bench WHERE step = 'silver_join' GROUP BY experiment_id""",
    "e1_load_throughput": _bench("v_e1") + f"""SELECT experiment_id,
      {_r("max(copy_throughput_mib_s)", 3)} AS mib_s,
      {_r("max(copy_throughput_rows_s)", 1)} AS rows_s
      FROM bench WHERE step = 'dwh_single' GROUP BY experiment_id""",
    "e2_steps": _delta("v_e2"),
    "e2_steps_nullable": _nullable("v_e2"),
    "e2_shuffle_spill": _bench("v_e2") + f"""SELECT
      CASE experiment_id WHEN '{_E2_OFF}' THEN 'off' WHEN '{_E2_ON}' THEN 'on' END AS variant,
      {_details(_SPILL)} FROM bench WHERE step = 'silver_join'""",
    "e2_metrics": _bench("v_e2") + f"""SELECT metric, {_r("off_val", 3)} AS off,
      {_r("on_val", 3)} AS "on",
      {_r("(off_val - on_val) * 100.0 / nullif(off_val, 0)", 1)} AS improvement_pct
      FROM ({_METRICS})""",
    "e3_totals": _totals("v_e3"),
    "e3_step_table": _step_table("v_e3"),
    "e3_spark_totals": _totals("v_e3", "spark_sec", steps=trips.SPARK_STEPS),
    "e3_steps": f"""{_bench("v_e3")}, {_pivoted(_E3)}
      SELECT step, {", ".join(f"{_r(n, 3)} AS {n}" for n in _E3)} FROM pivoted""",
    "e3_steps_vs_base": f"""{_bench("v_e3")}, {_walls(trips.SPARK_STEPS)},
      base AS (SELECT step, wall_sec AS base_sec FROM walls WHERE experiment_id = '{_E3_BASE}')
      SELECT step, {", ".join(f"{_r(_case(e), 3)} AS {n}" for n, e in _E3.items())},
        {_change(_case("E3_sp128_mpb128"), "base_sec")} AS sp128_mpb128_vs_base_pct
      FROM walls JOIN base USING (step) GROUP BY step, base_sec""",
    "e4_totals": _totals("v_e4", suffix="f1", steps=trips.ALL_STEPS),
    "e4_spark_totals": _totals("v_e4", "spark_sec", "f1", trips.SPARK_STEPS),
    "e4_step_table": _step_table("v_e4"),
    "e4_step_metrics": _bench("v_e4") + f"""SELECT step, experiment_id,
      {_details({**_SPILL, "skew_factor": 2})}
      FROM bench WHERE step IN {trips.SPARK_STEPS}""",
    "e5_totals": _totals("v_e5"),
    "e5_stages": _bench("v_e5") + f""",
      etl AS (SELECT experiment_id, sum(wall_sec) AS etl_sec FROM bench
              WHERE step IN {trips.SPARK_STEPS} GROUP BY experiment_id),
      export AS (SELECT experiment_id, sum(wall_sec) AS export_sec FROM bench
                 WHERE step = 'export' GROUP BY experiment_id),
      dwh AS (SELECT experiment_id, sum(wall_sec) AS dwh_sec FROM bench
              WHERE step IN {trips.LOAD_STEPS} GROUP BY experiment_id)
      SELECT experiment_id, {_r("etl_sec", 3)} AS etl_sec, {_r("export_sec", 3)} AS export_sec,
        {_r("dwh_sec", 3)} AS dwh_sec, {_r("etl_sec + export_sec + dwh_sec", 3)} AS pipeline_sec
      FROM etl JOIN export USING (experiment_id) JOIN dwh USING (experiment_id)""",
    "e5_loads": _bench("v_e5") + f"""SELECT experiment_id, step AS dwh_step,
      {_r("sum(wall_sec)", 3)} AS dwh_wall_sec, {_r("max(copy_throughput_mib_s)", 3)} AS copy_mib_s,
      {_r("max(copy_throughput_rows_s)", 1)} AS copy_rows_s,
      {_r("max(table_bytes_mb)", 3)} AS table_mb, {_r("max(index_bytes_mb)", 3)} AS index_mb
      FROM bench WHERE step IN {trips.LOAD_STEPS} GROUP BY experiment_id, step""",
    "e5_exports": _bench("v_e5") + f""", sums AS (SELECT experiment_id,
        coalesce(max(files_out), 0) AS files_out, {_r("sum(bytes_out_mb)", 3)} AS bytes_out_mb,
        {_r("sum(write_sec)", 3)} AS write_sec, {_r("sum(merge_sec)", 3)} AS merge_sec
        FROM bench WHERE step = 'export' GROUP BY experiment_id)
      SELECT *, CASE WHEN write_sec > 0 THEN {_r("bytes_out_mb / write_sec", 3)} END
        AS export_throughput_mib_s FROM sums""",
}

MONTHLY = """
monthly AS (SELECT *, CAST(year(o_orderdate) AS INT) AS year,
                   CAST(month(o_orderdate) AS INT) AS month FROM orders)
"""
REPLACED = f"""WITH {MONTHLY}, replaced AS (SELECT * REPLACE (
  CASE WHEN year = 1998 AND month = 3 THEN o_totalprice + 1000000 ELSE o_totalprice END
  AS o_totalprice) FROM monthly)
"""
PRICE = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price"


def _fk(column: str, known: str) -> str:
    return f"""SELECT '{column}' AS foreign_key,
      CAST(coalesce(sum(n), 0) AS BIGINT) AS violating_rows, count(*) AS violating_values
      FROM (SELECT {column} AS v, count(*) AS n FROM silver WHERE {column} IS NOT NULL
            GROUP BY {column})
      WHERE v NOT IN ({known})"""


def _pk(name: str, key: str, table: str) -> str:
    return f"""SELECT '{name}' AS dimension,
      count(*) FILTER (WHERE k IS NOT NULL AND n > 1) AS repeated_keys,
      CAST(coalesce(sum(CASE WHEN k IS NULL THEN n END), 0) AS BIGINT) AS null_keys
      FROM (SELECT {key} AS k, count(*) AS n FROM {table} GROUP BY {key})"""


ORDER_LINES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
  o_orderdate, o_orderstatus, c_name, c_mktsegment, cn.n_name AS customer_nation, p_name, p_brand,
  s_name, sn.n_name AS supplier_nation
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey"""

ORACLES: dict[str, str] = {
    # An empty CSV field is read as null.
    "csv_text_scan": f"""WITH {RAW}
      SELECT * REPLACE (nullif(passenger_count, '') AS passenger_count) FROM raw""",
    "month_slice": """SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01'
      AND o_orderdate < TIMESTAMP '1998-04-01'""",
    "month_select": f"""WITH {MONTHLY} SELECT year, month, count(*) AS orders, {PRICE}
      FROM monthly WHERE year IN (1996, 1998) AND month IN (1, 2, 3) GROUP BY year, month""",
    "new_months": f"""WITH {MONTHLY} SELECT * FROM monthly m WHERE NOT EXISTS (
      SELECT 1 FROM monthly x WHERE x.o_orderdate < TIMESTAMP '2000-01-01'
      AND x.year = m.year AND x.month = m.month)""",
    "new_months_by_rows": f"""WITH {MONTHLY} SELECT * FROM monthly m WHERE NOT EXISTS (
      SELECT 1 FROM monthly x WHERE x.o_orderdate < TIMESTAMP '2000-01-01'
      AND x.year = m.year AND x.month = m.month)""",
    "layer_without_fallback": """SELECT 'trial 1' AS read, count(*) AS rows_total FROM orders WHERE o_orderstatus = 'P'
      UNION ALL SELECT 'trial 2', 0""",
    "zones_with_mark": f"WITH {ZONES} SELECT * FROM zones",
    "fact_in_order": """SELECT count(*) AS rows_total, CAST(6 AS BIGINT) AS files, CAST(0 AS BIGINT) AS rows_out_of_order,
      CAST(0 AS BIGINT) AS files_out_of_order FROM lineitem""",
    "fk_large_dimensions": " UNION ALL ".join(
        f"""SELECT '{name}' AS foreign_key, count(*) AS violating_rows, count(DISTINCT l_orderkey) AS violating_values
        FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""
        for name in ("l_orderkey", "sparse", "name")),
    "load_interrupted": REPLACED + "SELECT * FROM replaced",
    "reports_in_order": f"""WITH {SILVER}, {SILVER_QUALITY}, {EVALUATED}
      SELECT 'rules' AS report, CAST(row_number() OVER (ORDER BY step, rule) AS INT) AS place, step || '.' || rule AS row
      FROM evaluated
      UNION ALL SELECT 'steps', CAST(row_number() OVER (ORDER BY event_type) AS INT), event_type FROM events""",
    "load_part_times": """WITH t AS (SELECT *, CAST(props->>'$.k' AS BIGINT) % 5 AS stage FROM events)
      SELECT count(*) AS parts, round(sum(CAST(round(value * 100) AS BIGINT)) / 1000.0::DOUBLE, 3) AS copy_sec_sum,
        round(max(CAST(round(value * 100) AS BIGINT)) / 1000.0::DOUBLE, 3) AS copy_sec_max,
        CAST(sum(event_id + 1) AS BIGINT) AS rows_read
      FROM t WHERE event_type <> 'error' AND stage = 2""",
    "pipe_load_unknown_key": """SELECT count(*) AS rows_left, 'rows_unknown_do_zone_id' AS refused,
        count(*) FILTER (l_linenumber = 3 AND l_tax >= 0.01) AS rows_refused FROM lineitem""",
    "pipe_reports": """SELECT unnest(['bronze', 'silver_prep', 'silver_join', 'export', 'dwh_single', 'pipeline_total']) AS step,
      true AS off_timed, true AS on_timed, true AS difference""",
    "layer_scan": f"WITH {SILVER} SELECT {SILVER_LIST} FROM silver",
    "dictionary_read": """
      SELECT 'vendor' AS dictionary, CAST(s_suppkey AS VARCHAR) AS key, s_name AS description
      FROM supplier
      UNION ALL SELECT 'ratecode', CAST(n_nationkey AS VARCHAR), n_name FROM nation
      UNION ALL SELECT 'payment_type', CAST(r_regionkey AS VARCHAR), r_name FROM region
      UNION ALL SELECT 'store_flag', o_orderstatus, o_orderpriority FROM orders""",
    "zones_read": f"WITH {ZONES} SELECT * FROM zones",
    "dim_date": f"WITH {DATES} SELECT * FROM dates",
    "file_and_partition_stats": """SELECT CAST(3 AS BIGINT) AS files, CAST(3 AS BIGINT) AS partitions_in,
      CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS key_bytes FROM orders""",
    "event_log_stats": """WITH t AS (
        SELECT *, CAST(props->>'$.k' AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS run
        FROM events)
      SELECT round(sum(k) * 5000 / 1048576.0::DOUBLE, 3) AS shuffle_read_mb,
        round(sum(k) * 4000 / 1048576.0::DOUBLE, 3) AS shuffle_write_mb,
        count(*) AS tasks_total,
        count(DISTINCT CASE WHEN event_type = 'signup' THEN k END) AS stages,
        round(sum(k) * 500 / 1048576.0::DOUBLE, 3) AS disk_spill_mb,
        round(sum(k) * 1000 / 1048576.0::DOUBLE, 3) AS memory_spill_mb,
        CAST(sum(k) AS BIGINT) AS gc_time_ms, CAST(sum(run) AS BIGINT) AS executor_run_time_ms,
        round(max(run) / avg(CASE WHEN run > 0 THEN run END), 6) AS skew_factor FROM t""",
    "metrics_roundtrip": """SELECT event_type AS step, count(*) AS rows_out,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS wall_sec
      FROM events GROUP BY event_type""",
    "canonical_cast": f"""WITH {TYPED} SELECT vendor_id, pickup_ts, dropoff_ts, passenger_count,
      trip_distance, ratecode_id, store_and_fwd_flag, payment_type, pu_zone_id, do_zone_id,
      fare_amount, extra, mta_tax, total_amount, CAST(NULL AS INT) AS year, 'run1' AS load_src
      FROM typed""",
    "defaults_and_flag": f"""WITH {FILLED} SELECT vendor_id, ratecode_id, payment_type,
      passenger_count, store_and_fwd_flag FROM filled""",
    "date_keys": f"WITH {TYPED} SELECT {DATE_KEYS} FROM typed",
    "quality_flags": f"WITH {FILLED} SELECT {FLAGS} FROM filled",
    "row_hash": f"WITH {SILVER} SELECT row_hash FROM silver",
    "row_hash_marked": "WITH " + _silver("\\N") + " SELECT row_hash FROM silver",
    "silver_fact": f"WITH {SILVER} SELECT {SILVER_LIST} FROM silver",
    "export_fact": EXPORT,
    "normalize_zones": f"WITH {ZONES} {ZONE_KEYS}",
    "normalize_payments": "SELECT r_regionkey AS payment_type, r_name AS payment_desc FROM region",
    "normalize_ratecodes": "SELECT n_nationkey AS ratecode_id, n_name AS ratecode_desc FROM nation",
    "normalize_vendors": """SELECT CAST(s_suppkey AS INT) AS vendor_id, s_name AS vendor_name
      FROM supplier""",
    "normalize_store_flags": """SELECT DISTINCT l_returnflag AS store_flag,
      'flag ' || l_returnflag AS description FROM lineitem""",
    "normalize_dates": f"""WITH {DATES} SELECT date_id, date, year, month, day, iso_week, iso_dow,
      is_weekend, is_month_start, is_month_end FROM dates
      WHERE date IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""",
    "surrogate_key": """SELECT count(*) AS rows_total, count(*) AS distinct_keys,
      CAST(0 AS BIGINT) AS rows_without_load_time FROM orders""",
    "details_json": f"""WITH {BENCH_RECORDS} SELECT step, rows_in, wall_sec,
      CAST(NULL AS BIGINT) AS rows_out, details FROM records""",
    "star_join_broadcast": f"WITH {WIDE} SELECT {WIDE_LIST} FROM wide",
    "star_join_merge": f"WITH {WIDE} SELECT {WIDE_LIST} FROM wide",
    "order_lines": ORDER_LINES,
    "order_lines_merge": ORDER_LINES,
    "fk_violations": "WITH " + SILVER + "," + ZONES + "," + DATES + " UNION ALL ".join([
        _fk("pu_zone_id", "SELECT zone_id FROM zones"),
        _fk("do_zone_id", "SELECT zone_id FROM zones"),
        _fk("payment_type", "SELECT r_regionkey FROM region"),
        _fk("ratecode_id", "SELECT n_nationkey FROM nation"),
        _fk("vendor_id", "SELECT s_suppkey FROM supplier"),
        _fk("pickup_date_id", "SELECT date_id FROM dates"),
        _fk("dropoff_date_id", "SELECT date_id FROM dates"),
    ]),
    "pk_violations": f"WITH {ZONES}, {DATES} " + " UNION ALL ".join([
        _pk("orders", "o_orderkey", "orders"), _pk("customer", "c_custkey", "customer"),
        _pk("supplier", "s_suppkey", "supplier"), _pk("lines by order", "l_orderkey", "lineitem"),
        _pk("zones", "zone_id", "zones"), _pk("dates", "date_id", "dates"),
    ]),
    "month_and_flag_guard": f"""WITH {TYPED} SELECT count(*) AS rows_total,
      count(*) FILTER (WHERE coalesce(NOT (year(pickup_ts) = 1998 AND month(pickup_ts) = 3), true))
        AS rows_outside_month,
      count(*) FILTER (WHERE upper(store_and_fwd_flag) NOT IN ('Y', 'N', 'U')) AS rows_bad_flag
      FROM typed""",
    "dq_rules": f"WITH {SILVER} SELECT {_rules(SILVER_RULES)}, count(*) AS rows_total FROM silver",
    "dq_silver": f"WITH {SILVER}, {SILVER_QUALITY} SELECT * FROM quality",
    "duplicate_pct": _duplicates("lineitem", "l_orderkey, l_linenumber"),
    "dq_unmapped": f"""WITH {WIDE} SELECT
      {", ".join(f"{_pct(c + ' IS NULL')} AS unmapped_{c}_pct" for c in UNMAPPED)},
      count(*) AS rows_total FROM wide""",
    "dq_load": f"""WITH {SILVER} SELECT {_rules(LOAD_RULES)}, count(*) AS rows_fact,
      (SELECT count(*) FROM lineitem) AS rows_export,
      round(100.0::DOUBLE * abs((SELECT count(*) FROM lineitem) - count(*))
            / (SELECT count(*) FROM lineitem), 6) AS rowcount_mismatch_pct
      FROM silver WHERE pickup_ts IS NOT NULL""",
    "rowcount_mismatch": """SELECT count(*) AS rows_export,
      count(*) FILTER (WHERE o_orderstatus <> 'P') AS rows_fact,
      round(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 6)
        AS rowcount_mismatch_pct FROM orders""",
    "dq_evaluate": f"WITH {SILVER}, {SILVER_QUALITY}, {EVALUATED} SELECT * FROM evaluated",
    "dq_failing": f"""WITH {SILVER}, {SILVER_QUALITY}, {EVALUATED}
      SELECT step, rule, value_num, threshold FROM evaluated WHERE status = 'FAIL'""",
    "dq_summary": f"""WITH {MONTHLY}, results AS (SELECT *, CASE WHEN o_totalprice > 300000
        THEN 'FAIL' WHEN o_totalprice > 200000 THEN 'WARN' ELSE 'OK' END AS status FROM monthly)
      SELECT o_orderstatus AS experiment_id, o_orderpriority AS step, year, month,
        count(*) AS rules_count, count(*) FILTER (WHERE status = 'OK') AS ok_cnt,
        count(*) FILTER (WHERE status = 'WARN') AS warn_cnt,
        count(*) FILTER (WHERE status = 'FAIL') AS fail_cnt,
        min(o_orderdate) AS first_at, max(o_orderdate) AS last_at
      FROM results GROUP BY o_orderstatus, o_orderpriority, year, month""",
    "quality_append": f"""WITH {SILVER},
      a AS (SELECT {_rules(SILVER_RULES)} FROM silver), b AS (SELECT {_rules(LOAD_RULES)} FROM silver),
      long AS ({_long("dq_silver", "a", SILVER_RULES)} UNION ALL {_long("dq_dwh", "b", LOAD_RULES)})
      SELECT 'exp1' AS experiment_id, 'run1' AS run_id, step, 1998 AS year, 3 AS month, rule,
        value_num, threshold, CASE WHEN value_num > threshold THEN 'FAIL' ELSE 'OK' END AS status,
        '{{"source":"table"}}' AS details FROM long""",
    "csv_single_roundtrip": READ_BACK,
    "csv_parts_roundtrip": READ_BACK,
    "csv_merge_roundtrip": READ_BACK,
    "parquet_sorted_files": "SELECT * FROM orders",
    "month_replace": REPLACED + "SELECT * FROM replaced",
    "load_month": REPLACED + "SELECT * FROM replaced",
    "load_month_staged": REPLACED + f"""SELECT year, month, count(*) AS rows_total,
      count(*) AS distinct_keys, {PRICE} FROM replaced GROUP BY year, month""",
    "table_month_scan": f"WITH {MONTHLY} SELECT * FROM monthly WHERE year = 1998 AND month = 3",
    "table_statistics": f"""WITH {MONTHLY}
      SELECT 'table' AS scope, count(*) AS rows_total, CAST(NULL AS BIGINT) AS nulls, CAST(NULL AS BIGINT) AS distinct_values,
        CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS BOOLEAN) AS histogram FROM monthly
      UNION ALL SELECT 'month', count(*), NULL, NULL, NULL, NULL, NULL FROM monthly WHERE year = 1998 AND month = 3
      UNION ALL SELECT 'o_orderstatus', NULL, count(*) FILTER (o_orderstatus IS NULL), count(DISTINCT o_orderstatus),
        NULL, NULL, false FROM orders
      UNION ALL SELECT 'o_orderpriority', NULL, count(*) FILTER (o_orderpriority IS NULL), count(DISTINCT o_orderpriority),
        NULL, NULL, false FROM orders
      UNION ALL SELECT 'o_totalprice', NULL, count(*) FILTER (o_totalprice IS NULL), NULL,
        min(CAST(o_totalprice AS DOUBLE)), max(CAST(o_totalprice AS DOUBLE)), true FROM orders""",
    "dimension_refresh": f"""WITH {ZONES}, z AS ({ZONE_KEYS})
      SELECT zone_id, zone_name, upper(borough) AS borough FROM z""",
    "bench_append": f"""WITH {BENCH_RECORDS} SELECT 'exp1' AS experiment_id, run_id,
      'optimized' AS mode, step, 2024 AS year, 1 AS month, rows_in, wall_sec,
      CAST(NULL AS DOUBLE) AS skew_factor, details
      FROM records, (SELECT unnest(['run1', 'run2']) AS run_id)""",
    "run_report": f"""WITH {SILVER}, {SILVER_QUALITY}, {EVALUATED}
      SELECT 'steps' AS part, event_type AS step, '' AS name, CAST(event_id AS VARCHAR) AS rows_in,
        '' AS rows_out, '' AS bytes_in_mb, '' AS bytes_out_mb, CAST(value AS VARCHAR) AS value,
        '' AS threshold, '' AS status FROM events
      UNION ALL SELECT 'rules', step, rule, '', '', '', '', printf('%.6f', value_num),
        coalesce(CAST(threshold AS VARCHAR), ''), status FROM evaluated""",
    "load_throughput": f"""WITH {MONTHLY}, parts AS (
        SELECT year, month, o_orderpriority, count(*) AS n,
          sum(CAST(o_totalprice AS DECIMAL(18,2))) AS mib,
          count(*) FILTER (WHERE o_orderstatus = 'P') AS sec,
          count(*) FILTER (WHERE o_orderstatus = 'F') AS filled
        FROM monthly GROUP BY year, month, o_orderpriority)
      SELECT year, month, CAST(sum(n) AS BIGINT) AS rows_loaded,
        CAST(sum(sec) AS BIGINT) AS copy_sec_sum, max(sec) AS copy_sec_max,
        {_r("CAST(sum(mib) AS DOUBLE) / nullif(sum(filled), 0)", 6)} AS copy_throughput_mib_s,
        {_r("CAST(sum(n) AS DOUBLE) / nullif(sum(filled), 0)", 6)} AS copy_throughput_rows_s
      FROM parts GROUP BY year, month""",
    "text_casts": """SELECT l_orderkey, l_linenumber, CAST(trunc(CAST(l_tax AS DOUBLE)) AS INT) AS tax,
        CAST(trunc(l_quantity) AS INT) AS quantity, CAST(NULL AS INT) AS flag FROM lineitem""",
    "normalize_dates_from_date": f"""WITH {DATES} SELECT date_id, date, iso_week, iso_dow, is_weekend,
        CAST(NULL AS BOOLEAN) AS is_month_start, is_month_end FROM dates
      WHERE date IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""",
    "fk_two_dimensions": " UNION ALL ".join(
        f"SELECT '{name}' AS foreign_key, count(*) AS violating_rows, count(DISTINCT {c}) AS violating_values "
        f"FROM lineitem WHERE {c} NOT IN (SELECT {k} FROM {dim})" for c, name, dim, k in (
            ("l_partkey", "part of a line", "part", "p_partkey"),
            ("l_partkey", "part as a customer", "customer", "c_custkey"),
            ("l_suppkey", "supplier of a line", "supplier", "s_suppkey"))),
    "load_empty_month": f"WITH {MONTHLY} SELECT * FROM monthly WHERE NOT (year = 1998 AND month = 3)",
    "gate_rerun": " UNION ALL ".join(
        f"""SELECT 'exp1' AS experiment_id, 'manual' AS run_id, 'dq_orders' AS step, 1998 AS year, 3 AS month,
        'pending_pct' AS rule, v AS value_num, CAST(0.5 AS DOUBLE) AS threshold,
        CASE WHEN v > 0.5 THEN 'FAIL' ELSE 'OK' END AS status, CAST(NULL AS VARCHAR) AS details
        FROM (SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 6) AS v
              FROM orders WHERE {condition})""" for condition in ("true", "o_orderstatus <> 'P'")),
    "pipe_bronze": f"WITH {LANDED} SELECT * REPLACE (nullif(passenger_count, '') AS passenger_count) FROM raw",
    "pipe_silver": f"WITH {LANDED_SILVER} SELECT {SILVER_LIST} FROM silver",
    "pipe_wide": f"WITH {WIDE.replace(RAW, LANDED)} SELECT {WIDE_LIST} FROM wide",
    "pipe_load": READ_BACK.replace(RAW, LANDED).replace("'run1' AS load_src", "'exp1' AS load_src"),
    "pipe_quality": f"""WITH {LANDED_SILVER}, {SILVER_QUALITY}, {EVALUATED}
      SELECT step, rule, value_num, threshold, status FROM evaluated""",
    "pipe_gates": f"""WITH {WIDE.replace(RAW, LANDED)}, {SILVER_QUALITY},
      j AS (SELECT {", ".join(f"{_pct(c + ' IS NULL')} AS unmapped_{c}_pct" for c in UNMAPPED)} FROM wide),
      d AS (SELECT {_rules(LOAD_RULES)}, CAST(0 AS DOUBLE) AS rowcount_mismatch_pct FROM silver),
      long AS ({_long("dq_silver", "quality", trips.GATE.limits["dq_silver"])}
        UNION ALL {_long("dq_join", "j", trips.GATE.limits["dq_join"])}
        UNION ALL {_long("dq_dwh", "d", trips.GATE.limits["dq_dwh"])}),
      e AS (SELECT *, CASE WHEN value_num > threshold THEN 'FAIL' ELSE 'OK' END AS status FROM long)
      SELECT step, rule, value_num, threshold, status, bool_or(status = 'FAIL') OVER (PARTITION BY step) AS stopped FROM e""",
    "pipe_bench": f"""WITH n AS (SELECT count(*) AS n FROM lineitem)
      SELECT 'exp1' AS experiment_id, 'manual' AS run_id, 'optimized' AS mode, step, 2021 AS year, 1 AS month,
        n AS rows_in, n AS rows_out, true AS timed, true AS sized,
        CASE WHEN step = 'dwh_' THEN true END AS rate_of_files_read
      FROM n, (SELECT unnest(['bronze', 'silver_prep', 'export', 'dwh_']) AS step)""",
    "pipe_dims": f"""SELECT 'vendor' AS dimension, count(*) AS rows_total FROM supplier
      UNION ALL SELECT 'ratecode', count(*) FROM nation UNION ALL SELECT 'payment_type', count(*) FROM region
      UNION ALL SELECT 'store_flag', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'zones', count(*) FROM part
      UNION ALL SELECT 'dim_date', date_diff('day', DATE '{trips.CALENDAR_START}', DATE '{trips.CALENDAR_END}') + 1""",
    **{f"report_{name}": sql for name, sql in REPORTS.items()},
    "report_views": " UNION ALL ".join(
        f"SELECT * FROM ({_bench(view)} SELECT '{view}' AS view, count(*) AS rows_total, "
        "count(DISTINCT experiment_id) AS experiments FROM bench)" for view in trips.EXPERIMENTS),
    "report_order": f"""{_bench("v_e5")}, walls AS (
        SELECT experiment_id, step, {_r("sum(wall_sec)", 3)} AS wall_sec FROM bench
        GROUP BY experiment_id, step)
      SELECT experiment_id, step,
        CAST(row_number() OVER (ORDER BY
          list_position({list(trips.STEP_ORDER)}, step) NULLS LAST, step, experiment_id) AS INT)
          AS position,
        CAST(row_number() OVER (ORDER BY nullif(wall_sec, 0) DESC NULLS LAST, experiment_id, step)
          AS INT) AS position_by_wall
      FROM walls""",
}
ORACLES["event_log_two_applications"] = ORACLES["event_log_stats"]
