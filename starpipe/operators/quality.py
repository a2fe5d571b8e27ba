"""Rule percentages, duplicates, evaluation against limits, the gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starpipe.functions.measures import share_pct
from starpipe.spec import GatePolicy


#: Slots of the bitmap of suspected duplicates, as a power of two: a million words of 64.
SUSPECT_BITS = 26


class QualityGateError(RuntimeError):
    """Raised when a gated step has failing rules."""


def rule_percentages(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """All rule shares and the row count in one aggregate: one scan, no data shuffle."""
    return df.agg(
        *[share_pct(predicate).alias(name) for name, predicate in rules.items()],
        F.count(F.lit(1)).alias("rows_total"),
    )


def suspect_words(hashes: DataFrame, bits: int = SUSPECT_BITS) -> DataFrame:
    """word, bits: a bitmap of the slots of those `hash` values that occur more than once.

    It has 2^bits slots whatever the data. Only the hash, eight bytes, is exchanged to fill it.
    """
    twice = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slot = _slot(F.col("hash"), bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    return twice.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _slot(hashed: Column, bits: int) -> Column:
    return hashed.bitwiseAND(F.lit((1 << bits) - 1))


def suspects(df: DataFrame, keys: Sequence[str], bits: int = SUSPECT_BITS) -> DataFrame:
    """The keys of rows that may share them with another row; no row that does is missing."""
    hashed = df.select(*keys, F.xxhash64(*keys).alias("hash"))
    words = F.broadcast(suspect_words(hashed.select("hash"), bits))  # at most 2^(bits - 6) words
    slot = _slot(F.col("hash"), bits)
    marked = hashed.withColumn("word", F.shiftright(slot, 6)).join(words, "word")
    own = F.call_function("shiftright", F.col("bits"), slot.bitwiseAND(63).cast("int")).bitwiseAND(1)
    return marked.where(own == 1).select(*keys)


def duplicate_percentage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key group, over those of the keys the frame has.

    A first pass finds the slots of key hashes seen twice; a second one groups exactly, and so
    exchanges, only rows of these slots. Rows whose key is theirs alone stay where they are. Group
    sizes are summed on the map side. Nulls compare equal. `df` is read three times, so a
    derived one is stored first.
    """
    present = [k for k in keys if k in df.columns]
    count = F.count(F.lit(1))
    rows = df.agg(count.alias("rows_total"))
    if not present:
        return _duplicates(rows, F.lit(0).cast("long"))  # no key, nothing to repeat
    groups = suspects(df, present).groupBy(*present).agg(count.alias("n")).where("n > 1")
    return _duplicates(rows, groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar())


def _duplicates(rows: DataFrame, extra: Column) -> DataFrame:
    counted = rows.select(extra.alias("extra_rows"), "rows_total")
    share = F.coalesce(F.try_divide(F.col("extra_rows") * 100.0, F.col("rows_total")), F.lit(0.0))
    return counted.withColumn("duplicate_key_pct", F.round(share, 6))


def rowcount_mismatch(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """Difference of two row counts in percent of the expected one; 0 if that is 0."""
    rows = F.count(F.lit(1))
    counts = expected.agg(rows.alias("rows_export")).select(
        "rows_export", loaded.agg(rows).scalar().alias("rows_fact"))
    return counts.withColumn("rowcount_mismatch_pct", mismatch_pct())


def mismatch_pct() -> Column:
    gap = F.abs(F.col("rows_export") - F.col("rows_fact"))
    return F.round(F.coalesce(F.try_divide(gap * 100.0, F.col("rows_export")), F.lit(0.0)), 6)


def as_rules(metrics: DataFrame, rules: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per rule from one column per rule."""
    return metrics.unpivot(list(keep), list(rules), "rule", "value_num")


def evaluate(rows: DataFrame, step: str, policy: GatePolicy) -> DataFrame:
    """Add step, threshold and status. A rule without a limit is OK, a limit is inclusive."""
    limits = policy.limits.get(step, {})
    threshold = F.lit(None).cast("double")
    if limits:
        pairs = [F.lit(v) for rule, limit in limits.items() for v in (rule, limit)]
        table = F.create_map(*[p if i % 2 == 0 else p.cast("double")
                               for i, p in enumerate(pairs)])
        threshold = F.try_element_at(table, F.col("rule"))
    failed = F.col("value_num") > F.col("threshold")
    return rows.withColumns({"step": F.lit(step), "threshold": threshold}).withColumn(
        "status", F.when(failed, F.lit("FAIL")).otherwise(F.lit("OK"))
    )


def failing(results: DataFrame, policy: GatePolicy) -> DataFrame:
    """The rows that stop a run: failed rules of gated steps."""
    return results.where((F.col("status") == "FAIL") & F.col("step").isin(*policy.gated))


def gate(results: DataFrame, policy: GatePolicy) -> None:
    """Raise with rule, value and threshold of every failing rule; rule rows only are read."""
    bad = failing(results, policy).select("step", "rule", "value_num", "threshold").collect()
    if bad:
        raise QualityGateError("quality gate failed: " + ", ".join(
            f"{r['step']}.{r['rule']}={r['value_num']} > {r['threshold']}" for r in bad
        ))


def summarize(results: DataFrame) -> DataFrame:
    """Counts of rules by status for each experiment, step and month."""
    status = F.col("status")
    return results.groupBy("experiment_id", "step", "year", "month").agg(
        F.count(F.lit(1)).alias("rules_count"),
        *[F.count_if(status == s).alias(f"{s.lower()}_cnt") for s in ("OK", "WARN", "FAIL")],
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )
