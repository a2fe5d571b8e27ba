"""Left joins of a fact to lookup tables that keep every fact row exactly once.

A lookup is broadcast only after its rows and bytes were measured against a bound: whole, or by
the keys that the fact has of it. A larger one is shuffled, with the frequent keys and the nulls of
the fact spread over many tasks. How lookups travel is decided once over the whole fact; the join
then takes the fact or any part of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starpipe.operators.dims import one_row_per_key
from starpipe.session import shared_folder
from starpipe.sinks.files import remove_folder
from starpipe.sinks.parquet import write_parquet

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
TRACKED_KEYS = 20  # by the frequency sketch, for each task of an exchange
FAN_IN = 128  # sketches that one task merges

_SLOT = "__slot"


@dataclass(frozen=True, eq=False)
class Lookup:
    """Attach `take` (lookup column -> new name) where fact.on == dim.key.

    `dim` need not be unique by key; one row per key is taken deterministically.
    """

    dim: DataFrame
    on: str
    key: str
    take: Mapping[str, str] = field(default_factory=dict)
    large: bool = False  # known to be too big to broadcast, so not measured
    unique: bool = False  # known to have one row per key

    def source(self) -> tuple:
        """What is read of which table, whatever the new names."""
        return id(self.dim), self.key, tuple(self.take)

    def projection(self) -> DataFrame:
        return self.dim.select(F.col(self.key).alias("__key"), *[
            F.col(c).alias(name) for c, name in self.take.items()
        ])

    def rows(self) -> DataFrame:
        """One row per key under names that are the same in every role, so that roles share a broadcast."""
        return self.one_per_key(
            self.dim.select(F.col(self.key).alias("__key"), *[F.col(c).alias(f"__take_{i}") for i, c in enumerate(self.take)]))

    def one_per_key(self, rows: DataFrame) -> DataFrame:
        return rows if self.unique else one_row_per_key(rows, ["__key"])

    def among(self, rows: DataFrame) -> Lookup:
        """The same lookup in `rows`, which has the columns of `rows()` and one row per key."""
        taken = {f"__take_{i}": name for i, name in enumerate(self.take.values())}
        return replace(self, dim=rows, key="__key", take=taken, unique=True)


def measure(frames: Sequence[DataFrame]) -> list[tuple[int, int]]:
    """Rows and bytes of each frame, all in one job; strings count their own length."""
    def widths(position: int, df: DataFrame) -> DataFrame:
        texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields
                 if isinstance(f.dataType, (T.StringType, T.BinaryType))]
        width = reduce(lambda a, b: a + b, texts, F.lit(16 * len(df.columns)))
        return df.select(F.lit(position).alias("i"), width.cast("long").alias("w"))

    every = reduce(DataFrame.unionAll, [widths(i, f) for i, f in enumerate(frames)])
    rows = every.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("b")).collect()
    found = {r["i"]: (r["n"], r["b"]) for r in rows}
    return [found.get(i, (0, 0)) for i in range(len(frames))]


def small_lookups(lookups: Sequence[Lookup]) -> list[Lookup]:
    """Those that fit a broadcast, smallest first and together; what is left over is shuffled.

    What counts is what a broadcast holds: one row per key, and a table used in several roles once, as
    its roles share one broadcast.
    """
    frames: dict[tuple, DataFrame] = {}
    for x in lookups:
        frames.setdefault(x.source(), x.rows())
    sizes = dict(zip(frames, measure(list(frames.values())))) if frames else {}
    rows = size = 0
    small = set()
    for source in sorted(sizes, key=lambda source: sizes[source][1]):
        rows, size = rows + sizes[source][0], size + sizes[source][1]
        if rows > BROADCAST_ROWS or size > BROADCAST_BYTES:
            break
        small.add(source)
    return [x for x in lookups if x.source() in small]


def used_lookups(fact: DataFrame, lookups: Sequence[Lookup]) -> dict[Lookup, Lookup]:
    """Lookups of few different keys in the fact, each with one that has just the rows of these keys.

    Sketches of the numbers of different keys, all in one pass, leave out those that cannot fit a broadcast.
    """
    if not lookups:
        return {}
    columns = sorted({x.on for x in lookups})
    different = fact.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()

    def used(x: Lookup) -> DataFrame:
        keys = fact.select(F.col(x.on).alias("__used")).where(F.col("__used").isNotNull()).distinct()
        return x.rows().join(keys, F.col("__key") == F.col("__used"), "left_semi")

    return {x: x.among(used(x)) for x in lookups if different[x.on] <= BROADCAST_ROWS}


def key_sketches(fact: DataFrame, columns: Sequence[str], tracked: int) -> DataFrame:
    """Rows (`n`) and a frequency sketch of each column, over groups of groups of map tasks.

    Sketches are merged in levels: FAN_IN neighbouring tasks into one, FAN_IN of those into the next,
    so that no task receives the sketches of all others.
    """
    def level(rows, lane, n, sketch):
        return rows.groupBy(lane.alias("__lane")).agg(n.alias("n"), *[
            F.expr(sketch.format(c, tracked)).alias(c) for c in columns])

    first = level(fact.select(*columns), F.floor(F.spark_partition_id() / FAN_IN),
                  F.count(F.lit(1)), "approx_top_k_accumulate(`{}`, {})")
    return level(first, F.floor(F.col("__lane") / FAN_IN), F.sum("n"), "approx_top_k_combine(`{}`, {})")


def hot_keys(fact: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[object, float]]]:
    """The most frequent keys of each column with their shares, for all columns in one pass.

    A frequency sketch: it only steers how rows travel, so its error cannot change a result. At
    most TRACKED_KEYS keys for each shuffle partition come back for a column, a million in all.
    """
    tracked = tracked_keys(fact, len(columns))
    sketches = key_sketches(fact, columns, tracked)
    # A group, so that tasks without a sketch bring none.
    row = sketches.groupBy(F.lit(0).alias("__all")).agg(F.sum("n").alias("__n"), *[
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(`{c}`, {tracked}), {tracked})").alias(c) for c in columns
    ]).first()
    if row is None:
        return {c: [] for c in columns}
    return {c: [(item["item"], item["count"] / row["__n"]) for item in (row[c] or [])] for c in columns}


def tracked_keys(fact: DataFrame, columns: int) -> int:
    tasks = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(TRACKED_KEYS * tasks, 1_000_000 // max(1, columns)))


@dataclass(frozen=True)
class Frequent:
    """Frequent keys of a column as a frame `__hot` (None for none), and whether others occur at all."""

    keys: DataFrame | None
    others: bool


def frequent_keys(fact: DataFrame, columns: Sequence[str]) -> dict[str, Frequent]:
    """Keys of each column that hold more than a task's fair share of the fact.

    Where the tracked keys seem to be all there are, that is counted exactly; if so, all of them.
    """
    spark, sketched = fact.sparkSession, hot_keys(fact, columns)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def frame(c, keys):
        schema = T.StructType([T.StructField("__hot", fact.schema[c].dataType)])
        return spark.createDataFrame([(k,) for k in keys if k is not None], schema)

    whole = {c: frame(c, [k for k, _ in found]) for c, found in sketched.items() if sum(s for _, s in found) > 0.999}
    others = dict.fromkeys(columns, True)
    if whole:
        rest = fact.select(*whole)
        for n, (c, keys) in enumerate(whole.items()):
            known = F.broadcast(keys.select(F.col("__hot").alias(f"__hot_{n}")))
            rest = rest.join(known, F.col(c) == F.col(f"__hot_{n}"), "left")
        beyond = rest.agg(*[F.count_if(F.col(c).isNotNull() & F.col(f"__hot_{n}").isNull()) for n, c in enumerate(whole)]).first()
        others |= {c: beyond[n] > 0 for n, c in enumerate(whole)}
    large = {c: [k for k, share in found if k is not None and share * tasks > 1] for c, found in sketched.items()}
    return {c: Frequent(frame(c, large[c]) if large[c] else None, True) if others[c] else Frequent(whole[c], False)
            for c in columns}


def _merge_join(fact: DataFrame, lookup: Lookup, frequent: Frequent) -> DataFrame:
    """Shuffled left join. Rows of frequent keys find their dimension row in a broadcast.

    That broadcast has a row per frequent key at most. These rows, and those without a key, are
    spread over all tasks of the exchange; if there are no others, there is no exchange.
    """
    dim = lookup.projection().where(F.col("__key").isNotNull())
    tasks = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.col(_SLOT), F.lit(tasks)) + 1
    if frequent.keys is None:
        left = fact.withColumn("__salt", F.when(F.col(lookup.on).isNull(), spread).otherwise(0).cast("int"))
        far = lookup.one_per_key(dim).withColumn("__zero", F.lit(0)).hint("merge")
        match = (F.col(lookup.on) == F.col("__key")) & (F.col("__salt") == F.col("__zero"))
        return left.join(far, match, "left").drop("__salt", "__key", "__zero")
    hot = F.broadcast(frequent.keys)
    near = lookup.one_per_key(dim.join(hot, F.col("__key") == F.col("__hot"), "left_semi"))
    names = list(lookup.take.values())
    near = near.select(F.col("__key").alias("__near"), *[F.col(n).alias(f"__near_{n}") for n in names])
    if not frequent.others:
        out = fact.join(F.broadcast(near), F.col(lookup.on) == F.col("__near"), "left")
        return out.select(*fact.columns, *[F.col(f"__near_{n}").alias(n) for n in names])
    marked = fact.join(hot, F.col(lookup.on) == F.col("__hot"), "left")
    left = marked.join(F.broadcast(near), F.col(lookup.on) == F.col("__near"), "left")
    cold = F.when(F.col("__hot").isNull(), F.col(lookup.on))
    left = left.withColumns({"__cold": cold, "__salt": F.when(cold.isNull(), spread).otherwise(0).cast("int")})
    far = lookup.one_per_key(dim).withColumn("__zero", F.lit(0)).hint("merge")
    out = left.join(far, (F.col("__cold") == F.col("__key")) & (F.col("__salt") == F.col("__zero")), "left")
    return out.select(*fact.columns, *[F.coalesce(F.col(f"__near_{n}"), F.col(n)).alias(n) for n in names])


@dataclass(frozen=True, eq=False)
class StarJoin:
    """How the lookups of a fact travel, as `plan_star_join` found it over the whole fact."""

    lookups: Sequence[Lookup]
    small: Sequence[Lookup]  # broadcast as they are
    frequent: Mapping[str, Frequent]
    reduced: Sequence[Lookup] = ()  # those of `small` that hold just the keys the fact has
    from_files: bool = True

    @property
    def moved(self) -> list[Lookup]:
        """Lookups for which the fact is exchanged."""
        return [x for x in self.lookups if x not in self.small and self.frequent[x.on].others]

    def rows(self, fact: DataFrame) -> DataFrame:
        """The fact, or any part of its rows, with all attributes."""
        out = fact
        if any(x.others for x in self.frequent.values()):
            slot = F.monotonically_increasing_id() if self.from_files else F.xxhash64(*fact.columns)
            out = out.withColumn(_SLOT, slot)  # before any shuffle
        # Exchanges come first and the widest lookup last, so that few attributes travel along.
        moved = self.moved
        for lookup in sorted(moved, key=lambda x: len(x.take)):
            out = _merge_join(out, lookup, self.frequent[lookup.on])
        for lookup in (x for x in self.lookups if x not in moved):
            if lookup in self.small:
                named = [F.col(f"__take_{i}").alias(name) for i, name in enumerate(lookup.take.values())]
                kept = out.columns
                out = out.join(F.broadcast(lookup.rows()), F.col(lookup.on) == F.col("__key"), "left").select(*kept, *named)
            else:
                out = _merge_join(out, lookup, self.frequent[lookup.on])
        return out.select(*fact.columns, *[name for x in self.lookups for name in x.take.values()])

    @contextmanager
    def stored(self) -> Iterator[StarJoin]:
        """The same join for a fact that comes in parts: the rows of large lookups are found once and kept meanwhile."""
        large = [x for x in self.lookups if x not in self.small or x in self.reduced]
        folders: dict[tuple, str] = {}

        def keep(x: Lookup) -> Lookup:
            spark, source = x.dim.sparkSession, x.source()
            if source not in folders:
                folders[source] = shared_folder(spark, "lookup")
                write_parquet(x.rows(), folders[source], codec="zstd")
            return x.among(spark.read.parquet(folders[source]))

        try:
            kept = {x: keep(x) for x in large}
            lookups, small, reduced = ([kept.get(x, x) for x in some] for some in (self.lookups, self.small, self.reduced))
            yield replace(self, lookups=lookups, small=small, reduced=reduced)
        finally:
            for folder in folders.values():
                remove_folder(large[0].dim.sparkSession, folder)


def plan_star_join(
    fact: DataFrame, lookups: Sequence[Lookup], strategy: str = "auto", *,
    measured: bool = False, from_files: bool = True,
) -> StarJoin:
    """Measure the lookups and the keys of the fact, as `star_join` tells."""
    if strategy not in ("auto", "merge"):
        raise ValueError(f"unknown strategy: {strategy}")
    for lookup in lookups:
        if lookup.on not in fact.columns:
            raise ValueError(f"{lookup.on} is not a column of the fact")
    lookups, reduced = list(lookups), []
    if measured:
        small = lookups
    elif strategy == "merge":
        small = []
    else:
        small = small_lookups([x for x in lookups if not x.large])
        used = used_lookups(fact, [x for x in lookups if x not in small and not x.large])
        if used:
            lookups = [used.get(x, x) for x in lookups]
            small = small_lookups([x for x in lookups if x in small or x in used.values()])
            reduced = [x for x in small if x in used.values()]

    spread = sorted({x.on for x in lookups if x not in small})
    frequent = frequent_keys(fact, spread) if spread else {}
    return StarJoin(lookups, small, frequent, reduced, from_files)


def star_join(
    fact: DataFrame, lookups: Sequence[Lookup], strategy: str = "auto", *,
    measured: bool = False, from_files: bool = True,
) -> DataFrame:
    """Attach all lookups, each on a column of the fact itself.

    `auto` broadcasts what fits, whole or by the keys that the fact has; `merge` broadcasts only the
    dimension rows of frequent keys. A second-level dimension is attached to its own parent first. With
    `measured` all lookups are already known to fit. What does not fit reads the keys of the fact up to
    four times more: a derived fact is stored first.

    Rows without a rare key are spread by a row number. That number is the same when a lost
    task runs again as long as the fact comes from files through projections and filters;
    for any other fact set `from_files` to False, and a hash of the row is used instead.
    """
    return plan_star_join(fact, lookups, strategy, measured=measured, from_files=from_files).rows(fact)
