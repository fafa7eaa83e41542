"""Joins and rankings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.session import ensure_checkpoint_dir

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 32
SMALL_ROWS = 500_000
RANGE_CHARACTERS = 256
HOT_SHARE = 1 / 1000
HOT_KEYS = 1000  # no more keys than this can hold that share


def is_small(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure, do not guess: at most ``max_rows + 1`` rows are looked at."""
    size = (
        table.limit(max_rows + 1)
        .agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b"))
        .first()
    )
    return size["n"] <= max_rows and (size["b"] or 0) <= max_bytes


def join_dimension(
    facts: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    small: bool | None = None,
) -> DataFrame:
    """Join facts to one row per key of a dimension that may or may not be small.

    A small dimension is broadcast. A large one is copied ``salts`` times and the
    facts spread by a hash of ``spread``, so a job with a third of all pages
    still fills many tasks. ``small`` passes on an earlier measurement.
    """
    keys = list(keys)
    if is_small(dimension, max_rows, max_bytes) if small is None else small:
        return facts.join(F.broadcast(dimension), keys, how)
    salted = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    marked = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return marked.join(salted, [*keys, "_salt"], how).drop("_salt")


def hot_keys(table: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Hashes of the keys holding more than ``share`` of all rows: never over ``HOT_KEYS`` rows.

    One mergeable sketch per task, so nothing is shuffled by key.
    """
    top = table.select(F.xxhash64(*keys).alias("_h")).agg(
        F.expr(f"approx_top_k(_h, {HOT_KEYS}, {HOT_KEYS * 16})").alias("top"), F.count("*").alias("n")
    )
    items = top.select("n", F.explode("top").alias("t"))
    return items.filter(F.col("t.count") > F.greatest(F.lit(1000), F.col("n") * share)).select(
        F.col("t.item").alias("_h"), F.lit(True).alias("_hot")
    )


def join_hot(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    hot: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join to a right side with unique keys, the left side's hot keys salted.

    Only rows of hot keys are salted and copied; all others keep one partner
    partition. The list of hot keys is bounded, hence the broadcast.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(left, keys) if hot is None else hot)
    spread_left = (
        left.withColumn("_h", F.xxhash64(*keys))
        .join(hot, "_h", "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(0).cast("int"))
        .drop("_h", "_hot")
    )
    copied_right = (
        right.withColumn("_h", F.xxhash64(*keys))
        .join(hot, "_h", "left")
        .withColumn(
            "_salt",
            F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("_h", "_hot")
    )
    return spread_left.join(copied_right, [*keys, "_salt"], how).drop("_salt")


class Buckets:
    """A table in the shared folder, dealt by its keys once: joins on them move the other side only.

    A checkpoint forgets how its rows are dealt, a bucketed table does not. There
    are as many buckets as shuffle partitions, so that a grouping by the same keys
    meets a bucket as it is. Rows can be appended; each append adds a file to
    every bucket. Reads go through the session's catalog until ``closed``, which
    gives the rows as plain Parquet and takes the name out of the catalog.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str]):
        self.spark, self.keys = spark, list(keys)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"buckets_{uuid.uuid4().hex}"
        self.path = f"{ensure_checkpoint_dir(spark)}/{self.name}"

    @classmethod
    def at(cls, spark: SparkSession, keys: Sequence[str], path: str, fields: str, buckets: int) -> Buckets:
        """A table at a path of its own, of this or an earlier session; the number of buckets must be the same each time."""
        table = cls(spark, keys)
        table.path, table.buckets = path, buckets
        named = ", ".join(f"`{key}`" for key in table.keys)
        spark.sql(f"CREATE TABLE {table.name} ({fields}) USING parquet CLUSTERED BY ({named}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return table

    def append(self, rows: DataFrame) -> Buckets:
        dealt = rows.repartition(self.buckets, *self.keys)  # one file for each bucket
        dealt.write.format("parquet").mode("append").option("compression", "zstd").bucketBy(self.buckets, *self.keys).option("path", self.path).saveAsTable(self.name)
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def closed(self) -> DataFrame:
        schema = self.read().schema
        self.spark.sql(f"DROP TABLE {self.name}")  # the files stay, the table being an external one
        return self.spark.read.schema(schema).parquet(self.path)


def durable(table: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that outlives executors."""
    ensure_checkpoint_dir(table.sparkSession)
    return table.checkpoint(eager=True)


def running_totals(
    table: DataFrame, group: Sequence[str], order: Sequence[str], totals: dict[str, Column], small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Inclusive running sums per group, in a unique order, for groups of any size.

    A table of up to ``small_rows`` rows is one plain window. A larger one is
    range-partitioned by (group, order); each slice is summed on its own and
    shifted by the sums of the slices before it. Then a group never meets in one
    task; only one row per group and slice is brought together.
    """
    group, order = list(group), list(order)
    fixed = durable(table)
    kept = [name for name in table.columns if name not in totals]
    if fixed.limit(small_rows + 1).count() <= small_rows:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return fixed.select(*kept, *[F.sum(value).over(window).alias(name) for name, value in totals.items()])
    # The ranges are found on the driver from a sample of the keys, some hundred rows for each task: of a
    # long text only its beginning goes there, and texts with the same beginning stay in one slice.
    texts = {name for name, kind in fixed.dtypes if kind == "string"}
    ends = [F.substring(name, 1, RANGE_CHARACTERS) if name in texts else F.col(name) for name in order]
    # Slice numbers depend on sampled ranges: fix them before they are used twice.
    slices = durable(fixed.repartitionByRange(*group, *ends).withColumn("_slice", F.spark_partition_id()))
    within = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = slices.select("*", *[F.sum(value).over(within).alias(f"_run_{name}") for name, value in totals.items()])
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slices.groupBy(*group, "_slice")
        .agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()])
        .select(
            *group,
            "_slice",
            *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_off_{name}") for name in totals],
        )
    )
    joined = local.join(offsets, [*group, "_slice"])
    return joined.select(
        *kept, *[(F.col(f"_run_{name}") + F.col(f"_off_{name}")).alias(name) for name in totals]
    )


def row_numbers(table: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based rank per group without a single-task window."""
    return running_totals(table, group, order, {name: F.lit(1).cast("bigint")})
