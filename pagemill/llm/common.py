"""What the operators share: document identity, shared tables and connected components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from pagemill.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(table: DataFrame, stem: str) -> str:
    """A column name that the table does not have: the stem behind as many underscores as needed."""
    taken = {name.lower() for name in table.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def _has_order(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_order(kind.elementType)
    if isinstance(kind, StructType):
        return all(_has_order(field.dataType) for field in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def identified(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with an id, one for each id.

    A row without id cannot be named in a result and is left out. Rows that
    repeat an id are one document: the row that sorts first by its other
    columns, nulls last (maps and variants by their JSON text). Looking for repeats reads the id column only; without
    any, no row is moved.
    """
    present = table.filter(F.col(key).isNotNull())
    if not present.groupBy(key).count().filter("count > 1").limit(1).count():
        return present
    others = [name for name in table.columns if name != key]
    if not others:
        return present.distinct()
    by_text = [name for name in others if not _has_order(table.schema[name].dataType)]
    column = {name: F.to_json(F.struct(F.col(f"`{name}`"))) if name in by_text else F.col(f"`{name}`") for name in others}
    ordered = F.struct(*[part for name in others for part in (F.col(f"`{name}`").isNull(), column[name])])
    first, row = F.min_by(F.struct(*[F.col(f"`{name}`") for name in others]), ordered), free_name(table, "_row")
    return present.groupBy(key).agg(first.alias(row)).select(*[key if n == key else F.col(f"{row}.`{n}`") for n in table.columns])


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def stored(table: DataFrame, release: bool = False) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder.

    Unlike ``checkpoint()`` it is columnar, so later reads take only the columns
    they need, and it survives the loss of any executor. Shuffle files of a
    finished step stay on disk until the driver's garbage is collected;
    ``release`` asks for that now, for operators with several large steps.
    """
    spark, schema = table.sparkSession, table.schema
    path = shared_path(spark)
    table.write.parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table made by ``stored`` that nothing reads any more."""
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        if folder.rpartition("/")[2].startswith("table-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours over to its smallest one."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours over to its smallest one."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; root is the smallest node reachable.

    Large-star and small-star rounds until nothing moves. Each round joins the
    links to one row per node, pre-aggregated in the map tasks, and ends in a
    shared table, so no component ever meets in one task. Self links and repeats
    are allowed; an empty table gives no rows.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    current, before = stored(links), None
    while True:
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        following = stored(_small_star(_large_star(current)))
        discard(current)
        current, before = following, state
    roots = current.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
