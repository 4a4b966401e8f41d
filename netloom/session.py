"""Session settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

PACKED = 10.0
TASK_ROWS, TASK_BYTES = 100_000, 4 << 20  # rows of a table that one task has, and bytes that it reads from shuffles


def settle(spark: SparkSession) -> None:
    """Written tables are packed several times closer than rows in memory, which the estimate for broadcasts must know."""
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name, "1.0")) < PACKED:
        spark.conf.set(name, str(PACKED))


def deal(spark: SparkSession, rows: int) -> None:
    """Shuffles for tables that come from so many rows: what follows a shuffle sorts and joins its rows several times, so a
    task holds a bounded part of them, however large the tables are. Settings that deal finer stay."""
    parts, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    least = -(-rows // TASK_ROWS)
    if int(spark.conf.get(parts, None) or spark.conf.get("spark.sql.shuffle.partitions")) < least:
        spark.conf.set(parts, str(least))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > TASK_BYTES:
        spark.conf.set(size, str(TASK_BYTES))


def by_image(spark: SparkSession, on: bool) -> None:
    """Whether joins by image and more may use rows that are shuffled by image; not where images are crowded."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", str(not on).lower())


def build_session(app: str = "netloom", cpus: str = "*", shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and benchmarks; a cluster passes its own configuration."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "12g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
