"""Session helpers: shared scratch space, lineage cuts and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is broadcast only after its measured bytes proved to stay below this.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is made only where the session names none, which is the
    case in single-machine tests.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="creditloom-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    One write job, and what follows survives the loss of any executor without
    running the upstream plan again.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str = "id", buckets: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``key``, sorted in each, and read it back.

    Tables with equally many buckets join on ``key`` where they lie: no row of
    either moves. Rows are dealt once, here, so that a task writes one file per bucket it holds.
    The number of buckets is that of shuffle partitions unless given. The session's catalog
    keeps a name for the layout; a session that ends leaves the files only.
    """
    spark = df.sparkSession
    buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4096)
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Share the rows of a scan over all cores when it has fewer splits than cores.

    Meant for heavy work on a few files, or on files that cannot be split. A
    scan with enough splits is left alone, so large tables are not moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def unnest(df: DataFrame, keep: list[str], array: Column | str, *names: str) -> DataFrame:
    """One row per array element: ``keep`` and ``names`` (position first when two are given).

    The outer explode keeps Spark from testing the array's size in a filter of
    its own, which would compute an expensive array twice.
    """
    generator = F.posexplode_outer(array) if len(names) == 2 else F.explode_outer(array)
    rows = df.select(*keep, generator.alias(*names))
    # An element of an array is dropped only if it is NULL, as is an empty array's row.
    return rows.where(F.col(names[-1]).isNotNull())


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df``: 16 a row and plain value, 8 an array element, texts and other types by length."""
    def width(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.octet_length(c)
        if kind in ("array<double>", "array<float>", "array<bigint>", "array<int>"):
            return 8 * F.array_size(c)
        if "<" in kind or kind == "vector":
            return F.octet_length(F.to_json(F.struct(c)))
        return F.lit(0)

    row = sum((F.coalesce(width(n, k), F.lit(0)) + 16 for n, k in df.dtypes), F.lit(16))
    return df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0]


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str = "left",
    *,
    salt_by: Column | str | None = None,
    salts: int = 16,
    limit: int = BROADCAST_BYTES,
    size: int | None = None,
) -> DataFrame:
    """Join a large, possibly skewed fact table to a lookup with one row per key.

    A lookup of at most ``limit`` measured bytes (``size``, if they were measured
    before) is broadcast, so no fact row moves. A larger one is copied once per salt and the facts are spread over the salts by a hash of
    ``salt_by``: a key that holds a third of all facts is then shared by
    ``salts`` tasks. The salt depends on the row only, so a recomputed task
    places its rows as before.
    """
    if (measured_bytes(lookup) if size is None else size) <= limit:
        return facts.join(F.broadcast(lookup), on=on, how=how)
    if salt_by is None:
        return facts.join(lookup, on=on, how=how)
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    salted_lookup = lookup.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return salted_facts.join(salted_lookup, on=[on, "_salt"], how=how).drop("_salt")


def frequent_join(facts: DataFrame, lookup: DataFrame, on: str, *, salt_by: Column | str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join of many facts to a wide lookup that may be too large to broadcast.

    A lookup of at most ``limit`` measured bytes is broadcast. Of a larger one
    the rows of the most frequent keys, as many as the limit holds, are
    broadcast, so most facts stay where they are; facts of the other keys
    are few per key and go to theirs. Facts and lookup are then read several
    times, so they should be cheap to read.
    """
    size = measured_bytes(lookup)
    if size <= limit:
        return facts.join(F.broadcast(lookup), on)
    counts = cut_lineage(facts.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n")), "counts")
    known = counts.join(lookup.select(on), on)
    share = limit / size * lookup.count() / max(1, known.count())
    # No key of the rest has more facts than any broadcast one.
    least = 0 if share >= 1 else known.agg(F.percentile_approx("_n", 1 - share, 10000).alias("_n")).first()["_n"]
    frequent = cut_lineage(counts.where(F.col("_n") > least).select(on), "frequent")
    first = lookup_join(lookup, frequent, on, "left_semi")
    rest = lookup_join(lookup, frequent, on, "left_anti")
    rare = lookup_join(facts, frequent, on, "left_anti", salt_by=salt_by)
    return lookup_join(facts, first, on, "inner", salt_by=salt_by).unionByName(lookup_join(rare, rest, on, "inner"))
