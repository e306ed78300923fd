"""Cluster helpers: shared-folder tables, checked broadcasts and hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its rows take at most this many bytes.
BROADCAST_BYTES = 24_000_000
_ENDS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it names none, a temporary one is made in local mode (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master or "").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemesh-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_end(spark: SparkSession, folder: str) -> None:
    """Deletes the tables of this application when Python ends, if its session still runs."""
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, folder)
    except Exception:  # noqa: BLE001 - the session is gone; the folder stays for the cluster's own cleaning
        pass


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to a Parquet table in the shared folder and reads it back: cuts lineage and survives lost executors.

    Columns and rows stay as they are. An empty df gives an empty table with the same schema. Tables lie in one folder per
    application, which is deleted when Python ends; `discard` deletes one that nothing reads any more.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tidemesh-{spark.sparkContext.applicationId}"
    if folder not in _ENDS:
        _ENDS.add(folder)
        atexit.register(_at_end, spark, folder)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `materialise`; nothing that still is to run may read them."""
    for t in tables:
        if getattr(t, "_table", None):
            _delete(t.sparkSession, t._table)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of df and their bytes: 16 a value, and what strings and lists hold."""
    width, more = 0, []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        width += 16
        if kind in ("string", "binary"):
            more.append(F.coalesce(F.length(f"`{f.name}`"), F.lit(0)))
        elif kind in ("array", "map"):
            more.append(16 * F.greatest(F.size(f"`{f.name}`"), F.lit(0)))
        elif kind == "struct":
            width += 16 * len(f.dataType.fields)
    n, extra = df.agg(F.count("*"), F.sum(sum(more, F.lit(0)).cast("long"))).first()
    return n, n * width + (extra or 0)


def if_small(df: DataFrame, most: int = BROADCAST_BYTES, scan: bool = False) -> DataFrame:
    """broadcast(df) if its rows are measured to take at most `most` bytes, else df, which then joins by shuffle.

    df is written to a table first, unless it is one, so that its plan runs once; `scan` says that df is hardly more than
    the scan of a small table, which is cheaper to read twice.
    """
    side = df if scan or getattr(df, "_table", None) else materialise(df)
    return F.broadcast(side) if measured(side)[1] <= most else side


def _sliced(top: list, slice_rows: int) -> dict[int, int]:
    return {int(e["item"]): -(-int(e["count"]) // slice_rows) for e in top or [] if e["item"] is not None and e["count"] > slice_rows}


def hot_keys(df: DataFrame, key: Column, slice_rows: int = 20_000, most: int = 256) -> dict[int, int]:
    """Key (bigint) -> number of slices, for keys of more than slice_rows rows.

    One pass with a frequent-items sketch, whose answer has at most `most` entries whatever the data. It steers only how
    rows are spread, never which rows take part, so a sketch is enough.
    """
    found = df.select(key.alias("k")).agg(F.expr(f"approx_top_k(k, {most}, {16 * most})").alias("t"))
    return _sliced(found.first()["t"], slice_rows)


def slices(key: Column, hot: dict[int, int]) -> Column:
    """Number of slices of a key: 1 unless it is hot."""
    if not hot:
        return F.lit(1)
    pairs = F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])
    return F.coalesce(pairs[key], F.lit(1))


def salted(big: DataFrame, small: DataFrame, key: Column, row_id: Column, slice_rows: int = 20_000, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """Adds `_salt` to both sides of an equi-join, so that no hot key of either goes to one task.

    `key` is an expression over columns both sides have. Rows of a key that is hot in `big` spread by row_id (copies stay
    together) and those of `small` are repeated over its slices; rows of a key that is hot in `small` spread by a hash of
    the row, and those of `big` are repeated. Every pair meets once. Keys that are hot on neither side stay as they are.
    """
    both = big.select(key.alias("k"), F.lit(True).alias("b")).unionByName(small.select(key.alias("k"), F.lit(False).alias("b")))
    sketch = f"approx_top_k(k, {most}, {16 * most})"
    top = both.agg(F.expr(f"{sketch} filter (where b)").alias("big"), F.expr(f"{sketch} filter (where not b)").alias("small")).first()
    of_big, of_small = _sliced(top["big"], slice_rows), _sliced(top["small"], slice_rows)
    if not of_big and not of_small:
        return big.withColumn("_salt", F.lit(0)), small.withColumn("_salt", F.lit(0))
    n, m = slices(key, of_big), slices(key, of_small)
    mine, yours = F.pmod(F.xxhash64(row_id), n), F.pmod(F.xxhash64(*small.columns), m)
    return (
        big.withColumn("_salt", F.explode(F.transform(F.sequence(F.lit(0), m - 1), lambda j: (mine * m + j).cast("int")))),
        small.withColumn("_salt", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * m + yours).cast("int")))),
    )


def usable(*cols: Column) -> Column:
    """True where every value is neither null, NaN nor infinite."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(ok, F.lit(False))
