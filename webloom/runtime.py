"""Session defaults, table loading and shared intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MADE: set[str] = set()


def session(app: str = "webloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the plans are written for (UTC, AQE with skew handling, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or (only where that is unset and all
    executors are threads of this process, as in tests) a temporary folder, which is set on the session so that
    checkpoint() uses it too."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("webloom.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        at = tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("webloom.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and a lost executor costs
    nothing, since every other one can read the files. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    if not _MADE:
        atexit.register(_clean)
    _MADE.add(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete the shared tables made so far, but for those named in keep."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in list(_MADE - set(keep)):
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _MADE.discard(p)


def _clean() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            drop_shared(spark)
    except Exception:  # the gateway may be gone already; the folder's owner cleans up then
        pass


def one_delivery(df: DataFrame, key: str, *cols: str | Column) -> DataFrame:
    """One row for each key with the given columns, whatever the number of deliveries.

    It is the earliest one where the table tells when rows came in (ingested_at), whole: columns of two deliveries are
    never mixed. Deliveries have the same content, so ties change nothing. The aggregation combines before the shuffle,
    so a key delivered a million times reaches its reducer once per input split. A null key is no key and gives no row.
    """
    picked = [F.col(c) if isinstance(c, str) else c for c in cols]
    at = F.col("ingested_at") if "ingested_at" in df.columns else F.lit(0)
    flat = df.where(F.col(key).isNotNull()).select(key, *picked, at.alias("_came_in"))
    rest = [c for c in flat.columns if c not in (key, "_came_in")]
    if not rest:
        return flat.select(key).distinct()
    if len(rest) == 1:
        return flat.groupBy(key).agg(F.min_by(rest[0], "_came_in").alias(rest[0]))
    return flat.groupBy(key).agg(F.min_by(F.struct(*rest), "_came_in").alias("_row")).select(key, "_row.*")


def width(spark: SparkSession) -> int:
    """Partitions for a stage whose work is far above its bytes (parsing documents in Python), which the adaptive
    coalescing, judging by bytes alone, would put into a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(n: int, *keys: str | Column) -> Column:
    """A salt in 0..n-1 that depends on the row's own keys only, so a re-run task gives the same rows."""
    return F.pmod(F.xxhash64(*keys), F.lit(n))


def ranked(df: DataFrame, by: list, order: list, top: int, name: str = "rk") -> DataFrame:
    """The first `top` rows of each group; Spark prunes with WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= top)


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' import path, once a session, so that Python stages run on any cluster."""
    if spark.conf.get("webloom.shipped", None) == spark.sparkContext.applicationId:
        return
    home = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="webloom-ship-")) / "webloom_package.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*")):
            if p.suffix in (".py", ".json"):
                z.write(p, Path(home.name) / p.relative_to(home))
    spark.sparkContext.addPyFile(str(at))
    spark.conf.set("webloom.shipped", spark.sparkContext.applicationId)
