"""Session settings and the one way this engine cuts lineage: a written table in the shared folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables that materialize() wrote and that still exist, by application.
_written: dict[str, set[str]] = {}


def build_session(app: str = "chronoloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects. On a cluster, let the submitter choose master and memory."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python workers, once per session: they need not start in its folder, nor have it installed.

    The archive lies in the shared folder and Spark hands it out from there."""
    sc = spark.sparkContext
    if getattr(sc, "_chronoloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if root.endswith(".zip" + os.sep + "chronoloom"):  # this process was given it itself
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join("chronoloom", os.path.relpath(os.path.join(folder, f), root)))
    path = f"{shared_dir(spark)}/chronoloom-{uuid.uuid4().hex}.zip"
    p, fs = _file(spark, path)
    out = fs.create(p)
    out.write(data.getvalue())
    out.close()
    fs.deleteOnExit(p)
    sc.addPyFile(path)
    sc._chronoloom_shipped = True


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests, a laptop) a temporary one is set for the session."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        jd = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = jd.get() if jd.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and survives a lost executor.

    The table goes with discard(), with release(), or when the session's JVM ends, whichever comes first."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronoloom_path = path
    return out


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted by release(), or when the session's JVM ends."""
    p, fs = _file(spark, path)
    fs.deleteOnExit(p)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that materialize() wrote. Only for tables that no plan still to be run reads."""
    for df in tables:
        path = getattr(df, "_chronoloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all tables that materialize() wrote in this session: for long sessions, after the results that read them were written."""
    for path in list(_written.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _file(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def catalyst_column(expression) -> Column:
    """A Column around a JVM Catalyst expression."""
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = SparkSession.active()._jvm
    return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def column_expression(c: Column):
    return SparkSession.active()._jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(c._jc)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def millis_to_period(c: Column) -> Column:
    """UTC month YYYY-MM of unix milliseconds; the session time zone is UTC."""
    return F.date_format(F.timestamp_millis(c), "yyyy-MM")
