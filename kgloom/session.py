"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "kgloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what ``spark.checkpoint.dir`` names. Only a local session without it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="kgloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a finite lineage that outlives any executor."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/kgloom-cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, at))
    return spark.read.schema(df.schema).parquet(at)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more."""
    for f in df.inputFiles():
        at = f.rsplit("/", 1)[0]
        for entry in [e for e in _written if e[1].rsplit("/", 1)[-1] == at.rsplit("/", 1)[-1]]:
            _delete(*entry)
            _written.remove(entry)


def _delete(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001, S110 - a stopped session can't delete; the folder belongs to the cluster then
        pass


def _sweep() -> None:
    for spark, at in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, at)
