"""Session helpers: defaults for local runs, the checkpoint folder, and shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


def _given() -> dict[str, str]:
    """Settings from outside (spark-submit, whose JVM is up already)."""
    if "PYSPARK_GATEWAY_PORT" in os.environ or SparkContext._jvm is not None:
        SparkContext._ensure_initialized()
        return dict(SparkConf().getAll())
    return {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tillrec") -> SparkSession:
    """The active session, or a new one; nothing that is set from outside is overridden.

    Without a master from outside (``master``, spark-submit, ``PYSPARK_SUBMIT_ARGS``) the session is
    local and sized by ``BENCH_CPUS``. AQE stays on so that shuffle partitions coalesce, skewed join
    partitions split and small build sides switch to broadcast at run time.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    given = _given()
    conf = {
        "spark.app.name": app_name,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    outside = "spark.master" in given or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if master or not outside:
        cpus = os.environ.get("BENCH_CPUS", "8")
        conf["spark.master"] = master or f"local[{cpus}]"
        if conf["spark.master"].startswith("local"):
            conf |= {
                "spark.sql.shuffle.partitions": cpus,
                "spark.driver.memory": os.environ.get("TILLREC_DRIVER_MEMORY", "16g"),
                "spark.driver.host": "127.0.0.1",
                "spark.driver.bindAddress": "127.0.0.1",
                "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
            }
    conf = {k: v for k, v in conf.items() if k not in given}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names in spark.checkpoint.dir.

    A local session without the setting gets a folder of its own; on a cluster that is an error,
    since a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tillrec-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once below the shared folder and read back, for steps that read them several times."""
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def compiled_code(spark: SparkSession) -> None:
    """HotSpot leaves methods beyond 8000 bytes of bytecode to its interpreter, which is what wide parses fuse
    into by default. Beyond this limit Spark generates many small methods instead; a limit set outside stays."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name, None) in (None, "65535"):
        spark.conf.set(name, "8000")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the session was started from."""
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tillrec-src-"), "tillrec_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
