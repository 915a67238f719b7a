"""Spark session settings and the shared folder used for written stages."""

from __future__ import annotations

from pyspark.sql import SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python call site of every Column makes plan building ~5x slower.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "queuelens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings the operators are written for.

    ``shuffle_partitions`` is only an upper bound to start from: adaptive
    execution merges small partitions, so on a cluster set it for the largest
    shuffle (raw bytes / ~128 MB) and let it shrink the rest.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application below a place every executor can reach.

    The place is ``spark.checkpoint.dir``.  On a cluster it has to be set: any default would
    be a folder of one machine.  With a local master, where the driver's folders are the
    executors' too, it may be unset; a folder in ``spark.sql.warehouse.dir`` serves then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(
                f"spark.checkpoint.dir is not set; master {master} needs a folder that all machines share"
            )
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"
    return f"{root.rstrip('/')}/queuelens-{spark.sparkContext.applicationId}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written folder, wherever it is stored."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
