"""Session construction and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str | None = None, app: str = "engramspark", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a fresh one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="engramspark-checkpoint-")
    sc.setCheckpointDir(shared)


#: Spark deletes the shuffle files of a plan made under this once the plan has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[list[DataFrame]] = []


@contextmanager
def cleaning(df: DataFrame) -> Iterator[None]:
    """Plans made inside leave no shuffle files when they have run: what they wrote is read instead."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        conf.set(CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    with cleaning(df):
        once = df.select("*")  # a plan of its own
    table = once.checkpoint(eager=True)
    if _made:
        _made[-1].append(table)
    return table


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``materialize`` of what ``make`` returns; tables materialized on the way are deleted, so nothing else may read them."""
    _made.append([])
    try:
        table = materialize(make())
    finally:
        steps = _made.pop()
    for step in steps:
        if step is not table:
            discard(step)
    if _made:
        _made[-1].append(table)
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a materialized or stored table that is not read any more."""
    plan = table._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        file = plan.rdd().getCheckpointFile()
        folders = [file.get()] if file.isDefined() else []
    else:
        folders = {f.rpartition("/")[0] for f in table.inputFiles()}
    for folder in folders:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``materialize``, in compressed columns: for long tables of repeated names that are read more than once."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with cleaning(df):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for costly row work on a scan with fewer partitions than cores.

    Large inputs have more partitions than cores and pass through without a shuffle, as does
    anything that already shuffles: asking it for its partitions would start its stages.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lookup(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """Materialize a per-key table and broadcast it if its counted rows stay within ``limit``.

    Joining a large table to it then needs no shuffle by a possibly hot key; above the
    limit the join is left to the planner.
    """
    table = materialize(df)
    return F.broadcast(table) if table.count() <= limit else table


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the Arrow kernels."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="engramspark-package-")) / "engramspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path(package.name) / f.relative_to(package))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
