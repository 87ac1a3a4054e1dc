"""Session helpers: table access, checkpoint folder and bounded broadcast."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session, whose tasks all run on this
    machine, may do without and gets a temporary folder; any other raises an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(current)
        return current
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "vellum-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when ``df`` has been counted and holds at most ``max_rows`` rows."""
    n = df.limit(max_rows + 1).agg(F.count(F.lit(1))).first()[0]
    return F.broadcast(df) if n <= max_rows else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, so that Python kernels can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_vellum_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vellum-")) / "vellum.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, f"{here.name}/{path.relative_to(here)}")
    sc.addPyFile(str(target))
    sc._vellum_shipped = True


#: Logical operators that keep the partitions of what they read.
NARROW = frozenset("Project Filter Generate MapInArrow MapInPandas LogicalRelation LogicalRDD LocalRelation Union SubqueryAlias".split())


def _is_narrow(plan) -> bool:
    """Whether a logical plan reads its sources without an exchange."""
    below = plan.children()
    return plan.getClass().getSimpleName() in NARROW and all(_is_narrow(below.apply(i)) for i in range(below.length()))


def spread(df: DataFrame) -> DataFrame:
    """Deal ``df`` out over all cores where its files give less than half as many partitions as there are cores.

    Only frames straight from a source are dealt out; what comes from a shuffle is left as it is, since
    asking for its partitions would run the stages before it while the plan is still being built.
    """
    if not _is_narrow(df._jdf.queryExecution().optimizedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
