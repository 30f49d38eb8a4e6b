"""Sessions, table readers and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; other settings are the caller's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows and bytes of an Arrow batch where the session names none: texts are long, and a batch is held whole on either side.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers of this session the package, once per context."""
    named = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in ARROW_BATCH.items():
        if key not in named:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_palimpsest_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="palimpsest-pkg-")
    target = os.path.join(folder, "palimpsest_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(target)
    context._palimpsest_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a folder of our own where it is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark, "_palimpsest_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark._palimpsest_scratch = own
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared one that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str) -> DataFrame:
    """df as the table it is written to: lineage ends there, so a lost executor costs no more than what follows."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing lazy refers to any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
