"""Tables, shared scratch tables and session settings used by every operator here."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import remove, shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(schema: T.StructType, **kinds: str) -> T.StructType:
    """The schema with further fields; ``StructType.add`` would change the one a DataFrame holds."""
    return T.StructType([*schema.fields, *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in kinds.items())])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of an executor.

    ``drop`` removes a table that nothing lazy refers to any more; ``last`` keeps
    a result alone.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, **options) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def last(self, df: DataFrame) -> DataFrame:
        """Write a result to a table of its own and remove all the others."""
        result = Scratch(self.spark, "result").write(df)
        self._delete(self.root)
        return result

    def _delete(self, path: str) -> None:
        remove(self.spark, path)

    def settle(self) -> None:
        """Let the context's cleaner free the shuffle files and broadcasts of finished steps: it does so when the driver collects garbage."""
        self.spark._jvm.System.gc()


def doc_bucket(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


#: Labels up to this many are broadcast with their counts; more are joined by a shuffle.
BROADCAST_LABELS = 10_000


def bounded_sample(df: DataFrame, label: str, key: str, per_label: int, late: str | None = None) -> DataFrame:
    """At most ``per_label`` rows of each label, chosen by a hash of ``key``; rows whose ``late`` is greater come after others.

    Counts are taken over all rows; a hash threshold keeps what is shuffled small
    before the exact cut, however many rows one label has. Null keys are left out.
    """
    from pyspark.sql import Window

    kinds = [label, late] if late else [label]
    df = df.where(F.col(key).isNotNull())
    counts = df.groupBy(*kinds).count()
    few = counts.limit(BROADCAST_LABELS + 1).collect()  # a pass over the rows; a row for each label
    if len(few) <= BROADCAST_LABELS:
        counts = F.broadcast(df.sparkSession.createDataFrame(few, counts.schema))
    slot = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20))
    thin = df.withColumn("_slot", slot).join(counts, kinds).where(F.col("_slot") * F.col("count") <= F.lit(float((1 << 20) * per_label * 2)))
    order = Window.partitionBy(label).orderBy(*([late] if late else []), "_slot", key)
    return thin.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label).drop("_slot", "_n", "count", *([late] if late else []))
