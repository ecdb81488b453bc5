"""Incremental import: exports arrive in a folder one at a time; known identities are skipped, conflicts fail."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.imports import IDENTITY, additions, conflicts
from ..operators.integrate import require_clean
from ..sources.tables import written

SCHEMA = "request_id string, repeat_id string, concept_id string, date date, interest double, is_partial boolean"


def import_batch(batch: DataFrame, store: str, batch_id: int) -> None:
    """Adds a batch's new observations to the store under the batch's own folder, so that a batch that is tried again replaces itself.

    The store is partitioned by import_batch; a repeated batch doesn't see its own earlier rows as known.
    """
    spark = batch.sparkSession
    try:
        known = spark.read.schema(SCHEMA + ", import_batch long").parquet(store).where(f"import_batch <> {batch_id}")
    except Exception as e:  # the first batch finds no store
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], SCHEMA + ", import_batch long")
    batch = batch.select(*IDENTITY, "interest", "is_partial")
    require_clean(conflicts(known, batch), "known observations with other values")
    additions(known, batch).write.mode("overwrite").parquet(f"{store}/import_batch={batch_id}")


def import_stream(spark: SparkSession, landing: str, store: str, checkpoint: str):
    """A query that imports every Parquet file of observations that lands, each once. It is keyed by identity, so that it needs no watermark."""
    rows = spark.readStream.schema(SCHEMA).parquet(landing)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: import_batch(df, store, n)).start()


#: Parts of a store by the hash of the request; a batch reads the parts that its requests fall in.
PARTS = 64


def decided(batch: DataFrame, known: DataFrame, parts: int = PARTS) -> DataFrame:
    """Each different row of a batch with its status: new, repeated (known with this value), or conflict (known with another, or of several values of
    one batch not the smallest), and the value that stands against it."""
    value = F.struct("interest", "is_partial")
    rows = batch.select(*IDENTITY, value.alias("v")).distinct()
    least = rows.groupBy(*IDENTITY).agg(F.min("v").alias("least"))
    old = known.select(*IDENTITY, F.struct("interest", "is_partial").alias("old"))
    rows = rows.join(least, IDENTITY).join(old, IDENTITY, "left").withColumn("stands", F.coalesce("old", "least"))
    status = F.when(~F.col("v").eqNullSafe(F.col("stands")), "conflict").when(F.col("old").isNull(), "new").otherwise("repeated")
    part = F.pmod(F.xxhash64("request_id"), F.lit(parts)).cast("int")
    return rows.select(*IDENTITY, "v.*", part.alias("part"), status.alias("status"), F.when(status == "conflict", F.col("stands.interest")).alias("old_interest"))


def import_parted_batch(batch: DataFrame, store: str, batch_id: int, parts: int = PARTS) -> None:
    """Adds a batch's new observations to a store whose folders are parts by request, reading only the parts that the batch touches.

    store/rows holds observations by part and batch, store/conflicts the rows put aside, store/log a row for each batch: rows, added,
    repeated, conflicting, parts touched, files read. A batch that is tried again replaces what it wrote before and does not see it as known.
    """
    spark = batch.sparkSession
    part = F.pmod(F.xxhash64("request_id"), F.lit(parts)).cast("int")
    touched = [r[0] for r in batch.select(part.alias("part")).distinct().collect()]  # no more than parts
    kept = spark.createDataFrame([], SCHEMA + ", part int, import_batch long")
    if _exists(spark, f"{store}/rows"):
        kept = spark.read.schema(kept.schema).parquet(f"{store}/rows").where(F.col("part").isin(touched) & (F.col("import_batch") != batch_id))
        files = kept.select("_metadata.file_path").distinct().count()
    else:
        files = 0
    rows = written(decided(batch, kept, parts), "decided")
    new = rows.where("status = 'new'").select(*IDENTITY, "interest", "is_partial", "part", F.lit(batch_id).cast("long").alias("import_batch"))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "import_batch").parquet(f"{store}/rows")
    rows.where("status = 'conflict'").select(*IDENTITY, "interest", "is_partial", "old_interest").write.mode("overwrite").parquet(f"{store}/conflicts/import_batch={batch_id}")
    n = lambda s: F.count_if(F.col("status") == s)
    log = rows.agg(F.count("*").alias("rows"), n("new").alias("added"), n("repeated").alias("repeated"), n("conflict").alias("conflicting"))
    log = log.withColumns({"parts": F.lit(len(touched)), "files_read": F.lit(files)})
    log.write.mode("overwrite").parquet(f"{store}/log/import_batch={batch_id}")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(SCHEMA).parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def import_parted_stream(spark: SparkSession, landing: str, store: str, checkpoint: str, parts: int = PARTS):
    """A query that imports every Parquet file of observations that lands, each once, in work that grows with the batch and the parts it touches."""
    rows = spark.readStream.schema(SCHEMA).parquet(landing)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: import_parted_batch(df, store, n, parts)).start()
