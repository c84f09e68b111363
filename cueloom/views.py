"""Cue tables over the star-schema and document tables: the corpus that the registered queries work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Default timing of untimed lines: a cue of 2.0 s and a gap of 0.2 s.
CUE_MS, STEP_MS = 2000, 2200
#: Bytes of files that a task gets where a table of few files is dealt out.
SPREAD_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out anew if their files are fewer than the cores: a small file is one task, however much work follows. A task
    gets SPREAD_BYTES of the files at most, so that tasks become more with the table and not larger."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(cores, -(-size // SPREAD_BYTES)))


def sequential(cues: DataFrame) -> DataFrame:
    """start_ms and end_ms by cue_no for cues without times."""
    start = ((F.col("cue_no") - 1) * STEP_MS).cast("bigint")
    return cues.withColumn("start_ms", start).withColumn("end_ms", start + CUE_MS)


def cues_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cue for each line of a document that isn't blank; no shuffle, unless the table is one of few files."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select(F.col("doc_id").alias("file_id"), "lang", F.posexplode(lines).alias("cue_no", "text"))
    return sequential(rows.withColumn("cue_no", F.col("cue_no") + 1))


CUES_DOC = """cues_lines AS (SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents),
cues_doc AS (SELECT file_id, lang, cue_no, text, CAST((cue_no - 1) * 2200 AS BIGINT) AS start_ms, CAST((cue_no - 1) * 2200 + 2000 AS BIGINT) AS end_ms
  FROM (SELECT doc_id AS file_id, lang, unnest(l) AS text, generate_subscripts(l, 1) AS cue_no FROM cues_lines))"""


def cues_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cue for each turn of a conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), "role", "text", "conv_id", "turn")
    return sequential(rows.withColumn("cue_no", F.row_number().over(order)).drop("conv_id", "turn"))


CUES_CONV = """cues_conv AS (SELECT file_id, role, text, cue_no, CAST((cue_no - 1) * 2200 AS BIGINT) AS start_ms, CAST((cue_no - 1) * 2200 + 2000 AS BIGINT) AS end_ms
  FROM (SELECT conv_id AS file_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cue_no FROM conversations))"""


def cues_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cue for each event of a user, in order, without end times; start_ms counts from 1970."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), F.row_number().over(order).alias("cue_no"), F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text")
    )
    return rows.withColumn("end_ms", F.lit(None).cast("bigint"))


CUES_EVT = """cues_evt AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cue_no, epoch_us(ts) // 1000 AS start_ms, CAST(NULL AS BIGINT) AS end_ms,
  concat_ws(' ', event_type, CAST(event_id AS VARCHAR)) AS text FROM events)"""


def with_sql(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
