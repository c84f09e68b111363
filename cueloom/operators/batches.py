"""Size-bounded batches, guarded enrichment by caller-supplied functions, chunks and peaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_CHARS = 7000


def greedy_batches(cues: DataFrame, most: int = BATCH_CHARS) -> DataFrame:
    """cues with batch: rows fill a file's batch in order up to `most` characters, one more for each; a longer row stands alone."""

    def fill(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, used, batch = None, None, 0  # None: no row yet, so that a null file_id is a file too
        for part in rows:
            out = []
            for own, n in zip(part.column("file_id").to_pylist(), part.column("_n").to_pylist(), strict=True):
                if used is None or own != file:
                    file, used, batch = own, 0, 0
                if used and used + n > most:
                    used, batch = 0, batch + 1
                used += n
                out.append(batch)
            kept = part.drop_columns(["_n"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.int32())], [*kept.schema.names, "batch"])

    # rows of a file follow each other in one partition, of which batches go through a worker: no file is held whole
    ordered = cues.withColumn("_n", F.length(F.coalesce("text", F.lit(""))) + 1).repartition("file_id").sortWithinPartitions("file_id", F.asc_nulls_last("cue_no"))
    return ordered.mapInArrow(fill, T.StructType([*cues.schema.fields, T.StructField("batch", T.IntegerType())]))


def chunks(docs: DataFrame, most: int = 2500) -> DataFrame:
    """(doc_id, text) to (doc_id, chunk_no, chunk): up to `most` characters, cut at line breaks; a longer line is a chunk of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("now"))
    join = lambda acc, x: F.concat(acc["now"], F.lit("\n"), x)
    step = lambda acc, x: F.when(acc["now"].isNull(), F.struct(acc["out"].alias("out"), x.alias("now"))).when(F.length(join(acc, x)) > most, F.struct(F.concat(acc["out"], F.array(acc["now"])).alias("out"), x.alias("now"))).otherwise(F.struct(acc["out"].alias("out"), join(acc, x).alias("now")))
    parts = F.aggregate(F.split(F.coalesce("text", F.lit("")), "\n"), empty, step, lambda acc: F.concat(acc["out"], F.array(acc["now"])))
    return docs.select("doc_id", F.posexplode(parts).alias("chunk_no", "chunk")).filter("chunk <> ''")


def guarded(out: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of batches (keys) with as many rows as the source has, and the batches that have not."""
    n = lambda d, name: d.groupBy(*keys).agg(F.count("*").alias(name))
    compared = n(source, "_a").join(n(out, "_b"), keys, "left")
    bad = compared.filter(F.coalesce("_b", F.lit(0)) != F.col("_a")).select(*keys)
    return out.join(bad, keys, "left_anti"), bad


def map_text(cues: DataFrame, f: Callable[[str], str], column: str = "text") -> DataFrame:
    """f applied to every text that isn't blank, with ok added; a row on which f fails keeps its text."""
    schema = T.StructType([*[x for x in cues.schema.fields if x.name != "ok"], T.StructField("ok", T.BooleanType())])

    def one(value: str | None) -> tuple[str | None, bool]:
        if value is None or not value.strip():
            return value, True
        try:
            return f(value), True
        except Exception:  # the caller's function may fail in any way; the row says so
            return value, False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [one(v) for v in batch[column]]
            yield batch.assign(**{column: [d[0] for d in done], "ok": [d[1] for d in done]})[schema.names]

    return cues.drop("ok").mapInPandas(run, schema)


def map_batches(cues: DataFrame, f: Callable[[list[str]], list[str]], most: int = BATCH_CHARS, tries: int = 2) -> DataFrame:
    """f applied to each batch's texts, one result for each; a batch whose count differs or which fails `tries` times keeps its texts
    with ok false."""
    batched = greedy_batches(cues.select("file_id", "cue_no", "text"), most)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cue_no")
        texts = group["text"].fillna("").tolist()
        for _ in range(tries):
            try:
                new = f(texts)
            except Exception:  # the caller's function may fail in any way; the batch says so
                continue
            if len(new) == len(texts):
                return group.assign(text=new, ok=True)
        return group.assign(ok=False)

    done = batched.groupBy("file_id", "batch").applyInPandas(run, T.StructType([*batched.schema.fields, T.StructField("ok", T.BooleanType())]))
    return cues.drop("text", "ok").join(done.select("file_id", "cue_no", "text", "ok"), ["file_id", "cue_no"])


def bridge(cues: DataFrame, f: Callable[[str], str]) -> DataFrame:
    """One bridge_text a cue; blank texts pass, and a file with any failure gets none."""
    done = map_text(cues.withColumn("bridge_text", F.col("text")), f, "bridge_text")
    sound = done.groupBy("file_id").agg(F.bool_and("ok").alias("_sound"))
    return done.join(sound, "file_id").withColumn("bridge_text", F.when(F.col("_sound"), F.col("bridge_text"))).drop("_sound", "ok")


def peaks(samples: DataFrame, buckets: int = 4000) -> DataFrame:
    """(series_id, i from 0, v) to (series_id, bucket, low, high): extremes of `buckets` equal steps; empty ones 1 and -1."""
    n = samples.groupBy("series_id").agg((F.max("i") + 1).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / buckets))
    full = samples.join(n, "series_id").withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.col("i") / step)).cast("int")).groupBy("series_id", "bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    every = n.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return every.join(full, ["series_id", "bucket"], "left").select("series_id", "bucket", F.coalesce("low", F.lit(1.0)).alias("low"), F.coalesce("high", F.lit(-1.0)).alias("high"))


def repaired_json(rows: DataFrame, column: str = "text") -> DataFrame:
    """Rows with `repaired`: truncated JSON closed by a stack of its open brackets and quotes; null where nothing can be read."""
    import json

    def close(text: str | None) -> str | None:
        if not text:
            return None
        stack, quoted, escaped = [], False, False
        for c in text:
            if quoted:
                quoted, escaped = (True, False) if escaped else (c != '"', c == "\\")
            elif c == '"':
                quoted = True
            elif c in "[{":
                stack.append("]" if c == "[" else "}")
            elif c in "]}" and stack:
                stack.pop()
        body = text + ('"' if quoted else "")
        for tail in ("", "null"):
            candidate = body.rstrip().rstrip(",") + tail + "".join(reversed(stack))
            try:
                json.loads(candidate)
            except ValueError:
                continue
            return candidate
        return None

    udf = F.pandas_udf(lambda s: s.map(close), "string")
    return rows.withColumn("repaired", udf(F.col(column)))
