"""Helpers shared by the training-data operators: shared-folder tables, column hygiene, batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only for a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="touchline-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/touchline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of tables made by stored() that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for frame in frames:
        for name in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            if "/touchline/" in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """deleted(), and ask the driver's JVM to collect garbage: only then does Spark delete the shuffle files of a loop's earlier rounds."""
    deleted(spark, *frames)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has in any case: those given, with as many underscores more as are needed."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(df: DataFrame, *names: str) -> DataFrame:
    """df whose columns of these names, in any case, have exactly these names."""
    for c in df.columns:
        if c.lower() in names and c not in names and c.lower() not in df.columns:
            df = df.withColumnRenamed(c, c.lower())
    return df


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", text.lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0) if int(number) >= 0 else 1 << 62


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after lowering its session's bound on the bytes of an Arrow batch to BATCH_BYTES where it is higher."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(conf.get(key)) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def small_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column holds at most max_bytes, or a single longer row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def word_count(text: str) -> F.Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string expression's UTF-8; the table is that of the reflected polynomial 0xEDB88320."""
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    digits = f"hex(encode({text}))"
    codes = f"list_transform(range(0, length({digits}), 2), lambda i: CAST(concat('0x', substr({digits}, i + 1, 2)) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, ({table}::BIGINT[])[xor(a, b) % 256 + 1])))"
