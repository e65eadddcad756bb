"""Documents as notes: paths, names, sizes and times, and readers for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

NOTES = StructType([StructField("path", StringType(), False), *(StructField(n, t) for n, t in (("basename", StringType()), ("extension", StringType()), ("size", LongType()), ("mtime", LongType()), ("contentHash", StringType()), ("indexedAt", StringType())))])
CHUNKS = StructType([StructField(n, t) for n, t in (("chunkId", StringType()), ("path", StringType()), ("chunkIndex", IntegerType()), ("text", StringType()), ("textHash", StringType()), ("createdAt", StringType()))])
EMBEDDINGS = StructType(
    [StructField(n, t) for n, t in (("chunkId", StringType()), ("path", StringType()), ("index", IntegerType()), ("textHash", StringType()), ("model", StringType()), ("provider", StringType()), ("dimensions", IntegerType()), ("embedding", ArrayType(DoubleType())), ("createdAt", StringType()), ("embeddingInputHash", StringType()))]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly if it comes in fewer parts than there are cores, as a small file of one row group does; others are left as they are."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: doc_id, path, basename, extension, size, mtime, text."""
    name = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(name, F.lit(".md"))).alias("path"),
        name.alias("basename"),
        F.lit("md").alias("extension"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(1704067200000) + F.col("doc_id") * 1000).alias("mtime"),
        "text",
    )


def part_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as notes with wordy names: p_partkey, basename, path."""
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("basename"), F.concat(F.concat_ws("/", "p_brand", "p_type", name), F.lit(".md")).alias("path"))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files below root, with content; the path filter runs before any content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(name, r"\.md$", "").alias("basename"), F.lit("md").alias("extension"), F.col("length").alias("size"), (F.col("modificationTime").cast("double") * 1000).cast("long").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def read_chunks(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Chunks from JSON lines; lenient reads skip bad lines, strict ones fail on them. records.chunks_status tells of the format's limits."""
    rows = spark.read.schema(CHUNKS).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows.where("chunkId is not null and path is not null and text is not null")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes from a JSON array."""
    return spark.read.schema(NOTES).option("multiLine", "true").json(path)


def read_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, invalid lines): a line that doesn't parse or has no chunkId is invalid, not skipped."""
    raw = spark.read.schema(StructType([*EMBEDDINGS.fields, StructField("_bad", StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = F.col("_bad").isNull() & (F.coalesce(F.col("chunkId"), F.lit("")) != "")
    return raw.where(good).drop("_bad"), raw.where(~good)
