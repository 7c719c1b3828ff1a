"""The shared folder that cuts lineages, and readers of the file formats that the analytics take."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir if it is set; else (in tests) a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = f"{folder(df.sparkSession)}/sightline-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of whole pages at most: a task holds one in Python.
PAGES = 1_000


def bound_pages(spark: SparkSession) -> None:
    """Lowers the session's bound of rows in an Arrow batch to PAGES; it leaves a smaller one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > PAGES:
        spark.conf.set(key, str(PAGES))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores: a table of few bytes is read by a task or two, however much work its rows make."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Text files of URLs, one a line -> (url); blank lines and those that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files -> (url, html), url being the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def decoded(pages: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """pages with text: body decoded by its byte-order mark, else its header's or meta tag's charset, else UTF-8.

    Charsets that are not known are read as UTF-8, and bytes that are not valid are replaced.
    """
    raw = F.col(body)
    start = F.decode(F.substring(raw, 1, 4096), "ISO-8859-1")
    named = F.lower(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.col(content_type), F.lit("")), r"(?i)charset=[\"']?([\w\-]+)", 1), F.lit("")), F.regexp_extract(start, r"(?i)<meta[^>]*charset=[\"']?([\w\-]+)", 1)))
    mark = F.hex(F.substring(raw, 1, 3))
    utf16 = F.decode(raw, "UTF-16")
    text = F.when(mark.startswith("EFBBBF"), F.make_valid_utf8(F.substring(raw, F.lit(4), F.length(raw)).cast("string"))).when(mark.startswith("FFFE") | mark.startswith("FEFF"), utf16)
    text = text.when(named.isin("iso-8859-1", "latin1", "windows-1252"), F.decode(raw, "ISO-8859-1")).when(named == "us-ascii", F.decode(raw, "ISO-8859-1")).otherwise(F.make_valid_utf8(raw.cast("string")))
    return pages.withColumn("text", text)


def web_graph_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated host ranks, compressed or not; lines that begin with # are left out."""
    schema = "harmonic_rank long, harmonic_value double, pagerank_rank long, pagerank_value double, host_reversed string"
    return spark.read.csv(path, sep="\t", schema=schema, comment="#")


def vendor_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Vendor envelopes tasks[].result[].items[] -> one row for each item, with its endpoint's cost.

    item: the item's schema. A result without items counts as an item itself.
    """
    fields = item.removeprefix("struct<").removesuffix(">")
    schema = f"status_code int, tasks array<struct<cost: double, result: array<struct<items: array<struct<{fields}>>, {fields}>>>>"
    tasks = spark.read.json(path, multiLine=True, schema=schema).select("status_code", F.posexplode_outer("tasks").alias("task", "t"))
    results = tasks.select("status_code", "task", "t.cost", F.explode_outer("t.result").alias("r"))
    own = F.struct(*[F.col(f"r.{f.split(':')[0].strip()}") for f in _split(fields)])
    return results.select("status_code", "task", "cost", F.explode_outer(F.coalesce("r.items", F.array(own))).alias("item")).select("status_code", "task", "cost", "item.*")


def _split(fields: str) -> list[str]:
    depth, out, last = 0, [], 0
    for i, c in enumerate(fields):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(fields[last:i])
            last = i + 1
    return [*out, fields[last:]]


def sidecars(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "heic", "avif")) -> DataFrame:
    """Image files of a folder and whether a metadata sidecar stands beside each: (path, has_sidecar)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    images = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*kinds))
    cars = files.where(F.lower(F.col("path")).endswith(".xmp")).select(F.regexp_replace("path", r"(?i)\.xmp$", "").alias("path"), F.lit(True).alias("s"))
    return images.join(cars, "path", "left").select("path", F.coalesce("s", F.lit(False)).alias("has_sidecar"))


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; null fields are left out, as Spark does by itself."""
    df.write.mode(mode).json(path)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Rows appended to a Parquet table, in folders by one column where given."""
    out = df.write.mode("append")
    (out.partitionBy(by) if by else out).parquet(path)
