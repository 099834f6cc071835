"""Readers and writers with the reference options, and listings about files. Paths are anything that Spark can open."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path, header: bool | None = None, delim: str | None = None, quote: str = '"', escape: str = '"', nullstr: str = "", columns: dict[str, str] | None = None, skip: int = 0, filename: bool = False, union_by_name: bool = False, ignore_errors: bool = False, rejects: bool = False) -> DataFrame:
    """CSV; what is not told is sniffed from the head of the first file. With rejects, faulty lines stand in __rejected.

    With skip, that many lines at each file's head go before it is read; quoted values hold no line breaks then.
    """
    found = sniff_csv(spark, path, skip=skip) if header is None or delim is None or skip else {}
    reader = spark.read.option("header", found.get("header", True) if header is None else header).option("sep", delim or found.get("delimiter", ",")).option("quote", quote).option("escape", escape).option("nullValue", nullstr).option("mode", "DROPMALFORMED" if ignore_errors else "PERMISSIVE" if rejects else "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").option("preferDate", True)
    if skip and filename:
        raise NotImplementedError("skip and filename together")
    if columns:
        fields = ", ".join(f"`{k}` {v}" for k, v in columns.items())
        reader = reader.schema(fields + (", __rejected string" if rejects else ""))
        if rejects:
            reader = reader.option("columnNameOfCorruptRecord", "__rejected")
    else:
        reader = reader.option("inferSchema", True)
    if skip:
        titled = found["header"] if header is None else header
        lines = without_head(spark, path, skip + int(titled))._jdf
        df = DataFrame(reader.option("header", False)._jreader.csv(getattr(lines, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())), spark)
        return df if columns else df.toDF(*(next(csv.reader([found["first"]], delimiter=delim or found["delimiter"], quotechar=quote)) if titled else [f"column{i}" for i in range(len(df.columns))]))
    df = reader.csv(path)
    return df.withColumn("filename", F.col("_metadata.file_path")) if filename else df


def without_head(spark: SparkSession, path, skip: int) -> DataFrame:
    """Lines of files but the first ones of each. Row ids rise along a file's first block, and only that block is searched."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    starts = lines.where("block = 0").groupBy("file").agg(F.min("id").alias("start"))
    return lines.join(starts, "file").where(f"block > 0 or id >= start + {int(skip)}").select("value")


def sniff_csv(spark: SparkSession, path, lines: int = 50, skip: int = 0) -> dict:
    """Delimiter, quote and header of a CSV file, from its first lines."""
    head = [r[0] for r in spark.read.text(path if isinstance(path, str) else path[0]).limit(lines + skip).collect()][skip:]
    sample = "\n".join(head)
    try:
        dialect = csv.Sniffer().sniff(sample, delimiters=",;\t|")
        delimiter, quote = dialect.delimiter, dialect.quotechar
    except csv.Error:
        delimiter, quote = ",", '"'
    rows = list(csv.reader(head, delimiter=delimiter, quotechar=quote or '"'))

    def numeric(x: str) -> bool:
        try:
            float(x)
            return True
        except ValueError:
            return False

    header = bool(rows) and not any(numeric(x) for x in rows[0]) and (len(rows) == 1 or len(set(rows[0])) == len(rows[0]) and any(numeric(x) for x in rows[1]) or all(x.replace("_", "").isalnum() for x in rows[0]))
    return {"delimiter": delimiter, "quote": quote, "header": header, "first": head[0] if head else "", "columns": rows[0] if header and rows else [f"column{i}" for i in range(len(rows[0]) if rows else 0)]}


def read_parquet(spark: SparkSession, path, filename: bool = False, union_by_name: bool = False) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("mergeSchema", union_by_name).parquet(*paths)
    return df.withColumn("filename", F.col("_metadata.file_path")) if filename else df


def read_json(spark: SparkSession, path, format: str = "auto", columns: dict[str, str] | None = None) -> DataFrame:
    """Lines of objects or, with format array, arrays of them."""
    reader = spark.read.option("multiLine", format == "array")
    if columns:
        reader = reader.schema(", ".join(f"`{k}` {v}" for k, v in columns.items()))
    return reader.json(path)


def read_json_objects(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "json")


def read_text(spark: SparkSession, path) -> DataFrame:
    """One row for each file: its name, size and whole content."""
    blob = read_blob(spark, path)
    return blob.withColumn("content", F.decode("content", "UTF-8"))


def read_blob(spark: SparkSession, path) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("filename"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def glob(spark: SparkSession, pattern: str) -> DataFrame:
    """Files that fit a pattern, listed by the file system that the path belongs to."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return spark.createDataFrame([(s.getPath().toString(),) for s in (found or [])], "file string")


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row group and column of a file on this machine."""
    import pyarrow.parquet as pq

    meta, rows = pq.ParquetFile(path).metadata, []
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            x = meta.row_group(g).column(c)
            s = x.statistics
            rows.append((path, g, meta.row_group(g).num_rows, x.path_in_schema, str(x.physical_type), str(x.compression), int(x.total_compressed_size), int(x.total_uncompressed_size), int(x.num_values), None if s is None or s.null_count is None else int(s.null_count), None if s is None or not s.has_min_max else str(s.min), None if s is None or not s.has_min_max else str(s.max)))
    return spark.createDataFrame(rows, "file_name string, row_group_id int, row_group_num_rows bigint, path_in_schema string, type string, compression string, total_compressed_size bigint, total_uncompressed_size bigint, num_values bigint, stats_null_count bigint, stats_min string, stats_max string")


def parquet_schema(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow.parquet as pq

    schema = pq.ParquetFile(path).schema
    return spark.createDataFrame([(path, c.name, c.physical_type, str(c.logical_type)) for c in (schema.column(i) for i in range(len(schema.names)))], "file_name string, name string, type string, logical_type string")


def parquet_kv_metadata(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow.parquet as pq

    pairs = (pq.ParquetFile(path).metadata.metadata or {}).items()
    return spark.createDataFrame([(path, bytearray(k), bytearray(v)) for k, v in pairs], "file_name string, key binary, value binary")


def copy_to(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, compression: str | None = None, header: bool = True, delimiter: str = ",", overwrite: bool = False, return_files: bool = False):
    """COPY ... TO a folder."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer = writer.option("header", header).option("sep", delimiter)
    writer.format(format).save(path)
    if return_files:
        return glob(df.sparkSession, os.path.join(path, *["*"] * (len(partition_by or []) + 1)))
    return None
