"""Sources and sinks in the formats that records arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "structured_tables": "table_id string, document_id string, user_id string, node_id string, page_start int, page_end int, title string, extraction_method string, columns array<struct<key:string,label:string,type:string,unit:string>>, rows array<map<string,string>>, source_fragments array<struct<page:int,bounding_box:array<double>>>, keywords array<string>, created_at timestamp, updated_at timestamp, deleted_at timestamp",
    "sparse_records": "point_id string, collection string, text string, payload struct<user_id:string,doc_id:string,page_number:int,node_id:string,source:string>, indexed_at timestamp",
}


def read_records(spark: SparkSession, path: str, table: str, form: str = "json") -> DataFrame:
    """Records of a known table from JSON lines, CSV, ORC, Avro or parquet, with its schema; malformed JSON and CSV lines are kept in ``_corrupt``."""
    schema = T.StructType.fromDDL(SCHEMAS[table])
    if form in ("json", "csv"):
        schema = T.StructType([*schema, T.StructField("_corrupt", T.StringType())])
        return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("header", "true").format(form).load(path)
    return spark.read.schema(schema).format(form).load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``path``, ``sha256`` of the bytes, which names the document, and ``text``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("document_id"), F.decode("content", "UTF-8").alias("text"))


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
