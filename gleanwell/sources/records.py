"""Reading and checking records, hashing files, writing results that can be taken up again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = "struct<title:string,author:string,url:string,source:string,category:string,published_at:string,fact:string>"
# The columns a record must have, and the types a question can be of.
QA_DDL = f"query string, answer string, question_type string, evidence_list array<{EVIDENCE}>"
CORPUS_DDL = "title string, author string, source string, published_at string, category string, url string, body string"
QUESTION_TYPES = ("inference_query", "comparison_query", "temporal_query", "null_query")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """QA records of JSON arrays, with the fixed schema; a file that is no such JSON raises."""
    return spark.read.schema(QA_DDL).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus records of JSON arrays, with the fixed schema; a file that is no such JSON raises."""
    return spark.read.schema(CORPUS_DDL).option("multiLine", True).option("mode", "FAILFAST").json(path)


def missing_columns(df: DataFrame, ddl: str) -> list[str]:
    """Columns of the schema that df lacks."""
    have = {c.lower() for c in df.columns}
    return [f.name for f in T.StructType.fromDDL(ddl).fields if f.name.lower() not in have]


def invalid_questions(df: DataFrame) -> DataFrame:
    """Records without a query, of an unknown type, or with an evidence item that lacks url or fact; reason says which."""
    reason = F.when(F.coalesce(F.col("query"), F.lit("")) == "", "query")
    reason = reason.when(F.coalesce(~F.col("question_type").isin(*QUESTION_TYPES), F.lit(True)), "question_type")
    reason = reason.when(F.exists("evidence_list", lambda e: e["url"].isNull() | e["fact"].isNull()), "evidence")
    return df.withColumn("reason", reason).filter("reason IS NOT NULL")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def append_remaining(todo: DataFrame, path: str, key: str) -> int:
    """Append the rows of todo that the parquet table at path lacks by key; the number of them. A second call appends none."""
    spark = todo.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
        todo = todo.join(done, key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    written = Observation()
    todo.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return written.get["n"]
