"""The driver's tables in the roles that the engine's operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import language_of
from ..session import read_table

#: Extensions that stand for the languages of the synthetic documents.
EXTENSIONS = {"en": "md", "fr": "txt", "de": "rst", "es": "adoc"}
OTHER = "log"


def _extension(lang: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))[lang], F.lit(OTHER))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file_path, root_path, project, extension, language, file_hash, content, and doc_id."""
    d = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    ext = _extension(F.col("lang"))
    return d.select("doc_id", F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), ext)).alias("file_path"), F.col("source").alias("root_path"), F.col("source").alias("project"), ext.alias("extension"), language_of(ext).alias("language"), F.sha2(text, 256).alias("file_hash"), text.alias("content"))


FILES = """files AS (SELECT doc_id, source || '/' || doc_id || '.' || ext AS file_path, source AS root_path, source AS project, ext AS extension,
  CASE ext WHEN 'md' THEN 'Markdown' WHEN 'txt' THEN 'Text' WHEN 'rst' THEN 'reStructuredText' WHEN 'adoc' THEN 'AsciiDoc' ELSE 'Log' END AS language, sha256(content) AS file_hash, content
  FROM (SELECT doc_id, source, coalesce(text, '') AS content, CASE lang WHEN 'en' THEN 'md' WHEN 'fr' THEN 'txt' WHEN 'de' THEN 'rst' WHEN 'es' THEN 'adoc' ELSE 'log' END AS ext FROM documents))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as stored chunks: chunk_id, vector, project."""
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("project"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return read_table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).head()["embedding"]


def chunks_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with the vector of the same number, or null where there is none: one chunk a file, chunk_id = doc_id."""
    return files(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id").join(vectors(spark, sf_dir).select("chunk_id", "vector"), "chunk_id", "left")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as commits: one a conversation, the first turn its message, every turn a changed file."""
    c = read_table(spark, sf_dir, "conversations")
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    email = F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("@example.com")))
    return g.select(
        F.sha2(F.col("conv_id").cast("string"), 256).alias("hash"),
        F.get("t", F.lit(0))["text"].alias("message"),
        F.concat(F.lit("author "), (F.col("conv_id") % 7).cast("string")).alias("author_name"),
        email.alias("author_email"),
        (F.lit(1_700_000_000) + F.col("conv_id") * 86_400).alias("commit_date"),
        F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.transform("t", lambda x: F.concat(F.lit("src/"), x["role"], F.lit("/"), x["turn"].cast("string"), F.lit(".py")))).alias("files_changed"),
        F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.element_at("t", -1)["text"]).alias("diff_content"),
        "conv_id",
    )


COMMITS = """turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
commits AS (SELECT sha256(CAST(conv_id AS VARCHAR)) AS hash, first(text ORDER BY turn, role, text) AS message, 'author ' || (conv_id % 7) AS author_name,
  CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'u' || conv_id || '@example.com' END AS author_email, 1700000000 + conv_id * 86400 AS commit_date,
  CASE WHEN conv_id % 5 = 0 THEN [] ELSE list('src/' || role || '/' || turn || '.py' ORDER BY turn, role, text) END AS files_changed,
  CASE WHEN conv_id % 4 = 0 THEN '' ELSE last(text ORDER BY turn, role, text) END AS diff_content, conv_id FROM turns GROUP BY conv_id)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as definitions: an order is a file, a line a definition from 8 * l_linenumber over l_quantity lines."""
    li = read_table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 8).cast("int")
    one = li.groupBy(F.col("l_orderkey").cast("string").alias("file_path"), start.alias("start_line")).agg(F.max(start + F.col("l_quantity").cast("int")).alias("end_line"), F.min("l_suppkey").alias("name"))
    return one.select("file_path", "start_line", "end_line", F.concat(F.lit("f"), F.col("name").cast("string")).alias("name"), F.lit("function").alias("kind"), F.lit(0).alias("start_col"), F.col("start_line").alias("pre"), F.concat_ws(":", F.lit("def"), "file_path", "start_line").alias("def_id"))


SPANS = """defs AS (SELECT *, start_line AS pre, 'def:' || file_path || ':' || start_line AS def_id FROM (SELECT CAST(l_orderkey AS VARCHAR) AS file_path, CAST(l_linenumber * 8 AS INTEGER) AS start_line,
  CAST(max(l_linenumber * 8 + CAST(l_quantity AS INTEGER)) AS INTEGER) AS end_line, 'f' || min(l_suppkey) AS name FROM lineitem GROUP BY 1, 2))"""
