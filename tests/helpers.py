from pyspark.sql import functions as F


def files_of(spark, *rows):
    """Rows (path, content) as a frame of files."""
    data = [(p, c) for p, c in rows]
    f = spark.createDataFrame(data, "file_path string, content string")
    from tessera.functions.language import language_of
    from tessera.functions.text import extension

    ext = extension(F.col("file_path"))
    return f.select("file_path", F.lit("/r").alias("root_path"), F.lit("p").alias("project"), ext.alias("extension"), language_of(ext).alias("language"), F.sha2("content", 256).alias("file_hash"), "content")


def value(spark, column, **given):
    """A column's value on one row of strings."""
    names = list(given) or ["x"]
    row = spark.createDataFrame([tuple(given.get(n) for n in names)], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("v")).head()["v"]
