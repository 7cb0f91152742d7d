"""Sinks: JSON, Markdown, sessions, telemetry, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines and characters of a cleaned text in a session export.
LINES, CHARACTERS = 80, 12_000
#: Lines of tools, not of people.
NOISE = r"^\s*(?:\{.*\}|<[^>]*>|\$ .*|data:.*;base64,.*|-----(?:BEGIN|END) .*|[A-Za-z0-9+/=]{60,})\s*$"


def json_rows(df: DataFrame) -> DataFrame:
    """(json) of every row; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_trace(df: DataFrame, path: str) -> None:
    """Rows of telemetry as JSON lines, added to a log."""
    df.coalesce(1).write.mode("append").json(path)


def bullet(text: Column, importance: Column, tags: Column) -> Column:
    """- text ★★★ `tag` `tag`"""
    marks = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("`"), t, F.lit("`"))), " ")
    return F.concat_ws(" ", F.concat(F.lit("- "), F.regexp_replace(text, "\\s*\\n\\s*", " ")), F.repeat(F.lit("★"), importance), F.nullif(marks, F.lit("")))


def markdown_lines(df: DataFrame) -> DataFrame:
    """(kind, line_no, line): a heading a kind with its count, then a bullet a row by importance, age and id, numbered within days.

    It stays a table: written sorted by kind and line it is the document, however large, and no row is gathered.
    """
    from pyspark.sql import Window

    from skein.operators.lifecycle import in_order

    counts = df.groupBy("kind", "importance").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy(F.desc("importance")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("kind").alias("k"), F.col("importance").alias("i"), before.alias("before"))
    placed = in_order(df, ["kind", "importance"], "created_at", "id").join(offsets, F.col("kind").eqNullSafe(F.col("k")) & (F.col("importance") == F.col("i")))
    rows = placed.select("kind", (F.col("before") + F.col("place") + 1).cast("int").alias("line_no"), bullet(F.col("content"), F.col("importance"), F.col("tags")).alias("line"))
    heads = df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", F.lit(0).alias("line_no"), F.concat(F.lit("## "), F.col("kind"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    return heads.unionByName(rows)


def cleaned(text: Column) -> Column:
    """A text for people: no tool noise, at most LINES lines and CHARACTERS characters, as the export format defines."""
    kept = F.filter(F.split(text, "\r?\n"), lambda line: ~line.rlike(NOISE))
    return F.substring(F.array_join(F.slice(kept, 1, LINES), "\n"), 1, CHARACTERS)


def session_documents(df: DataFrame) -> DataFrame:
    """(session_id, n, document) of every session: front matter, then its rows by time. A session is a bounded unit of one conversation."""
    from skein.operators.lifecycle import session_capsules

    rows = df.filter("session_id is not null and kind <> 'credential'")
    part = F.struct("created_at", "id", F.concat(F.lit("### "), F.col("kind"), F.lit("\n"), cleaned(F.col("content"))).alias("t"))
    lists = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(part)).alias("x"), F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("first_day"))
    joined = lists.join(session_capsules(df).select("session_id", "capsule"), "session_id", "left")
    front = F.concat(F.lit("---\nsession: "), F.col("session_id"), F.lit("\nrows: "), F.col("n").cast("string"), F.lit("\nsince: "), F.col("first_day"), F.lit("\n---"))
    return joined.select("session_id", "n", F.concat_ws("\n\n", front, "capsule", F.array_join(F.transform("x", lambda v: v["t"]), "\n\n")).alias("document"))


def write_vectors(vectors: DataFrame, path: str, dim: int) -> None:
    """Usable vectors as Parquet, with their length in the path: a change of model is another folder, never a mixture."""
    from skein.operators.vectors import usable

    vectors.filter(usable(F.col("v"), dim)).write.mode("overwrite").parquet(f"{path}/dim={dim}")


def read_vectors(spark, path: str, dim: int) -> DataFrame:
    """The vectors of that length; an empty table if there are none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/dim={dim}").select("id", "v")
    except AnalysisException:
        return spark.createDataFrame([], "id string, v array<float>")
