"""Sources: folders of texts, exports of an earlier version, long-memory question sets, batches of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.tables import kind_of, slug

#: Files taken by default, largest file, and the bounds of both settings.
FILES, BYTES = 20, 2_000_000
SUFFIXES = ("txt", "md", "json", "jsonl", "log")


def text_folder(spark: SparkSession, path: str, *, max_files: int = FILES, max_bytes: int = BYTES) -> DataFrame:
    """(path, size, text) of the first files by path; a file over the size is an error, other suffixes are not read."""
    if not 1 <= max_files <= 200 or not 1_000 <= max_bytes <= 20_000_000:
        raise ValueError("max_files has to be 1 to 200, max_bytes 1 kB to 20 MB")
    glob = "*.{" + ",".join(SUFFIXES) + "}"
    meta = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    first = meta.orderBy("path").limit(max_files)
    checked = first.select("path", F.when(F.col("size") <= max_bytes, F.col("size")).otherwise(F.raise_error(F.concat(F.lit("file over the limit: "), F.col("path"))).cast("long")).alias("size"))
    texts = spark.read.option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return checked.withColumn("path", plain(F.col("path"))).join(texts.withColumn("path", plain(F.col("path"))), "path")


def legacy_export(spark: SparkSession, path: str, known: DataFrame, *, lines: bool = False) -> DataFrame:
    """Rows of an earlier version's JSON (global.json, projects/*.json) that the store does not hold yet.

    Kinds are renamed, the project comes of the file's name; rows whose content the store has are left out, and
    so are repeats. Imported rows have no hash and no links.
    """
    raw = spark.read.option("multiLine", str(not lines).lower()).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").schema("memories array<struct<id string, content string, kind string, tags array<string>, importance int, created_at string>>").json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    rows = raw.select(F.explode("memories").alias("m"), F.when(name == "global", F.lit(None)).otherwise(slug(name)).alias("project")).select("m.*", "project").filter("content is not null and trim(content) <> ''")
    once = rows.withColumn("r", F.row_number().over(Window.partitionBy(F.md5("content"), "project").orderBy("created_at", "id"))).filter("r = 1").drop("r")
    return once.withColumn("kind", kind_of(F.col("kind"))).join(known.select(F.col("content")).distinct(), "content", "left_anti")


QUESTIONS = "question_id string, question string, question_type string, question_date string, answer string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"


def question_set(spark: SparkSession, path: str, *, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(questions, turns) of a long-memory question set; abstentions (ids ending with _abs) are left out.

    lines: one question a line instead of an array a file. A turn's id is <session>__t<n>, its text has the date in front.
    """
    raw = spark.read.option("multiLine", str(not lines).lower()).schema(QUESTIONS).json(path).filter(~F.col("question_id").endswith("_abs"))
    questions = raw.select("question_id", "question", "question_type", "question_date", F.col("answer_session_ids").alias("gold"))
    each = raw.select("question_id", F.explode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("s"))
    turns = each.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("date"), F.posexplode("s.haystack_sessions").alias("n", "turn"))
    text = F.concat(F.lit("["), F.col("date"), F.lit("] "), F.upper("turn.role"), F.lit(": "), F.col("turn.content"))
    return questions, turns.select("question_id", F.concat("session_id", F.lit("__t"), F.col("n")).alias("id"), "session_id", "n", text.alias("content"))


def requests(spark: SparkSession, path: str) -> DataFrame:
    """(query, text, project, kind, limit) of a JSON-lines batch; lines that do not parse and empty queries are left out."""
    raw = spark.read.option("mode", "DROPMALFORMED").schema("id string, query string, project string, kind string, limit int").json(path)
    return raw.filter("query is not null and trim(query) <> ''").select(F.coalesce("id", F.md5("query")).alias("query"), F.col("query").alias("text"), slug(F.col("project")).alias("project"), "kind", F.least(F.greatest(F.coalesce("limit", F.lit(10)), F.lit(1)), F.lit(100)).alias("limit"))
