"""Normalising, classifying, chunking and distilling text."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.stem import stems
from skein.operators import chunk as C
from skein.operators import classify as K
from skein.tables import AS_OF, M, memories, one_per_id, table


def text_normalised(s, d):
    return memories(s, d).select("id", X.normalised(F.col("content")).alias("text"))


def text_preview(s, d):
    return memories(s, d).select("id", X.preview(F.col("content")).alias("preview"))


def text_terse(s, d):
    return memories(s, d).select("id", X.terse(F.col("kind"), F.col("importance"), F.col("content"), F.col("tags"), F.col("project")).alias("line"))


def text_language(s, d):
    return memories(s, d).select("id", K.language(F.col("content")).alias("language"))


def text_stems(s, d):
    """The distinct stems of every text, in order."""
    return memories(s, d).select("id", F.array_sort(F.array_distinct(stems(X.terms(F.col("content")), K.language(F.col("content"))))).alias("stems"))


def index_text(s, d):
    """What is indexed: the text and its stems."""
    m = memories(s, d)
    st = stems(X.terms(F.col("content")), K.language(F.col("content")))
    return m.select("id", F.concat_ws(" ", "content", F.array_join(st, " ")).alias("text"))


def auto_classify(s, d):
    c = K.classified(F.col("content"))
    return memories(s, d).select("id", c["kind"].alias("kind"), c["importance"].alias("importance"), c["ttl_days"].alias("ttl_days"))


def auto_expiry(s, d):
    rows = K.with_expiry(memories(s, d).select("id", "content", "created_at"), "created_at")
    return rows.select("id", "kind", F.date_format("expires", "yyyy-MM-dd HH:mm:ss").alias("expires"))


def filename_words(s, d):
    files = memories(s, d).select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\w.\-]+(?:/[\w.\-]+)+\.[A-Za-z]{1,7}"), F.lit(0)))).alias("path")).distinct()
    return files.select("path", X.name_words(F.col("path")).alias("words"))


def dated_prefix(s, d):
    return memories(s, d).select("id", X.dated(F.to_date("created_at"), F.lit(AS_OF).cast("date")).alias("prefix"))


def chunk_paragraphs(s, d):
    return C.chunks(one_per_id(table(s, d, "memories").select("id", "content")), "id", "content").select("id", "n", "text", "start_line", "end_line")


def chunk_code(s, d):
    return C.chunks(memories(s, d), "id", "content", code=True).select("id", "n", "text", "start_line", "end_line")


def spoken(s, d):
    """Memories that hold turns, whatever their kind says."""
    return memories(s, d).filter(F.col("content").rlike(r"(?m)^\s*(?:USER|ASSISTANT|SYSTEM|User|Assistant|System)\s?:"))


def transcript_segments(s, d):
    return K.segments(spoken(s, d), "id", "content").groupBy(F.col("key").alias("id"), "role").agg(F.count(F.lit(1)).alias("n"))


def transcript_distilled(s, d):
    return K.distilled(spoken(s, d), "id", "content").withColumnRenamed("key", "id")


def ingest_session(s, d):
    """A session's transcript as new rows: the distilled statements and its chunks."""
    t = spoken(s, d)
    facts = K.distilled(t, "id", "content").select(F.concat("key", F.lit("#d"), F.col("place")).alias("id"), "kind", "importance", F.col("sentence").alias("text"))
    raw = C.chunks(t, "id", "content").select(F.concat("id", F.lit("#c"), F.col("n")).alias("id"), F.lit("transcript").alias("kind"), F.lit(2).alias("importance"), "text")
    return facts.unionByName(raw)


QUERIES = {f.__name__: f for f in (text_normalised, text_preview, text_terse, text_language, text_stems, index_text, auto_classify, auto_expiry, filename_words, dated_prefix, chunk_paragraphs, chunk_code, transcript_segments, transcript_distilled, ingest_session)}

PREV = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1} - 1) || '…' ELSE {0} END"
LINE = r"trim(regexp_replace(content, '\s+', ' ', 'g'))"
quote = lambda p: "'" + p.replace("'", "''") + "'"
CASES = lambda col: "CASE " + " ".join(f"WHEN regexp_matches(low, {quote(p)}) THEN {col(k, i, t)}" for k, i, t, p in K.RULES) + f" ELSE {col(*K.DEFAULT)} END"
CLS = f"c AS (SELECT id, created_at, lower(content) AS low FROM m), k AS (SELECT id, created_at, {CASES(lambda k, i, t: quote(k))} AS kind, {CASES(lambda k, i, t: str(i))} AS importance, {CASES(lambda k, i, t: 'NULL' if t is None else str(t))} AS ttl_days FROM c)"
hits = lambda ws: " + ".join(f"CAST(contains(low, ' {w.strip()} ') AS INT)" for w in ws)
ROLE = r"^\s*(USER|ASSISTANT|SYSTEM|User|Assistant|System)\s?:\s*"
BODY = r"trim(regexp_replace(raw, '^\s*(?:USER|ASSISTANT|SYSTEM|User|Assistant|System)\s?:\s*|^\s*[-*]\s+', ''))"
SEG = rf"""sp AS (SELECT id, string_split_regex(content, '\r?\n') AS ls FROM m WHERE regexp_matches(content, '(?m)^\s*(?:USER|ASSISTANT|SYSTEM|User|Assistant|System)\s?:')), ln AS (SELECT id, unnest(ls) AS raw, unnest(range(len(ls))) AS line FROM sp),
  rl AS (SELECT *, nullif(lower(regexp_extract(raw, '{ROLE}', 1)), '') AS own FROM ln), tr AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS role FROM rl),
  sn AS (SELECT id, role, line, string_split(regexp_replace({BODY}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM tr), seg AS (SELECT id, role, line * 1000 + n AS spot, trim(x) AS sentence FROM (SELECT id, role, line, unnest(ss) AS x, unnest(range(len(ss))) AS n FROM sn) WHERE trim(x) <> '')"""
MARK = lambda f: "CASE " + " ".join(f"WHEN regexp_matches(low, {quote(p)}) THEN {f(k, i, b)}" for k, i, b, p in K.MARKERS) + " END"
DIST = rf"""good AS (SELECT *, lower(sentence) AS low, length(regexp_replace(sentence, '[\p{{L}}\p{{N}}\s]', '', 'g')) AS marks FROM seg WHERE length(sentence) BETWEEN 24 AND 260 AND NOT regexp_matches(sentence, 'https?://|```|~~~|^\s*[{{}}<$>]|^\d{{4}}-\d\d-\d\d') AND NOT suffix(sentence, '?')),
  sc AS (SELECT *, {MARK(lambda k, i, b: quote(k))} AS kind, {MARK(lambda k, i, b: str(i))} AS importance, {MARK(lambda k, i, b: str(b))} + CASE WHEN regexp_matches(low, '\d') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(low, 'because|car |since|parce') THEN 2 ELSE 0 END + CASE WHEN role = 'user' THEN 1 ELSE 0 END AS score FROM good WHERE marks * 3 <= length(sentence)),
  one AS (SELECT * FROM sc WHERE kind IS NOT NULL AND score >= {K.LEAST_SCORE} QUALIFY row_number() OVER (PARTITION BY id, trim(regexp_replace(low, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) ORDER BY spot) = 1),
  cp AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY id, kind ORDER BY score DESC, importance DESC, length(sentence) DESC, spot) <= CASE kind {" ".join(f"WHEN '{k}' THEN {n}" for k, n in K.CAPS.items())} ELSE 1 END)"""
PARTED = r"regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '')"
for case in X.CASES:
    PARTED = rf"regexp_replace({PARTED}, '{case}', '\1 \2', 'g')"
SQL = {
    "filename_words": rf"""WITH {M}, p AS (SELECT DISTINCT unnest(regexp_extract_all(content, '[\w.\-]+(?:/[\w.\-]+)+\.[A-Za-z]{{1,7}}')) AS path FROM m), w AS (SELECT path, list_transform(list_filter(string_split_regex({PARTED}, '[^A-Za-z0-9]+'), lambda x: length(x) >= 3), lambda x: lower(x)) AS ws FROM p)
        SELECT path, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS words FROM w""",
    "transcript_segments": f"WITH {M}, {SEG} SELECT id, role, count(*) AS n FROM seg GROUP BY 1, 2",
    "transcript_distilled": f"WITH {M}, {SEG}, {DIST} SELECT id, kind, importance, score, sentence, row_number() OVER (PARTITION BY id ORDER BY score DESC, importance DESC, length(sentence) DESC, spot) AS place FROM cp QUALIFY place <= {K.SELECTED}",
    "text_normalised": rf"WITH {M} SELECT id, trim(regexp_replace(lower(content), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS text FROM m",
    "text_preview": f"WITH {M}, x AS (SELECT id, {LINE} AS line FROM m) SELECT id, {PREV.format('line', 120)} AS preview FROM x",
    "text_terse": f"""WITH {M}, x AS (SELECT *, {LINE} AS line FROM m) SELECT id, concat_ws(' | ', '[' || upper(kind) || ':' || importance || '] ' || {PREV.format('line', 200)}, nullif(array_to_string(tags, ','), ''), project) AS line FROM x""",
    "text_language": f"""WITH {M}, x AS (SELECT id, ' ' || lower(content) || ' ' AS low FROM m), y AS (SELECT id, {hits(K.FRENCH)} + CASE WHEN regexp_matches(low, '[àâçéèêëîïôùûœ]') THEN 2 ELSE 0 END AS fr, {hits(K.ENGLISH)} AS en FROM x)
        SELECT id, CASE WHEN fr > 2 * en THEN 'fr' WHEN en > 2 * fr THEN 'en' ELSE 'both' END AS language FROM y""",
    "auto_classify": f"WITH {M}, {CLS} SELECT id, kind, importance, ttl_days FROM k",
    "auto_expiry": f"WITH {M}, {CLS} SELECT id, kind, strftime(created_at + to_days(ttl_days), '%Y-%m-%d %H:%M:%S') AS expires FROM k",
    "dated_prefix": f"""WITH {M}, x AS (SELECT id, CAST(created_at AS DATE) AS day, date_diff('day', CAST(created_at AS DATE), DATE '{AS_OF[:10]}') AS n FROM m) SELECT id, strftime(day, '%Y-%m-%d') || ', ' || strftime(day, '%A') || ', ' ||
        CASE WHEN n < 0 THEN 'later' WHEN n = 0 THEN 'today' WHEN n < 14 THEN n || ' days ago' WHEN n < 60 THEN (n // 7) || ' weeks ago' ELSE (n // 30) || ' months ago' END AS prefix FROM x""",
}
