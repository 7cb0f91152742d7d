"""Text functions as column expressions, so that they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain forms, in order; enough for the Latin languages of the store.
MARKED = "àáâãäåāăąçćčďèéêëēėęěğìíîïīįłñńňòóôõöøōőŕřśšşťùúûüūůűųýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeegiiiiiilnnnoooooooorrssstuuuuuuuuyyzzz"


def folded(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def terms(text: Column) -> Column:
    """Tokens of the index, in order: runs of letters and digits of the folded text; null gives none."""
    return F.filter(F.split(F.coalesce(folded(text), F.lit("")), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def normalised(text: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(normalised(text), F.lit("")), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; two empty ones are alike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def preview(text: Column, n: int = 120) -> Column:
    """One line of at most n characters, an ellipsis where it goes on."""
    line = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n - 1), F.lit("…"))).otherwise(line)


def terse(kind: Column, importance: Column, text: Column, tags: Column, project: Column) -> Column:
    """[KIND:n] text | tags | project, the parts that are empty left out."""
    head = F.concat(F.lit("["), F.upper(kind), F.lit(":"), importance.cast("string"), F.lit("] "), preview(text, 200))
    return F.concat_ws(" | ", head, F.nullif(F.array_join(tags, ","), F.lit("")), project)


def kebab(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^\\p{L}\\p{N}]+", "-"), "^-|-$", "")


#: Where a name changes from small to capital, from capitals to a word, and between letters and digits.
CASES = ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])")


def name_words(path: Column) -> Column:
    """Words of a file's name: parted at marks and where case or digits change, at least three characters, lower case."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")
    parted = stem
    for pattern in CASES:
        parted = F.regexp_replace(parted, pattern, "$1 $2")
    return F.array_distinct(F.transform(F.filter(F.split(parted, "[^A-Za-z0-9]+"), lambda p: F.length(p) >= 3), lambda p: F.lower(p)))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | text.contains(w), words, F.lit(False))


def count_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a + text.contains(w).cast("int"), words, F.lit(0))


def ascii_share(text: Column) -> Column:
    return 1 - F.length(F.regexp_replace(text, "[\\x00-\\x7f]", "")) / F.greatest(F.length(text), F.lit(1))


def first_sentence(text: Column, least: int = 24, most: int = 200) -> Column:
    """Up to the first full stop, mark or line end that leaves at least `least` characters."""
    found = F.regexp_extract(F.trim(text), f"(?s)^(.{{{least},}}?[.!?])(?:\\s|$)", 1)
    line = F.element_at(F.split(F.trim(text), "\n"), 1)
    return F.substring(F.when((found != "") & (F.length(found) <= most), F.regexp_replace(found, "\\s+", " ")).otherwise(line), 1, most)


def dated(day: Column, as_of: Column) -> Column:
    """date, weekday and how long ago: in days up to two weeks, in weeks up to two months, then in months."""
    n = F.datediff(as_of, day)
    ago = F.when(n < 0, "later").when(n == 0, "today").when(n < 14, F.concat(n.cast("string"), F.lit(" days ago"))).when(n < 60, F.concat(F.floor(n / 7).cast("string"), F.lit(" weeks ago"))).otherwise(F.concat(F.floor(n / 30).cast("string"), F.lit(" months ago")))
    return F.concat_ws(", ", F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "EEEE"), ago)
