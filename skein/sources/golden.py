"""A small store and questions with known answers, written for this library: what a search has to find, and what it must not show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (id, project, kind, importance, content)
CORPUS = [
    ("g01", "harbour", "decision", 5, "We decided to keep the ferry timetable in Postgres, because the planner joins it with the berths."),
    ("g02", "harbour", "bug", 4, "Root cause of the double booking: the berth lock was released before the tide table was written."),
    ("g03", "harbour", "architecture", 5, "Architecture: the tide service writes to a queue, the planner reads from it and never calls the service."),
    ("g04", "harbour", "preference", 3, "The harbour master prefers metres over feet in every report."),
    ("g05", "harbour", "todo", 2, "Todo: replace the fog horn adapter before winter."),
    ("g06", "harbour", "milestone", 4, "Shipped the mobile berth map on 2025-03-14."),
    ("g07", "orchard", "decision", 4, "We chose drip irrigation zones of forty trees, since the pump cannot serve more."),
    ("g08", "orchard", "bug", 4, "Soil sensors fail after a frost: the firmware forgets its calibration."),
    ("g09", "orchard", "pattern", 3, "Pattern: always run the pruning forecast after the weather import."),
    ("g10", "orchard", "preference", 3, "On préfère les noms de parcelles en français dans les exports."),
    ("g11", "orchard", "snippet", 3, "```py\ndef ripeness(brix, firmness):\n    return brix / max(firmness, 0.1)\n```"),
    ("g12", "orchard", "architecture", 5, "Architecture: sensor readings land in hourly files; the ripeness model reads the last thirty days."),
    ("g13", None, "preference", 5, "Answers should be short and give the command first."),
    ("g14", None, "fact", 3, "The support line is staffed from eight to six, except on Sundays."),
    ("g15", "harbour", "credential", 5, "The tide service password is kept in the vault under harbour/tide."),
    ("g16", "orchard", "transcript", 2, "USER: when did the harvest planner change?\nASSISTANT: the harvest planner moved to the new calendar last week."),
    ("g17", "orchard", "note", 2, "Les capteurs du verger nord ont été remplacés après le gel."),
    ("g18", "harbour", "note", 2, "Visitors ask about parking more than about ferries."),
    ("g19", "archive", "note", 1, "Scanned ledgers from 1921 mention a lighthouse keeper and his lamp oil."),
    ("g20", "archive", "decision", 4, "Ledgers are transcribed by hand, because the ink has faded too far for recognition."),
]
#: (name, query, project, words of which the answer holds one, mode)
QUESTIONS = [
    ("where-data-lives", "where is the ferry timetable kept", "harbour", ["ferry timetable in Postgres"], "default"),
    ("root-cause", "root cause of double booking", "harbour", ["berth lock was released"], "default"),
    ("flow", "how does the planner get tides", "harbour", ["tide service writes to a queue"], "default"),
    ("liking", "which units are preferred in reports", "harbour", ["prefers metres"], "default"),
    ("when-shipped", "when was the berth map shipped", "harbour", ["2025-03-14"], "default"),
    ("inflected", "sensor failing with frosts", "orchard", ["Soil sensors fail"], "default"),
    ("french", "remplacement des capteurs", "orchard", ["capteurs du verger"], "default"),
    ("code", "ripeness brix firmness", "orchard", ["def ripeness"], "default"),
    ("turn", "what did the user ask about the harvest planner", "orchard", ["harvest planner change"], "default"),
    ("everywhere", "support line on sundays", None, ["support line is staffed"], "default"),
    ("hidden", "tide service password", "harbour", ["tide service writes to a queue"], "default"),
    ("shown", "tide service password", "harbour", ["kept in the vault"], "full"),
]


def corpus(spark: SparkSession) -> DataFrame:
    """The store's columns, with one day between the rows."""
    rows = [(i, c, k, p, [], "golden", n, d) for d, (i, p, k, n, c) in enumerate(CORPUS)]
    base = spark.createDataFrame(rows, "id string, content string, kind string, project string, tags array<string>, source string, importance int, d int")
    day = "timestamp'2025-09-01 00:00:00' + make_dt_interval(d)"
    return base.selectExpr(
        "id", "content", "kind", "project", "tags", "source", "importance", "cast(null as timestamp) as expires_at", f"{day} as created_at", f"{day} as updated_at", "cast(null as timestamp) as last_accessed_at", "0 as access_count",
        "cast(null as string) as session_id", "cast(null as string) as thread_id", "cast(null as string) as window_id",
    )


def questions(spark: SparkSession) -> DataFrame:
    """(query, text, project, answers, mode)"""
    return spark.createDataFrame(QUESTIONS, "query string, text string, project string, answers array<string>, mode string")
