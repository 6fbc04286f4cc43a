"""Small reports with the claims, citations and references that the driver tables don't hold; queries add them to the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REPORTS = [
    (-1, "# Summary\nThe beam mass is 1,250 kg and the span = 12.5 m.\npump power was 3 kW; the load mass is 900 g.\nheight is 7 kg.\nspan is 12.5 kg, too\nin 2021 the total is 42 %.\n# Method\nSee Figure 3 and Table 12.\n1. The first step takes 90 s\npower = 3.2 kW\nspan = 12.5 m\n| a | b |\n|---|---|\n| 1 | 2 | 3 |\nno table\n| x |\n| y |\n"),
    (-2, "# Body\nThe beam mass is 1.25 t, measured twice.\nThe pump power was 3,050 W; the load mass is 950 g.\nspan = 12.9 m\npower = 3.2 kW\ndepth = 4 m\nAs Kim (2020) shows [1], and others agree (Lee, 2019; Park, 2030), [@choi2021] found more. Cho (2031) differs.\n\n\n# References\nKim, A. (2020). Beams under load. Journal of Beams. https://doi.org/10.1000/Beam.12_3\n  ISBN 978-0-306-40615-7\nLee, B. (2019). Pumps and power. Press. http://Example.org/Pumps#top\n\nPark, C. (2030). Loads to come. doi:10.5555/loads(1)\n# After\nlast = 1 m\n"),
    (-3, "# 참고문헌\nNo, D. (1999). Old things. ISBN 0-306-40615-2\n"),
]
#: Reports with something for every checker of a preflight.
DRAFTS = [
    (-21, "intro TODO 3.14\n# Summary\nThe mass is 12.5 and the speed 7.25; fill in here.\n# Body\nmass = 12.5 kg\nmass = 12500 g\nspan = 3 m\nIn order to show 12.51, 9.75 and [1] [4] [@kim20] [@lee19].\n[[FIG file=\"a.png\" caption=\"x\"]] [[FIG file=\"b.png\"]]\n[[FIG file=\"a.png\" caption=\"y\"]]\n[[TABLE open\nvery very long, in order to\n# References\n@kim20 Kim (2020). A. https://x.org/a\n  more https://x.org/a\nLee (2031). B (1999). https://x.org/b\n\n"),
    (-21, "# References\nno body"),
    (-22, "# Abstract\n5.5 only\n# Method\nno numbers, tbd"),
    (-23, "plain text [7] [@none] 1.5\r\nx = 1.5\r\ny=2 %"),
]
PRIVATE = [
    (-11, "see C:\\Users\\anna\\notes.txt and /home/bert/x\nmail noreply@forge.org or ann@sub.users.noreply.github.com\nC:\\Users\\me\\y"),
    (-12, "번호 900101-1234567, 전화 010-1234-5678 그리고 02-345-6789\n홍길동 12345678\n12-34"),
    (-14, "900101-1234567 900102-1234567\n900101 - 1234567, 1900101-1234567 900101-12345678\n900101-5234567 010 - 1234 -5678 01012345678 010-12-3456\n12345 23456 345678 9 45678\n가나다라마바사 12345\n12345 김철수 23456 (이영희) 34567\n홍길동 -------------- 12345 박 01234\n번호12345와 이름"),
    (-13, "[[FIG a\nb]] text **bold** and [[TAB c]] **more** end\n# guide: fill\n# Guide\n# other\n\n<!-- x -->\n\nlast part"),
]
#: What a summary claims: subject (null for none), unit, value.
SUMMARY = [("beam mass", "kg", 1250.0), ("pump power", "W", 3000.0), ("load mass", "kg", 0.9), ("span", "m", 12.7), ("colour", "m", 1.0), (None, "s", 90.0), (None, "m", 77.0)]
CONSTANTS = [(42.0, "%"), (12.0, None), (87.0, "kg")]
ENVELOPES = [("plain", "p", 20), ("plain", "a", 40), ("rich", "p", 400), ("rich", "a", 400), ("rich", "li", 400), ("rich", "ul", 40), ("rich", "h1", 4), ("rich", "div", 400)]
MODULES = [("core", None), ("text", "core"), ("claims", "text"), ("forms", "core"), ("forms", "text"), ("gates", "claims"), ("gates", "forms"), ("lone", None)]
#: References to parts that no table has, and what owners need that none supplies.
UNDEFINED, UNMET = [(-1,), (-1,), (-2,)], [("RESERVE", 0), ("RESERVE", 99), ("RESERVE", 99)]
#: Trials of groups in both splits, of which one passes everywhere.
TRIALS = [("sure", "train", True), ("sure", "holdout", True), ("sure", "holdout", True), ("unsure", "train", True), ("unsure", "holdout", False)]
FORBIDDEN = [("fill in here",), ("hha",), ("and the",)]


def reports(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text of a table and the reports."""
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(REPORTS, "doc_id long, text string"))


def private(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text of a table and of texts with personal data and tags."""
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(PRIVATE, "doc_id long, text string"))


def drafts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text of a table and of the drafts."""
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(DRAFTS, "doc_id long, text string"))


def literal(value) -> str:
    """A value in SQL."""
    return "NULL" if value is None else repr(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A table expression of rows."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({names}))"


#: The reports beside the documents, as SQL.
REPORTS_SQL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT CAST(doc_id AS BIGINT), text FROM {values(REPORTS, 'doc_id, text')})"
#: The texts with personal data and tags beside the documents, as SQL.
PRIVATE_SQL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT CAST(doc_id AS BIGINT), text FROM {values(PRIVATE, 'doc_id, text')})"
#: The drafts beside the documents, as SQL.
DRAFTS_SQL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT CAST(doc_id AS BIGINT), text FROM {values(DRAFTS, 'doc_id, text')})"
