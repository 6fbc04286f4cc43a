"""Queries on large files and places, with the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import privacy
from ..plans.shared import new_path
from ..sources import chunks
from ..sources.tables import read_table
from .fixtures import PRIVATE_SQL, private

#: Bytes of a range: small, so that files of every size are cut.
CHUNK = 1 << 16
# the same places may be looked for in Python, whose look-arounds are those of the JVM
PATTERNS = {"email": privacy.EMAIL, "resident": privacy.RESIDENT, "phone": privacy.PHONE, "license": r"(?i)licen[cs]e"}


def chunked_findings(spark, sf_dir):
    """All texts as large files, read back in ranges: what is found, and how often."""
    path = new_path(spark, "texts")
    private(spark, read_table(spark, sf_dir, "documents")).where("text is not null").select("text").write.text(path)
    found = chunks.chunk_matches(chunks.chunked_texts(spark, path, CHUNK), PATTERNS)
    told = F.when(F.col("kind").isin("resident", "phone"), F.regexp_replace("found", "[^0-9]", "")).otherwise(F.lower("found"))
    return found.groupBy(F.col("kind"), told.alias("found")).agg(F.count(F.lit(1)).alias("places"))


QUERIES = {"chunked_findings": chunked_findings}


def oracle(identities: str, digits: str) -> dict[str, str]:
    return {
        "chunked_findings": f"""{digits}
        SELECT kind, found, count(*) AS places FROM (
            SELECT kind, number AS found FROM ({identities})
            UNION ALL SELECT 'email', lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))) FROM {PRIVATE_SQL}
            UNION ALL SELECT 'license', unnest(regexp_extract_all(lower(text), 'licen[cs]e')) FROM {PRIVATE_SQL}) GROUP BY 1, 2""",
    }
