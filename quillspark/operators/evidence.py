"""Evidence: record streams, keyed receipts, machine checks, scorecards, support of claims, and the seats that others fill."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forms import squeezed
from .inventories import MARKED, UNMARKED

#: Bytes that a stream may have when inflated; a longer one is a fault.
LONGEST = 1 << 28
# The fields of a record's head, and the size that says that four bytes of size follow.
EXTENDED = 0xFFF


def _records(raw: bytes | None) -> Iterator[tuple[int | None, int | None, int | None, str | None]]:
    """(tag, level, size, fault) of the records of a deflated stream; a fault ends it."""
    try:
        inflater = zlib.decompressobj(-15)
        data = inflater.decompress(raw or b"", LONGEST + 1)
    except zlib.error:
        data, inflater = b"", None
    if inflater is None or not inflater.eof or len(data) > LONGEST:
        yield None, None, None, "too_long" if len(data) > LONGEST else "deflate_invalid"
        return
    at, before = 0, -1
    while at < len(data):
        if at + 4 > len(data):
            yield None, None, None, "header_truncated"
            return
        (head,) = struct.unpack_from("<I", data, at)
        tag, level, size = head & 0x3FF, head >> 10 & 0x3FF, head >> 20
        at += 4
        if size == EXTENDED:
            if at + 4 > len(data):
                yield tag, level, None, "size_truncated"
                return
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        fault = "level_jump" if level > before + 1 else "payload_truncated" if at + size > len(data) else None
        yield tag, level, size, fault
        if fault:
            return
        at, before = at + size, level


def record_scan(streams: DataFrame, key: str, content: str) -> DataFrame:
    """key, seq, tag, level, size, fault of the records of streams: heads of ten bits of tag, ten of level and twelve of size, a level at most one deeper than the one before.

    A broken stream ends with one row that says how: deflate_invalid (a null or empty one too), too_long, header_truncated, size_truncated, level_jump or payload_truncated.
    """

    def read(batches):
        schema = pa.schema([(key, pa.int64()), ("seq", pa.int64()), ("tag", pa.int64()), ("level", pa.int64()), ("size", pa.int64()), ("fault", pa.string())])
        for batch in batches:
            rows = []
            for k, raw in zip(batch.column(0), batch.column(1)):
                for i, (tag, level, size, fault) in enumerate(_records(raw.as_py())):
                    rows.append({key: k.as_py(), "seq": i, "tag": tag, "level": level, "size": size, "fault": fault})
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return streams.select(F.col(key).cast("long").alias(key), content).mapInArrow(read, f"{key} bigint, seq bigint, tag bigint, level bigint, size bigint, fault string")


def keyed_digest(text: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a text in UTF-8, in lower-case hexadecimal; null for null. The key's pads stand in the plan, so plans of a secret key are secret too."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def masked(text: Column, limit: int = 60) -> tuple[Column, Column, Column]:
    """Digest, length and beginning of a text: line ends are spaces, and three points stand for what is cut off."""
    flat = F.regexp_replace(text, r"\r\n|[\r\n]", " ")
    return F.sha2(F.encode(text, "UTF-8"), 256), F.length(text).cast("long"), F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def polygon_area(points: Column) -> Column:
    """The area of a polygon, an array of (x, y) in order; 0 of fewer than three points, null for null."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    crossed = F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(crossed, F.lit(0.0), lambda a, x: a + x)) / 2)


def machine_checks(checks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """id, kind, ok of checks (id, kind, name, arg) on artifacts (name, text): file (it is there), text_present, text_absent, unmodified (arg is its digest). Without its artifact no check holds, nor does one of an unknown kind."""
    rows = checks.join(artifacts.select("name", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("there")), "name", "left")
    holds = F.contains("text", "arg")
    ok = F.when(F.col("kind") == "file", True).when(F.col("kind") == "text_present", holds).when(F.col("kind") == "text_absent", ~holds).when(F.col("kind") == "unmodified", F.sha2(F.encode("text", "UTF-8"), 256) == F.col("arg"))
    return rows.select("id", "kind", (F.coalesce("there", F.lit(False)) & F.coalesce(ok, F.lit(False))).alias("ok"))


def scorecard_faults(workspaces: DataFrame, scorecards: DataFrame, files: DataFrame) -> DataFrame:
    """ws, code of workspaces (ws) with their scorecards (ws, json) and files (ws, name, digest): scorecard_missing (or no JSON), stop_lines_invalid (they must be an object), sheet_missing, sheet_changed (the pinned digest is another)."""
    card = workspaces.join(scorecards, "ws", "left").select("ws", F.try_parse_json("json").alias("v"))
    get = lambda path: F.try_variant_get("v", path, "string")
    rows = card.select("ws", F.col("v").isNull().alias("none"), F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.stop_lines", "variant")).startswith("OBJECT"), F.lit(False)).alias("stops"), get("$.sheet.path").alias("name"), get("$.sheet.sha256").alias("pinned"))
    seen = rows.join(files.select("ws", "name", "digest", F.lit(True).alias("there")), ["ws", "name"], "left")
    pinned = ~F.col("none") & F.col("name").isNotNull()
    codes = F.array_compact(F.array(
        F.when(F.col("none"), "scorecard_missing"), F.when(~F.col("none") & ~F.col("stops"), "stop_lines_invalid"), F.when(pinned & F.col("there").isNull(), "sheet_missing"),
        F.when(pinned & F.col("there") & ~F.coalesce(F.col("pinned") == F.col("digest"), F.lit(False)), "sheet_changed"),
    ))
    return seen.select("ws", F.explode(codes).alias("code"))


def support_matrix(claims: DataFrame, pointers: DataFrame, targets: DataFrame) -> DataFrame:
    """status, claims, unsupported of claims (claim, status): a claim needs one pointer (claim, target) that resolves."""
    held = pointers.join(targets.select("target").distinct(), "target", "left_semi").select("claim").distinct().withColumn("held", F.lit(True))
    return claims.join(held, "claim", "left").groupBy("status").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("held").isNull()).alias("unsupported"))


def staff_seats(cells: DataFrame, labels: list[str], rule: str, darkest: float) -> DataFrame:
    """doc, tab, seat, basis of cells (doc, tab, seat, text, brightness) that aren't for the applicant: by their label, or, where some seat of the form says so (`rule`), by a dark ground without slots."""
    declared = cells.where(F.contains("text", F.lit(rule))).select("doc").distinct().withColumn("declared", F.lit(True))
    label = F.exists(F.array(*[F.lit("".join(x.split())) for x in labels]), lambda x: F.contains(squeezed(F.col("text")), x))
    dark = F.coalesce("declared", F.lit(False)) & F.coalesce(F.col("brightness") <= darkest, F.lit(False)) & ~F.coalesce(F.col("text").rlike(f"{MARKED}|{UNMARKED}"), F.lit(False))
    basis = F.concat_ws(",", F.when(label, "label"), F.when(dark, "shaded"))
    return cells.where("tab is not null").join(declared, "doc", "left").select("doc", "tab", "seat", basis.alias("basis")).where("basis <> ''")


def seal_slots(cells: DataFrame, labels: list[str], reds: list[str]) -> DataFrame:
    """doc, tab, seat, red, labelled of the only cells of their tables (doc, tab, seat, text, borders: colours) that have a red border or name a seal."""
    single = cells.where("tab is not null").groupBy("doc", "tab").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seat", "text", "borders")).alias("c")).where("n = 1")
    red = F.coalesce(F.arrays_overlap(F.transform(F.col("c.borders"), lambda x: F.upper(x)), F.array(*map(F.lit, reds))), F.lit(False))
    label = F.exists(F.array(*[F.lit("".join(x.split())) for x in labels]), lambda x: F.contains(squeezed(F.col("c.text")), x))
    return single.select("doc", "tab", "c.seat", red.alias("red"), label.alias("labelled")).where("red or labelled")


def seats(blocks: DataFrame, key: str) -> DataFrame:
    """doc, tab, seat, text of documents' blocks: cells by table, a million numbers to a section, and paragraphs with tab null; seats are numbered by section and place."""
    section = F.regexp_extract("member", r"([0-9]+)\.xml$", 1).cast("long")
    return blocks.where(F.col("kind").isin("cell", "paragraph")).select(F.col(key).alias("doc"), (section * 1_000_000 + F.col("tab")).alias("tab"), (section * 1_000_000 + F.col("seq")).alias("seat"), "text")
