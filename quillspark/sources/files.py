"""Files as rows: folders of files, texts in more than one encoding, JSON by lines, and packages (zip archives of XML members).

A package is opened in the task that has its bytes, member by member; what it holds comes out as rows, and what is
wrong with it as a value in a column instead of an exception, so one bad file doesn't end a job.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import xml.parsers.expat as expat
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Folders that a walk leaves out.
PRUNED = [".git", "__pycache__", "node_modules"]
# The tags of a section's parts and of its package description.
PARAGRAPH, RUN_TEXT, TABLE, CELL, EQUATION, SCRIPT, PICTURE, IMAGE = "hp:p", "hp:t", "hp:tbl", "hp:tc", "hp:equation", "hp:script", "hp:pic", "hc:img"
DESCRIPTION = "Contents/content.hpf"
SECTION = r"^Contents/section[0-9]+\.xml$"
#: Bytes of members, and members, that leave a task in one batch.
BATCH_BYTES, BATCH_MEMBERS = 1 << 22, 1 << 10


def files(spark: SparkSession, root: str, pruned: list[str] = PRUNED) -> DataFrame:
    """path (below root), length, content of all files under a folder, without those below pruned folders. Columns that aren't selected aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.concat(F.lit("/"), F.regexp_replace("path", "^[a-z0-9]+:/*", ""))
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    below = F.expr("substring(inside, locate(base, inside) + length(base))")
    named = found.select(inside.alias("inside"), F.lit(base).alias("base"), "length", "content").select(below.alias("path"), "length", "content")
    return named.where(~F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), F.array(*map(F.lit, pruned))))


@F.pandas_udf(StringType())
def _korean(content: pd.Series) -> pd.Series:
    def one(data: bytes | None) -> str | None:
        try:
            return None if data is None else data.decode("cp949")
        except UnicodeDecodeError:
            return None

    return content.map(one)


def decoded(df: DataFrame, content: str = "content") -> DataFrame:
    """The columns of `df` but for its bytes, then text, codec: UTF-8, else the Korean code page, else both null. Only bytes that aren't UTF-8 leave the JVM."""
    utf8 = F.try_validate_utf8(F.col(content).cast("string"))
    other = _korean(F.when(utf8.isNull(), F.col(content)))
    text = F.coalesce(utf8, F.col("_other"))
    codec = F.when(utf8.isNotNull(), "utf-8").when(F.col("_other").isNotNull(), "cp949")
    kept = [c for c in df.columns if c != content]
    return df.withColumn("_other", other).select(*kept, text.alias("text"), codec.alias("codec"))


def json_lines(docs: DataFrame, key: str, text: str, schema: str, offset: int = 0) -> DataFrame:
    """key, line (from 0), value of the lines from an offset on that hold one JSON object of the schema; blank and broken lines are left out, but counted."""
    lines = docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line", "raw")).where((F.col("line") >= offset) & (F.trim("raw") != ""))
    parsed = lines.withColumn("value", F.from_json("raw", f"{schema}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"}))
    return parsed.where(F.col("value._broken").isNull() & F.trim("raw").startswith("{")).select(key, "line", F.col("value").dropFields("_broken").alias("value"))


def _members(data: bytes | None) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(name, bytes, what is wrong) of a package's members in the archive's order."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data or b""))
    except (zipfile.BadZipFile, ValueError):
        yield None, None, "no archive"
        return
    for info in archive.infolist():
        if info.is_dir():
            continue
        try:
            content = archive.read(info)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
            yield info.filename, None, "damaged"
            continue
        fault = None
        if info.filename.endswith((".xml", ".hpf")):
            try:
                ET.fromstring(content)
            except ET.ParseError:
                fault = "malformed"
        yield info.filename, content, fault


def members(packages: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, member, n_bytes, fault, data of each member: fault is no archive (one row, member null), damaged (data null), malformed (XML that doesn't parse) or null."""
    kind = packages.schema[key].dataType.simpleString()

    def read(batches):
        out, size = [], 0
        schema = pa.schema([(key, batches_type), ("member", pa.string()), ("n_bytes", pa.int64()), ("fault", pa.string()), ("data", pa.binary())])
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1)):
                for name, got, fault in _members(data.as_py()):
                    out.append({key: k.as_py(), "member": name, "n_bytes": None if got is None else len(got), "fault": fault, "data": got})
                    size += len(got or b"")
                    if size > BATCH_BYTES or len(out) >= BATCH_MEMBERS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    batches_type = {"bigint": pa.int64(), "string": pa.string()}[kind]
    return packages.select(key, content).mapInArrow(read, f"{key} {kind}, member string, n_bytes bigint, fault string, data binary")


def _attributes(name: str, attribute: str, having: str = "") -> Column:
    return F.expr(f"xpath(xml, \"//*[name()='{name}']{having}/@{attribute}\")")


def sections(found: DataFrame, key: str) -> DataFrame:
    """key, position, member, fault: the sections in the order of the spine, not of their names.

    Faults: 'missing' (the manifest names a member that the package hasn't, or the spine an id that the manifest hasn't), 'duplicate' (two items of one id).
    Packages whose description doesn't parse have no rows.
    """
    xml = found.where((F.col("member") == DESCRIPTION) & F.col("fault").isNull()).select(key, F.col("data").cast("string").alias("xml"))
    listed = xml.select(key, _attributes("opf:item", "id", "[@id and @href]").alias("ids"), _attributes("opf:item", "href", "[@id and @href]").alias("hrefs"), _attributes("opf:itemref", "idref").alias("spine"))
    items = listed.select(key, F.explode(F.arrays_zip("ids", "hrefs")).alias("i")).groupBy(key, F.col("i.ids").alias("item")).agg(F.min("i.hrefs").alias("member"), F.count(F.lit(1)).alias("n"))
    order = listed.select(key, F.posexplode("spine").alias("position", "item"))
    there = found.where("member is not null").select(key, "member", F.lit(True).alias("there")).distinct()
    placed = order.join(items, [key, "item"], "left").join(there, [key, "member"], "left")
    fault = F.when(F.col("n") > 1, "duplicate").when(F.col("there").isNull(), "missing")
    return placed.select(key, F.col("position").cast("long").alias("position"), "member", fault.alias("fault"))


class _Walk:
    """Blocks of a section in document order: paragraphs outside of tables, cells of every table by the nearest one, equations, pictures."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.n_tables = 0

    def add(self, kind: str, text: str | None, **place) -> None:
        self.rows.append({"kind": kind, "text": text, **place})

    def text(self, node: ET.Element) -> str:
        """The text of a node's own runs, without that of tables inside."""
        parts = []
        for child in node:
            if child.tag == RUN_TEXT:
                parts.append("".join(child.itertext()))
            elif child.tag not in (TABLE, EQUATION, PICTURE):
                parts.append(self.text(child))
        return "".join(parts)

    def walk(self, node: ET.Element, depth: int) -> None:
        for child in node:
            if child.tag == PARAGRAPH and not depth:
                self.add("paragraph", self.text(child))
                self.walk(child, depth)
            elif child.tag == EQUATION:
                self.add("equation", child.findtext(SCRIPT, ""))
            elif child.tag == PICTURE:
                image = next(child.iter(IMAGE), None)
                self.add("picture", None if image is None else image.get("binaryItemIDRef"))
            elif child.tag == TABLE:
                self.table(child, depth + 1)
            else:
                self.walk(child, depth)

    def table(self, node: ET.Element, depth: int) -> None:
        number = self.n_tables
        self.n_tables += 1
        cells = [cell for row in node for cell in ([row] if row.tag == CELL else row.findall(CELL))]
        for cell in cells:
            at, span = cell.find("hp:cellAddr"), cell.find("hp:cellSpan")
            whole = lambda e, name: int(e.get(name)) if e is not None and (e.get(name) or "").isdigit() else None
            place = {"tab": number, "depth": depth, "row": whole(at, "rowAddr"), "col": whole(at, "colAddr"), "row_span": whole(span, "rowSpan"), "col_span": whole(span, "colSpan")}
            self.add("cell", self.text(cell), **place)
        for cell in cells:
            self.walk(cell, depth)


def _tree(data: bytes) -> ET.Element:
    """The elements with their names as written, prefix and all."""
    builder, reader = ET.TreeBuilder(), expat.ParserCreate()
    reader.buffer_text = True
    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = builder.start, builder.end, builder.data
    reader.Parse(data, True)
    return builder.close()


def blocks(found: DataFrame, key: str) -> DataFrame:
    """key, member, seq, kind, text, tab, depth, row, col, row_span, col_span of the parts of well-formed sections, in document order.

    kind is paragraph, cell (tab counts the section's tables from 0, depth their nesting from 1), equation (its script) or picture (the name of its image).
    """
    kind = found.schema[key].dataType.simpleString()
    key_type = {"bigint": pa.int64(), "string": pa.string()}[kind]
    numbers = ["tab", "depth", "row", "col", "row_span", "col_span"]

    def read(batches):
        schema = pa.schema([(key, key_type), ("member", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("text", pa.string()), *((n, pa.int64()) for n in numbers)])
        for batch in batches:
            for k, member, data in zip(*(batch.column(i) for i in range(3))):
                walk = _Walk()
                walk.walk(_tree(data.as_py()), 0)
                rows = [{key: k.as_py(), "member": member.as_py(), "seq": i, **r} for i, r in enumerate(walk.rows)]
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 4096], schema)

    parts = found.where(F.col("member").rlike(SECTION) & F.col("fault").isNull()).select(key, "member", "data")
    return parts.mapInArrow(read, f"{key} {kind}, member string, seq bigint, kind string, text string, " + ", ".join(f"{n} bigint" for n in numbers))
