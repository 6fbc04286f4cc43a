"""Trees of documents as rows: alignment of many documents by path, and digests of all subtrees."""

from __future__ import annotations

import hashlib
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize, new_path, task_partitions, temporary

_SCHEMA = "doc {doc}, at long, parent long, depth int, path string, tag string, value string"
#: Nodes that leave a task in one batch.
BATCH_NODES = 1 << 14
_JSON = json.JSONEncoder(ensure_ascii=False)
#: Characters of texts that are digested side by side, and at least one text.
BATCH_CHARS = 1 << 20


def _encoded(value: object) -> str:
    """A JSON value without members; the encoder is slow to start on numbers."""
    return str(value) if type(value) is int else _JSON.encode(value)


def _json_nodes(text: str) -> Iterator[tuple]:
    """(parent, depth, path, tag, value) in the order of the text; members by name, items by place."""
    rest, at = [(json.loads(text), None, 0, "$", "")], -1
    while rest:
        value, parent, depth, path, tag = rest.pop()
        at += 1
        inner = isinstance(value, (dict, list))
        yield parent, depth, path, tag, None if inner else _encoded(value)
        if isinstance(value, dict):
            rest += reversed([(v, at, depth + 1, f"{path}.{k}", k) for k, v in value.items()])
        elif isinstance(value, list):
            rest += reversed([(v, at, depth + 1, f"{path}[{i}]", "") for i, v in enumerate(value)])


def _xml_nodes(text: str) -> Iterator[tuple]:
    """The same of elements: each by its place among the elements of its name, with its own text."""
    root = ET.fromstring(text)
    rest, at = [(root, None, 0, f"/{root.tag}[0]")], -1
    while rest:
        element, parent, depth, path = rest.pop()
        at += 1
        yield parent, depth, path, element.tag, (element.text or "").strip()
        seen: dict[str, int] = {}
        inner = []
        for e in element:
            inner.append((e, at, depth + 1, f"{path}/{e.tag}[{seen.get(e.tag, 0)}]"))
            seen[e.tag] = seen.get(e.tag, 0) + 1
        rest += reversed(inner)


def _json_root(text: str) -> object:
    root = json.loads(text)
    if "\\u" in text:
        _JSON.encode(root).encode()  # half a surrogate pair is no text
    return root


def _json_breadth(nodes: list) -> tuple[list[str], list[str], list[int]]:
    """Tags and values of trees in breadth-first order, all roots first, and where each node's children begin, which lie side by side; the last number is the end."""
    tags, values, begin = [""] * len(nodes), [], [len(nodes)]
    for node in nodes:
        kind = type(node)
        if kind is dict:
            tags += node
            nodes += node.values()
            values.append("")
        elif kind is list:
            tags += [""] * len(node)
            nodes += node
            values.append("")
        else:
            values.append(_encoded(node))
        begin.append(len(nodes))
    return tags, values, begin


def _xml_breadth(nodes: list[ET.Element]) -> tuple[list[str], list[str], list[int]]:
    """The same of elements."""
    begin = [len(nodes)]
    for element in nodes:
        nodes += element
        begin.append(len(nodes))
    return [e.tag for e in nodes], [(e.text or "").strip() for e in nodes], begin


def _subtree_counts(tags: pa.Array, values: pa.Array, begin: np.ndarray, copies: np.ndarray, least: int) -> pa.RecordBatch:
    """digest, size, places, documents of the subtrees of `least` nodes and more of trees in breadth-first order, each in so many copies, digested as `digests` does, level by level from the deepest."""
    levels, low, high, docs = [], 0, int(begin[0]), np.arange(begin[0])
    while low < high:
        levels.append((low, high, docs))
        docs = np.repeat(docs, np.diff(begin[low : high + 1]))
        low, high = high, int(begin[high])
    own, size, found = pa.array([], pa.string()), np.zeros(0, np.int64), []
    for low, high, docs in reversed(levels):
        at = begin[low : high + 1] - begin[low]
        inner = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), own), ",")
        text = pc.binary_join_element_wise(tags[low:high], "(", inner, ")", values[low:high], "").dictionary_encode()
        own = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text.dictionary.to_pylist()], pa.string()).take(text.indices)
        size = 1 + np.diff(np.append(0, np.cumsum(size))[at])
        kept = size >= least
        found.append((own.filter(pa.array(kept)), size[kept], docs[kept]))
    own = pa.concat_arrays([x[0] for x in found]).dictionary_encode()
    code, size, docs = own.indices.to_numpy(), *(np.concatenate([x[i] for x in found]) for i in (1, 2))
    order = np.lexsort((docs, size, code))
    code, size, docs = code[order], size[order], docs[order]
    other = np.append(True, (np.diff(code) != 0) | (np.diff(size) != 0))[: len(code)]
    in_doc = other | np.append(True, np.diff(docs) != 0)[: len(code)]
    first, held = np.flatnonzero(other), copies[docs]
    digest = [bytes.fromhex(x) for x in own.dictionary.take(pa.array(code[first])).to_pylist()]
    counts = [np.add.reduceat(x, first) if len(first) else first for x in (held, held * in_doc)]
    columns = [pa.array(digest, pa.binary()), *(pa.array(x, pa.int64()) for x in (size[first], *counts))]
    return pa.RecordBatch.from_arrays(columns, names=["digest", "size", "places", "documents"])


def tree_nodes(docs: DataFrame, kind: str = "json") -> DataFrame:
    """doc, at (from 0, in the text's order), parent, depth, path, tag, value of the nodes of documents (doc, text), which are json or xml. Null texts, and what doesn't parse, have none."""
    parse = {"json": _json_nodes, "xml": _xml_nodes}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = [], []

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
                return pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(own, pa.int64())), *(pa.array([x[i] for x in found], k) for i, k in enumerate(kinds))], names=["doc", "at", "parent", "depth", "path", "tag", "value"])

            for i, text in enumerate(batch.column("text").to_pylist()):
                try:
                    nodes = [] if text is None else [(n, *x) for n, x in enumerate(parse(text))]
                except (ValueError, RecursionError, ET.ParseError):
                    nodes = []
                own += [i] * len(nodes)
                found += nodes
                if len(own) >= BATCH_NODES:
                    yield made()
                    own, found = [], []
            if own:
                yield made()

    return docs.select("doc", "text").mapInArrow(run, _SCHEMA.format(doc=docs.schema["doc"].dataType.simpleString()))


def aligned(nodes: DataFrame) -> DataFrame:
    """path, documents, absent, values, difference over all documents: where a path is, and whether all have it (skeleton if not) and with one value (value if not, else none).

    A path is a row whatever documents there are, so none is compared with each other one; absence is counted, not stored.
    """
    # of a document that comes twice a path counts once
    per = materialize(nodes.groupBy("path", "doc").agg(F.min(F.coalesce("value", F.lit(""))).alias("own"), F.min("at").alias("at")), "paths")
    # texts are parsed once: each document has one root or more
    total = per.where("at = 0").select("doc").distinct().count()
    paths = per.groupBy("path").agg(F.count(F.lit(1)).alias("documents"), F.min("own").alias("least"), F.max("own").alias("most"), F.count_distinct("own").alias("values"))
    absent = F.lit(total) - F.col("documents")
    return paths.select("path", "documents", absent.alias("absent"), "values", F.when(absent > 0, "skeleton").when(F.col("least") != F.col("most"), "value").otherwise("none").alias("difference"))


def digests(nodes: DataFrame) -> DataFrame:
    """doc, at, path, depth, size, digest of every node: a digest of its tag, its children's digests in order and its value, so equal subtrees meet by equality, in one document or in many. Documents have one row each.

    Levels are worked off from the deepest, each a written table, so the passes are as many as the tree is deep.
    """
    spark, out = nodes.sparkSession, new_path(nodes.sparkSession, "digests")
    with temporary(spark):
        rows = materialize(nodes.select("doc", "at", "parent", "depth", "path", "tag", "value"), "nodes")
        deepest = rows.agg(F.max("depth")).first()[0]
        every, below = None, None
        for depth in range(deepest if deepest is not None else 0, -1, -1):
            level = rows.where(F.col("depth") == depth)
            if below is None:
                level = level.withColumn("inner", F.lit("")).withColumn("n", F.lit(0).cast("long"))
            else:
                inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), ",")
                held = below.groupBy("doc", F.col("parent").alias("at")).agg(inner.alias("inner"), F.sum("size").alias("n"))
                level = level.join(held, ["doc", "at"], "left").withColumn("inner", F.coalesce("inner", F.lit(""))).withColumn("n", F.coalesce("n", F.lit(0)))
            digest = F.sha2(F.concat("tag", F.lit("("), "inner", F.lit(")"), F.coalesce("value", F.lit(""))), 256)
            below = materialize(level.select("doc", "at", "parent", "path", "depth", (F.col("n") + 1).alias("size"), digest.alias("digest")), "level")
            every = below if every is None else every.unionByName(below)
        return materialize(every.drop("parent"), "digests", out)


def repeated_subtrees(digests: DataFrame, least: int = 2) -> DataFrame:
    """digest, size, places, documents of subtrees of `least` nodes and more that stand in several places."""
    return digests.where(F.col("size") >= least).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("doc").alias("documents")).where("places > 1")


def repeated_in_texts(docs: DataFrame, kind: str = "json", least: int = 2, partitions: int | None = None) -> DataFrame:
    """The same of documents (doc, text) with one row each, as of `repeated_subtrees(digests(tree_nodes(docs, kind)), least)`; one without an id, with null text or what doesn't parse has none.

    A text holds its whole tree, so a task digests it where it lies, from the leaves up, and hands on counts of the equal subtrees of many texts: nodes are neither written nor shuffled, and equal texts of a batch are parsed once. Counts meet over `partitions`, or the session's number.
    """
    parse, breadth = {"json": (_json_root, _json_breadth), "xml": (ET.fromstring, _xml_breadth)}[kind]

    def counted(texts: list[str], copies: list[int]) -> Iterator[pa.RecordBatch]:
        roots, held = [], []
        for text, n in zip(texts, copies, strict=True):
            try:
                roots.append(parse(text))
            except (ValueError, RecursionError, ET.ParseError):
                continue
            held.append(n)
        if roots:
            tags, values, begin = breadth(roots)
            yield _subtree_counts(pa.array(tags, pa.string()), pa.array(values, pa.string()), np.array(begin), np.array(held), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = batch.column("text").drop_null().value_counts()
            texts, copies, chars, first = equal.field(0).to_pylist(), equal.field(1).to_pylist(), 0, 0
            for i, text in enumerate(texts, 1):
                chars += len(text)
                if chars >= BATCH_CHARS or i == len(texts):
                    yield from counted(texts[first:i], copies[first:i])
                    chars, first = 0, i

    parts = docs.where("doc IS NOT NULL").select("text").mapInArrow(run, "digest binary, size long, places long, documents long")
    met = parts.repartition(partitions or task_partitions(docs), "digest", "size").groupBy("digest", "size")
    return met.agg(F.sum("places").alias("places"), F.sum("documents").alias("documents")).where("places > 1").withColumn("digest", F.lower(F.hex("digest")))
