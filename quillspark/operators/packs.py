"""Layers of settings as trees: JSON objects flattened to paths, merged by precedence, and rebuilt.

In a merge of layers, objects are joined member by member and anything else replaces what a lower layer has there, so a scalar or a list hides a
whole subtree, and an object a scalar. As rows: what stands at a path after all layers is its topmost node, if no node above it in the tree
was replaced by something that is no object in a still higher layer. So a merge is one pass over a key's nodes in the order of their paths, however many layers there are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that leave a task in one batch, about.
BATCH_ROWS = 1 << 13
_PARTS = "key {key}, priority {priority}, mark long, path string, kind string, value string"


_JSON = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def _nodes(value: object, path: str = "") -> Iterator[tuple[str, str, str | None]]:
    """(path, kind, value) of a tree's nodes: objects, and what else there is as JSON."""
    rest = [(path, value)]
    while rest:
        path, value = rest.pop()
        if isinstance(value, dict):
            yield path, "object", None
            rest += [(f"{path}/{_escaped(k)}", v) for k, v in value.items()]
        else:
            yield path, "value", _JSON.encode(value)


def flattened(layers: DataFrame) -> DataFrame:
    """key, priority, mark, path, kind, value of layers (key, priority, text of JSON): a row a node; kind is object, value or invalid (a text that isn't JSON: one row without a path). mark tells texts of one priority apart. Null texts have no nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                try:
                    nodes = [] if text is None else list(_nodes(json.loads(text, parse_constant=_constant)))
                except (ValueError, RecursionError):
                    nodes = [(None, "invalid", None)]
                own += [i] * len(nodes)
                found += nodes
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("key", "priority", "mark")), *(pa.array([x[i] for x in found], pa.string()) for i in range(3))], names=["key", "priority", "mark", "path", "kind", "value"])

    kinds = {c: layers.schema[c].dataType.simpleString() for c in ("key", "priority")}
    return layers.select("key", "priority", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, _PARTS.format(**kinds))


class _Tree:
    """The merge of one key's nodes as they come, each path before those below it: open holds the objects on the way to the present one, and no more is kept."""

    def __init__(self, key: object) -> None:
        self.key = key
        self.open: list[list] = []
        self.node: list | None = None

    def add(self, path: list[str], at: tuple, kind: str, value: str | None) -> Iterator[tuple]:
        if self.node is None or self.node[0] != path:
            yield from self.settle()
            self.node = [path, at, kind, value, None, set()]
        node = self.node
        node[1:4] = at, kind, value
        if kind == "value":
            node[4] = at
            node[5].add(value)

    def settle(self) -> Iterator[tuple]:
        """Rows that are known once the present node has all its layers."""
        if self.node is None:
            return
        (path, top, kind, value, replaced, given), self.node = self.node, None
        yield from self.leave(path)
        if self.open and (over := self.open[-1][2]) is not None:
            if over > top:
                return
            replaced = max(replaced or over, over)
        if self.open:
            self.open[-1][3] = False
        if kind == "value":
            yield self.key, path, value, top[1], len(given)
        # with what replaced it or one above last, and whether nothing stands in it
        self.open.append([path, top, replaced, kind == "object", len(given)])

    def leave(self, path: list[str] | None) -> Iterator[tuple]:
        while self.open and (path is None or path[: len(self.open[-1][0])] != self.open[-1][0]):
            own, top, _, empty, given = self.open.pop()
            if empty:
                yield self.key, own, "{}", top[1], given

    def end(self) -> Iterator[tuple]:
        yield from self.settle()
        yield from self.leave(None)


def _folded(nodes: DataFrame) -> DataFrame:
    """The merge of nodes whose keys lie in one partition each: sorted, they are one stream, and a task holds a path at a time, however many layers and nodes a key has."""
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("key", "priority")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, out, kind_of = None, [], None

        def made() -> pa.RecordBatch:
            columns = [pa.array([x[0] for x in out], kind_of[0]), pa.array(["/".join(x[1]) for x in out], pa.string()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], kind_of[1]), pa.array([x[4] for x in out], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["key", "path", "value", "priority", "given"])

        for batch in batches:
            kind_of = batch.schema.field("key").type, batch.schema.field("priority").type
            for key, priority, mark, path, kind, value in zip(*(batch.column(c).to_pylist() for c in ("key", "priority", "mark", "path", "kind", "value"))):
                if tree is None or tree.key != key:
                    if tree is not None:
                        out += tree.end()
                    tree = _Tree(key)
                # a null priority is the least
                out += tree.add(path.split("/"), (priority is not None, priority, mark), kind, value)
            if len(out) >= BATCH_ROWS:
                yield made()
                out = []
        if tree is not None:
            out += tree.end()
        if out:
            yield made()

    rows = nodes.where("kind <> 'invalid'").sortWithinPartitions("key", F.split("path", "/"), "priority", "mark")
    return rows.mapInArrow(run, f"key {kinds['key']}, path string, value string, priority {kinds['priority']}, given long")


def merged(nodes: DataFrame) -> DataFrame:
    """key, path, value, priority, given of the merge of layers (see flattened): each value, or empty object, that it has, the priority of its layer, and how many different values the layers give the path.

    Higher priorities win; of one priority the texts go by a hash, so repeated layers don't matter. Invalid layers are left out.
    """
    return _folded(nodes.repartition("key"))


def _laid(node: list, value: object, at: int, priority: object) -> None:
    """Lay a layer's value over a node: [nodes below by name, layer that gave it last and its priority, value or None for an object, layer of the last value, all values]."""
    rest = [(node, value)]
    while rest:
        node, value = rest.pop()
        node[1], node[2] = at, priority
        if isinstance(value, dict):
            node[3] = None
            for name, inner in value.items():
                below = node[0].get(name)
                if below is None:
                    below = node[0][name] = [{}, -1, None, None, -1, set()]
                rest.append((below, inner))
        else:
            node[3], node[4] = _JSON.encode(value), at
            node[5].add(node[3])


def _left(node: list) -> Iterator[tuple]:
    """(path, value, priority, given) of what is left of a tree: a node goes if one above it was replaced by a value in a later layer."""
    rest = [("", node, -1)]
    while rest:
        path, node, over = rest.pop()
        over = max(over, node[4])
        kept = [(name, below) for name, below in node[0].items() if below[1] >= over]
        if node[3] is not None:
            yield path, node[3], node[2], len(node[5])
        elif not kept:
            yield path, "{}", node[2], len(node[5])
        rest += [(f"{path}/{_escaped(name)}", below, over) for name, below in kept]


def merged_layers(layers: DataFrame) -> DataFrame:
    """merged(flattened(layers)) of layers (key, priority, text of JSON) by a fold: texts are shuffled, once, and not their nodes. A task holds the tree of one key's settings, and a layer at a time."""
    kinds = {c: layers.schema[c].dataType.simpleString() for c in ("key", "priority")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        own, last, tree, at, out, types = none, None, None, 0, [], ()

        def made() -> pa.RecordBatch:
            keys, nodes = [k for k, rows in out for _ in rows], [x for _, rows in out for x in rows]
            return pa.RecordBatch.from_arrays([pa.array(keys, types[0]), *(pa.array([x[i] for x in nodes], t) for i, t in enumerate((pa.string(), pa.string(), types[1], pa.int64())))], names=["key", "path", "value", "priority", "given"])

        for batch in batches:
            types = batch.schema.field("key").type, batch.schema.field("priority").type
            for key, priority, mark, text in zip(*(batch.column(c).to_pylist() for c in ("key", "priority", "mark", "text"))):
                if own is none or key != own:
                    if tree is not None:
                        out.append((own, list(_left(tree))))
                    own, last, tree, at = key, None, None, 0
                if last == (priority, mark):
                    continue
                last = priority, mark
                try:
                    value = json.loads(text, parse_constant=_constant)
                except (ValueError, RecursionError):
                    continue
                tree = tree or [{}, -1, None, None, -1, set()]
                _laid(tree, value, at, priority)
                at += 1
                if len(out) >= BATCH_ROWS:
                    yield made()
                    out = []
        if tree is not None:
            out.append((own, list(_left(tree))))
        if out:
            yield made()

    rows = layers.where("text is not null").select("key", "priority", F.xxhash64("text").alias("mark"), "text").repartition("key").sortWithinPartitions("key", "priority", "mark")
    return rows.mapInArrow(run, f"key {kinds['key']}, path string, value string, priority {kinds['priority']}, given long")


def rebuilt(merged: DataFrame) -> DataFrame:
    """key, text: the JSON of each key's values, with sorted names."""
    lists = merged.groupBy("key").agg(F.collect_list(F.struct("path", "value")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for m in batch.column("m").to_pylist():
                root: dict = {}
                for x in m:
                    # the root is a member without a name of what holds it
                    names, own = x["path"].split("/"), root
                    for name in names[:-1]:
                        own = own.setdefault(name, {})
                    own[names[-1]] = json.loads(x["value"])
                texts.append(json.dumps(_unescaped(root[""], {x["path"] for x in m}), ensure_ascii=False, separators=(",", ":"), sort_keys=True))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    return lists.mapInArrow(run, f"key {lists.schema['key'].dataType.simpleString()}, text string")


def _unescaped(value: object, ends: set[str], path: str = "") -> object:
    """A rebuilt tree with the names as they were; values that layers gave as a whole stay as they are."""
    if path in ends or not isinstance(value, dict):
        return value
    return {k.replace("~1", "/").replace("~0", "~"): _unescaped(v, ends, f"{path}/{k}") for k, v in value.items()}
