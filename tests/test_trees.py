"""Trees as rows against recursion."""

import hashlib
import json
import random
import xml.etree.ElementTree as ET

import duckdb

from quillspark.operators import trees
from quillspark.plans.queries import ORACLE_SQL, QUERIES


def tree(rng, depth=0):
    if depth < 3 and rng.random() < 0.6:
        return [tree(rng, depth + 1) for _ in range(rng.randrange(3))] if rng.random() < 0.5 else {k: tree(rng, depth + 1) for k in rng.sample("abc", rng.randrange(3))}
    return rng.choice([1, "x", None, True])


def walk(value, path="$", tag=""):
    inner = [walk(v, f"{path}.{k}", k) for k, v in value.items()] if isinstance(value, dict) else [walk(v, f"{path}[{i}]") for i, v in enumerate(value)] if isinstance(value, list) else []
    own = "" if isinstance(value, (dict, list)) else json.dumps(value)
    digest = hashlib.sha256(f"{tag}({','.join(x[0][1] for x in inner)}){own}".encode()).hexdigest()
    return [(path, digest, 1 + sum(len(x) for x in inner)), *(y for x in inner for y in x)]


def test_digests_and_alignment_equal_recursion(spark):
    rng = random.Random(4)
    docs = [(i, tree(rng)) for i in range(120)]
    df = spark.createDataFrame([*((i, json.dumps(x)) for i, x in docs), (900, None), (901, "{broken")], "doc long, text string").repartition(3)
    nodes = trees.tree_nodes(df)
    found = trees.digests(nodes)
    want = [(i, *x) for i, value in docs for x in walk(value)]
    assert sorted((r.doc, r.path, r.digest, r.size) for r in found.collect()) == sorted(want)
    same = {}
    for _, _, d, n in want:
        same.setdefault((d, n), []).append(d)
    assert sorted((r.digest, r.size, r.places) for r in trees.repeated_subtrees(found).collect()) == sorted((d, n, len(x)) for (d, n), x in same.items() if n > 1 and len(x) > 1)
    paths = {}
    for i, p, *_ in want:
        paths.setdefault(p, set()).add(i)
    got = {r.path: (r.documents, r.absent) for r in trees.aligned(nodes).collect()}
    assert got == {p: (len(d), 120 - len(d)) for p, d in paths.items()}
    assert trees.digests(nodes.limit(0)).count() == trees.aligned(nodes.limit(0)).count() == 0


def test_elements_are_told_by_their_place_among_equals(spark):
    text = "<a><p>one</p><q/><p> two <b>x</b></p></a>"
    df = spark.createDataFrame([(1, text), (2, text.replace("two", "2").replace("<q/>", "")), (3, "<a>")], "doc int, text string")
    nodes = trees.tree_nodes(df, "xml")
    assert [(r.path, r.value) for r in nodes.where("doc = 1").orderBy("at").collect()] == [("/a[0]", ""), ("/a[0]/p[0]", "one"), ("/a[0]/q[0]", ""), ("/a[0]/p[1]", "two"), ("/a[0]/p[1]/b[0]", "x")]
    assert {r.path: r.difference for r in trees.aligned(nodes).collect()} == {"/a[0]": "none", "/a[0]/p[0]": "none", "/a[0]/q[0]": "skeleton", "/a[0]/p[1]": "value", "/a[0]/p[1]/b[0]": "none"}
    assert len(list(ET.fromstring(text).iter())) == trees.digests(nodes).where("doc = 1").count()


def test_alignment_parses_texts_once(spark):
    parsed = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    rows = [(1, '{"a":1}'), (1, '{"a":2,"b":{}}'), (2, "[1]"), (None, "7"), (3, "{")]
    df = spark.createDataFrame(rows, "doc long, text string").mapInArrow(told, "doc long, text string")
    got = sorted(tuple(r) for r in trees.aligned(trees.tree_nodes(df)).collect())
    assert got == [("$", 3, 0, 2, "value"), ("$.a", 1, 2, 1, "skeleton"), ("$.b", 1, 2, 1, "skeleton"), ("$[0]", 1, 2, 1, "skeleton")]
    assert parsed.value == len(rows)


def counted(docs):
    same = {}
    for i, value in docs:
        for _, d, n in walk(value):
            same.setdefault((d, n), []).append(i)
    return {(d, n, len(x), len(set(x))) for (d, n), x in same.items() if n > 1 and len(x) > 1}


def test_subtrees_are_counted_where_texts_lie(spark):
    rng = random.Random(7)
    docs = [(i, {"a": tree(rng), "ß": [tree(rng), "\n\"/", 10**30, 0.5, -0.0]}) for i in range(300)]
    docs += [(i, docs[i % 9][1]) for i in range(300, 400)]
    deep = []
    for _ in range(300):
        deep = [deep]
    docs += [(400, deep), (401, [deep]), (402, [[i % 7, {"x": i % 5}] for i in range(90000)])]
    none = [(900, None), (901, "{broken"), (902, '{"a": {"b": "\\ud800"}}'), (903, '{"a": {"b": "\\ud800"}}'), (None, json.dumps([[1, 2], [1, 2]]))]
    texts = [(i, json.dumps(x, ensure_ascii=i % 2 == 0)) for i, x in docs]
    assert len(texts[-1][1]) > trees.BATCH_CHARS
    df = spark.createDataFrame([*texts, *none], "doc long, text string").repartition(3)
    got = {tuple(r) for r in trees.repeated_in_texts(df, partitions=5).select("digest", "size", "places", "documents").collect()}
    assert got == counted(docs)
    least = {tuple(r) for r in trees.repeated_in_texts(df, least=4).select("digest", "size", "places", "documents").collect()}
    assert least == {x for x in got if x[1] > 3}
    assert trees.repeated_in_texts(df.limit(0)).count() == trees.repeated_in_texts(df.where("doc = 901")).count() == trees.repeated_in_texts(df.where("doc = 400"), least=400).count() == 0


def test_subtrees_of_elements_are_counted_as_their_digests_are(spark):
    text = "<a><p>one</p><q> <p>one</p></q><q><p>one</p> </q><p> two <b>x</b></p></a>"
    df = spark.createDataFrame([(1, text), (2, text), (3, text.replace("two", "2")), (4, "<a>"), (5, None), (None, text)], "doc int, text string")
    want = sorted(map(tuple, trees.repeated_subtrees(trees.digests(trees.tree_nodes(df, "xml"))).collect()))
    assert len(want) == 3 and sorted(map(tuple, trees.repeated_in_texts(df, "xml").collect())) == want


def test_fields_without_a_value_stay_in_orders(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 150, rng.choice([1, 1, 2, None]), rng.choice(["A", "R", None]), rng.choice(["F", None]), rng.choice([1.0, 25.0, None]), 7) for i in range(500)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
        for name in ("aligned_paths", "repeated_subtrees"):
            want = duck.execute(ORACLE_SQL[name])
            columns = [d[0] for d in want.description]
            assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(want.fetchall())
