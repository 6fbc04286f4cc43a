"""Deep merge of layers as rows against the recursive merge."""

import json
import random

from quillspark.operators import packs


def deep(base, over):
    if isinstance(base, dict) and isinstance(over, dict):
        return {**base, **{k: deep(base[k], v) if k in base else v for k, v in over.items()}}
    return over


def tree(rng, depth=0):
    if depth < 4 and rng.random() < 0.75 - 0.1 * depth:
        return {rng.choice(["a", "b", "c/d", "~e", "", "f~1"]): tree(rng, depth + 1) for _ in range(rng.randrange(4))}
    return rng.choice([1, "x", None, True, [1, {"a": 2}], [], 2.5, "한"])


def test_merge_equals_the_recursive_one(spark):
    rng, rows, want = random.Random(2), [], {}
    for key in range(150):
        layers = [tree(rng) for _ in range(rng.randrange(1, 6))]
        rows += [(key, i, json.dumps(x)) for i, x in enumerate(layers)]
        for x in layers:
            want[key] = deep(want[key], x) if key in want else x
    rng.shuffle(rows)
    rows += rows[:20] + [(3, 99, None), (4, 99, "{broken"), (5, 99, '{"a": NaN}')]  # repeated, null and invalid layers
    df = spark.createDataFrame(rows, "key int, priority int, text string").repartition(4)
    nodes = packs.flattened(df)
    assert nodes.where("kind = 'invalid'").count() == 2
    got = {r.key: json.loads(r.text) for r in packs.rebuilt(packs.merged(nodes)).collect()}
    assert got == want
    assert packs.merged(packs.flattened(df.limit(0))).count() == 0


def test_conflicts_are_told(spark):
    rows = [(1, 1, '{"a":{"x":1},"b":1}'), (1, 2, '{"a":5,"b":2}'), (1, 3, '{"a":{"y":1},"b":2}')]
    got = packs.merged(packs.flattened(spark.createDataFrame(rows, "key int, priority int, text string")))
    assert sorted((r.path, r.value, r.priority, r.given) for r in got.collect()) == [("/a/y", "1", 3, 1), ("/b", "2", 3, 2)]


def test_a_fold_of_layers_equals_the_merge_of_nodes(spark):
    rng = random.Random(3)
    rows = [(key, rng.randrange(4), json.dumps(tree(rng))) for key in range(100) for _ in range(5)]
    df = spark.createDataFrame([*rows, *rows[:9], (3, 9, "{broken"), (4, 9, None)], "key int, priority int, text string").repartition(3)
    assert sorted(map(tuple, packs.merged_layers(df).collect())) == sorted(map(tuple, packs.merged(packs.flattened(df)).collect()))


def test_layers_are_shuffled_once_and_as_texts(spark, capsys):
    rows = [(1, None, '{"a":{"x":1},"a!":{"z":{}}}'), (1, 2, '{"a":5,"b":{"c":{}}}'), (1, 3, '{"a":{"y":{"v":1}}}'), (1, 4, '{"a":{"y":7}}'), (2, 1, "{}"), (3, 1, "[]"), (None, 1, '{"a":{}}')]
    merged = packs.merged_layers(spark.createDataFrame(rows, "key int, priority int, text string"))
    got = sorted(map(str, ((r.key, r.path, r.value, r.priority, r.given) for r in merged.collect())))
    assert got == sorted(map(str, [(1, "/a/y", "7", 4, 1), (1, "/a!/z", "{}", None, 0), (1, "/b/c", "{}", 2, 0), (2, "", "{}", 1, 0), (3, "", "[]", 1, 1), (None, "/a", "{}", 1, 0)]))
    merged.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan
