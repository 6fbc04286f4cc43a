"""The n-gram Jaccard join against SQL and brute force."""

import duckdb
import numpy as np
import pytest
from test_llm import EDGE, groups

from quillspark.llm import ngram_join, queries
from quillspark.llm.ngram_join import NgramJoin, jaccard_components
from quillspark.llm.neardup import Shingler


def found(df, p):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, p).collect())


def test_join_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.op11_ngram_join(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(f"select doc_id, n_shingles, component_id from ({queries.ORACLE_SQL['op11_ngram_join']})").fetchall())


def test_join_of_odd_rows(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, class_id string")
    got = {}
    for r in jaccard_components(df, NgramJoin(words=3, percent=90)).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert [got[i] for i in (1, 2, 3)] == [[(0, i)] for i in (1, 2, 3)]
    assert sorted(got[4]) == [(1, 4), (1, 4)] and got[7] == [(1, 4)] and got[6] == [(1, 6)] and got[None] == [(2, None)]
    empty = jaccard_components(df.limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "class_id"] and empty.collect() == []


def families(seed, sizes, words, edits, line):
    """Families of copies with edits, about the threshold; all texts share `line`."""
    rng, rows = np.random.default_rng(seed), []
    for f, size in enumerate(sizes):
        base = [f"f{f}-{i}" for i in range(words)]
        for _ in range(size):
            w = list(base)
            for at in rng.integers(0, words, rng.integers(0, edits)):
                w[at] = f"n{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join([*line, *w])))
    return rows


@pytest.mark.parametrize("block, frequent", [(256, 1 << 16), (16, 1 << 16), (16, 20)])
def test_join_of_families_about_the_threshold(spark, monkeypatch, block, frequent):
    rows = families(block, [150, 40, 3, 2, 1, 1], 150, 12, [f"line{i}" for i in range(12)])
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0 if block == 16 else 1 << 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = groups(rows, 1, 90)
    assert len({c for *_, c in want}) > 6  # some of a family's texts stay apart
    assert found(df, NgramJoin(words=1, percent=90)) == want
    assert found(df, NgramJoin(words=2, percent=70, fragments=3)) == groups(rows, 2, 70)


def test_join_of_long_texts_by_folded_bitmaps(spark):
    rng, base = np.random.default_rng(3), [f"w{i}" for i in range(1060)]
    rows = [(i, " ".join(base[: 1000 + rng.integers(0, 60)])) for i in range(20)]  # sizes about a power of two: bitmaps of two widths
    rows += [(20 + i, " ".join(base[200 * i :])) for i in range(4)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), NgramJoin(words=1, percent=90)) == groups(rows, 1, 90)


def test_bitmaps_never_rule_a_link_out():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, len(a) // 20).astype(np.uint64))))
        x, y = (np.frombuffer(ngram_join._bits(s).tobytes(), np.uint64)[None] for s in (a, b))
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_fragments_and_counts_of_the_order(spark):
    rows = [(i, "a b c d e f " + f"x{i} y{i} z{i}") for i in range(50)]
    counts = ngram_join._counts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 3, 2)
    order = ngram_join._order(counts.where("gram is not null").select("gram", "seen"))
    common, own = Shingler(3)("a b c d e f"), Shingler(3)("x1 y1 z1")
    assert order.counts(common).tolist() == [50] * 4 and order.counts(own).tolist() == [0]
    assert set(order.fragment(common, 8)) == {7} and order.fragment(own, 8)[0] < 7
    assert order.first(np.sort(np.concatenate((common, own))), 1).tolist() == own.tolist()


@pytest.mark.parametrize("parts, window", [(1, 1 << 21), (5, 2000)])
def test_sets_that_lack_too_much_of_the_first_fragment(spark, monkeypatch, parts, window):
    monkeypatch.setattr(ngram_join, "WINDOW", window)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40000)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 400))) for _ in range(60)]
    texts += [" ".join(t.split()[: -1 - i % 9] + ["x"] * (i % 4)) for i, t in enumerate(texts[:30])] + texts[:5] + ["", "one"]
    sets = {s.tobytes(): s for s in map(Shingler(1), texts) if len(s)}
    every, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    single = set(every[n == 1].tolist())
    want = set()
    for s in sets.values():
        lacking = sum(g in single and g < 1 << 62 for g in s.tolist())
        if 100 * lacking > 10 * len(s):
            want.add(ngram_join._digest(s.tobytes())[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.class_id for r in ngram_join._alone(ngram_join._counts(df, 1, parts), 90, parts).collect()}
    assert 10 < len(want) < len(sets) - 10 and got == want
