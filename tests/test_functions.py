import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import privacy, relational, reuse, state, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("code,ok", [("0306406152", True), ("0306406153", False), ("097522980X", True), ("abc", False)])
def test_isbn10(spark, code, ok):
    assert one(spark, T.valid_isbn10(F.col("c")), c=code) is ok


def test_scalars(spark):
    assert one(spark, T.fold(F.col("c")), c="Straße ÉT") == "strasse ét"
    assert one(spark, T.squeeze(F.col("c")), c="a　b c") == "abc"
    assert one(spark, T.number(F.col("c")), c="1,234.5") == 1234.5
    assert one(spark, T.number(F.col("c")), c="NaN") is None
    assert one(spark, T.written_ulp(F.col("c")), c="1.50") == pytest.approx(0.01)
    assert one(spark, T.written_ulp(F.col("c")), c="1.5e3") == pytest.approx(100)
    assert one(spark, T.canonical_url(F.col("c")), c="HTTP://Ex.Com/A?b#c") == "http://ex.com/A?b"
    assert one(spark, T.canonical_url(F.col("c")), c="mailto:x") is None
    assert one(spark, T.tokens(F.col("c")), c="가나 l'eau well-known _x_") == ["가나", "l'eau", "well-known", "x"]
    assert one(spark, T.lines(F.col("c")), c="a\r\nb c\x1cd") == ["a", "b", "c", "d"]
    assert one(spark, T.without_tags(F.col("c")), c="a[[FIG\nx]]b") == "a b"


def test_ordered_coverage(spark):
    df = spark.createDataFrame([(["a", "c", "x"], ["a", "b", "c"]), ([], ["a"])], "s array<string>, l array<string>")
    assert [r.x for r in df.select(T.ordered_coverage(F.col("s"), F.col("l")).alias("x")).collect()] == pytest.approx([2 / 3, 0])


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "One two. Three?\nfour", "s")], "doc_id long, text string, source string")
    assert {(r.ending, r.sentences) for r in text.ending_distribution(docs).collect()} == {("period", 1), ("question", 1), ("other", 1)}
    assert text.density(docs, "[!?]").count() == 2
    assert {(r.doc_id, r.exit_code) for r in privacy.rollup(docs, privacy.findings(docs, ["three"])).collect()} == {(1, 0), (2, 0), (3, 3)}
    assert reuse.repeated_texts(docs.limit(0)).count() == 0


def test_prose_tokens_skip_headings_and_short_lines(spark):
    docs = spark.createDataFrame([(1, "# a b c d e f g\n| a b c d e f |\na b\nu v w x y z")], "doc_id long, text string")
    assert text.prose_tokens(docs).first().tokens == list("uvwxyz")


def test_bands_find_all_close_values(spark):
    values = [(i, 100 * 1.0007**i) for i in range(200)]
    results = [(100 * 1.0011**i,) for i in range(100)]
    got = {r.id: r.backed for r in relational.backed(spark.createDataFrame(values, "id long, value double"), spark.createDataFrame(results, "result double"), 1e-4).collect()}
    assert got == {i: any(abs(v - r) <= 1e-4 * max(v, r) for (r,) in results) for i, v in values}


def test_state_of_one_user(spark):
    rows = [(1, "2024-01-01 00:00:00", 7, "error", 1.0), (2, "2024-01-01 00:10:00", 7, "view", 0.5), (3, "2024-01-01 01:00:00", 7, "view", 2.0)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert state.restarts(events).first().sessions == 2
    assert {r.event_id: r.blocked for r in state.blocked(events).collect()} == {1: False, 2: True, 3: True}
    assert sorted(r.n for r in state.sessions(events).collect()) == [1, 2]


def test_streams(spark, sf, tmp_path):
    from quillspark.streaming.events import latest_state, windowed

    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    q = latest_state(stream).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.user_id, r.event_id) for r in state.latest(events, 1).collect()}
    assert {(r.user_id, r.event_id) for r in spark.table("latest").collect()} == want
    q = windowed(stream, "1 hour").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = spark.table("windows").collect()
    whole = {tuple(r) for r in events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n").collect()}
    assert closed and {(r["starts"], r.event_type, r.n) for r in closed} <= whole


def test_user_paths_are_found(spark):
    from quillspark.operators import gates, privacy

    texts = ["see C:\\Users\\anna\\x.txt", "in /home/bert/x and\nC:\\Users\\me", "C:\\Users\\<user> only", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, privacy.user_paths(df).collect())) == [(0, 1, "anna"), (1, 1, "bert")]
    rules = spark.createDataFrame([("user_path",)], "rule string")
    assert gates.rule_states(rules, privacy.findings(df, [])).first().state == "hard"
    assert {r.doc_id: r.exit_code for r in privacy.rollup(df, privacy.findings(df, [])).collect()} == {0: 3, 1: 3, 2: 0, 3: 0}


def test_json_lines_without_repeats(spark, tmp_path):
    from quillspark.streaming.events import event_stream, json_lines, without_repeats

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"event_id": 1, "ts": "2024-01-01 00:00:00"}\nnot json\n{"event_id": 1, "ts": "2024-01-01 00:00:05"}\n{"event_id": 2, "ts": "2024-01-01 00:00:09", "more": 1}\n')
    stream = json_lines(spark, str(tmp_path / "in"), "event_id long, ts timestamp").where("event_id is not null")
    q = without_repeats(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    q = event_stream(spark, str(tmp_path / "out")).writeStream.format("memory").queryName("again").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("again").count() == 2
