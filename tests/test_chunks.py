"""The splittable text source against whole-file scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.sources import chunks

PATTERNS = {"term": "(?i)geheim|비밀", "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "five": r"(?<![0-9])[0-9]{5}(?![0-9])"}


def sample(rng, words):
    return "".join(rng.choice(words) + rng.choice(["", " ", "\n", ","]) for _ in range(900))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, root = random.Random(5), tmp_path_factory.mktemp("large")
    korean = ["가나다라", "비밀", "12345", "abz", "뷁", "ann@corp.de", "Z", "이름", "123456"]
    texts = {"utf8.txt": (sample(rng, [*korean, "Geheim", "\U0001f600", "ß"]), "utf-8"), "korean.txt": (sample(rng, korean), "cp949"), "line.txt": ("가" * 4000 + "비밀" + "나" * 4001, "cp949"), "ascii.txt": (sample(rng, ["geheim", "12345", "x@y.org"]), "utf-8")}
    for name, (text, codec) in texts.items():
        (root / name).write_bytes(text.encode(codec))
    (root / "broken.txt").write_bytes(b"geheim \xff\xff ann@corp.de \xc3 12345 \x81")
    (root / "empty.txt").write_bytes(b"")
    (root / ".hidden").write_bytes(b"geheim")
    texts["broken.txt"] = ("geheim  ann@corp.de  12345 ", "utf-8-lossy")
    return root, texts


@pytest.mark.parametrize("size, overlap", [(1, 64), (7, 64), (100, 64), (1013, 40), (1 << 20, 0)])
def test_matches_of_ranges_equal_a_scan_of_whole_files(spark, folder, size, overlap):
    root, texts = folder
    if size < 100:  # one small file is enough for many tiny ranges
        cut = {"korean.txt": texts["korean.txt"][0][:60], "utf8.txt": texts["utf8.txt"][0][:60]}
        path = root / f"small-{size}"
        path.mkdir()
        for name, text in cut.items():
            (path / name).write_bytes(text.encode(texts[name][1]))
        texts = {name: (text, texts[name][1]) for name, text in cut.items()}
    else:
        path = root
    rows = chunks.chunked_texts(spark, str(path), size, overlap)
    if size >= 100:
        rows = rows.where(~F.col("path").contains("small-"))
    name = F.element_at(F.split("path", "/"), -1)
    own = rows.select(name.alias("name"), "start", "codec", F.substr("text", F.col("first") + 1, F.col("last") - F.col("first")).alias("own")).collect()
    for n, (text, codec) in texts.items():
        assert "".join(r.own for r in sorted(own, key=lambda r: r.start) if r.name == n) == text, n
        assert {r.codec for r in own if r.name == n} == {codec}
    got = sorted(map(tuple, chunks.chunk_matches(rows, PATTERNS).select(name.alias("name"), "kind", "found").collect()))
    assert got == sorted((n, k, m.group()) for n, (text, _) in texts.items() for k, p in PATTERNS.items() for m in re.finditer(p, text))


def test_ranges_of_one_file_and_wrong_options(spark, folder):
    root, _ = folder
    assert chunks.chunked_texts(spark, f"file://{root}/ascii.txt", 1000).select("start").orderBy("start").first().start == 0
    with pytest.raises(Exception, match="chunkBytes"):
        chunks.chunked_texts(spark, str(root), 0).count()


def test_a_task_reads_many_small_ranges(tmp_path, monkeypatch):
    sizes = {"a.txt": 5000, "b.txt": 10, "c.txt": 70, "d.txt": 2048}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(b"x" * n)
    monkeypatch.setattr(chunks, "TASK_BYTES", 1 << 10)
    parts = [p.value for p in chunks._Reader({"path": str(tmp_path), "chunkbytes": "64"}).partitions()]
    assert len(parts) == 7 and all(a % 64 == 0 for part in parts for _, a, _ in part)
    assert sum(b - a for part in parts for _, a, b in part) == sum(sizes.values())
    rows = [batch for part in chunks._Reader({"path": str(tmp_path), "chunkbytes": "64"}).partitions() for batch in chunks._Reader({"chunkbytes": "64"}).read(part)]
    assert len(rows) == sum(-(-n // 64) for n in sizes.values())
