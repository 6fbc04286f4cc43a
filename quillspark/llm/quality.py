"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of 64 words. Every passage is encoded; a gated attention network,
learned from the document labels alone, weighs them; the weighted representation is scored.
Nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.shared import materialize, temporary
from .batches import text_bytes, text_slices
from .chunked import _Hash, forget_encoder

PASSAGE_WORDS = 64
SAMPLE_DOCS = 4000  # labelled texts that the classifier is fitted on, at most
SAMPLE_PASSAGES = 1 << 18  # passages of those texts, at most: 54 MB in the driver; texts that don't fit are left out
THRESHOLD = 0.3
BIGRAMS = 32
HIDDEN, ATTENTION, EPOCHS, BATCH = 24, 16, 24, 64

#: Kinds of bytes that are counted: lower case, upper case, digits, marks of sentences, other marks one by one or together, line ends, the rest.
_KINDS = np.zeros(256, np.int64)
for _i, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:?", b"!", b"|", b"#$%&*@^~", b"\"'()-", b"<>[]{}=+_/\\`", b"\n", range(128, 256)), 1):
    _KINDS[list(_set)] = _i
KINDS = 12
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
FEATURES = KINDS + BIGRAMS + 7


class PassageEncoder:
    """Features of all passages of a slice of texts."""

    def __init__(self) -> None:
        self.hash = _Hash()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features, and the text that each passage is of; a text without words has one passage of zeros."""
        texts = len(offsets) - 1
        space = np.concatenate((_SPACE[data], [True]))
        before = np.concatenate(([True], space[:-1]))
        before[offsets[:-1]] = True
        start = np.flatnonzero(~space & before)
        stop = space.copy()
        stop[offsets[1:]] = True
        end = np.flatnonzero(stop[1:] & ~space[:-1]) + 1
        text = np.searchsorted(offsets, start, "right") - 1
        number = np.arange(len(start)) - np.searchsorted(text, text)
        first = np.flatnonzero(number % PASSAGE_WORDS == 0)
        owner = text[first]
        blank = np.setdiff1d(np.arange(texts), owner)
        out = np.zeros((len(first) + len(blank), FEATURES), np.float32)
        if len(first):
            n = np.diff(first, append=len(start)).astype(np.float32)
            passage = np.repeat(np.arange(len(first)), np.diff(first, append=len(start)))
            at = start[first]
            to = end[np.append(first[1:], len(start)) - 1]
            size = (to - at).astype(np.float32)
            inside = np.repeat(np.arange(len(first)), np.diff(at, append=len(data)))
            from_ = at[0]
            part = data[from_:].astype(np.int64)
            # bytes of the texts that follow aren't the last passage's, nor are pairs that reach into them
            left = offsets[owner + 1][inside] - np.arange(from_, len(data))
            own, both = left > 0, left[:-1] > 1
            out[: len(first), :KINDS] = np.bincount((inside * KINDS + _KINDS[part])[own], minlength=len(first) * KINDS).reshape(-1, KINDS) / size[:, None]
            pair = ((part[:-1] * 31 + part[1:]) * 0x9E3779B1 >> 11) % BIGRAMS
            out[: len(first), KINDS : KINDS + BIGRAMS] = np.bincount((inside[:-1] * BIGRAMS + pair)[both], minlength=len(first) * BIGRAMS).reshape(-1, BIGRAMS) / size[:, None]
            word = self.hash.ranges(data, start, end)
            length = (end - start).astype(np.float32)
            mean = np.bincount(passage, length, len(first)) / n
            column = KINDS + BIGRAMS
            out[: len(first), column] = mean / 10
            out[: len(first), column + 1] = np.sqrt(np.maximum(np.bincount(passage, length * length, len(first)) / n - mean * mean, 0)) / 10
            distinct = np.unique(word * np.uint64(0x9E3779B97F4A7C15) + passage.astype(np.uint64), return_index=True)[1]
            out[: len(first), column + 2] = np.bincount(passage[distinct], minlength=len(first)) / n
            same = np.zeros(len(start))
            same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
            out[: len(first), column + 3] = np.bincount(passage, same, len(first)) / n
            triple = word.copy()
            triple[1:] += np.where(text[1:] == text[:-1], word[:-1] * np.uint64(3), np.uint64(0))
            triple[2:] += np.where(text[2:] == text[:-2], word[:-2] * np.uint64(7), np.uint64(0))
            fresh = np.zeros(len(start))
            fresh[np.unique(triple * np.uint64(0x9E3779B97F4A7C15) + text.astype(np.uint64), return_index=True)[1]] = 1
            out[: len(first), column + 4] = np.bincount(passage, fresh, len(first)) / n
            capital = (data[start] >= 65) & (data[start] <= 90)
            out[: len(first), column + 5] = np.bincount(passage, capital, len(first)) / n
            out[: len(first), column + 6] = np.log1p(n) / 5
        owner = np.concatenate((owner, blank))
        order = np.argsort(owner, kind="stable")
        return out[order], owner[order]


@dataclass
class AttentionModel:
    """h = relu(x H + h0); weight = softmax over a text of w . (tanh(x V) * sigmoid(x U)); score = sigmoid(o . sum(weight h) + o0)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @staticmethod
    def _forward(p: dict, x: np.ndarray, text: np.ndarray, texts: int) -> dict:
        start = np.searchsorted(text, np.arange(texts))
        h = np.maximum(x @ p["H"] + p["h0"], 0)
        t, s = np.tanh(x @ p["V"]), 1 / (1 + np.exp(-(x @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, start)[text])
        a = e / np.add.reduceat(e, start)[text]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["o0"], -30, 30)))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "start": start}

    def score(self, x: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Of each text, between 0 and 1; every text has a passage, and passages are in the order of texts."""
        return self._forward(self.weights, (x - self.mean) / self.scale, text, texts)["y"] if texts else np.empty(0)

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> AttentionModel:
        """Adam on the log loss with a little weight decay. One label alone, or no bags, gives its constant score."""
        every = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
        mean, scale = every.mean(0).astype(np.float64), every.std(0).astype(np.float64) + 1e-3
        rng = np.random.default_rng(seed)
        near = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        share = (labels.sum() + 1) / (len(labels) + 2)
        p = {"H": near(FEATURES, HIDDEN), "h0": np.zeros(HIDDEN), "V": near(FEATURES, ATTENTION), "U": near(FEATURES, ATTENTION), "w": near(ATTENTION), "o": near(HIDDEN), "o0": np.array(np.log(share / (1 - share)))}
        if len(set(labels.tolist())) < 2:
            return cls(mean, scale, p | {"o": np.zeros(HIDDEN)})
        bags = [((b - mean) / scale) for b in bags]
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for epoch in range(EPOCHS):
            rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            order = rng.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                x, text = np.concatenate([bags[j] for j in some]), np.repeat(np.arange(len(some)), [len(bags[j]) for j in some])
                f = cls._forward(p, x, text, len(some))
                d = (f["y"] - labels[some]) / len(some)
                g = {"o": f["z"].T @ d, "o0": d.sum()}
                dz = d[:, None] * p["o"]
                da = (f["h"] * dz[text]).sum(1)
                de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["start"])[text])
                dh = f["a"][:, None] * dz[text] * (f["h"] > 0)
                g |= {"H": x.T @ dh, "h0": dh.sum(0), "w": (f["t"] * f["s"]).T @ de}
                dg = de[:, None] * p["w"]
                g |= {"V": x.T @ (dg * f["s"] * (1 - f["t"] ** 2)), "U": x.T @ (dg * f["t"] * f["s"] * (1 - f["s"]))}
                step += 1
                for k in p:
                    grad = g[k] + 1e-4 * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(mean, scale, p)


def held_out(doc_id) -> object:
    """Rows that no label is learned from: crc32 of the id as text is divisible by 5. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """Fit on all passages of at most SAMPLE_DOCS labelled texts, chosen by the hash of their id, without the held-out ones; of rows that repeat an id one is taken.

    In the order of the hashes a text is taken as long as SAMPLE_PASSAGES hold its passages too, so the driver's memory is bounded whatever the texts' length.

    `labels` has doc_id and quality (0 or 1; rows with another value, or a null, are left out; of a repeated doc_id the larger counts).
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        encoder = PassageEncoder()
        for part in text_slices(batches):
            x, owner = encoder(*text_bytes(part.column("text")))
            bags = [x[owner == i] for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([len(b) for b in bags], pa.int64()), pa.array([b.tobytes() for b in bags], pa.binary())], names=["doc_id", "quality", "size", "bag"])

    # the sample is at most SAMPLE_DOCS narrow rows, so it may go to every task
    one = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    texts = one.select("doc_id", "quality", "least.text")
    with temporary(docs.sparkSession):
        bags = materialize(texts.mapInArrow(run, "doc_id long, quality int, size long, bag binary"), "bags")
        left, chosen = SAMPLE_PASSAGES, []
        for r in bags.select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
            if r.size <= left:
                chosen.append((r.doc_id,))
                left -= r.size
        few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long"))
        rows = sorted((r.doc_id, r.bag, r.quality) for r in bags.drop("size").join(few, "doc_id").toLocalIterator())
    return AttentionModel.fit([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, b, _ in rows], np.array([q for *_, q in rows], np.float64))


def score(docs: DataFrame, model: AttentionModel, name: str = "quality_score") -> DataFrame:
    """All columns of `docs` and a column `name` (0 to 1), which replaces one of that name."""
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        encoder = PassageEncoder()
        for part in text_slices(batches):
            x, owner = encoder(*text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x, owner, part.num_rows), pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text; other columns are ignored).

    Null and empty texts are scored as a passage of zeros; repeated rows get equal scores; without labels the score is constant; an empty table gives no rows.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
