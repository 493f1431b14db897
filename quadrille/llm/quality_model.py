"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the texts are, one pass, and depend on the text alone. Trees are trained
on at most about ``max_rows`` labelled documents (default 40,000), chosen by a hash of their id, so
training costs the same at every size; everything else covers all rows. The trees are complete binary
trees flattened into arrays and traversed level by level with numpy for whole batches.

Defined results: null and empty texts have statistics of 0 and are scored like any other; without a
usable label every score is 0.5; with labels of one kind the score is their smoothed share; repeated
labels each count; repeated document rows each get their row; a row with a null id is not held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.llm.text import blobs, id_text, is_held_out, keep_rows, read_table, rows, slices

STATISTICS = (
    "log_words", "log_bytes", "mean_word", "distinct_words", "top_word", "adjacent_same", "distinct_pairs", "log_lines", "mean_line", "dup_lines", "upper", "digits", "punctuation", "symbols", "marks", "bars", "blanks", "wide", "controls", "entropy", "ends_in_stop", "short_words", "long_words", "longest_word",
)
CLASSES = {
    "upper": range(65, 91), "digits": range(48, 58), "punctuation": b".,;:'\"()-", "symbols": b"#*$%&<>@^~=+_{}[]\\/`", "marks": b"!?", "bars": b"|", "blanks": b" \t\n\r\x0b\x0c", "wide": range(128, 256), "controls": [*range(9), *range(14, 32), 127],
}
MEMBERS = np.array([[b in set(c) for b in range(256)] for c in CLASSES.values()], np.float64)


def statistics(text: bytes) -> list[float]:
    """One document's statistics in the order of STATISTICS."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0, np.log1p(size)] + [0.0] * (len(STATISTICS) - 2)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = dict(zip(CLASSES, (MEMBERS @ histogram / size).tolist()))
    p = histogram[histogram > 0] / size
    follow = list(zip(words, words[1:]))
    return [
        np.log1p(n), np.log1p(size), size / n, len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in follow) / n, len(set(follow)) / max(1, n - 1),
        np.log1p(len(lines)), np.log1p(size / len(lines)), 1 - len(set(lines)) / len(lines),
        shares["upper"], shares["digits"], shares["punctuation"], shares["symbols"], shares["marks"], shares["bars"], shares["blanks"], shares["wide"], shares["controls"],
        float(-(p * np.log2(p)).sum()), sum(x.rstrip()[-1:] in b".!?:" for x in lines) / len(lines), float((lengths <= 2).mean()), float((lengths > 15).mean()), np.log1p(int(lengths.max())),
    ]


def table_of(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(len(texts), len(STATISTICS))


@dataclass
class Trees:
    """Complete trees of one depth in arrays: node i of a tree has children 2i+1 and 2i+2."""

    bias: float
    features: np.ndarray  # (trees, 2**depth - 1)
    thresholds: np.ndarray  # the same; a value above goes right
    leaves: np.ndarray  # (trees, 2**depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, own = np.full(len(x), self.bias), np.arange(len(x))
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(len(leaves).bit_length() - 1):
                at = 2 * at + 1 + (x[own, features[at]] > thresholds[at])
            out += leaves[at - len(features)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 5.0, least: int = 10) -> Trees:
    """Boost trees on the logistic loss with gradient and curvature histograms."""
    n, width = x.shape
    inner, outer = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share))) if n else 0.0
    if not n or y.min() == y.max():
        return Trees(bias, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, outer)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    flat_bins = binned + np.arange(width) * bins
    raw = np.full(n, bias)
    all_features, all_thresholds, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, curvature = y - p, p * (1 - p)
        features, cuts, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            place = ((at - first)[:, None] * (width * bins) + flat_bins).ravel()
            shape = (nodes, width, bins)
            g, h, c = (np.bincount(place, weights=w, minlength=np.prod(shape)).reshape(shape).cumsum(axis=2) for w in (np.repeat(gradient, width), np.repeat(curvature, width), np.ones(n * width)))
            gt, ht, ct = g[..., -1:], h[..., -1:], c[..., -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(c < least) | (ct - c < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for node, i in enumerate(best.tolist()):
                f, b = divmod(i, bins)
                if gain[node, f, b] > 1e-9 and b < len(edges[f]):
                    features[first + node], cuts[first + node] = f, b
            at = 2 * at + 1 + (binned[np.arange(n), features[at]] > cuts[at])
        leaf = at - inner
        leaves = rate * np.bincount(leaf, gradient, outer) / (np.bincount(leaf, curvature, outer) + ridge)
        raw += leaves[leaf]
        all_features.append(features)
        all_thresholds.append([np.inf if np.isinf(b) else edges[f][int(b)] for f, b in zip(features, cuts)])
        all_leaves.append(leaves)
    return Trees(bias, np.array(all_features), np.array(all_thresholds), np.array(all_leaves))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from the labelled documents that are not held out, at most about ``max_rows`` of them."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("mark"))
    marked = marked.where(F.col("mark").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    n = marked.count()
    share = 1_000_000 * max_rows // max(n, 1)
    if share < 1_000_000:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield rows(schema, batch.column("doc_id"), batch.column("mark"), table_of(blobs(batch, "text")).tolist())

    # The labels are bounded by max_rows, and so is what comes back.
    found = id_text(docs, id_col, text_col).join(F.broadcast(marked), "doc_id").select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark int, x array<double>")
    table = found.toArrow()
    x = np.asarray(table.column("x").combine_chunks().flatten()).reshape(table.num_rows, len(STATISTICS))
    mark = table.column("mark").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, mark, table.column("doc_id").to_numpy()))  # repeated ids too come in one order, so sums do not vary
    return fit(x[order], mark[order])


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield rows(schema, batch.column("doc_id"), sent.value.scores(table_of(blobs(batch, "text"))))

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, trees: Trees, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, whose text scores ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    return keep_rows(docs, text_col, lambda: lambda texts: (sent.value.scores(table_of(texts)) >= least).tolist())


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
