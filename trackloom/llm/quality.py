"""Quality scores: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import common, tokens

#: Labelled rows that the trees are fitted on at most (those with the least hash of doc_id).
SAMPLE = 20_000
FEATURES = [
    "log_bytes", "log_words", "log_lines", "mean_word", "spread_word", "longest_word", "words_a_line", "letters", "upper", "digits",
    "commas_stops", "marks", "symbols", "bars", "dashes_slashes", "other_ascii", "beyond_ascii", "line_ends", "distinct_words",
    "most_frequent", "repeated_next", "title_words", "upper_words", "symbol_words", "short_words", "distinct_lines",
]
#: Byte classes: 0 white, 1 lower, 2 upper, 3 digit, 4 ,.  5 !?:;"'  6 @#$%&*^~`+=<>  7 |  8 -_/\  9 other ASCII, 10 beyond ASCII
CLASS = np.full(256, 10, np.uint8)
for _c in range(128):
    _s = chr(_c)
    CLASS[_c] = 0 if _s in " \t\n\v\f\r" else 1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 4 if _s in ",." else 5 if _s in "!?:;\"'" else 6 if _s in "@#$%&*^~`+=<>" else 7 if _s == "|" else 8 if _s in "-_/\\" else 9


def document_statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) for texts that stand end to end; empty texts are all zeros."""
    n, size = len(off) - 1, np.diff(off)
    out = np.zeros((n, len(FEATURES)), np.float64)
    if n == 0 or len(data) == 0:
        return out
    some = np.maximum(size, 1)
    kind = CLASS[data]
    byte_doc = np.repeat(np.arange(n), size)
    counts = np.bincount(byte_doc * 11 + kind, minlength=11 * n).reshape(n, 11)
    newline = data == 10
    newlines = np.bincount(byte_doc[newline], minlength=n)
    starts, ends = tokens.words(data, off)
    doc = np.searchsorted(off, starts, side="right") - 1
    words = np.bincount(doc, minlength=n)
    any_words, width = np.maximum(words, 1), (ends - starts).astype(float)
    mean = np.bincount(doc, width, n) / any_words
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(words), np.log1p(newlines)
    out[:, 3] = mean
    out[:, 4] = np.sqrt(np.maximum(np.bincount(doc, width**2, n) / any_words - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, width)
    out[:, 5], out[:, 6] = np.log1p(longest), words / (newlines + 1)
    out[:, 7] = (counts[:, 1] + counts[:, 2]) / some
    out[:, 8] = counts[:, 2] / np.maximum(counts[:, 1] + counts[:, 2], 1)
    for f, k in ((9, 3), (10, 4), (11, 5), (12, 6), (13, 7), (14, 8), (15, 9), (16, 10)):
        out[:, f] = counts[:, k] / some
    out[:, 17] = newlines / some
    prints = tokens.word_prints(data, starts, ends)
    order = np.lexsort((prints, doc))
    p, d = prints[order], doc[order]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])]) if len(p) else np.zeros(0, np.int64)
    run = np.diff(np.r_[first, len(p)]).astype(float)
    out[:, 18] = np.bincount(d[first], minlength=n) / any_words
    top = np.zeros(n)
    np.maximum.at(top, d[first], run)
    out[:, 19] = top / any_words
    if len(prints) > 1:
        again = (prints[1:] == prints[:-1]) & (doc[1:] == doc[:-1])
        out[:, 20] = np.bincount(doc[1:][again], minlength=n) / any_words
    head, tail = kind[starts], kind[ends - 1]
    # Running counts of upper-case letters give those within each word.
    uppers, lowers = np.r_[0, np.cumsum(kind == 2)], np.r_[0, np.cumsum(kind == 1)]
    up, low = uppers[ends] - uppers[starts], lowers[ends] - lowers[starts]
    for f, mask in ((21, (head == 2) & (low > 0)), (22, (up > 1) & (low == 0)), (23, (tail >= 6) & (tail <= 8)), (24, width <= 3)):
        out[:, f] = np.bincount(doc[mask], minlength=n) / any_words
    # Lines, by the fingerprints of their bytes.
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    edge[1:] |= newline
    begin = np.flatnonzero(edge[:-1])
    finish = np.r_[begin[1:], len(data)]
    filled = finish - begin > 1
    begin, finish = begin[filled], finish[filled]
    trimmed = finish - newline[finish - 1]
    lines = tokens.word_prints(data, begin, trimmed)
    line_doc = np.searchsorted(off, begin, side="right") - 1
    order = np.lexsort((lines, line_doc))
    l, d = lines[order], line_doc[order]
    fresh = np.r_[True, (l[1:] != l[:-1]) | (d[1:] != d[:-1])] if len(l) else np.zeros(0, bool)
    out[:, 25] = np.bincount(d[fresh], minlength=n) / np.maximum(np.bincount(line_doc, minlength=n), 1)
    out[size == 0] = 0
    return out


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself, so that `depth` steps end in one."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 64, least: int = 12, ridge: float = 1.0) -> Trees:
    """Boosting on the logistic loss; each feature is cut into quantile bins, and a level of a
    tree needs one histogram of gradients and one of curvatures for all its nodes."""
    n, m = x.shape
    if n == 0:
        return Trees(0.0, depth, *[np.zeros(0, int)] * 2, np.zeros(0), *[np.zeros(0, int)] * 2, np.zeros(0))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # x <= cuts[b] just if bin <= b
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    parts = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots, total = [], 0
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, left, right, value = [0], [0.0], [0], [0], [0.0]
        node, level = np.zeros(n, np.int64), [0]
        for d in range(depth + 1):
            place = {k: i for i, k in enumerate(level)}
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            rows = np.flatnonzero(slot[node] >= 0)
            own = slot[node[rows]]
            gs, hs, ns = (np.bincount(own, w, len(level)) for w in (g[rows], h[rows], np.ones(len(rows))))
            for k in level:
                value[k] = -rate * gs[place[k]] / (hs[place[k]] + ridge)
            if d == depth:
                break
            gain, pick = np.full(len(level), 1e-6), [None] * len(level)
            for f in range(m):
                key, width = own * bins + binned[rows, f], bins
                G, H, N = (np.bincount(key, w, len(level) * width).reshape(-1, width).cumsum(axis=1)[:, :-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                ok = (N >= least) & (ns[:, None] - N >= least)
                better = G**2 / (H + ridge) + (gs[:, None] - G) ** 2 / (hs[:, None] - H + ridge) - (gs**2 / (hs + ridge))[:, None]
                better = np.where(ok, better, -1)
                b = better.argmax(axis=1)
                for i in np.flatnonzero(better[np.arange(len(level)), b] > gain):
                    gain[i], pick[i] = better[i, b[i]], (f, int(b[i]))
            following = []
            for i, k in enumerate(level):
                if pick[i] is None:
                    continue
                f, b = pick[i]
                feature[k], threshold[k] = f, float(cuts[f][b])
                left[k], right[k] = len(feature), len(feature) + 1
                for _side in range(2):
                    feature.append(0)
                    threshold.append(0.0)
                    left.append(len(left))
                    right.append(len(right))
                    value.append(0.0)
                mine = rows[own == i]
                inside = binned[mine, f] <= b
                node[mine[inside]], node[mine[~inside]] = left[k], right[k]
                following += [left[k], right[k]]
            level = following
            if not level:
                break
        margin += np.asarray(value)[node]
        roots.append(total)
        for k, v in (("feature", feature), ("threshold", threshold), ("left", np.asarray(left) + total), ("right", np.asarray(right) + total), ("value", value)):
            parts[k].append(np.asarray(v))
        total += len(feature)
    flat = {k: np.concatenate(v) for k, v in parts.items()}
    return Trees(base, depth, np.asarray(roots), flat["feature"], flat["threshold"], flat["left"], flat["right"], flat["value"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, **options) -> Trees:
    """Trees fitted on at most `sample` labelled rows outside the held-out fold. Without any
    labels the trees are none and every score is 0.5."""
    known = common.pick(labels, doc_id="long", quality="int").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.where(common.crc_fold(folds=folds) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast

    def statistics(batches):
        for whole in batches:
            for b in common.slices(whole, "text", 1 << 20):
                x = document_statistics(*common.flat_text(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), b.column(2)], ["doc_id", "x", "quality"])

    rows = common.pick(docs, doc_id="long", text="string").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")
    rows = rows.mapInArrow(common.tidy(statistics), "doc_id long, x array<double>, quality int")
    # One row for each labelled id, so `sample` at most: of rows that share an id the one with the least statistics.
    got = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("least")).select("least.*").toArrow()
    if got.num_rows == 0:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = np.asarray(got.column("quality"), float)
    order = np.lexsort((y, *x.T))  # the same trees whatever order the rows come in
    return fit(x[order], y[order], **options)


def score_quality(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """docs with a column quality_score (0 to 1), which takes the place of one that they have.
    Null texts count as empty; each of repeated rows keeps its row; an empty table stays empty."""
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c != "quality_score"])
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", quality_score double"
    share = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, text, 1 << 20):
                x = document_statistics(*common.flat_text(b.column(b.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(share.value.score(x))], [*b.schema.names, "quality_score"])

    return docs.mapInArrow(common.tidy(run), schema)


def where_scored(docs: DataFrame, trees: Trees, threshold: float) -> DataFrame:
    """The rows of docs (any columns, one of them text) scored at the threshold or more."""
    share = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, "text", 1 << 20):
                x = document_statistics(*common.flat_text(b.column(b.schema.get_field_index("text"))))
                yield b.filter(pa.array(share.value.score(x) >= threshold))

    return docs.mapInArrow(common.tidy(run), docs.schema)


def op6_quality_trees(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(common.pick(docs, doc_id="long", text="string"), trees)
    return scored.select("doc_id", (common.crc_fold() == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
