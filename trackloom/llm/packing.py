"""Best-fit packing of token pieces into sequences under several capacities at once.

A piece demands (tokens, 1 document, attention cost), so its length says it all, and lengths are
few: 1 to the capacity. The cost of attention within a piece is counted in tiles, ceil(length /
tile) squared; tile 1 is length squared. The packing is solved on the histogram of lengths (at
most `capacity` rows, whatever the input), longest first. Bins in the same state form a class
and are kept as runs of sequence numbers; a step gives one length to one class as a whole. The
classes are chosen by vector best fit: the least weighted norm of what would be left of every
capacity, or the largest weighted dot product of demand and residual. The outcome is a table of
rank ranges, "pieces of length L ranked a to b go m to a bin from bin s at offset o", which every
piece looks up by its rank among the pieces of its length. Nothing but the histogram reaches the
driver, and the result is the packing one machine would make.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm import common, tokens


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence and the weights of the three residuals. A limit that isn't set is
    left out of the state."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    rule: str = "norm"  # or "dot"
    tile: int = 1

    def limits(self) -> np.ndarray:
        return np.asarray([self.tokens, self.documents or 0, self.attention or 0], np.int64)

    def demand(self, length: int) -> np.ndarray:
        return np.asarray([length, 1, (-(-length // self.tile)) ** 2], np.int64)


#: Limits of the registered query and of the pipeline: 2048 tokens, 128 pieces (an entry each in
#: the table of a variable-length attention kernel), and 272 tiles of 128 by 128 tokens, 16 more
#: than one full piece has. Very short pieces bind the second, such ones beside a long one the third.
PRODUCTION = Capacity(2048, documents=128, attention=272, tile=128)


class Classes:
    """States that bins are in, in arrays, with the runs of bins in each."""

    def __init__(self):
        self.place: dict[tuple[int, int, int], int] = {}
        self.state, self.runs = np.zeros((64, 3), np.int64), []

    def add(self, state: np.ndarray, start: int, count: int) -> None:
        key = tuple(state.tolist())
        at = self.place.get(key)
        if at is None:
            at = self.place[key] = len(self.runs)
            if at == len(self.state):
                self.state = np.concatenate([self.state, np.zeros_like(self.state)])
            self.state[at] = state
            self.runs.append([])
        runs = self.runs[at]
        if runs and sum(runs[-1]) == start:
            runs[-1] = (runs[-1][0], runs[-1][1] + count)
        else:
            runs.append((start, count))

    def tidy(self, least: np.ndarray) -> None:
        """Without empty states and those in which nothing more fits; runs that touch are one."""
        alive = [i for i, r in enumerate(self.runs) if r and (self.state[i] >= least).all()]
        state, runs = self.state[alive], [self.runs[i] for i in alive]
        self.place, self.state, self.runs = {}, np.zeros((max(64, 2 * len(alive)), 3), np.int64), []
        for x, parts in zip(state, runs, strict=True):
            for start, count in sorted(parts):
                self.add(x, start, count)


def solve(histogram: dict[int, int], cap: Capacity) -> tuple[np.ndarray, int]:
    """(rows of length, rank from, rank to, first bin, pieces a bin, offset; number of bins)."""
    limits = cap.limits()
    on = limits > 0
    scale = np.where(on, limits, 1).astype(float)
    weight = np.asarray(cap.weights) * on
    classes, rows, bins = Classes(), [], 0
    shortest = cap.demand(min(histogram, default=1)) * on
    for step, length in enumerate(sorted(histogram, reverse=True)):
        left, rank = histogram[length], 0
        demand = cap.demand(length) * on
        if (demand > limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        if step % 16 == 0:
            classes.tidy(shortest)
        empty = np.asarray([not r for r in classes.runs], bool)
        while left:
            state = classes.state[: len(classes.runs)]
            empty = np.concatenate([empty, np.zeros(len(state) - len(empty), bool)])
            fits = (state >= demand).all(axis=1) & ~empty
            if fits.any():
                if cap.rule == "dot":
                    value = -((state / scale) * (demand / scale) * weight).sum(axis=1)
                else:
                    value = ((((state - demand) / scale) ** 2) * weight).sum(axis=1)
                at = int(np.where(fits, value, np.inf).argmin())
                free, runs = state[at].copy(), classes.runs[at]
                classes.runs[at] = []
                empty[at] = True
            else:
                at, free, runs = None, limits, [(bins, left)]  # as many as may be needed; the rest isn't opened
            each = int(min(f // d for f, d, o in zip(free, demand, on, strict=True) if o))
            offset = cap.tokens - int(free[0])
            for start, count in runs:
                full = min(count, left // each)
                if full:
                    rows.append((length, rank, rank + full * each, start, each, offset))
                    classes.add(free - each * demand, start, full)
                    rank, left = rank + full * each, left - full * each
                used = full
                if used < count and 0 < left < each:
                    rows.append((length, rank, rank + left, start + used, left, offset))
                    classes.add(free - left * demand, start + used, 1)
                    rank, left, used = rank + left, 0, used + 1
                if at is None:
                    bins += used
                elif used < count:
                    classes.runs[at].append((start + used, count - used))
                    empty[at] = False
    return np.asarray(rows, np.int64).reshape(-1, 6), bins


def tokenize_pieces(docs: DataFrame, vocabulary: str | None = None, separator: int = 0, most: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids as uint32 bytes).

    A null text counts as empty: its only id is the separator. Documents of more than `most` ids,
    of any length, are cut into pieces of `most`, the last of which may be shorter. Repeated rows
    each give their pieces; a null doc_id stays null; an empty table gives none. Extra columns
    aren't read.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches):
        enc = tokens.word_ids(vocabulary)
        for whole in batches:
            for b in common.slices(whole, "text", tokens.AT_ONCE):
                ids, at = enc.flat(*common.flat_text(b.column(1)))
                ids = np.insert(ids, at[1:], separator).astype("<u4")
                at = at + np.arange(len(at))
                n = -(-np.diff(at) // most)  # pieces of each document; every one has an id at least
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                begin = at[doc] + piece * most
                end = np.minimum(begin + most, at[doc + 1])
                parts = [ids[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                columns = [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * most), pa.array(end - begin), pa.array([tokens.crc_ids(x) for x in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.tobytes() for x in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return common.pick(docs, doc_id="long", text="string").mapInArrow(common.tidy(cut), schema)


def pack(pieces: DataFrame, cap: Capacity = PRODUCTION, group: int = 128) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    Ranks are counted within (length, salt); a length gets a salt for every `group` pieces, so
    a length that a third of all pieces share is many small groups, and so is the running count
    over its salts, which goes by blocks of 1,024 of them. Equal rows (repeated documents) get
    different places, in any order. No pieces: no rows.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # cap.tokens rows at most
    plan, _ = solve(histogram, cap)
    salts = spark.createDataFrame([(k, max(1, -(-n // group))) for k, n in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("block", F.expr("salt div 1024"))
    within = Window.partitionBy("length", "block").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("length", "block").agg(F.sum("n").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    before = counts.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, ["length", "block"])
    before = before.select("length", "salt", (F.col("own") + F.col("above")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("salt", "salts", "before")
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    share = spark.sparkContext.broadcast(plan)  # bounded by the lengths there can be
    columns = [c for c in pieces.columns]
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def place(batches):
        plan = share.value
        key = (plan[:, 0] << 48) | plan[:, 1]
        for b in batches:
            if b.num_rows == 0:
                continue
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            row = plan[np.searchsorted(key, (length << 48) | rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(common.tidy(place), schema)


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of all documents (tokenised once) with their sequences of PRODUCTION limits."""
    return pack(common.materialize(tokenize_pieces(docs), "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
