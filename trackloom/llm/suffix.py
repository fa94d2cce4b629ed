"""Removal of long repeats with a logarithmic family of suffix arrays.

A byte goes if a `length`-byte string (50), a window, covers it that also starts in a document
with a smaller doc_id. The documents stand in ascending doc_id order and are cut into batches.

A batch's windows are dealt to buckets in segments. A window is represented by the least hash
of its 24-byte strings; neighbouring windows with one representative are one segment, a
stretch of text of `length` - 1 bytes more than it has windows. Equal windows have equal
representatives, so they meet in one bucket, and what is sent there is their text, each
different segment once by each batch.

In each bucket the batches arrive in order. Some of them at a time get a suffix array: the
positions of their windows in the order of the bytes that begin there, cut at `length` as no
more can matter. It is merge-scanned against the levels of the family, each the suffix array
of all windows of a run of earlier batches without those that came before; a window that
stands in a level with a smaller doc_id is a repeat. What no level has becomes the lowest
level; levels of equal size are merged, so there are never more of them than the logarithm of
the batches. Strings are compared as bytes, never by hashes alone. Answers come back as one bit
for each window that was sent.

`remove_repeats` knows all documents, so it first asks for which representatives stand in two
batches at all (4 bytes for one position in 14 or so) and sends no other windows. Windows of
representatives that very many batches have go one by one, dealt by their own hashes, so that
what surrounds a common line doesn't meet in one bucket. `SuffixIndex` keeps the family in a
folder and takes batches as they come; it can leave out no window.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import common, tokens

GRAM = 24
#: Bytes of text in a batch at least, and in a partition (about).
BATCH, EACH = 1 << 20, 24 << 20
#: Windows that get a suffix array at once, at least, and windows in a stored row at most.
TURN, ROW = 1 << 16, 1 << 20
#: Batches that may have a representative before its windows go one by one; windows in a segment at most.
HOT, LONGEST = 64, 64
_rng = np.random.default_rng(20)
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
FINISH = np.uint64(0xD6E8FEB86659FD93)


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * FINISH
    return x ^ (x >> np.uint64(32))


def running(data: np.ndarray) -> np.ndarray:
    """Running sums that give the fingerprint of any stretch of data by `gram`."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * tokens.powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def gram(total: np.ndarray, k: int) -> np.ndarray:
    """A well mixed 64-bit fingerprint of the k bytes that begin at each place."""
    down = tokens.powers(len(total))[1]
    return finish((total[k:] - total[:-k]) * down[: len(total) - k])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, width = x, 1
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = w - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def strings(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The `length` bytes at each place, as one column that compares byte by byte."""
    return np.lib.stride_tricks.sliding_window_view(data, length)[at].view(f"S{length}").ravel()


def suffix_array(data: np.ndarray, at: np.ndarray, length: int):
    """(order, strings in order, whether each differs from the one before) of the places."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, f"S{length}"), np.zeros(0, bool)
    found = strings(data, at, length)
    order = np.argsort(found, kind="stable")
    found = found[order]
    return order, found, np.r_[True, found[1:] != found[:-1]]


def spread(first: np.ndarray, span: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (span[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(span) - span), span) + np.arange(span.sum())


class Batch:
    """The documents of a batch end to end, and which windows lie within one document."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, length: int):
        self.ids, self.data, self.length = ids, data, length
        self.off = np.concatenate([[0], np.cumsum(sizes)])
        n = max(0, len(data) - length + 1)
        self.valid = np.ones(n, bool)
        cut = (self.off[1:-1, None] - np.arange(1, length)[None, :]).ravel()
        self.valid[cut[(cut >= 0) & (cut < n)]] = False
        self.runs = None
        # Rank of each document's id; equal ids have one rank.
        self.rank = np.cumsum(np.r_[0, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)

    def minima(self, size: int = 1 << 16):
        """(first window, value, last window + 1, document) of the runs of windows of one document
        with one representative, without those that reach over a document's end. Kept."""
        if self.runs is None:
            found = []
            doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.off))
            for s in range(0, len(self.valid), size):
                e = min(s + size, len(self.valid))
                good = self.valid[s:e]
                if not good.any():
                    continue
                m = sliding_min(gram(running(self.data[s : e + self.length - 1]), GRAM), self.length - GRAM + 1)
                new = np.ones(e - s, bool)
                new[1:] = (m[1:] != m[:-1]) | (doc[s + 1 : e] != doc[s : e - 1]) | (good[1:] != good[:-1])
                first = np.flatnonzero(new)
                last = np.r_[first[1:], e - s]
                on = good[first]
                # Least hashes are small numbers; mixed again they fill all buckets alike.
                found.append((first[on] + s, finish(m[first[on]]), last[on] + s, doc[first[on] + s]))
            none = np.zeros(0, np.int64)
            self.runs = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none.astype(np.uint64), none, none.astype(np.int32))
        return self.runs

    def representatives(self, shift: int):
        """(representative, whether two documents here have it) of all windows, ascending."""
        _, value, _, doc = self.minima()
        value, rank = value >> np.uint64(shift), self.rank[doc]
        order = np.argsort(value)
        value, rank = value[order], rank[order]
        if not len(value):
            return value, np.zeros(0, bool)
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        return value[first], np.minimum.reduceat(rank, first) != np.maximum.reduceat(rank, first)

    def segments(self, reps: np.ndarray, keep: np.ndarray, hot: np.ndarray, shift: int, low: int) -> dict:
        """The different segments of the runs to be kept, in the order of their buckets (what is
        above bit `low`), and where each run's windows are among theirs."""
        first, value, last, doc = self.minima()
        place = np.searchsorted(reps, value >> np.uint64(shift))
        on = keep[place]
        first, value, last, doc, alone = first[on], value[on], last[on], doc[on], hot[place[on]]
        # Longer runs in pieces, hot ones window by window.
        most = np.where(alone, 1, LONGEST)
        pieces = -(-(last - first) // most)
        nth = spread(np.zeros(len(first), np.int64), pieces)
        of = np.repeat(np.arange(len(first)), pieces)
        a = first[of] + nth * most[of]
        n = np.minimum(last[of] - a, most[of])
        key = value[of]
        one = np.flatnonzero(alone[of])
        for k in range(0, len(one), 1 << 16):
            part = one[k : k + (1 << 16)]
            text = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[a[part]]
            key[part] = finish((BYTE[text] * tokens.powers(self.length)[0][: self.length]).sum(axis=1, dtype=np.uint64))
        raw, known = self.data.tobytes(), {}
        begin = a.tolist()
        mine = np.asarray([known.setdefault(raw[x:y], len(known)) for x, y in zip(begin, (a + n + self.length - 1).tolist(), strict=True)], np.int64)
        _, lead = np.unique(mine, return_index=True)  # the first of equal segments has the least id
        bucket = (key[lead] >> np.uint64(low)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        lead = lead[order]
        text = list(known)
        return {
            "at": a, "n": n, "of": back[mine], "bucket": bucket[order], "width": n[lead],
            "ids": self.ids[doc[of[lead]]], "text": [text[i] for i in order.tolist()],
        }

    def repeats(self, reps: np.ndarray, local: np.ndarray, shift: int) -> np.ndarray:
        """The windows that also start in a document of this batch with a smaller id, by the
        batch's own suffix array; windows of one representative are sorted together."""
        first, value, last, doc = self.minima()
        place = np.searchsorted(reps, value >> np.uint64(shift))
        on = np.flatnonzero(local[place])
        on = on[np.argsort(place[on], kind="stable")]
        if not len(on):
            return np.zeros(0, np.int64)
        span, place = last[on] - first[on], place[on]
        new = np.r_[True, place[1:] != place[:-1]]
        turn = ((np.cumsum(span) - span) // (1 << 18))[np.flatnonzero(new)][np.cumsum(new) - 1]
        edges = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1], True])
        found = []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            here = spread(first[on[x:y]], span[x:y])
            rank = np.repeat(self.rank[doc[on[x:y]]], span[x:y])
            order, _, new = suffix_array(self.data, here, self.length)
            rank = rank[order]
            least = np.minimum.reduceat(rank, np.flatnonzero(new))
            found.append(here[order[rank > least[np.cumsum(new) - 1]]])
        return np.concatenate(found)


class Family:
    """Levels of geometrically falling sizes: (strings, ascending and different; the least id of
    each; numbers of the stored levels that went into it)."""

    def __init__(self, levels=()):
        self.levels = list(levels)

    def scan(self, found: np.ndarray) -> np.ndarray:
        """Place of the id of each of the ascending strings: the least id of a level that has it
        (the oldest level comes first), or -1 where none has it; with which ones are known."""
        known, owner = np.zeros(len(found), bool), np.zeros(len(found), np.int64)
        for level, ids, _ in self.levels:
            order = np.argsort(np.concatenate([level, found]), kind="stable")  # a merge of two runs; equal strings of the level first
            right = order[1:] >= len(level)
            right &= order[:-1] < len(level)
            pairs = np.flatnonzero(right)
            old, new = order[pairs], order[pairs + 1] - len(level)
            same = (level[old] == found[new]) & ~known[new]
            known[new[same]], owner[new[same]] = True, ids[old[same]]
        return known, owner

    def add(self, found: np.ndarray, ids: np.ndarray) -> None:
        """Ascending strings that no level has."""
        if not len(found):
            return
        self.levels.append((found, ids, []))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (y, b, q), (x, a, p) = self.levels.pop(), self.levels.pop()
            both = np.concatenate([x, y])
            order = np.argsort(both, kind="stable")
            self.levels.append((both[order], np.concatenate([a, b])[order], p + q))


SENT = "bucket int, batch long, n int, blob binary"
ANSWERS = "batch long, kind int, bucket int, blob binary"
LEVELS = "bucket int, level long, part int, replaces array<long>, ids binary, strings binary"
#: How a null doc_id stands in a batch: before all others, as the least long does.
NULL = -(1 << 63)


def batches_of(docs: DataFrame, table: str, parts: int, length: int, most: int) -> DataFrame:
    """Store the documents as batches in ascending doc_id order, bucketed by batch, so that
    answers can be joined to them without moving the texts again. A text that also stands as a
    whole (by its SHA-256) at a smaller doc_id is stored as its length alone: all its suffixes
    are repeats, and as any of them starts at that smaller doc_id too, nothing else needs it."""
    docs = docs.withColumn("print", F.when(F.length(F.col("text").cast("binary")) >= length, F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    by = [F.col("doc_id").asc_nulls_first(), F.col("print").asc_nulls_first()]
    # Rows that say which texts also stand at a smaller doc_id come right before them.
    prints = common.materialize(docs.where("print is not null").select("doc_id", "print"), "prints")
    # Written, so that the join is one of plain scans and a print with a third of all rows can be split.
    least = common.materialize(prints.groupBy("print").agg(F.min(F.coalesce("doc_id", F.lit(NULL))).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    copies = prints.join(least, "print").where("coalesce(doc_id, least) > least").select("doc_id", "print", F.lit(0).alias("kind"))
    docs = docs.withColumn("kind", F.lit(1)).unionByName(copies, allowMissingColumns=True).repartitionByRange(parts, *by).sortWithinPartitions(*by, "kind")
    carried = docs.schema["carry"].dataType.simpleString()
    names = ["batch", "nth", "doc_id", "copied", "carry", "data"]

    def cut(rows):
        part, number, nth, held, of = TaskContext.get().partitionId(), 0, 0, 0, None
        for whole in rows:
            whole = whole.select(["doc_id", "text", "carry", "print", "kind"])
            for b in common.slices(whole, "text", 1 << 20):
                sizes = np.diff(common.flat_text(b.column(1))[1]).tolist()
                out = []
                for i, (d, p, kind, n) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), sizes, strict=True)):
                    if not kind:
                        of = (d, p)
                        continue
                    copy = p is not None and of == (d, p)
                    if nth and held + (0 if copy else n) > most:
                        number, nth, held = number + 1, 0, 0
                    out.append((i, (part << 32) + number, nth, n if copy else -1))
                    nth, held = nth + 1, held + (0 if copy else n)
                if out:
                    i, batch, order, copied = (np.asarray(x) for x in zip(*out, strict=True))
                    mine = b.take(pa.array(i))
                    data = pc.if_else(pa.array(copied >= 0), pa.scalar(b"", pa.binary()), mine.column(1).cast(pa.binary()).fill_null(b""))
                    yield pa.RecordBatch.from_arrays([pa.array(batch, pa.int64()), pa.array(order, pa.int32()), mine.column(0), pa.array(copied, pa.int64()), mine.column(2), data], names)

    schema = f"batch long, nth int, doc_id long, copied long, carry {carried}, data binary"
    docs.mapInArrow(common.tidy(cut), schema).write.option("compression", "zstd").bucketBy(parts, "batch").saveAsTable(table, format="parquet")
    return docs.sparkSession.table(table)


def _opened(table: pa.Table, length: int) -> tuple[Batch, pa.Table]:
    """The batch that the rows of a group make, and these rows in their order."""
    tokens.forget()  # workers outlive stages
    table = table.take(pa.array(np.argsort(table.column("nth").to_numpy()))).combine_chunks()
    data, off = common.flat_text(table.column("data"))
    ids = np.asarray(table.column("doc_id").combine_chunks().fill_null(NULL))
    return Batch(ids, np.diff(off), data, length), table


def _bits(answers: pa.Table, kind: int, keys: np.ndarray, low: int) -> np.ndarray:
    """The answers for keys in the order of their buckets (what is above bit `low`), from packed
    bits for each bucket; none for a bucket: all are off."""
    out = np.zeros(len(keys), bool)
    rows = [r for r in answers.select(["kind", "bucket", "blob"]).to_pylist() if r["kind"] == kind]
    edge = np.searchsorted(keys >> np.uint64(low), np.asarray([[r["bucket"], r["bucket"] + 1] for r in rows], np.uint64).reshape(-1, 2))
    for r, (a, b) in zip(rows, edge.tolist(), strict=True):
        out[a:b] = np.unpackbits(np.frombuffer(r["blob"], np.uint8), count=b - a).astype(bool)
    return out


def _cells(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of equal buckets."""
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    return edge[:-1], edge[1:]


def _sent(batch: int, bucket: np.ndarray, n: np.ndarray, blobs: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "batch": pa.array(np.full(len(bucket), batch), pa.int64()), "n": pa.array(n, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _asked(batch: int, s: dict) -> pa.Table:
    """Segments as one blob for each bucket: widths, ids, texts."""
    first, end = _cells(s["bucket"])
    width, ids = s["width"].astype("<u4"), s["ids"].astype("<i8")
    blobs = [b"".join([width[a:b].tobytes(), ids[a:b].tobytes(), *s["text"][a:b]]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]
    return _sent(batch, s["bucket"][first], end - first, blobs)


def _answers(batch, bucket: int, kind: int, bits) -> pa.Table:
    n = len(batch)
    return pa.table({"batch": pa.array(batch, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "blob": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _scanned(rows: pa.Table, family: Family, length: int) -> pa.Table:
    """Answers for the segments of a bucket's batches; they are added to the family."""
    rows = rows.take(pa.array(np.argsort(rows.column("batch").to_numpy()))).combine_chunks()
    counts, sizes = rows.column("n").to_numpy(), np.diff(common.flat_text(rows.column("blob"))[1])
    windows = sizes - counts * (11 + length)  # 12 bytes and length - 1 more for each segment
    least = max(TURN, int(windows.sum()) // 16)
    turns = (np.cumsum(windows) - windows) // least
    bits = []
    for turn in np.unique(turns).tolist():
        mine = np.flatnonzero(turns == turn)
        blobs = [rows.column("blob")[i].as_buffer() for i in mine.tolist()]
        n = counts[mine].tolist()
        width = np.concatenate([np.frombuffer(x, "<u4", k) for x, k in zip(blobs, n, strict=True)]).astype(np.int64)
        own = np.repeat(np.concatenate([np.frombuffer(x, "<i8", k, 4 * k) for x, k in zip(blobs, n, strict=True)]), width)
        data = np.concatenate([np.frombuffer(x, np.uint8, -1, 12 * k) for x, k in zip(blobs, n, strict=True)])
        size = width + length - 1
        order, found, new = suffix_array(data, spread(np.cumsum(size) - size, width), length)
        first = np.flatnonzero(new)
        found, own = found[first], own[order]
        ids = np.minimum.reduceat(own, first)
        known, owner = family.scan(found)
        owner = np.where(known, np.minimum(owner, ids), ids)
        hit = np.empty(len(order), bool)
        hit[order] = own > owner[np.cumsum(new) - 1]
        family.add(found[~known], ids[~known])
        bits += np.split(hit, np.cumsum(windows[mine])[:-1])
    return _answers(rows.column("batch").to_numpy(), rows.column("bucket")[0].as_py(), 2, bits)


def _cut(batch: Batch, rows: pa.Table, repeat: np.ndarray, as_text: bool) -> pa.Table:
    """The documents of a batch without the bytes that the windows cover."""
    n = len(batch.data)
    edge = np.zeros(n + 1, np.int8)
    edge[repeat] += 1  # a window starts at one place, so no index comes twice
    edge[repeat + batch.length] -= 1
    gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
    new = gone & ~np.r_[False, gone[:-1]]
    begins = batch.off[:-1]
    begins = begins[begins < n]
    new[begins] = gone[begins]
    start = np.flatnonzero(new)
    stops = gone & ~np.r_[gone[1:], False]
    last = batch.off[1:][batch.off[1:] > 0] - 1
    stops[last] = gone[last]
    stop = np.flatnonzero(stops) + 1
    total = np.r_[0, np.cumsum(gone)]
    removed = total[batch.off[1:]] - total[batch.off[:-1]]
    cuts = np.searchsorted(start, batch.off)
    copied = rows.column("copied").to_numpy()
    whole = copied >= 0
    raw, kept_off = batch.data[~gone].tobytes(), batch.off - total[batch.off]
    spans = [(start[a:b] - o, stop[a:b] - o) if c < 0 else ([0], [c]) for a, b, o, c in zip(cuts[:-1], cuts[1:], batch.off[:-1], copied.tolist(), strict=True)]
    kept = [raw[a:b].decode("utf-8", "ignore") if as_text else raw[a:b] for a, b in zip(kept_off[:-1], kept_off[1:], strict=True)]
    return pa.table(
        {
            "doc_id": rows.column("doc_id"),
            "carry": rows.column("carry"),
            "n_bytes": pa.array(np.where(whole, copied, np.diff(batch.off))),
            "n_removed": pa.array(np.where(whole, copied, removed)),
            "n_spans": pa.array(np.where(whole, 1, np.diff(cuts))),
            "starts": pa.array([a for a, _ in spans], pa.list_(pa.int64())),
            "ends": pa.array([b for _, b in spans], pa.list_(pa.int64())),
            "kept": pa.array(kept, pa.string() if as_text else pa.binary()),
        }
    )


class _Run:
    """The steps that both forms share: batches of documents, questions, answers, the cut."""

    def __init__(self, docs: DataFrame, length: int, as_text: bool):
        if length <= GRAM:
            raise ValueError(f"length must exceed {GRAM}")
        self.spark, self.length, self.as_text = docs.sparkSession, length, as_text
        carry = F.col("carry") if "carry" in docs.columns else F.lit(None).cast("string")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carry.alias("carry"))
        self.size = self.docs.select(F.sum(F.length(F.col("text").cast("binary")))).first()[0] or 0
        self.parts = common.partitions_for(self.spark, self.size, EACH)
        # Buckets of 4 MB or so, up to 16 MB for larger inputs. A batch sends a blob to each
        # bucket, so batches grow as well, for blobs of 100 bytes or so, up to 64 MB.
        self.bucket = min(16 << 20, max(4 << 20, int((4 << 20) * (self.size / (1 << 30)) ** 0.5)))
        self.most = max(BATCH, min(64 << 20, int(100 * self.size / self.bucket)))

    def stored(self, table: str | None = None) -> DataFrame:
        self.batches = batches_of(self.docs, table or new_table(self.spark), self.parts, self.length, self.most)
        common.forget_shuffles(self.spark)
        return self.batches

    def result(self, answers: DataFrame, shift: int, low: int, every: bool) -> DataFrame:
        length, as_text = self.length, self.as_text

        def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
            batch, rows = _opened(rows, length)
            reps, local = batch.representatives(shift)
            keep = np.ones(len(reps), bool) if every else _bits(answers, 1, reps, 32)
            s = batch.segments(reps, keep, np.zeros(len(reps), bool) if every else _bits(answers, 3, reps, 32), shift, low)
            # One bit for each window sent, in the order of the segments.
            width = s["width"]
            owner = np.repeat(s["bucket"], width).astype(np.uint64)
            hit = _bits(answers, 2, owner, 0)
            found = spread(s["at"], s["n"])[hit[spread((np.cumsum(width) - width)[s["of"]], s["n"])]]
            gone = np.zeros(max(0, len(batch.data)), bool)
            gone[found] = True
            gone[batch.repeats(reps, local, shift)] = True
            return _cut(batch, rows, np.flatnonzero(gone), as_text)

        kind = self.batches.schema["carry"].dataType.simpleString()
        out = f"doc_id long, carry {kind}, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept {'string' if as_text else 'binary'}"
        return self.batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(common.tidy_tables(cut), out)


def remove_repeats(docs: DataFrame, length: int = 50, as_text: bool = False, table: str | None = None) -> DataFrame:
    """docs (doc_id, text[, carry]) -> doc_id, carry, n_bytes, n_removed, n_spans, starts and
    ends (of the removed runs, in bytes), kept (the remaining bytes; as_text: a string of the
    characters of which no byte was removed).

    Null and empty texts have nothing to remove; texts may be of any length. Rows that share a
    doc_id don't remove each other's bytes (none is smaller), be they equal or not, and may
    stand in several batches. A null doc_id comes before all others. An empty table gives
    none. Extra columns aren't read, but `carry` (of any type) comes through. The result reads a
    table of batches (its name: `table`, or one of its own), to be dropped once the result has
    been written; `drop_batches` drops all that this application has made.
    """
    run = _Run(docs, length, as_text)
    # Powers of two, as the top bits name the bucket.
    b1 = max(4, int(np.ceil(np.log2(max(1, run.size / 14 * 4 / run.bucket)))))
    b2 = max(8, int(np.ceil(np.log2(max(1, run.size * 1.2 / run.bucket)))))
    shift, low = 64 - b1 - 32, 64 - b2  # representatives keep 32 bits beside those of the bucket
    batches = run.stored(table)

    def first_round(rows: pa.Table) -> pa.Table:
        reps, _ = _opened(rows, length)[0].representatives(shift)
        bucket = (reps >> np.uint64(32)).astype(np.int64)
        first, end = _cells(bucket)
        raw = reps.astype("<u4")
        return _sent(rows.column("batch")[0].as_py(), bucket[first], end - first, [raw[a:b].tobytes() for a, b in zip(first.tolist(), end.tolist(), strict=True)])

    def shared(rows: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), "<u4") for x in rows.column("blob").combine_chunks()]
        keys = np.concatenate(blobs)
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[order][1:] != keys[order][:-1]]
        count = np.diff(np.r_[np.flatnonzero(new), len(keys)])
        times = np.empty(len(keys), np.int64)
        times[order] = count[np.cumsum(new) - 1]  # batches that have it
        times = np.split(times, np.cumsum([len(x) for x in blobs])[:-1])
        batch, bucket = rows.column("batch").to_numpy(), rows.column("bucket")[0].as_py()
        hot = [i for i, x in enumerate(times) if (x > HOT).any()]
        return pa.concat_tables([_answers(batch, bucket, 1, [x > 1 for x in times]), _answers(batch[hot], bucket, 3, [times[i] > HOT for i in hot])])

    asked = batches.groupBy("batch").applyInArrow(common.tidy_table(first_round), SENT)
    one = common.materialize(asked.groupBy("bucket").applyInArrow(common.tidy_table(shared), ANSWERS), "suffix-1")
    del asked
    common.forget_shuffles(run.spark)

    def second_round(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch, _ = _opened(rows, length)
        reps, _ = batch.representatives(shift)
        s = batch.segments(reps, _bits(answers, 1, reps, 32), _bits(answers, 3, reps, 32), shift, low)
        return _asked(rows.column("batch")[0].as_py(), s)

    def scanned(rows: pa.Table) -> pa.Table:
        return _scanned(rows, Family(), length)

    asked = batches.groupBy("batch").cogroup(one.groupBy("batch")).applyInArrow(common.tidy_tables(second_round), SENT)
    two = common.materialize(asked.groupBy("bucket").applyInArrow(common.tidy_table(scanned), ANSWERS), "suffix-2")
    del asked
    common.forget_shuffles(run.spark)
    return run.result(one.unionByName(two), shift, low, every=False)


class SuffixIndex:
    """A family kept in a folder, for documents that come in batches.

    `add` removes from new documents what also starts in a document with a smaller doc_id, be it
    one of them or one added before, and stores the levels that are new. Batches must come in
    ascending order of doc_id, as documents added before aren't looked at again; the results of
    all batches are then those of one run over everything. Documents that are added a second time
    change nothing and get the same results. A folder holds about 50 bytes for each byte
    of different text before compression (sorted strings compress well); `buckets`, a power of
    two, is fixed by the first batch and should be the bytes to come over 4 MB or so.
    """

    def __init__(self, spark, path: str, length: int = 50, buckets: int = 256):
        if buckets & (buckets - 1) or not 2 <= buckets <= 1 << 30:
            raise ValueError("buckets must be a power of two")
        self.spark, self.path, self.length, self.low = spark, path.rstrip("/"), length, 64 - (buckets.bit_length() - 1)

    def versions(self) -> list[int]:
        """Numbers of the batches whose levels have been written as a whole."""
        found = common.children(self.spark, self.path)
        return sorted(int(n[2:]) for n in found if n.startswith("v=") and common.exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def levels(self) -> DataFrame:
        """The levels in use: all that no later one has replaced."""
        paths = [f"{self.path}/v={v}" for v in self.versions()]
        if not paths:
            return self.spark.createDataFrame([], LEVELS)
        rows = self.spark.read.schema(LEVELS).parquet(*paths)
        gone = rows.where("part = 0").select("bucket", F.explode("replaces").alias("level")).distinct()
        return rows.join(gone.hint("merge"), ["bucket", "level"], "left_anti").select(*rows.columns)

    def add(self, docs: DataFrame, as_text: bool = False) -> DataFrame:
        run = _Run(docs, self.length, as_text)
        batches, length, low = run.stored(), self.length, self.low
        version = max(self.versions(), default=0) + 1
        both = f"{ANSWERS}, level long, part int, replaces array<long>, ids binary, strings binary"

        def ask(rows: pa.Table) -> pa.Table:
            batch, _ = _opened(rows, length)
            reps, _ = batch.representatives(0)
            return _asked(rows.column("batch")[0].as_py(), batch.segments(reps, np.ones(len(reps), bool), np.zeros(len(reps), bool), 0, low))

        def scan(rows: pa.Table, levels: pa.Table) -> pa.Table:
            out, held = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("level", pa.int64()), ("part", pa.int32()), ("replaces", pa.list_(pa.int64())), ("ids", pa.binary()), ("strings", pa.binary())]), {}
            if not rows.num_rows:
                return out.empty_table()
            for r in sorted(levels.select(["level", "part", "ids", "strings"]).to_pylist(), key=lambda r: (r["level"], r["part"])):
                held.setdefault(r["level"], []).append((np.frombuffer(r["strings"], f"S{length}"), np.frombuffer(r["ids"], "<i8")))
            found = [(np.concatenate([s for s, _ in parts]), np.concatenate([i for _, i in parts]), [k]) for k, parts in held.items()]
            family = Family(sorted(found, key=lambda x: -len(x[0])))
            bits = _scanned(rows, family, length).to_pylist()
            stored = []
            for k, (strings_, ids, of) in enumerate(family.levels):
                if len(of) == 1 and len(strings_) == sum(len(s) for s, _ in held[of[0]]):
                    continue  # as it was
                for part, a in enumerate(range(0, len(strings_), ROW)):
                    stored.append({"kind": 9, "bucket": bits[0]["bucket"], "level": (version << 20) + k, "part": part, "replaces": of, "ids": ids[a : a + ROW].tobytes(), "strings": strings_[a : a + ROW].tobytes()})
            return pa.Table.from_pylist(bits + stored, schema=out)

        asked = batches.groupBy("batch").applyInArrow(common.tidy_table(ask), SENT)
        done = common.materialize(asked.groupBy("bucket").cogroup(self.levels().groupBy("bucket")).applyInArrow(common.tidy_tables(scan), both), "suffix-2")
        done.where("kind = 9").select("bucket", "level", "part", "replaces", "ids", "strings").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/v={version}")
        return run.result(done.where("kind = 2").select("batch", "kind", "bucket", "blob"), 0, low, every=True)


def _prefix(spark) -> str:
    """Names of the tables of this application; those of others that run are left alone."""
    return "trackloom_batches_" + "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId).lower() + "_"


def new_table(spark) -> str:
    return f"{_prefix(spark)}{uuid.uuid4().hex[:10]}"


def drop_batches(spark) -> None:
    """Drop the batches that this application stored; for when all results have been written."""
    for t in spark.catalog.listTables():
        if t.name.startswith(_prefix(spark)):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    table = new_table(spark)
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), table=table)
    out = common.materialize(found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "repeats")
    spark.sql(f"DROP TABLE {table}")  # the digests are written; the batches hold all texts
    return out
