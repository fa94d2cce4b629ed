"""Token ids in canonical length-limited Huffman files.

Layout of the stored table, one row for each block file:
  part, block       place of the block; blocks ascend by doc_id
  base, n           ids before the block in its part, and ids in it
  blob              b"THUF" | u8 version | u8 width of the longest code | u16 checkpoint step
                    | u32 documents | u32 ids | u64 bits
                    | i64 doc_id x documents | u32 ids of each document
                    | u64 bit offset of every step-th id | bit stream, padded by 8 bytes
The code lengths of all ids stand once, in the row with part = -1; canonical codes follow
from the lengths alone. A block needs nothing but its own bytes and the lengths, and each
checkpoint is a place where decoding can begin.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import common, tokens

HEAD = struct.Struct("<4sBBHIIQ")
MAGIC = b"THUF"
#: Ids between checkpoints; bytes of text in a partition (about; a block has 1 MB or a text).
STEP, EACH = 256, 24 << 20


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge). Symbols without a count
    have length 0; a sole symbol has length 1."""
    live = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(live)
    if n == 0:
        return out
    if n == 1:
        out[live] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = live[np.lexsort((live, counts[live]))]
    weight = counts[order].astype(np.int64)
    # Each level's list: coins of the symbols merged with the packages of the level below.
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        place = np.argsort(both, kind="stable")
        levels.append(place)
        merged = both[place]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for place in reversed(levels):
        chosen = place[:take]
        own = chosen < n
        lengths[chosen[own]] += 1
        take = 2 * int((~own).sum())
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0].tolist():
        code <<= int(lengths[s]) - before
        before = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(bit stream as bytes, bit offset of each id, bits); most significant bit first."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    bits = int(ends[-1]) if len(ends) else 0
    starts = ends - width
    words = np.zeros(bits // 64 + 3, np.uint64)
    if len(ids):
        word, room = starts >> 6, 64 - (starts & 63)
        code = codes[ids].astype(np.uint64)
        over = width - room  # bits that go to the next word
        here = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] = np.bitwise_or.reduceat(here, first)
        cross = np.flatnonzero(over > 0)  # one at most for each word
        words[word[cross] + 1] |= code[cross] << (64 - over[cross]).astype(np.uint64)
    return words.byteswap().view(np.uint8)[: (bits + 7) // 8 + 8], starts, bits


class Decoder:
    """Table-driven: the next `width` bits name the id and its length."""

    def __init__(self, lengths: np.ndarray):
        self.width = max(1, int(lengths.max(initial=0)))
        codes = canonical(lengths)
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.length = np.zeros(1 << self.width, np.uint8)
        live = np.flatnonzero(lengths)
        order = live[np.argsort(codes[live].astype(np.uint64) << (self.width - lengths[live]).astype(np.uint64), kind="stable")]
        span = 1 << (self.width - lengths[order]).astype(np.int64)
        filled = int(span.sum())
        self.symbol[:filled] = np.repeat(order, span)
        self.length[:filled] = np.repeat(lengths[order], span)

    def decode(self, stream: np.ndarray, marks: np.ndarray, n: int, step: int) -> np.ndarray:
        """All runs between checkpoints side by side, one id of each at a time."""
        out = np.zeros(len(marks) * step, np.uint32)
        at = marks.astype(np.int64)
        wide = np.zeros(len(stream), np.uint64)
        # The 40 bits that begin at each byte.
        padded = np.concatenate([stream, np.zeros(8, np.uint8)]).astype(np.uint64)
        for k in range(5):
            wide |= padded[k : k + len(stream)] << np.uint64(32 - 8 * k)
        grid = out.reshape(len(marks), step)
        mask, top = np.uint64((1 << self.width) - 1), len(stream) - 1
        for k in range(step):
            live = len(marks) if n >= (len(marks) - 1) * step + k + 1 else len(marks) - 1
            if live == 0:
                break
            a = at[:live]
            look = (wide[np.minimum(a >> 3, top)] >> (np.uint64(40 - self.width) - (a & 7).astype(np.uint64))) & mask
            grid[:live, k] = self.symbol[look]
            at[:live] += self.length[look]
        return out[:n]


def write_block(doc_ids, counts, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> bytes:
    stream, starts, bits = pack(ids, codes, lengths)
    head = HEAD.pack(MAGIC, 1, int(lengths.max(initial=0)), step, len(doc_ids), len(ids), bits)
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), np.asarray(counts, "<u4").tobytes(), starts[::step].astype("<u8").tobytes(), stream.tobytes()])


def read_block(blob: bytes, decoder: Decoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each, all ids)."""
    magic, version, _, step, docs, n, bits = HEAD.unpack_from(blob)
    if magic != MAGIC or version != 1:
        raise ValueError("not a block of this format")
    at = HEAD.size
    doc_ids = np.frombuffer(blob, "<i8", docs, at)
    counts = np.frombuffer(blob, "<u4", docs, at := at + 8 * docs)
    marks = np.frombuffer(blob, "<u8", -(-n // step), at := at + 4 * docs)
    stream = np.frombuffer(blob, np.uint8, (bits + 7) // 8 + 8, at + 8 * len(marks))
    return doc_ids, counts, decoder.decode(stream, marks, n, step)


def read_ids(blob: bytes, decoder: Decoder, first: int, last: int) -> np.ndarray:
    """The ids first to last (without it) of a block, from the checkpoint before the first on:
    nothing before that is decoded."""
    _, _, _, step, docs, n, bits = HEAD.unpack_from(blob)
    first, last = max(0, first), min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    a, b = first // step, -(-last // step)
    at = HEAD.size + 12 * docs
    marks = np.frombuffer(blob, "<u8", -(-n // step), at)[a:b].astype(np.int64)
    begin = int(marks[0]) >> 3
    end = HEAD.size + 12 * docs + 8 * -(-n // step) + (int(np.frombuffer(blob, "<u8", 1, at + 8 * b)[0]) + 7 >> 3 if b * step < n else (bits + 7) // 8) + 8
    stream = np.frombuffer(blob[at + 8 * -(-n // step) + begin : end], np.uint8)
    ids = decoder.decode(stream, marks - 8 * begin, min(n, b * step) - a * step, step)
    return ids[first - a * step : last - a * step]


def _sorted(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    size = docs.select(F.sum(F.length(F.col("text").cast("binary")))).first()[0] or 0
    by = F.col("doc_id").asc_nulls_first()
    return docs.repartitionByRange(common.partitions_for(spark, size, EACH), by).sortWithinPartitions(by, F.crc32(F.coalesce("text", F.lit("")).cast("binary")))


def write_huffman(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, limit: int = 20) -> None:
    """Encode every whole text (null: empty), append end_id, and store all ids below path in
    ascending doc_id order (null ids first; equal ids by their texts' checksum; repeated rows are
    each stored). Texts may be of any length; an empty table gives a store without documents; extra
    columns aren't read.

    The texts are dealt out by ranges of doc_id and encoded once, to blocks of plain ids
    that are staged in the shared folder; these are counted, and then coded one by one.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.default_vocabulary()
    staged = f"{path}-ids"

    def stage(batches):
        enc, part, block, at = tokens.word_ids(vocabulary), TaskContext.get().partitionId(), 0, 0
        kind = "<u2" if max(len(enc.ends) - 1, end_id) < 1 << 16 else "<u4"
        for whole in batches:
            for b in common.slices(whole, "text", tokens.AT_ONCE):
                ids, off = enc.flat(*common.flat_text(b.column(1)))
                ids = np.insert(ids, off[1:], end_id).astype(kind)
                doc_ids = np.asarray(b.column(0).fill_null(NULL)).astype("<i8")
                counts = (np.diff(off) + 1).astype("<u4")
                row = [part, block, at, len(ids), b.column(0).null_count, doc_ids.tobytes(), counts.tobytes(), ids.tobytes(), ids.itemsize]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["part", "block", "base", "n", "nulls", "doc_ids", "counts", "ids", "width"])
                block, at = block + 1, at + len(ids)

    _sorted(common.pick(docs, doc_id="long", text="string")).mapInArrow(common.tidy(stage), STAGED).write.option("compression", "zstd").parquet(staged)
    common.forget_shuffles(spark)
    plain = spark.read.schema(STAGED).parquet(staged)

    def tally(batches):
        sums = np.zeros(0, np.int64)
        for b in batches:
            for ids, width in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                got = np.bincount(np.frombuffer(ids.as_py(), f"<u{width}"))
                if len(got) > len(sums):
                    sums = np.concatenate([sums, np.zeros(len(got) - len(sums), np.int64)])
                sums[: len(got)] += got
        live = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(sums[live], pa.int64())], ["id", "n"])

    # One row for each id of the vocabulary at most.
    rows = plain.select("ids", "width").mapInArrow(common.tidy(tally), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    lengths = code_lengths(counts, max(limit, int(np.ceil(np.log2(max(2, len(rows)))))))
    share = spark.sparkContext.broadcast(lengths)

    def code(batches):
        lengths = share.value
        codes = canonical(lengths)
        for b in batches:
            for i, r in enumerate(b.select(["doc_ids", "counts", "ids", "width"]).to_pylist()):
                blob = write_block(np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["counts"], "<u4"), np.frombuffer(r["ids"], f"<u{r['width']}"), codes, lengths)
                kept = ["part", "block", "base", "n", "nulls"]
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, 1) for c in kept], pa.array([blob], pa.binary())], [*kept, "blob"])

    codebook = spark.createDataFrame([(-1, 0, 0, 0, 0, bytearray(lengths.tobytes()))], BLOCKS)
    plain.mapInArrow(common.tidy(code), BLOCKS).unionByName(codebook).write.option("compression", "none").parquet(path)
    share.unpersist()
    common.delete_path(spark, staged)


STAGED = "part int, block int, base long, n long, nulls int, doc_ids binary, counts binary, ids binary, width int"
BLOCKS = "part int, block int, base long, n long, nulls int, blob binary"
#: How a null doc_id stands in a block; the first `nulls` ids of a block are null ones.
NULL = -(1 << 63)


def read_huffman(spark, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids (uint32 bytes), ids_crc32."""
    stored = spark.read.schema(BLOCKS).parquet(path)
    row = stored.where("part = -1").first()  # one row: the code lengths
    starts, total = {}, 0  # one entry for each partition that was written
    for r in sorted(stored.where("part >= 0").groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.part):
        starts[r.part], total = total, total + r.n
    share = spark.sparkContext.broadcast((bytes(row.blob), starts))

    def decode(batches):
        lengths, starts = share.value
        decoder = Decoder(np.frombuffer(lengths, np.uint8))
        for b in batches:
            for part, base, nulls, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                base += starts[part]
                doc_ids, counts, ids = read_block(blob.as_py(), decoder)
                ends = np.cumsum(counts.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                each = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=np.arange(len(doc_ids)) < nulls), pa.array(base + ends - counts, pa.int64()), pa.array(counts.astype(np.int64), pa.int64()), pa.array(each, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    out = stored.where("part >= 0").select("part", "base", "nulls", "blob").mapInArrow(common.tidy(decode), "doc_id long, start long, n_tokens long, ids binary")
    return out.withColumn("ids_crc32", F.crc32("ids"))


def op8_huffman_ids(spark, sf_dir: str) -> DataFrame:
    """Round trip of all documents through the files."""
    path = common.scratch(spark, "huffman")
    write_huffman(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_huffman(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
