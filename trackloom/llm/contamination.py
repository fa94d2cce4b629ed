"""Benchmark items inside documents: size-partitioned MinHash containment search.

Words are runs of ASCII letters and digits (A-Z in lower case) and of characters beyond
ASCII. An item's shingles are its runs of five words, or all its words if it has fewer, and it is
sought in a document's runs of that many words. It is inside if at least the share `containment`
of its distinct shingles is.

Items are partitioned by the width of their shingles and their number n of them, by powers of
two. An item's sketch is the k least hashes of its shingles, bottom-k MinHash, with
k = n - ceil(c n) + 1: a document that lacks none but n - ceil(c n) of the shingles can't lack all
of these. A partition's limit is the largest hash in its sketches, and a document's sketch for the
partition is all its hashes up to that limit. So no item is missed, however long the document is
and however many other shingles it has, where the bands of plain MinHash would need Jaccard
similarities of a thousandth. Where sketches meet, the item's whole set of shingles is compared,
string by string.

Items of up to BLOCK bytes in all are one broadcast index. More of them are joined: sketches of
documents with sketches of items by their hashes, and the pairs found with both texts.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import common, tokens

SHINGLE = 5
#: Bytes of item texts that a broadcast index may be made of; more items are joined.
BLOCK = 16 << 20
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE, short: bool = False):
    """(text of each shingle, hash, first byte, end byte, words in it) of texts that stand end to
    end. short: a text of fewer words has one of all its words, otherwise none."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, np.zeros(0, np.uint64), none, none, none
    black = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts, ends = black.copy(), black.copy()
    starts[1:] &= ~black[:-1] | edge[1:-1]
    ends[:-1] &= ~black[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    prints = tokens.word_prints(LOWER[data], starts, ends)
    text = np.searchsorted(off, starts, side="right") - 1
    place = np.searchsorted(starts, off)  # first word of each text
    count = np.diff(place)
    n = np.minimum(count, size)  # words in a shingle
    left = place[1:][text] - np.arange(len(starts))
    first = np.flatnonzero((left >= size) | (short & (count[text] < size) & (left == count[text])))
    hashes = np.zeros(len(first), np.uint64)
    width = n[text[first]]
    for k in range(size):
        on = width > k
        hashes[on] = (hashes[on] ^ prints[first[on] + k]) * _STEP
        hashes[on] ^= hashes[on] >> np.uint64(29)
    return text[first], hashes, starts[first], ends[first + width - 1], width


def canonical(raw: bytes) -> bytes:
    """The words of a stretch of text, with one space between."""
    data = np.frombuffer(raw, np.uint8)
    return b" ".join(np.where(WORD[data], LOWER[data], np.uint8(32)).tobytes().split())


def item_shingles(texts: list[bytes], containment: Fraction):
    """Distinct shingles of items by (item, hash), and what belongs to each item: (item, hash,
    text, whether it is in the sketch), (number, how many must be found, width, partition)."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw = b"".join(texts)
    of, hashes, a, b, width = shingles(np.frombuffer(raw, np.uint8), off, short=True)
    order = np.lexsort((hashes, of))
    of, hashes, a, b, width = of[order], hashes[order], a[order], b[order], width[order]
    keep = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])]) if len(of) else np.zeros(0, np.int64)
    of, hashes, a, b = of[keep], hashes[keep], a[keep], b[keep]
    n = np.bincount(of, minlength=len(texts))
    need = np.asarray([-((-containment.numerator * int(x)) // containment.denominator) for x in n], np.int64)  # ceil(c n)
    # Ascending hashes within an item: its sketch are the first k.
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    wide = np.full(len(texts), SHINGLE, np.int64)
    wide[of] = width[keep]
    part = np.asarray([int(x).bit_length() for x in n], np.int64)
    text = [canonical(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return (of, hashes, text, nth <= (n - need)[of]), (n, need, wide, part)


class Partition:
    """Items of one width and about one number of shingles: their sketches and the limit."""

    def __init__(self, item: np.ndarray, hashes: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.item, self.hash = item[order], hashes[order]
        self.limit = self.hash[-1]

    def candidates(self, of: np.ndarray, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) that share a hash of their sketches."""
        mine = np.flatnonzero(hashes <= self.limit)
        lo, hi = np.searchsorted(self.hash, hashes[mine]), np.searchsorted(self.hash, hashes[mine], side="right")
        hit = np.flatnonzero(hi > lo)
        return {(t, i) for t, x, y in zip(of[mine[hit]].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True) for i in self.item[x:y].tolist()}


class Index:
    """Items by partitions, and every shingle with its items by width."""

    def __init__(self, ids: list[int], texts: list[bytes], containment: Fraction):
        (item, hashes, text, sketch), (self.n, self.need, wide, part) = item_shingles(texts, containment)
        self.ids, self.widths = np.asarray(ids, np.int64), {}
        for w in np.unique(wide[self.n > 0]).tolist():
            mine = np.flatnonzero(wide[item] == w)
            order = mine[np.argsort(hashes[mine], kind="stable")]
            held = [np.flatnonzero(sketch & (wide[item] == w) & (part[item] == p)) for p in np.unique(part[wide == w]).tolist() if p]
            bits = np.zeros(1 << 20, bool)
            for x in held:
                bits[(hashes[x] >> np.uint64(44)).astype(np.int64)] = True
            self.widths[w] = (hashes[order], item[order], [text[i] for i in order.tolist()], bits, [Partition(item[x], hashes[x]) for x in held])

    def search(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, shingles found) of all items inside, ascending."""
        return sorted(x for w in self.widths for x in self._search(data, off, w))

    def _search(self, data: np.ndarray, off: np.ndarray, width: int):
        known, item, text, bits, partitions = self.widths[width]
        of, hashes, a, b, _ = shingles(data, off, width)
        near = np.flatnonzero(bits[(hashes >> np.uint64(44)).astype(np.int64)])
        wanted: dict[int, set[int]] = {}
        for p in partitions:
            for t, i in p.candidates(of[near], hashes[near]):
                wanted.setdefault(t, set()).add(i)
        raw = data.tobytes() if wanted else b""
        for t, items in wanted.items():
            x, y = np.searchsorted(of, [t, t + 1])
            mine, first = np.unique(hashes[x:y], return_index=True)
            got = dict.fromkeys(items, 0)
            place = np.searchsorted(known, mine)
            live = place < len(known)
            live[live] = known[place[live]] == mine[live]
            for p, f in zip(place[live].tolist(), first[live].tolist(), strict=True):
                words = canonical(raw[a[x + f] : b[x + f]])
                h = known[p]
                while p < len(known) and known[p] == h:
                    if int(item[p]) in got and text[p] == words:
                        got[int(item[p])] += 1
                    p += 1
            yield from ((t, i, c) for i, c in got.items() if c >= self.need[i])


def _items(items: DataFrame, unnamed: bool) -> tuple[DataFrame, int]:
    """Distinct items (those without an item_id, which then reads 0, only if unnamed) and their bytes."""
    items = common.pick(items, item_id="long", text="string").where("text is not null")
    items = common.materialize((items.fillna(0, "item_id") if unnamed else items.where("item_id is not null")).distinct(), "items")
    return items, items.select(F.sum(F.length(F.col("text").cast("binary")))).first()[0] or 0


def _broadcast(items: DataFrame, share: Fraction):
    """The index of items of BLOCK bytes at most."""
    rows = items.orderBy("item_id", "text").collect()
    return items.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text.encode() for r in rows], share))


def _key(a: str = "k1", b: str = "k2"):
    """128 bits that a text is known by in joins."""
    return F.xxhash64("text").alias(a), F.xxhash64("text", F.lit(1)).alias(b)


def joined_items(docs: DataFrame, items: DataFrame, share: Fraction) -> DataFrame:
    """For item tables of any size: (k1, k2, item_id, n_shingles, n_found) for each different
    text of docs, known by _key, and item inside it. Both sides are dealt by the hashes of their
    sketches; what the tables have in common decides how many rows meet."""
    texts = common.pick(docs, text="string").where("text is not null").select(*_key(), "text").dropDuplicates(["k1", "k2"])
    texts = common.materialize(texts, "texts")
    items = items.withColumn("item", F.xxhash64("item_id", "text"))

    def sketch_items(batches):
        for whole in batches:
            for b in common.slices(whole, "text", 1 << 20):
                (of, hashes, _, sketch), (_, _, wide, part) = item_shingles(list(common.texts(b.column(1))), share)
                on = np.flatnonzero(sketch)
                yield pa.RecordBatch.from_arrays([pa.array(wide[of[on]], pa.int32()), pa.array(part[of[on]], pa.int32()), pa.array(hashes[on].view(np.int64)), b.column(0).take(pa.array(of[on]))], ["width", "part", "hash", "item"])

    sketches = common.materialize(items.select("item", "text").mapInArrow(common.tidy(sketch_items), "width int, part int, hash long, item long"), "sketches")
    # The limits: a row for each width and power of two. Compared as unsigned numbers.
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    limits = {}
    for r in sketches.groupBy("width").agg(F.max(unsigned).alias("limit")).collect():
        limits[r.width] = np.uint64((r.limit & (1 << 64) - 1) ^ 1 << 63)

    def sketch_texts(batches):
        for whole in batches:
            for b in common.slices(whole, "text", 1 << 20):
                data, off = common.flat_text(b.column(2))
                for w, limit in limits.items():
                    of, hashes, _, _, _ = shingles(data, off, w)
                    on = hashes <= limit
                    of, hashes = of[on], hashes[on]
                    order = np.lexsort((hashes, of))
                    of, hashes = of[order], hashes[order]
                    on = np.r_[True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])] if len(of) else np.zeros(0, bool)
                    rows = pa.array(of[on])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.full(on.sum(), w), pa.int32()), pa.array(hashes[on].view(np.int64))], ["k1", "k2", "width", "hash"])

    pairs = texts.mapInArrow(common.tidy(sketch_texts), "k1 long, k2 long, width int, hash long").join(sketches.hint("merge"), ["width", "hash"]).select("k1", "k2", "item").distinct()
    pairs = common.materialize(pairs, "pairs")

    def verify(batches):
        for b in batches:
            rows = []
            for k, (x, y) in enumerate(zip(common.texts(b.column(3)), common.texts(b.column(4)), strict=True)):
                index = Index([0], [y], share)
                rows += [(k, int(index.n[0]), c) for _, _, c in index.search(np.frombuffer(x, np.uint8), np.asarray([0, len(x)]))]
            k, n, c = np.asarray(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([*[b.column(j).take(pa.array(k)) for j in range(3)], pa.array(n), pa.array(c)], ["k1", "k2", "item_id", "n_shingles", "n_found"])

    both = pairs.join(items.select("item", "item_id", F.col("text").alias("other")), "item").join(texts.hint("merge"), ["k1", "k2"])
    return both.select("k1", "k2", "item_id", "text", "other").mapInArrow(common.tidy(verify), "k1 long, k2 long, item_id long, n_shingles long, n_found long")


def find_items(docs: DataFrame, items: DataFrame, containment: float = 0.8) -> DataFrame:
    """One row for each item inside a document: doc_id, item_id, n_shingles, n_found.

    Null and empty texts hold nothing and are found nowhere. An item of fewer than five words
    is found wherever these words stand side by side. Repeated rows of documents each give
    their rows; rows of items that share item_id and text count once, those without an item_id
    not at all. Texts may be of any length, either table may be empty; extra columns aren't read.
    """
    docs = common.pick(docs, doc_id="long", text="string")
    share = Fraction(containment).limit_denominator(1000)
    items, size = _items(items, unnamed=False)
    if size > BLOCK:
        found = joined_items(docs, items, share)
        return docs.select("doc_id", *_key()).join(found, ["k1", "k2"]).drop("k1", "k2")
    index = _broadcast(items, share)

    def run(batches):
        x = index.value
        for whole in batches:
            for b in common.slices(whole, "text", 1 << 20):
                got = x.search(*common.flat_text(b.column(1)))
                if got:
                    t, i, n = np.asarray(got, np.int64).T
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array(x.ids[i]), pa.array(x.n[i].astype(np.int64)), pa.array(n)], ["doc_id", "item_id", "n_shingles", "n_found"])

    return docs.mapInArrow(common.tidy(run), "doc_id long, item_id long, n_shingles long, n_found long")


def without_items(docs: DataFrame, items: DataFrame, containment: float = 0.8) -> DataFrame:
    """The rows of docs (any columns, one of them text) that hold no item, be it one with an item_id
    or without. Rows with a null or empty text stay; repeated rows all stay or all go."""
    share = Fraction(containment).limit_denominator(1000)
    items, size = _items(items, unnamed=True)
    if size > BLOCK:
        found = common.materialize(joined_items(docs, items, share).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct(), "held")
        return docs.select("*", *_key("__k1", "__k2")).join(found.hint("merge"), ["__k1", "__k2"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    index = _broadcast(items, share)

    def run(batches):
        x = index.value
        for whole in batches:
            for b in common.slices(whole, "text", 1 << 20):
                held = {t for t, _, _ in x.search(*common.flat_text(b.column(b.schema.get_field_index("text"))))}
                yield b.filter(pa.array([i not in held for i in range(b.num_rows)], pa.bool_())) if held else b

    return docs.mapInArrow(common.tidy(run), docs.schema)


def op2_benchmark_containment(spark, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
_RUNS = "unnest(list_transform(range(1, len(ws) - w + 2), lambda i: array_to_string(ws[i:i + w - 1], ' ')))"
OP2_SQL = f"""
WITH iw AS (SELECT item_id, ws, least(len(ws), 5) AS w FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, w, {_RUNS} AS s FROM iw),
d AS (SELECT DISTINCT doc_id, w, {_RUNS} AS s FROM (SELECT doc_id, {_WORDS} AS ws FROM documents) JOIN (SELECT DISTINCT w FROM iw) ON len(ws) >= w),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found FROM d JOIN i USING (w, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 10 >= n_shingles * 8
"""
