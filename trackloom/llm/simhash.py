"""SimHash near-duplicates by vantage-point trees.

Exact form (`link_fingerprints`): all 64-bit fingerprints at Hamming distance <= radius are
linked. A vantage-point tree fitted on a bounded sample deals the distinct fingerprints out
to shards, as many as their number asks for: at a node with vantage v and bound m, fingerprints with d(x, v) <= m go inside,
the others outside. By the triangle inequality the ends of a link differ by radius at most
in d(., v), so those with m - radius < d(x, v) <= m are sent outside as well. Any two linked
fingerprints thus meet in some shard, whatever the sample: the index is exact. Within a
shard a tree of its own prunes in the same way down to small blocks, which are compared in
full. Shards give component labels, never pairs, and the labels that a fingerprint got in
several shards are joined by `graph.components`.

Similarity form (`near_groups`): at the distances that a similarity of 0.8 stands for, all
distances to a vantage lie within the radius of one another and no bound prunes, so a tree
can't deal documents out. There bands of MinHash deal them out to shards, and within a shard
the longer fingerprints are linked as above.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm import common, graph, tokens

#: Fingerprints that a tree is fitted on at most; fingerprints aimed at in a shard; most shards
#: of a tree. Inputs for more shards get a second tree below each shard of the first.
SAMPLE, SHARD, SHARDS = 32_768, 8_192, 1_024


def shingle_hashes(text: bytes, n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each n-word shingle, repeats included, of the text with A-Z lower-cased.
    Words: maximal runs without ASCII white space. Fewer than n words: the whole sequence;
    none: nothing."""
    words = text.lower().split()  # bytes: both touch ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= n:
        return np.asarray([xxhash.xxh64_intdigest(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hash64 = xxhash.xxh64_intdigest
    return np.asarray([hash64(whole[a:b], seed) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    sums = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 64):  # sums of 255 rows fit a byte
        bits = np.unpackbits(hashes[at : at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:
            sums += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if full < len(bits):
            sums += np.add.reduce(bits[full:], axis=0, dtype=np.uint8)
    return int(np.packbits(sums * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each text as a signed long; no words: 0."""

    def run(batches):
        for b in batches:
            got = [majority(shingle_hashes(t, n)) for t in common.texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(got, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return common.pick(docs, doc_id="long", text="string").mapInArrow(common.tidy(run), "doc_id long, fp long")


def distance(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Hamming distances; points (n, words) of uint64, one (words,)."""
    return np.bitwise_count(points ^ one).sum(axis=1, dtype=np.int64)


def choose(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 6):
    """(vantage, bound) that copies the fewest points at a fair split, or None."""
    best = None
    for v in points[rng.integers(0, len(points), tries)]:
        d = distance(points, v)
        counts = np.bincount(d, minlength=64 * points.shape[1] + 1)
        inside = np.cumsum(counts) / len(points)
        near = (np.cumsum(counts) - np.concatenate([np.zeros(radius, np.int64), np.cumsum(counts)[:-radius]] if radius else np.cumsum(counts))) / len(points)
        larger = np.maximum(inside, 1 - inside + near)  # of the two sides
        m = int(np.where((inside > 0.15) & (inside < 0.85), larger + near, 9.0).argmin())
        if best is None or larger[m] + near[m] < best[0]:
            best = (larger[m] + near[m], v, m, larger[m])
    return None if best is None or best[0] >= 9 or best[3] > 0.9 else (best[1], best[2])


def build(sample: np.ndarray, shards: int, radius: int) -> list:
    """Nodes (vantage words, bound, inside, outside); a leaf's number n stands as -1 - n."""
    nodes: list = []
    rng, leaves = np.random.default_rng(7), [0]
    least = max(2, len(sample) // max(1, shards))

    def grow(points):
        found = choose(points, radius, rng) if len(points) > least else None
        if found is None:
            leaves[0] += 1
            return -leaves[0]
        v, m = found
        at = len(nodes)
        nodes.append(None)
        d = distance(points, v)
        nodes[at] = (v.tolist(), m, grow(points[d <= m]), grow(points[d > m]))
        return at

    root = grow(sample)
    return [root, nodes]


def route(points: np.ndarray, tree: list, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard): every point's own shard and the shards over whose bounds it reaches."""
    root, nodes = tree
    rows, shards, todo = [], [], [(root, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        if at < 0:
            rows.append(own)
            shards.append(np.full(len(own), -1 - at))
            continue
        v, m, inside, outside = nodes[at]
        d = distance(points[own], np.asarray(v, np.uint64))
        todo += [(inside, own[d <= m]), (outside, own[d > m - radius])]
    return np.concatenate(rows), np.concatenate(shards)


def compare(points: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, forest: graph.Forest) -> None:
    """Join all pairs of a row on the left and a row on the right that are linked."""
    for a in range(0, len(left), 512):
        rows = left[a : a + 512]
        for b in range(a if left is right else 0, len(right), 4096):
            cols = right[b : b + 4096]
            d = np.zeros((len(rows), len(cols)), np.uint16)
            for w in range(points.shape[1]):
                d += np.bitwise_count(points[rows, w][:, None] ^ points[cols, w][None, :])
            x, y = np.nonzero(d <= radius)
            forest.join(rows[x], cols[y])


def crowd(points: np.ndarray, own: np.ndarray, radius: int, forest: graph.Forest, rng: np.random.Generator) -> None:
    """Join a crowd that no bound divides. What lies within the radius of a vantage point is
    linked to it; after a few vantage points hardly any are left, and only rows that are not
    yet connected are compared with one another. No link between components is missed."""
    left = own
    for _ in range(24):
        if len(left) < 64:
            break
        best = max((own[distance(points[own], points[v]) <= radius] for v in left[rng.integers(0, len(left), 6)]), key=len)
        forest.join(best, np.full(len(best), best[0]))
        left = np.setdiff1d(left, best, assume_unique=True)
    while True:
        roots, size = np.unique(forest.parent[own], return_counts=True)
        if len(roots) == 1:
            return
        # The smallest component against all others; it is then joined or done with.
        one = roots[size.argmin()]
        mine = own[forest.parent[own] == one]
        compare(points, mine, own[forest.parent[own] != one], radius, forest)
        if forest.parent[mine[0]] == one and (forest.parent[own] == one).sum() == len(mine):
            own = own[forest.parent[own] != one]
            if not len(own):
                return


def link(points: np.ndarray, radius: int, block: int = 384) -> np.ndarray:
    """For each point the smallest row linked to it, by a tree of its own."""
    forest, rng = graph.Forest(len(points)), np.random.default_rng(11)
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            continue
        found = choose(points[own], radius, rng) if len(own) > block else None
        if found is not None:
            d = distance(points[own], found[0])
            todo += [own[d <= found[1]], own[d > found[1] - radius]]
        elif len(own) > 2048 and radius == 2 and points.shape[1] == 1:
            # A crowd that no bound divides. Two points are 2 apart or less just if some word
            # is 1 apart or less from both, so all points at such a word are linked: exact,
            # and in proportion to the crowd where a comparison of all pairs isn't.
            flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
            for part in range(2):  # half of the middle words at a time
                words = (points[own, 0][:, None] ^ flips[None, :]).ravel()
                keep = np.flatnonzero(np.bitwise_count(words) % 2 == part)
                order = keep[np.argsort(words[keep], kind="stable")]
                same = np.flatnonzero(words[order][1:] == words[order][:-1])
                forest.join(own[order[same] // 65], own[order[same + 1] // 65])
        elif len(own) > 2048:
            crowd(points, own, radius, forest, rng)
        else:
            compare(points, own, own, radius, forest)
    return forest.parent


def _sampled(df: DataFrame, share: float, salt: int) -> DataFrame:
    """About a share of the rows, by a hash of the fingerprint."""
    return df.where(F.pmod(F.xxhash64("fp", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, share)))


def _points(column) -> np.ndarray:
    return np.sort(np.asarray(column)).view(np.uint64).reshape(-1, 1)


def deal_out(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """(shard, fp) of n different fingerprints: each in its own shard and in those over whose
    bounds it reaches. The number of shards follows n: one tree of up to SHARDS leaves, or one
    more below each of its leaves, fitted on a bounded sample of the shard by one task each."""
    spark = distinct.sparkSession
    shards = max(1, -(-n // SHARD))
    sample = _sampled(distinct, SAMPLE / max(1, n), 0).select("fp").limit(2 * SAMPLE).toPandas()["fp"]
    tree = build(_points(sample.to_numpy(np.int64)), min(SHARDS, shards), radius) if len(sample) else [-1, []]

    def dealt(tree, below):
        share = spark.sparkContext.broadcast((tree, below))  # SHARDS squared nodes at most

        def deal(batches):
            tree, below = share.value
            for b in batches:
                points = np.asarray(b.column(0)).view(np.uint64).reshape(-1, 1)
                rows, own = route(points, tree, radius)
                own = own.astype(np.int64) << 32
                if below:
                    parts = []
                    order = np.argsort(own, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                        sub = below.get(int(own[part[0]]))
                        at, inner = route(points[rows[part]], sub, radius) if sub else (np.arange(len(part)), np.zeros(len(part), np.int64))
                        parts.append((rows[part[at]], own[part[at]] + inner))
                    rows, own = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (rows, own)
                yield pa.RecordBatch.from_arrays([pa.array(own), b.column(0).take(pa.array(rows))], ["shard", "fp"])

        return distinct.select("fp").mapInArrow(common.tidy(deal), "shard long, fp long")

    first = dealt(tree, {})
    if shards <= SHARDS or not tree[1]:
        return first

    def fitted(table: pa.Table) -> pa.Table:
        points = _points(table.column("fp").combine_chunks())[:SAMPLE]
        found = build(points, min(SHARDS, -(-len(points) * n // (SHARD * max(1, int(n * each))))), radius)
        return pa.table({"shard": table.column("shard")[:1], "tree": pa.array([json.dumps(found)])})

    each = min(1.0, SHARDS * SAMPLE / 8 / n)  # of every shard, some 4,096 fingerprints at the mean
    rows = _sampled(first, each, 1).groupBy("shard").applyInArrow(common.tidy_table(fitted), "shard long, tree string").collect()  # SHARDS rows at most
    return dealt(tree, {r.shard: json.loads(r.tree) for r in rows})


def link_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp) -> (fp, component_id) for every distinct fingerprint; component_id is the
    smallest doc_id among the documents of all fingerprints reachable over links."""
    distinct = common.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    dealt = deal_out(distinct, distinct.count(), radius)

    def labels(table: pa.Table) -> pa.Table:
        fp = np.sort(np.asarray(table.column("fp").combine_chunks()))
        label = fp[link(fp.view(np.uint64).reshape(-1, 1), radius)]
        size = np.unique(label, return_inverse=True, return_counts=True)
        linked = size[2][size[1]] > 1
        return pa.table({"fp": fp[linked], "label": label[linked]})

    found = common.materialize(dealt.groupBy("shard").applyInArrow(common.tidy_table(labels), "fp long, label long"), "labels")
    low = found.withColumn("low", F.min("label").over(Window.partitionBy("fp")))
    roots = graph.components(low.where("label != low").select(F.col("label").alias("a"), F.col("low").alias("b")))
    of = found.groupBy("fp").agg(F.min("label").alias("label")).join(roots.withColumnRenamed("node", "label"), "label", "left").select("fp", F.coalesce("root", "label").alias("root"))
    own = distinct.join(of, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = own.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(smallest, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, n: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts, and those without words, have fingerprint zero and link like any
    other. Repeated rows each keep their row; texts of any length count whole; an empty table gives
    none; extra columns aren't read. A null doc_id takes part, but can't be the smallest of its
    component unless all are null.
    """
    fps = common.materialize(fingerprints(docs, n), "simhash")
    of = common.materialize(link_fingerprints(fps, radius), "components")
    # A fingerprint may hold a third of all rows: both sides are plain scans, so that adaptive
    # execution can split the large partition.
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Bands of the similarity form, MinHash values in a band, and words of its fingerprints.
BANDS, ROWS, WORDS = 14, 4, 8
#: Documents in a bucket of which all pairs are looked at.
SMALL = 32
#: Documents, and shingles in all, of a block of a larger bucket.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Documents of a bucket that are linked in one task at first, and one of how many is counted to
#: find the buckets that have more.
CROWD, COUNTED = 8_192, 16
_rng = np.random.default_rng(1)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def radius_of(similarity: float, bits: int) -> int:
    """Bits that differ, as expected, between the SimHashes of sets of a Jaccard similarity."""
    return int(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi + 0.5)


def sketches(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, WORDS) fingerprints, (documents, BANDS) keys and the numbers of the n-word shingles."""
    docs = len(off) - 1
    words, keys, sizes = np.zeros((docs, WORDS), np.uint64), np.zeros((docs, BANDS), np.uint64), np.zeros(docs, np.int64)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    starts, ends = tokens.words(data, off)
    prints, place = tokens.word_prints(data, starts, ends), np.searchsorted(starts, off)
    count = np.diff(place)
    hashes = np.zeros(len(prints), np.uint64)
    doc = np.repeat(np.arange(docs), count)
    last = place[1:][doc]
    for k in range(n):
        at = np.arange(len(prints)) + k
        on = at < last
        hashes[on] = (hashes[on] ^ prints[at[on]]) * np.uint64(0x9E3779B97F4A7C15)
        hashes[on] ^= hashes[on] >> np.uint64(29)
    keep = (np.arange(len(prints)) + n <= last) | ((count[doc] < n) & (np.arange(len(prints)) == place[:-1][doc]))
    hashes, doc = hashes[keep], doc[keep]
    order = np.lexsort((hashes, doc))  # repeats go: similarity is that of sets
    hashes, doc = hashes[order], doc[order]
    once = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
    hashes, doc = hashes[once], doc[once]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    if not len(first):
        return words, keys, sizes
    own = doc[first]
    sizes[own] = np.diff(np.r_[first, len(doc)])
    for j, f in enumerate(_FACTORS):
        x = hashes * f
        least = np.minimum.reduceat(x ^ (x >> np.uint64(32)), first)
        keys[own, j // ROWS] = (keys[own, j // ROWS] ^ least) * np.uint64(0xD6E8FEB86659FD93)
    for w, salt in enumerate(_SALTS):
        x = hashes * salt
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        for d, a, b in zip(own.tolist(), first.tolist(), np.r_[first[1:], len(x)].tolist(), strict=True):
            words[d, w] = majority(x[a:b])
    return words, keys, sizes


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text as ascending hashes."""
    return np.unique(shingle_hashes(text, n))


def blocks(root: np.ndarray, size: np.ndarray, similarity: float):
    """Ordered rows of a crowd cut into blocks, for each two blocks that may hold a link between
    two labels: (i, j, rows of i, rows of j). Rows of large labels stand together, others by size."""
    _, of, count = np.unique(root, return_inverse=True, return_counts=True)
    many = np.where(count[of] > 1, of, len(count))
    order = np.lexsort((size, many))
    cuts, rows, held = [0], 0, 0
    for at, n in enumerate(size[order].tolist()):
        if rows and (rows == BLOCK or held + n > BLOCK_SHINGLES):
            cuts.append(at)
            rows = held = 0
        rows, held = rows + 1, held + n
    parts = np.split(order, cuts[1:])
    low, high = np.asarray([size[x].min() for x in parts]), np.asarray([size[x].max() for x in parts])
    label = np.asarray([of[x[0]] if (of[x] == of[x[0]]).all() else -1 for x in parts])
    for i, mine in enumerate(parts):
        j = np.arange(i, len(parts))
        j = j[((label[j] != label[i]) | (label[i] < 0)) & (high[j] >= similarity * low[i]) & (high[i] >= similarity * low[j])]
        for k in j.tolist():
            yield i, k, mine, parts[k]


def meet(sets: list, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many hashes the sets of rows on the left and of rows on the right have in common."""
    both = np.zeros((len(left), len(right)), np.int64)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[of] > 1)  # a hash in one set only is common to none
    rank = np.cumsum(count > 1) - 1
    rows, of = rows[shared], rank[of[shared]]
    order = np.argsort(of, kind="stable")
    rows, of = rows[order], of[order]
    for first in range(0, int(of[-1]) + 1 if len(of) else 0, 4096):
        a, b = np.searchsorted(of, [first, first + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[rows[a:b], of[a:b] - first] = 1
        both += (m[left] @ m[right].T).astype(np.int64)
    return both


def text_key():
    """The hash that a text is known by; null and empty texts share one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_groups(docs: DataFrame, n: int = 5, similarity: float = 0.8, keyed: bool = False) -> DataFrame:
    """doc_id, component_id of every document: components of the links between documents
    whose sets of n-word shingles have the Jaccard similarity or more.

    Documents that share a band's bucket are candidates, and no link stands without a
    comparison of the sets. First SimHashes of 512 bits propose one link for each document that
    is clearly near another, in buckets of more than CROWD documents part by part and then for
    one document of each component so far. Then the candidates that these links leave apart are
    compared: pair by pair in buckets of SMALL documents or less, and in larger ones, which may
    be of any size, block by block. Null, empty and blank texts have equal fingerprints and are one
    component. Texts are known by their 64-bit hashes, so rows that share a doc_id may be in
    several components; a component's id is its least doc_id. In `keyed` form: doc_id, key,
    component, where key is the hash of the row's text and component that of one of its texts.
    """
    spark = docs.sparkSession
    docs = common.pick(docs, doc_id="long", text="string").withColumn("key", text_key())
    sure = radius_of(similarity, 64 * WORDS) - 28  # three standard errors and more

    def sketch(batches):
        for whole in batches:
            for b in common.slices(whole, "text", 1 << 20):
                words, keys, sizes = sketches(*common.flat_text(b.column(1)), n)
                blobs = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (words, keys)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *blobs, pa.array(sizes)], ["doc_id", "key", "print", "bands", "size"])

    whole = common.materialize(docs.mapInArrow(common.tidy(sketch), "doc_id long, key long, print binary, bands binary, size long"), "sketches")
    distinct = common.materialize(whole.where("doc_id is not null").groupBy("print", "bands").agg(F.min("key").alias("rep"), F.max("size").alias("size")), "distinct")

    def spread(batches):
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            keys = np.frombuffer(common.flat_text(b.column(0))[0].tobytes(), np.uint64).reshape(-1, BANDS) ^ salt
            row = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *[c.take(row) for c in b.columns[1:]]], ["bucket", *b.schema.names[1:]])

    def buckets(of):
        """The function over columns of whole buckets: bucket, and the others."""

        def run(batches):
            held = []  # what has come of the last bucket, which may go on in the next batch
            for b in batches:
                if not b.num_rows:
                    continue
                now = [np.asarray(c) if pa.types.is_integer(c.type) else common.flat_text(c)[0].copy().view(np.uint64).reshape(-1, WORDS) for c in b.columns]
                if held and now[0][-1] == held[0][0][0]:
                    held.append(now)
                    continue
                now = [np.concatenate(x) for x in zip(*held, now, strict=True)]
                last = int(np.searchsorted(now[0], now[0][-1]))
                held = [[x[last:] for x in now]]
                if last:
                    yield from of(*(x[:last] for x in now))
            if held:
                yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)))

        return common.tidy(run)

    def sizes_of(bucket):
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        return first, np.diff(np.r_[first, len(bucket)])

    def proposals(bucket, rep, points):
        first, size = sizes_of(bucket)
        of = np.repeat(size, size)
        forest = graph.Forest(len(rep))
        for step in range(1, SMALL):  # small buckets, all at once
            a = np.flatnonzero((of[step:] <= SMALL) & (bucket[step:] == bucket[:-step]))
            a = a[distance(points[a], points[a + step]) <= sure] if len(a) else a
            forest.join(a, a + step)
        for f, s in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            forest.join(np.arange(f, f + s), f + link(points[f : f + s], sure))
        on = np.flatnonzero(forest.parent != np.arange(len(rep)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(rep[forest.parent[on]])], ["a", "b"])

    def rest(bucket, rep, size, root):
        first, rows = sizes_of(bucket)
        of = np.repeat(rows, rows)
        for step in range(1, SMALL):
            a = np.flatnonzero((of[step:] <= SMALL) & (bucket[step:] == bucket[:-step]) & (root[step:] != root[:-step]))
            b = a + step
            fit = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
            a, b = rep[a[fit]], rep[b[fit]]
            if len(a):
                yield pair_rows(None, None, None, None, np.maximum(a, b), np.minimum(a, b))
        for f, s in zip(first[rows > SMALL].tolist(), rows[rows > SMALL].tolist(), strict=True):
            if (root[f : f + s] == root[f]).all():
                continue
            for i, j, x, y in blocks(root[f : f + s], size[f : f + s], similarity):
                for side, z in ((0, x),) if i == j else ((0, x), (1, y)):
                    yield pair_rows(bucket[f], i, j, side, rep[f + z], root[f + z])

    def pair_rows(bucket, i, j, side, a, b):
        fixed = [pa.nulls(len(a), k) if v is None else pa.array(np.full(len(a), v), k) for v, k in ((bucket, pa.int64()), (i, pa.int32()), (j, pa.int32()), (side, pa.int32()))]
        return pa.RecordBatch.from_arrays([*fixed, pa.array(a), pa.array(b)], ["bucket", "i", "j", "side", "a", "b"])

    def hashed(batches):
        for whole in batches:
            for b in common.slices(whole, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, n).tobytes() for t in common.texts(b.column(1))], pa.binary())], ["id", "set"])

    # A text that very many rows have is read where it first stands: by id, not by its key alone.
    firsts = common.materialize(whole.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first")), "firsts")

    def sets_of(ids):
        # A sort-merge join at every size: the ids grow with the input and aren't to be broadcast.
        ids = ids.distinct().join(firsts.hint("merge"), "key").withColumnsRenamed({"key": "k"})
        texts = docs.join(ids.hint("merge"), (docs["key"] == ids["k"]) & (docs["doc_id"] == ids["first"]), "left_semi")
        texts = texts.groupBy("key").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        return common.materialize(texts.mapInArrow(common.tidy(hashed), "id long, set binary"), "sets")

    def alike(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs, sets):
        pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
        return pairs.mapInArrow(common.tidy(alike), "a long, b long")

    def joined(table: pa.Table) -> pa.Table:
        side, rep, root = (np.asarray(table.column(c).combine_chunks()) for c in ("side", "a", "b"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set").combine_chunks()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
        both, size = meet(sets, left, right), np.asarray([len(x) for x in sets])
        x, y = np.nonzero((both >= similarity * (size[left][:, None] + size[right][None, :] - both)) & (root[left][:, None] != root[right][None, :]))
        forest = graph.Forest(len(rep))
        forest.join(left[x], right[y])
        on = np.flatnonzero(forest.parent != np.arange(len(rep)))
        return pa.table({"a": rep[on], "b": rep[forest.parent[on]]})

    parts = common.partitions_for(spark, distinct.count() * BANDS * 88, 16 << 20)
    keys = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(COUNTED)) == 0).select("bands", "rep").mapInArrow(common.tidy(spread), "bucket long, rep long")
    counted = keys.groupBy("bucket").agg((F.count("*") * COUNTED).alias("n")).where(F.col("n") > CROWD)
    hot = common.materialize(counted.select("bucket", F.ceil(F.col("n") / CROWD).alias("salts")), "hot")
    crowded = not hot.isEmpty()

    def linked(rows):
        rows = rows.select("bucket", "rep", "print").repartition(parts, "bucket").sortWithinPartitions("bucket", "rep")
        proposed = common.materialize(rows.mapInArrow(buckets(proposals), "a long, b long").groupBy("a").agg(F.min("b").alias("b")), "proposed")
        return common.materialize(verified(proposed, sets_of(proposed.select(F.explode(F.array("a", "b")).alias("key")))), "links")

    dealt = distinct.select("bands", "rep", "print").mapInArrow(common.tidy(spread), "bucket long, rep long, print binary")
    if crowded:  # in parts, so that no task has all of a large bucket; numbers that meet by chance do no harm
        salted = F.xxhash64("bucket", F.pmod(F.xxhash64("rep"), "salts"))
        dealt = dealt.join(hot, "bucket", "left").withColumn("bucket", F.when(F.col("salts").isNull(), F.col("bucket")).otherwise(salted))
    links = linked(dealt)
    labels = graph.components(links)
    if crowded:  # then one document for each component that these links have made in a large bucket
        rows = distinct.join(labels, distinct.rep == labels.node, "left").select("bands", "rep", F.coalesce("root", "rep").alias("root"))
        rows = rows.mapInArrow(common.tidy(spread), "bucket long, rep long, root long").join(hot.select("bucket"), "bucket", "left_semi")
        heads = rows.groupBy("bucket", "root").agg(F.min("rep").alias("rep"))
        links = links.unionByName(linked(heads.join(distinct.select("rep", "print").hint("merge"), "rep")))
        labels = graph.components(links)
    # All candidates that these links leave apart.
    labelled = distinct.join(labels, distinct.rep == labels.node, "left").select("bands", "rep", "size", F.coalesce("root", "rep").alias("root"))
    dealt = labelled.mapInArrow(common.tidy(spread), "bucket long, rep long, size long, root long")
    if crowded:  # large buckets that have become one component have nothing left to compare
        one = dealt.join(hot.select("bucket"), "bucket", "left_semi").groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a = b").select("bucket")
        dealt = dealt.join(common.materialize(one, "done"), "bucket", "left_anti")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "rep")
    apart = common.materialize(dealt.mapInArrow(buckets(rest), "bucket long, i int, j int, side int, a long, b long"), "apart")
    pairs, crowds = apart.where("bucket is null").select("a", "b").distinct(), apart.where("bucket is not null")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(crowds.select(F.col("a").alias("key"))))
    found = verified(pairs, sets).unionByName(crowds.join(sets, crowds.a == sets.id).drop("id").groupBy("bucket", "i", "j").applyInArrow(common.tidy_table(joined), "a long, b long"))
    roots = graph.components(links.unionByName(common.materialize(found, "links")))
    own = distinct.join(roots, distinct.rep == roots.node, "left").select("print", "bands", F.coalesce("root", "rep").alias("component"))
    own = common.materialize(own, "groups")
    found = whole.join(own, ["print", "bands"], "left").select("doc_id", "key", "component")
    if keyed:
        return found
    found = common.materialize(found, "found")
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component", "left").select("doc_id", "component_id")


def op1_simhash_vptree(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
