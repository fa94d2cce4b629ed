"""Relationships of all tracks of a video, block by block.

In a crowded video most tracks meet, and a row for each frame that two of them share is far more
than the input. So tracks are dealt to blocks in the order of their numbers, a task gets the
observations of two blocks (packed, once for each block that theirs meets), and the pairs of the
two are compared frame by frame in memory; what leaves a task is one row for each related pair, or
one for each kind of pair where these are only counted. Nothing is left out: all pairs that share
a frame are compared.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import vocabulary as V
from trackloom.operators import events, pairs
from trackloom.operators.tracks import KEY, keyed
from trackloom.plans import staging

#: Observations of a block, tracks of a side of a tile, pairs whose frames are met at once.
BLOCK, TILE, PAIRS = 1 << 19, 4096, 1 << 14
#: Columns of packed observations: what any comparison needs, and what only rows of pairs do.
_PLACES, _BOXES = ["at", "frame_rank"], ["x1", "y1", "x2", "y2"]
_WHOLE, _REAL = ["frame_index", "track_pos", "obs_pos"], ["timestamp_seconds"]
_ROWS = (
    "video_id string, track_a_id bigint, track_b_id bigint, track_a_class string, track_b_class string, way_a string, way_b string, shared_frames bigint, near_frames bigint, "
    "overlap_frames bigint, average double, least double, iou double, first_frame bigint, last_frame bigint, first_timestamp double, last_timestamp double, came bigint, number bigint, relationship_types array<string>"
)
_NUMBERS = "video_id string, track_a_id bigint, at bigint, j bigint, n bigint"
_TALLIES = "video_id string, track_a_class string, track_b_class string, shared_frames bigint, near_frames bigint, overlap_frames bigint, together boolean, n bigint"


def _squeeze(whole, real) -> bytes:
    """Columns as bytes, compressed. Real columns are kept exactly: as whole numbers if all are,
    as places in the list of their values if these are few, else by their bits. Whole numbers go
    by their steps, and all by bytes of one weight together."""
    import numpy as np

    parts = []
    for c in [*whole, *real]:
        kind, values = b"w", c
        if c.dtype.kind == "f":
            bits = np.ascontiguousarray(c).view(np.int64)
            small = np.abs(c) < 2.0**53
            rounded = np.where(small, c, 0.0).astype(np.int64)
            of, places = np.unique(bits, return_inverse=True)
            if (rounded.astype(np.float64).view(np.int64) == bits).all():
                kind, values = b"r", rounded
            elif 4 * len(of) <= len(c):
                kind, values = b"v" + struct.pack("<q", len(of)) + of.tobytes(), places.astype(np.int64)
            else:
                kind, values = b"b", None
        if values is None:
            steps = bits
        else:
            steps = np.diff(values, prepend=np.int64(0))
            steps = (steps << 1) ^ (steps >> 63)  # the sign in the lowest bit, so that high bytes are 0
        parts += [kind, np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8).T.tobytes()]
    return struct.pack("<q", len([*whole, *real][0])) + zlib.compress(b"".join(parts), 1)


def _open(data, whole: int, real: int):
    """The columns of squeezed runs: whole numbers, then real ones."""
    import numpy as np

    runs = [[] for _ in range(whole + real)]
    for one in data:
        (n,), raw, at = struct.unpack("<q", one[:8]), zlib.decompress(one[8:]), 0
        for c in runs:
            kind, of, at = raw[at : at + 1], None, at + 1
            if kind == b"v":
                (k,) = struct.unpack_from("<q", raw, at)
                of, at = np.frombuffer(raw, np.int64, k, at + 8), at + 8 + 8 * k
            values = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel()
            at += 8 * n
            if kind != b"b":
                values = np.cumsum((values >> 1 & np.int64(2**63 - 1)) ^ -(values & 1))
            c.append(of[values] if of is not None else values.astype(np.float64).view(np.int64) if kind == b"r" else values)
    columns = []
    while runs:
        columns.append(np.concatenate(runs.pop(0)))
    return columns[:whole], [c.view(np.float64) for c in columns[whole:]]


def _pack(batches):
    """Runs of rows of one block -> a row with their columns, compressed."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        video, k = b.column("video_id"), b.column("k").to_numpy(zero_copy_only=False)
        codes = video.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(k) != 0)) + 1).tolist(), b.num_rows]
        whole = lambda names: [b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
        real = lambda names: [b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]
        at = pa.array(cuts[:-1])
        columns = [video.take(at), pa.array(k[cuts[:-1]], pa.int64())]
        for w, r in ((whole(_PLACES), real(_BOXES)), (whole(_WHOLE), real(_REAL))):
            columns.append(pa.array([_squeeze([c[s:e] for c in w], [c[s:e] for c in r]) for s, e in zip(cuts, cuts[1:])], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["video_id", "k", "data", "more"])


class _Tiles:
    """Observations in the order of tiles and frames, with where each frame of a tile is."""

    def __init__(self, unit, rank, boxes, more, start: int, stop: int):
        import numpy as np

        self.start, self.stop, self.parts = start, stop, []
        mine = np.flatnonzero((unit >= start) & (unit < stop))
        order = mine[np.lexsort((unit[mine], rank[mine], (unit[mine] - start) // TILE))]
        self.unit, self.rank = unit[order], rank[order]
        self.x1, self.y1, self.x2, self.y2 = (c[order] for c in boxes)
        self.frame, self.track_pos, self.obs_pos, self.seconds = (c[order] for c in more) if more else [None] * 4
        self.cx, self.cy = (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2
        self.area = np.maximum(0.0, self.x2 - self.x1) * np.maximum(0.0, self.y2 - self.y1)
        tile = (self.unit - start) // TILE
        for t in range(-(-(stop - start) // TILE)):
            lo, hi = np.searchsorted(tile, [t, t + 1])
            ranks, first = np.unique(self.rank[lo:hi], return_index=True)
            self.parts.append((start + t * TILE, min(TILE, stop - start - t * TILE), ranks, np.append(first, hi - lo) + lo))


def _presence(x, first: int, n: int, spans, side: int, twice: bool):
    """For each track of a tile, in which of the frames it is: bits, or how often where a track
    may stand in a frame twice."""
    import numpy as np

    seen = np.zeros((n, -(-len(spans) // 64) * 64), np.int64 if twice else np.uint8)
    for c, span in enumerate(spans):
        u = x.unit[span[side] : span[side + 1]] - first
        if twice:
            np.add.at(seen[:, c], u, 1)
        else:
            seen[u, c] = 1
    return seen if twice else np.packbits(seen, axis=1).view(np.uint64)


def _shared(here, there, i, j, twice: bool):
    """How many frames the tracks i of one side share with the tracks j of the other."""
    import numpy as np

    out, step = np.empty(len(i), np.int64 if twice else np.int32), max(1, PAIRS * 32 // max(32, here.shape[1]))
    for s in range(0, len(i), step):
        one, two = here[i[s : s + step]], there[j[s : s + step]]
        if twice:
            out[s : s + step] = (one * two).sum(1)
        else:
            np.bitwise_and(one, two, out=one)
            out[s : s + step] = np.bitwise_count(one).sum(1, dtype=np.int32)
    return out


def _tile(a, b, s, t, ways, ids, p, counts: bool):
    """Related pairs of tile s of a and tile t of b, with their statistics; without those of
    distances and frames if they are only counted."""
    import numpy as np

    (a0, na, ra, ia), (b0, nb, rb, ib) = a.parts[s], b.parts[t]
    _, fa, fb = np.intersect1d(ra, rb, assume_unique=True, return_indices=True)
    if not len(fa):
        return None
    spans = list(zip(ia[fa].tolist(), ia[fa + 1].tolist(), ib[fb].tolist(), ib[fb + 1].tolist()))
    twice = p["twice"] and any(((x.unit[lo + 1 : hi] == x.unit[lo : hi - 1]) & (x.rank[lo + 1 : hi] == x.rank[lo : hi - 1])).any() for x, lo, hi in ((a, ia[0], ia[-1]), (b, ib[0], ib[-1])))
    # A cell has the near frames of a pair in its low bits, those with an overlap in the high ones.
    most = min(np.bincount(x.unit[lo:hi] - x0).max() for x, lo, hi, x0 in ((a, ia[0], ia[-1], a0), (b, ib[0], ib[-1], b0)))
    bits, kind = (32, np.uint64) if twice or most > 65535 else (16, np.uint32) if most > 255 else (8, np.uint16)
    acc, one = np.zeros(na * nb, kind), kind(1 << bits)
    near2 = (p["near"] * p["diag"]) ** 2 * (1 + 1e-9)
    half = lambda x, lo, hi: ((x.x2[lo:hi] - x.x1[lo:hi]).max() / 2, (x.y2[lo:hi] - x.y1[lo:hi]).max() / 2)
    wa, ha, wb, hb = *half(a, ia[0], ia[-1]), *half(b, ib[0], ib[-1])
    reach = max(near2, (max(0.0, wa + wb) ** 2 + max(0.0, ha + hb) ** 2) * (1 + 1e-9))  # boxes that overlap have their centers nearer than that
    for x, y, z, w in spans:
        d2, dy = b.cx[z:w] - a.cx[x:y, None], b.cy[z:w] - a.cy[x:y, None]
        d2 *= d2
        dy *= dy
        d2 += dy
        close = np.flatnonzero(d2 <= reach)
        if not len(close):
            continue
        i = close // (w - z)
        j = close - i * (w - z)
        near = np.sqrt(d2.ravel()[close]) / p["diag"] <= p["near"]
        i += x
        j += z
        wide = np.minimum(a.x2[i], b.x2[j]) - np.maximum(a.x1[i], b.x1[j])
        high = np.minimum(a.y2[i], b.y2[j]) - np.maximum(a.y1[i], b.y1[j])
        over = (wide > 0) & (high > 0) & (wide * high > 0) & (a.area[i] + b.area[j] - wide * high > 0)
        cell, more = (a.unit[i] - a0) * nb + (b.unit[j] - b0), near + over * one
        if twice:
            np.add.at(acc, cell, more.astype(kind))
        else:
            acc[cell] += more.astype(kind)
    least = [math.ceil(pairs.NEAR * p["shared"]), math.ceil(pairs.TOGETHER_FRAMES * (1 - p["together"] / p["near"])) if p["near"] > p["together"] else 0]
    low = kind((1 << bits) - 1)
    cells = np.flatnonzero(((acc & low) >= max(1, min(least))) | (acc >= one * kind(max(1, math.ceil(pairs.OVER * p["shared"])))))
    found = acc[cells]
    del acc
    i, j = (c.astype(np.int32) for c in np.divmod(cells, nb))
    right = (i + a0 < j + b0) & (ids[i + a0] != ids[j + b0])
    cells, found, i, j = (c[right] for c in (cells, found, i, j))
    near_n, over_n = (x.astype(np.int64 if twice else np.int32) for x in (found & low, found >> kind(bits)))
    count = _shared(_presence(a, a0, na, spans, 0, twice), _presence(b, b0, nb, spans, 2, twice), i, j, twice)
    way_a, way_b = ways[i + a0], ways[j + b0]
    part = 1 - p["together"] / p["near"] - 1e-9 if p["near"] > p["together"] else -1.0
    alike = (way_a == way_b) & (way_a >= 0) & (count >= pairs.TOGETHER_FRAMES)
    named = (near_n / count >= pairs.NEAR) | (over_n / count >= pairs.OVER)
    keep = (count >= p["shared"]) & (named | (alike & (near_n / count >= part)))
    cells, i, j, near_n, over_n, count, alike, named = (c[keep] for c in (cells, i, j, near_n, over_n, count, alike, named))
    m = len(cells)
    if not m:
        return None
    # Frames of pairs are met again for what rows say of them; of counted ones for the mean that those need which move together.
    wanted = np.flatnonzero(alike) if counts else np.arange(m)
    said = 0 if counts else m
    total, nearest, iou, came = np.zeros(m), np.full(said, np.inf), np.zeros(said), np.full(said, -1, np.int64)
    first, last, first_s, last_s = np.zeros(said, np.int64), np.zeros(said, np.int64), np.zeros(said), np.zeros(said)
    nth, asked = np.full(na * nb, -1, np.int32), np.zeros(na * nb, bool)
    nth[cells[wanted]], asked[cells[wanted]] = wanted, True
    for x, y, z, w in spans if len(wanted) else ():
        cell = (((a.unit[x:y] - a0) * nb)[:, None] + (b.unit[z:w] - b0)).ravel()
        at = np.flatnonzero(asked[cell])
        if not len(at):
            continue
        n = nth[cell[at]]
        i_, j_ = np.divmod(at, w - z)
        i_, j_ = i_ + x, j_ + z
        dx, dy = b.cx[j_] - a.cx[i_], b.cy[j_] - a.cy[i_]
        d = np.sqrt(dx * dx + dy * dy) / p["diag"]
        if twice:
            np.add.at(total, n, d)
        else:
            total[n] += d
        if counts:
            continue
        inter = np.maximum(0.0, np.minimum(a.x2[i_], b.x2[j_]) - np.maximum(a.x1[i_], b.x1[j_])) * np.maximum(0.0, np.minimum(a.y2[i_], b.y2[j_]) - np.maximum(a.y1[i_], b.y1[j_]))
        union = a.area[i_] + b.area[j_] - inter
        u = np.where(union <= 0, 0.0, inter / np.where(union <= 0, 1.0, union))
        if twice:
            np.minimum.at(nearest, n, d)
            np.maximum.at(iou, n, u)
        else:
            nearest[n] = np.minimum(nearest[n], d)
            iou[n] = np.maximum(iou[n], u)
        ours = (a.track_pos[i_] < b.track_pos[j_]) | ((a.track_pos[i_] == b.track_pos[j_]) & (a.obs_pos[i_] < b.obs_pos[j_]))
        seconds, new = np.where(ours, a.seconds[i_], b.seconds[j_]), came[n] < 0
        first[n[new]], first_s[n[new]], came[n[new]] = a.frame[x], seconds[new], a.rank[x]
        last[n], last_s[n] = a.frame[x], seconds
    mean = total / count
    together = alike & (mean <= p["together"])
    ok = named | together
    i, j, count, near_n, over_n = (c.astype(np.int64) for c in (i, j, count, near_n, over_n))
    head = [i + a0, j + b0, count, near_n, over_n, together]
    return [c[ok] for c in (head if counts else [*head, mean, np.minimum(1.0, nearest), iou, first, last, first_s, last_s, came])]


#: What a task says of two blocks: a row for each pair; how many pairs each track has; how many are alike in all that is counted.
ROWS, NUMBERS, TALLIES = _ROWS, _NUMBERS, _TALLIES
#: Rows of a batch that leaves a task.
BATCH = 1 << 14


def _compare(p, what: str):
    import pyarrow as pa

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds_of = pa.array([[k for b, k in enumerate(pairs.KINDS) if n >> b & 1] for n in range(1 << len(pairs.KINDS))], pa.list_(pa.string()))
        table = pa.Table.from_batches(list(batches))
        i, j, video = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("video_id")[0]
        left, right = table.filter(table.column("data").is_valid()), table.filter(table.column("data").is_null()).sort_by("at").combine_chunks()
        del table
        at, k, ids = (right.column(c).to_numpy() for c in ("at", "k", "track_id"))
        ways_of, ways = np.unique(right.column("direction").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        codes = np.where(np.isin(ways_of, ["unknown", "stationary"]), -1, np.arange(len(ways_of)))[ways]
        (place, rank), boxes = _open(left.column("data").to_pylist(), len(_PLACES), len(_BOXES))
        more = sum(_open(left.column("more").to_pylist(), len(_WHOLE), len(_REAL)), []) if what == ROWS else None
        unit, cut = np.searchsorted(at, place), int(np.searchsorted(k, i, "right"))
        a = _Tiles(unit, rank, boxes, more, 0, cut)
        b = a if i == j else _Tiles(unit, rank, boxes, more, cut, len(at))
        del left, place, rank, boxes, more, unit
        names = [x.split()[0] for x in what.split(", ")]
        for s in range(len(a.parts)):
            found = [x for t in range(s if i == j else 0, len(b.parts)) if (x := _tile(a, b, s, t, codes, ids, p, what != ROWS))]
            if not found:
                continue
            ua, ub, *rest = (np.concatenate(c) for c in zip(*found))
            del found
            if what == NUMBERS:
                who, n = np.unique(ua, return_counts=True)
                yield pa.record_batch([pa.repeat(video, len(who)), pa.array(ids[who]), pa.array(at[who]), pa.array(np.full(len(who), j, np.int64)), pa.array(n.astype(np.int64))], names=names)
                continue
            text = lambda name, u: right.column(name).take(pa.array(u)).combine_chunks()
            if what == TALLIES:
                alike = pa.table([text("class_name", ua), text("class_name", ub), *map(pa.array, rest[:4])], names=names[1:-1])
                alike = alike.group_by(names[1:-1]).aggregate([([], "count_all")]).combine_chunks()
                yield from pa.table([pa.repeat(video, len(alike)), *[alike.column(c) for c in names[1:-1]], alike.column("count_all")], names=names).to_batches(BATCH)
                continue
            order = np.lexsort((ub, ua))
            starts = np.flatnonzero(np.r_[True, np.diff(ua[order]) != 0])
            nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            before = right.column("before").fill_null(0).to_numpy() if p["numbered"] else None
            classes = right.column("class_name").to_numpy(zero_copy_only=False).astype(str)
            human, vehicle = np.isin(classes, list(V.HUMAN)), np.isin(classes, list(V.VEHICLE_PAIRS))
            for o in range(0, len(order), BATCH):
                here = order[o : o + BATCH]
                u, v, *c = (x[here] for x in (ua, ub, *rest))
                number = pa.array(before[u] + nth[o : o + BATCH] + 1) if p["numbered"] else pa.nulls(len(here), pa.int64())
                columns = [pa.repeat(video, len(here)), ids[u], ids[v], text("class_name", u), text("class_name", v), text("direction", u), text("direction", v), *c[:3], *c[4:9]]
                near = c[1] / c[0] >= pairs.NEAR
                mixed = (human[u] & vehicle[v]) | (human[v] & vehicle[u])
                kinds = kinds_of.take(pa.array(near + 2 * (c[2] / c[0] >= pairs.OVER) + 4 * (mixed & near) + 8 * c[3]))
                columns += [pa.array(c[9], from_pandas=True), pa.array(c[10], from_pandas=True), c[11], number, kinds]
                yield pa.record_batch([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=names)

    # Batches of the result leave one by one, as the groups' functions on iterators do.
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


@dataclass
class Blocks:
    """Tracks of usable observations dealt to blocks, and which blocks meet."""

    packed: DataFrame
    units: DataFrame
    members: DataFrame
    settings: dict

    def _groups(self, what: str, before: DataFrame | None = None) -> DataFrame:
        on, spark = ["video_id", "k"], self.packed.sparkSession
        units = self.units.join(self.members, on)
        if before is not None:
            units = units.join(before, ["video_id", "at", "j"], "left")
        packed = self.packed if what == ROWS else self.packed.drop("more")
        both = packed.join(self.members, on).unionByName(units, allowMissingColumns=True)
        # By their number: pairs of blocks are few and take long, so small partitions aren't to be joined.
        dealt = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video_id", "i", "j")
        return dealt.groupBy("video_id", "i", "j").applyInArrow(_compare({**self.settings, "numbered": before is not None}, what), what)

    def rows(self, before: DataFrame | None = None) -> DataFrame:
        """Statistics of the related pairs. before: how many events stand before those of a track
        (at) with the tracks of a block (j); then `number` goes on from there."""
        return self._groups(ROWS, before)

    def counts(self) -> DataFrame:
        """Related pairs of each track with the tracks of each block."""
        return self._groups(NUMBERS)

    def relationships(self, before: DataFrame | None = None) -> DataFrame:
        return pairs.of_kinds(self.rows(before), *(["number"] if before is not None else []))

    def tallies(self) -> DataFrame:
        """Relationships without tracks, distances and frames: one row, with their number n, for
        all pairs that are alike in the rest."""
        none = dict(x.split() for x in _ROWS.split(", "))
        rows = self._groups(TALLIES).withColumn("average", F.lit(0.0))
        rows = rows.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in none.items() if c not in [*rows.columns, "relationship_types"]])
        return pairs.named(rows, F.col("together"), self.settings["together"], "n")


def deal(obs: DataFrame, moved: DataFrame, width: int, height: int, near: float = 0.08, shared: int = 3, together: float = pairs.TOGETHER, block: int = BLOCK) -> Blocks:
    o = pairs.framed(obs).where("track_id IS NOT NULL").withColumn("class_name", F.coalesce("class_name", F.lit("unknown")))
    one = ["video_id", "track_id", "class_name"]
    units = o.groupBy(*one).agg(F.count("*").alias("n"), F.count_distinct("frame_index").alias("frames"), F.min("frame_index").alias("first"), F.max("frame_index").alias("last"))
    units = events.positions(units, [F.col("track_id"), F.col("class_name")], ["video_id"], "at", "n").withColumn("k", F.floor((F.col("at") - 1) / block))
    ways = keyed(moved).groupBy(*KEY).agg(F.min("direction").alias("direction"))
    units = staging.staged(units.join(ways, KEY, "left").withColumn("direction", F.coalesce("direction", F.lit("unknown"))), "units")
    ends = units.groupBy("video_id", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    side = lambda s: ends.select("video_id", F.col("k").alias(s), F.col("first").alias(f"{s}_first"), F.col("last").alias(f"{s}_last"))
    meet = side("i").join(side("j"), "video_id").where("i <= j AND i_first <= j_last AND j_first <= i_last")
    members = meet.select("video_id", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("k"))
    members = staging.staged(members, "members")
    rows = o.join(units.select(*one, "at", "k"), one).select("video_id", "k", *_PLACES, *_BOXES, *_WHOLE, *_REAL)
    packed = rows.repartition("video_id", "k").sortWithinPartitions("video_id", "k", "at", "frame_rank").mapInArrow(_pack, "video_id string, k bigint, data binary, more binary")
    packed = staging.staged(packed, "packed")
    settings = {"near": near, "shared": shared, "together": together, "diag": G.diagonal(width, height), "twice": bool(units.where("n > frames").limit(1).count())}
    return Blocks(packed, units.select("video_id", "k", "track_id", "class_name", "direction", "at"), members, settings)
