"""N-gram Jaccard join: which documents reach each other over links of Jaccard similarity >= 3/4.

Sets are the distinct 5-word shingles (64-bit hashes; a wrong equality inside one compared pair has
odds of about 1e-13). The Jaccard distance is a metric; two documents link at distance <= 1/4.

* Equal sets are one point. A point's *prefix* is the part of its set of which any linked set's
  prefix shares at least ``shared_at_least`` shingles, frequent shingles last; that order may be any,
  so the list of frequent shingles only has to be the same for all, and it is bounded (``FREQUENT``).
* Each prefix shingle that several points have leads them into one region. A linked pair meets in some
  region. Points with fewer shared prefix shingles than a link takes drop out before texts move, and a
  point leaves the regions where it shares least, as long as these are less than half of what a link takes.
* In a region all points are measured against a central pivot. Points within 1/4 are linked to it, so
  they need no comparison among themselves. The points outside, with those inside that the
  triangle inequality lets reach them (``d >= nearest outside - 1/4``), form the next region
  with a pivot of their own, until no point is outside. This is exact.
* Regions of at most ``REGION`` shingles recurse inside one task, which streams over regions. Larger
  ones are measured in parts against many pivots at once, which each part has a copy of, and recurse as Spark
  rounds: a point of a ball (that of its nearest pivot) stays only if the window lets it reach a point outside.

Null and empty texts have an empty set and link with nothing. Repeated rows link like other equal
texts. Null ids take part in links but never become a ``component_id`` while another id is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfmark.llm.common import (
    Words, blocks, bytes_of, checked, components, documents, same, signed, text_id, tidy, written,
)

WORDS = 5
# A shingle is frequent from so many documents on; at most FREQUENT_LIMIT of them are told apart.
FREQUENT = 24
FREQUENT_LIMIT = 1 << 20
# Bits of a rare shingle by which points meet: shingles that fall together only bring more points into a region.
MEET_BITS = (1 << 48) - 1
# Shingles of all points together that one task handles as a region.
REGION = 1_500_000
# Pivots of a large region in one round, and their shingles.
PIVOTS = 512
PIVOT_WEIGHT = 800_000
# Texts whose sets are held together, in bytes: a few whole-length arrays of 8 bytes a word stand beside them.
POINT_BLOCK = 4 << 20
# Shingles of the points that are measured against one copy of a pivot.
PART = 400_000

_POINTS = "doc_id long, text_key long, n_shingles long, point long, key binary, central double, token array<long>, times array<int>, token_central array<double>, token_point array<long>"
_PREFIX = "frequent boolean, meet long, point long, times int"


def shingle_sets(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts)
    hashes, first = words.windows(size)
    bounds = np.searchsorted(words.text[first], np.arange(len(texts) + 1))
    offsets = np.concatenate(([0], np.cumsum(words.count)))
    out = []
    for i in range(len(texts)):
        if 0 < words.count[i] < size:
            short = words.hash[offsets[i] : offsets[i + 1]].tobytes()
            out.append(np.frombuffer(blake2b(short, digest_size=8).digest(), np.uint64))
        else:
            out.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
    return out


def key_of(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def point_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def prefix_length(n: int) -> int:
    """Linked sets overlap in 3/4 of either, so prefixes so long share n/16 of the smaller one's n."""
    return n - (3 * n + 3) // 4 + (n + 15) // 16


def shared_at_least(n: Column) -> Column:
    """Prefix shingles a set of n shares with any set it links to, which has 3n/4 shingles or more."""
    return F.ceil(3 * n / 64)


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        texts = bytes_of(batch.column("text"))
        packed = [codec.compress(t, asbytes=True) for t in texts]
        columns = [batch.column("point"), pa.array(packed, pa.binary()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["point", "text", "bytes"])


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    codec = pa.Codec("zstd")
    sizes = batch.column("bytes").to_pylist()
    return [codec.decompress(t, n, asbytes=True) for t, n in zip(batch.column("text").to_pylist(), sizes)]


def _point_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(bytes_of(batch.column("text")), POINT_BLOCK):
                sets = [s for _, some in blocks(texts) for s in shingle_sets(some, size)]
                keys = [key_of(s) for s in sets]
                points = np.array([point_of(k) for k in keys], np.int64)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                values, inverse, times = np.unique(every, return_inverse=True, return_counts=True)
                owner = np.repeat(np.arange(len(sets)), sizes)
                share = np.bincount(owner, np.log2(times)[inverse], len(sets)) / np.maximum(sizes, 1)
                # the most central text of each repeated shingle
                order = np.argsort(-share, kind="stable")
                rank = np.empty(len(sets), np.int64)
                rank[order] = np.arange(len(sets))
                best = np.full(len(values), len(sets), np.int64)
                np.minimum.at(best, inverse, rank[owner])
                often = np.flatnonzero(times >= 3)
                top = order[best[often]] if len(often) else np.zeros(0, np.int64)
                lists = [(signed(values[often]).tolist(), times[often].tolist(), share[top].tolist(), points[top].tolist())]
                lists += [(None,) * 4] * (len(sets) - 1)
                part = batch.slice(first, len(texts))
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(sizes), pa.array(points), pa.array(keys, pa.binary()), pa.array(share)]
                    + [pa.array([row[i] for row in lists], kind) for i, kind in enumerate(kinds)],
                    names=["doc_id", "text_key", "n_shingles", "point", "key", "central", "token", "times", "token_central", "token_point"],
                )

    return run


def _prefix_batches(size: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pivots = frequent.value
        for batch in batches:
            for _, texts in blocks(bytes_of(batch.column("text")), POINT_BLOCK):
                rows: list[list[np.ndarray]] = [[], [], [], []]
                seen = set()
                for _, some in blocks(texts):
                    for shingles in shingle_sets(some, size):
                        if not len(shingles):
                            continue
                        point = point_of(key_of(shingles))
                        if point in seen:
                            continue
                        seen.add(point)
                        own = signed(shingles)
                        at = np.searchsorted(tokens, own)
                        common = np.zeros(len(own), bool)
                        if len(tokens):
                            at[at == len(tokens)] = 0
                            common = tokens[at] == own
                        rare = own[~common]
                        length = prefix_length(len(own))
                        meet = rare[:length]
                        near, times = np.unique(pivots[at[common][: length - len(meet)]], return_counts=True)
                        rows[0].append(np.repeat([False, True], [len(meet), len(near)]))
                        rows[1].append(np.concatenate((meet & MEET_BITS, near)))
                        rows[2].append(np.full(len(meet) + len(near), point, np.int64))
                        rows[3].append(np.concatenate((np.ones(len(meet), np.int32), times.astype(np.int32))))
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r)) for r in rows], names=["frequent", "meet", "point", "times"])

    return run


def _meeting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by meeting key to (region, point, times): points of a rare shingle meet at the first.

    The first point of a shingle comes out only when a second one shows up.
    """
    last, head, alone = None, 0, False
    for batch in batches:
        meet, point, times = (batch.column(c).to_numpy() for c in ("meet", "point", "times"))
        frequent = batch.column("frequent").to_numpy(zero_copy_only=False)
        rare = ~frequent
        n = int(rare.sum())
        parts = [(meet[frequent], point[frequent], times[frequent])]
        if n:
            meet, point = meet[rare], point[rare]
            new = np.concatenate(([meet[0] != last or last is None], meet[1:] != meet[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            first = np.where(start >= 0, point[np.maximum(start, 0)], head)
            second = ~new & np.concatenate(([alone], new[:-1]))
            for keep, who in ((~new, point), (second, first)):
                parts.append((first[keep], who[keep], np.ones(int(keep.sum()), np.int32)))
            last, head, alone = meet[-1], first[-1], bool(new[-1])
        columns = [np.concatenate([p[i] for p in parts]) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["region", "point", "times"])


def region_links(sets: list[np.ndarray], keys: list[bytes], central: list[float]) -> list[tuple[bytes, bytes]]:
    """Links that connect what one region's links connect, fewer than it has points.

    Each round measures the points left against a pivot and keeps those outside or in the window;
    the region is done when these are connected already.
    """
    links = []
    group = np.arange(len(sets))
    active = np.arange(len(sets))
    order = np.array(central)
    held = 2 * len(sets) + 1
    while len(active) > 1 and (group[active] != group[active[0]]).any():
        if 2 * len(active) < held:
            # only the shingles of the points left
            held = len(active)
            sizes = np.fromiter((len(sets[i]) for i in active), np.int64, held)
            _, token = np.unique(np.concatenate([sets[i] for i in active]), return_inverse=True)
            owner = np.repeat(active, sizes)
            ends = dict(zip(active.tolist(), np.cumsum(sizes).tolist()))
            in_pivot = np.zeros(len(token) + 1, bool)
            of_point = np.zeros(len(sets), np.int64)
            of_point[active] = sizes
        pivot = active[np.argmax(order[active])]
        own = token[ends[pivot] - of_point[pivot] : ends[pivot]]
        in_pivot[own] = True
        shared = np.bincount(owner[in_pivot[token]], minlength=len(sets))[active]
        in_pivot[own] = False
        union = of_point[active] + of_point[pivot] - shared
        near = 100 * shared >= 75 * union
        ball = active[near]
        found, first = np.unique(group[ball], return_index=True)
        links += [(keys[pivot], keys[i]) for i in ball[first].tolist() if group[i] != group[pivot]]
        group[np.isin(group, found)] = group[pivot]
        if near.all():
            break
        distance = 1 - shared / np.maximum(union, 1)
        window = distance >= distance[~near].min() - 0.25 - 1e-9
        active = active[(~near | window) & (active != pivot)]
    return links


def _region_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, float]] = []
        current = None

        def flush() -> pa.RecordBatch:
            texts = list(dict(held).items())
            sets = [s for _, some in blocks([t for t, _ in texts]) for s in shingle_sets(some, size)]
            unique = {}
            for shingles, (_, central) in zip(sets, texts):
                unique.setdefault(key_of(shingles), (shingles, central))
            links = region_links([s for s, _ in unique.values()], list(unique), [c for _, c in unique.values()])
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            regions = batch.column("region").to_pylist()
            centrals = batch.column("central").to_pylist()
            for region, text, central in zip(regions, _unpacked(batch), centrals):
                if region != current and held:
                    yield flush()
                    held = []
                current = region
                held.append((text, central))
        if held:
            yield flush()

    return run


def shared_counts(pivots: list[np.ndarray], sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pivot (rows) has in common with each set (columns)."""
    tokens = np.unique(np.concatenate(pivots))
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.searchsorted(tokens, every)
    at[at == len(tokens)] = 0
    known = tokens[at] == every
    at, owner = at[known], owner[known]
    in_pivot = np.zeros(len(tokens), bool)
    out = np.empty((len(pivots), len(sets)), np.int64)
    for i, pivot in enumerate(pivots):
        own = np.searchsorted(tokens, pivot)
        in_pivot[own] = True
        out[i] = np.bincount(owner[in_pivot[at]], minlength=len(sets))
        in_pivot[own] = False
    return out


class _Part:
    """The pivots of one part of a region: what they are linked with, and how near the points outside their balls come."""

    def __init__(self, region: int) -> None:
        self.region = region
        self.points: list[int] = []
        self.sets: list[np.ndarray] = []
        self.keys: list[bytes] = []

    def add(self, point: int, shingles: np.ndarray) -> None:
        self.points.append(point)
        self.sets.append(shingles)
        self.keys.append(key_of(shingles))
        self.group = list(range(len(self.points)))
        self.outside = np.full(len(self.points), np.inf)

    def _root(self, i: int) -> int:
        while self.group[i] != i:
            self.group[i] = i = self.group[self.group[i]]
        return i

    def measure(self, points: list[int], centrals: list[float], sets: list[np.ndarray]) -> list[tuple]:
        """Rows (kind, region, point, central, pivot, distance, a, b): links (0) and measured points (1)."""
        shared = shared_counts(self.sets, sets)
        sizes, own = np.array([len(x) for x in sets]), np.array([len(x) for x in self.sets])[:, None]
        together = own + sizes - shared
        near = 100 * shared >= 75 * together
        distance = 1 - shared / np.maximum(together, 1)
        self.outside = np.minimum(self.outside, np.where(near, np.inf, distance).min(axis=1))
        nearest = distance.argmin(axis=0)
        out = []
        for j, (point, central) in enumerate(zip(points, centrals)):
            close = np.flatnonzero(near[:, j]).tolist()
            pivot = self.points[nearest[j]] if close else None
            out.append((1, self.region, point, central, pivot, float(distance[nearest[j], j]), None, None))
            key = key_of(sets[j]) if close else None
            for i in close:
                # one link to the first, and to those that no other point has connected with it
                first = i == close[0]
                if (first or self._root(i) != self._root(close[0])) and self.keys[i] != key:
                    out.append((0, self.region, None, None, None, None, self.keys[i], key))
                self.group[self._root(i)] = self._root(close[0])
        return out

    def ends(self) -> list[tuple]:
        """Rows of kind 2: how near points outside a pivot's ball come."""
        return [(2, self.region, None, None, p, float(d), None, None) for p, d in zip(self.points, self.outside) if d < np.inf]


_MEASURED = "kind int, region long, point long, central double, pivot long, distance double, a binary, b binary"
_MEASURED_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())


def _measure_batches(size: int):
    names = [field.split()[0] for field in _MEASURED.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_MEASURED_TYPES)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, part = None, None
        for batch in batches:
            places = list(zip(batch.column("region").to_pylist(), batch.column("part").to_pylist(), batch.column("role").to_pylist()))
            points, centrals = batch.column("point").to_pylist(), batch.column("central").to_pylist()
            for first, texts in blocks(_unpacked(batch)):
                sets = shingle_sets(texts, size)
                start = first
                while start < first + len(texts):
                    end = start
                    while end < first + len(texts) and places[end] == places[start]:
                        end += 1
                    region, number, role = places[start]
                    if (region, number) != place:
                        if part is not None:
                            yield batch_of(part.ends())
                        place, part = (region, number), _Part(region)
                    some = sets[start - first : end - first]
                    if role == 0:
                        # the pivots come first in each part
                        for point, shingles in zip(points[start:end], some):
                            part.add(point, shingles)
                    else:
                        yield batch_of(part.measure(points[start:end], centrals[start:end], some))
                    start = end
        if part is not None:
            yield batch_of(part.ends())

    return run


def _frequent(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles with a central point each, sorted; at most ``FREQUENT_LIMIT``."""
    counted = written(
        points.where(F.size("token") > 0)
        .select(F.explode(F.arrays_zip("token", "times", "token_central", "token_point")).alias("t"))
        .groupBy(F.col("t.token").alias("token"))
        .agg(
            F.sum("t.times").alias("times"),
            F.max(F.struct("t.token_central", "t.token_point"))["token_point"].alias("pivot"),
        )
    )
    least = FREQUENT
    while counted.where(F.col("times") >= least).count() > FREQUENT_LIMIT:
        least *= 2
    rows = counted.where(F.col("times") >= least).orderBy("token").toArrow()
    return rows.column("token").to_numpy(), rows.column("pivot").to_numpy()


def _measured(regions: DataFrame, texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(measures, pivots (region, point)) of large regions: all points against many pivots, in parts of bounded size.

    The most central point and some even in the hash order are pivots, as many as ``PIVOTS`` or ``PIVOT_WEIGHT`` allows.
    """
    heads = written(
        regions.groupBy("region").agg(
            F.max(F.struct("central", "point"))["point"].alias("best"), F.ceil(F.sum("n") / PART).cast("int").alias("parts"),
            F.greatest(F.ceil(F.count(F.lit(1)) / PIVOTS), F.ceil(F.sum("n") / PIVOT_WEIGHT)).cast("bigint").alias("every"), F.count(F.lit(1)).alias("m"),
        )
    )
    joined = written(regions.join(heads, "region"))
    # the number of points salts the choice, as it falls in every round
    chosen = (F.col("point") == F.col("best")) | (F.pmod(F.xxhash64("point", "m"), F.col("every")) == 0)
    pivots = written(joined.where(chosen).select("region", "point", "parts"))
    members = joined.select(
        "region", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "point", "central"
    )
    copies = pivots.select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "point", F.lit(0.0).alias("central"))
    rows = members.union(copies).join(texts, "point").select("region", "part", "role", "point", "central", "text", "bytes")
    measures = written(
        rows.repartition("region", "part").sortWithinPartitions("region", "part", "role").mapInArrow(tidy(_measure_batches(size)), _MEASURED)
    )
    return measures, pivots.select("region", "point")


def _met(docs: DataFrame, points: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(regions, the points in them): (region, point, n, central) and (point, n, central, doc_id, text_key)."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(points))
    met = (
        docs.select("text").mapInArrow(tidy(_prefix_batches(size, frequent)), _PREFIX)
        .repartition(F.when(F.col("frequent"), F.xxhash64("meet", "point")).otherwise(F.col("meet")))
        .sortWithinPartitions("frequent", "meet", "point")
        .mapInArrow(tidy(_meeting_batches), "region long, point long, times int")
    )
    # equal sets in several tasks are counted several times, which only lets more points stay
    pairs = written(met.groupBy("region", "point").agg(F.sum("times").alias("times")))
    shared = written(pairs.groupBy("point").agg(F.sum("times").alias("shared")))
    chosen = points.where("n_shingles > 0").groupBy("point").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.max("n_shingles").alias("n"), F.max("central").alias("central")
    )
    info = chosen.join(shared, "point").where(F.col("shared") >= shared_at_least(F.col("n")))
    info = written(info.select("point", "n", "central", "first.doc_id", "first.text_key"))
    regions = pairs.join(checked(info.select("point", "n", "central")), "point")
    return written(_telling(regions)), info


def _telling(regions: DataFrame) -> DataFrame:
    """``regions`` (region, point, n, central, times) without those in which a point shares too little to be missed.

    A pair that links has S prefix shingles in common, or more, where S is ``shared_at_least`` of either. If each side
    leaves regions in which it shares fewer than S / 2 in all, fewer than S common ones go, so the pair still meets.
    """
    rising = Window.partitionBy("point").orderBy("times", "region").rowsBetween(Window.unboundedPreceding, 0)
    summed = regions.withColumn("sum", F.sum("times").over(rising))
    return summed.where(2 * F.col("sum") >= shared_at_least(F.col("n"))).select("region", "point", "n", "central")


def jaccard_points(docs: DataFrame, size: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(points, links): a row per document with its set's key, and links between keys."""
    keyed = docs.select("doc_id", "text", text_id().alias("text_key"))
    points = written(keyed.mapInArrow(tidy(_point_batches(size)), _POINTS))
    regions, info = _met(docs, points, size)
    wanted = checked(info.select("point", "doc_id", "text_key"))
    texts = written(keyed.join(wanted, same(keyed, wanted, ["doc_id", "text_key"])).select("point", "text").mapInArrow(tidy(_pack_batches), "point long, text binary, bytes long"))
    if not texts.groupBy("point").count().where("count > 1").isEmpty():
        texts = written(texts.dropDuplicates(["point"]))
    small, links = [], []
    while True:
        weights = written(regions.groupBy("region").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("m")).where("m > 1"))
        fits = weights.where(F.col("weight") <= REGION).select("region")
        small.append(regions.join(fits, "region", "left_semi").select("region", "point", "central"))
        large = weights.where(F.col("weight") > REGION).select("region")
        if large.isEmpty():
            break
        found, pivots = _measured(regions.join(large, "region", "left_semi"), texts, size)
        links.append(found.where("kind = 0").select("a", "b"))
        reach = written(found.where("kind = 2").groupBy("region", "pivot").agg(F.min("distance").alias("outside")))
        # a point stays if it is in no ball, or may reach a point outside of its pivot's; pivots are done
        measured = found.where("kind = 1").select("region", "point", "pivot", "distance").join(pivots, ["region", "point"], "left_anti")
        held = measured.join(reach, ["region", "pivot"], "left")
        left = held.where(F.col("pivot").isNull() | (F.col("distance") >= F.col("outside") - 0.25 - 1e-9))
        regions = written(left.select("region", "point").join(info.select("point", "n", "central"), "point"))
    every = small[0]
    for more in small[1:]:
        every = every.union(more)
    links.append(
        every.join(texts, "point").select("region", "central", "text", "bytes")
        .repartition("region").sortWithinPartitions("region")
        .mapInArrow(tidy(_region_batches(size)), "a binary, b binary")
    )
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return points.select("doc_id", "text_key", "n_shingles", "key"), out


def jaccard_components(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    points, links = jaccard_points(docs, size)
    roots = components(links)
    # without a link, the key is its own root; an empty set never links, its id is its class
    keyed = points.where("n_shingles > 0").join(written(roots), F.col("key") == F.col("node"), "left")
    rooted = written(keyed.select("doc_id", "text_key", "n_shingles", F.coalesce("root", "key").alias("root")))
    first = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    alone = points.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return rooted.join(first, "root").select("doc_id", "text_key", "n_shingles", "component_id").union(alone)


def keep_one_each(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """Documents without those that reach a smaller id; of repeated rows one stays."""
    classes = written(jaccard_components(docs, size))
    extra = classes.where(~F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("n_shingles") > 0))
    gone = checked(written(extra.select(F.col("doc_id").alias("_llm_gone"), F.col("text_key").alias("_llm_key")).distinct()))
    keyed = docs.withColumn("_llm_text_key", text_id())
    matched = F.col("doc_id").eqNullSafe(F.col("_llm_gone")) & (F.col("_llm_text_key") == F.col("_llm_key"))
    kept = keyed.join(gone, matched, "left_anti")
    # within a class, rows that share the smallest id (repeated rows, or none has an id)
    tied = classes.where((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    tied = written(tied.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if tied.isEmpty():
        return kept.drop("_llm_text_key")
    marked = tied.withColumn("_llm_tied", F.lit(True)).withColumnRenamed("doc_id", "_llm_id")
    labelled = kept.join(marked, F.col("doc_id").eqNullSafe(F.col("_llm_id")), "left").drop("_llm_id")
    loose = labelled.where("_llm_tied is null").drop("_llm_tied", "_llm_text_key")
    once = labelled.where("_llm_tied").drop("_llm_tied").dropDuplicates(["doc_id", "_llm_text_key"]).drop("_llm_text_key")
    return loose.unionByName(once)


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(documents(spark, folder)).drop("text_key")
