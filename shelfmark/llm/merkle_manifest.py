"""Merkle dataset manifest: digests of rows, a tree per source, a tree of the trees, and proofs by octopus multiproof.

A leaf is H (lowercase hex SHA-256 of the joined inputs) of its fields, each ``-`` if null, else its UTF-8 byte
count, ``:`` and the value. A source's leaves ascend by id; every ``ARITY`` consecutive nodes (the last run: fewer,
even one) become their H until one is left, the subroot. Subroots in the order of their sources (null first,
bytewise) are the leaves of the top tree, whose last node is the root.

Places in a tree come from a range-partitioned sort, so that a source may hold any share of the rows. Nodes are
built in rounds of six levels: aligned blocks of 729 nodes are complete subtrees and
meet in one task each. Proofs are made by leaf partition (any partition of any leaves does): a partition computes the
minimal union of node coordinates that all its proofs need and its own leaves don't yield, fetches them once with
a join, derives the interiors its leaves share, and expands one proof per leaf.

Null ids come first, rows with the same id in the order of their leaf digests; rows equal in all fields each get a place.
Empty texts have byte count 0. Columns that are no fields don't count. An empty table gives no rows and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.llm.common import documents, held_back, place, same, sorted_runs, written

ARITY = 3
# Levels built in one round.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The number of the tree whose leaves are the subroots.
TOP = -1


@dataclass
class Manifest:
    """``leaves``: tree, size (leaves of the tree), pos, _part, doc_id, leaf, shown. ``nodes``: tree, level, pos, digest.

    ``trees``: number of sources; ``root``: hex digest, None for an empty table.
    """

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def digest(fields: list[Column]) -> Column:
    """H of some columns, 32 bytes."""
    texts = [c.cast("string") for c in fields]
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def without_newlines(docs: DataFrame) -> dict[str, Column]:
    """The tampering of the query: where 2 divides the id's CRC-32, the text has lost its line feeds."""
    return {"text": F.when(held_back(2, 0), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def _parent(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests)).hexdigest().encode()


def _up(size: int) -> int:
    return -(-size // ARITY)


# ---- building --------------------------------------------------------------------------------


def _climb(tree: np.ndarray, size: np.ndarray, pos: np.ndarray, digests: list[bytes]) -> Iterator[tuple]:
    """(step, tree, size, pos, digests) of the levels above complete blocks of nodes sorted by tree and place."""
    for step in range(1, LEVELS + 1):
        inner = np.flatnonzero(size > 1)
        tree, size, pos, digests = tree[inner], size[inner], pos[inner] // ARITY, [digests[i] for i in inner]
        if not len(tree):
            return
        starts = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (pos[1:] != pos[:-1]))))
        ends = np.append(starts[1:], len(tree))
        digests = [_parent(digests[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        tree, size, pos = tree[starts], -(-size[starts] // ARITY), pos[starts]
        yield step, tree, size, pos, digests


_BUILT = pa.schema([("tree", pa.int64()), ("step", pa.int32()), ("size", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary())])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes above the sorted nodes of a task; the last block of a batch waits for the rest of it."""
    block = ARITY**LEVELS
    held: pa.Table | None = None

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, size, pos = (table.column(c).to_numpy() for c in ("tree", "size", "pos"))
        for step, t, s, p, d in _climb(tree, size, pos, [x.hex().encode() for x in table.column("digest").to_pylist()]):
            raw = pa.array([bytes.fromhex(x.decode()) for x in d], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), step, np.int32)), pa.array(s), pa.array(p), raw], schema=_BUILT)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        tree, pos = table.column("tree").to_numpy(), table.column("pos").to_numpy() // block
        last = int(np.flatnonzero((tree == tree[-1]) & (pos == pos[-1]))[0])
        held = table.slice(last)
        if last:
            yield from emit(table.slice(0, last))
    if held is not None:
        yield from emit(held)


def grow(leaves: DataFrame, largest: int) -> DataFrame | None:
    """(tree, level, pos, digest) of all nodes above ``leaves`` (tree, size, pos, digest), None if there are none."""
    base, level, out = leaves.select("tree", "size", "pos", "digest"), 0, None
    while largest > 1:
        block = F.floor(F.col("pos") / ARITY**LEVELS)
        built = written(
            base.where("size > 1").repartition("tree", block).sortWithinPartitions("tree", "pos")
            .mapInArrow(_build, "tree long, step int, size long, pos long, digest binary")
        )
        nodes = built.select("tree", (F.col("step") + level).alias("level"), "pos", "digest")
        out = nodes if out is None else out.union(nodes)
        base, level = built.where(F.col("step") == LEVELS).drop("step"), level + LEVELS
        for _ in range(LEVELS):
            largest = _up(largest)
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", changed: dict[str, Column] | None = None) -> Manifest:
    """The trees over ``docs``. ``changed`` gives other values of some fields: ``shown`` is the digest with these, null if the same."""
    own = digest([F.col(c) for c in fields])
    other = digest([(changed or {}).get(c, F.col(c)) for c in fields])
    rows = docs.select("doc_id", F.col(group).cast("string").alias("_name"), own.alias("leaf"), other.alias("shown"))
    rows = written(rows.withColumn("shown", F.expr("nullif(shown, leaf)")))
    at, runs = sorted_runs(rows, ["_name"], ["doc_id", "leaf"])
    sources = written(runs.groupBy("_name").agg(F.sum("_n").alias("size")))
    numbers = written(place(*sorted_runs(sources, [], ["_name"]), [], "tree"))
    trees, largest = numbers.agg(F.count(F.lit(1)), F.max("size")).first()
    numbers = numbers.select(F.col("_name").alias("_of"), "tree", "size")
    runs = runs.join(numbers, runs["_name"].eqNullSafe(numbers["_of"])).drop("_of")
    leaves = written(place(at, written(runs), ["_name"], "pos").drop("_name"))
    floor = leaves.select("tree", "size", "pos", F.col("leaf").alias("digest"))
    nodes = floor.select("tree", F.lit(0).alias("level"), "pos", "digest")
    above = grow(floor, largest or 0)
    if above is not None:
        nodes = nodes.union(above)
    # the last node of each tree is the one of its last level
    depth, left = F.lit(0), F.col("size")
    for _ in range(_depth(largest or 0)):
        depth = depth + (left > 1).cast("int")
        left = F.ceil(left / ARITY)
    last = numbers.select("tree", depth.alias("level"), F.lit(0).cast("bigint").alias("pos"))
    subroots = written(nodes.join(last, ["tree", "level", "pos"]).select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(trees).cast("bigint").alias("size"), F.col("tree").alias("pos"), "digest"))
    top = subroots.select("tree", F.lit(0).alias("level"), "pos", "digest")
    above = grow(subroots, trees)
    top = top if above is None else top.union(above)
    root = top.where(F.col("level") == _depth(trees)).select(F.lower(F.hex("digest"))).first()
    return Manifest(leaves, nodes.union(top), trees, root[0] if root else None)


def _depth(size: int) -> int:
    levels = 0
    while size > 1:
        size, levels = _up(size), levels + 1
    return levels


# ---- proving ---------------------------------------------------------------------------------


def missing(positions: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places) of the nodes that proofs of the leaves at ``positions`` need and these leaves don't yield."""
    known, level = np.unique(positions), 0
    while size > 1:
        above = np.unique(known // ARITY)
        run = (above[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, np.setdiff1d(run[run < size], known, assume_unique=True)
        known, size, level = above, _up(size), level + 1


def _by_tree(tree: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(tree, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(tree[order])) + 1) if len(order) else []:
        yield int(tree[rows[0]]), rows


def _needs(trees: int):
    def of(leaves: pa.Table) -> pa.Table:
        tree, size, pos = (leaves.column(c).to_numpy() for c in ("tree", "size", "pos"))
        asked = [(t, pos[rows], int(size[rows[0]])) for t, rows in _by_tree(tree)]
        asked.append((TOP, np.array([t for t, _, _ in asked]), trees))
        found = [(t, level, places) for t, some, n in asked for level, places in missing(some, n) if len(places)]
        count = [len(places) for _, _, places in found]
        part = leaves.column("_part")[0].as_py()
        return pa.table({
            "_part": pa.array(np.full(sum(count), part, np.int64)),
            "tree": pa.array(np.repeat([t for t, _, _ in found], count).astype(np.int64)),
            "level": pa.array(np.repeat([level for _, level, _ in found], count).astype(np.int32)),
            "pos": pa.array(np.concatenate([p for _, _, p in found]).astype(np.int64) if found else np.zeros(0, np.int64)),
        })

    return of


class _Tree:
    """Digests by level and place: the given leaves, the fetched nodes, and what follows from them."""

    def __init__(self, size: int, leaves: dict[int, bytes], fetched: dict[int, dict[int, bytes]]) -> None:
        self.sizes, self.levels = [size], [leaves]
        while self.sizes[-1] > 1:
            level, below = self.sizes[-1], self.levels[-1]
            below.update(fetched.get(len(self.levels) - 1, {}))
            above = {p: _parent([below[i] for i in range(p * ARITY, min(p * ARITY + ARITY, level))]) for p in {i // ARITY for i in below}}
            self.sizes.append(_up(level))
            self.levels.append(above)

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def fold(self, pos: int, digest: bytes, proof: list[bytes]) -> bytes:
        """What ``digest`` at ``pos`` becomes with its siblings, which are added to ``proof``."""
        for level, size in zip(self.levels, self.sizes[:-1]):
            first = pos - pos % ARITY
            run = [level[i] if i != pos else b"" for i in range(first, min(first + ARITY, size))]
            proof += [d for d in run if d]
            run[pos - first] = digest
            digest, pos = _parent(run), pos // ARITY
        return digest


_PROVED = "doc_id {}, leaf string, subroot string, proof array<string>, folded_root string, derived_root string"


def _prove(trees: int, digest_only: bool, doc_type: pa.DataType):
    def of(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        given: dict[int, dict[int, dict[int, bytes]]] = {}
        for tree, level, pos, raw in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "pos", "digest"))):
            given.setdefault(tree, {}).setdefault(level, {})[pos] = raw.hex().encode()
        size, pos = leaves.column("size").to_numpy(), leaves.column("pos").to_numpy()
        own = [x.hex().encode() for x in leaves.column("leaf").to_pylist()]
        shown = [x and x.hex().encode() for x in leaves.column("shown").to_pylist()]
        rows_of = dict(_by_tree(leaves.column("tree").to_numpy()))
        built = {t: _Tree(int(size[rows[0]]), {int(pos[i]): own[i] for i in rows}, given.get(t, {})) for t, rows in rows_of.items()}
        top = _Tree(trees, {t: tree.root for t, tree in built.items()}, given.get(TOP, {}))
        n = leaves.num_rows
        subroots, proofs, folded = [""] * n, [None] * n, [""] * n
        for t, rows in rows_of.items():
            for i in rows.tolist():
                proof: list[bytes] = []
                node = built[t].fold(int(pos[i]), shown[i] or own[i], proof)
                folded[i] = top.fold(t, node, proof).decode()
                subroots[i] = built[t].root.decode()
                proofs[i] = _parent(proof).decode() if digest_only else [p.decode() for p in proof]
        return pa.table({
            "doc_id": leaves.column("doc_id").cast(doc_type), "leaf": pa.array([x.decode() for x in own], pa.string()),
            "subroot": pa.array(subroots, pa.string()), "proof": pa.array(proofs, pa.string() if digest_only else pa.list_(pa.string())),
            "folded_root": pa.array(folded, pa.string()), "derived_root": pa.array([top.root.decode()] * n, pa.string()),
        })

    return of


def prove(of: Manifest, leaves: DataFrame | None = None, digest_only: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, proof, folded_root, derived_root, root, verified) for some leaves of the manifest, all by default.

    ``proof`` lists the siblings from the leaf to the root, or is their H if ``digest_only``. ``folded_root`` is
    made from ``shown`` (else the leaf) and the proof, ``derived_root`` from the partition's leaves and what it fetched.
    """
    leaves = of.leaves if leaves is None else leaves
    doc_type = leaves.schema["doc_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[doc_type]
    coordinates = leaves.select("_part", "tree", "size", "pos")
    needs = written(coordinates.groupBy("_part").applyInArrow(_needs(of.trees), "_part long, tree long, level int, pos long"))
    fetched = of.nodes.join(needs, same(of.nodes, needs, ["tree", "level", "pos"])).select(
        needs["_part"], needs["tree"], needs["level"], needs["pos"], "digest"
    )
    schema = _PROVED.format(doc_type)
    if digest_only:
        schema = schema.replace("array<string>", "string")
    proved = leaves.groupBy("_part").cogroup(fetched.groupBy("_part")).applyInArrow(_prove(of.trees, digest_only, arrow), schema)
    return proved.withColumn("root", F.lit(of.root).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    proofs = prove(manifest(docs, changed=without_newlines(docs)), digest_only=True)
    return proofs.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT *, list_reduce(
      [4294967295::BIGINT] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: CASE WHEN c = '' THEN [] ELSE [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] END)),
      lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) & 1 = 1 AS tampered
  FROM documents),
coded AS (
  SELECT doc_id, source, tampered, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM crc),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS shown
  FROM coded),
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, leaf, coalesce(shown, leaf) AS shown,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM hashed),
nodes AS (
  SELECT source, 0 AS level, pos, size, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY source, level, pos // 3, size),
folds AS (
  SELECT r, source, 0 AS level, pos, size, shown AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT f.r, f.source, f.level + 1, f.pos // 3, (f.size + 2) // 3,
    sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.h ELSE n.h END, '' ORDER BY n.pos)),
    f.proof || coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos <> f.pos), '')
  FROM folds f JOIN (
      SELECT source, 0 AS level, pos, leaf AS h FROM leaves UNION ALL SELECT source, level, pos, h FROM nodes WHERE level > 0
    ) n ON n.source IS NOT DISTINCT FROM f.source AND n.level = f.level AND n.pos // 3 = f.pos // 3
  WHERE f.size > 1 GROUP BY f.r, f.source, f.level, f.pos, f.size, f.h, f.proof),
subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, pos, size, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE size > 1 GROUP BY level, pos // 3, size),
ends AS (
  SELECT f.r, 0 AS level, s.pos, s.size, f.h, f.proof FROM folds f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source WHERE f.size = 1
  UNION ALL
  SELECT f.r, f.level + 1, f.pos // 3, (f.size + 2) // 3,
    sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.h ELSE n.h END, '' ORDER BY n.pos)),
    f.proof || coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos <> f.pos), '')
  FROM ends f JOIN (SELECT level, pos, h FROM tops) n ON n.level = f.level AND n.pos // 3 = f.pos // 3
  WHERE f.size > 1 GROUP BY f.r, f.level, f.pos, f.size, f.h, f.proof),
root AS (SELECT h FROM tops WHERE size = 1)
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM leaves l JOIN ends e ON e.r = l.r AND e.size = 1 JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source, root
"""
