"""BPE encoding and decoding with a byte-level vocabulary file, the merges of a word found by a segment tree.

A text is cut at the vocabulary's special strings, the rest by the byte-level pattern into pieces.
The tree over a piece holds (rank, position) of every adjacent pair; its root is the leftmost pair of
the lowest rank. Merging it updates three leaves and their paths, until no pair can be merged. The new pieces
of some texts go through this together: one array holds the trees of all pieces of like size, and a round
merges the root's pair of each; pieces of more than ``WIDEST`` bytes are merged alone.
Decoding joins the bytes of the ids and reads them as UTF-8, with replacement characters for what is
not. Null is an empty text and has no ids. Rows are independent: nothing is shuffled, and a task holds
one batch of texts. The vocabulary has a fixed size and is broadcast; each Python worker remembers
the ids of at most ``REMEMBERED`` pieces.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.common import documents

REMEMBERED = 200_000
# Bytes of a piece that is merged together with others.
WIDEST = 64
# Texts whose new pieces are merged together, in characters, and pieces in one array of trees.
TOGETHER = 1 << 20
PIECES_TOGETHER = 1 << 14
# Fixed value: the pattern that cuts text before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 62
_NO_PAIR = np.int64(_NONE)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """Plain tables of a tokenizer file: ids, merges by pair of ids, special strings."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    ids = dict(model["model"]["vocab"])
    special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
    pairs = {}
    for rank, merge in enumerate(model["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs[ids[left] << 32 | ids[right]] = (rank, ids[left + right])
    return {"ids": ids, "pairs": pairs, "special": special, "seen": {}}


class Codec:
    def __init__(self, vocabulary: dict) -> None:
        letters = byte_letters()
        self.pairs = vocabulary["pairs"]
        self.special = vocabulary["special"]
        self.bytes_to_ids = [vocabulary["ids"][x] for x in letters]
        value = {x: b for b, x in enumerate(letters)}
        size = max([*vocabulary["ids"].values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for text, i in [*vocabulary["ids"].items(), *self.special.items()]:
            known = all(x in value for x in text)
            self.pieces[i] = bytes(value[x] for x in text) if known else text.encode()
        self.numbers = [str(i) for i in range(size)]
        self.find = regex.compile(PIECES).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if longest_first else None
        self.seen: dict[str, bytes] = {}
        order = sorted(self.pairs)
        self.pair_keys = np.array(order, np.int64)
        self.pair_ranks = np.array([self.pairs[x][0] for x in order], np.int64)
        self.pair_ids = np.array([self.pairs[x][1] for x in order], np.int64)

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids of one piece, from the ids of its bytes."""
        n, pairs = len(symbols), self.pairs
        if n < 2:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        width = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * width)

        def key(i: int) -> int:
            j = after[i]
            found = pairs.get(symbols[i] << 32 | symbols[j]) if j < n else None
            return found[0] << 32 | i if found else _NONE

        for i in range(n - 1):
            tree[width + i] = key(i)
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a <= b else b
        while tree[1] != _NONE:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            symbols[i] = pairs[symbols[i] << 32 | symbols[j]][1]
            symbols[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for leaf in (i, j, before[i]):
                if leaf < 0:
                    continue
                node = width + leaf
                tree[node] = _NONE if leaf == j else key(leaf)
                node >>= 1
                while node:
                    a, b = tree[2 * node], tree[2 * node + 1]
                    best = a if a <= b else b
                    if tree[node] == best:
                        break
                    tree[node] = best
                    node >>= 1
        return [s for s in symbols if s >= 0]

    def _pairs_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair of ids among the merges, -1 where it is none."""
        wanted = left << 32 | right
        at = np.searchsorted(self.pair_keys, wanted)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == wanted, at, -1) if len(self.pair_keys) else np.full(len(wanted), -1)

    def merge_rows(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``merge`` of many pieces, one a row of ``symbols`` (a power of two wide); -1 where no id is left."""
        n, width = symbols.shape
        place = np.arange(width)
        flat = symbols.reshape(-1)
        after = np.tile(place + 1, (n, 1)).reshape(-1)
        before = np.tile(place - 1, (n, 1)).reshape(-1)
        tree = np.full((n, 2 * width), _NO_PAIR)
        row, i = np.nonzero(place[None, :] < sizes[:, None] - 1)
        found = self._pairs_at(symbols[row, i], symbols[row, i + 1])
        some = found >= 0
        tree[row[some], width + i[some]] = self.pair_ranks[found[some]] << 32 | i[some]
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        nodes = tree.reshape(-1)
        rows = np.flatnonzero(tree[:, 1] != _NO_PAIR)
        while len(rows):
            first, root = rows * width, rows * 2 * width
            i = nodes[root + 1] & 0xFFFFFFFF
            j = after[first + i]
            flat[first + i] = self.pair_ids[self._pairs_at(flat[first + i], flat[first + j])]
            flat[first + j] = -1
            end = after[first + j]
            after[first + i] = end
            inner = end < sizes[rows]
            before[(first + end)[inner]] = i[inner]
            back = before[first + i]
            # the pairs that begin at the merged symbol and at the one before it; the one at j is gone
            nodes[root + width + j] = _NO_PAIR
            for there, left, right in ((inner, i, end), (back >= 0, back, i)):
                here, leaf = first[there], left[there]
                found = self._pairs_at(flat[here + leaf], flat[here + right[there]])
                key = np.where(found >= 0, self.pair_ranks[found] << 32 | leaf, _NO_PAIR)
                nodes[root[there] + width + leaf] = key
            nodes[(root + width + i)[~inner]] = _NO_PAIR
            node = np.concatenate((width + i, width + j, width + np.maximum(back, 0))) >> 1
            root = np.tile(root, 3)
            while node[0]:
                nodes[root + node] = np.minimum(nodes[root + 2 * node], nodes[root + 2 * node + 1])
                node >>= 1
            rows = rows[nodes[rows * 2 * width + 1] != _NO_PAIR]
        return symbols

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pieces, as bytes."""
        out: list[bytes] = [b""] * len(pieces)
        to_id = np.array(self.bytes_to_ids, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        wide, least = 2, 0
        while least < WIDEST:
            like = np.flatnonzero((lengths > least) & (lengths <= wide))
            for start in range(0, len(like), PIECES_TOGETHER):
                some = like[start : start + PIECES_TOGETHER]
                sizes = lengths[some]
                symbols = np.full((len(some), wide), -1, np.int64)
                symbols[np.arange(wide) < sizes[:, None]] = to_id[np.frombuffer(b"".join([pieces[i] for i in some.tolist()]), np.uint8)]
                symbols = self.merge_rows(symbols, sizes)
                left = symbols >= 0
                ids = symbols[left].astype(np.uint32).tobytes()
                ends = np.cumsum(left.sum(axis=1)) * 4
                a = 0
                for i, b in zip(some.tolist(), ends.tolist()):
                    out[i] = ids[a:b]
                    a = b
            wide, least = 2 * wide, wide
        for i in np.flatnonzero(lengths > least).tolist():
            out[i] = array("I", self.merge([self.bytes_to_ids[x] for x in pieces[i]])).tobytes()
        return out

    def _encode_together(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of a few texts; what they have of pieces not seen before is merged together."""
        cut, special, find = self.cut, self.special, self.find
        found: list[list[str]] = []
        for text in texts:
            if cut and any(s in text for s in special):
                pieces: list[str] = []
                for part in cut(text):
                    pieces += (part,) if part in special else find(part)
                found.append(pieces)
            else:
                found.append(find(text))
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        seen = self.seen
        new = list({p for pieces in found for p in pieces if p not in seen})
        plain = [p for p in new if p not in special]
        seen.update(zip(plain, self.merge_all([p.encode() for p in plain])))
        seen.update((p, array("I", [special[p]]).tobytes()) for p in new if p in special)
        out = [np.frombuffer(b"".join([seen[p] for p in pieces]), np.uint32) for pieces in found]
        for p in new:
            if len(p) > 64:
                del seen[p]
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text, in their order."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > TOGETHER:
                yield from (ids.tolist() for ids in self._encode_together(held))
                held, size = [], 0
            held.append(text)
            size += len(text)
        yield from (ids.tolist() for ids in self._encode_together(held))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


def _codec(shared) -> Codec:
    """One codec per Python worker, kept with the broadcast value."""
    value = shared.value
    if "codec" not in value:
        value["codec"] = Codec(value)
    return value["codec"]


def _encode_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            ids = pa.array(codec.encode_all([t or "" for t in batch.column("text").to_pylist()]), pa.list_(pa.int32()))
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [ids], names=[batch.schema.names[i] for i in keep] + ["ids"]
            )

    return run


def _decode_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = pa.array([codec.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())
            keep = [i for i, name in enumerate(batch.schema.names) if name != "ids"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [texts], names=[batch.schema.names[i] for i in keep] + ["text"]
            )

    return run


def _digest_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for ids in codec.encode_all(t.as_py() or "" for t in batch.column("text")):
                listed = ",".join([codec.numbers[i] for i in ids])
                rows.append((len(ids), sha(listed.encode()).hexdigest(), sha(codec.decode(ids).encode()).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return run


def share(spark: SparkSession, path: str):
    """The vocabulary of a file the driver can open, for all executors."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def _fields(df: DataFrame, without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != without)


def encode(df: DataFrame, vocabulary) -> DataFrame:
    """``ids`` in place of ``text``."""
    return df.mapInArrow(_encode_batches(vocabulary), _fields(df, "text") + "ids array<int>")


def decode(df: DataFrame, vocabulary) -> DataFrame:
    """``text`` in place of ``ids``."""
    return df.mapInArrow(_decode_batches(vocabulary), _fields(df, "ids") + "text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    shared = share(docs.sparkSession, path)
    return docs.select("doc_id", "text").mapInArrow(
        _digest_batches(shared), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op3_bpe_encoding_and_decoding(spark: SparkSession, folder: str) -> DataFrame:
    return digests(documents(spark, folder))
