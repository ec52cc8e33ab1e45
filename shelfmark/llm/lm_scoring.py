"""LM scoring: a causal self-attention model over subword ids, and a smoothed unigram base.

Each text is cut into subword ids once, and these are written beside it: counts, rounds of training and scores
read them there. Counts come from all learning texts: words (white-space words, A-Z lower-cased, and one end per
text) are counted, combined per task before the exchange. The ids fall into ``CLASSES`` classes: the commonest ids alone, the
others by their first byte. The model gives P(class | ids before), an id has its share of its class's
smoothed count after the class of the id before, so every text over the vocabulary has a probability.

The model: embeddings, one masked attention head over windows of ``CONTEXT`` ids, a residual and a softmax
over classes. All learning texts train it, in ``STEPS`` rounds over disjoint parts of them: each task trains
a copy on its texts, and the changes are averaged by row of the weights and broadcast again. Windows
overlap by ``OVERLAP`` ids, so that each id is scored once and with ids before it.

The base needs the count of every word. The ``FREQUENT`` commonest words are broadcast; the others of
each text are joined with the table of counts and summed back by row. Words are told apart by 64-bit
hashes. Null is an empty text, one end token; repeated rows are scored each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.common import BLOCK_BYTES, Words, blocks, bytes_of, documents, held_back, signed, tidy, written

CLASSES = 128
SHARED_CLASSES = 40
CONTEXT = 16
OVERLAP = 4
WIDTH = 8
HIDDEN = 16
TABLES = ("q", "k", "v", "own")
# Rounds of training: each learning text is read in one of them.
STEPS = 6
BATCH = 256
RATE = 0.1
# Rows of class scores, and windows of a text that is scored, held at a time.
ROWS = 768
WINDOWS = 128
# Words whose ids a task remembers, and texts that train or are scored together, in bytes.
REMEMBERED = 300_000
TRAIN_BLOCK = 2 << 20
SCORE_BLOCK = 2 << 20
# Bytes of the batches in which texts go to the cutting into ids and to the scores.
TEXT_BATCH = 4 << 20
# Parts of the id tables that are added up apart.
PARTS = 16
FREQUENT = 1 << 20
# Fixed value: the pattern that cuts text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _encoder(shared):
    value = shared.value
    if "encoder" not in value:
        import tiktoken

        value["encoder"] = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=value["ranks"], special_tokens={}).encode_ordinary
    return value["encoder"]


def ids_of_words(words: list[bytes], encode) -> list[list[int]]:
    return [encode(" " + w.decode("utf-8", "replace")) for w in words]


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``begin``, ``begin + 1`` and so on, ``size`` of each, end to end."""
    ends = np.cumsum(size)
    out = np.repeat(begin - ends + size, size)
    out += np.arange(len(out))
    return out


def _flat_ids(words: Words, place: np.ndarray, encode, length_of: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids_of_words`` of the words at ``place`` end to end, and where each one's ids begin and how many they are.

    Words without odd white space are cut in one go, as no piece goes on behind a space.
    """
    starts, ends = words.starts[place], words.ends[place]
    strange = np.concatenate(([0], np.cumsum((words.data < 0x21) | (words.data > 0x7E), dtype=np.int64)))
    ascii = strange[ends] == strange[starts]
    # in the joined text a space or a line end goes before each word, but for the first
    taken = words.data.take(ragged(starts[ascii] - 1, ends[ascii] - starts[ascii] + 1), mode="clip")
    heads = np.cumsum(ends[ascii] - starts[ascii] + 1)
    taken[np.concatenate(([0], heads[:-1]))[: len(heads)]] = 0x20
    others = [" " + words.joined[a:b].decode("utf-8", "replace") for a, b in zip(starts[~ascii].tolist(), ends[~ascii].tolist())]
    plain = np.fromiter((t[1:].isprintable() for t in others), bool, len(others))
    ids = np.array(encode(taken.tobytes().decode("ascii") + "".join([t for t, x in zip(others, plain) if x])), np.int64)
    odd = [encode(t) for t, x in zip(others, plain) if not x]
    lengths = np.concatenate((ends[ascii] - starts[ascii] + 1, np.array([len(t.encode()) for t, x in zip(others, plain) if x], np.int64)))
    edge = np.concatenate(([0], np.searchsorted(np.cumsum(length_of[ids]), np.cumsum(lengths)) + 1, len(ids) + np.cumsum([len(x) for x in odd], dtype=np.int64)))
    foreign = np.flatnonzero(~ascii)
    order = np.concatenate((np.flatnonzero(ascii), foreign[plain], foreign[~plain]))
    begin, size = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    begin[order], size[order] = edge[:-1], np.diff(edge)
    return np.concatenate([ids.astype(kind), *(np.array(x, kind) for x in odd)]), begin, size


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes in order, a place of each, and the number of the hash at every place."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(hashes), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


class CutWords:
    """The subword ids of the words a task has met, by hash; forgets them all when they are too many."""

    def __init__(self, ranks: dict[bytes, int], end: int, encode) -> None:
        self.encode, self.kind = encode, _id_type(end)
        self.length_of = np.zeros(end + 1, np.int64)
        for piece, i in ranks.items():
            self.length_of[i] = len(piece)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.flat = np.zeros(0, np.uint64), np.zeros(0, self.kind)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        have = at < len(self.hashes)
        have[have] = self.hashes[at[have]] == hashes[have]
        return np.flatnonzero(~have)

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of the texts end to end, and the edges of each text's ids."""
        unique, place, number = distinct(words.hash)
        if len(self.hashes) >= REMEMBERED:
            self.forget()
        new = self._missing(unique)
        if len(new):
            flat, begin, size = _flat_ids(words, place[new], self.encode, self.length_of, self.kind)
            to = np.searchsorted(self.hashes, unique[new])
            self.begin, self.size = np.insert(self.begin, to, begin + len(self.flat)), np.insert(self.size, to, size)
            self.hashes, self.flat = np.insert(self.hashes, to, unique[new]), np.concatenate((self.flat, flat))
        at = np.searchsorted(self.hashes, unique)
        own = self.size[at][number]
        edges = np.concatenate(([0], np.cumsum(own)))
        return self.flat.take(ragged(self.begin[at][number], own)), edges[np.concatenate(([0], np.cumsum(words.count)))]


def slices(batch: pa.RecordBatch, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have about ``size`` bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(ends):
        held = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, held + size + 1, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


# ---- counts --------------------------------------------------------------------------------


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n) of words; the end of a text is code 0."""
    for batch in batches:
        for _, big in blocks(bytes_of(batch.column("text")), 8 << 20):
            codes, times, rows = [], [], 0
            for _, texts in blocks(big):
                unique, n = np.unique(Words(texts).hash, return_counts=True)
                codes.append(unique)
                times.append(n)
                rows += len(texts)
            code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(times), len(code)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(signed(code), 0)), pa.array(np.append(n, rows))], names=["code", "n"])


def word_counts(learning: DataFrame) -> DataFrame:
    """(code, n) of every distinct word of ``learning`` (text), the end as code 0."""
    counted = learning.select("text").mapInArrow(tidy(_word_batches), "code long, n long")
    return written(counted.groupBy("code").agg(F.sum("n").alias("n")))


def _id_type(end: int) -> type:
    return np.uint16 if end < 1 << 16 else np.int32


def _encode_batches(shared):
    """``_llm_ids``, the ids of each text as bytes, and ``_llm_size``, the bytes of the text, behind the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = CutWords(shared.value["ranks"], shared.value["end"], _encoder(shared))
        for batch in batches:
            for own in slices(batch):
                texts = bytes_of(own.column("text"))
                ids, edges = cut.ids(Words(texts))
                edges = (edges * ids.itemsize).astype(np.int32)
                coded = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, coded, pa.array([len(x) for x in texts], pa.int64())], names=[*batch.schema.names, "_llm_ids", "_llm_size"]
                )

    return run


def encoded(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``docs`` with the subword ids of ``text``, written; as it is where it has them."""
    if "_llm_ids" in docs.columns:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks, "end": len(ranks)})
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return written(docs.mapInArrow(tidy(_encode_batches(shared)), fields + "_llm_ids binary, _llm_size long"), TEXT_BATCH)


def _stream(ids: bytes, end: int) -> np.ndarray:
    """End id, the ids, end id."""
    own = np.frombuffer(ids, _id_type(end))
    out = np.empty(len(own) + 2, np.int32)
    out[0] = out[-1] = end
    out[1:-1] = own
    return out


def _stream_blocks(batch: pa.RecordBatch, end: int, size: int = TRAIN_BLOCK) -> Iterator[list[np.ndarray]]:
    """The streams of consecutive texts of about ``size`` bytes together."""
    streams, held = [], 0
    for ids, n in zip(batch.column("_llm_ids").to_pylist(), batch.column("_llm_size").to_pylist()):
        if held and held + n > size:
            yield streams
            streams, held = [], 0
        streams.append(_stream(ids, end))
        held += n + 1
    if streams:
        yield streams


def _id_batches(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, np.int64)
        for batch in batches:
            for ids in batch.column("_llm_ids").to_pylist():
                own = np.frombuffer(ids, _id_type(end))
                if len(own) > end:
                    total += np.bincount(own, minlength=len(total))
                else:
                    np.add.at(total, own, 1)
            total[end] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    return run


def _pair_batches(shared):
    """(class of the id before, id, n) of the learning texts, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, kind = shared.value["end"], shared.value["kind"]
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for streams in _stream_blocks(batch, end, 8 << 20):
                before = kind[np.concatenate([s[:-1] for s in streams])]
                pairs, n = np.unique(before * (end + 1) + np.concatenate([s[1:] for s in streams]), return_counts=True)
                keys, place = np.unique(np.concatenate((keys, pairs)), return_inverse=True)
                times = np.bincount(place, np.concatenate((times, n)), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["pair", "n"])

    return run


# ---- model ---------------------------------------------------------------------------------


def classes_of(counts: np.ndarray, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, log probability of each id in its class)."""
    alone = CLASSES - SHARED_CLASSES
    kind = np.zeros(len(counts), np.int64)
    for piece, i in ranks.items():
        spaced = piece[:1] == b" "
        letter = piece[spaced : spaced + 1] or b" "
        kind[i] = (letter[0] * 2 + spaced) % SHARED_CLASSES
    kind += alone
    common = np.argsort(-counts, kind="stable")[:alone]
    kind[common] = np.arange(alone)
    smooth = counts + 0.1
    total = np.bincount(kind, smooth, CLASSES)
    return kind, np.log(smooth / total[kind])


def shares_after(kind: np.ndarray, inside: np.ndarray, pairs: np.ndarray, n: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """Log probability of each id in its class after each class: counts of pairs, smoothed by ``inside``."""
    size = len(kind)
    out = np.empty((CLASSES, size), np.float32)
    edges = np.searchsorted(pairs, np.arange(CLASSES + 1) * size)
    for before in range(CLASSES):
        a, b = edges[before], edges[before + 1]
        ids = pairs[a:b] - before * size
        have = weight * np.exp(inside)
        have[ids] += n[a:b]
        out[before] = np.log(have / (np.bincount(kind[ids], n[a:b], CLASSES) + weight)[kind])
    return out


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (window, place) into texts laid end to end, -1 where there is none, and which are scored."""
    stride = CONTEXT - OVERLAP
    per_text = np.maximum(-(-(sizes - OVERLAP) // stride), 1)
    number = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = np.repeat(np.cumsum(sizes) - sizes, per_text)
    size = np.repeat(sizes, per_text)
    local = number[:, None] * stride + np.arange(CONTEXT)
    inside = local < size[:, None]
    fresh = inside & ((np.arange(CONTEXT) >= OVERLAP) | (number[:, None] == 0))
    return np.where(inside, local + begin[:, None], -1), fresh


_LAG = np.subtract.outer(np.arange(CONTEXT), np.arange(CONTEXT)).clip(0)
_MASK = np.where(np.tril(np.ones((CONTEXT, CONTEXT), bool)), 0, -1e9).astype(np.float32)


_ONES = np.ones(max(CONTEXT, CLASSES, WIDTH), np.float32)
# Columns of the id tables laid side by side, and which table each is of.
_EDGES = (0, WIDTH, 2 * WIDTH, 3 * WIDTH, 3 * WIDTH + HIDDEN)
_TABLE_OF = np.repeat(np.eye(len(TABLES), dtype=np.float32), np.diff(_EDGES), axis=1)


def side_by_side(model: dict) -> np.ndarray:
    """The id tables as one, so that an id is looked up once."""
    return np.concatenate([model[name] for name in TABLES], axis=1)


def _softmax(close: np.ndarray) -> np.ndarray:
    """In place, over the last axis of (window, place, place before); the diagonal is never masked."""
    top = close.max()
    # far from the highest number, a row is measured from its own
    if top - close.diagonal(axis1=1, axis2=2).min() > 60:
        top = close.max(axis=2, keepdims=True)
    close -= top
    np.exp(close, out=close)
    close /= np.repeat(close.reshape(-1, CONTEXT) @ _ONES[:CONTEXT], CONTEXT).reshape(close.shape)
    return close


def attended(model: dict, wide: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden states (window and place, HIDDEN) of windows of ids; places after a text's end are masked by order."""
    rows = wide.take(ids, axis=0)
    q, k, v, own = (rows[..., a:b] for a, b in zip(_EDGES[:-1], _EDGES[1:]))
    close = np.matmul(q, k.transpose(0, 2, 1))
    close *= np.float32(WIDTH**-0.5)
    close += model["near"] + _MASK
    weight = _softmax(close)
    mixed = np.matmul(weight, v)
    hidden = mixed.reshape(-1, WIDTH) @ model["mix"]
    hidden += own.reshape(-1, HIDDEN)
    return hidden, (q, k, v, weight, mixed)


def new_model(size: int, start: np.ndarray, seed: int = 7) -> dict:
    random = np.random.default_rng(seed)

    def table(*shape: int, scale: float = 0.1) -> np.ndarray:
        return (random.standard_normal(shape) * scale).astype(np.float32)

    return {
        "q": table(size, WIDTH, scale=0.3), "k": table(size, WIDTH, scale=0.3), "v": table(size, WIDTH, scale=0.3),
        "near": np.zeros((CONTEXT, CONTEXT), np.float32), "mix": table(WIDTH, HIDDEN), "own": table(size, HIDDEN),
        "out": table(HIDDEN, CLASSES), "bias": start.astype(np.float32),
    }


def new_state(model: dict) -> dict:
    """A model with the squared slopes Adagrad keeps: by row of the id tables, by entry of the others."""
    sums = {f"sum_{name}": np.zeros((len(x), 1) if name in TABLES else x.shape, np.float32) for name, x in model.items()}
    return {**model, **sums}


def _with_bias(model: dict) -> np.ndarray:
    return np.concatenate((model["out"], model["bias"][None, :]))


def _slopes(state: dict, wide: np.ndarray, ids: np.ndarray, scored: np.ndarray, goal: np.ndarray) -> tuple[dict, np.ndarray]:
    """Mean slopes of the cross entropy of one batch of windows: of the dense weights, and at each place of the id tables.

    ``scored`` are numbers of places, ``goal`` the classes that follow there.
    """
    hidden, (q, k, v, weight, mixed) = attended(state, wide, ids)
    d_hidden = np.zeros_like(hidden)
    # the bias is the weight of a last number that is always 1
    forth, back = _with_bias(state), np.ascontiguousarray(state["out"].T)
    d_forth = np.zeros_like(forth)
    scores, used = np.empty((ROWS, CLASSES), np.float32), np.empty((ROWS, HIDDEN + 1), np.float32)
    for a in range(0, len(scored), ROWS):
        at, some = scored[a : a + ROWS], goal[a : a + ROWS]
        p, h = scores[: len(at)], used[: len(at)]
        h[:, :HIDDEN], h[:, HIDDEN] = hidden.take(at, axis=0), 1
        np.matmul(h, forth, out=p)
        np.exp(p, out=p)
        total = p @ _ONES[:CLASSES]
        p[np.arange(len(p)), some] -= total
        share = (1 / (total * np.float32(len(scored))))[:, None]
        d_hidden[at] = (p @ back) * share
        h *= share
        d_forth += h.T @ p
    dense = {"out": d_forth[:HIDDEN], "bias": d_forth[HIDDEN]}
    dense["mix"] = mixed.reshape(-1, WIDTH).T @ d_hidden
    d_mixed = (d_hidden @ state["mix"].T).reshape(mixed.shape)
    d_close = np.matmul(d_mixed, v.transpose(0, 2, 1))
    d_close -= np.repeat((d_mixed * mixed).reshape(-1, WIDTH) @ _ONES[:WIDTH], CONTEXT).reshape(d_close.shape)
    d_close *= weight
    # a lag has one number wherever it stands in the window
    summed = (np.ones(len(ids), np.float32) @ d_close.reshape(len(ids), -1)).reshape(CONTEXT, CONTEXT)
    by_lag = np.bincount(_LAG.ravel(), np.tril(summed).ravel(), CONTEXT)
    dense["near"] = np.tril(by_lag[_LAG]).astype(np.float32)
    d_close *= np.float32(WIDTH**-0.5)
    places = np.empty((*ids.shape, _EDGES[-1]), np.float32)
    d_q, d_k, d_v, d_own = (places[..., a:b] for a, b in zip(_EDGES[:-1], _EDGES[1:]))
    np.matmul(d_close, k, out=d_q)
    np.matmul(d_close.transpose(0, 2, 1), q, out=d_k)
    np.matmul(weight.transpose(0, 2, 1), d_mixed, out=d_v)
    d_own[:] = d_hidden.reshape(d_own.shape)
    return dense, places.reshape(-1, _EDGES[-1])


def train(state: dict, streams: list[np.ndarray], kind: np.ndarray, seen: np.ndarray, rate: float, passes: int = 1, seed: int = 11) -> int:
    """Adagrad in place on every window of the streams (each: the end id, then the ids of a text, then the end id).

    ``seen`` counts the batches that moved each row of the id tables; returns the number of batches.
    """
    random = np.random.default_rng(seed)
    place, fresh = windows_of(np.array([len(s) - 1 for s in streams]))
    np.maximum(place, 0, out=place)
    inputs = np.concatenate([s[:-1] for s in streams])[place]
    goals = kind[np.concatenate([s[1:] for s in streams])][place]
    narrow = np.uint16 if len(kind) <= 1 << 16 else np.int64
    wide, sums = side_by_side(state), np.concatenate([state[f"sum_{name}"] for name in TABLES], axis=1)
    mean_of = np.ascontiguousarray((_TABLE_OF / np.diff(_EDGES)[:, None]).T.astype(np.float32))
    rate, least = np.float32(rate), np.float32(1e-6)
    batches = 0
    for _ in range(passes):
        order = random.permutation(len(place))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            ids, scored = inputs[some], np.flatnonzero(fresh[some])
            dense, places = _slopes(state, wide, ids, scored, goals[some].ravel()[scored])
            for name, g in dense.items():
                state[f"sum_{name}"] += g * g
                state[name] -= rate * g / (np.sqrt(state[f"sum_{name}"]) + least)
            # 16 bits are sorted by counting
            by_id = np.argsort(ids.ravel().astype(narrow), kind="stable")
            sorted_ids = ids.ravel()[by_id]
            edge = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
            rows = sorted_ids[edge]
            seen[rows] += 1
            g = np.add.reduceat(places.take(by_id, axis=0), edge, axis=0)
            total = sums[rows] + (g * g) @ mean_of
            sums[rows] = total
            g *= (rate / (np.sqrt(total) + least)) @ _TABLE_OF
            wide[rows] -= g
            batches += 1
    for name, table, total in zip(TABLES, np.split(wide, _EDGES[1:-1], axis=1), np.split(sums, len(TABLES), axis=1)):
        state[name][:], state[f"sum_{name}"][:] = table, total
    return batches


def _round_batches(shared):
    """One task's part of a round: trains a copy of the model on its texts, gives weighted changes by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        end, kind = value["end"], value["kind"]
        state = {name: x.copy() for name, x in value["state"].items()}
        seen, steps = np.zeros(end + 1, np.int64), 0
        for batch in batches:
            for streams in _stream_blocks(batch, end):
                steps += train(state, streams, kind, seen, value["rate"])
        if not steps:
            return
        rows = np.flatnonzero(seen)
        for name, before in value["state"].items():
            if name.removeprefix("sum_") in TABLES:
                at, weight = rows, seen[rows]
            else:
                at, weight = np.arange(len(np.atleast_2d(before))), np.full(len(np.atleast_2d(before)), steps)
            change = (np.atleast_2d(state[name])[at] - np.atleast_2d(before)[at]).astype(np.float64) * weight[:, None]
            for part in range(PARTS):
                mine = at % PARTS == part
                if mine.any():
                    sums = [at[mine].astype(np.int64), weight[mine].astype(np.int64), change[mine].astype(np.float32)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)],
                        names=["name", "part", "at", "weight", "change"],
                    )

    return run


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the parts of all tasks by (name, part); one table of sums is held for each."""
    held: dict[tuple, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            at, weight = (np.frombuffer(row[x], np.int64) for x in ("at", "weight"))
            change = np.frombuffer(row["change"], np.float32).reshape(len(at), -1).astype(np.float64)
            have = held.get((row["name"], row["part"]))
            if have is not None:
                all_at, place = np.unique(np.concatenate((have[0], at)), return_inverse=True)
                total = np.zeros((len(all_at), change.shape[1] + 1))
                total[place[: len(have[0])]] = have[1]
                total[place[len(have[0]) :]] += np.column_stack((change, weight))
                held[row["name"], row["part"]] = [all_at, total]
            else:
                held[row["name"], row["part"]] = [at, np.column_stack((change, weight))]
    for (name, _), (at, total) in held.items():
        mean = (total[:, :-1] / total[:, -1:]).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([at.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], names=["name", "at", "mean"]
        )


def trained(learning: DataFrame, model: dict, value: dict) -> dict:
    """The model after ``STEPS`` rounds over disjoint parts of all learning rows (text, pick, and ids where there).

    In a round every task goes on from the same model with its own texts; each row of weights then moves by the
    mean of the tasks' changes, weighted by the batches that moved it. A text trains in one round, once, whatever the
    size of the input. The size of a model is fixed.
    """
    context = learning.sparkSession.sparkContext
    learning = encoded(learning, value["ranks"])
    coded = {name: value[name] for name in ("end", "kind")}
    state = new_state(model)
    for step in range(STEPS):
        shared = context.broadcast({**coded, "state": state, "rate": RATE * (1 - 0.8 * step / STEPS)})
        some = learning.where(F.pmod("pick", F.lit(STEPS)) == step).select("_llm_ids", "_llm_size")
        changes = some.mapInArrow(tidy(_round_batches(shared)), "name string, part int, at binary, weight binary, change binary")
        for row in changes.repartition(PARTS, "name", "part").mapInArrow(_sum_batches, "name string, at binary, mean binary").collect():
            at = np.frombuffer(row["at"], np.int64)
            np.atleast_2d(state[row["name"]])[at] += np.frombuffer(row["mean"], np.float32).reshape(len(at), -1)
        shared.destroy()
    return {name: state[name] for name in model}


def log_probabilities(model: dict, kind: np.ndarray, inside: np.ndarray, streams: list[np.ndarray], wide: np.ndarray | None = None) -> np.ndarray:
    """log10 P of each stream's ids after the first; ``wide``: the model's tables ``side_by_side``."""
    inputs, goals = np.concatenate([s[:-1] for s in streams]), np.concatenate([s[1:] for s in streams])
    sizes = np.array([len(s) - 1 for s in streams])
    place, fresh = windows_of(sizes)
    wide = side_by_side(model) if wide is None else wide
    goal_kinds = kind[goals]
    out = (inside[goals] if inside.ndim == 1 else inside[kind[inputs], goals]).astype(np.float64)
    forth = _with_bias(model)
    scores, used = np.empty((WINDOWS * CONTEXT, CLASSES), np.float32), np.ones((WINDOWS * CONTEXT, HIDDEN + 1), np.float32)
    for i in range(0, len(place), WINDOWS):
        at, scored = place[i : i + WINDOWS], np.flatnonzero(fresh[i : i + WINDOWS])
        hidden, _ = attended(model, wide, inputs[np.maximum(at, 0)])
        use = at.ravel()[scored]
        logits, h = scores[: len(use)], used[: len(use)]
        h[:, :HIDDEN] = hidden.take(scored, axis=0)
        np.matmul(h, forth, out=logits)
        top = logits[np.arange(len(use)), goal_kinds[use]]
        np.exp(logits, out=logits)
        out[use] += top - np.log(logits @ _ONES[:CLASSES])
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), out, len(sizes)) / np.log(10)


# ---- scoring -------------------------------------------------------------------------------


def streams_of(words: Words, n: int, encode, end: int) -> list[np.ndarray]:
    """End id, ids of the words, end id of each text; each distinct word is encoded once."""
    unique, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    names = [words.joined[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())]
    ids = ids_of_words(names, encode)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    own = sizes[inverse]
    at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begin[inverse], own)
    every = flat[at]
    edges = np.concatenate(([0], np.cumsum(np.bincount(words.text, own, n).astype(np.int64))))
    around = np.array([end], np.int32)
    return [np.concatenate((around, every[a:b], around)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        end, wide = value["end"], side_by_side(value["model"])
        codes, counts = value["codes"], value["counts"]
        base = value["total"] + 0.1 * (value["distinct"] + 1)
        end_part = np.log10((value["ends"] + 0.1) / base)
        for block in (part for batch in batches for part in slices(batch, SCORE_BLOCK)):
            streams = [_stream(x, end) for x in block.column("_llm_ids").to_pylist()]
            scores, first = log_probabilities(value["model"], value["kind"], value["inside"], streams, wide), 0
            for batch in slices(block):
                words = Words(bytes_of(batch.column("text")))
                n = batch.num_rows
                unique, _, number = distinct(words.hash)
                unique = signed(unique)
                at = np.searchsorted(codes, unique)
                at[at == len(codes)] = 0
                met = codes[at] == unique if len(codes) else np.zeros(len(at), bool)
                part = np.where(met, np.log10((counts[at] if len(counts) else 0) + 0.1) - np.log10(base), 0.0)
                known = met[number]
                # the rare words of each text, each once
                rare = np.flatnonzero(~known)
                pairs, times = np.unique(words.text[rare] * len(unique) + number[rare], return_counts=True)
                owner, code = np.divmod(pairs, max(len(unique), 1))
                edges = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
                columns = [
                    pa.array(words.count + 1, pa.int64()),
                    pa.array(np.bincount(words.text, known, n).astype(np.int64) + (value["ends"] > 0), pa.int64()),
                    pa.array(np.bincount(words.text, part[number], n) + end_part, pa.float64()),
                    pa.array(scores[first : first + n]),
                    pa.ListArray.from_arrays(edges, pa.array(unique[code], pa.int64())),
                    pa.ListArray.from_arrays(edges, pa.array(times, pa.int64())),
                ]
                keep = [i for i, name in enumerate(batch.schema.names) if name not in ("text", "_llm_ids")]
                first += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in keep] + columns,
                    names=[batch.schema.names[i] for i in keep] + ["n_tokens", "n_frequent", "part", "score", "rare", "times"],
                )

    return run


def fit(learning: DataFrame, path: str, frequent: int = FREQUENT) -> tuple[DataFrame, dict]:
    """(word counts, model) from learning rows (text, pick, and ids where ``encoded``); pick deals the texts to the rounds of training."""
    context = learning.sparkSession.sparkContext
    ranks = read_ranks(path)
    end = len(ranks)
    learning = encoded(learning, ranks)
    counts = word_counts(learning)
    sums = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("code") == 0, F.col("n")))).first()
    total, distinct, ends = (int(x or 0) for x in sums)
    by_id = learning.select("_llm_ids").mapInArrow(tidy(_id_batches(end)), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    of_id = np.zeros(end + 1)
    for row in by_id:
        of_id[row["id"]] = row["n"]
    kind, inside = classes_of(of_id, ranks)
    # the commonest words: the lowest count that leaves at most ``frequent`` of them
    per_count = counts.where("code <> 0").groupBy(F.least("n", F.lit(4096)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, held = 4097, 0
    for row in per_count:
        if held + row["count"] > frequent:
            break
        least, held = row["n"], held + row["count"]
    common = counts.where((F.col("code") != 0) & (F.least("n", F.lit(4096)) >= least)).select("code", "n").orderBy("code").toArrow()
    by_class = np.bincount(kind, of_id + 0.1, CLASSES)
    coded = {"ranks": ranks, "end": end, "kind": kind}
    in_order = learning.select("_llm_ids", "_llm_size")
    pairs = in_order.mapInArrow(tidy(_pair_batches(context.broadcast({"end": end, "kind": kind}))), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    inside = shares_after(kind, inside, pairs.column("pair").to_numpy(), pairs.column("n").to_numpy())
    model = trained(learning, new_model(end + 1, np.log(by_class / by_class.sum())), coded)
    value = {
        "ranks": ranks, "end": end, "kind": kind, "inside": inside, "model": model, "total": total, "distinct": distinct, "ends": ends,
        "codes": common.column("code").to_numpy(), "counts": common.column("n").to_numpy(), "least": least,
    }
    return counts, value


def score(docs: DataFrame, counts: DataFrame, model: dict) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score, score in place of ``text``."""
    docs = encoded(docs, model["ranks"])
    shared = docs.sparkSession.sparkContext.broadcast({name: x for name, x in model.items() if name != "ranks"})
    keys = [f for f in docs.schema if f.name not in ("text", "_llm_ids", "_llm_size")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys)
    rows = docs.withColumn("_llm_row", F.monotonically_increasing_id()).select(*[f.name for f in keys], "_llm_row", "text", "_llm_ids")
    # written once: the number of a row is kept with it
    scored = written(rows.mapInArrow(tidy(_score_batches(shared)), fields + "_llm_row long, n_tokens long, n_frequent long, part double, score double, rare array<long>, times array<long>"), TEXT_BATCH)
    rare = scored.where(F.size("rare") > 0).select("_llm_row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("_llm_row", F.col("r.rare").alias("code"), F.col("r.times").alias("times"))
    left = counts.where((F.col("code") != 0) & (F.least("n", F.lit(4096)) < model["least"])).select("code", "n")
    base = model["total"] + 0.1 * (model["distinct"] + 1)
    n = F.coalesce("n", F.lit(0))
    more = rare.join(left, "code", "left").groupBy("_llm_row").agg(
        F.sum(F.col("times") * (F.log10(n + 0.1) - float(np.log10(base)))).alias("more"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    return scored.join(more, "_llm_row", "left").select(
        *[f.name for f in keys], "n_tokens", (F.col("n_frequent") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model["total"]).cast("bigint").alias("train_tokens"), (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, folder).select("doc_id", held_back(10, 0).alias("held_out"), "text", F.xxhash64("doc_id", "text").alias("pick"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = encoded(docs, read_ranks(path))
    learning = docs.where("not held_out").select("text", "pick", "_llm_ids", "_llm_size")
    counts, model = fit(learning, path)
    return score(docs.select("doc_id", "held_out", "text", "_llm_ids"), counts, model)
