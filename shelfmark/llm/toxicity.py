"""Toxicity: lexicon terms found through misspellings, weighed by where they stand.

The lexicon is a trie of words and word beginnings that mark the toxic labels of a bounded sample of
labelled learning rows (``SAMPLE`` at most about; chosen by a hash of the id). A Levenshtein automaton,
intersected with the trie, reads each word of a text, so that words within one edit of a term match
as well. Each match lies in a window of words; a window in quotation marks, or opened by
a reporting mark (colon and quote), counts as quotation, apart from the rest. A logistic
model over these counts, fitted on the same sample, gives the score.

Null and empty texts have no words and get the score of a text without matches; without labels every
score is the share of toxic rows seen (0). Whole texts count; predicting shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.common import checked, documents, held_back, written

SAMPLE = 10_000
TERMS = 400
MIN_SUPPORT = 0.004
MIN_TEXTS = 8
MIN_LOG_ODDS = 2.5
WINDOW = 4
THRESHOLD = 0.3
REMEMBERED = 300_000
STEMS = (4, 5, 6)

_PUNCTUATION = bytes(b if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile("[\"“”„«»]")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()


class Lexicon:
    """A trie of terms; a term ending in ``*`` matches the beginning of a word.

    A state of the automaton is the set of (trie node, edits) that the letters read so far can reach
    with at most one edit. States and their transitions are worked out when first met and kept, so
    that a word costs a look-up a letter and most words end after a few.
    """

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int, bool]]] = [[]]
        for number, term in enumerate(terms):
            stem, node = term.endswith("*"), 0
            word = term.rstrip("*")
            for letter in word:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][letter]
            self.ends[node].append((number, 1 if len(word) >= 5 else 0, stem))
        self.states: dict[frozenset, tuple] = {}
        self.start = self._state({(0, 0)})
        self.seen: dict[bytes, tuple[int, int] | None] = {}

    def _state(self, places: set[tuple[int, int]]) -> tuple | None:
        """(transitions, best whole term, best beginning, places) of a set of places."""
        # a letter of the term that the word lacks
        places |= {(child, 1) for node, edits in places if edits == 0 for child in self.children[node].values()}
        places -= {(node, 1) for node, edits in places if edits == 0}
        if not places:
            return None
        key = frozenset(places)
        if key not in self.states:
            whole = [(edits, n) for node, edits in places for n, allowed, stem in self.ends[node] if edits <= allowed and not stem]
            stems = [(edits, n) for node, edits in places for n, allowed, stem in self.ends[node] if edits <= allowed and stem]
            self.states[key] = ({}, min(whole, default=None), min(stems, default=None), key)
        return self.states[key]

    def _after(self, state: tuple, letter: str) -> tuple | None:
        following = set()
        for node, edits in state[3]:
            if letter in self.children[node]:
                following.add((self.children[node][letter], edits))
            if edits == 0:
                # another letter than the term's, or one too many
                following |= {(child, 1) for child in self.children[node].values()} | {(node, 1)}
        return self._state(following)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term, or None."""
        state, best = self.start, None
        for letter in word:
            known = state[0]
            if letter in known:
                state = known[letter]
            else:
                state = known[letter] = self._after(state, letter)
            if state is None:
                return best
            if state[2] is not None and (best is None or state[2] < best):
                best = state[2]
        return best if state[1] is None or best is not None and best < state[1] else state[1]

    def of(self, word: bytes) -> tuple[int, int] | None:
        if word in self.seen:
            return self.seen[word]
        found = self.match(word.decode("utf-8", "replace")) if len(word) >= 3 else None
        if len(word) > 60:
            return found  # long words hardly come again
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[word] = found
        return found


def features_of(text: str, lexicon: Lexicon) -> list[float]:
    """log counts: exact, misspelt, beginnings, in quotation, most in a window, share of the words."""
    words = words_of(text)
    of = lexicon.of
    found = {w: m for w in set(words) if (m := of(w)) is not None}
    if not found:
        return [0.0] * 7
    places = [i for i, w in enumerate(words) if w in found]
    quoted = set()
    if _QUOTES.search(text):
        # words between an opening mark and the next one, short passages only
        parts = _QUOTES.split(text.lower())
        position = 0
        for number, part in enumerate(parts):
            n = len(words_of(part))
            if number % 2 and number + 1 < len(parts) and n <= 40:
                quoted |= set(range(position, position + n))
            position += n
    exact = misspelt = stems = quotes = 0
    for i in places:
        edits, term = found[words[i]]
        if i in quoted:
            quotes += 1
        elif lexicon.terms[term].endswith("*"):
            stems += edits == 0
            misspelt += 0.5 * (edits > 0)
        elif edits:
            misspelt += 1
        else:
            exact += 1
    spans = np.array([i for i in places if i not in quoted])
    most = int(max(np.searchsorted(spans, spans + WINDOW, side="right") - np.arange(len(spans)))) if len(spans) else 0
    kinds = len({found[words[i]][1] for i in places if i not in quoted and found[words[i]][0] == 0})
    return [*map(float, np.log1p([exact, misspelt, stems, quotes, most, kinds])), 100 * (exact + stems) / (len(words) + 20)]


def learn_terms(texts: list[str], toxic: np.ndarray, limit: int = TERMS) -> list[str]:
    """Words and word beginnings that are much commoner in toxic texts."""
    bad, good = Counter(), Counter()
    for text, label in zip(texts, toxic.tolist()):
        own = {w.decode("utf-8", "replace") for w in set(words_of(text))}
        stems = {w[:n] + "*" for w in own for n in STEMS if len(w) > n}
        (bad if label else good).update(own | stems)
    n_bad, n_good = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    scored = []
    for term, n in bad.items():
        if n < max(MIN_TEXTS, MIN_SUPPORT * n_bad) or len(term) < 4:
            continue
        odds = np.log((n + 0.5) / (n_bad + 1)) - np.log((good[term] + 0.5) / (n_good + 1))
        if odds >= MIN_LOG_ODDS:
            # of terms that say the same the longest first
            scored.append((n * odds * (1 + 0.03 * len(term)), term))
    chosen: list[str] = []
    for _, term in sorted(scored, key=lambda x: (-x[0], x[1])):
        # a term says nothing new if a chosen beginning covers it, or if chosen words make it up
        covered = any(c.endswith("*") and term.startswith(c[:-1]) for c in chosen)
        own = sum(bad[c] for c in chosen if c.startswith(term[:-1])) if term.endswith("*") else 0
        if not covered and own < 0.8 * bad[term]:
            chosen.append(term)
        if len(chosen) == limit:
            break
    return chosen


def fit_logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: constant) by Newton's method."""
    x = np.column_stack((rows, np.ones(len(rows))))
    weights = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - labels) + penalty @ weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(learning: DataFrame, sample: int = SAMPLE) -> dict:
    """Lexicon and weights from labelled (text, toxic, pick) rows; pick orders the sample."""
    n = learning.count()
    share = min(1.0, sample / max(n, 1))
    rows = learning.where(F.pmod("pick", F.lit(1 << 20)) < share * (1 << 20)).orderBy("pick").toArrow()
    texts = [t or "" for t in rows.column("text").to_pylist()]
    labels = np.array(rows.column("toxic").to_pylist(), float)
    if not len(texts) or labels.min() == labels.max():
        return {"terms": [], "weights": None, "base": float(labels.mean()) if len(texts) else 0.0}
    terms = learn_terms(texts, labels)
    lexicon = Lexicon(terms)
    weights = fit_logistic(np.array([features_of(t, lexicon) for t in texts]), labels)
    return {"terms": terms, "weights": weights, "base": float(labels.mean())}


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if "lexicon" not in model:
            model["lexicon"] = Lexicon(model["terms"])
        lexicon, weights = model["lexicon"], model["weights"]
        for batch in batches:
            if weights is None:
                scores = np.full(batch.num_rows, model["base"])
            else:
                rows = np.array([features_of(t.as_py() or "", lexicon) for t in batch.column("text")]).reshape(-1, len(weights) - 1)
                scores = 1 / (1 + np.exp(-np.clip(rows @ weights[:-1] + weights[-1], -30, 30)))
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(scores)], names=[batch.schema.names[i] for i in keep] + ["score"])

    return run


def score(texts: DataFrame, model: dict) -> DataFrame:
    """``score`` in place of ``text``."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema if f.name != "text")
    return texts.mapInArrow(_score_batches(shared), fields + "score double")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, pick) of documents with a label; of several labels the larger counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    known = checked(written(known))
    return docs.join(known, F.col("doc_id") == F.col("label_id")).select("text", "toxic", F.xxhash64("doc_id", "text").alias("pick"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    held_out = held_back(4, 2)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out)
    model = fit(labelled(docs.where(~held_out), labels))
    scored = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
