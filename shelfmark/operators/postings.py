"""A positional word index: which words stand where in which column of which book.

One row per word, column and book, with the word's places; stored, those of one word in a block of texts are one
row, which is split behind the tests of words. In the order of the words, a search reads the row groups whose
word range it asks for: equality for the inner words of a phrase, a prefix range for the last one. A phrase is found by arithmetic on places (word i of a phrase that starts at s
stands at s + i), so no text is read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions import text as tx
from shelfmark.operators.skew import all_of, any_of
from shelfmark.schema import SEARCH_COLUMNS

ORDER = ("token", "field", "book_id")
# Words are gathered in blocks of texts of about so many bytes.
BLOCK_BYTES = 16 << 20
# At most so many ids that several rows have are broadcast.
REPEATED_IDS = 2_000_000


@dataclass(frozen=True)
class Term:
    """One thing a search box asks for: words in a row, the last one a prefix, in any of some columns."""

    columns: tuple[str, ...]
    phrase: tuple[str, ...]


def search_name(column: str) -> str:
    return f"tok_{column}"


def words_of(books: DataFrame, column: str) -> Column:
    """The stored word string, or the one computed on the fly."""
    name = search_name(column)
    return F.col(name) if name in books.columns else tx.token_string(F.col(column))


def phrases(text: str) -> list[tuple[str, ...]]:
    """The phrases a search text asks for, one per blank-separated word.

    A word holding punctuation is a phrase of its parts. One made of punctuation only is an empty phrase,
    which nothing matches, as in a word index; quotes and stars alone are ignored.
    """
    terms = (word.replace('"', " ").replace("*", " ").strip() for word in text.split())
    return [tuple(tx.query_words(term)) for term in terms if term]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``BLOCK_BYTES`` together."""
    number = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_BYTES
    edges = np.flatnonzero(np.diff(number)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(texts)])


def _block_postings(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """Words, the first id of each, its ids, all its places, and where those of each id end, of one column of some books."""
    held = pc.greater(texts, " ")
    ids, texts = ids.filter(held), texts.filter(held)
    lists = pc.split_pattern(pc.utf8_slice_codeunits(texts, 1), " ")
    codes = lists.flatten().dictionary_encode()
    code, row = codes.indices.to_numpy().astype(np.int64), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    place = np.arange(len(code)) - lists.offsets.to_numpy()[row]
    # by word, then in the order of the texts and places
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    new_word = np.concatenate(([True], code[1:] != code[:-1]))[: len(code)]
    one = np.flatnonzero(new_word | np.concatenate(([True], row[1:] != row[:-1]))[: len(code)])
    first, word = np.flatnonzero(new_word[one]), np.flatnonzero(new_word)
    ends = np.append(one[1:], len(code)) - np.repeat(word, np.diff(np.append(first, len(one))))
    of = ids.take(pa.array(row[one]))
    each = pa.array(np.append(first, len(one)), pa.int32())
    places = pa.ListArray.from_arrays(pa.array(np.append(word, len(code)), pa.int32()), pa.array(place[order], pa.int32()))
    return [
        codes.dictionary.take(pa.array(code[word])), of.take(pa.array(first)), pa.ListArray.from_arrays(each, of),
        places, pa.ListArray.from_arrays(each, pa.array(ends, pa.int32())),
    ]


_BLOCKS = "token string, field string, first_id long, ids array<long>, places array<int>, ends array<int>"
_POSTINGS = "token string, field string, book_id long, positions array<int>"


def _single(blocks: pa.RecordBatch) -> pa.RecordBatch:
    """(token, field, book_id, positions) of blocks, in their order."""
    ids, places, ends = (blocks.column(name) for name in ("ids", "places", "ends"))
    row = pc.list_parent_indices(ids)
    sizes = pc.list_value_length(places).to_numpy().astype(np.int64)
    edges = ends.flatten().to_numpy() + (np.cumsum(sizes) - sizes)[row.to_numpy()]
    positions = pa.ListArray.from_arrays(pa.array(np.append(0, edges), pa.int32()), places.flatten())
    return pa.RecordBatch.from_arrays(
        [blocks.column("token").take(row), blocks.column("field").take(row), ids.flatten(), positions], names=["token", "field", "book_id", "positions"]
    )


def _gather_batches(columns: tuple[str, ...], single: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column in columns:
                texts = batch.column(column).cast(pa.string())
                for a, b in _blocks(texts):
                    token, *found = _block_postings(batch.column("id").slice(a, b - a), texts.slice(a, b - a))
                    field = pa.array([column] * len(token), pa.string())
                    block = pa.RecordBatch.from_arrays([token, field, *found], names=["token", "field", "first_id", "ids", "places", "ends"])
                    yield _single(block) if single else block

    return run


def _gathered(books: DataFrame, columns: tuple[str, ...], single: bool) -> DataFrame:
    """The words of each row with their places, of a block of texts together or single; nothing is exchanged."""
    texts = books.select(F.col("id").cast("bigint").alias("id"), *[words_of(books, name).alias(name) for name in columns])
    return texts.mapInArrow(_gather_batches(columns, single), _POSTINGS if single else _BLOCKS)


def _by_repetition(books: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The books whose id no other row has, and the others if there are any."""
    repeated = books.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    n = repeated.limit(REPEATED_IDS + 1).count()
    if not n:
        return books, None
    held = F.broadcast(repeated) if n <= REPEATED_IDS else repeated
    same = books["id"].eqNullSafe(held["id"])
    return books.join(held, same, "left_anti"), books.join(held, same, "left_semi")


def _regrouped(books: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The postings of rows that share their ids."""
    return _gathered(books, columns, True).groupBy(*ORDER).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def build_postings(books: DataFrame, columns: tuple[str, ...] = SEARCH_COLUMNS) -> DataFrame:
    """(token, field, book_id, positions) of all words of some columns.

    A row of the books gathers its own words, so only those of ids that several rows have are grouped again.
    """
    once, several = _by_repetition(books)
    postings = _gathered(once, columns, True)
    return postings if several is None else postings.unionByName(_regrouped(several, columns))


def posting_blocks(books: DataFrame, columns: tuple[str, ...] = SEARCH_COLUMNS) -> DataFrame:
    """(token, field, first_id, ids, places, ends): the postings of one word in a block of texts as one row, in ranges of the words.

    ``ends`` tells where the places of each id end; a frequent word is cut by the ids its blocks begin with.
    ``books`` is a stored table.
    """
    once, several = _by_repetition(books)
    blocks, order = _gathered(once, columns, False), ("token", "field", "first_id")
    if several is not None:
        alone = _regrouped(several, columns).select(
            "token", "field", F.col("book_id").alias("first_id"), F.array("book_id").alias("ids"), F.col("positions").alias("places"),
            F.array(F.size("positions")).alias("ends"),
        )
        blocks = blocks.unionByName(alone)
    # a file split of texts makes several times its bytes of postings
    parts = 4 * books.rdd.getNumPartitions()
    wide = parts > int(books.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = blocks.repartitionByRange(parts, *order) if wide else blocks.repartitionByRange(*order)
    return ranges.sortWithinPartitions(*order)


def postings_of(blocks: DataFrame) -> DataFrame:
    """The postings of stored blocks; tests of words and columns reach the scan of the blocks."""

    def one(book_id: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
        return F.struct(book_id.alias("book_id"), F.slice("places", before + 1, F.get("ends", i) - before).alias("positions"))

    return blocks.select("token", "field", F.inline(F.transform("ids", one)))


def sync_postings(postings: DataFrame, changed: DataFrame, columns: tuple[str, ...] = SEARCH_COLUMNS) -> DataFrame:
    """The index after the texts of the ``changed`` books were replaced."""
    kept = postings.join(changed.select(F.col("id").alias("book_id")), "book_id", "left_anti")
    return kept.unionByName(build_postings(changed, columns))


def books_with_terms(postings: DataFrame, terms: list[Term]) -> DataFrame:
    """(book_id) of the books that have every term, each in one of its columns.

    One pass over the ranges of the asked words; rows are reduced per book before they are exchanged.
    """
    if not terms:
        return postings.select("book_id").distinct()
    if not all(term.phrase for term in terms):
        return postings.select("book_id").limit(0)

    def asks(term: Term, slot: int) -> Column:
        word = term.phrase[slot]
        token = F.col("token").startswith(word) if slot == len(term.phrase) - 1 else F.col("token") == word
        return token & F.col("field").isin(*term.columns)

    slots = [(t, slot) for t, term in enumerate(terms) for slot in range(len(term.phrase))]
    wanted = [asks(terms[t], slot) for t, slot in slots]
    places = F.transform("positions", lambda p: p - F.col("slot"))
    rows = (
        postings.where(any_of(wanted))
        .withColumn("hit", F.explode(F.array_compact(F.array(*[F.when(w, F.struct(F.lit(t).alias("term"), F.lit(s).alias("slot"))) for w, (t, s) in zip(wanted, slots)]))))
        .select("book_id", "field", "hit.term", "hit.slot", "positions")
    )
    lengths = [len(term.phrase) for term in terms]
    if max(lengths) > 1:
        # a term of one word is found wherever it is
        length = F.element_at(F.array(*map(F.lit, lengths)), F.col("term") + 1)
        rows = rows.withColumn("start", F.explode(F.when(length == 1, F.array(F.lit(0))).otherwise(places)))
        rows = rows.groupBy("book_id", "field", "term", "start").agg(F.size(F.collect_set("slot")).alias("n")).where(F.col("n") == length)
    return rows.groupBy("book_id").agg(F.size(F.collect_set("term")).alias("n")).where(F.col("n") == len(terms)).select("book_id")


def match_terms(books: DataFrame, terms: list[Term]) -> Column:
    """The same as a predicate on the books, which reads the word strings of every row."""
    return all_of([
        any_of([words_of(books, c).contains(" " + " ".join(term.phrase)) for c in term.columns]) if term.phrase else F.lit(False)
        for term in terms
    ])
