"""Text folding, tokens and HTML clean-up as Spark columns.

Everything stays in built-in expressions; the three Python functions (compatibility folding,
composed form, HTML to text) only ever receive the values that built-ins cannot handle, all
other rows send them NULL.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Unicode white space, as one regular-expression class that Java and Python read alike.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_nocase(c: Column) -> Column:
    """ASCII-only case fold: accented letters keep their case."""
    return F.translate(c, _UPPER, _UPPER.lower())


def strip_space(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def squeeze_space(c: Column) -> Column:
    """Collapse each run of white space to one blank and trim."""
    return F.btrim(F.regexp_replace(c, rf"{SPACE}+", " "))


def is_blank(c: Column) -> Column:
    """True for NULL and for white-space-only text."""
    return c.isNull() | (strip_space(c) == "")


def clean_field(c: Column, fallback: Column) -> Column:
    """Squeezed text, or the fallback when nothing is left."""
    return F.coalesce(F.nullif(squeeze_space(c), F.lit("")), fallback)


# --- word search ---------------------------------------------------------------------------

# Folds of single letters that are not an accent on a Latin letter.
_EXTRA_FOLDS = {
    "µ": "μ", "ſ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ",
    "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε",
}
# Combining marks that vanish inside a word; every other mark ends the word.
_WORD_MARKS = (
    r"[\u0300-\u0304\u0306-\u030c\u030f\u0311\u031b\u0323-\u0328\u032d\u032e\u0330\u0331]"
)
# Fixed value: keeps its marks although its decomposition starts with a Latin letter.
_UNFOLDED = {"ǡ"}


def _accent_table() -> dict[str, str]:
    """Lower-case accented Latin letters and their plain letter, by decomposition."""
    table = dict(_EXTRA_FOLDS)
    for code in range(0x80, 0x1F00):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) > 1 and "a" <= parts[0] <= "z" and letter not in _UNFOLDED:
            table[letter] = parts[0]
    return table


_ACCENTS = _accent_table()
_ACCENTS_FROM = "".join(_ACCENTS)
_ACCENTS_TO = "".join(_ACCENTS.values())
_NOT_WORD = r"[^\p{L}\p{N}\p{Co}]+"
_RARE = r"[^\x01-\x7f\p{L}\p{N}\p{Co}]"
# ASCII characters that end a word become blanks in the same pass that drops the accents
_ENDS = "".join(ch for ch in map(chr, range(1, 128)) if not ch.isalnum())


def token_string(c: Column) -> Column:
    """All words of a text, lower case and without Latin accents, each with one blank in front.

    A phrase whose last word is a prefix is then a plain substring test on this column. In a text of
    single bytes each run of what is no letter or digit becomes a blank. In others one
    translation does most of the work; regular expressions run only over texts that hold other
    marks or signs, or long runs of blanks.
    """
    ascii_only = F.octet_length(c) == F.length(c)
    ascii_words = F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    plain = F.translate(F.lower(c), _ACCENTS_FROM + _ENDS, _ACCENTS_TO + " " * len(_ENDS))

    def tidy(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(text, _WORD_MARKS, ""), _NOT_WORD, " ")
        return F.when(text.rlike(_RARE), bare).otherwise(text)

    def single(text: Column) -> Column:
        return F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text)

    text = let(plain, tidy)
    for _ in range(3):
        text = F.replace(text, F.lit("  "), F.lit(" "))
    words = F.btrim(F.when(ascii_only, ascii_words).otherwise(let(text, single)))
    return F.concat(F.lit(" "), F.coalesce(words, F.lit("")))


def query_words(text: str) -> list[str]:
    """The words of a search term, folded like :func:`token_string` folds the column."""
    folded = re.sub(_WORD_MARKS, "", "".join(_ACCENTS.get(ch, ch) for ch in text.lower()))
    kept = "".join(
        ch if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co" else " "
        for ch in folded
    )
    return kept.split()


# --- author tokens -------------------------------------------------------------------------


def _compat_fold(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text)
    return "".join(ch for ch in decomposed if not unicodedata.combining(ch)).lower()


def _native_letters() -> tuple[dict[str, str], str]:
    """Latin letters whose compatibility fold is one letter, and the set needing no Python."""
    single, safe = {}, []
    for code in range(0x80, 0x300):
        letter = chr(code)
        folded = "".join(
            ch for ch in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(ch)
        )
        if len(folded) != 1 or len(folded.lower()) != 1:
            continue
        safe.append(letter)
        if folded != letter:
            single[letter] = folded
    return single, "".join(safe)


_NATIVE, _SAFE = _native_letters()
_NEEDS_PYTHON_FOLD = "[^\\x00-\\x7f" + "".join(f"\\u{ord(ch):04x}" for ch in _SAFE) + "]"


@F.pandas_udf(StringType())
def _compat_fold_udf(values: pd.Series) -> pd.Series:
    return values.map(_compat_fold, na_action="ignore")


def author_fold(c: Column) -> Column:
    """Compatibility-decomposed, marks dropped, lower case."""
    rare = _compat_fold_udf(F.when(c.rlike(_NEEDS_PYTHON_FOLD), c))
    plain = F.lower(F.translate(c, "".join(_NATIVE), "".join(_NATIVE.values())))
    return F.coalesce(rare, plain)


def author_tokens(c: Column) -> Column:
    """Distinct author words in order of appearance; ``_`` counts as a letter but not at an end."""
    raw = F.split(author_fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+")
    words = F.transform(raw, lambda w: F.btrim(w, F.lit("_")))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def query_author_tokens(text: str) -> list[str]:
    """Author words of a search text, folded like :func:`author_tokens`."""
    found: dict[str, None] = {}
    for piece in re.findall(r"\w+", _compat_fold(text)):
        word = piece.strip("_")
        if word:
            found[word] = None
    return list(found)


# --- composed form -------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _composed_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda text: unicodedata.normalize("NFC", text), na_action="ignore")


def composed(c: Column) -> Column:
    """Canonical composed form. Text below U+0300 already is, so only the rest visits Python."""
    return F.coalesce(_composed_udf(F.when(c.rlike(r"[^\x00-\u02ff]"), c)), c)


# --- HTML to text --------------------------------------------------------------------------

# Tags that separate words, and tags whose content is not text.
BREAKING_TAGS = {"p", "div", "br", "hr", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
HIDDEN_TAGS = {"script", "style"}
# Fixed value: what counts as markup.
_MARKUP = r"<[a-zA-Z/!]"
# Fixed value: doubly escaped text is decoded at most this often.
_DECODE_ROUNDS = 3


class _TextOf(HTMLParser):
    """Collects the visible text of one description."""

    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.pieces = 0, []
        self.feed(markup)
        self.close()

    def _at_tag(self, tag: str, step: int) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden + step)
        elif tag in BREAKING_TAGS and not self.hidden:
            self.pieces.append(" ")

    def handle_starttag(self, tag, attrs):
        self._at_tag(tag, 1)

    def handle_endtag(self, tag):
        self._at_tag(tag, -1)

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)


def _visible_text(markup: str) -> str | None:
    text, rounds = markup.strip(), 0
    while rounds < _DECODE_ROUNDS and (decoded := html.unescape(text)) != text:
        text, rounds = decoded, rounds + 1
    if re.search(_MARKUP, text):
        text = "".join(_TextOf(text).pieces)
    return " ".join(text.split()) or None


@F.pandas_udf(StringType())
def _visible_text_udf(values: pd.Series) -> pd.Series:
    return values.map(_visible_text, na_action="ignore")


def plain_text(c: Column) -> Column:
    """Text of an HTML description; NULL when nothing is left.

    Only values with an entity or a tag go through the HTML parser.
    """
    marked = c.contains("&") | c.rlike(_MARKUP)
    parsed = _visible_text_udf(F.when(marked, c))
    return F.when(marked, parsed).otherwise(F.nullif(squeeze_space(c), F.lit("")))


def needs_plain_text(c: Column, cleaned: Column) -> Column:
    """Whether ``cleaned`` (the plain text of ``c``) differs from what is stored."""
    return F.when(c.isNull(), F.lit(False)).otherwise(
        F.when(cleaned.isNull(), ~is_blank(c)).otherwise(cleaned != c)
    )
