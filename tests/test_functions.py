import random
import re
import sqlite3
import unicodedata

from pyspark.sql import functions as F

from shelfmark.functions import display, files as fn, metadata as md, text as tx
from shelfmark.sources.packages import resolve_href


def values(spark, func, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.r for r in df.select("i", func(F.col("v")).alias("r")).orderBy("i").collect()]


def test_author_tokens(spark):
    got = values(spark, tx.author_tokens, [
        "Brian Williams; Roderick Gordon", "Éric  VALL_ & ﬁn", None, "a_b __ a_b", "½ Ångström", "Ω한글",
    ])
    assert got[0] == ["brian", "williams", "roderick", "gordon"]
    assert got[1] == ["eric", "vall", "fin"]
    assert got[2] == []
    assert got[3] == ["a_b"]
    for text, tokens in zip(["½ Ångström", "Ω한글"], got[4:]):
        assert tokens == tx.query_author_tokens(text)


def test_author_tokens_match_definition(spark):
    rng = random.Random(3)
    pool = [chr(c) for c in (*range(32, 0x250), *range(0x300, 0x340), *range(0x1E00, 0x1F00), 0xFB01, 0x2460, 0xAC00)]
    texts = ["".join(rng.choices(pool, k=12)) for _ in range(300)]

    def expected(text):
        flat = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
        words = [w.strip("_") for w in re.split(r"[^\w]+", flat)]
        return list(dict.fromkeys(w for w in words if w))

    assert values(spark, tx.author_tokens, texts) == [expected(t) for t in texts]


def test_word_search_agrees_with_a_word_index(spark):
    """The token column and query words behave like a unicode61 index with remove_diacritics 2."""
    rng = random.Random(5)
    pool = list("abcdeéèÉçñøßœ 012.,-_'\"*()«»µſςΣ   ") + ["̀", "ǡ", "ẽ", "\n"]
    texts = ["".join(rng.choices(pool, k=30)) for _ in range(200)]
    words = ["".join(rng.choices(pool, k=rng.randint(1, 3))).strip() for _ in range(400)]
    words = [w.split()[0] for w in words if w.split()]
    index = sqlite3.connect(":memory:")
    index.execute("create virtual table t using fts5(x, tokenize='unicode61 remove_diacritics 2')")
    index.executemany("insert into t(rowid, x) values (?, ?)", enumerate(texts))
    tokens = values(spark, tx.token_string, texts)
    for word in words:
        term = word.replace('"', " ").replace("*", " ").strip()
        if not term:
            continue
        want = {r[0] for r in index.execute("select rowid from t where t match ?", (f'"{term}"*',))}
        phrase = tx.query_words(term)
        got = {i for i, t in enumerate(tokens) if phrase and " " + " ".join(phrase) in t}
        assert got == want, (word, phrase)


def test_plain_text(spark):
    cases = {
        "<p>First</p><p>Second</p>": "First Second",
        "&amp;amp;": "&",
        "<p>Safe</p><script>alert(1)</script>": "Safe",
        "<p></p>": None,
        "&lt;b&gt;bold&lt;/b&gt; move": "bold move",
        "  two\n words ": "two words",
        "a < b": "a < b",
        "x<br/>y<style>p{}</style>z": "x yz",
        " \t": None,
        None: None,
    }
    assert values(spark, tx.plain_text, list(cases)) == list(cases.values())
    needs = values(spark, lambda c: tx.needs_plain_text(c, tx.plain_text(c)), list(cases))
    assert needs == [True, True, True, True, True, True, False, True, False, False]


def test_file_names(spark):
    assert values(spark, fn.sanitize_filename, ["bad:name?.epub", " . .epub", "a​b\tc.epub", "é.epub", "x"]) == [
        "badname.epub", "unnamed.epub", "abc.epub", "é.epub", "x",
    ]
    assert values(spark, fn.suffix, ["a.b.c", ".hidden", "a.", "/x.y/z", "..x"]) == [".c", "", "", "", ".x"]
    assert values(spark, fn.stem, ["a.b.c", ".hidden", "a.", "/x.y/z", "..x"]) == ["a.b", ".hidden", "a.", "z", "."]
    assert values(spark, fn.has_short_basename, ["Kim.epub", "Kim.pdf", "long enough.epub"]) == [True, False, False]
    df = spark.createDataFrame(
        [
            ("Kim.epub", "Kim", "Rudyard Kipling", "Penguin"),
            ("Kim.epub", None, " ", None),
            ("ac.epub", "AC/DC", "X", "Y"),
            ("l.epub", "t" * 177 + " . x", "A", "P"),
            ("a much longer name.epub", "T", "A", "P"),
        ],
        "n string, t string, a string, p string",
    )
    got = [r[0] for r in df.select(fn.target_filename(F.col("n"), F.col("t"), F.col("a"), F.col("p"))).collect()]
    assert got == [
        "Kim - Rudyard Kipling-(Penguin).epub",
        "Kim - Unknown Author-(Unknown Publisher).epub",
        "DC - X-(Y).epub",
        "t" * 177 + ".epub",
        "a much longer name.epub",
    ]


def test_covers(spark):
    assert values(spark, fn.cover_shard, [1, 42, 100, 12342], "long") == ["01", "42", "00", "42"]
    assert values(spark, fn.cover_public_segment, ["data/covers/42/1.jpg", "covers\\1.jpg", "x/1.jpg"]) == ["42/1.jpg", "1.jpg", "x/1.jpg"]
    assert values(spark, fn.cover_book_id, ["c/12.jpg", "c/x.png", "c/+7.png", "c/1_0.png"]) == [12, None, 7, 10]


def test_metadata_values(spark):
    assert values(spark, md.normalize_authors, ["A & B &", " & ", None]) == ["A; B", None, None]
    assert values(spark, md.authors_for_fetch, ["A; B;", ";", None]) == ["A & B", None, None]
    assert values(spark, md.first_language, ["en, fr", " ,fr", None]) == ["en", None, None]
    assert values(spark, md.parse_number, ["1.5", " 2 ", "1_0", "1d", "", "x", None, "1e2", "-inf"]) == [
        1.5, 2.0, 10.0, None, None, None, None, 100.0, float("-inf"),
    ]
    report = "Title : A: B\nTitle: C\nAuthor(s): X & Y\nIdentifiers: google:q, isbn: 123 \nNumber in series: 2.0\njunk"
    row = values(spark, md.parse_tool_output, [report])[0]
    assert (row.title, row.authors, row.isbn, row.series_index, row.tags) == ("C", "X; Y", "123", 2.0, None)
    kind = "array<struct<scheme:string,text:string>>"
    assert values(spark, md.isbn_from_identifiers, [
        [("UUID", "u"), ("ISBN", " 1 ")], [("", "isbn: 22"), ("ISBN", "1")], [("", "123456789X")], [("", "12345")], None,
    ], kind) == ["1", "22", "123456789X", None, None]


def test_display(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 1024 * 1024 - 1, 1024 * 1024, 123456789, 1024 * 1024 + 5243]

    def expected(n):
        if n >= 1 << 20:
            return f"{n / 1024 / 1024:.2f} MB"
        return f"{n / 1024:.1f} KB" if n >= 1024 else f"{n} B"

    assert values(spark, display.format_size, sizes, "long") == [expected(n) for n in sizes]
    dates = {
        "1999": "1999", "1999-03": "March 1999", "1999-13": "1999-13", "1999-03-07": "7 March 1999",
        "1999-03-07T01:00:00": "7 March 1999", "1999-02-30": "1999-02-30", "circa 1900": "circa 1900",
        " ": "", None: "", "0000-01": "0000-01", "2001-05-06 10:00": "6 May 2001",
    }
    assert values(spark, display.format_published_date, list(dates)) == list(dates.values())
    assert values(spark, display.short_number, [1.0, 2.5, 0.25], "double") == ["1", "2.5", "0.25"]


def test_resolve_href():
    assert resolve_href("OEBPS/content.opf", "a%20b.xhtml") == "OEBPS/a b.xhtml"
    assert resolve_href("OEBPS/content.opf", "../../x/./y.html") == "x/y.html"
    assert resolve_href("content.opf", "/z.html") == "z.html"
