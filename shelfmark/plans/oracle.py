"""The bound tables and recurring expressions in SQL, for checking the queries independently."""

from __future__ import annotations

import re

A, Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(column: str) -> str:
    return f"translate({column}, '{A}', '{Z}')"


def words(column: str) -> str:
    """Words of a text, each with a blank in front."""
    return (
        f"(' ' || coalesce(trim(regexp_replace(strip_accents(lower({column})), "
        "'[^\\p{L}\\p{N}]+', ' ', 'g')), ''))"
    )


def author_words(column: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex(strip_accents(lower(coalesce({column}, ''))), "
        "'[^\\p{L}\\p{N}_]+'), lambda x: trim(x, '_')), lambda x: x <> '')"
    )


def clean_list(column: str, separator: str, joiner: str) -> str:
    return (
        f"nullif(array_to_string(list_filter(list_transform(string_split({column}, '{separator}'), "
        f"lambda x: trim(x)), lambda x: x <> ''), '{joiner}'), '')"
    )


def base(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$')"


def key(path: str) -> str:
    """The copy with the greatest key stays."""
    return f"row(length({base(path)}), length({path}), {path})"


TITLE_KEY = fold("coalesce(nullif(sort_title, ''), nullif(title, ''), file_name)")

# order by clauses of the listing sorts, with the directions they start with
ORDERS = {
    "title": f"{TITLE_KEY} ASC NULLS FIRST, id",
    "author": f"{fold('authors')} ASC NULLS FIRST, id",
    "published": "published_date IS NULL, published_date DESC, id",
    "size": "file_size DESC, id",
    "pages": "page_count IS NULL, page_count DESC, id",
    "scanned": "last_scanned_at DESC, id",
}

LIB = "(file_path = '/lib' OR starts_with(file_path, '/lib/'))"

# fmt: off
TABLES = {
    "docs": """
        SELECT *, nullif(trim(split_part(text, chr(10), 1)), '') AS first_line,
          CASE WHEN source = 'src19' THEN '/archive' ELSE '/lib' END || '/' || source || '/' || lang
            || '/shelf-' || (doc_id % 100) || '/' || name AS book_path
        FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN doc_id || '.epub' WHEN 1 THEN 'volume ' || doc_id || '.epub'
          WHEN 2 THEN 'bad:name?  ' || doc_id || '.epub' ELSE 'Collected works ' || doc_id || '.epub' END AS name
          FROM documents)""",
    "books": """
        SELECT doc_id AS id, book_path AS file_path, name AS file_name,
          CASE doc_id % 97 WHEN 0 THEN 'doc' WHEN 1 THEN 'EPUB' ELSE 'epub' END AS format,
          n_chars AS file_size, (doc_id + 1700000000) * 1000000 AS file_mtime,
          CASE WHEN doc_id % 19 <> 0 THEN sha1(text) END AS content_hash,
          CASE doc_id % 4 WHEN 0 THEN 'data/covers/' || doc_id || '.jpg'
            WHEN 1 THEN 'data/covers/' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '/' || doc_id || '.png'
            WHEN 3 THEN 'data/covers/' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '/' || doc_id || '.jpeg' END AS cover_path,
          first_line AS title, CASE WHEN doc_id % 3 <> 0 THEN first_line END AS sort_title,
          CASE WHEN doc_id % 11 <> 0 THEN split_part(first_line, ' ', 1) || '; ' || split_part(first_line, ' ', 2) END AS authors,
          CASE WHEN doc_id % 5 = 0 THEN 'Éditions ' || source ELSE source || ' Press' END AS publisher,
          CASE doc_id % 6 WHEN 1 THEN y WHEN 2 THEN y || '-' || m WHEN 3 THEN y || '-' || m || '-' || d
            WHEN 4 THEN y || '-' || m || '-' || d || 'T00:00:00+00:00' WHEN 5 THEN 'circa ' || y END AS published_date,
          CASE WHEN doc_id % 9 <> 0 THEN '978' || lpad(doc_id::VARCHAR, 10, '0') END AS isbn,
          CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN ' ' ELSE lang END AS language,
          text AS description,
          CASE WHEN doc_id % 8 = 0 THEN 'Series ' || (doc_id % 40) END AS series,
          CASE WHEN doc_id % 8 = 0 THEN (doc_id % 48) / 16.0::DOUBLE END AS series_index,
          CASE WHEN doc_id % 7 <> 0 THEN n_chars // 1800 END AS page_count,
          lang || ' prose, ' || source AS tags,
          '2024-01-' || d || 'T00:00:00+00:00' AS first_seen_at,
          '2024-02-' || d || 'T' || lpad((doc_id % 24)::VARCHAR, 2, '0') || ':00:00+00:00' AS last_scanned_at,
          doc_id % 17 = 0 AS is_missing, doc_id % 2 = 0 AS epub_validated,
          doc_id % 4 = 0 AS epub_deep_validated, doc_id % 5 = 0 AS epub_version2
        FROM (SELECT *, '19' || lpad((doc_id % 100)::VARCHAR, 2, '0') AS y,
          lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') AS m, lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS d FROM docs)""",
    "toxics": "SELECT DISTINCT doc_id FROM labels WHERE toxic = 1",
    "inventory": """
        SELECT CASE doc_id % 10 WHEN 1 THEN '/lib/moved/' || source || '/' || doc_id || '-copy.epub' ELSE book_path END AS path,
          CASE doc_id % 10 WHEN 2 THEN n_chars + 10 ELSE n_chars END AS file_size,
          (doc_id + 1700000000 + CASE doc_id % 10 WHEN 1 THEN 86400 WHEN 2 THEN 3600 WHEN 4 THEN 60 ELSE 0 END) * 1000000 AS file_mtime,
          sha1(CASE doc_id % 10 WHEN 2 THEN text || ' (revised)' ELSE text END) AS content_hash
        FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM toxics)
        UNION ALL
        SELECT '/lib/copies/' || lang || '/' || name, n_chars, (doc_id + 1700000000) * 1000000, sha1(text)
        FROM docs WHERE doc_id % 10 = 3 AND doc_id NOT IN (SELECT doc_id FROM toxics)
        UNION ALL
        SELECT '/lib/incoming/' || page_id || '.epub', length(html), (page_id + 1700000000) * 1000000, sha1(html) FROM pages""",
    "covers": """
        SELECT unnest(CASE doc_id % 4 WHEN 0 THEN ['covers/' || doc_id || '.jpg']
          WHEN 1 THEN ['covers/' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '/' || doc_id || '.png']
          WHEN 2 THEN ['covers/' || doc_id || '.jpg', 'covers/' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '/' || doc_id || '.png']
          ELSE ['covers/' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '/' || doc_id || '.JPEG'] END) AS path FROM documents
        UNION ALL
        SELECT CASE WHEN page_id % 2 = 0 THEN 'covers/cover-' || page_id || '.png'
          ELSE 'covers/' || (page_id + 1000000000) || '.jpg' END FROM pages""",
    "cover_ids": "SELECT path, try_cast(regexp_extract(path, '([^/]*)\\.[^./]*$', 1) AS BIGINT) AS book_id FROM covers",
    "users": "SELECT c_custkey AS id, trim(c_name) AS username, '2024-06-01T00:00:00+00:00' AS created_at FROM customer",
    "favorites": """
        SELECT DISTINCT user_id, event_id % (SELECT count(*) FROM documents) AS book_id
        FROM events WHERE event_type = 'purchase'""",
    "changes": """
        SELECT user_id, event_id % (SELECT count(*) FROM documents) AS book_id, event_type = 'click' AS favorite, event_id AS seq
        FROM events WHERE event_type IN ('click', 'error')""",
    "marks": "SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id",
    "proposed": """
        SELECT doc_id AS id, CASE WHEN toxic = 0 THEN 'Title of ' || source END AS title, 'Author ' || lang AS authors,
          'Q' || quality AS publisher, '1999' AS published_date, lang AS language, 2.5::DOUBLE AS series_index,
          '2024-06-01T00:00:00+00:00' AS last_scanned_at
        FROM documents JOIN marks USING (doc_id)""",
    "edits": """
        SELECT doc_id AS id, CASE WHEN toxic = 0 THEN 'Edited ' || source END AS title,
          CASE WHEN quality = 1 THEN 'Editor ' || lang END AS authors, CASE WHEN quality = 0 THEN lang END AS genre
        FROM documents JOIN marks USING (doc_id)""",
    "conversions": """
        SELECT doc_id AS id, quality = 1 AS ok, sha1('v2 ' || text) AS content_hash, n_chars + 3 AS file_size,
          (doc_id + 1700007200) * 1000000 AS file_mtime,
          CASE WHEN doc_id % 2 = 0 THEN 'data/covers/new/' || doc_id || '.jpg' END AS cover_path
        FROM documents JOIN marks USING (doc_id)""",
    "author_index": "SELECT DISTINCT id AS book_id, unnest(" + author_words("authors") + ") AS token FROM books",
    "unindexed": "SELECT * FROM inventory WHERE path NOT IN (SELECT file_path FROM books)",
    "canon": """
        SELECT content_hash, min(id) AS canon_id, arg_min(file_path, id) AS canon_path FROM books
        WHERE content_hash IS NOT NULL GROUP BY content_hash""",
    "copy_groups": f"""
        SELECT g.content_hash, c.canon_id AS book_id, c.canon_path, i.path IS NOT NULL AS there,
          CASE WHEN i.path IS NOT NULL AND {key('c.canon_path')} > {key('g.best')} THEN c.canon_path ELSE g.best END AS keeper,
          g.files - 1 + (i.path IS NOT NULL)::INT AS n_remove
        FROM (SELECT content_hash, count(*) AS files, arg_max(path, {key('path')}) AS best FROM unindexed GROUP BY content_hash) g
        LEFT JOIN canon c USING (content_hash) LEFT JOIN inventory i ON i.path = c.canon_path""",
    "listed_groups": """
        SELECT * FROM copy_groups
        WHERE n_remove > 0 OR (book_id IS NOT NULL AND canon_path <> keeper)""",
    "copy_members": """
        SELECT u.content_hash, u.path, g.keeper FROM unindexed u JOIN copy_groups g USING (content_hash) WHERE u.path <> g.keeper
        UNION ALL
        SELECT content_hash, canon_path, keeper FROM copy_groups WHERE there AND canon_path <> keeper""",
    "classified": f"""
        SELECT path, file_size, file_mtime, content_hash, status,
          CASE WHEN status = 'repointed' THEN canon_id ELSE existing_id END AS book_id,
          CASE WHEN status = 'repointed' AND there THEN canon_path END AS delete_path
        FROM (SELECT *, CASE
            WHEN calm THEN 'unchanged'
            WHEN foreign_row AND existing_id IS NULL AND (NOT there OR outranks) AND path = best_free THEN 'repointed'
            WHEN foreign_row AND existing_id IS NOT NULL AND (NOT there OR outranks) THEN 'conflict'
            WHEN foreign_row THEN 'duplicate'
            WHEN old_hash = content_hash THEN 'unchanged'
            WHEN path = index_path THEN 'to_index'
            WHEN existing_id IS NOT NULL AND {key('path')} > {key('index_path')} THEN 'conflict'
            ELSE 'duplicate' END AS status
          FROM (SELECT s.* REPLACE (CASE WHEN calm THEN NULL ELSE s.content_hash END AS content_hash),
              c.canon_id, c.canon_path, c.canon_path IN (SELECT path FROM inventory) AS there,
              c.canon_id IS NOT NULL AND (s.existing_id IS NULL OR s.existing_id <> c.canon_id) AS foreign_row,
              {key('s.path')} > {key('c.canon_path')} AS outranks, g.best_free, coalesce(g.owner, g.best_free) AS index_path
            FROM suspects_all s LEFT JOIN canon c USING (content_hash)
            LEFT JOIN (SELECT content_hash,
                arg_max(path, {key('path')}) FILTER (existing_id IS NULL) AS best_free,
                arg_min(path, existing_id) FILTER (existing_id IS NOT NULL) AS owner
              FROM suspects_all WHERE NOT calm GROUP BY content_hash) g USING (content_hash)))""",
    "suspects_all": """
        SELECT i.*, b.id AS existing_id, b.content_hash AS old_hash,
          coalesce(b.file_size = i.file_size AND b.file_mtime = i.file_mtime, false) AS calm
        FROM inventory i LEFT JOIN books b ON b.file_path = i.path""",
    "wanted_names": """
        SELECT id, file_path, file_name, dir,
          CASE WHEN ext = '' THEN stem ELSE
            coalesce(nullif(trim(left(clean, 180), ' .'), ''), 'unnamed') || ext END AS wanted
        FROM (SELECT *, CASE WHEN trim(squeezed, ' .') = '' THEN 'unnamed' ELSE trim(squeezed, ' .') END AS clean
          FROM (SELECT *, regexp_replace(regexp_replace(long_stem, '[\\p{C}/\\\\<>:"|?*]', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g') AS squeezed
            FROM (SELECT *, CASE WHEN length(stem) < 10 THEN regexp_extract(meta, '[^/]*$') ELSE stem END AS long_stem
              FROM (SELECT *, coalesce(nullif(trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g')), ''), stem) || ' - '
                  || coalesce(nullif(trim(regexp_replace(authors, '[\\s\\p{Z}]+', ' ', 'g')), ''), 'Unknown Author') || '-('
                  || coalesce(nullif(trim(regexp_replace(publisher, '[\\s\\p{Z}]+', ' ', 'g')), ''), 'Unknown Publisher') || ')' AS meta
                FROM (SELECT *, regexp_extract(file_path, '([^/]*)\\.epub$', 1) AS stem, '.epub' AS ext,
                    regexp_replace(file_path, '/[^/]*$', '') AS dir FROM books)))))""",
    "fixes": f"""
        SELECT id, file_path, file_name, dir, wanted FROM wanted_names
        WHERE id IN (SELECT id FROM books WHERE NOT is_missing) AND {LIB}
          AND file_path IN (SELECT path FROM inventory)""",
    "renames": f"""
        SELECT id, file_path, dir || '/' || CASE WHEN n = 1 THEN wanted ELSE regexp_replace(wanted, '\\.epub$', '') || ' (' || n || ').epub' END AS to_path
        FROM (SELECT *, row_number() OVER (PARTITION BY dir, wanted ORDER BY id) AS n FROM fixes WHERE wanted <> {base('file_path')})""",
    "dir_parts": """
        SELECT DISTINCT array_to_string(p[1:n], '/') AS path FROM (
          SELECT p, unnest(range(2, len(p))) AS n FROM (
            SELECT string_split(book_path, '/') AS p FROM docs UNION ALL SELECT string_split(path, '/') FROM inventory))""",
    "used_dirs": """
        SELECT DISTINCT array_to_string(p[1:n], '/') AS path FROM (
          SELECT p, unnest(range(2, len(p))) AS n FROM (SELECT string_split(path, '/') AS p FROM inventory))""",
    "backfill": """
        SELECT f.id, f.content_hash, coalesce(c.canon_id, min(f.id) OVER (PARTITION BY f.content_hash)) AS winner
        FROM (SELECT b.id, i.content_hash FROM books b JOIN inventory i ON i.path = b.file_path WHERE b.content_hash IS NULL) f
        LEFT JOIN canon c USING (content_hash)""",
}
# fmt: on


def sql(body: str) -> str:
    """``body`` with the bound tables it names, and those they name, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({TABLES[name]})" for name in needed)
    return f"WITH {parts}\n{body}"
