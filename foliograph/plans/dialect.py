"""Pieces of SQL that several oracle queries share; none of it is used by the Spark plans."""

from __future__ import annotations

PAGES = """
    latest AS (SELECT page_id, max_by(graph_path, loaded_at) AS graph, max_by(title, loaded_at) AS title, max_by(file, loaded_at) AS file,
                      coalesce(arg_max_null(raw_content, loaded_at), '') AS content, max(created_at) AS c, arg_max_null(deleted_at, loaded_at) AS d
               FROM graph_pages GROUP BY page_id),
    pages AS (SELECT * FROM latest WHERE d IS NULL QUALIFY row_number() OVER (PARTITION BY graph, title ORDER BY c DESC, page_id DESC) = 1)"""
ENTRIES = """
    entries AS (SELECT entry_id, any_value(graph_path) AS graph, any_value(entry_index) AS entry_index, any_value(title) AS title,
                       any_value(tier) AS tier, any_value(backlinks) AS backlinks, any_value(exclude) AS exclude, any_value(redact) AS redact,
                       any_value(file) AS file, any_value(filters) AS filters
                FROM publish_entries GROUP BY entry_id),
    filt AS (SELECT graph, entry_index, title, pos - 1 AS pos, f.prepend AS prepend, f.append AS append, f.redact AS mode
             FROM (SELECT graph, entry_index, title, unnest(filters) AS f, generate_subscripts(filters, 1) AS pos FROM entries))"""
BODIES = "bodies AS (SELECT body_id, coalesce(any_value(body), '') AS content FROM page_bodies GROUP BY body_id)"

#: Blanks, and those that don't end a line.
BLANK = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LINE_BLANK = BLANK.replace(r"\n", "")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{BLANK}+|{BLANK}+\z', '', 'g')"


def decode(x: str) -> str:
    for old, new in (("&sect;", "§"), ("&mdash;", "—"), ("&ndash;", "–"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&middot;", "·"), ("&hellip;", "…"), ("&amp;", "&")):
        x = f"replace({x}, '{old}', '{new}')"
    return x


def file_names(title: str) -> str:
    """The five names a page's file can have."""
    return f"[{title}, replace({title}, '/', '___'), replace({title}, ':', '%3A'), replace({title}, '?', '%3F'), replace({title}, '\"', '%22')]"


def found_files(name: str, wanted: str) -> str:
    """CTE ``name`` (graph, title, file): the first file name that is there, of each title of ``wanted``."""
    return f"""
    {name} AS (SELECT graph, title, min_by(file, k) AS file FROM (
        SELECT w.graph, w.title, w.k, p.file FROM (
            SELECT graph, title, unnest([0, 1, 2, 3, 4]) AS k, unnest({file_names('title')}) || '.md' AS name FROM (SELECT DISTINCT graph, title FROM {wanted})) w
        JOIN pages p ON p.graph = w.graph AND p.file = w.name) GROUP BY ALL)"""


RESOLVED = f"""
    tries AS (SELECT graph, entry_index, title, 0 AS rank, file AS name FROM entries WHERE file <> ''
              UNION ALL SELECT graph, entry_index, title, k, n || '.md' FROM (
                  SELECT graph, entry_index, title, unnest([0, 1, 2, 3, 4]) AS k, unnest({file_names('title')}) AS n
                  FROM entries WHERE file IS NULL OR file = '')),
    resolved AS (SELECT e.graph, e.entry_index, e.title, min_by(p.file, t.rank) AS page_file
                 FROM entries e JOIN tries t ON t.graph = e.graph AND t.entry_index = e.entry_index AND t.title = e.title
                 LEFT JOIN pages p ON p.graph = t.graph AND p.file = t.name GROUP BY ALL)"""

LINK = r"'\[\[([^\[\]|]+?)(?:\|[^\]]+)?\]\]'"
EDGES = rf"""
    line AS (SELECT graph, title AS src, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM pages),
    body AS (SELECT *, coalesce(bool_or(NOT regexp_matches(x, '^[A-Za-z0-9_-]+::') AND trim(x, E' \t\r') <> '') OVER (PARTITION BY graph, src ORDER BY i), false) AS after FROM line),
    link AS (SELECT graph, src, i, k, {decode("trim(t, E' \\t\\r\\n')")} AS dst, CASE WHEN NOT after AND regexp_matches(x, '^(?i:related)::\s*\S') THEN 2 ELSE 1 END AS weight
             FROM (SELECT *, unnest(regexp_extract_all(x, {LINK}, 1)) AS t, generate_subscripts(regexp_extract_all(x, {LINK}, 1), 1) AS k FROM body)),
    edge AS (SELECT graph, src, dst, max(weight) AS weight, min(i * 100000 + k) AS seq FROM link
             WHERE dst <> '' AND dst <> src AND NOT regexp_matches(dst, '^\d{{4}}-\d{{2}}-\d{{2}}$') GROUP BY ALL)"""


def prop(key: str) -> str:
    return rf"nullif(trim(regexp_extract(content, '(?m)^{key}::\s*(.+)$', 1), E' \t\r'), '')"


LINKS = rf"list_distinct(list_filter(list_transform(regexp_extract_all(content, {LINK}, 1), lambda t: {decode("trim(t, E' \\t\\r\\n')")}), lambda t: length(t) BETWEEN 1 AND 199))"
_TAGS = rf"""CASE WHEN len(regexp_extract_all(coalesce({prop("tags")}, ''), {LINK}, 1)) > 0
             THEN regexp_extract_all({prop("tags")}, {LINK}, 1)
             ELSE list_filter(list_transform(string_split(coalesce({prop("tags")}, ''), ','), lambda t: trim(t)), lambda t: t <> '') END"""
META = f"meta AS (SELECT graph, title, file, {prop('category')} AS category, {prop('type')} AS type, {prop('project')} AS project, {_TAGS} AS tags, {LINKS} AS links FROM pages)"

#: Titles that pages of the manifest name, that have a page and aren't in it: both ends by the names of files.
NEAR = f"""{found_files('source', 'entries')},
    named AS (SELECT DISTINCT graph, title FROM (
        SELECT m.graph, unnest(m.links) AS title FROM (SELECT DISTINCT graph, file FROM source) s JOIN meta m ON m.graph = s.graph AND m.file = s.file) x
        WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.graph = x.graph AND e.title = x.title)),
    {found_files('there', 'named')},
    near AS (SELECT graph, title FROM there)"""

HASHED = (
    r"substr(sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), "
    r"'(?m)^[ \r]+|[ \r]+$', '', 'g'), '\n+', chr(10), 'g'), '^\n+|\n+$', '', 'g')), 1, 16)"
)

#: Full-width forms and the letters they stand for.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))


def vault_title(x: str) -> str:
    plain = f"replace(regexp_replace(replace({x}, ' / ', ', '), '[/\\\\]', '-', 'g'), ':', ' -')"
    bare = f"regexp_replace({plain}, '[*?\"<>|]', '', 'g')"
    return strip(f"regexp_replace({bare}, '{BLANK}+', ' ', 'g')")


def route_slug(x: str) -> str:
    narrow = "translate(lower({0}), '{1}', '{2}')".format(x, _WIDE.replace("'", "''"), _NARROW.replace("'", "''"))
    for joined, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ĳ", "ij"), ("§", "section"), ("…", "..."), ("™", "TM")):
        narrow = f"replace({narrow}, '{joined}', '{letters}')"
    kept = rf"regexp_replace(strip_accents({narrow}), '[^A-Za-z0-9_\-\t\n\x0B\f\r \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', '', 'g')"
    return f"substr(regexp_replace(regexp_replace(regexp_replace({kept}, '{BLANK}+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 80)"


#: Leading properties of pages; of a key that comes twice the last holds.
PROPERTIES = rf"""
    block AS (SELECT graph, title, string_split(regexp_extract(content, '\A(?:{LINE_BLANK}*\n)*((?:[A-Za-z0-9_-]+::[^\n\r\x{{2028}}\x{{2029}}]+(?:\n|\z))*)', 1), chr(10)) AS xs FROM pages),
    row AS (SELECT graph, title, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM block),
    props AS (SELECT graph, title, regexp_extract(x, '^([^:]+)::', 1) AS key, max_by({strip("regexp_extract(x, '^[^:]+::(.*)$', 1)")}, i) AS value FROM row WHERE x <> '' GROUP BY ALL)"""
