"""Queries of the operators of this subpackage over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import encoding, frequencies, leaks, lookalikes, markup, pii, residue, similar_sets
from foliograph.sources import latest_rows, load

Query = Callable[[SparkSession, str], DataFrame]


def _readings(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    return latest_rows(load(spark, base, "page_metadata"), "page_id", list(columns))


def p1_terms(spark: SparkSession, base: str) -> DataFrame:
    """Every tag and category with its occurrences, records and mark."""
    rows = _readings(spark, base, "tags", "category")
    counts = frequencies.term_frequencies(rows, "page_id", {"tags": "array", "category": "string"})
    total = load(spark, base, "page_metadata").agg(F.countDistinct("page_id"))
    return frequencies.mark_terms(counts, total)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Tags and categories too rare or too common to place a page by."""
    return p1_terms(spark, base).filter(F.col("mark").isNotNull()).select("field", "term", "mark")


#: Tables with marked-up text: their key and text column.
_MARKED = {"graph_pages": ("page_id", "raw_content"), "page_bodies": ("body_id", "body")}


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """The kinds of foreign markup each page and body has."""
    out = None
    for table, (key, text) in _MARKED.items():
        found = markup.markup_elements(load(spark, base, table), key, text)
        found = found.select(F.lit(table).alias("src_table"), F.col(key).cast("long").alias("record_id"), "markup", "element")
        out = found if out is None else out.unionByName(found)
    return out


def p2_clean(spark: SparkSession, base: str) -> DataFrame:
    """Every page and body as clean Markdown."""
    out = None
    for table, (key, text) in _MARKED.items():
        texts = markup.clean_texts(load(spark, base, table), key, text)
        texts = texts.select(F.lit(table).alias("src_table"), F.col(key).cast("long").alias("record_id"), "clean")
        out = texts if out is None else out.unionByName(texts)
    return out


#: Share in common and least number of distinct values, by field.
_SIMILAR = {"tags": ("0.6", 4), "wikilinks": ("0.7", 5)}


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of page readings with similar tags or wikilinks."""
    out = None
    for field, (share, least) in _SIMILAR.items():
        pairs = similar_sets.similar_records(_readings(spark, base, field), "page_id", field, share, least)
        pairs = pairs.select(F.lit(field).alias("field"), F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p3_links(spark: SparkSession, base: str) -> DataFrame:
    """Each page reading with the class of its set and its number of similar readings."""
    out = None
    for field, (share, least) in _SIMILAR.items():
        links = similar_sets.similar_links(_readings(spark, base, field), "page_id", field, share, least)
        links = links.select(F.lit(field).alias("field"), F.col("record").alias("page_id"), F.col("class").alias("class_id"), "links")
        out = links if out is None else out.unionByName(links)
    return out


def _titles_and_links(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    entries = latest_rows(load(spark, base, "publish_entries"), "entry_id", ["graph_path", "title"])
    pages = _readings(spark, base, "graph_path", "wikilinks")
    titles = entries.select(F.col("graph_path").alias("scope"), F.col("entry_id").alias("id"), F.col("title").alias("text"))
    links = pages.select(
        F.col("graph_path").alias("scope"), F.col("page_id").alias("id"), F.explode(F.array_distinct("wikilinks")).alias("text")
    )
    return titles, links


def _strings(spark: SparkSession, base: str) -> DataFrame:
    """Every title and link of every delivery: more than the last ones have, without looking for the last."""
    titles = load(spark, base, "publish_entries").select(F.col("title").alias("text"))
    return titles.unionByName(load(spark, base, "page_metadata").select(F.explode("wikilinks").alias("text")))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Titles and links that look like another title but differ as strings."""
    return lookalikes.look_alike_pairs(*_titles_and_links(spark, base), _strings(spark, base))


def p4_forms(spark: SparkSession, base: str) -> DataFrame:
    """The one form of every distinct title and link that isn't its own form."""
    titles, links = _titles_and_links(spark, base)
    return lookalikes.odd_forms(titles.select("text").unionByName(links.select("text")).filter(F.col("text") != "")).filter(F.col("form") != F.col("text"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Personal information in the bodies, as written."""
    return pii.find_personal(load(spark, base, "page_bodies"), "body_id", "body").select("body_id", "kind", "value").distinct()


def p6_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Every body with typed placeholders in place of personal information."""
    return pii.redact(load(spark, base, "page_bodies"), "body_id", "body")


def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return encoding.encode_corpus(load(spark, base, "documents"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents with the test items that leaked into them."""
    return leaks.leaked_items(load(spark, base, "documents"), load(spark, base, "benchmark"))


def p8_spans(spark: SparkSession, base: str) -> DataFrame:
    """The leaked runs of words, for removal."""
    return leaks.leaked_spans(load(spark, base, "documents"), load(spark, base, "benchmark"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that are template residue, filler or error pages."""
    return residue.find_residue(load(spark, base, "documents")).select("doc_id")


def p9_kept(spark: SparkSession, base: str) -> DataFrame:
    """The documents that are left without them."""
    return residue.without_residue(load(spark, base, "documents")).select("doc_id", "source", "lang")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_terms": p1_terms,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p3_found": p3_found,
    "p3_links": p3_links,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_found": p9_found,
    "p9_kept": p9_kept,
}

_TERMS = """
    m AS (SELECT page_id, any_value(tags) AS tags, any_value(category) AS category FROM page_metadata GROUP BY page_id),
    v AS (SELECT 'tags' AS field, unnest(tags) AS term, page_id FROM m UNION ALL SELECT 'category', category, page_id FROM m),
    t AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT page_id) AS records FROM v WHERE term <> '' GROUP BY ALL),
    k AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * (SELECT count(*) FROM m) THEN 'common' END AS mark FROM t)
"""

_SETS = """
    m AS (SELECT page_id, any_value(tags) AS tags, any_value(wikilinks) AS wikilinks FROM page_metadata GROUP BY page_id),
    v AS (SELECT DISTINCT 'tags' AS field, page_id, unnest(tags) AS x FROM m UNION SELECT 'wikilinks', page_id, unnest(wikilinks) FROM m),
    s AS (SELECT field, page_id, count(*) AS n FROM v WHERE x <> '' GROUP BY ALL HAVING n >= CASE field WHEN 'tags' THEN 4 ELSE 5 END),
    c AS (SELECT v.field, v.page_id AS a, w.page_id AS b, count(*) AS o
          FROM v JOIN v AS w ON v.field = w.field AND v.x = w.x AND v.page_id < w.page_id WHERE v.x <> '' GROUP BY ALL),
    p AS (SELECT c.field, a, b FROM c JOIN s ON s.field = c.field AND s.page_id = a JOIN s AS u ON u.field = c.field AND u.page_id = b
          WHERE o * 10 >= CASE c.field WHEN 'tags' THEN 6 ELSE 7 END * (s.n + u.n - o))
"""

def _form(text: str) -> str:
    """The form of a string as SQL: single characters by the same table, then composition, instead of a trie over clusters."""
    singles = {c: to for c, to in lookalikes._singles().items() if c != to}
    quote = lambda x: x.replace("'", "''")
    one = {c: to for c, to in singles.items() if len(to) == 1 and ord(c) > 31 and ord(c) != 127}
    gone = [c for c, to in singles.items() if not to and ord(c) > 31 and not 0xE0000 <= ord(c) < 0xE1000]
    text = f"nfc_normalize({text})"
    for c, to in singles.items():
        if len(to) > 1 and c in "ﬀﬁﬂﬃﬄﬅﬆĲĳǄǅǆǇǈǉǊǋǌǱǲǳ":
            text = f"replace({text}, '{c}', '{quote(to)}')"
    return f"nfc_normalize(translate({text}, '{quote(''.join(one))}{quote(''.join(gone))}', '{quote(''.join(one.values()))}'))"


def _looks() -> str:
    return f"""
    e AS (SELECT entry_id, any_value(graph_path) AS g, any_value(title) AS t FROM publish_entries GROUP BY entry_id),
    m AS (SELECT page_id, any_value(graph_path) AS g, any_value(wikilinks) AS links FROM page_metadata GROUP BY page_id),
    s AS (SELECT entry_id AS id, g, t, 'title' AS side FROM e WHERE t <> '' UNION SELECT page_id, g, t, 'link' FROM (SELECT page_id, g, unnest(links) AS t FROM m) WHERE t <> ''),
    d AS (SELECT DISTINCT t FROM s),
    f AS (SELECT t, CASE WHEN regexp_full_match(t, '[ -~]*') THEN t ELSE {_form("t")} END AS form FROM d),
    w AS (SELECT s.*, f.form FROM s JOIN f USING (t) WHERE form <> '')"""


SQL: dict[str, str] = {
    "p3_links": f"""WITH {_SETS},
        whole AS (SELECT v.field, v.page_id, list(x ORDER BY x) AS xs FROM v JOIN s ON s.field = v.field AND s.page_id = v.page_id WHERE x <> '' GROUP BY ALL),
        ends AS (SELECT field, a AS page_id FROM p UNION ALL SELECT field, b FROM p),
        n AS (SELECT field, page_id, count(*) AS links FROM ends GROUP BY ALL)
        SELECT w.field, w.page_id, min(w.page_id) OVER (PARTITION BY w.field, xs) AS class_id, coalesce(links, 0)::BIGINT AS links
        FROM whole w LEFT JOIN n ON n.field = w.field AND n.page_id = w.page_id""",
    "p4_found": f"""WITH {_looks()}
        SELECT DISTINCT CASE b.side WHEN 'title' THEN 'title_title' ELSE 'link_title' END AS kind, a.id AS id_lo, b.id AS id_hi
        FROM w a JOIN w b ON a.g = b.g AND a.form = b.form AND a.t <> b.t WHERE a.side = 'title' AND (b.side = 'link' OR a.id < b.id)""",
    "p4_forms": f"WITH {_looks()} SELECT DISTINCT t AS text, form FROM w WHERE t <> form",
    "p8_spans": r"""
        WITH doc AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
        ), item AS (
            SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
        ), doc_run AS (
            SELECT doc_id, i, array_to_string(w[i : i + 11], ' ') AS run FROM doc, unnest(generate_series(1, len(w) - 11)) AS s(i)
        ), item_run AS (
            SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS run FROM item, unnest(generate_series(1, len(w) - 11)) AS s(i)
        ), hit AS (
            SELECT DISTINCT doc_id, item_id, i FROM doc_run JOIN item_run USING (run)
        ), isle AS (
            SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS n
            FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) + 12 THEN 0 ELSE 1 END AS fresh FROM hit)
        )
        SELECT doc_id, item_id, min(i) - 1 AS first_word, max(i) + 10 AS last_word FROM isle GROUP BY doc_id, item_id, n
    """,
    "p1_terms": f"WITH {_TERMS} SELECT * FROM k",
    "p1_found": f"WITH {_TERMS} SELECT field, term, mark FROM k WHERE mark IS NOT NULL",
    "p3_found": f"WITH {_SETS} SELECT field, a AS page_id_a, b AS page_id_b FROM p",
    "p8_found": r"""
        WITH doc AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
            FROM documents WHERE text IS NOT NULL
        ), item AS (
            SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
            FROM benchmark WHERE text IS NOT NULL
        ), doc_run AS (
            SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS run
            FROM doc, unnest(generate_series(1, len(w) - 11)) AS s(i)
        ), item_run AS (
            SELECT item_id, array_to_string(w[i : i + 11], ' ') AS run
            FROM item, unnest(generate_series(1, len(w) - 11)) AS s(i)
        )
        SELECT DISTINCT doc_id, item_id FROM doc_run JOIN item_run USING (run)
    """,
}
