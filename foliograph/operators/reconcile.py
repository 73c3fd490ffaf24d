"""Pages that are partly projected from a source: marked regions follow the source, all others are left alone.

A page and its desired form are compared region by region; the source wins. Regions are those of
:mod:`foliograph.operators.regions` in all their forms, told here for one text at a time; the outermost projected
ones count, and whatever lies between them is free. The table of region hashes from the last run (the bridge) is
joined by equality. Where nothing says otherwise: a created region is put behind the projected region before it in
the source (at the end of the page without one), and a free region with the id of a desired one stays and the
desired one is created beside it.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliograph.functions import text as T
from foliograph.operators import recall, transform
from foliograph.operators import regions as R
from foliograph.operators.pages import resolve
from foliograph.sources import present

_heading = re.compile(R.HEADING.replace(r"\z", r"\Z"))
_section_heading, _opens, _closes, _component, _component_end = (
    re.compile(p.replace(r"\z", r"\Z")) for p in (R.SECTION_HEADING, R.COMMENT_OPEN, R.COMMENT_CLOSE, R.COMPONENT_OPEN, R.COMPONENT_CLOSE)
)
_id, _level, _source = (re.compile(p) for p in (R.ID_ATTRIBUTE, R.LEVEL_ATTRIBUTE, R.SOURCE_ATTRIBUTE))
_anchor = re.compile(R.PROJECTED_ANCHOR)
_comment = re.compile(R.PROJECTED_COMMENT.replace(r"\z", r"\Z"))
_grounded = re.compile(r"(?m)^\s*citation-recall::")
_recall = re.compile(r"(?m)^\s*citation-recall::\s*([0-9.]+)")

#: In what order verdicts and states are shown.
VERDICTS = ("remove", "regenerate", "create", "unchanged")
STATES = ("hash-mismatch", "orphan", "stale", "synced")


@dataclass(frozen=True)
class Region:
    """A region of a page: its lines from ``start`` to before ``end``, body included, and where it is projected from."""

    id: str
    start: int
    end: int
    body: str
    text: str
    source: str | None


def slug(text: str) -> str:
    """Id of a heading; the rule of :func:`foliograph.functions.text.region_slug`."""
    return re.sub(r"[^a-z0-9]+", "-", re.sub("['’]", "", text.lower())).strip("-")


def body_hash(body: str) -> str:
    """The rule of :func:`foliograph.functions.text.content_hash`."""
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in re.split(r"\r?\n", body)]
    return hashlib.sha256("\n".join(x for x in lines if x).encode()).hexdigest()[:16]


def projected_marker(anchor: str, body: list[str]) -> str | None:
    """Where a region comes from: named by its anchor, else by the comment its body begins with; None if it is free."""
    if _anchor.search(anchor):
        found = _source.search(anchor)
    else:
        marker = _comment.match(next((x.strip() for x in body if x.strip()), ""))
        found = _source.search(marker[1]) if marker else None
    return found[1] if found else None


def _heads(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line, level, id) of headings, those written as components included."""
    out = []
    for i, x in enumerate(lines):
        if (m := _heading.match(x)) is not None:
            out.append((i, len(m[1]), slug(m[2])))
        elif _section_heading.match(x) and (m := _id.search(x)) is not None:
            level = _level.search(x)
            out.append((i, int(level[1]) if level else 2, m[1]))
    return out


def regions(content: str) -> list[Region]:
    """All regions of a page in the order of their lines, an outer one before an inner one."""
    lines = content.split("\n")
    out: list[Region] = []

    def add(name: str, start: int, end: int, body: list[str]) -> None:
        out.append(Region(name, start, end, "\n".join(body), "\n".join(lines[start:end]), projected_marker(lines[start], body)))

    heads = _heads(lines)
    for k, (i, level, name) in enumerate(heads):
        end = next((j for j, other, _ in heads[k + 1 :] if other <= level), len(lines))
        add(name, i, end, lines[i + 1 : end])
    for opening, closing in ((_opens, _closes), (_component, _component_end)):
        for i, x in enumerate(lines):
            if (m := opening.match(x)) is not None:
                end = next((j for j in range(i + 1, len(lines)) if closing.match(lines[j])), None)
                if end is not None:
                    add(m[1], i, end + 1, lines[i + 1 : end])
    return sorted(out, key=lambda r: (r.start, -r.end))


def projected_regions(content: str) -> list[Region]:
    """The outermost projected regions, which therefore don't overlap; of an id that comes twice the first counts."""
    out: list[Region] = []
    seen: set[str] = set()
    for r in regions(content):
        if r.source is not None and r.id not in seen and (not out or r.start >= out[-1].end):
            out.append(r)
            seen.add(r.id)
    return out


def stamp(content: str, title: str) -> str:
    """The page with a marker below every heading that says which region of ``title`` it comes from; stamped ones stay."""
    lines = content.split("\n")
    after = {}
    for k, (i, _, name) in enumerate(_heads(lines)):
        if projected_marker(lines[i], lines[i + 1 :]) is None:
            after[i] = f'<!-- projected: source="{title}#{name}" -->'
    return "\n".join(x for i, line in enumerate(lines) for x in ((line, after[i]) if i in after else (line,)))


def plan(desired: str, current: str, prior: dict[str, str] | None = None) -> list[dict]:
    """One item per projected region: ``unchanged``, ``regenerate``, ``create`` or ``remove``, and whether it was edited by hand.

    ``prior``: hash of each region's body at the last run.
    """
    want = {r.id: r for r in projected_regions(desired)}
    have = {r.id: r for r in projected_regions(current)}
    items = []
    for name, r in want.items():
        old = have.get(name)
        edited = old is not None and prior is not None and name in prior and body_hash(old.body) != prior[name]
        verdict = "create" if old is None else "unchanged" if body_hash(old.body) == body_hash(r.body) else "regenerate"
        items.append({"id": name, "source": r.source, "verdict": verdict, "drift": "hand-edited" if edited else None})
    items += [{"id": name, "source": r.source, "verdict": "remove", "drift": None} for name, r in have.items() if name not in want]
    return items


def bridge_of(content: str) -> dict[str, str]:
    """Hash of the body of every projected region."""
    return {r.id: body_hash(r.body) for r in projected_regions(content)}


def _blocks(content: str) -> list[tuple[str | None, str]]:
    """The page as (id, text): projected regions, and the free stretches between them with no id."""
    lines = content.split("\n")
    out: list[tuple[str | None, str]] = []
    at = 0
    for r in projected_regions(content):
        if r.start > at:
            out.append((None, "\n".join(lines[at : r.start])))
        out.append((r.id, r.text))
        at = r.end
    return out + ([(None, "\n".join(lines[at:]))] if at < len(lines) and "".join(lines[at:]) else [])


def _ordered(blocks: list[tuple[str | None, str]], order: list[str]) -> tuple[list[tuple[str | None, str]], list[str]]:
    """Blocks whose projected regions take their places in the order of the source, and the ids that moved; free ones stay."""
    places = [k for k, (name, _) in enumerate(blocks) if name in order]
    by_id = {name: text for name, text in blocks if name is not None}
    ranked = sorted((blocks[k][0] for k in places), key=order.index)
    moved = [name for k, name in zip(places, ranked) if blocks[k][0] != name]
    out = list(blocks)
    for k, name in zip(places, ranked):
        out[k] = (name, by_id[name])
    return out, moved


def reorder(current: str, desired: str) -> dict:
    """(``content``, ``moved``): the page with its projected regions in the order of the source."""
    blocks, moved = _ordered(_blocks(current), [r.id for r in projected_regions(desired)])
    return {"content": "\n".join(_spaced([text for _, text in blocks])) if moved else current, "moved": moved}


def apply(desired: str, current: str, prior: dict[str, str] | None = None) -> dict:
    """The page after the source has won, with what was done; applying again changes nothing."""
    items = plan(desired, current, prior)
    done = {v: [i["id"] for i in items if i["verdict"] == v] for v in VERDICTS}
    want = projected_regions(desired)
    new = {r.id: r.text for r in want}
    order = list(new)
    kept = [(name, new[name] if name in done["regenerate"] else text) for name, text in _blocks(current) if name is None or name in new]
    kept, moved = _ordered(kept, order)
    for k, name in enumerate(order):
        if name in done["create"]:
            at = max((i + 1 for i, (other, _) in enumerate(kept) if other in order[:k]), default=len(kept))
            kept.insert(at, (name, new[name]))
    texts = [text for _, text in kept if text]
    if moved or done["create"]:  # what comes to stand beside other text gets a line between
        content = "\n".join(_spaced(texts))
    else:
        content = "\n".join(texts) if done["remove"] or done["regenerate"] else current
    return {
        "content": content,
        "bridge": bridge_of(content),
        "created": done["create"],
        "regenerated": done["regenerate"],
        "removed": done["remove"],
        "unchanged": done["unchanged"],
        "reordered": moved,
        "hand_edited": [i["id"] for i in items if i["drift"]],
    }


def _spaced(blocks: list[str]) -> list[str]:
    """Blocks with one empty line before each that follows text."""
    out: list[str] = []
    for block in blocks:
        if out and out[-1].strip() and not out[-1].endswith("\n"):
            out.append("")
        out.append(block)
    return out


def is_grounded(content: Column) -> Column:
    """Whether a source page says how well it is cited."""
    return content.rlike(_grounded.pattern)


_PLAN = "page string, id string, source string, verdict string, drift string"
_DONE = (
    "page string, content string, bridge map<string,string>, created array<string>, regenerated array<string>, removed array<string>, "
    "unchanged array<string>, reordered array<string>, hand_edited array<string>, first_run boolean"
)


def _texts(pages: DataFrame) -> DataFrame:
    return pages.select("page", F.coalesce("desired", F.lit("")).alias("desired"), F.coalesce("current", F.lit("")).alias("current"), "prior")


def plan_pages(pages: DataFrame) -> DataFrame:
    """(``page``, ``id``, ``source``, ``verdict``, ``drift``) for pages of (page, desired, current, prior map)."""

    def run(batches):
        for pdf in batches:
            rows = [{"page": p, **i} for p, d, c, b in zip(pdf["page"], pdf["desired"], pdf["current"], pdf["prior"]) for i in plan(d, c, None if b is None else dict(b))]
            yield pd.DataFrame(rows, columns=["page", "id", "source", "verdict", "drift"])

    return _texts(pages).mapInPandas(run, _PLAN)


def apply_pages(pages: DataFrame) -> DataFrame:
    """Every page reconciled, with what was done to it and its new bridge; nothing is written."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, d, c, b in zip(pdf["page"], pdf["desired"], pdf["current"], pdf["prior"]):
                rows.append({"page": p, **apply(d, c, None if b is None else dict(b)), "first_run": b is None})
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _DONE.split(", ")])

    return _texts(pages).mapInPandas(run, _DONE)


def read_bridge(text: Column) -> Column:
    """Map from region to hash of a bridge file; the older flat form is read too, null is empty."""
    new = F.from_json(F.get_json_object(text, "$.entries"), "map<string,struct<source:string,contentHash:string>>")
    flat = F.from_json(text, "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.transform_values(new, lambda _, v: v["contentHash"]), F.map_filter(flat, lambda k, _: ~k.isin("version", "page")), empty)


def bridge_health(pages: DataFrame, bridge: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """(``page``, ``id``, ``state``) of every region of the bridge: orphan, hash-mismatch, stale or synced.

    ``pages``: (page, content); ``bridge``: (page, id, content_hash); ``fresh``: (page, content) as projected now.
    """

    def hashes(df: DataFrame, name: str) -> DataFrame:
        found = R.page_regions(df, ["page"]).filter(F.col("source").isNotNull())
        return found.select("page", "id", F.col("content_hash").alias(name)).dropDuplicates(["page", "id"])

    rows = bridge.join(hashes(pages, "now"), ["page", "id"], "left")
    rows = rows.join(hashes(fresh, "next"), ["page", "id"], "left") if fresh is not None else rows.withColumn("next", F.lit(None).cast("string"))
    state = (
        F.when(F.col("now").isNull(), "orphan")
        .when(F.col("now") != F.col("content_hash"), "hash-mismatch")
        .when(F.col("next") != F.col("content_hash"), "stale")
        .otherwise("synced")
    )
    return rows.select("page", "id", state.alias("state"))


def health_counts(health: DataFrame) -> DataFrame:
    """Regions of the bridge by state."""
    return health.groupBy("state").agg(F.count("*").alias("regions"))


def faithfulness_gate(content: Column, least: float | None) -> Column:
    """Why a grounded source mustn't be projected, null if it may: its stated recall is below ``least``, or unreadable.

    Sources that don't say how well they are cited aren't held back, nor is anything without ``least``.
    """
    if least is None:
        return F.lit(None).cast("string")
    value = F.regexp_extract(content, _recall.pattern, 1)
    number = F.try_to_number(value, F.lit("9.9999999999")).cast("double")
    low = F.concat(F.lit("recall "), value, F.lit(f" is below {least}"))
    reason = F.when(F.coalesce(number, F.lit(-1.0)) < 0, "recall can't be read").when(number < least, low)
    return F.when(is_grounded(content), reason)


def project_source(raw: str | None, slugs: dict[str, str] | None = None) -> str | None:
    """A source page as its target shows it: without leading properties, as :func:`foliograph.operators.transform.site_text` writes it."""
    return None if raw is None else transform.site_text(_property_block.sub("", raw, count=1), slugs)


_property_block = re.compile(
    T.java_free(rf"\A(?:{T.LINE_BLANK}*\n)*(?:(?:{T.PROPERTY}(?:\n|\Z))+(?:{T.LINE_BLANK}*(?:\n|\Z))?)?")
)


def slug_map(entries: DataFrame) -> DataFrame:
    """(``graph``, ``title``, ``slug``) of the published entries; excluded ones are dropped."""
    shown = entries.filter(~F.coalesce("exclude", F.lit(False)) & present(F.col("title")))
    return shown.select("graph", "title", T.route_slug(F.col("title")).alias("slug")).distinct()


def reconcile_manifest(entries: DataFrame, pages: DataFrame, targets: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """One row per published entry of every manifest: its page projected, stamped and reconciled with what is there.

    ``entries``: (graph, entry_index, title, file, exclude); ``pages``: (graph, title, file, content); ``targets``:
    (graph, slug, content, prior), the pages as they are and their bridge, absent ones being new. Out come graph,
    slug, title, ``error`` (no source page), ``gate`` (why the source is held back), ``grounded``, and what
    :func:`apply` did, ``first_run`` without a bridge. Of entries with one slug the last holds. Nothing is written.
    """
    shown = entries.filter(~F.coalesce("exclude", F.lit(False)) & present(F.col("title")))
    last = shown.withColumn("slug", T.route_slug(F.col("title"))).groupBy("graph", "slug").agg(F.max_by(F.struct("entry_index", "title", "file"), "entry_index").alias("r"))
    placed = resolve(last.select("graph", "slug", "r.*"), pages)
    rows = placed.join(pages.select("graph", F.col("file").alias("page_file"), "content"), ["graph", "page_file"], "left")
    keys = ["graph", "slug"]
    rows = rows.join(transform.link_slugs(rows.filter(F.col("content").isNotNull()), shown.select("graph", "title"), keys), keys, "left")
    project = F.udf(lambda raw, slugs, title: None if raw is None else stamp(project_source(raw, slugs), title), StringType(), useArrow=True)
    rows = rows.select(
        *keys, "title", F.when(F.col("page_file").isNull(), "no page").alias("error"), faithfulness_gate(F.col("content"), least).alias("gate"),
        F.coalesce(is_grounded(F.col("content")), F.lit(False)).alias("grounded"), project("content", "slugs", "title").alias("desired"),
    )
    if targets is None:
        rows = rows.withColumn("current", F.lit("")).withColumn("prior", F.lit(None).cast("map<string,string>"))
    else:
        rows = rows.join(targets.select(*keys, F.col("content").alias("current"), "prior"), keys, "left")
    names = [x.split()[0] for x in _DONE.split(", ")[1:]]
    head = ["graph", "slug", "title", "error", "gate", "grounded"]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                row = {c: getattr(r, c) for c in head}
                if row["error"] is None and row["gate"] is None:
                    row |= {**apply(r.desired, r.current or "", None if r.prior is None else dict(r.prior)), "first_run": r.prior is None}
                out.append(row)
            yield pd.DataFrame(out, columns=[*head, *names]).astype(object).where(lambda d: d.notna(), None)

    schema = "graph string, slug string, title string, error string, gate string, grounded boolean, " + _DONE.removeprefix("page string, ")
    return rows.mapInPandas(run, schema)


def batch_summary(done: DataFrame) -> DataFrame:
    """(``graph``, ``entries``, ``errors``, ``held_back``, ``drifted``, ``first_runs``): what a batch came to."""
    return done.groupBy("graph").agg(
        F.count("*").alias("entries"),
        F.count("error").alias("errors"),
        F.count("gate").alias("held_back"),
        F.count_if(F.size("hand_edited") > 0).alias("drifted"),
        F.count_if("first_run").alias("first_runs"),
    )


def recall_of_targets(done: DataFrame) -> DataFrame:
    """(``page``, ``line``): the recall of every grounded page as reconciled, its root divided by source."""
    pages = done.filter(F.col("grounded") & F.col("content").isNotNull()).select(F.col("slug").alias("page"), "graph", "content")
    return recall.recall_lines(recall.region_recall(pages, ["graph", "page"], subdivide_root=True), ["graph", "page"])


def shown_order(column: str, values: tuple[str, ...]) -> Column:
    """Place of a verdict or state in the order it is shown; unknown ones last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(column)), F.lit(0)), F.lit(len(values) + 1))
