"""Operators on outlines: ordered paragraphs with roles and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import roles

_BREAKS = ("SectionID", "SectionTitle", "PART", "ARTICLE", "END_OF_SECTION")


def _document(*more):
    return Window.partitionBy("doc_id").orderBy("paragraph_index", *more)


def _given(rows: DataFrame, name: str, kind: str) -> Column:
    """A column that the caller may leave out; then it is null."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def gated_roles(paragraphs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, paragraph_index, role`` and ``keep``: roles that depend on what came before.

    A number counts as a subparagraph only after a lettered paragraph, a lower
    letter only after a number, deep forms only after a paragraph; section,
    part and article rows end all three.  A ``numbering_role``, where the rows
    have that column, outranks the text; what has a skip reason (``in_table``
    may be given) has no role and changes nothing.  The flags are the last
    events seen, each layer's events being known before the next is asked, so
    windows suffice and no fold over a document is needed.
    """
    before = _document().rowsBetween(Window.unboundedPreceding, -1)
    text, numbered = F.col("text"), _given(paragraphs, "numbering_role", "string")
    part = roles.skip_reason(text, _given(paragraphs, "in_table", "boolean")).isNull()
    rows = paragraphs.withColumn("free", F.when(part, F.coalesce(numbered, roles.ungated_role(text)))).withColumn("marker", F.when(part & numbered.isNull(), roles.marker_type(text)))
    free = F.col("free")

    def last(event: Column) -> Column:
        return F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(False))

    alpha = last(F.when(free == "PARAGRAPH", True).when(free.isin(*_BREAKS), False))
    # Rows below a paragraph that the text alone tells presuppose the flag, so only told ones set it.
    deep = last(F.when(free.isin(*_BREAKS), False).when(free.isNotNull(), True))
    rows = rows.withColumn("alpha", alpha).withColumn("deep", deep)
    number = free.isNull() & (F.col("marker") == "number") & F.col("alpha")
    numeric = last(F.when(number | (free == "SUBPARAGRAPH"), True).when(free.isin("PARAGRAPH", *_BREAKS), False))
    rows = rows.withColumn("numeric", numeric)
    below = F.create_map(*[F.lit(x) for k in (5, 6, 7, 8) for x in (f"deep_{k}", f"SUBPARAGRAPH_LEVEL_{k}")])[F.col("marker")]
    role = F.coalesce(free, F.when(F.col("deep"), below), F.when(number, "SUBPARAGRAPH").when((F.col("marker") == "lower_alpha") & F.col("numeric"), "SUBSUBPARAGRAPH"))
    return rows.select("doc_id", "paragraph_index", role.alias("role"), *keep)


def preclassified(paragraphs: DataFrame, available: tuple[str, ...] = tuple(roles.LEVELS)) -> DataFrame:
    """``doc_id, paragraph_index, preferred, role`` of the rows that need no further judgement.

    Of a numbered row (``numbered``) the ``numbering_role`` counts, and nothing
    else; of any other its text and the row before.  Empty rows and those
    ``in_table`` have none.  ``role`` is the preferred one or what stands in
    for it among the ``available``; rows without any are left out.  The three
    flag columns may be absent.
    """
    no = F.lit(False)
    aside = (roles.clean(F.col("text")) == "") | F.coalesce(_given(paragraphs, "in_table", "boolean"), no)
    told = F.when(F.coalesce(_given(paragraphs, "numbered", "boolean"), no), _given(paragraphs, "numbering_role", "string")).otherwise(roles.heading_role(F.col("text"), F.lag("text").over(_document())))
    rows = paragraphs.select("doc_id", "paragraph_index", F.when(~aside, told).alias("preferred"))
    return rows.withColumn("role", roles.resolved(F.col("preferred"), F.array(*map(F.lit, available)))).where("role IS NOT NULL")


def strong_hits(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, role, paragraph_index, nth``: the rows that show a role by themselves, numbered by role; the first is its exemplar.

    A section's title is behind its number, or the row after the first section
    row whose next row shows no role.  A row a hit instead of a list a role, so
    a long document needs no long value.
    """
    part = roles.skip_reason(F.col("text"), _given(paragraphs, "in_table", "boolean")).isNull()
    told = gated_roles(paragraphs.where(part), keep=("text",))
    after, index = F.lead(F.struct("paragraph_index", roles.ungated_role(F.col("text")).alias("free"))).over(_document()), F.col("paragraph_index")
    rows = told.withColumn("after", after).withColumn("opens", (F.col("role") == "SectionID") & (F.col("after.paragraph_index") == index + 1) & F.col("after.free").isNull())
    first = F.min(F.when(F.col("opens"), index)).over(Window.partitionBy("doc_id"))
    hit = lambda role, at: F.struct(role.alias("role"), at.alias("paragraph_index"))
    title = F.lit("SectionTitle")
    combined = (F.col("role") == "SectionID") & roles.section_title(F.col("text")).isNotNull()
    hits = F.array_compact(F.array(F.when(F.col("role").isNotNull(), hit(F.col("role"), index)), F.when(combined, hit(title, index)), F.when(F.col("first") == index, hit(title, index + 1))))
    out = rows.withColumn("first", first).select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*")
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "role").orderBy("paragraph_index")))


def literal_markers(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, paragraph_index, marker, label, ordinal, body`` of rows with a typed marker."""
    t = roles.clean(F.col("text"))
    form = r"^([(]?)([A-Za-z]|[0-9]+)[.)]+[ \t]+"
    rows = paragraphs.withColumn("marker", roles.marker_type(F.col("text"))).where("marker IS NOT NULL")
    label = F.regexp_extract(t, form, 2)
    return rows.select("doc_id", "paragraph_index", "marker", label.alias("label"), roles.ordinal(label).alias("ordinal"), F.regexp_replace(t, form, "").alias("body"))


#: Roles whose typed counters run on, with the level that a row must be above to end their run.
COUNTED = tuple((r, v) for r, v in roles.LEVELS.items() if v)


def counted(paragraphs: DataFrame, only: tuple[str, ...] = tuple(r for r, _ in COUNTED)) -> DataFrame:
    """``doc_id, paragraph_index, role, expected, found, text`` of the rows of the roles ``only``.

    ``found`` is the number in the text, ``expected`` the row's place among the
    rows of its role since the last row of a higher level, from 1.  Roles and
    counters come from one shuffle by document.
    """
    levels = F.create_map(*[F.lit(x) for r, v in roles.LEVELS.items() for x in (r, v)])
    told = gated_roles(paragraphs, keep=("text",)).where("role IS NOT NULL").withColumn("level", levels[F.col("role")])
    upto = _document().rowsBetween(Window.unboundedPreceding, 0)
    own = [(r, v) for r, v in COUNTED if r in only]
    runs = [F.when(F.col("role") == r, F.sum(F.when(F.col("level") < v, 1).otherwise(0)).over(upto)) for r, v in own]
    rows = told.withColumn("run", F.coalesce(*runs)).where(F.col("role").isin(*only))
    expected = F.row_number().over(Window.partitionBy("doc_id", "role", "run").orderBy("paragraph_index")).cast("long")
    return rows.select("doc_id", "paragraph_index", "role", expected.alias("expected"), roles.counter(F.col("role"), F.col("text")).alias("found"), "text")


def sequence_violations(paragraphs: DataFrame) -> DataFrame:
    """The first row of each document whose typed counter is not the next one.

    ``doc_id, paragraph_index, role, expected, found``, for parts, articles and
    all levels below.  A row without a number in its text breaks nothing.
    """
    wrong = counted(paragraphs).where("found <> expected")
    first = wrong.groupBy("doc_id").agg(F.min_by(F.struct("paragraph_index", "role", "expected", "found"), "paragraph_index").alias("r"))
    return first.select("doc_id", "r.*")


def sequence_faults(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, paragraph_index, role, code``: all that keeps counters from being made anew; empty means proven.

    ``gap``: a typed counter that is not the next after the one before it under
    the same parent; ``no_parent``: no row of the level above is open (for a
    lettered paragraph only where the document has articles); ``wrong_part``:
    an article of another part than the open one; ``mixed_sources``: numbered
    otherwise (typed, or by a ``numbering_role``) than the role's first row.  A
    section row closes all that is open.
    """
    levels = F.create_map(*[F.lit(x) for r, v in roles.LEVELS.items() for x in (r, v)])
    rows = paragraphs.withColumn("automatic", _given(paragraphs, "numbering_role", "string").isNotNull())
    told = gated_roles(rows, keep=("text", "automatic")).where("role IS NOT NULL").withColumn("level", levels[F.col("role")])
    level, role, text = F.col("level"), F.col("role"), F.col("text")
    told = told.withColumn("found", F.when(~F.col("automatic"), roles.counter(role, text)))
    before, upto = (_document().rowsBetween(Window.unboundedPreceding, x) for x in (-1, 0))
    # Nothing above a level has closed it if the last row of that level or a higher one is of that level.
    open_at = [F.last(F.when(level <= v, level), ignorenulls=True).over(before) == v for _, v in COUNTED]
    has_articles = F.max(role == "ARTICLE").over(Window.partitionBy("doc_id"))
    parent_open = F.lit(True)
    for (r, v), above in zip(COUNTED[1:], open_at):
        parent_open = F.when(role == r, F.coalesce(above, F.lit(False)) | (~has_articles if r == "PARAGRAPH" else F.lit(False))).otherwise(parent_open)
    runs = F.coalesce(*[F.when(role == r, F.sum(F.when(level < v, 1).otherwise(0)).over(upto)) for r, v in COUNTED])
    part = F.last(F.when(level <= 1, F.struct(F.when(role == "PART", F.col("found")).alias("n"))), ignorenulls=True).over(before)
    stated = F.regexp_extract(roles.clean(text), r"^(\d{1,2})[.]", 1).try_cast("long")
    known = told.withColumn("run", runs).withColumn("open", parent_open).withColumn("part", part)
    prior = Window.partitionBy("doc_id", "role", "run").orderBy("paragraph_index")
    first = F.first("automatic").over(Window.partitionBy("doc_id", "role").orderBy("paragraph_index").rowsBetween(Window.unboundedPreceding, 0))
    known = known.where("level > 0").withColumn("expected", F.coalesce(F.lag("found").over(prior), F.lit(0)) + 1).withColumn("kind", first)
    codes = F.array_compact(F.array(
        F.when(F.col("found") != F.col("expected"), "gap"), F.when(~F.col("open"), "no_parent"),
        F.when((role == "ARTICLE") & ~F.col("automatic") & (stated != F.col("part.n")), "wrong_part"), F.when(F.col("automatic") != F.col("kind"), "mixed_sources"),
    ))
    return known.select("doc_id", "paragraph_index", "role", F.explode(codes).alias("code"))


def with_text_at(paragraphs: DataFrame, further: int, text_there: str, last: str) -> DataFrame:
    """``paragraphs`` with the text of the paragraph whose index is ``further`` on (null: none) and their document's last index.

    Windows by document, so the text isn't looked up by a join.
    """
    there = Window.partitionBy("doc_id").orderBy("paragraph_index").rangeBetween(further, further)
    return paragraphs.withColumn(text_there, F.first("text").over(there)).withColumn(last, F.max("paragraph_index").over(Window.partitionBy("doc_id")))


def index_faults(given: DataFrame) -> DataFrame:
    """``doc_id, at, code``: what is wrong with instructions that give a paragraph a style.

    ``given``: ``doc_id, at, style, last, text`` (the index told, the last one
    that the document has, the text at the index).  ``out_of_range``, ``blank``
    and ``excluded`` are told of each instruction, ``two_styles`` once of an
    index that is given several.
    """
    index = Window.partitionBy("doc_id", "at")
    rows = given.withColumn("nth", F.row_number().over(index.orderBy("style"))).withColumn("low", F.min("style").over(index)).withColumn("high", F.max("style").over(index))
    codes = F.array_compact(F.array(
        F.when(F.col("at") > F.col("last"), "out_of_range"), F.when((F.col("at") <= F.col("last")) & (F.trim("text") == ""), "blank"),
        F.when(F.col("text").startswith("["), "excluded"), F.when((F.col("nth") == 1) & (F.col("low") != F.col("high")), "two_styles"),
    ))
    return rows.select("doc_id", "at", F.explode(codes).alias("code"))


def conversion_plan(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, paragraph_index, depth, nth, body``: what each typed marker of the three upper levels becomes.

    ``depth`` is the new marker's form, ``nth`` its number, which begins anew
    under each parent, ``body`` the text without the old marker.
    """
    forms = {"PARAGRAPH": ".", "SUBPARAGRAPH": ".1", "SUBSUBPARAGRAPH": ".1.1"}
    depth = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])[F.col("role")]
    body = F.regexp_replace(roles.clean(F.col("text")), r"^[(]?([A-Za-z]|[0-9]+)[.)]+[ \t]+", "")
    return counted(paragraphs, tuple(forms)).select("doc_id", "paragraph_index", depth.alias("depth"), F.col("expected").alias("nth"), body.alias("body"))


def neighbours(rows: DataFrame, group: str, order: str, text: str, width: int = 80) -> DataFrame:
    """``group, order, prev_text, next_text``: the neighbours' texts, cut to ``width``."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.select(group, order, F.left(F.lag(text).over(w), F.lit(width)).alias("prev_text"), F.left(F.lead(text).over(w), F.lit(width)).alias("next_text"))


def merge_intervals(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """``group, start_at, end_at, n``: intervals that touch or overlap, made one."""
    order = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.select(group, start, end, F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0).alias("fresh"))
    island = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(group, "island").agg(F.min(start).alias("start_at"), F.max(end).alias("end_at"), F.count("*").alias("n")).drop("island")
