"""Queries of range joins, clocks, schemas and instruction rules, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cases, ordering, schemas
from ..operators import bags, clock, instructions, ranges, sharing
from ..session import cut
from ..sources import bundles
from ..sources.tables import outline, table


def _at():
    return F.unix_timestamp(F.col("ts").cast("timestamp"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range per purchase: from its second on, for a thousand times its value; every 50th lasts for ever."""
    length = F.when(F.col("event_id") % 50 == 0, F.lit(10**12)).otherwise(F.floor(F.abs("value") * 1000))
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return bought.select("user_id", F.col("event_id").alias("range_id"), _at().alias("from_at"), (_at() + length).cast("long").alias("to_at"))


def ranges_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with every range of its user that holds it."""
    spots = table(spark, sf_dir, "events").select("user_id", "event_id", _at().alias("at"))
    return ranges.contained(spots, _spans(spark, sf_dir), ["user_id"], "at", "from_at", "to_at").select("event_id", "range_id")


def ranges_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event lies in any range of all users: one key holds all rows, and every 50th range is endless."""
    spots = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(1)).alias("k"), "event_id", _at().alias("at"))
    spans = _spans(spark, sf_dir).where("range_id % 50 <> 0").select(F.pmod("user_id", F.lit(1)).alias("k"), "from_at", (F.col("from_at") + (F.col("to_at") - F.col("from_at")) / 100).cast("long").alias("to_at"))
    return ranges.flagged(spots, spans, ["k"], "at", "from_at", "to_at", "inside").select("event_id", "inside")


def single_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clock and one numbering for all events; every 7th has no time, every 5th comes a day late."""
    at = F.when(F.col("event_id") % 7 != 0, _at() - F.when(F.col("event_id") % 5 == 0, 86400).otherwise(0))
    return clock.monotone(table(spark, sf_dir, "events").select("event_id", at.alias("at")), ["event_id"], "at").select("event_id", "seq", "clock")


#: Of a supplier's card: a name, a nation's key, phones, a remark.
CARD = {
    "type": "object", "additionalProperties": False, "required": ["name", "nation", "phones"], "$defs": {"phone": {"type": "string", "pattern": "^[0-9]{2}-"}},
    "properties": {"name": {"type": "string", "minLength": 1, "maxLength": 18}, "nation": {"type": "integer", "minimum": 0, "maximum": 24}, "phones": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"$ref": "#/$defs/phone"}}, "remark": {"type": ["string", "null"], "enum": ["good", "bad"]}, "kind": {"const": "supplier"}},
}


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card per supplier; by the key's remainder one thing or another is wrong with it."""
    k = F.col("s_suppkey")
    text = F.concat(
        F.lit('{"name": '), F.when(k % 11 == 1, F.lit("7")).when(k % 11 == 2, F.lit('""')).otherwise(F.concat(F.lit('"'), "s_name", F.lit('"'))), F.lit(', "nation": '),
        F.when(k % 13 == 1, F.lit("2.0")).when(k % 13 == 2, F.lit("-1")).when(k % 13 == 3, F.lit("25")).otherwise(F.col("s_nationkey").cast("string")),
        F.when(k % 17 == 1, F.lit("")).when(k % 17 == 2, F.lit(', "phones": []')).when(k % 17 == 3, F.lit(', "phones": ["11-1", "x", 5]')).otherwise(F.lit(', "phones": ["11-222"]')),
        F.when(k % 5 == 1, F.lit(', "remark": "fair"')).when(k % 5 == 2, F.lit(', "remark": "good", "kind": "other"')).otherwise(F.lit("")), F.when(k % 7 == 1, F.lit(', "extra": {}, "also": 1')).otherwise(F.lit("")), F.when(k % 19 == 1, F.lit("")).otherwise(F.lit("}")),
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 23 != 1, text).alias("card"))


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the schema in each supplier's card, with its path."""
    told = _cards(spark, sf_dir).select("s_suppkey", F.explode(schemas.schema_faults(F.col("card"), CARD)).alias("f"))
    return told.select("s_suppkey", "f.path", "f.fault")


#: What is wrong with an order's instructions, by its key's remainder.
_VARIANTS = 20


def _instructed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Instructions, paragraphs and styles of the customers' outlines of which the head is read: paragraphs 0 (number), 1 (title), 2 (part), 12 or more left out."""
    lines = cut(outline(spark, sf_dir).where("paragraph_index < 6"))
    whole = lines.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 6").select("doc_id")
    role = F.get(F.array(*map(F.lit, ["SectionID", "SectionTitle", "PART", "ARTICLE", "PARAGRAPH", "SUBPARAGRAPH"])), F.col("paragraph_index").cast("int"))
    plain = lines.join(whole, "doc_id", "left_semi").select(
        "doc_id", "paragraph_index", "text", F.lit("Normal").alias("style"), F.when((F.col("doc_id") % _VARIANTS == 1) & (F.col("paragraph_index") == 5), "editor_note").alias("skip_reason"), F.lit(False).alias("direct"), (F.col("paragraph_index") > 1).alias("numbered"),
        F.when(F.col("paragraph_index") != 5, role).alias("strong_role"), F.when(F.col("paragraph_index") == 3, F.lit("1|decimal|%1.%2")).alias("signature"), F.lit("x").alias("formatting"), F.lit(False).alias("head_and_title"),
    )
    v = F.col("doc_id") % _VARIANTS
    name = lambda r: instructions.STYLES[r]
    order = list(instructions.STYLES)[:6]
    style = lambda i: F.when((v == 2) & F.lit(i == 4), F.lit(name("PART"))).otherwise(F.lit(name(order[i])))
    applied = [F.struct(F.lit(i).alias("paragraph_index"), style(i).alias("styleId")) for i in range(6)]
    created = [F.struct(F.lit(name(r)).alias("styleId"), F.when((v == 3) & F.lit(i == 3), 99).otherwise(i).alias("derive_from_paragraph_index"), F.when((v == 4) & F.lit(i == 2), "Heading9").otherwise("Normal").alias("basedOn")) for i, r in enumerate(order)]
    given = [F.struct(style(i).alias("styleId"), F.when((v == 3) & F.lit(i == 3), 99).when((v == 5) & F.lit(i == 2), 3).otherwise(i).alias("exemplar_paragraph_index")) for i in range(6)]
    roles = F.create_map(*[x for r, g in zip(order, given) for x in (F.lit(r), g)])
    roles = F.when(v == 6, F.map_filter(roles, lambda k, _: k != "ARTICLE")).otherwise(roles)
    ignored = F.when(v == 7, F.array(F.struct(F.lit(5).alias("paragraph_index"), F.lit("not needed").alias("reason")), F.struct(F.lit(5).alias("paragraph_index"), F.lit("again").alias("reason"))))
    ignored = ignored.when(v == 8, F.array(F.struct(F.lit(-1).alias("paragraph_index"), F.lit("  ").alias("reason")))).otherwise(F.array().cast("array<struct<paragraph_index: int, reason: string>>"))
    styled = F.array(*applied)
    styled = F.when(v == 9, F.slice(styled, 1, 5)).when(v == 10, F.concat(styled, F.array(F.struct(F.lit(40).alias("paragraph_index"), F.lit(name("PART")).alias("styleId"))))).otherwise(styled)
    fields = F.struct(F.array(*created).alias("create_styles"), styled.alias("apply_pStyle"), ignored.alias("ignored_paragraphs"), roles.alias("roles"))
    payload = F.when(v == 11, F.lit("{")).when(v == 12, F.lit('{"roles": {"CHAPTER": {}}, "notes": [1]}')).otherwise(F.to_json(fields))
    told = whole.select("doc_id", payload.alias("payload"))
    styles = whole.select("doc_id", F.explode(F.array(F.lit("Normal"), F.when(v == 13, name("PART")))).alias("style")).where("style IS NOT NULL").select("doc_id", "style", (F.col("style") == "Normal").alias("is_default"))
    return told, plain, styles


def instruction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that the instructions of the customers' outlines break."""
    return instructions.instruction_faults(*_instructed(spark, sf_dir))


def bag_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, by nines, of each order's lines before and after; by the order's key a line is gone, another, turned round or added."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 9).cast("string").alias("value"), F.col("l_linenumber").cast("long").alias("place"))
    v, place = F.col("l_orderkey") % 5, F.col("place")
    turned = F.when(v == 3, F.lit(8) - place).otherwise(place)
    after = lines.where(~((v == 1) & (place == 1))).select("l_orderkey", F.when((v == 2) & (place == 2), F.lit(None)).otherwise(F.col("value")).alias("value"), turned.alias("place"))
    more = lines.where((v == 4) & (place == 1)).select("l_orderkey", F.lit("SLED").alias("value"), F.lit(9).cast("long").alias("place"))
    return bags.differences(lines, after.unionByName(more), ["l_orderkey"])


def bundle_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of each supplier's name, nation and number, as name, address and phone; by the key's remainder its manifest is wrong."""
    own = table(spark, sf_dir, "supplier")
    each = F.explode(F.map_from_arrays(F.array(F.lit("name"), F.lit("address"), F.lit("phone")), F.array(F.col("s_name"), F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string"))))
    held = own.select("s_suppkey", each.alias("artifact", "text")).select(F.col("s_suppkey").alias("owner"), "artifact", F.lit("text/plain").alias("media_type"), F.col("text").cast("binary").alias("content"))
    v = F.col("owner").cast("long") % 10
    told = bundles.manifest_of(held, ["name", "phone"])
    name = F.col("artifact") == "name"
    told = told.where(~((v == 1) & name)).withColumn("length", F.when((v == 2) & name, F.col("length") + 1).otherwise(F.col("length"))).withColumn("sha256", F.when((v == 3) & name, F.lit("0")).otherwise(F.col("sha256")))
    told = told.withColumn("version", F.when((v == 4) & name, 2).otherwise(F.col("version"))).withColumn("required", F.when((v == 5) & name, F.lit(False)).otherwise(F.col("required")))
    told = told.unionByName(told.where((v == 6) & name)).unionByName(told.where((v == 7) & name).withColumn("artifact", F.lit("../up")))
    held = held.where(~((F.col("owner") % 10 == 8) & name)).unionByName(held.where((F.col("owner") % 10 == 9) & name))
    return bundles.faults(told, held, ["name", "phone"])


def list_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lists of their customer's document, their lines as paragraphs; lists share definitions and styles."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "path").withColumn("num_id", F.col("o_orderkey").cast("string"))
    k = F.col("o_orderkey")
    numbers = orders.select("path", "num_id", F.when(k % 31 != 0, (F.floor(k / 4) % 6).cast("string")).alias("abstract_id"), F.when(k % 29 == 0, "2").alias("start"), (k % 37 == 0).alias("overridden"), F.lit(None).cast("boolean").alias("restart"))
    styles = orders.where("o_orderkey % 3 = 0").select("path", F.concat("o_orderpriority", F.col("o_orderstatus")).alias("style"), "num_id")
    lines = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "path", "num_id"), F.col("l_orderkey") == F.col("o_orderkey"))
    proven = F.when(F.col("l_partkey") % 97 != 0, F.col("l_returnflag"))
    paragraphs = lines.select("path", (k * 10 + F.col("l_linenumber")).alias("paragraph_index"), "num_id", F.col("l_returnflag").alias("role"), proven.alias("proven_role"), (F.col("l_suppkey") % 41 != 0).alias("handled"))
    got = sharing.convertible_lists(paragraphs, numbers, styles)
    return got.select("path", F.col("num_id").cast("long").alias("num_id"), "paragraphs", "convertible", F.array_join("reasons", ",").alias("reasons"))


def case_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts with short forms and hyphens in the case of one word or another, whole and as the second of two runs."""
    text = F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, F.lit(" HVAC-UNIT A-b")).otherwise(F.lit("  mixed Case ÉTÉ")))
    pattern = F.when(F.col("p_partkey") % 3 == 0, "title").when(F.col("p_partkey") % 3 == 1, "upper").otherwise("mixed")
    runs = F.array(F.left(text, F.lit(7)), F.substr(text, F.lit(8)))
    return table(spark, sf_dir, "part").select("p_partkey", cases.applied(text, pattern).alias("whole"), F.get(cases.applied_to_runs(runs, pattern), F.lit(1)).alias("second"))


_CHILDREN = ("type", "pgSz", "pgMar", "custom", "cols", "titlePg", "docGrid")


def section_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as children of a section; page size, margins and columns come from another section or go."""
    tag = F.get(F.array(*map(F.lit, _CHILDREN)), (F.col("l_partkey") % 7).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct(tag.alias("tag"), F.concat(F.lit("<"), tag, F.col("l_linenumber").cast("string"), F.lit(">")).alias("xml")).alias("c"))
    target = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "c"))), lambda x: x["c"]).alias("target"))
    given = [F.when(F.floor(F.col("l_orderkey") / 2**i) % 2 == 1, F.struct(F.lit(t).alias("tag"), F.lit(f"<new {t}>").alias("xml"))) for i, t in enumerate(("cols", "pgSz", "pgMar"))]
    merged = ordering.merged_children(F.col("target"), F.array_compact(F.array(*given)), ["pgSz", "pgMar", "cols"])
    return target.select("l_orderkey", F.array_join(F.transform(merged, lambda c: c["xml"]), "").alias("children"))


_FRAME = (ranges_containing, ranges_flag, single_clock, schema_violations, instruction_rules, bag_differences, bundle_faults, list_sharing, case_applied, section_children)
QUERIES = {f.__name__: f for f in _FRAME}

_SPANS = "SELECT user_id, event_id AS range_id, a AS from_at, a + CASE WHEN event_id % 50 = 0 THEN 1000000000000 ELSE CAST(floor(abs(value) * 1000) AS BIGINT) END AS to_at FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS a FROM events) e WHERE event_type = 'purchase'"
ORACLES = {
    "ranges_containing": f"SELECT e.event_id, r.range_id FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events) e JOIN ({_SPANS}) r ON r.user_id = e.user_id AND e.at BETWEEN from_at AND to_at - 1",
    "ranges_flag": f"""
        SELECT e.event_id, EXISTS (SELECT 1 FROM ({_SPANS}) r WHERE range_id % 50 <> 0 AND e.at >= from_at AND e.at < from_at + CAST(floor((to_at - from_at) / 100) AS BIGINT)) AS inside
        FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events) e""",
    "single_clock": """
        SELECT event_id, row_number() OVER w AS seq, max(CASE WHEN event_id % 7 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 5 = 0 THEN 86400 ELSE 0 END END) OVER w AS clock
        FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "schema_violations": """
        WITH s AS (SELECT s_suppkey AS k, s_name AS n FROM supplier), sound AS (SELECT * FROM s WHERE k % 23 <> 1 AND k % 19 <> 1)
        SELECT k AS s_suppkey, path, fault FROM (
          SELECT k, '$' AS path, 'json' AS fault FROM s WHERE k % 23 = 1 OR k % 19 = 1
          UNION ALL SELECT k, '$.name', 'type' FROM sound WHERE k % 11 = 1
          UNION ALL SELECT k, '$.name', 'minLength' FROM sound WHERE k % 11 = 2
          UNION ALL SELECT k, '$.name', 'maxLength' FROM sound WHERE k % 11 > 2 AND length(n) > 18
          UNION ALL SELECT k, '$.name', 'maxLength' FROM sound WHERE k % 11 = 0 AND length(n) > 18
          UNION ALL SELECT k, '$.nation', 'type' FROM sound WHERE k % 13 = 1
          UNION ALL SELECT k, '$.nation', 'minimum' FROM sound WHERE k % 13 = 2
          UNION ALL SELECT k, '$.nation', 'maximum' FROM sound WHERE k % 13 = 3
          UNION ALL SELECT k, '$.phones', 'required' FROM sound WHERE k % 17 = 1
          UNION ALL SELECT k, '$.phones', 'minItems' FROM sound WHERE k % 17 = 2
          UNION ALL SELECT k, '$.phones', 'maxItems' FROM sound WHERE k % 17 = 3
          UNION ALL SELECT k, '$.phones[1]', 'pattern' FROM sound WHERE k % 17 = 3
          UNION ALL SELECT k, '$.phones[2]', 'type' FROM sound WHERE k % 17 = 3
          UNION ALL SELECT k, '$.remark', 'enum' FROM sound WHERE k % 5 = 1
          UNION ALL SELECT k, '$.kind', 'const' FROM sound WHERE k % 5 = 2
          UNION ALL SELECT k, '$.extra', 'unknown' FROM sound WHERE k % 7 = 1
          UNION ALL SELECT k, '$.also', 'unknown' FROM sound WHERE k % 7 = 1) f""",
    # A document with six lines or more; the rows that each variant must give, written out.
    "instruction_rules": """
        WITH w AS (SELECT o_custkey AS doc_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) >= 6),
        told(v, rule, place) AS (VALUES
          (1, 'excluded_but_styled', '5'), (1, 'exemplar_excluded', 'SUBPARAGRAPH'),
          (2, 'style_is_not_canonical', 'PARAGRAPH'), (2, 'exemplar_is_not_source', 'PARAGRAPH'), (2, 'created_unused', 'CSI_Paragraph__ARCH'),
          (3, 'source_out_of_range', 'CSI_Article__ARCH'), (3, 'role_out_of_range', 'ARTICLE'), (3, 'numbering_not_covered', '1|decimal|%1.%2'),
          (4, 'base_is_not_source', 'CSI_Part__ARCH'), (4, 'base_unknown', 'CSI_Part__ARCH'),
          (5, 'exemplar_is_not_source', 'PART'), (5, 'exemplar_of_other_role', 'PART'),
          (6, 'role_missing', 'ARTICLE'), (6, 'style_without_role', 'CSI_Article__ARCH'), (6, 'created_unused', 'CSI_Article__ARCH'), (6, 'numbering_not_covered', '1|decimal|%1.%2'),
          (7, 'ignored_twice', '5'), (7, 'styled_and_ignored', '5'), (7, 'ignored_but_numbered', '5'),
          (8, 'shape:minimum', '$.ignored_paragraphs[0].paragraph_index'), (8, 'shape:pattern', '$.ignored_paragraphs[0].reason'),
          (9, 'not_covered', '5'), (10, 'not_to_be_covered', '40'), (10, 'applied_out_of_range', '40'),
          (11, 'shape:json', '$'), (12, 'shape:unknown', '$.roles.CHAPTER'), (12, 'shape:type', '$.notes[0]'),
          (13, 'created_exists', 'CSI_Part__ARCH'), (13, 'role_other_style', 'PART'), (13, 'applied_other_style', '2'))
        SELECT doc_id, rule, place FROM w JOIN told ON w.doc_id % 20 = v""",
    "bag_differences": """
        WITH b AS (SELECT l_orderkey AS k, CAST(l_suppkey % 9 AS VARCHAR) AS v, l_linenumber AS p FROM lineitem),
        a AS (SELECT k, CASE WHEN k % 5 = 2 AND p = 2 THEN NULL ELSE v END AS v, CASE WHEN k % 5 = 3 THEN 8 - p ELSE p END AS p FROM b WHERE NOT (k % 5 = 1 AND p = 1)
              UNION ALL SELECT k, 'SLED', 9 FROM b WHERE k % 5 = 4 AND p = 1),
        n AS (SELECT coalesce(x.k, y.k) AS k, coalesce(x.v, y.v) AS v, coalesce(x.n, 0) - coalesce(y.n, 0) AS n
              FROM (SELECT k, v, count(*) AS n FROM b GROUP BY 1, 2) x FULL JOIN (SELECT k, v, count(*) AS n FROM a GROUP BY 1, 2) y ON x.k = y.k AND x.v IS NOT DISTINCT FROM y.v)
        SELECT k AS l_orderkey, CASE WHEN n > 0 THEN 'lost' ELSE 'gained' END AS change, v AS value, abs(n) AS n FROM n WHERE n <> 0
        UNION ALL SELECT k, 'moved', v, sum(m) FROM (SELECT k, v, p, greatest(sum(s), 0) AS m FROM (SELECT k, v, p, 1 AS s FROM b UNION ALL SELECT k, v, p, -1 FROM a) u WHERE k % 5 = 3 GROUP BY 1, 2, 3) t GROUP BY 1, 3 HAVING sum(m) > 0""",
    "bundle_faults": """
        SELECT CAST(s_suppkey AS VARCHAR) AS owner, artifact, fault FROM supplier JOIN (VALUES
          (1, 'name', 'unlisted'), (1, 'name', 'required'), (2, 'name', 'length'), (3, 'name', 'digest'), (4, 'name', 'format'), (5, 'name', 'required'), (6, 'name', 'listed_twice'),
          (7, '../up', 'unsafe_id'), (7, '../up', 'missing'), (8, 'name', 'missing'), (9, 'name', 'held_twice')) t(v, artifact, fault) ON s_suppkey % 10 = v""",
    "list_sharing": """
        WITH RECURSIVE o AS (SELECT o_custkey AS path, o_orderkey AS k, CASE WHEN o_orderkey % 31 <> 0 THEN CAST(floor(o_orderkey / 4) AS BIGINT) % 6 END AS def, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || o_orderstatus END AS style FROM orders),
        e AS (SELECT a.path, a.k AS x, b.k AS y FROM o a JOIN o b ON a.path = b.path AND (a.def = b.def OR a.style = b.style)),
        r(path, x, y) AS (SELECT path, k, k FROM o UNION SELECT r.path, r.x, e.y FROM r JOIN e ON e.path = r.path AND e.x = r.y),
        w AS (SELECT path, k, 'start' AS why FROM o WHERE k % 29 = 0 UNION SELECT path, k, 'override' FROM o WHERE k % 37 = 0 UNION SELECT path, k, 'no_definition' FROM o WHERE k % 31 = 0
              UNION SELECT path, k, 'not_handled' FROM o JOIN lineitem ON l_orderkey = k WHERE l_suppkey % 41 = 0 UNION SELECT path, k, 'other_role' FROM o JOIN lineitem ON l_orderkey = k WHERE l_suppkey % 41 <> 0 AND l_partkey % 97 = 0)
        SELECT o.path, o.k AS num_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o.k) AS paragraphs, count(w.why) = 0 AS convertible, coalesce(string_agg(DISTINCT w.why, ',' ORDER BY w.why), '') AS reasons
        FROM o JOIN r ON r.path = o.path AND r.x = o.k LEFT JOIN w ON w.path = r.path AND w.k = r.y GROUP BY o.path, o.k""",
    "case_applied": """
        WITH t AS (SELECT p_partkey, p_type || CASE WHEN p_partkey % 2 = 0 THEN ' HVAC-UNIT A-b' ELSE '  mixed Case ÉTÉ' END AS x FROM part),
        w AS (SELECT p_partkey, x, CASE p_partkey % 3 WHEN 1 THEN upper(x) WHEN 2 THEN x
            ELSE array_to_string([upper(y[1]) || lower(y[2:]) FOR y IN string_split(p_type_only, ' ')], ' ') || CASE WHEN p_partkey % 2 = 0 THEN ' HVAC-Unit A-b' ELSE '  mixed Case Été' END END AS whole
          FROM t JOIN (SELECT p_partkey, p_type AS p_type_only FROM part) p USING (p_partkey))
        SELECT p_partkey, whole, substr(whole, 8) AS second FROM w""",
    "section_children": """
        WITH tags(tag, rank, i) AS (VALUES ('type', 5, 0), ('pgSz', 6, 1), ('pgMar', 7, 2), ('custom', 0, 3), ('cols', 12, 4), ('titlePg', 16, 5), ('docGrid', 20, 6)),
        kept AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, tag) - 1 AS pos, 1 AS kind, rank, '<' || tag || l_linenumber || '>' AS xml FROM lineitem JOIN tags ON l_partkey % 7 = i WHERE tag NOT IN ('pgSz', 'pgMar', 'cols')),
        given AS (SELECT k, tag, rank FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o JOIN (VALUES ('cols', 12, 1), ('pgSz', 6, 2), ('pgMar', 7, 4)) g(tag, rank, bit) ON (k // bit) % 2 = 1),
        placed AS (SELECT g.k, coalesce((SELECT min(pos) FROM kept c WHERE c.k = g.k AND c.rank > g.rank), (SELECT count(*) FROM kept c WHERE c.k = g.k)) AS pos, 0 AS kind, rank, '<new ' || tag || '>' AS xml FROM given g)
        SELECT o.k AS l_orderkey, coalesce(string_agg(xml, '' ORDER BY pos, kind, rank), '') AS children FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o LEFT JOIN (SELECT * FROM kept UNION ALL SELECT * FROM placed) u ON u.k = o.k GROUP BY 1""",
}
