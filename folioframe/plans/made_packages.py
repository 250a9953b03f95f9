"""Queries of the operators on packages, over packages made of driver tables, with rows of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import application, invariants, tokens
from ..sources import environment, writing
from ..sources.tables import table

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_LISTS = '<w:abstractNum w:abstractNumId="{d}"><w:nsid w:val="{m}"/><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1"/></w:lvl></w:abstractNum><w:num w:numId="{n}"><w:abstractNumId w:val="{d}"/></w:num>'
_BASE = '<w:style w:type="paragraph" w:styleId="Base"><w:name w:val="{}"/></w:style>'
_P = '<w:style w:type="paragraph" w:styleId="P"><w:name w:val="P"/><w:basedOn w:val="Base"/><w:pPr><w:jc w:val="both"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr></w:pPr><w:rPr><w:b/></w:rPr></w:style>'


def _parts(of: DataFrame, documents: Column, styles: Column, lists: Column, more: dict[str, Column]) -> DataFrame:
    """``path, part, content, fault`` of one package per row of ``of``."""
    named = {"[Content_Types].xml": F.lit("<Types/>"), "_rels/.rels": F.lit("<Relationships/>"), "word/document.xml": documents, "word/styles.xml": styles, "word/numbering.xml": lists} | more
    pairs = F.array(*[F.struct(F.lit(part).alias("part"), F.encode(text, "UTF-8").alias("content")) for part, text in named.items()])
    return of.select(F.col("path"), F.explode(pairs).alias("p")).select("path", "p.part", "p.content", F.lit(None).cast("string").alias("fault"))


def _packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A package per nation, its suppliers as paragraphs with typed letters; and the rows (path, k, paragraph_index) they came from."""
    own = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("n_nationkey")
    run = lambda x: F.concat(F.lit('<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">'), x, F.lit("</w:t></w:r>"))
    body = F.when(k % 5 == 3, F.concat(F.lit("<w:ins>"), run(F.col("s_name")), F.lit("</w:ins>"))).otherwise(run(F.col("s_name")))
    paragraph = F.concat(F.lit('<w:p><w:pPr><w:jc w:val="left"/></w:pPr>'), run(F.lit("A. ")), body, F.lit("</w:p>"))
    rows = own.select(F.col("n_name").alias("path"), k.alias("k"), "s_suppkey", paragraph.alias("xml"))
    whole = rows.groupBy("path", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "xml"))), lambda x: x["xml"]), "").alias("body"), F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    document = F.concat(F.lit(f"<w:document {_W}><w:body>"), "body", F.lit('<w:sectPr><w:pgSz w:w="1"/><w:formProt/></w:sectPr></w:body></w:document>'))
    styles = F.concat(F.lit(f"<w:styles {_W}>"), F.when(F.col("k") % 2 == 0, F.lit(_BASE.format("own"))).otherwise(F.lit("")), F.lit("</w:styles>"))
    lists = F.lit(f"<w:numbering {_W}>{_LISTS.format(d=0, n=1, m='BBBB0000')}</w:numbering>")
    parts = _parts(whole, document, styles, lists, {"word/media/a.png": F.concat(F.lit("picture of "), "path")})
    broken = whole.where("k % 5 = 4").select("path")
    sound = parts.join(broken, "path", "left_anti").unionByName(broken.select("path", F.lit(None).cast("string").alias("part"), F.lit(None).cast("binary").alias("content"), F.lit("not_a_package").alias("fault")))
    return sound, whole.select("path", "k", F.posexplode("keys").alias("paragraph_index", "s_suppkey")).withColumn("paragraph_index", F.col("paragraph_index").cast("long"))


def _template(spark: SparkSession) -> DataFrame:
    one = spark.range(1).select(F.lit("template").alias("path"))
    return _parts(one, F.lit(f"<w:document {_W}><w:body><w:p/></w:body></w:document>"), F.lit(f"<w:styles {_W}>{_BASE.format('template')}{_P}</w:styles>"), F.lit(f"<w:numbering {_W}>{_LISTS.format(d=3, n=5, m='AAAA0000')}</w:numbering>"), {})


def policy_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome and faults of each nation's package under either policy, and how many of its parts were written anew."""
    parts, rows = _packages(spark, sf_dir)
    roles = rows.select("path", "paragraph_index", F.when((F.col("k") % 5 == 1) & (F.col("paragraph_index") == 0), "CHAPTER").otherwise("PARAGRAPH").alias("role"), "k").where("k % 5 <> 2").drop("k")
    entries = spark.range(1).select(F.lit("PARAGRAPH").alias("role"), F.lit("P").alias("style_id"), F.lit("5").alias("num_id"), F.lit("0").alias("level"))
    told = []
    for mode in ("format_only", "convert"):
        run = application.run(parts, _template(spark), entries, roles, mode)
        faults = run.faults.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
        written = run.parts.where("origin <> 'kept'").groupBy("path").agg(F.count("*").alias("written"))
        told.append(run.outcomes.join(faults, "path", "left").join(written, "path", "left").select(F.lit(mode).alias("mode"), "path", "status", F.coalesce("codes", F.lit("")).alias("codes"), F.coalesce("written", F.lit(0)).alias("written")))
    return told[0].unionByName(told[1])


def protected_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sound package against itself with one thing changed, by the nation's key: what the evidence tells."""
    parts, rows = _packages(spark, sf_dir)
    keyed = parts.where("fault IS NULL").join(rows.select("path", "k").distinct(), "path")
    text, k, part = F.decode("content", "UTF-8"), F.col("k") % 7, F.col("part")
    main = part == "word/document.xml"
    new = (
        F.when((k == 1) & main, F.replace(text, F.lit("<w:formProt/>"), F.lit(""))).when((k == 2) & main, F.replace(text, F.lit('w:w="1"'), F.lit('w:w="2"'))).when((k == 3) & (part == "word/numbering.xml"), F.replace(text, F.lit("decimal"), F.lit("upperRoman")))
        .when((k == 4) & (part == "word/media/a.png"), F.lit("another")).when((k == 5) & main, F.regexp_replace(text, r"<w:rPr><w:b/></w:rPr>(<w:t[^>]*>A)", "$1")).otherwise(text)
    )
    after = keyed.withColumn("content", F.encode(new, "UTF-8")).select(parts.columns)
    found = invariants.violations(invariants.evidence(keyed.select(parts.columns)), invariants.evidence(after))
    return found.groupBy("path", "kind", "change").agg(F.count_distinct("owner").alias("owners"), F.sum("n").alias("n"))


_FONT = '<w:font w:name="{}"><w:panose1 w:val="{}"/></w:font>'


def environment_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What surrounds the text of each nation's package once a template's environment is in it: some have fonts, some settings of their own."""
    parts, rows = _packages(spark, sf_dir)
    keyed = rows.select("path", "k").distinct()
    fonts = keyed.where("k % 3 = 0").select("path", F.lit(environment.PARTS["fontTable"]).alias("part"), F.lit(f"<w:fonts {_W}>{_FONT.format('B', 'own')}</w:fonts>").alias("text"))
    settings = keyed.where("k % 3 = 1").select("path", F.lit(environment.PARTS["settings"]).alias("part"), F.lit(f"<w:settings {_W}><w:zoom/><w:compat><w:own/></w:compat></w:settings>").alias("text"))
    more = fonts.unionByName(settings).select("path", "part", F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("string").alias("fault"))
    targets = parts.unionByName(more.join(parts.where("fault IS NULL").select("path").distinct(), "path", "left_semi"))
    given = {
        environment.PARTS["settings"]: F.lit(f"<w:settings {_W}><w:protect/><w:compat><w:flag/></w:compat></w:settings>"), environment.PARTS["fontTable"]: F.lit(f"<w:fonts {_W}>{_FONT.format('A', 'new')}{_FONT.format('B', 'new')}</w:fonts>"),
        environment.PARTS["theme"]: F.lit('<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"/>'),
    }
    one = spark.range(1).select(F.lit("template").alias("path"))
    template = environment.scanned(_parts(one, F.lit(f"<w:document {_W}><w:body/></w:document>"), F.lit(f'<w:styles {_W}><w:docDefaults><w:rPrDefault><w:rPr><w:b/></w:rPr></w:rPrDefault></w:docDefaults></w:styles>'), F.lit(f"<w:numbering {_W}/>"), given))
    after = writing.patched(targets, environment.applied(targets, template)).withColumn("fault", F.lit(None).cast("string"))
    told = environment.scanned(after).where("kind IN ('defaults', 'theme', 'compat_flag', 'setting', 'font')")
    return told.select("path", "kind", "key", F.contains("value", F.lit("own")).alias("own"))


def shell_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers and footers of each nation's customers agree on, and a footer with new tokens; by the key they differ in one thing or another."""
    own = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    v, nth = F.col("n_nationkey") % 6, F.col("c_custkey") % 4
    number, title = F.concat(F.lpad((F.col("n_nationkey") % 40 + 10).cast("string"), 2, "0"), F.lit(" 10 00")), F.concat(F.initcap(F.translate("n_name", "0123456789", "abcdefghij")), F.lit(" Work"))
    text = F.when(nth == 0, F.concat(F.lit("SECTION "), F.when((v == 1) & (F.col("c_custkey") % 8 == 0), F.lit("99 10 00")).otherwise(number))).when(nth == 1, F.concat(number, F.lit(" "), F.when((v == 2) & (F.col("c_custkey") % 8 == 1), F.lit("Other Work")).otherwise(title), F.lit(".docx")))
    text = text.when(nth == 2, F.when(v == 3, F.lit("Nothing alike")).otherwise(F.upper(title))).otherwise(F.when(v == 4, F.lit("DIVISION 98")).otherwise(F.concat(F.lit("Division "), F.left(number, F.lit(2)))))
    kind = F.when(nth == 1, "footer").otherwise("header")
    # Each line of a shell is seen in both of its mirrored forms.
    texts = own.select(F.col("n_name").alias("path"), kind.alias("kind"), text.alias("text"), F.explode(F.array(F.lit(0), F.lit(1))).alias("form"))
    got = tokens.inferred(texts)
    new = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.lit("770000").alias("new_section"), F.lit("New").alias("new_title"))
    told = tokens.replaced(texts, got, new).groupBy("path").agg(F.count_if(F.col("new_text") != F.col("text")).alias("changed"), F.min(F.when(F.col("kind") == "footer", F.col("new_text"))).alias("footer"))
    return got.join(told, "path").select("path", "section", "division", "title", F.array_join("aliases", "|").alias("aliases"), "code", "changed", "footer")


_FRAME = (policy_run, protected_structures, environment_applied, shell_consensus)
QUERIES = {f.__name__: f for f in _FRAME}

_NATIONS = "SELECT n_name AS path, n_nationkey AS k, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2"
ORACLES = {
    # Broken packages, unknown roles, no roles and (where numbers are converted) tracked changes fail; a new style sheet and main part, and with conversion a new list part, are written.
    "policy_run": f"""
        WITH p AS ({_NATIONS}), m(mode, lists) AS (VALUES ('format_only', 0), ('convert', 1))
        SELECT mode, path, CASE WHEN codes = '' THEN 'succeeded' ELSE 'failed' END AS status, codes, CASE WHEN codes = '' THEN 2 + lists ELSE 0 END AS written
        FROM (SELECT *, CASE k % 5 WHEN 4 THEN 'package' WHEN 1 THEN 'role_unknown' WHEN 2 THEN 'no_paragraphs' WHEN 3 THEN CASE WHEN lists = 1 THEN 'tracked' ELSE '' END ELSE '' END AS codes FROM p CROSS JOIN m) t""",
    "protected_structures": f"""
        WITH p AS ({_NATIONS})
        SELECT path, kind, change, CASE WHEN kind = 'runs' THEN n ELSE 1 END AS owners, CASE WHEN kind = 'runs' THEN n ELSE 1 END AS n FROM p
        JOIN (VALUES (1, 'section'), (2, 'layout'), (3, 'list'), (4, 'media'), (4, 'part'), (5, 'runs')) t(v, kind) ON k % 7 = v CROSS JOIN (VALUES ('lost'), ('gained')) c(change) WHERE k % 5 <> 4""",
    "environment_applied": f"""
        WITH p AS ({_NATIONS})
        SELECT path, kind, key, own FROM p JOIN (VALUES ('defaults', 'rPr', false, -1), ('defaults', 'pPr', false, -1), ('theme', '', false, -1), ('compat_flag', 'flag', false, -1), ('setting', 'zoom', false, 1), ('font', 'A', false, -1), ('font', 'B', true, 0), ('font', 'B', false, -2)) t(kind, key, own, v)
        ON v = -1 OR v = k % 3 OR (v = -2 AND k % 3 <> 0) WHERE k % 5 <> 4""",
    # Packages of which every kind of line was seen; a kind seen at all was seen twice.
    "shell_consensus": """
        WITH c AS (SELECT n_name AS path, n_nationkey % 6 AS v, c_custkey % 4 AS nth, c_custkey % 8 AS eighth, CAST(n_nationkey % 40 + 10 AS VARCHAR) AS d,
            list_aggregate([upper(w[1]) || lower(w[2:]) FOR w IN string_split(translate(n_name, '0123456789', 'abcdefghij'), ' ')], 'string_agg', ' ') || ' Work' AS title FROM customer JOIN nation ON n_nationkey = c_nationkey),
        g AS (SELECT path, any_value(v) AS v, any_value(d) AS d, any_value(title) AS title, count(*) AS n, bool_or(nth = 0) AS s, bool_or(nth = 0 AND eighth = 0) AS s8, bool_or(nth = 0 AND eighth <> 0) AS s4, bool_or(nth = 1) AS f, bool_or(nth = 1 AND eighth = 1) AS f1, bool_or(nth = 1 AND eighth <> 1) AS f5,
            bool_or(nth = 2) AS h, bool_or(nth = 3) AS x FROM c GROUP BY path),
        k AS (SELECT *, CASE WHEN NOT s THEN 'no_support' WHEN v = 1 AND s8 AND s4 THEN 'ambiguous_section' WHEN v = 1 AND s8 THEN 'no_support' WHEN NOT f THEN 'no_support' WHEN v = 2 AND f1 AND f5 THEN 'ambiguous_title'
            WHEN v = 2 AND f1 THEN 'no_support' WHEN NOT h OR v = 3 THEN 'no_support' WHEN v = 4 AND x THEN 'division_conflict' END AS code FROM g)
        SELECT path, CASE WHEN code IS NULL THEN d || '1000' END AS section, CASE WHEN code IS NULL AND x THEN d END AS division, CASE WHEN code IS NULL THEN title END AS title,
               CASE WHEN code IS NULL THEN upper(title) || '|' || title END AS aliases, code, CASE WHEN code IS NULL THEN 2 * n ELSE 0 END AS changed,
               CASE WHEN NOT f THEN NULL WHEN code IS NULL THEN '77 00 00 New.docx' WHEN v = 2 AND f1 AND (NOT f5 OR 'Other Work' < title) THEN d || ' 10 00 Other Work.docx' ELSE d || ' 10 00 ' || title || '.docx' END AS footer FROM k""",
}
