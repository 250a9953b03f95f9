"""Runs under a policy, protected structures and bundles, from file to file."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.functions import cases, ordering
from folioframe.operators import application, bags, graph, invariants, sharing
from folioframe.sources import bundles, packages, writing

from .test_shells import W, _lists, _package, _rels, _run

STYLES = (
    f'<w:styles {W}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>'
    '<w:style w:type="paragraph" w:styleId="Base"><w:name w:val="Base"/><w:basedOn w:val="Normal"/><w:pPr><w:jc w:val="both"/></w:pPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="P"><w:name w:val="P"/><w:basedOn w:val="Base"/><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr></w:pPr><w:rPr><w:b/></w:rPr></w:style></w:styles>'
)
OWN = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="Base"><w:name w:val="another"/></w:style><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="H1"/></w:style></w:styles>'
BOLD = "<w:rPr><w:b/><w:sz w:val=\"20\"/></w:rPr>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    (folder / "template").mkdir()
    (folder / "targets").mkdir()
    _package(folder / "template", "template.docx", f'<w:p><w:pPr><w:pStyle w:val="P"/></w:pPr>{_run("x")}</w:p>', {"word/styles.xml": STYLES, "word/numbering.xml": _lists(3, 5, "AAAA0000"), "word/_rels/document.xml.rels": _rels(("s", "styles", "styles.xml"))})
    more = {"word/styles.xml": OWN, "word/numbering.xml": _lists(0, 1, "BBBB0000"), "word/_rels/document.xml.rels": _rels(("s", "styles", "styles.xml"))}
    good = f'<w:p><w:pPr><w:pStyle w:val="H1"/><w:jc w:val="left"/></w:pPr>{_run("A. ", BOLD)}{_run("Scope", BOLD)}</w:p><w:p>{_run("plain")}</w:p><w:sectPr><w:pgSz w:w="1"/></w:sectPr>'
    _package(folder / "targets", "good.docx", good, more)
    _package(folder / "targets", "tracked.docx", f'<w:p>{_run("A. ")}<w:ins>{_run("in")}</w:ins></w:p><w:p>{_run("plain")}</w:p>', more)
    _package(folder / "targets", "unknown.docx", good, more)
    (folder / "targets" / "broken.docx").write_bytes(b"no package")
    return folder


def _names(rows, *columns):
    return {(r.path.rsplit("/", 1)[1], *(r[c] for c in columns)) for r in rows.collect()}


@pytest.mark.parametrize(("mode", "failed"), [("format_only", {("broken.docx", "package", "not_a_package"), ("unknown.docx", "role_unknown", "CHAPTER")}), ("convert", {("broken.docx", "package", "not_a_package"), ("unknown.docx", "role_unknown", "CHAPTER"), ("tracked.docx", "tracked", "0")})])
def test_one_run_with_good_and_bad_packages(spark, folder, tmp_path, mode, failed):
    parts = packages.parts(packages.files(spark, f"{folder}/targets")).cache()
    template = packages.parts(packages.files(spark, f"{folder}/template")).cache()
    paths = {p.rsplit("/", 1)[1]: p for p in (r.path for r in parts.select("path").distinct().collect())}
    roles = spark.createDataFrame([(paths[n], 0, "CHAPTER" if n == "unknown.docx" else "PARAGRAPH") for n in paths], "path string, paragraph_index long, role string")
    entries = spark.createDataFrame([("PARAGRAPH", "P", "5", "0")], "role string, style_id string, num_id string, level string")
    run = application.run(parts, template, entries, roles, mode)
    assert _names(run.faults, "code", "detail") == failed
    bad = {f[0] for f in failed}
    assert _names(run.outcomes, "status") == {(n, "failed" if n in bad else "succeeded") for n in paths}
    assert _names(run.parts.where("origin <> 'kept'")) == {(n,) for n in paths if n not in bad}
    # What failed is whole and unchanged.
    before = {(r.path, r.part): bytes(r.content) for r in parts.where("fault IS NULL").collect()}
    after = {(r.path, r.part): bytes(r.content) for r in run.parts.collect()}
    assert {k[0] for k in after} == {k[0] for k in before}
    for k, content in before.items():
        if k[0].rsplit("/", 1)[1] in bad:
            assert after[k] == content
    made = dict((r.path, r.package) for r in writing.packed(run.parts).collect())
    again = tmp_path / "good.docx"
    again.write_bytes(made[paths["good.docx"]])
    with zipfile.ZipFile(io.BytesIO(made[paths["good.docx"]])) as z:
        sheet, body, lists = (z.read(f"word/{x}.xml").decode() for x in ("styles", "document", "numbering"))
    assert 'w:styleId="P"' in sheet and sheet.count("Base__") == 2 and 'w:default="1"' not in sheet
    assert ("<w:numPr>" in sheet) == (mode == "convert") and ('<w:numId w:val="2"/>' in sheet) == (mode == "convert") == ('w:numId="2"' in lists)
    first = body[body.index("<w:p>") : body.index("</w:p>")]
    assert '<w:pStyle w:val="P"/>' in first and "<w:jc" not in first and "<w:b/>" not in first and 'w:val="20"' in first
    assert ("A. " in first) == (mode == "format_only") and ("<w:numPr>" in first) == (mode == "convert")
    assert [r.text for r in packages.paragraphs(packages.parts(packages.files(spark, str(tmp_path)))).orderBy("paragraph_index").collect()] == ["A. Scope" if mode == "format_only" else "Scope", "plain"]


def test_one_planted_change_per_kind(spark, tmp_path):
    header = f"<w:hdr {W}><w:p/></w:hdr>"
    body = f'<w:p>{_run("a", BOLD)}{_run("b")}</w:p><w:sectPr><w:headerReference w:type="default" r:id="h"/><w:pgSz w:w="1"/><w:formProt/></w:sectPr>'
    _package(tmp_path, "a.docx", body, {"word/_rels/document.xml.rels": _rels(("h", "header", "header1.xml"), ("i", "image", "media/a.png")), "word/header1.xml": header, "word/media/a.png": b"picture", "word/numbering.xml": _lists(0, 1, "AAAA0000"), "word/settings.xml": f"<w:settings {W}/>"})
    parts = packages.parts(packages.files(spark, str(tmp_path))).cache()
    before = invariants.evidence(parts).cache()
    assert {r.kind for r in before.select("kind").distinct().collect()} == set(invariants.KINDS)
    assert invariants.violations(before, invariants.evidence(parts)).isEmpty()
    changes = {
        "section": ("word/document.xml", "<w:formProt/>", '<w:formProt w:val="0"/>', {("section", "0")}), "layout": ("word/document.xml", 'w:w="1"', 'w:w="2"', {("layout", "0")}),
        "shell": ("word/document.xml", 'r:id="h"', 'r:id="x"', {("shell", "0/header/default")}), "list": ("word/numbering.xml", "decimal", "upperLetter", {("list", "abstractNum")}),
        "media": ("word/media/a.png", "picture", "another", {("media", "media"), ("part", "word/media/a.png")}), "runs": ("word/document.xml", "<w:b/>", "", {("runs", "0")}),
        "links": ("word/_rels/document.xml.rels", "media/a.png", "media/b.png", {("links", "i")}), "part": ("word/settings.xml", "/>", "><w:zoom/></w:settings>", {("part", "word/settings.xml")}),
    }
    for kind, (part, old, new, want) in changes.items():
        text = F.replace(F.decode("content", "UTF-8"), F.lit(old), F.lit(new)).cast("binary")
        hurt = parts.withColumn("content", F.when(F.col("part") == part, text).otherwise(F.col("content")))
        got = invariants.violations(before, invariants.evidence(hurt))
        assert {(r.kind, r.owner) for r in got.collect()} == want, kind
        free = spark.createDataFrame([(None, k, None) for k, _ in want], "path string, kind string, owner string")
        assert invariants.violations(before, invariants.evidence(hurt), free).isEmpty()
    swapped = F.replace(F.decode("content", "UTF-8"), F.lit(_run("a", BOLD) + _run("b")), F.lit(_run("b") + _run("a", BOLD))).cast("binary")
    turned = parts.withColumn("content", F.when(F.col("part") == "word/document.xml", swapped).otherwise(F.col("content")))
    assert {(r.kind, r.change) for r in invariants.violations(before, invariants.evidence(turned)).collect()} == {("runs", "moved")}


def test_bags(spark):
    b = spark.createDataFrame([("x", "a", 1), ("x", "a", 2), ("x", None, 3), ("y", "p", 1), ("y", "q", 2), (None, "n", 1), ("z", "s", None)], "k string, value string, place int")
    a = spark.createDataFrame([("x", "a", 1), ("x", "b", 3), ("y", "q", 1), ("y", "p", 2), (None, "n", 2), ("z", "s", None)], "k string, value string, place int")
    got = {tuple(r) for r in bags.differences(b, a, ["k"]).collect()}
    assert got == {("x", "lost", "a", 1), ("x", "lost", None, 1), ("x", "gained", "b", 1), ("y", "moved", "p", 1), ("y", "moved", "q", 1), (None, "moved", "n", 1)}
    assert bags.differences(b.limit(0), a.limit(0), ["k"]).collect() == []


def test_components_and_cycles(spark):
    links = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "z", "z"), ("q", "a", "z")] + [("chain", f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "path string, src string, dst string")
    got = {(r.path, r.node): r.root for r in sharing.components(links).collect()}
    assert got[("p", "c")] == "a" and got[("p", "z")] == "z" and got[("q", "z")] == "a" and {got[("chain", f"n{i:03}")] for i in range(61)} == {"n000"}
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, 5)], "k long, up long")
    assert {(r.k, r.node, r.depth) for r in graph.closure(ring, "k", "up").collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (2, 1, 2), (3, 3, 0), (3, 1, 1), (3, 2, 2), (4, 4, 0), (5, 5, 0)}


def test_lists_share_their_fate(spark):
    numbers = spark.createDataFrame([("d", "1", "7", None, False, False), ("d", "2", "7", "1", False, False), ("d", "3", "8", "2", False, False), ("d", "4", "9", None, True, True), ("e", "1", None, None, None, None)], "path string, num_id string, abstract_id string, start string, overridden boolean, restart boolean")
    paragraphs = spark.createDataFrame([("d", 0, "1", "PART", "PART", True), ("d", 1, "2", "PART", None, True), ("d", 2, "3", "PART", "PART", True), ("d", 3, None, None, None, None), ("d", 4, "5", "PART", "PART", None), ("d", 5, "6", None, None, True)], "path string, paragraph_index long, num_id string, role string, proven_role string, handled boolean")
    styles = spark.createDataFrame([("d", "S", "5"), ("d", "T", None), ("d", "U", "6"), ("d", "U", "3")], "path string, style string, num_id string")
    got = {(r.path, r.num_id): (r.paragraphs, r.convertible, r.reasons) for r in sharing.convertible_lists(paragraphs, numbers, styles).collect()}
    assert got == {("d", "1"): (1, False, ["other_role"]), ("d", "2"): (1, False, ["other_role"]), ("d", "3"): (1, False, ["no_definition", "start"]), ("d", "4"): (0, False, ["override", "restart"]), ("d", "5"): (1, False, ["no_definition", "not_handled"]), ("d", "6"): (1, False, ["no_definition", "start"]), ("e", "1"): (0, False, ["no_definition"])}


def test_bundle_from_file_to_file(spark, tmp_path):
    held = spark.createDataFrame([("o1", "styles", "text/xml", b"<a/>"), ("o1", "audit", "application/json", b"{}"), ("o2", "styles", "text/xml", None)], "owner string, artifact string, media_type string, content binary")
    root = str(tmp_path / "out")
    staged = bundles.stage(held, root, ["styles"])
    manifest, artifacts = bundles.read(spark, staged)
    assert bundles.faults(manifest, artifacts, ["styles"]).isEmpty() and {(r.owner, r.artifact, r.length, r.required) for r in manifest.collect()} == {("o1", "styles", 4, True), ("o1", "audit", 2, False), ("o2", "styles", 0, True)}
    done = bundles.publish(spark, staged, required=["styles"])
    assert done.rpartition("/")[2] == bundles.name_of(spark, done) and [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == [done.rpartition("/")[2]]
    # The same artifacts, otherwise dealt, have the same name, and don't replace what is there.
    other = bundles.stage(held.repartition(3), root, ["styles"])
    with pytest.raises(FileExistsError):
        bundles.publish(spark, other, required=["styles"])
    assert bundles.publish(spark, other, overwrite=True) == done and bundles.read(spark, done)[1].count() == 3
    with pytest.raises(ValueError, match="required"):
        bundles.stage(held.where("artifact = 'audit'"), root, ["styles"])
    with pytest.raises(ValueError, match="listed_twice"):
        bundles.stage(held.unionByName(held), root)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".staging")]
    with pytest.raises(ValueError):
        bundles.discard(spark, done)
    with pytest.raises(ValueError):
        bundles.publish(spark, done)


def test_bundle_changed_behind_its_manifest(spark, tmp_path):
    held = spark.createDataFrame([("o", "a", "t", b"1"), ("o", "b", "t", b"2")], "owner string, artifact string, media_type string, content binary")
    staged = bundles.stage(held, str(tmp_path))
    held.where("artifact = 'a'").write.mode("append").parquet(f"{staged}/artifacts")
    with pytest.raises(ValueError, match="o/a: held_twice"):
        bundles.publish(spark, staged)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "manifest").write_text('{"format": 1, "length": "x"}')
    with pytest.raises(Exception, match="(?i)malformed|cannot be parsed|FAILED_READ"):
        spark.read.schema(bundles.MANIFEST).option("mode", "FAILFAST").json(f"{tmp_path}/bad/manifest").collect()


def test_case_applied_by_hand(spark):
    rows = [("SUMMARY OF WORK", "title", "Summary Of Work"), ("HVAC AND DDC-CONTROLS", "title", "HVAC And DDC-Controls"), ("hvac Work", "title", "hvac Work"), ("O'NEIL'S ÉTÉ", "title", "O'Neil'S Été"), ("a  b\tC", "upper", "A  B\tC"), ("A b", "mixed", "A b"), ("", "title", ""), (None, "upper", None), ("X", None, "X"), ("(HVAC), UL", "title", "(HVAC), UL"), ("01 10 00", "title", "01 10 00"), ("groß", "upper", "GROSS")]
    frame = spark.createDataFrame(rows, "t string, p string, w string").select("t", "w", cases.applied(F.col("t"), F.col("p")).alias("got"))
    assert [(r.t, r.got) for r in frame.collect()] == [(r[0], r[2]) for r in rows]
    runs = spark.createDataFrame([(["SUM", None, "MARY O", "F groß"], "title"), (["gr", "oß x"], "upper"), ([], "title")], "r array<string>, p string").select(cases.applied_to_runs(F.col("r"), F.col("p")).alias("g"))
    assert [r.g for r in runs.collect()] == [["Sum", "", "mary O", "f groß"], ["GR", "OSS X"], []]


def test_children_in_order_by_hand(spark):
    child = "array<struct<tag: string, xml: string>>"
    cases_ = [
        (["type", "x", "cols", "docGrid"], ["docGrid", "pgSz", "pgSz"], ["type", "x", "pgSz", "cols", "docGrid"], ["pgSz", "docGrid"]), (["pgSz", "titlePg"], [], ["titlePg"], ["pgSz"]), ([], ["cols", "pgMar"], ["pgMar", "cols"], ["pgMar", "cols"]), (["x", "y"], ["pgSz"], ["x", "y", "pgSz"], ["pgSz"]), (None, None, [], ["pgSz"]), (["titlePg", "type"], ["pgSz"], ["pgSz", "titlePg", "type"], ["pgSz"]),
    ]
    for target, source, want, managed in cases_:
        tagged = lambda xs, by: None if xs is None else [(x, f"{by}{i}") for i, x in enumerate(xs)]
        row = spark.createDataFrame([(tagged(target, "t"), tagged(source, "s"))], f"t {child}, s {child}").select(ordering.merged_children(F.col("t"), F.col("s"), managed).alias("m")).first()
        assert [c.tag for c in row.m] == want and all(c.xml.startswith("s" if c.tag in managed else "t") for c in row.m)
