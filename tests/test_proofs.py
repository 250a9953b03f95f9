"""Range joins, clocks, steady files, schemas and instruction rules on small cases written by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioframe.functions import schemas
from folioframe.operators import clock, instructions, ranges
from folioframe.sources import steady
from folioframe.streaming import clock as streamed


@pytest.mark.parametrize("width", [None, 1, 7, 10**6])
def test_ranges_equal_nested_loops(spark, width, monkeypatch):
    monkeypatch.setattr(ranges, "BINS_AT_ONCE", 8)
    rng = random.Random(2)
    spots = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(-300, 300), 5])) for i in range(200)]
    spans = [(rng.choice(["a", "b", None, "c"]), i, rng.choice([None, rng.randrange(-320, 300)]), rng.choice([None, rng.randrange(-300, 330), 2**62])) for i in range(80)] + [("a", 99, -(2**62), 2**62), ("a", 99, -(2**62), 2**62), ("b", 98, 5, 5)]
    got = ranges.contained(spark.createDataFrame(spots, "k string, i int, at long"), spark.createDataFrame(spans, "k string, r int, s long, e long"), ["k"], "at", "s", "e", width)
    want = [(i, r) for k, i, at in spots for q, r, s, e in spans if None not in (k, q, at, s, e) and k == q and s <= at < e]
    assert sorted((x.i, x.r) for x in got.collect()) == sorted(want)


def test_range_over_all_rows_is_many_groups(spark):
    """One key, one range over everything: the rows still meet in as many groups as there are bins."""
    spots = spark.range(20000).select(F.pmod("id", F.lit(1)).alias("k"), F.col("id").alias("at"))
    spans = spark.createDataFrame([(0, "all", 0, 10**12), (0, "some", 100, 200)], "k long, r string, s long, e long")
    got = ranges.contained(spots, spans, ["k"], "at", "s", "e")
    assert {r.r: r.n for r in got.groupBy("r").agg(F.count("*").alias("n")).collect()} == {"all": 20000, "some": 100}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__bin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_flagged_keeps_rows(spark):
    spots = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", None, "y"), (None, 3, "z"), ("a", 9, "q")], "k string, at long, flag string")
    spans = spark.createDataFrame([("a", 0, 5), ("a", 1, 2)], "k string, s long, e long")
    got = ranges.flagged(spots.withColumnRenamed("flag", "other"), spans, ["k"], "at", "s", "e", "inside")
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spots.selectExpr("k", "at", "flag AS other", "k IS NOT NULL AND at IS NOT NULL AND at < 5 AS inside").withColumn("inside", F.coalesce("inside", F.lit(False))).collect())
    assert ranges.flagged(spots.limit(0), spans, ["k"], "at", "s", "e", "inside").collect() == []


def test_clock_over_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, rng.random() * i])) for i in range(500)]
    got = clock.monotone(spark.createDataFrame(rng.sample(rows, 500), "i int, t double"), ["i"], "t", parts=7).orderBy("i").collect()
    most = None
    for n, (r, (i, t)) in enumerate(zip(got, rows), 1):
        most = t if most is None else most if t is None else max(most, t)
        assert (r.i, r.seq, r.clock) == (i, n, most)
    assert clock.monotone(spark.createDataFrame([], "i int, t double"), ["i"], "t").collect() == []


def test_streamed_clock_goes_on_after_a_restart(spark, tmp_path):
    """Two runs of the query over files that come in between equal one clock over all of them."""
    rng = random.Random(8)
    files = [[(rng.choice(["r1", "r2", None]), 100 * f + i, rng.choice([None, rng.random() * 50])) for i in range(40)] for f in range(4)]
    schema = "run string, event_id long, at double"

    def go(some):
        for f in some:
            spark.createDataFrame(files[f], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = streamed.clocked(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    go([0, 1])
    go([2, 3])
    got = {(r.run, r.event_id): (r.seq, r.clock, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for run in ("r1", "r2", None):
        most, seq = None, 0
        for row in sorted((x for f in files for x in f if x[0] == run), key=lambda x: x[1]):
            late = row[2] is not None and most is not None and row[2] < most
            most, seq = row[2] if most is None else most if row[2] is None else max(most, row[2]), seq + 1
            want[run, row[1]] = (seq, most, late)
    assert {k: (s, None if c is None or c != c else c, x) for k, (s, c, x) in got.items()} == want


def test_file_that_changes_while_it_is_read(spark, tmp_path):
    for name in ("same", "grows", "other", "goes"):
        (tmp_path / f"{name}.docx").write_bytes(name.encode())

    def during():
        (tmp_path / "grows.docx").write_bytes(b"grows more")
        (tmp_path / "other.docx").write_bytes(b"OTHER")
        (tmp_path / "goes.docx").unlink()
        (tmp_path / "comes.docx").write_bytes(b"new")

    got = {r.path.rsplit("/", 1)[1]: (r.content and bytes(r.content), r.fault) for r in steady.steady_files(spark, str(tmp_path), during=during).collect()}
    assert got == {"same.docx": (b"same", None), "grows.docx": (None, "resized"), "other.docx": (None, "rewritten"), "goes.docx": (None, "vanished"), "comes.docx": (None, "appeared")}
    assert {r.fault for r in steady.steady_files(spark, str(tmp_path)).collect()} == {None}


SCHEMA = {
    "type": "object", "required": ["a", "b.c"], "additionalProperties": False,
    "properties": {"a": {"type": ["integer", "null"], "minimum": 0}, "b.c": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {"k": {"enum": ["x", "y"]}}}}, "n": {"type": "number", "maximum": 1}, "t": {"type": "boolean"}},
}
CASES = {
    '{"a": 1, "b.c": []}': [], '{"a": null, "b.c": [{"k": "x", "more": 1}]}': [], "[]": [("$", "type")], "": [("$", "json")], "{": [("$", "json")], '{"a": 1, "a": 2, "b.c": []}': [("$", "json")], "null": [("$", "type")],
    '{"a": true, "b.c": {}}': [("$.a", "type"), ("$.b.c", "type")], '{"a": 1.0}': [("$.b.c", "required"), ("$.a", "type")], '{"a": -1, "b.c": [{"k": "z"}, 3, {}]}': [("$.a", "minimum"), ("$.b.c[0].k", "enum"), ("$.b.c[1]", "type"), ("$.b.c[2].k", "required")],
    '{"a": 0, "b.c": [], "z": 1, "y": null, "n": 2.5, "t": "true"}': [("$.y", "unknown"), ("$.z", "unknown"), ("$.n", "maximum"), ("$.t", "type")], '{"a": 0, "b.c": null, "n": 1e0}': [("$.b.c", "type")],
}


def test_schema_faults(spark):
    frame = spark.createDataFrame([(j,) for j in CASES] + [(None,)], "j string")
    got = {r.j: [tuple(x) for x in r.f] for r in frame.select("j", schemas.schema_faults(F.col("j"), SCHEMA).alias("f")).collect()}
    assert got == CASES | {None: [("$", "json")]}


@pytest.mark.parametrize("bad", [{"oneOf": []}, {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, {"$ref": "#/$defs/b"}, {"enum": [1]}])
def test_schemas_that_are_not_known(spark, bad):
    with pytest.raises(ValueError):
        schemas.schema_faults(F.col("j"), bad)


S = instructions.STYLES
GOOD = {
    "create_styles": [{"styleId": S["PART"], "derive_from_paragraph_index": 1, "basedOn": "Body", "name": "Part"}],
    "apply_pStyle": [{"paragraph_index": 1, "styleId": S["PART"]}, {"paragraph_index": 2, "styleId": "Head"}, {"paragraph_index": 3, "styleId": "Head"}],
    "ignored_paragraphs": [{"paragraph_index": 4, "reason": "note"}], "roles": {"PART": {"styleId": S["PART"], "exemplar_paragraph_index": 1}, "ARTICLE": {"styleId": "Head", "exemplar_paragraph_index": 2, "style_name": None}}, "notes": ["n"],
}
COLUMNS = "doc_id string, paragraph_index long, text string, style string, skip_reason string, direct boolean, numbered boolean, strong_role string, signature string, formatting string, head_and_title boolean"
PARAGRAPHS = [(0, "", None, "empty", False, False, None, None, None, False), (1, "PART 1", "Body", None, True, True, "PART", "0|PART %1", "f", False), (2, "1.01 A", "Head", None, False, True, "ARTICLE", "1|%1.%2", "g", False), (3, "1.02 B", "Head", None, False, True, "ARTICLE", "1|%1.%2", "g", False), (4, "NOTE", None, "editor_note", False, True, None, None, None, False), (5, "cell", None, "in_table", False, False, None, None, None, False)]


def _with(change):
    told = json.loads(json.dumps(GOOD))
    change(told)
    return told


VARIANTS = {
    "good": (lambda x: None, set()),
    "no base, null base": (lambda x: x["create_styles"][0].update(basedOn=None), {("base_is_not_source", S["PART"])}),
    "base left out": (lambda x: x["create_styles"][0].pop("basedOn"), set()),
    "twice": (lambda x: (x["create_styles"].append(dict(x["create_styles"][0])), x["apply_pStyle"].append({"paragraph_index": 3, "styleId": "Head"})), {("created_twice", S["PART"]), ("styled_twice", "3")}),
    "existing style with own formatting": (lambda x: x["roles"]["PART"].update(styleId="Body"), {("exemplar_has_own_formatting", "PART"), ("style_without_role", S["PART"]), ("created_unused", S["PART"]), ("style_is_not_of_role", "1")}),
    "unknown style": (lambda x: (x["roles"]["ARTICLE"].update(styleId="New"), [a.update(styleId="New") for a in x["apply_pStyle"][1:]]), {("role_unknown_style", "ARTICLE"), ("applied_unknown_style", "2"), ("applied_unknown_style", "3")}),
    "blank example": (lambda x: x["roles"]["PART"].update(exemplar_paragraph_index=0), {("exemplar_blank", "PART"), ("exemplar_is_not_source", "PART"), ("numbering_not_covered", "0|PART %1")}),
    "table example": (lambda x: x["roles"].update(PARAGRAPH={"styleId": "Normal", "exemplar_paragraph_index": 5}), {("exemplar_excluded", "PARAGRAPH")}),
    "collapse": (lambda x: (x["roles"]["PART"].update(styleId="Head", exemplar_paragraph_index=1), x["apply_pStyle"][0].update(styleId="Head"), x["create_styles"].clear()), {("roles_collapse", "Head"), ("exemplar_has_own_formatting", "PART"), ("role_other_style", "PART"), ("applied_other_style", "1")}),
    "coverage": (lambda x: (x["apply_pStyle"].pop(), x["ignored_paragraphs"].append({"paragraph_index": 5, "reason": "cell"})), {("not_covered", "3"), ("style_is_not_of_role", "3"), ("not_to_be_covered", "5")}),
    "bad index": (lambda x: x["apply_pStyle"][0].update(paragraph_index=True), {("shape:type", "$.apply_pStyle[0].paragraph_index")}),
    "null list": (lambda x: x.update(create_styles=None), {("shape:type", "$.create_styles")}),
    "extra": (lambda x: (x.update(more=1), x["roles"]["PART"].update(rPr="x")), {("shape:unknown", "$.more"), ("shape:unknown", "$.roles.PART.rPr")}),
}


def test_instruction_rules(spark):
    payloads = [(name, json.dumps(_with(change))) for name, (change, _) in VARIANTS.items()]
    paragraphs = [(name, *p) for name in VARIANTS for p in PARAGRAPHS] + [("without payload", 0, "x", None, None, False, False, None, None, None, False)]
    styles = [(name, s, s == "Normal") for name in VARIANTS for s in ("Normal", "Body", "Head")]
    got = instructions.instruction_faults(spark.createDataFrame(payloads, "doc_id string, payload string"), spark.createDataFrame(paragraphs, COLUMNS), spark.createDataFrame(styles, "doc_id string, style string, is_default boolean"))
    found = {name: set() for name in VARIANTS}
    for r in got.collect():
        assert (r.rule, r.place) not in found[r.doc_id], "a fault twice"
        found[r.doc_id].add((r.rule, r.place))
    assert found == {name: want for name, (_, want) in VARIANTS.items()}


def test_payload_rules_alone(spark):
    told = instructions.instruction_faults(spark.createDataFrame([("d", json.dumps(GOOD)), ("n", None)], "doc_id string, payload string"))
    assert [tuple(r) for r in told.collect()] == [("n", "shape:json", "$")]
    assert instructions.instruction_faults(spark.createDataFrame([], "doc_id string, payload string")).collect() == []
