"""Only lists that tie definitions and styles together take part in the rounds."""

from folioframe.operators import sharing

P = "path string, paragraph_index long, num_id string, role string, proven_role string, handled boolean"
N = "path string, num_id string, abstract_id string, start string, overridden boolean, restart boolean"


def test_ties(spark, monkeypatch):
    seen = []
    whole = sharing.components
    monkeypatch.setattr(sharing, "components", lambda links, *a: (seen.append(sorted(map(tuple, links.collect()))), whole(links, *a))[1])
    paragraphs = [("d", 1, "1", "A", "A", True), ("d", 2, "1", "A", "B", True), ("d", 3, "9", "A", "A", False), ("e", 1, "1", "A", "A", True)]
    numbers = [("d", "1", "a", None, None, None), ("d", "2", "b", "2", False, None), ("d", "3", "c", "1", None, True), ("d", "4", None, None, True, None), ("e", "1", "a", None, None, None), ("e", "2", "a", None, None, None)]
    styles = [("d", "s", "1"), ("d", "s", "2"), ("d", "t", "7"), ("d", "u", None)]
    got = sharing.convertible_lists(spark.createDataFrame(paragraphs, P), spark.createDataFrame(numbers, N), spark.createDataFrame(styles, "path string, style string, num_id string"))
    assert {tuple(r)[:5] + (tuple(r.reasons),) for r in got.collect()} == {
        ("d", "1", "abstract:a", 2, False, ("other_role", "start")), ("d", "2", "abstract:a", 0, False, ("other_role", "start")), ("d", "3", "abstract:c", 0, False, ("restart",)),
        ("d", "4", "num:4", 0, False, ("no_definition", "override")), ("d", "7", "num:7", 0, True, ()), ("d", "9", "num:9", 1, False, ("no_definition", "not_handled")),
        ("e", "1", "abstract:a", 1, True, ()), ("e", "2", "abstract:a", 0, True, ()),
    }
    assert seen == [[("d", "abstract:a", "style:s"), ("d", "abstract:b", "style:s")]]
