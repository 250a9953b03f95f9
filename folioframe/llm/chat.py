"""Reply trees to conversations: root-to-leaf paths, ranked, each formatted as one text.

Messages know the message they answer.  Self-joins find the way up: after round
k each message knows its ancestor 2**k steps above and the scores in between, so
a tree of depth d takes log2(d) joins of narrow rows, however it is shaped.
Only the leaves that were chosen by score are then unfolded, by the same
tables, into the messages of their path.  Texts join in at the end and are
written with marks that no text can hold, as every mark inside one is escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BEGIN, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """``text`` without the two characters that begin a mark: a backslash goes between them, or before those already there."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role as one line: as ``escape``, with ``<n|`` for a line end."""
    return F.replace(F.regexp_replace(role, r"<(\\*n?)\|", r"<\\$1|"), F.lit("\n"), F.lit("<n|"))


def unescape_role(role: Column) -> Column:
    """The inverse of ``escape_role``."""
    return F.regexp_replace(F.replace(role, F.lit("<n|"), F.lit("\n")), r"<\\(\\*n?)\|", r"<$1|")


def _nodes(messages: DataFrame, id_col: str, parent_col: str, role_col: str, text_col: str, score_col: str | None, keep: tuple[str, ...]) -> DataFrame:
    """``node, up, score, role, text, kept``: one row a message; ``up`` is null where the parent is no message."""
    key = lambda c: F.concat(F.lit("i"), F.col(c).cast("string"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    without = F.concat(F.lit("n"), F.sha2(F.concat_ws("\0", F.col(parent_col).cast("string"), role, text), 256))
    rows = messages.select(F.coalesce(key(id_col), without).alias("node"), F.struct(key(parent_col).alias("up"), score.alias("score"), role.alias("role"), text.alias("text"), F.struct(F.lit(0), *keep).alias("kept")).alias("row"))
    one = cut(rows.groupBy("node").agg(F.min("row").alias("row")).select("node", "row.*"))
    known = one.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    return one.join(known, "up", "left").withColumn("up", F.when(F.col("known"), F.col("up"))).drop("known")


def _climb(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``node, up`` of the ancestors 1, 2, 4, ... steps above, and ``node, root, depth, score`` of all nodes under a root.

    After k rounds the nodes of the first 2**k levels know their root.  A round
    in which none finds it leaves only those on a cycle or below one.
    """
    now, tables, open_before = cut(edges.select("node", "up", F.when(F.col("up").isNull(), F.col("node")).alias("root"), F.lit(1).cast("long").alias("depth"), "score")), [], None
    while (still := now.where(F.col("up").isNotNull()).count()) not in (0, open_before):
        open_before = still
        tables.append(now.where(F.col("up").isNotNull()).select("node", "up"))
        above = now.select(F.col("node").alias("up"), F.struct("up", "root", "depth", "score").alias("above"))
        # Nodes that know their root are told to others but ask no more.
        asked = now.where(F.col("up").isNotNull()).join(above, "up").select("node", F.col("above.up").alias("up"), F.col("above.root").alias("root"), (F.col("depth") + F.col("above.depth")).alias("depth"), (F.col("score") + F.col("above.score")).alias("score"))
        now = cut(now.where(F.col("up").isNull()).unionByName(asked))
    return tables, now.where(F.col("root").isNotNull()).select("node", "root", "depth", "score")


def _chosen(edges: DataFrame, climbed: DataFrame, top: int | None) -> DataFrame:
    """``leaf, root, depth, score, rank``: the ``top`` leaves of each root by score, ties to the least id; all of them, without a rank, where ``top`` is None."""
    leaves = climbed.join(edges.where(F.col("up").isNotNull()).select(F.col("up").alias("node")).distinct(), "node", "left_anti").withColumnRenamed("node", "leaf")
    if top is None:
        return leaves.withColumn("rank", F.lit(None).cast("int"))
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "leaf")))
    return ranked.where(F.col("rank") <= top)


def conversations(
    messages: DataFrame, id_col: str, parent_col: str, role_col: str = "role", text_col: str = "text", score_col: str | None = None, top: int | None = 1, keep: tuple[str, ...] = (), loss_role: str = "assistant"
) -> DataFrame:
    """``keep`` columns of the leaf, plus ``rank, score, n_turns, formatted, loss_spans``: one row per chosen path.

    A path's score is the sum of its messages' (null: 0); the ``top`` paths of
    each tree are taken (None: all).  ``loss_spans`` are the places of the
    ``loss_role``'s texts in ``formatted``, in code points from 0, end excluded.

    A message without a parent among the messages is a root; messages on a cycle
    or below one are in no path.  Of rows with one id the least by parent, score,
    role and text stays; a row without an id can't be answered, and such rows
    with equal parent, role and text are one.  Null roles and texts are empty; an
    empty table gives an empty one.
    """
    nodes = cut(_nodes(messages, id_col, parent_col, role_col, text_col, score_col, keep))
    edges = nodes.select("node", "up", "score")
    tables, climbed = _climb(edges)
    ways = _chosen(edges, climbed, top).select("leaf", F.col("leaf").alias("node"), "depth", "score", "rank", F.col("depth").alias("pos"))
    # The farthest steps first: until the last rounds few paths have more than their leaf.
    for k, table in reversed([*enumerate(tables)]):
        further = ways.join(table, "node", "left")
        both = F.array_compact(F.array(F.struct("node", "pos"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("pos") - 2**k).alias("pos")))))
        ways = cut(further.select("leaf", "depth", "score", "rank", F.explode(both).alias("x")).select("leaf", "depth", "score", "rank", "x.*"))
    told = ways.join(nodes.select("node", "role", "text", "kept"), "node")
    head, body = F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    turns = told.select("*", F.concat(head, body, F.lit(END + "\n")).alias("piece"), F.length(head).alias("before"), F.length(body).alias("chars"))
    earlier = Window.partitionBy("leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    begin = (F.coalesce(F.sum(F.length("piece")).over(earlier), F.lit(0)) + F.col("before")).alias("start")
    spans = turns.select("*", begin).withColumn("span", F.when(F.col("role") == loss_role, F.struct("start", (F.col("start") + F.col("chars")).alias("end"))))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    paths = spans.groupBy("leaf", "rank", "score").agg(F.max_by("kept", "pos").alias("kept"), F.count("*").alias("n_turns"), whole.alias("formatted"), F.array_sort(F.collect_list("span")).alias("loss_spans"))
    return paths.select(*[F.col("kept").getField(c).alias(c) for c in keep], "rank", "score", "n_turns", "formatted", "loss_spans")


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.split(formatted, BEGIN.replace("|", r"\|"))
    last = len(END) + 1

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        begin = F.length(role) + 2
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(part, begin, F.length(part) - begin + 1 - last)).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
