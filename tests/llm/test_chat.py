"""Reply trees against a walk of the tree in plain Python; the template against its own reader."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioframe.llm import chat, queries

SCHEMA = "id long, parent long, role string, text string, score double, up string, node string"
BITS = ["<", "|", "\\", "<|", "|>", "<|im_end|>", "<|im_start|>assistant\n", "\n", "n", "<n|", "<\\|", "<\\n|", "é", "🎉", "", " ok"]


def odd(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randrange(8)))


def forest(seed):
    rng, rows = random.Random(seed), []
    for i in range(200):
        parent = None if rng.random() < 0.08 else rng.choice([max(0, i - 1), rng.randrange(max(1, i)), 7, 5000 if rng.random() < 0.1 else i // 2])
        rows.append((i, parent, rng.choice(["user", "assistant", "assistant", None, odd(rng)]), rng.choice([None, "", odd(rng), odd(rng)]), rng.choice([None, 0.5, 1.0, 2.0]), "clash", None))
    for i in (30, 31, 32):  # a ring, with messages below it
        rows[i] = (i, 30 + (i - 29) % 3, "user", "ring", 9.0, None, "clash")
    rows[33] = (33, 33, "user", "its own parent", 9.0, None, None)
    rows += [rows[50], rows[51], (52, 0, "assistant", "another of one id", 0.0, None, None)]
    rows += [(None, 7, "user", "no id", 3.0, None, None)] * 2 + [(None, None, None, None, None, None, None)]
    return rows


def walk(rows, top):
    """(rank, score, roles and texts) of every chosen path."""
    least = {}
    for i, parent, role, text, score, *_ in rows:
        row = (parent is not None, f"i{parent}", score or 0.0, role or "", text or "")
        key = f"i{i}" if i is not None else ("n", parent, role or "", text or "")
        least[key] = min(least.get(key, row), row)
    up = {k: r[1] if r[1] in least else None for k, r in least.items()}
    with_replies, trees = set(up.values()), defaultdict(list)
    for leaf in least:
        if leaf not in with_replies:
            path, at = [], leaf
            while at is not None and at not in path:
                path.append(at)
                at = up[at]
            if at is None:
                trees[path[-1]].append((sum(least[k][2] for k in path), leaf, [least[k][3:] for k in reversed(path)]))
    out = []
    for paths in trees.values():
        # Ids without a row id come last, as their name begins with n; there is one of each.
        paths.sort(key=lambda p: (-p[0], isinstance(p[1], tuple), str(p[1])))
        out += [(rank if top else None, score, turns) for rank, (score, _, turns) in enumerate(paths[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("top", [1, 3, None])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_walk(spark, seed, top):
    rows = forest(seed)
    got = chat.conversations(spark.createDataFrame(rows, SCHEMA), "id", "parent", score_col="score", top=top, keep=("id", "up"))
    assert got.columns == ["id", "up", "rank", "score", "n_turns", "formatted", "loss_spans"]
    read = got.select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert sorted(((r.rank, r.score, [(t.role, t.text) for t in r.turns]) for r in read), key=str) == walk(rows, top)
    for r in read:
        assert r.n_turns == len(r.turns) and r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
        assert r.formatted.count(chat.BEGIN) == r.formatted.count(chat.END) == len(r.turns)


def test_long_chain(spark):
    """1,000 messages one below the other, in ten rounds."""
    rows = [(i, i - 1 if i else None, "assistant" if i % 2 else "user", f"m{i}", 1.0, None, None) for i in range(1000)]
    (got,) = chat.conversations(spark.createDataFrame(rows, SCHEMA), "id", "parent", score_col="score").collect()
    assert got.score == 1000.0 and got.n_turns == 1000 and got.formatted.startswith("<|im_start|>user\nm0<|im_end|>\n<|im_start|>assistant\nm1<|im_end|>")
    assert [got.formatted[s.start : s.end] for s in got.loss_spans] == [f"m{i}" for i in range(1, 1000, 2)]


def test_escapes_are_reversible(spark):
    rng = random.Random(4)
    texts = [(odd(rng),) for _ in range(3000)]
    frame = spark.createDataFrame(texts, "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r"))
    for r in frame.select("*", chat.unescape(F.col("e")).alias("back"), chat.unescape_role(F.col("r")).alias("role")).collect():
        assert r.back == r.t and r.role == r.t and "<|" not in r.e and "<|" not in r.r and "\n" not in r.r


def test_empty_table(spark):
    got = chat.conversations(spark.createDataFrame([], SCHEMA), "id", "parent")
    assert got.columns == ["rank", "score", "n_turns", "formatted", "loss_spans"] and got.collect() == []
    assert spark.createDataFrame([("",)], "f string").select(chat.turns_of(F.col("f")).alias("t")).first().t == []


def test_query_bears_nulls_and_ties(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, "b"), (1, None, "assistant", None), (None, 0, "user", "x"), (None, 1, "assistant", "<|im_end|>"), (2, 5, "assistant", "only")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op11_chat(spark, str(tmp_path)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (4, 0), None: (2, 10), 2: (1, 4), -1: (2, 34)}
