"""The prefix trie against a plain one, with one long conversation, copies, ties and odd rows."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from kerbside.llm import prefixtrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, rebuild=True):
    """Every node of the trie of whole sequences, counted one by one."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        source = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(source, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def words(path):
        return len((path[-1][1] if path else "").encode().split())

    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * words(path) + sum(saved[x] for x in children[path])
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(path))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), leaves[path], saved[path], sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def told(df):
    assert df.columns == COLUMNS
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("rebuild", [True, False])
def test_nodes_equal_a_plain_trie(spark, monkeypatch, rebuild):
    monkeypatch.setattr(prefixtrie, "HOT_PARENTS", 2)
    monkeypatch.setattr(prefixtrie, "CHUNK", 3)
    monkeypatch.setattr(prefixtrie, "MERGED", 1)
    dice, rows = random.Random(7), []
    for c in range(90):
        if c in (20, 41, 43):  # without a source, without turns of its own
            continue
        for t in range(dice.randint(1, 6)):
            rows.append((c, t, dice.choice(["user", "assistant"]), dice.choice(["a b", "c", "", "d e f"])))
    rows += [(c, t, "user", f"copy {t} of\tmany") for c in range(100, 160) for t in range(5)]
    rows += [(200, t, "user", f"long {t % 7}") for t in range(400)] + [(203, t, "user", f"long {t % 7}") for t in range(390)]
    dice.shuffle(rows)
    assert told(prefixtrie.trie(frame(spark, rows).repartition(5), rebuild)) == plain(rows, rebuild)


def test_odd_rows(spark):
    rows = [(1, None, None, "a"), (1, 0, "u", None), (1, 0, "u", None), (1, 0, "a", "x"), (2, 5, "", "a"), (None, 1, "u", "a"), (-3, 1, "u", "b c"), (-20, 1, "u", "b"), (-20, 2, "u", "b"), (-20, 3, "u", "b"), (0, 1, "u", "word " * 20000), (1 << 62, 0, "u", "é b")]
    rows += [(7, 1, "u", "same")] * 40
    df = frame(spark, rows)
    for name in ("c", "node", "parent", "part"):
        df = df.withColumn(name, F.lit("x"))
    assert told(prefixtrie.trie(df)) == plain(rows)
    assert told(prefixtrie.trie(df, rebuild=False)) == plain(rows, False)


def test_no_conversations_no_nodes(spark):
    assert prefixtrie.trie(frame(spark, [])).count() == 0
    assert prefixtrie.trie(frame(spark, [(None, 1, "u", "a")])).count() == 0


def test_a_conversation_of_most_rows_lies_in_many_tasks(spark):
    rows = [(5, t, "user", "x") for t in range(3000)] + [(c, 0, "user", "y") for c in range(100)]
    placed = []
    keep = prefixtrie.stage
    try:
        prefixtrie.stage = lambda df, label: placed.append((label, out := keep(df, label))) or out
        prefixtrie.trie(frame(spark, rows)).count()
    finally:
        prefixtrie.stage = keep
    parts = dict(placed)["turns"].groupBy("part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1500
