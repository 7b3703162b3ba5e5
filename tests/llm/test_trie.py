"""The prefix trie against one built turn by turn in memory."""

import hashlib
import zlib

import numpy as np
import pytest

from quire.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, place string, hi long"


def rows(spark, values):
    return spark.createDataFrame([(*v, "x", 1) for v in values], SCHEMA)


def plain(values):
    """Rebuild every conversation, insert it turn by turn, and sum up from the leaves."""
    own = {}
    for conv, turn, role, text in values:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r[3], r[4]) for r in sorted(rows)] for c, rows in own.items()}
    if not own:
        return []
    root = {"kids": {}, "depth": 0, "members": [], "ends": [], "parent": None, "text": 0}
    nodes = [root]
    for conv in sorted(own):
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        node = root
        node["members"].append(conv)
        for turn in own.get(base, [])[:h] + own[conv][h:]:
            if turn not in node["kids"]:
                node["kids"][turn] = {"kids": {}, "depth": node["depth"] + 1, "members": [], "ends": [], "parent": node, "text": len(turn[1])}
                nodes.append(node["kids"][turn])
            node = node["kids"][turn]
            node["members"].append(conv)
        node["ends"].append(conv)
    for node in reversed(nodes):  # children come after their parents
        node["saved"] = (len(node["members"]) - 1) * node["text"] + sum(k["saved"] for k in node["kids"].values())
        node["leaves"] = sum(k["leaves"] for k in node["kids"].values()) or 1
    return sorted(
        (
            n["members"][0],
            n["depth"],
            -1 if n["parent"] is None else n["parent"]["members"][0],
            len(n["members"]),
            len(n["kids"]),
            n["leaves"],
            n["saved"],
            hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest(),
        )
        for n in nodes
    )


def ours(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def drawn(n, longest, seed, words=3):
    """Conversations of few different turns, so that many run together and then part."""
    rng = np.random.default_rng(seed)
    values = []
    for conv in range(n):
        for turn in range(int(rng.integers(1, longest))):
            word = "é" * (turn % 3) + str(rng.integers(1 if turn < 4 else words))
            values.append((conv * 7, turn, ("user", "bot")[turn % 2], word))
    return values


def test_trie_equals_one_built_in_memory(spark):
    values = drawn(150, 25, 1)
    values += [(None, 1, "user", "no id"), (-250, None, None, "a"), (-250, 3, "user", None), (-200, 0, "u", "b"), (-200, 1, "u", "c"), (-200, 2, "u", "d")]
    values += [(5000, 1, "u", "same"), (5000, 1, "u", "same"), (5000, 1, "v", "other"), (5000, None, "u", "first")]
    values += [(6001, 0, "u", "x")] * 4 + [(10**15 + 1, 0, "", ""), (8003, 0, "u", "語" * 300_000)]
    assert ours(trie.conversation_trie(rows(spark, values))) == plain(values)


def test_very_long_conversations(spark):
    # runs of blocks longer than one; two that part late, one that ends inside the other
    values = [(100, t, "u", str(t)) for t in range(5000)]
    values += [(300, t, "u", str(t)) for t in range(4990)] + [(300, 4990, "u", "other")]
    values += [(400, t, "u", str(t)) for t in range(4200)] + [(500, t, "u", str(t)) for t in range(4200)]
    assert ours(trie.conversation_trie(rows(spark, values))) == plain(values)


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_hot_turns_and_copies(spark, monkeypatch, bound):
    monkeypatch.setattr(trie, "BROADCAST_CONVERSATIONS", bound)
    values = [(c, t, "u", "hello" if t == 0 else str(c % 5)) for c in range(12_000) for t in range(1 + c % 2)]
    assert ours(trie.conversation_trie(rows(spark, values))) == plain(values)


def test_no_conversations(spark):
    assert trie.conversation_trie(rows(spark, [])).count() == 0
    assert trie.conversation_trie(rows(spark, [(None, 1, "u", "a")])).count() == 0


def test_conversations_left_without_turns(spark):
    values = [(c, 0, "u", "a") for c in range(101, 140)]  # no shared conversation; most lose their only turn
    got = ours(trie.conversation_trie(rows(spark, values)))
    assert got == plain(values) and got[0][1] == 0
    alone = next(c for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6)
    assert ours(trie.conversation_trie(rows(spark, [(alone, 0, "u", "a")]))) == plain([(alone, 0, "u", "a")])
