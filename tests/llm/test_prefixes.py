"""The prefix trie against a trie built from dictionaries."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest

from pagecensus.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def in_order(rows):
    """Turns of each conversation as (role, text)."""
    listed = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            listed[conv_id].append((turn is not None, turn or 0, role or "", key, text or ""))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in listed.items()}


def with_openings(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]  # the remainder as in SQL
    return out


def brute(convs):
    members, parent, words = defaultdict(list), {}, {}
    for c in sorted(convs):
        turns = tuple(convs[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            parent[turns[:d]] = turns[: d - 1] if d else None
            words[turns[:d]] = len(re.findall(rb"[^\x20\x09-\x0D]+", turns[d - 1][1].encode())) if d else 0
    below = defaultdict(list)
    for node in members:
        if node:
            below[parent[node]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[n] for n in below[node]) if below[node] else 1
        saved[node] = (len(members[node]) - 1) * words[node] + sum(saved[n] for n in below[node])
    return sorted(
        (
            m[0], len(node), None if parent[node] is None else members[parent[node]][0], len(m), len(below[node]), leaves[node],
            saved[node], hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(node)).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def found(spark, rows, schema=SCHEMA):
    turns = prefixes.ordered_turns(spark.createDataFrame(rows, schema))
    result = prefixes.with_digests(prefixes.trie(*prefixes.with_shared_openings(turns)))
    return sorted(tuple(r[c] for c in COLUMNS) for r in result.collect())


def test_odd_conversations(spark):
    long_text = "word " * 20000
    rows = [
        (0, 1, "user", "hello there"), (0, 2, "assistant", "yes"), (0, 3, None, None), (0, 4, "user", ""),
        (1, None, "user", "first"), (1, 2, "user", "second"), (1, 2, "assistant", "tie"), (1, 2, "user", "second"),
        (2, 5, "user", "alone"), (21, 1, "user", "no opening to copy"), (22, 1, None, long_text), (23, 1, "", long_text),
        (None, 1, "user", "belongs nowhere"), (-5, 1, "user", "below zero"), (5, 1, "us", "er|x"), (6, 1, "user", "|x"),
    ]
    rows += [(c, t, "user", f"same {t}") for c in range(40, 60) for t in range(9)]
    assert found(spark, rows) == brute(with_openings(in_order(rows)))


@pytest.mark.parametrize("longest", [1, 4, 5, 37, 130])
def test_depths_around_the_cuts(spark, longest):
    """Conversations that part after every number of turns, and one that ends there."""
    rows = [(0, t, "user", f"t{t} a b") for t in range(longest)]
    for c in range(1, longest + 1):
        rows += [(20 * c, t, "user", f"t{t} a b" if t < c else f"own {c}") for t in range(min(c + 2, longest))]
    assert found(spark, rows) == brute(with_openings(in_order(rows)))


def test_without_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_more_columns_with_names_of_ours(spark):
    rows = [(c, t, "user", f"{t}", 1, 2, 3) for c in range(5) for t in range(c)]
    schema = SCHEMA + ", pos int, part int, n_turns int"
    assert found(spark, rows, schema) == brute(with_openings(in_order([r[:4] for r in rows])))


def test_a_conversation_over_several_parts(spark):
    """More turns than a task gets; the numbering goes on from part to part."""
    rows = [(7, t, "user", f"{t}") for t in range(3000)]
    turns = prefixes.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(8))
    got = sorted((r.pos, bytes(r.turn_key)) for r in turns.collect())
    want = [hashlib.sha256(f"4:user{t}".encode()).digest() for t in range(3000)]
    assert got == list(enumerate(want, start=1))


def test_digests_of_long_lists(spark):
    ends = spark.range(30000).selectExpr("1L AS conv_id", "2L AS depth", "id - 5 AS member").repartition(5)
    ends = ends.union(spark.sql("SELECT 1L, 3L, 9L"))
    got = {(r.conv_id, r.depth): r.ends_sha256 for r in prefixes.end_digests(ends).collect()}
    text = ",".join(str(i - 5) for i in range(30000))
    assert got == {(1, 2): hashlib.sha256(text.encode()).hexdigest(), (1, 3): hashlib.sha256(b"9").hexdigest()}
