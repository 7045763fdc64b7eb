import hashlib
import random
import zlib

import pytest

from pkgpulse.llm import prefix_trie as T
from pkgpulse.llm.queries import op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, n int, depth int"


def conversations(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out.setdefault(conv, []).append((turn is not None, turn or 0, role, tie, text))
    return {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in out.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved, rows = {}, {}, {}, []
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    for path in sorted(members, key=len, reverse=True):
        below, n = children.get(path, []), len(members[path])
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + (n - 1) * (len(path[-1][1].encode()) if path else 0)
        ends = ",".join(map(str, sorted(c for c in members[path] if len(convs[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        rows.append((min(members[path]), len(path), parent, n, len(below), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("limit", [4096, 40, 3, 1])
def test_limits_give_one_trie(spark, limit):
    rng = random.Random(11)
    rows = []
    for conv in range(120):
        crowd = conv % 3 == 0  # a third of all conversations share their first turns
        for turn in range(rng.randint(1, 7)):
            said = f"common {turn}" if crowd and turn < 3 else rng.choice(["é yes", "no", "perhaps", ""])
            rows.append((conv, turn, ("user", "assistant")[turn % 2], said))
    rows = [r for r in rows if r[0] not in (10, 15)]  # absent bases
    got = T.trie(T.entries(T.rebuilt(T.paths(frame(spark, rows)))), limit)
    assert found(got) == brute(rebuild(conversations(rows)))


def test_special_cases(spark):
    rows = [
        (1, None, None, "first"),
        (1, 2, "user", None),
        (1, 2, "user", None),
        (2, 0, None, "first"),
        (3, 0, "a", "b"),
        (3, 0, "a", "a"),
        (4, 0, "", "first"),
        (None, 0, "user", "lost"),
        (-7, 1, "ab", "c"),
        (-8, 1, "a", "bc"),
        (1 << 40, 1, "a", "bc"),
    ]
    for limit in (4096, 1):
        assert found(T.prefix_trie(frame(spark, rows), limit)) == brute(conversations(rows))
    assert T.prefix_trie(frame(spark, [])).collect() == []


def test_copies_and_long_chains(spark):
    # one conversation of 300 turns, 500 times, and one that leaves it at the end
    chain = [(0, t, "user", f"turn {t}") for t in range(300)]
    rows = [(c * 1000, *r[1:]) for c in range(500) for r in chain[:3]] + chain[3:]
    rows += [(7, *r[1:]) for r in chain[:299]] + [(7, 299, "user", "else")]
    for limit in (4096, 1):
        assert found(T.prefix_trie(frame(spark, rows), limit)) == brute(conversations(rows))


def test_turnless_conversations_end_at_the_root(spark):
    # conversations of one turn, on bases that are absent: all that h > 0 takes leaves none
    rows = [(c, 0, "user", f"t{c}") for c in range(1, 40) if c % 5]
    want = brute(rebuild(conversations(rows)))
    got = found(T.trie(T.entries(T.rebuilt(T.paths(frame(spark, rows))))))
    assert got == want
    (root,) = [r for r in got if r[1] == 0]
    assert root[3] == 32 and root[7] != hashlib.sha256(b"").hexdigest()


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_prefix_trie(spark, folder)) == brute(rebuild(conversations(rows)))
