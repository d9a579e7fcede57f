"""Operators 11 to 13 against brute force, and on rows of all kinds."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import differencing, dual_tree, oracles, prefix_trie
from tests.llm.test_operators import ODD_ROWS, library_ids


# ---- 11 -------------------------------------------------------------------------------------------------------------
def check_windows(out, texts, capacity):
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for x in out:
        pieces[x["doc_id"]].append((x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]))
        windows[x["sequence_id"]].append((x["offset"], x["length"]))
    total = 0
    for (doc, _), ids in zip(texts, library_ids(t for _, t in texts), strict=True):
        ids, at = ids + [1], 0
        for start, length, crc, whole in sorted(pieces[doc]):
            assert (start, crc, whole) == (at, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()), len(ids)) and length > 0
            at += length
        assert at == len(ids)
        total += at
    sums = []
    for placed in windows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        sums.append(at)
    assert max(sums) <= capacity
    return sums, total


@pytest.mark.parametrize("capacity", [64, 2048])
def test_windows_are_whole_and_even(corpus, corpus_rows, capacity):
    sums, total = check_windows(differencing.pack(corpus, capacity).collect(), [(d, t) for d, t, *_ in corpus_rows], capacity)
    least = -(-total // capacity)
    assert len(sums) <= 1.02 * least + 1 and min(sums) >= 0.8 * total / len(sums)


def test_windows_of_odd_rows(odd, empty):
    out = differencing.pack(odd).collect()
    assert len({(x["sequence_id"], x["offset"]) for x in out}) == len(out) and sum(x["start"] == 0 for x in out) == ODD_ROWS
    assert [x["doc_tokens"] for x in out if x["doc_id"] in (5, 6)] == [1, 1]
    assert differencing.pack(empty).count() == 0


def plain_differencing(sizes, k):
    held = [(-s, n, [s] + [0] * (k - 1)) for n, s in enumerate(sizes)] if k > 1 else [(0, 0, [sum(sizes)])]
    heapq.heapify(held)
    n = len(held)
    while len(held) > 1:
        a, b = heapq.heappop(held)[2], heapq.heappop(held)[2]
        sums = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        n += 1
        heapq.heappush(held, (sums[-1] - sums[0], n, sums))
    return held[0][2]


def test_differencing_equals_the_plain_method():
    r = random.Random(21)
    for _ in range(60):
        k = r.randint(2, 12)
        sizes = r.sample(range(1, 10**r.randint(4, 9)), r.randint(1, 60))  # of different lengths, so that ties don't matter
        found, following = differencing.difference(np.array(sizes), k)
        assert sorted(found.sums.tolist()) == [s for s in sorted(plain_differencing(sizes, k)) if s]
        kept = []
        for piece, total in zip(found.head.tolist(), found.sums.tolist(), strict=True):
            while piece >= 0:
                kept.append(piece)
                total -= sizes[piece]
                piece = int(following[piece])
            assert total == 0
        assert sorted(kept) == list(range(len(sizes)))


# ---- 12 -------------------------------------------------------------------------------------------------------------
EMBEDDINGS = "vec_id long, embedding array<float>, label int, score string, block string, cell string"


def vectors(r, n, width=12):
    rows = []
    for k in range(n):
        v = [r.gauss(0, 0.3) for _ in range(width)] if k % 6 else [0.25] * width  # one frequent vector
        rows.append((k * 5, v, r.choice([0, 0, 0, 1, 2, 9]), "s", "b", "c"))
    return rows


def brute_negatives(rows):
    taken = {}
    for vec_id, v, label, *_ in rows:
        if None in (vec_id, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        taken[vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, whole] = None
    rows, out = list(taken), []
    for anchor, label, v in (x for x in rows if x[0] % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), other, mark) for other, mark, w in rows if (other, mark, w) != (anchor, label, v))
        for p, positive, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(s, other) for s, other, mark in scored if mark != label and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(anchor, positive, rank, other, -p, -s) for rank, (s, other) in enumerate(fits[:5], 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("least", [1024, 16])
def test_negatives_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(dual_tree, "LEAST_BLOCK", least)
    monkeypatch.setattr(dual_tree, "ANCHOR_BLOCK", least // 4)
    rows = vectors(random.Random(31), 900)
    rows += rows[:40]  # repeated rows
    rows += [(100, [0.5] * 12, 3, "s", "b", "c"), (700, [0.1, 0.2], 0, "s", "b", "c"), (None, [0.5] * 12, 0, "s", "b", "c"), (200, None, 0, "s", "b", "c"), (300, [0.5] * 12, None, "s", "b", "c")]
    rows += [(400, [0.5, None] * 6, 0, "s", "b", "c"), (500, [float("nan")] * 12, 0, "s", "b", "c"), (600, [float("inf")] * 12, 0, "s", "b", "c"), (800, [], 0, "s", "b", "c"), (-100, [0.3] * 20, 1, "s", "b", "c")]
    out = dual_tree.mine(spark.createDataFrame(rows, EMBEDDINGS).repartition(5))
    assert out.columns[:6] == COLUMNS
    assert sorted(tuple(x) for x in out.select(COLUMNS).collect()) == brute_negatives(rows)


def test_negatives_of_few_rows(spark):
    assert dual_tree.mine(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    assert dual_tree.mine(spark.createDataFrame([(100, [1.0], 0, "", "", "")], EMBEDDINGS)).count() == 0
    huge = [(100, [3e38] * 4, 0, "", "", ""), (1, [1.0] * 4, 0, "", "", ""), (200, [1e6] * 4, 0, "", "", ""), (2, [0.9] * 4, 1, "", "", "")]
    assert sorted(tuple(x) for x in dual_tree.mine(spark.createDataFrame(huge, EMBEDDINGS)).select(COLUMNS).collect()) == brute_negatives(huge[1:])


def test_trees_prune_and_miss_nothing():
    r = np.random.default_rng(5)
    centres = r.normal(0, 300, (30, 16))
    x = np.floor(centres[r.integers(0, 30, 3000)] + r.normal(0, 15, (3000, 16)))
    a = dual_tree.Tree(np.arange(600) + 5000, np.zeros(600, np.int64), x[:600] + 1, 8)
    c = dual_tree.Tree(np.arange(3000), np.zeros(3000, np.int64), x, 32)
    search = dual_tree.Search(a, np.full((600, 1), -(1 << 62)), np.full((600, 1), 1 << 62), True, 5)
    scored = []
    score = search.score
    search.score = lambda *w: (scored.append((w[1] - w[0]) * (w[4] - w[3])), score(*w))
    search.run(c)
    every = a.x @ c.x.T
    for row in range(600):
        order = np.lexsort((c.ids, -every[row]))[:5]
        assert search.found[row, 0].tolist() == c.ids[order].tolist() and search.scores[row, 0].tolist() == every[row, order].astype(int).tolist()
    assert sum(scored) < 0.3 * 600 * 3000


# ---- 13 -------------------------------------------------------------------------------------------------------------
TURNS = "conv_id long, turn long, role string, text string, depth string, n string, leaf string"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {conv: [x[2:] for x in sorted(turns)] for conv, turns in own.items()}
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        built[conv] = own.get(conv - int(math.fmod(conv, 20)), [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children, leaves, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for path, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(convs) - 1) * words
            leaves[path[:d]] += not children[path]
    return sorted(
        (min(convs), len(path), min(members[path[:-1]]) if path else -1, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path)).encode()).hexdigest())
        for path, convs in members.items()
    )


def conversations(r):
    rows = []
    for conv in [*range(150), *range(203, 219), -3, -20]:
        path = []
        for turn in range(r.randint(1, 9)):
            path.append(f"turn {r.randint(0, 2)}\t\x0b of {turn}")
            rows.append((conv, turn, "user" if turn % 2 else "assistant", path[-1], "d", "n", "l"))
    long = [(401, k, "user", f"line {k // 7}", "d", "n", "l") for k in range(150)]
    rows += long + [(402, *x[1:]) for x in long] + [(403, *x[1:]) for x in long[:131]] + [(404, *x[1:]) for x in long[:128]]
    rows += [(421, 0, "user", "only one turn", "d", "n", "l"), (None, 0, "user", "no id", "d", "n", "l"), (7, None, None, "null turn", "d", "n", "l"), (8, 3, "user", None, "d", "n", "l"), (9, 1, None, None, "d", "n", "l")]
    rows += [(10, 2, "user", "the same", "d", "n", "l")] * 2 + [(11, 4, "", " \n ", "d", "n", "l"), (12, 4, "user", "x " * 50_000, "d", "n", "l")]
    return rows


@pytest.mark.parametrize(("segment", "parts"), [(64, 4), (3, 13)])
def test_trie_equals_brute_force(spark, monkeypatch, segment, parts):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "SEGMENTS_TOGETHER", 4)
    rows = conversations(random.Random(41))
    kept, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # partitions stay many
    try:
        out = prefix_trie.nodes(spark.createDataFrame(rows, TURNS).repartition(6)).na.fill(-1, ["parent_conv_id"])
        assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(tuple(x) for x in out.collect()) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_trie_of_few_rows(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], TURNS)).count() == 0
    for rows in ([(21, 0, "user", "all of it is dropped", "", "", "")], [(20, 0, "user", "a b", "", "", "")]):
        out = prefix_trie.nodes(spark.createDataFrame(rows, TURNS)).na.fill(-1, ["parent_conv_id"])
        assert sorted(tuple(x) for x in out.collect()) == brute_trie(rows)


def test_sql_equals_brute_force():
    r = random.Random(51)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows, turns = [x[:3] for x in vectors(r, 300)], [x[:4] for x in conversations(r)]
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    assert sorted(con.execute(oracles.HARD_NEGATIVES).fetchall()) == brute_negatives(rows)
    assert sorted(tuple(-1 if v is None else v for v in x) for x in con.execute(oracles.PREFIX_TRIE).fetchall()) == brute_trie(turns)
