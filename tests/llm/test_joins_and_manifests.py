"""Jaccard joins, Merkle manifests and conversation repair against plain versions, and their odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenarium.llm import conversations, jaccard, merkle
from scenarium.llm.conversations import hirschberg, moves, repair
from scenarium.llm.jaccard import jaccard_groups, overlaps
from scenarium.llm.merkle import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long, node string, root string, digest long, n long, c string, block long"


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- n-gram Jaccard join ---


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


def corpus(rng, base=30, copies=12, words=60):
    texts, common = [], [" ".join(f"c{rng.randrange(200)}" for _ in range(12)) for _ in range(5)]
    for b in range(base):
        text = [f"w{b}x{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(1 + b % copies):
            own = list(text)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(own) + rng.choice(("", " " + rng.choice(common))))
    texts += [" ".join(rng.sample(common, 3)) for _ in range(30)] + ["One two", "one  TWO", "two one", "a", "", " \t", "a b c d e", "a b c d"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("few", [256, 4])
def test_jaccard_groups_match_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = corpus(random.Random(few))
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == plain_groups(rows)


def test_a_large_group_of_near_copies(spark):
    """More documents under an n-gram than are listed: links between those that aren't near the central one come from blocks."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(330):
        own = list(base)
        for at in rng.sample(range(60), rng.choice((0, 1, 2))):
            own[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted(map(tuple, got)) == plain_groups(rows)


def test_blocked_products_count_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, 3000)).astype(np.uint64) for _ in range(14)]
    left, right = sets[:6], sets[6:]
    want = np.array([[len(np.intersect1d(a, b)) for b in right] for a in left])
    assert (overlaps(left, right, np.zeros((6, 8), np.int64)) == want).all()
    least = np.full((6, 8), 720)
    got = overlaps(left, right, least)
    assert ((got >= least) == (want >= least)).all() and (got[want >= 720] == want[want >= 720]).all()


def test_jaccard_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x y"), (3, "x y"), (None, "X  y"), (None, None), (7, "lorem ipsum " * 30_000), (8, "lorem ipsum " * 30_000), (9, "é 漢字")]
    frame = spark.createDataFrame([(i, t, *[None] * 11) for i, t in rows], DOCS)
    got = sorted(map(tuple, jaccard_groups(frame).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 1, 3), (None, 0, None), (7, 2, 7), (8, 2, 7), (9, 1, 9)]
    assert got == sorted(want, key=str)
    assert jaccard_groups(frame.limit(0)).collect() == []


# --- Merkle manifest ---


def plain_manifest(rows, tampered, fanout):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = nodes[i // fanout * fanout : i // fanout * fanout + fanout]
                paths[k].append((run[: i % fanout], run[i % fanout + 1 :]))
            nodes = [hexed("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
            at = [i // fanout for i in at]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, hexed("".join(map(field, (r[0], r[3], r[2], r[4], r[1]))))))
        leaves = [hexed("".join(map(field, (r[0], r[3], r[2], r[4], r[1])))) for r in own]
        groups[lang] = own, leaves, *tree(leaves)
    root, over = tree([groups[x][2] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        own, leaves, subroot, paths = groups[lang]
        for r, leaf, path in zip(own, leaves, paths, strict=True):
            path = path + over[k]
            node = leaf
            if tampered(r) and r[4] is not None:
                node = hexed("".join(map(field, (r[0], r[3], r[2], r[4] + 1, r[1]))))
            for left, right in path:
                node = hexed("".join([*left, node, *right]))
            proof = hexed("".join("".join(a) + "".join(b) for a, b in path))
            out.append((r[0], leaf, subroot, root, proof, node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "tile"), [(2, 256), (2, 4), (3, 9)])
def test_manifest_matches_a_plain_tree(spark, monkeypatch, fanout, tile):
    monkeypatch.setattr(merkle, "TILE", tile)
    rng = random.Random(fanout + tile)
    rows = [(i, rng.choice(("é 漢", "text", "", None)), rng.choice(("en",) * 9 + ("de", "", None, "Z")), rng.choice(("web", None)), rng.choice((5, None, 12))) for i in range(150)]
    rows += [rows[3], rows[3], (None, "t", "en", None, None), (None, None, None, None, None), (900, "alone", "xx", "s", 1)]
    frame = spark.createDataFrame([(*r, *[None] * 8) for r in rows], DOCS).repartition(4)
    got = manifest(frame, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, fanout).collect()
    want = plain_manifest(rows, lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0, fanout)
    assert sorted(map(tuple, got), key=str) == want
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "x" * 300_000, "en", "s", 3, *[None] * 8)], DOCS)
    (row,) = manifest(one, F.lit(False)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == hexed("")
    assert manifest(one.limit(0), F.lit(False)).collect() == []


# --- conversation repair ---


def plain_repair(rows):
    """All ways at once, each state with its cheapest edits as a whole text."""
    out, convs = [], {}
    for c, turn, role, text in rows:
        own = convs.setdefault(c, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hexed(f"{len(r[1].encode())}:{r[1]}{r[2]}")))
        faults, seen = [], set()
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        states = {"": (0, "", [])}  # what is kept so far: nothing, s, u or a
        after = {"": "u", "s": "u", "u": "a", "a": "u"}

        def inserted(states):
            states = dict(states)
            for _ in range(3):
                for s, (cost, audit, kept) in list(states.items()):
                    to = after[s]
                    new = (cost + 3, audit + "I", [*kept, {"u": "user:", "a": "assistant:"}[to]])
                    if to not in states or new[:2] < states[to][:2]:
                        states[to] = new
            return states

        for (_, role, text), fault in zip(own, faults, strict=True):
            new = {}
            for s, (cost, audit, kept) in inserted(states).items():
                ways = [(s, cost + 4, audit + "D", kept)]
                if fault not in ("blank", "duplicate"):
                    late, to = 3 * (fault == "truncated"), after[s]
                    ways.append((to, cost + 3 + late, audit + "R", [*kept, {"u": "user:", "a": "assistant:"}[to] + text]))
                    if role[:1] == "s" and s == "" or role[:1] == to:
                        ways.append((role[:1], cost + late, audit + "K", [*kept, f"{role}:{text}"]))
                for to, *way in ways:
                    if to not in new or tuple(way[:2]) < new[to][:2]:
                        new[to] = tuple(way)
            states = new
        cost, audit, kept = min((v for s, v in inserted(states).items() if s in ("", "a")), key=lambda v: v[:2])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own[:-1], own[1:], strict=True)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hexed("\n".join(kept))))
    return sorted(out, key=str)


def talks(rng, n, most):
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(1, most)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(("user", "assistant")) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = rng.choice(("system", "tool", "", None, "su")) if rng.random() < 0.12 else role
            text = rng.choice(("", " \n", None, "same.", "same.", "no end")) if rng.random() < 0.3 else f"t{rng.randrange(40)}{rng.choice(('.', '!', '? ', ''))}"
            rows.append((c if c else None, None if rng.random() < 0.05 else turn, role, text))
    return rows + rng.sample(rows, len(rows) // 10)


@pytest.mark.parametrize(("block", "fan", "most"), [(4096, 256, 12), (4, 2, 60)])
def test_repair_matches_all_ways(spark, monkeypatch, block, fan, most):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "FAN", fan)
    rows = talks(random.Random(block), 120, most)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, n long, edits string, block long").repartition(3)
    assert sorted(map(tuple, repair(frame).collect()), key=str) == plain_repair(rows)


def test_hirschberg_equals_a_whole_table():
    rng = random.Random(1)
    for _ in range(300):
        rows = [moves(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(1, 14))]
        ways = {0: (0, ())}
        for row in rows:
            new = {}
            for s, (cost, edits) in ways.items():
                for extra, e, to in row[s]:
                    way = (cost + extra, (*edits, e))
                    if to not in new or (way[0], "".join(way[1])) < (new[to][0], "".join(new[to][1])):
                        new[to] = way
            ways = new
        for end, (_, edits) in ways.items():
            assert hirschberg(rows, 0, end) == list(edits)


def test_repair_of_odd_conversations(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    twice = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    schema = "conv_id long, turn long, role string, text string"
    rows = [(gone, 0, "user", "hello."), *[(twice, 0, "user", "x" * 200_000 + ".")] * 3, (None, None, None, None)]
    got = {r["conv_id"]: tuple(r)[1:] for r in repair(spark.createDataFrame(rows, schema)).collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hexed(""))
    assert got[twice] == (0, 0, 2, 0, 2, 8 + 3, "KDDI", hexed("user:" + "x" * 200_000 + ".\nassistant:"))
    assert got[None] == plain_repair(rows[-1:])[0][1:]
    assert repair(spark.createDataFrame([], schema)).collect() == []
