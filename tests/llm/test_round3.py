"""Embedding near-duplicates, conversation repair and the Merkle manifest against brute force."""

import hashlib
import heapq
import math
import zlib

import numpy as np
import pytest


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, rep string")


def brute(rows, threshold=0.93):
    ok = lambda r: r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    unit = [np.array(r[1]) / np.linalg.norm(np.array(r[1]) / np.abs(r[1]).max()) / np.abs(r[1]).max() if ok(r) else None for r in rows]
    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if unit[i] is not None and unit[j] is not None and a[2] == b[2] and len(a[1]) == len(b[1]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = r[0] if r[0] is None else min(rows[j][0] for j in seen)
        out.append((r[0], len(links[i]), low, r[0] is not None and r[0] == low))
    return sorted(out, key=str), sum(len(x) for x in links.values())


def clustered(n, dims, seed=5):
    """Random vectors, a fifth of them with a neighbour at a cosine of 0.93 to 0.95."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, n - 1, 5):
        side = rng.normal(size=dims)
        side -= (side @ x[i]) * x[i]
        c = rng.uniform(0.9305, 0.95)
        x[i + 1] = c * x[i] + math.sqrt(1 - c * c) * side / np.linalg.norm(side)
    return [(k, v.tolist(), k % 7 // 4, "x", "y") for k, v in enumerate(x)]


def found(df):
    return sorted([tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()], key=str)


def test_odd_embeddings(spark):
    from geoterra.llm.embedding_dedup import near_duplicates

    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [2.0, 0.1], 1), (4, [2.0, 0.1], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1), (8, [1.0, float("nan")], 1), (9, [1.0, 0.0], None),
        (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1e308, 1e307], 1), (12, [-1.0, 0.0], 1), (13, [-1.0, -0.0], 1), (14, [], 1), (15, [float("inf"), 0.0], 1), (16, [1e-300, 0.0], 1),
    ]
    rows = [(*r, "x", "y") for r in rows]
    assert found(near_duplicates(vectors(spark, rows))) == brute(rows)[0]
    twice = rows + [(1, [0.0, 1.0], 1, "", ""), (2, [2.0, 0.1], 1, "", "")]
    assert found(near_duplicates(vectors(spark, twice))) == brute(twice)[0]
    assert near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_exact_cells(spark):
    """Small cells, split more than once and with blocks of few rows, a dense group among them: with the chord as reach nothing is missed."""
    from geoterra.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(3)
    rows = clustered(400, 8)
    rows += [(1000 + k, (np.ones(8) + rng.normal(size=8) * 0.02).tolist(), 0, "x", "y") for k in range(120)]
    want, links = brute(rows)
    assert links > 120 * 119
    assert found(near_duplicates(vectors(spark, rows), certainty=math.inf, limit=20, fan=4, block=16)) == want


def test_recall(spark):
    """Vectors of no structure with pairs just above the threshold, in 20 cells or so: at least 0.9 of the links are found, none is wrong."""
    from geoterra.llm.embedding_dedup import near_duplicates

    rows = clustered(1500, 64)
    want, links = brute(rows)
    got = found(near_duplicates(vectors(spark, rows), limit=80))
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.9 * links and links > 300


def hexed(*parts):
    return hashlib.sha256("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts).encode()).hexdigest()


def level_up(nodes, fan):
    return [hashlib.sha256("".join(nodes[i : i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]


def brute_tree(nodes, fan):
    """Top, and for each leaf its steps (left, right)."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, a in enumerate(at):
            lo = a // fan * fan
            steps[k].append(("".join(level[lo:a]), "".join(level[a + 1 : lo + fan])))
        level, at = level_up(level, fan), [a // fan for a in at]
    return level[0], steps


@pytest.mark.parametrize(("fan", "block"), [(2, 1024), (2, 4), (3, 9), (5, 5)])
def test_manifest(spark, fan, block):
    from pyspark.sql import functions as F

    from geoterra.llm.merkle_manifest import manifest

    rows = [(k, f"text {k} é", ("en", "de", None, "zz", "é")[0 if k < 60 else k % 4 if k < 75 else 4], "web", k if k % 5 else None) for k in range(77)]
    rows += [(5, "same", "en", "a", 1), (5, "same", "en", "a", 1), (5, "same", "en", "b", 1), (None, None, "en", None, None), (None, "", "en", None, 0), (900, "", "lone", "", 2**63 - 1)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx string")
    leaves = {}
    for i, t, lang, source, n in rows:
        leaves.setdefault(lang, []).append((i is not None, i or 0, hexed(i, source, lang, n, t), hexed(i, source, lang, n if n is None or i is None or zlib.crc32(str(i).encode()) % 7 else n + 1, t)))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: brute_tree([x[2] for x in sorted(leaves[lang])], fan) for lang in langs}
    root, over = brute_tree([trees[x][0] for x in langs], fan)
    want = []
    for lang, steps in zip(langs, over, strict=True):
        for (known, i, leaf, now), path in zip(sorted(leaves[lang]), trees[lang][1], strict=True):
            node = now
            for left, right in path + steps:
                node = hashlib.sha256((left + node + right).encode()).hexdigest()
            proof = hashlib.sha256("".join(a + b for a, b in path + steps).encode()).hexdigest()
            want.append((i if known else None, leaf, trees[lang][0], root, proof, node, now == leaf))
    got = manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, fan=fan, block=block).drop("path")
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want, key=str)
    assert manifest(docs.limit(0), fan=fan).count() == 0
    assert all(r.verified for r in manifest(docs, fan=fan, block=block).collect())


def cheapest(rows):
    """(cost, audit, lines) by Dijkstra over single edits: an independent reading of the rules."""
    heap, done = [(0, "", (), 0, 0)], set()
    grammar = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    while heap:
        cost, audit, lines, at, state = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(lines)
        if (cost, audit, at, state) in done or cost > 2 * len(rows) + 10:
            continue
        done.add((cost, audit, at, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in grammar:
                heapq.heappush(heap, (cost + 5, audit + "I", (*lines, role + ":"), at, grammar[state, role[0]]))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", lines, at + 1, state))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                if (state, role[:1]) in grammar:
                    heapq.heappush(heap, (cost + more, audit + "K", (*lines, f"{role}:{text}"), at + 1, grammar[state, role[:1]]))
                for new in ("user", "assistant"):
                    if (state, new[0]) in grammar:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", (*lines, f"{new}:{text}"), at + 1, grammar[state, new[0]]))
    raise AssertionError


def brute_repair(original):
    space, out = " \t\n\x0b\x0c\r", []
    for conv in {r[0] for r in original}:
        rows = []
        for c, turn, role, text in original:
            role, text = " " if role is None else role, " " if text is None else text
            if c == conv:
                kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
                text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
                rows += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort()
        turns = [r[1] for r in rows if r[0]]
        seen, listed = set(), []
        for _, _, role, text in rows:
            body = text.rstrip(space)
            listed.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        count = lambda f: sum(x[2] == f for x in listed)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(listed, listed[1:], strict=False))
        cost, audit, text = cheapest(listed)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("run", [256, 3, 1])
def test_repair(spark, run):
    from geoterra.llm.conversation_repair import damage, repaired

    rng = np.random.default_rng(11)
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 9))):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "s"])
            rows.append((conv, int(turn + rng.integers(0, 2)), str(role), str(rng.choice(["Yes.", "No", "What?  \n", " \t", "", "Go on!\x0b", "Well. ", "Yes."]))))
    rows += [(70, None, "user", "A."), (70, None, None, "B."), (70, 4, "assistant", None), (None, 1, "user", "Hm."), (None, None, None, None), (None, 2, "assistant", "Ok."), (71, 2**62, "user", "x."), (71, -5, "system", "Be.")]
    rows += [(80, t, ("user", "assistant")[t % 2], f"Turn {t}." + "x" * (t % 3 == 1)) for t in range(23)]
    data = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, key string, idx string")
    got = repaired(data, damage(data), run=run)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_repair(rows)
    assert repaired(data.limit(0), damage(data.limit(0))).count() == 0


def test_repair_of_one_long_conversation(spark):
    """Thousands of turns in many runs: the same answer as in one."""
    from geoterra.llm.conversation_repair import repaired

    rows = [(1, t, "user" if t % 7 else "assistant", f"Say {t % 900}.") for t in range(2000)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repaired(data, data, run=64).collect()] == [tuple(r) for r in repaired(data, data, run=4000).collect()]
