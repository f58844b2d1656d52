"""Cases that were wrong or untested before: bounds beyond 64 bits, pair marginals, training, ranges of files, rules of stopping."""

import itertools

import numpy as np
import pytest


def test_bound_wider_than_scores():
    """The bound is the score of a row that no row need equal: here it is beyond 64 bits while every score fits."""
    from geoterra.llm.threshold_search import Lists

    dims = 1024
    rows = np.zeros((2 * dims + 1, dims), np.int64)
    rows[np.arange(2 * dims), np.arange(2 * dims) // 2] = 2**27
    rows[-1] = 2**23
    query = np.full(dims, int(1.7 * 2**27), np.int64)
    best, _ = Lists(rows, np.arange(len(rows))).top(query, -1, 1)
    assert best == [(1959966552677679104, 2 * dims)]


def test_bound_where_floats_cancel():
    from geoterra.llm.threshold_search import Lists

    rng = np.random.default_rng(2)
    for kind, top in ((np.float32, 2**10), (np.float64, 2**24)):
        rows = rng.integers(-top, top, (400, 6)).astype(kind)
        rows[:, 1] = -rows[:, 0]
        for query in rng.integers(-top, top, (20, 6)).astype(kind):
            query[1] = query[0]
            exact = sorted(((int(sum(int(a) * int(b) for a, b in zip(r, query, strict=True))), i) for i, r in enumerate(rows)), key=lambda x: (-x[0], x[1]))
            assert Lists(rows, np.arange(400)).top(query, -1, 3)[0] == exact[:3]
            assert Lists(rows, np.arange(400)).top(query, -1, 3, floor=exact[1][0])[0][:2] == exact[:2]


def test_pair_marginals():
    """Expected transitions against enumeration, and as the derivative of the partition function."""
    from geoterra.llm.language_crf import forward_backward

    rng = np.random.default_rng(4)
    scores, transitions, first = rng.normal(size=(11, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 5, 5, 11])

    def log_z(t):
        total = 0.0
        for a, b in itertools.pairwise(first):
            if b > a:
                total += np.log(sum(np.exp(scores[np.arange(a, b), list(y)].sum() + sum(t[i, j] for i, j in itertools.pairwise(y))) for y in itertools.product(range(3), repeat=b - a)))
        return total

    p, expected = forward_backward(scores, first, transitions, pairs=True)
    assert np.allclose(p, forward_backward(scores, first, transitions))
    want = np.zeros((3, 3))
    for a, b in itertools.pairwise(first):
        paths = list(itertools.product(range(3), repeat=b - a))
        weight = np.array([np.exp(scores[np.arange(a, b), list(y)].sum() + sum(transitions[i, j] for i, j in itertools.pairwise(y))) for y in paths])
        for y, w in zip(paths, weight / weight.sum(), strict=True):
            for i, j in itertools.pairwise(y):
                want[i, j] += w
    assert np.allclose(expected, want)
    step = 1e-5
    for i, j in itertools.product(range(3), repeat=2):
        moved = transitions.copy()
        moved[i, j] += step
        assert abs((log_z(moved) - log_z(transitions)) / step - expected[i, j]) < 1e-3


def test_code_switched_training():
    """Texts that change their language every fifth word: transitions learn to stay, and words without a feature of their own follow their neighbours."""
    from geoterra.llm.language_crf import train, word_labels

    rng = np.random.default_rng(8)
    own = (["haus", "baum", "licht", "stein"], ["maison", "arbre", "lumiere", "pierre"])
    texts, labels = [], []
    for _ in range(300):
        words, of = [], []
        for part in range(4):
            k = (part + int(rng.integers(2))) % 2
            words += [str(rng.choice([*own[k], "xx"])) for _ in range(5)]
            of += [k] * 5
        texts.append(" ".join(words).encode())
        labels.append(np.array(of))
    weights, transitions = train(texts, labels, 2, bits=12, epochs=6)
    assert transitions[0, 0] > transitions[0, 1] and transitions[1, 1] > transitions[1, 0]
    found = word_labels("haus xx baum licht stein maison arbre xx pierre", (["de", "fr"], weights, transitions))
    assert [x[1] for x in found] == ["de"] * 5 + ["fr"] * 4


def test_machine_learns_as_written_out():
    """The factorisation machine's training against the same steps written row by row with all pairs."""
    from geoterra.llm.quality_fm import STATISTICS, Machine

    rng, k = np.random.default_rng(6), len(STATISTICS)
    rows = [(rng.normal(size=k), np.unique(rng.integers(0, 16, 5)), None) for _ in range(9)]
    rows = [(a, b, rng.random(len(b))) for a, b, _ in rows]
    y = rng.integers(0, 2, 9).astype(float)
    fast, slow = Machine(4, 2), Machine(4, 2)
    fast.learn(rows, y, epochs=2, batch=4)
    stats = np.stack([r[0] for r in rows])
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    w, v, w0 = slow.w, slow.v, 0.0
    sq, sqv, sq0 = np.full(w.shape, 1e-6), np.full(v.shape, 1e-6), 1e-6
    order = np.random.default_rng(13)
    for _ in range(2):
        shuffled = order.permutation(9)
        for low in range(0, 9, 4):
            gw, gv, g0, used, some = np.zeros(w.shape), np.zeros(v.shape), 0.0, set(), shuffled[low : low + 4]
            for j in some:
                x = {16 + i: c for i, c in enumerate(np.clip((rows[j][0] - mean) / scale, -5, 5) / np.sqrt(k))} | dict(zip(rows[j][1].tolist(), rows[j][2].tolist(), strict=True))
                z = w0 + sum(w[i] * c for i, c in x.items()) + sum(v[a] @ v[b] * x[a] * x[b] for a, b in itertools.combinations(x, 2))
                g = (1 / (1 + np.exp(-z)) - y[j]) / len(some)
                g0 += g
                used |= set(x)
                for a in x:
                    gw[a] += g * x[a]
                    gv[a] += g * x[a] * sum((v[b] * x[b] for b in x if b != a), np.zeros(2))
            at = sorted(used)
            gw[at] += 1e-4 * w[at] / 4
            gv[at] += 1e-4 * v[at] / 4
            sq[at] += gw[at] ** 2
            sqv[at] += gv[at] ** 2
            sq0 += g0**2
            w[at] -= 0.1 * gw[at] / np.sqrt(sq[at])
            v[at] -= 0.03 * gv[at] / np.sqrt(sqv[at])
            w0 -= 0.1 * g0 / np.sqrt(sq0)
    assert np.allclose(fast.w, w) and np.allclose(fast.v, v) and abs(fast.w0 - w0) < 1e-9


def test_token_files_by_ranges(spark, tmp_path):
    from geoterra.llm.token_counts import read_token_files, scan

    rng, want = np.random.default_rng(1), {}
    for name, n in (("a", 1000), ("b", 1), ("c", 0), ("d", 96)):
        ids = rng.integers(0, 9, n).astype("<u2")
        ids.tofile(tmp_path / name)
        ends = np.flatnonzero(ids == 0)
        starts = np.append(0, ends + 1)
        want[name] = [(int(s), int(e - s), True) for s, e in zip(starts, ends, strict=False)] + [(int(starts[-1]), n - int(starts[-1]), False)] * int(n > starts[-1])
    blocks = read_token_files(spark, str(tmp_path), block_tokens=8, task_blocks=4)
    assert blocks.filter("stream like '%a'").count() == 125
    got = {}
    for r in scan(blocks, 0).orderBy("doc_no").collect():
        got.setdefault(r.stream[-1], []).append((r.start, r.n_tokens, r.ended))
    assert got == {k: v for k, v in want.items() if v}
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        read_token_files(spark, str(tmp_path)).count()


def test_smallest_id_is_not_null(spark, tmp_path):
    from geoterra.llm.token_counts import op1_token_counts

    spark.createDataFrame([(-(2**63), "one"), (None, "two"), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted([(r.doc_id is None, r.doc_id or 0, r.n_tokens > 0) for r in op1_token_counts(spark, str(tmp_path)).collect()]) == [(False, -(2**63), True), (False, 5, False), (True, 0, True)]


def test_one_item_id_with_many_texts(spark):
    """Blocks of items are dealt by text too, so an id with any number of texts is no block of its own."""
    from geoterra.llm.decontamination import decontaminate

    texts = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(40)]
    bench = spark.createDataFrame([("same", t) for t in texts] + [("same", texts[0])] * 5, "item_id string, text string")
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(texts)] + [(99, "clean text of no item")], "doc_id long, text string")
    found = {r.doc_id: len(r.hit_words) for r in decontaminate(docs, bench, block_bytes=400).collect()}
    assert found == {k: 12 for k in range(40)} | {99: 0}


def test_trust_by_sql(spark, tmp_path):
    """Absolute links in long chains and a cycle: the query and its SQL stop by the same rule."""
    import duckdb

    from geoterra.llm.url_trust import ORACLES, op7_url_trust

    rows = [(0, "http://a.com/en/1", '<a href="http://h0/">'), (1, "http://example.com/en/7", '<a href="//g0/x"> <a href=http://h3/>'), (2, None, None), (3, "no", "")]
    rows += [(10 + k, f"http://h{k}/p", f'<a href="http://h{k + 1}/q"> <a href="http://h{k + 1}/r"> <a href="http://h{max(0, k - 2)}">') for k in range(14)]
    rows += [(40 + k, f"https://g{k}/p?q", f"<a href='https://g{k + 1}/'>" + ("<a href='http://a.com/en/1'>" if k == 13 else "")) for k in range(14)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op7_url_trust(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLES["op7_url_trust"]).fetchall()
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want, key=str)
    assert len({r.verdict for r in got.collect()}) == 2
