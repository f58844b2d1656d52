"""Each operator against a brute-force version on a small fixture that also holds the odd rows: nulls, empty and long texts, ties, repeats, other columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

RNG = np.random.default_rng(5)
SYLLABLES = ["ka", "lo", "mi", "ré", "tu", "sen", "dor", "vi", "ñu", "pa"]
WORDS = ["".join(RNG.choice(SYLLABLES, RNG.integers(1, 4))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


BASE = prose(120)
PASSAGE = prose(30)
TEXTS = [BASE, BASE, BASE.upper(), BASE + " " + prose(4), prose(60) + " " + PASSAGE + " " + prose(50), PASSAGE, prose(9) + " " + PASSAGE, "", "   ", "one two", "one  Two", "ab\0cd", "12 34!", prose(6000), "x" * 300, "x" * 120, *[prose(int(k)) for k in RNG.integers(1, 90, 12)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 3}", len(t), "other") for i, t in enumerate(TEXTS)]
    rows += [(100, None, None, None, None, None), (None, BASE, "en", "s1", 3, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string").repartition(3)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def split(s):
    return [w.decode() for w in lower(s).encode().translate(bytes(32 if 9 <= b <= 13 else b for b in range(256))).split(b" ") if w]


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def known(docs):
    return [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]


def test_jaccard(docs):
    from geoterra.llm.jaccard_join import jaccard_components

    sets = {}
    for i, t in known(docs):
        w = split(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = min(label[i], label[j])
    for fan in (1024, 1):
        got = by_id(jaccard_components(docs, block_shingles=60, fan=fan))
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), label[i]) for i, s in sets.items()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("spread", "fan"), [(20_000, 1024), (1, 1), (20_000, 2)])
def test_repeats(docs, spread, fan):
    from geoterra.llm.suffix_dedup import remove_repeats

    seen, want = {}, {}
    for i, t in sorted(known(docs)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        mine = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, w in enumerate(mine):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        for w in mine:
            seen.setdefault(w, i)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), sum(1 for p in bytes(gone).split(b"\0") if p), hashlib.sha256(kept).hexdigest())
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for i, r in by_id(remove_repeats(docs, spread=spread, fan=fan)).items()}
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_maximal_repeats():
    from geoterra.llm.suffix_dedup import maximal_repeats, suffix_array

    parts = [b"zabcabcq", b"yabcabcr", b"abcabc"]
    text = np.frombuffer(b"".join(parts), np.uint8)
    rest = np.concatenate([np.arange(len(p), 0, -1) for p in parts])
    start = np.concatenate([np.arange(len(p)) == 0 for p in parts])
    sa, lcp = suffix_array(text, rest, 3)
    left = np.where(start[sa], -1, text[np.maximum(sa - 1, 0)].astype(int))
    found = {(bytes(text[sa[lo] : sa[lo] + n]), hi - lo + 1) for n, lo, hi in maximal_repeats(lcp, left, 3)}
    assert found == {(b"abcabc", 3), (b"abc", 6)}


def test_decontamination(spark, docs):
    from geoterra.llm.decontamination import decontaminate, words

    items = [("b2", PASSAGE), ("b2", PASSAGE), (None, PASSAGE), ("long", prose(200) + " " + BASE), ("a1", "one two"), ("c", None), ("d", " ".join(TEXTS[13].split()[500:530])), ("e", "")]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1))
    want = {}
    for i, t in known(docs):
        w, hit, of = words((t or "").encode()), set(), set()
        for name, text in [x for x in items if x[0]]:
            x = words((text or "").encode())
            for k in range(max(1, len(x) - 9) if x else 0):
                y = x[k : k + 10]
                for p in range(len(w) - len(y) + 1):
                    if w[p : p + len(y)] == y:
                        hit.update(range(p, p + len(y)))
                        of.add(name)
        want[i] = (len(w), sorted(hit), sorted(of))
    for block in (8 << 20, 40):
        assert {i: (r.n_words, list(r.hit_words), list(r["items"])) for i, r in by_id(decontaminate(docs, bench, block_bytes=block)).items()} == want
    assert all(not r.hit_words for r in decontaminate(docs, bench.limit(0)).collect())


def test_packing_round_trip(docs):
    from geoterra.llm.packing import pack
    from geoterra.llm.tokens import default_vocabulary, encode

    rows = pack(docs, window=2048).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in known(docs):
        ids = np.append(encode(t, default_vocabulary()), 0).astype("<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 1024
    weighted = pack(docs, weights={"s0": 3.0, "s1": 1.0}).agg(F.sum("length")).first()[0]
    assert weighted == sum(r.length for r in rows)


def test_token_scan(spark, docs, tmp_path):
    from geoterra.llm.token_counts import read_token_files, scan, write_token_stream
    from geoterra.llm.tokens import default_vocabulary, encode

    blocks = write_token_stream(docs, 50256, block_tokens=64)
    got = sorted(r.n_tokens for r in scan(blocks, 50256).collect())
    assert got == sorted(len(encode(r.text, default_vocabulary())) for r in docs.collect())
    np.array([5, 6, 0, 0, 7, 8, 9], "<u2").tofile(tmp_path / "a.bin")
    rows = scan(read_token_files(spark, str(tmp_path), block_tokens=2), 0).orderBy("doc_no").collect()
    assert [(r.start, r.n_tokens, r.ended) for r in rows] == [(0, 2, True), (3, 0, True), (4, 3, False)]


def test_context_tree(docs):
    from geoterra.llm.context_tree import score, trains

    depth, nodes = 2, defaultdict(lambda: [0, 0])
    texts = {r.doc_id: lower(r.text).encode() for r in docs.collect()}
    path = lambda b, i: (b"\0" * depth + b)[i : i + depth]
    for i, b in texts.items():
        if trains(i):
            for k, byte in enumerate(b + b"\0"):
                c = path(b, k)
                for j in range(8):
                    for d in range(depth + 1):
                        nodes[c[depth - d :], (1 << j) | byte >> (8 - j)][byte >> (7 - j) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)
    below = defaultdict(float)
    share = {}
    for d in range(depth, -1, -1):
        for (c, n), (a, b) in list(nodes.items()):
            if len(c) == d:
                own, s = kt(a, b), below[c, n]
                w = own if d == depth else np.logaddexp(own, s) - math.log(2)
                share[c, n] = 1.0 if d == depth else 1 / (1 + math.exp(min(700, s - own)))
                if d:
                    below[c[1:], n] += w
    got = by_id(score(docs, depth=depth))
    for i, r in by_id(score(docs, depth=depth, fan=1)).items():
        assert tuple(r) == pytest.approx(tuple(got[i]))
    for i, b in texts.items():
        if i is None:
            continue
        total = 0.0
        for k, byte in enumerate(b + b"\0"):
            c = path(b, k)
            for j in range(8):
                n, p = (1 << j) | byte >> (8 - j), 0.5
                for d in range(depth, -1, -1):
                    x = c[depth - d :], n
                    if x in share:
                        p = share[x] * (nodes[x][1] + 0.5) / (sum(nodes[x]) + 1) + (1 - share[x]) * p
                    else:
                        p = 0.5
                total += math.log10(p if byte >> (7 - j) & 1 else 1 - p)
        assert got[i].score == pytest.approx(total, rel=1e-5) and got[i].bits_per_byte == pytest.approx(-total * math.log2(10) / (len(b) + 1), rel=1e-5)
    train = Counter(w for i, b in texts.items() if trains(i) for w in [*split(b.decode()), None])
    n, v = sum(train.values()), len(train)
    for i, r in got.items():
        w = [*split(texts[i].decode()), None]
        assert r.train_tokens == n and r.n_tokens == len(w) and r.base_score == pytest.approx(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))


def test_threshold_search(spark):
    from geoterra.llm.threshold_search import top_products

    v = RNG.normal(0, 0.3, (230, 7)).round(2)
    v[50:60] = v[40]
    rows = [(i, [float(x) for x in a], "x") for i, a in enumerate(v)] + [(500, None, "x"), (501, [float("nan")] * 7, "x"), (502, [1.0], "x"), (503, [float("inf")] * 7, "x"), (None, [1.0] * 7, "x"), (60, [0.0] * 7, "x"), (504, [None] * 7, "x"), (20, [float(x) for x in v[20]], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    whole = [(i, np.floor(1024 * np.pad(np.array(a, float), (0, 7 - len(a)))).astype(int)) for i, a, _ in rows if i is not None and a and None not in a and np.isfinite(a).all()]
    got = defaultdict(list)
    for r in top_products(df, df.filter("vec_id % 20 = 0 and vec_id <> 60"), block=50, query_block=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    wanted = {i: a for i, a in whole if i % 20 == 0 and i != 60}
    assert got == {q: sorted(((i, int(a @ b)) for i, a in whole if i != q), key=lambda x: (-x[1], x[0]))[:10] for q, b in wanted.items()}
    assert top_products(df.limit(0), df.limit(0)).count() == 0
    assert {r.score for r in top_products(df, df.filter("vec_id = 60").filter("embedding[0] = 0")).collect()} == {0}
    for size in (1e2, 1e5):
        big = spark.createDataFrame([(i, [size * i, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
        assert top_products(big, big.filter("vec_id = 2")).first().score == int(1024 * size) ** 2 * 6 + 1024 * 1024
    with pytest.raises(ValueError, match="too large"):
        top_products(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"), big)


def test_threshold_search_stops_at_the_bound(spark):
    """On skewed vectors few rows are scored; on even ones of many dimensions most are."""
    from geoterra.llm.threshold_search import Lists, top_products

    n = 4000
    scale = np.array([1.0, 0.3, 0.1, 0.03, 0.01, 0.003])
    for spread, most in ((scale, 0.25), (np.ones(24), 1.0)):
        v = np.floor(1024 * RNG.normal(0, 1, (n, len(spread))) * spread)
        lists = Lists(v, np.arange(n))
        shares = []
        for q in range(0, 200, 10):
            best, scored = lists.top(v[q], q, 10)
            s = (v @ v[q]).astype(int)
            assert best == sorted(((int(s[i]), i) for i in range(n) if i != q), key=lambda x: (-x[0], x[1]))[:10]
            shares.append(scored / n)
        assert np.mean(shares) <= most
    rows = [(i, [float(x) / 1024 for x in r]) for i, r in enumerate(np.floor(1024 * RNG.normal(0, 1, (n, 6)) * scale))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert max(r.scored for r in top_products(df, df.filter("vec_id % 400 = 0"), block=1000, counted=True).collect()) < n / 2


def test_url_trust(spark):
    from geoterra.llm.url_trust import judge

    rows = [(1, "http://A.example.com/en/1?x", None), (2, "https://b.net/de/1", '<a href="http://c.org/x">'), (3, "http://c.org/fr", ""), (4, None, "x"), (5, "no scheme", None), (6, "http://d.org/fr", "<a HREF='//a.example.com/en'>"), (7, "http://x.example.com/en/7#f", None), (8, "http://m.example.net/de/81", None), (9, "http://notcom/en/", None)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.com", "/en/1", "com/en/", "block") and got[2] == ("b.net", "/de/1", "net/de/", "allow")
    assert got[3] == ("c.org", "/fr", None, "allow") and got[6] == ("d.org", "/fr", None, "block")
    assert got[4] == got[5] == ("", "", None, "allow") and got[9][2] is None
    assert got[7][2:] == ("example.com/en/7", "allow") and got[8][2:] == ("example.net/de/8", "block")


def test_language(spark, docs):
    from geoterra.llm.language_crf import fit, identify, word_labels

    a, b = ["the", "and", "there", "other", "this"], ["der", "und", "nicht", "schon", "über"]
    rows = [(i, " ".join(RNG.choice(a if i % 2 else b, 40)), "en" if i % 2 else "de") for i in range(80)]
    rows += [(90, None, None), (91, "", "en"), (92, "12 !?", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df)
    got = by_id(identify(df, model))
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i < 80) and all(got[i].lang_pred == "und" for i in (90, 91, 92))
    labels = [x[1] for x in word_labels("the and there other this der und nicht schon über nicht", model)]
    assert labels == ["en"] * 5 + ["de"] * 6
    assert all(r.lang_pred == "und" for r in identify(docs, fit(df.limit(0))).collect())


def test_quality(spark, docs):
    from geoterra.llm.quality_fm import Machine, fit, quality

    rows = [(i, prose(50) if i % 2 else "BUY!! | " * 30) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    machine = fit(df, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"))
    got = by_id(quality(df, machine))
    assert all((got[i].score >= 0.7) == bool(i % 2) for i in got)
    assert all(0 <= r.score <= 1 for r in quality(docs, machine).collect())
    assert all(r.score == 0.5 for r in quality(docs, fit(df, spark.createDataFrame([], "doc_id long, quality int"))).collect())
    m = Machine(4, 3)
    i, x = np.array([0, 3, 5]), np.array([1.0, 2.0, -1.0])
    pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert m.margin(i, x, np.array([0]))[0][0] == pytest.approx(m.w[i] @ x + pairs)


def test_empty_tables(docs):
    from geoterra.llm.context_tree import score
    from geoterra.llm.jaccard_join import jaccard_components
    from geoterra.llm.packing import pack
    from geoterra.llm.suffix_dedup import remove_repeats

    for f in (score, jaccard_components, remove_repeats, pack):
        assert f(docs.limit(0)).count() == 0


def test_kept_text_loses_cut_characters(spark):
    from geoterra.llm.suffix_dedup import remove_repeats

    passage = "".join(chr(48 + i) for i in range(60))
    docs = spark.createDataFrame([(1, "é" + passage), (2, "xũ" + passage), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in remove_repeats(docs, as_text=True).collect()} == {1: "é" + passage, 2: "x", 3: ""}
