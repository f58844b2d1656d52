"""The pipeline's stages against brute force, and the odd rows of each operator: repeated and null ids, empty tables, other columns of the same names."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

RNG = np.random.default_rng(23)
WORDS = ["".join(RNG.choice(["ka", "lo", "mi", "ré", "tu", "sen"], RNG.integers(1, 5))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


PASSAGE = prose(40)
COPY = prose(60)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, row int, n_removed int, h string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [COPY, COPY + " end", prose(50) + " " + PASSAGE, prose(30) + " " + PASSAGE + " " + prose(9), PASSAGE, prose(80), None, "", "12 34 !?", "one two", prose(3000)]
    rows = [(i, t, "xx", f"s{i % 2}", None if t is None else len(t), "a", i, 7, "h") for i, t in enumerate(texts)]
    rows += [(5, prose(40), "xx", "s1", 5, "b", 1, 7, "h"), (None, COPY, "xx", None, 5, "c", 2, 7, "h"), (None, prose(25), None, "s0", 5, "d", 3, 7, "h"), (9, "one two", "xx", "s1", 7, "e", 4, 7, "h")]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([("b", PASSAGE), (None, COPY), ("c", None)], "item_id string, text string").write.parquet(base + "/benchmark.parquet")
    return base


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def ordered(df):
    """Rows in the order by which stages number them: nulls first, then doc_id; equal ids in any order."""
    return sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def test_language_stage(spark, docs):
    from corpus_pipeline import language

    out = language(spark, docs, "")
    assert out.columns == docs.columns
    kept = {r.shard + str(r.row) for r in out.collect()}
    assert {r.shard + str(r.row) for r in docs.collect()} - kept == {"a6", "a7", "a8"}


def test_near_copies_stage(spark, docs):
    from corpus_pipeline import near_copies

    def shingles(t):
        w = lower(t).split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    out = near_copies(spark, docs, "")
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    rows = ordered(docs)
    groups = []
    for r in rows:
        s = shingles(r.text)
        mine = [g for g in groups if any(linked(s, x) for _, x in g)]
        groups = [g for g in groups if g not in mine] + [sum(mine, []) + [(r, s)]]
    assert len(left) == len(groups) and all(sum((r.doc_id, r.text) in left for r, _ in g) >= 1 for g in groups)


def test_passages_stage(spark, docs):
    from corpus_pipeline import passages

    out = passages(spark, docs, "")
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = {r.shard + str(r.row): r for r in out.collect()}
    held = {r.shard + str(r.row): r for r in docs.collect()}
    distinct = [r for r in held.values() if r.text and r.text.encode().count(PASSAGE.encode()) and r.doc_id is not None]
    assert len(distinct) == 3 and "a4" not in got and PASSAGE in got["a2"].text
    assert PASSAGE not in got["a3"].text and got["a3"].n_chars == len(got["a3"].text) < held["a3"].n_chars
    for k in ("a5", "a6", "a7", "a10", "d3"):
        assert got[k] == held[k]
    seen = set()
    for r in out.collect():
        b = (r.text or "").encode()
        mine = {b[k : k + 50] for k in range(len(b) - 49)}
        assert not mine & seen
        seen |= mine


def test_benchmark_stage(spark, docs, folder):
    from corpus_pipeline import benchmark

    out = benchmark(spark, docs, folder)
    assert out.columns == docs.columns
    assert {r.shard + str(r.row) for r in docs.collect()} - {r.shard + str(r.row) for r in out.collect()} == {"a2", "a3", "a4"}


def test_stages_on_empty_tables_and_run(spark, docs, folder, tmp_path):
    from corpus_pipeline import STAGES, run

    for _, stage in STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in out) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in out}.values())


def test_forward_backward_equals_all_paths():
    from geoterra.llm.language_crf import forward_backward

    scores, transitions = RNG.normal(0, 2, (9, 3)), RNG.normal(0, 1, (3, 3))
    first = np.array([0, 4, 4, 5, 9])
    got = forward_backward(scores.copy(), first, transitions)
    for a, b in zip(first[:-1], first[1:], strict=True):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            weight = np.exp(sum(scores[a + i, y] for i, y in enumerate(path)) + sum(transitions[x, y] for x, y in itertools.pairwise(path)))
            for i, y in enumerate(path):
                want[i, y] += weight
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True) if b > a else want)


def test_language_letters_bytes_and_repeated_rows(spark):
    from geoterra.llm.language_crf import fit, identify

    rows = [(i, " ".join(RNG.choice(["the", "and", "this"] if i % 2 else ["der", "und", "nicht"], 20)), "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df)
    odd = [(1, "½ ² Ⅷ ٣"), (2, "ªb"), (3, "the and"), (3, "the and"), (None, "der"), (4, "ß")]
    got = sorted(((r.doc_id, r.lang_pred) for r in identify(spark.createDataFrame(odd, "doc_id long, text string").withColumn("lang_pred", F.lit("zz")), model).collect()), key=repr)
    assert (1, "und") in got and got.count((3, "en")) == 2 and (None, "de") in got and len(got) == 6 and all(x[1] != "und" for x in got if x[0] != 1)
    assert fit(df, sample_bytes=1)[0] == ["de", "en"]
    assert identify(df.limit(0), model).count() == 0


def test_trust_equals_iterated_pagerank(spark):
    from geoterra.llm.url_trust import judge

    hosts = [f"h{i}.info" for i in range(12)] + ["bad.org", "good.net", "b.com"]
    rows = []
    for i, h in enumerate(hosts):
        links = "".join(f"<a href='https://{RNG.choice(hosts).upper()}/x'>" for _ in range(int(RNG.integers(0, 5))))
        rows += [(i, f"http://{h}/{'es' if h == 'bad.org' else 'de' if h == 'good.net' else 'fr'}/1", links, "x")] * (1 + i % 2)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    judged = judge(df, tolerance=1e-4).checkpoint()
    got = {r.host: r for r in judged.collect()}
    at = {h: i for i, h in enumerate(hosts)}
    count = np.zeros((len(hosts), len(hosts)))
    for _, url, html, _ in rows:
        for part in html.split("https://")[1:]:
            a, b = url.split("/")[2], part.split("/")[0].lower()
            count[at[a], at[b]] += a != b
    for kind, seed, m in (("trust", "good.net", count), ("distrust", "bad.org", count.T)):
        share = m / np.maximum(m.sum(1, keepdims=True), 1)
        own = np.zeros(len(hosts))
        own[at[seed]] = 1
        x = own * 0.15
        for _ in range(400):
            x = own * 0.15 + 0.85 * x @ share
        for h in hosts:
            assert getattr(got[h], kind) == pytest.approx(x[at[h]], rel=2e-3, abs=1e-12)
            if h not in ("bad.org", "good.net"):
                assert got[h].verdict == ("block" if got[h].distrust > got[h].trust else "allow")
    assert judge(df.limit(0)).count() == 0 and judged.count() == len(rows)


def test_quality_on_odd_tables(spark):
    from geoterra.llm.quality_fm import fit, quality

    rows = [(i, prose(30) if i % 2 else "BUY!! | " * 20, 5) for i in range(80)] + [(7, None, 5), (7, "", 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(7, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality(df, fit(df, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 == 2 and i != 7]
    score = {r.doc_id: r.score for r in out}
    assert all((score[i] >= 0.5) == bool(i % 2) for i in held)
    assert quality(df.limit(0), fit(df, labels)).count() == 0


def test_repeated_ids_in_joins(spark):
    from geoterra.llm.context_tree import score
    from geoterra.llm.decontamination import decontaminate
    from geoterra.llm.jaccard_join import jaccard_components
    from geoterra.llm.suffix_dedup import remove_repeats

    df = spark.createDataFrame([(3, COPY), (3, COPY), (4, COPY), (3, PASSAGE), (5, None)], "doc_id long, text string").withColumn("shard", F.lit("s"))
    found = sorted((r.doc_id, r.component_id, r.n_shingles) for r in jaccard_components(df).collect())
    assert found == [(3, 3, 36), (3, 3, 56), (3, 3, 56), (4, 3, 56), (5, 5, 0)]
    assert sorted((r.doc_id, r.n_removed > 0) for r in remove_repeats(df).collect()) == [(3, False), (3, False), (3, False), (4, True), (5, False)]
    assert score(df).count() == 5
    assert sorted((r.doc_id, len(r.hit_words)) for r in decontaminate(df, spark.createDataFrame([("i", PASSAGE), ("i", PASSAGE)], "item_id string, text string")).collect()) == [(3, 0), (3, 0), (3, 40), (4, 0), (5, 0)]
