"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest

RNG = np.random.default_rng(11)
TONGUES = {
    "en": ["the", "and", "there", "other", "which", "would"], "de": ["der", "und", "nicht", "schon", "über", "zwischen"],
    "fr": ["les", "nous", "était", "quelque", "jamais", "aujourd"], "es": ["los", "pero", "mañana", "también", "hacia", "quizás"],
}


def spoken(lang, n):
    return " ".join(RNG.choice(TONGUES[lang], n))


def test_language_stage_keeps_mixed_texts(spark):
    from corpus_pipeline import language
    from geoterra.llm.language_crf import fit, identify

    rows = [(i, spoken(x, 40), x) for i, x in enumerate(list(TONGUES) * 30)]
    rows += [(1000, " ".join(spoken(x, 30) for x in TONGUES), None), (1001, " ".join(spoken(x, 30) for x in ("en", "fr", "es")), None), (1002, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(docs, fit(docs)).collect()}
    assert got[1000].score < 0.4 and got[1000].best > 0.9
    assert {r.doc_id for r in language(spark, docs, "").collect()} == {r[0] for r in rows} - {1002}


def test_sample_holds_every_language(spark):
    from geoterra.llm.language_crf import fit

    rows = [(i, spoken("de" if i % 9 == 0 else "en", 8), "de" if i % 9 == 0 else "en") for i in range(3000)] + [(5002, spoken("fr", 9), "fr"), (None, spoken("es", 9), "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert fit(docs, sample=20)[0] == ["de", "en", "es", "fr"]


def packed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_packing_by_table_equals_packing_by_arrays(spark):
    from geoterra.llm.packing import pack

    rows = [(i, spoken("en", int(n)), f"s{i % 9}" if i % 10 else None) for i, n in enumerate(RNG.integers(0, 400, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for weights in (None, {"s0": 2.0, "s1": 1.0, "s2": 0.0, "s3": 1.0}, {"s0": 0.0}):
        whole = packed(pack(docs, weights, window=2048))
        assert packed(pack(docs, weights, window=2048, max_queues=2)) == whole


@pytest.mark.parametrize("max_queues", [1000, 3])
def test_packing_honours_every_weight(spark, max_queues):
    from geoterra.llm.packing import pack

    rows = [(i, spoken("en", 300), f"s{i % 6}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = pack(docs, {"s0": 0.0, "s3": 1.0, "s4": 1.0, "s5": 2.0}, window=512, max_queues=max_queues).collect()
    source = {i: s for i, _, s in rows}
    early = [source[r.doc_id] for r in out if r.sequence_id == 0]
    share = {s: sum(r.length for r in out if r.sequence_id == 0 and source[r.doc_id] == s) for s in set(source.values())}
    assert set(early) == {"s3", "s4", "s5"} and share == {"s0": 0, "s1": 0, "s2": 0, "s3": 256, "s4": 256, "s5": 512}
    place = lambda some: [r.sequence_id for r in out if (source[r.doc_id] in ("s3", "s4", "s5")) == some]
    assert max(place(True)) <= min(place(False)) and sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())


def test_distrust_reaches_long_chains(spark):
    from geoterra.llm.url_trust import judge

    rows = [(i, f"http://h{i}.info/a", f'<a href="http://h{i + 1}.info/">') for i in range(14)] + [(14, "http://h14.info/a", '<a href="http://bad.org/">'), (15, "http://bad.org/es/1", None), (16, "http://alone.info/", None)]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [i for i in got if got[i].verdict == "allow"] == [16]
    assert all(got[14 - k].distrust == pytest.approx(0.15 * 0.85 ** (k + 1), rel=1e-6) for k in range(15))


@pytest.mark.parametrize(("window", "grain", "weights"), [(None, 64, None), (256, 16, {"s0": 3.0, "s1": 1.0, "s2": 0.05}), (100, 7, None), (None, 1, {"s1": 1.0})])
def test_packing_equals_a_simulated_round_robin(spark, window, grain, weights):
    from geoterra.llm.packing import _rounds, pack
    from geoterra.llm.tokens import default_vocabulary, encode

    rows = [(i, spoken("en", int(n)), f"s{i % 4}" if i % 7 else None) for i, n in enumerate(RNG.integers(0, 300, 50))] + [(99, None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    queues: dict = {}
    for i, text, source in rows:
        queues.setdefault("null" if source is None else "=" + source, []).extend((i, k) for k in range(len(encode(text, default_vocabulary())) + 1))
    plan = {r.queue: r for r in _rounds(spark.createDataFrame([(q, len(x)) for q, x in queues.items()], "queue string, size long"), weights, window or 1024, grain).collect()}
    given = {"=" + s: w for s, w in (weights or {}).items()}
    turns = sorted(queues, key=lambda q: (-len(queues[q]), q))
    stream = []
    for late in (False, True):
        now = [q for q in turns if (q not in given if weights else False) == late]
        share = {q: given.get(q, len(queues[q])) for q in now}
        assert all(plan[q].quantum == pytest.approx(share[q] / sum(share.values()) * ((window or 1024) / grain) * 2.0**20, abs=1) for q in now)
        credit, left = {q: plan[q].phase for q in now}, {q: list(queues[q]) for q in now}
        while any(left.values()):
            for q in now:
                credit[q] += plan[q].quantum
                take = (credit[q] >> 20) * grain
                credit[q] &= 2**20 - 1
                stream += left[q][:take]
                left[q] = left[q][take:]
    whole = len(stream) // 1024 * 1024
    starts = list(range(0, whole + 1, 1024))
    for bit in range(9, -1, -1):
        if (len(stream) - whole) >> bit & 1:
            starts.append(starts[-1] + (1 << bit))
    for some in (1000, 2):
        out = pack(docs, weights, window=window, grain=grain, max_queues=some).collect()
        placed = {starts[r.sequence_id] + r.offset + j: (r.doc_id, r.start + j) for r in out for j in range(r.length)}
        assert [placed[i] for i in range(len(stream))] == stream and len(placed) == len(stream)


def test_every_sequence_holds_its_proportions(spark):
    from geoterra.llm.packing import pack

    rows = [(i, spoken("en", 500), f"s{i % 5}") for i in range(100)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    full = max(r.sequence_id for r in out if r.offset + r.length == 1024)
    for seq in range(full):
        share = [sum(r.length for r in out if r.sequence_id == seq and r.doc_id % 5 == s) for s in range(5)]
        assert max(share) - min(share) <= 128


@pytest.mark.parametrize("n", [400_000, 1_000_000])
@pytest.mark.parametrize("blank", [" ", "\n", "\t"])
def test_long_white_space_is_encoded(blank, n):
    from tokenizers import Tokenizer

    from geoterra.llm.tokens import default_vocabulary, encode

    text = "a" + blank * n + "b"
    want = Tokenizer.from_file(default_vocabulary()).encode(text, add_special_tokens=False).ids
    assert encode(text, default_vocabulary()).tolist() == want


def test_counts_of_texts_that_hold_the_end_string(spark):
    from geoterra.llm.token_counts import KINDS, scan, stream_kind, write_token_stream
    from geoterra.llm.tokens import default_vocabulary, encode

    assert encode("a<|endoftext|>b", default_vocabulary()).tolist().count(50256) == 1
    assert 50256 not in encode("a<|endoftext|>b", default_vocabulary(), special=False)
    docs = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, ""), (3, None), (3, "x y")], "doc_id long, text string")
    for end in (50256, 70_000):
        kind = stream_kind(end)
        got = sorted(r.n_tokens for r in scan(write_token_stream(docs, end, block_tokens=3), end, kind).collect())
        assert got == sorted(len(encode(t, default_vocabulary(), special=False)) for t in ("a<|endoftext|>b", "", None, "x y"))
    assert KINDS[stream_kind(50256)].itemsize == 2 and KINDS[stream_kind(70_000)].itemsize == 4
    assert scan(write_token_stream(docs.limit(0), 50256), 50256).count() == 0
    with pytest.raises(Exception, match="cannot end documents"):
        write_token_stream(docs, 64)
