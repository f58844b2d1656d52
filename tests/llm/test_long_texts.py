"""Texts of several megabytes, longer than any piece that tasks cut their input to."""

import hashlib
import random


def long_text(seed, size):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(size // 7))


def test_long_texts(spark):
    from geoterra.llm.decontamination import decontaminate
    from geoterra.llm.merkle_manifest import manifest
    from geoterra.llm.suffix_dedup import remove_repeats

    passage = long_text(99, 90)
    texts = {1: long_text(1, 3_000_000) + " " + passage, 2: long_text(2, 3_000_000) + " " + passage + " end", 3: "short", 4: None}
    docs = spark.createDataFrame([(i, t, "en", "web", None) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    words = len(passage.split())
    bench = spark.createDataFrame([("b", passage)], "item_id string, text string")
    hits = {r.doc_id: (r.n_words, list(r.hit_words)) for r in decontaminate(docs, bench).collect()}
    for i in (1, 2):
        n = len(texts[i].split())
        start = n - words - (i == 2)
        assert hits[i] == (n, list(range(start, start + words)))
    assert hits[3] == (1, []) and hits[4] == (0, [])
    kept = {r.doc_id: (r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(docs).collect()}
    shared = " " + passage
    assert kept[2] == (len(shared), hashlib.sha256(texts[2].replace(shared, "").encode()).hexdigest())
    assert kept[1][0] == kept[3][0] == kept[4][0] == 0
    piece = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = {r.doc_id: r.leaf for r in manifest(docs).collect()}
    assert leaves == {i: hashlib.sha256("".join(map(piece, (i, "web", "en", None, t))).encode()).hexdigest() for i, t in texts.items()}
