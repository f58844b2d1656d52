"""Language of words, and of documents, by a linear-chain conditional random field.

Each word of a text is a position, each language a label. Features are the word itself (a learned lexicon), its
affixes and its byte trigrams, hashed; transitions between the labels are learned too. Forward-backward gives each
word the probability of every language, so code-switched text is labelled word by word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytekernel import LOWER, SPACE, U, chunks, prefix_sums, span_hashes, word_spans

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each, number per word): the word, prefixes and suffixes of 1 to 3 bytes, and trigrams with a mark at both ends."""
    sums = prefix_sums(buf)
    kind = lambda h, k: (h * U(2 * k + 1) + U(k) * U(0x9E3779B97F4A7C15)) >> U(64 - bits)
    with np.errstate(over="ignore"):
        fixed = [kind(span_hashes(sums, starts, ends), 1)]
        for n in (1, 2, 3):
            fixed += [kind(span_hashes(sums, starts, np.minimum(starts + n, ends)), 1 + n), kind(span_hashes(sums, np.maximum(ends - n, starts), ends), 4 + n)]
        grams = np.maximum(ends - starts - 2, 0)
        of = np.repeat(np.arange(len(starts)), grams)
        at = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams) + starts[of]
        tri = kind(span_hashes(sums, at, at + 3), 8)
    count = len(fixed) + grams
    out = np.empty(count.sum(), np.int64)
    first = np.cumsum(count) - count
    for k, f in enumerate(fixed):
        out[first + k] = f
    out[np.repeat(first + len(fixed), grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)] = tri
    return out, count


def emissions(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Summed weights of each word's features, found once for each distinct word."""
    if not len(starts):
        return np.zeros((0, weights.shape[1]), np.float32)
    _, at, back = np.unique(span_hashes(prefix_sums(buf), starts, ends), return_index=True, return_inverse=True)
    f, count = features(buf, starts[at], ends[at], int(weights.shape[0]).bit_length() - 1)
    return np.add.reduceat(weights[f], np.cumsum(count) - count, axis=0)[back]


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Probabilities of the labels at each position of several chains (chain i: positions first[i] to first[i + 1]).

    With ``pairs`` also how many transitions from label to label all chains are expected to make: the sum over neighbours of
    the pair's probability, forward(t, i) * step(i, j) * emission(t + 1, j) * backward(t + 1, j), brought to a sum of 1.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length, begin, last = length[order], first[:-1][order], first[1:][order] - 1
    e = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    step = np.exp(transitions - transitions.max()).astype(e.dtype)
    out = np.empty_like(e)
    active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
    state = None
    for t, m in enumerate(active):
        here = e[begin[:m] + t] if state is None else (state[:m] @ step) * e[begin[:m] + t]
        state = here / here.sum(1, keepdims=True)
        out[begin[:m] + t] = state
    state = np.ones((0, e.shape[1]), e.dtype)
    forward, expected = out.copy() if pairs else out, np.zeros(step.shape)
    # From the ends: chains of equal distance to their end move together.
    for t, m in enumerate(active):
        at = last[:m] - t
        if t == 0:
            state = np.ones((m, e.shape[1]), e.dtype)
        else:
            after = state[:m] * e[at + 1]
            if pairs:
                pair = forward[at][:, :, None] * step[None] * after[:, None, :]
                expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            state = after @ step.T
            state /= state.sum(1, keepdims=True)
        both = out[at] * state
        out[at] = both / both.sum(1, keepdims=True)
    return (out, expected) if pairs else out


def train(texts: list[bytes], labels: Sequence, count: int, bits: int = 16, epochs: int = 2, segment: int = 48, batch: int = 64, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that raise the log-likelihood of the labels (one for a text, or one for each of its words), by AdaGrad over batches of segments of the texts."""
    weights, transitions = np.zeros((1 << bits, count)), np.zeros((count, count))
    squares, squares_t = np.full(weights.shape, 1e-6), np.full(transitions.shape, 1e-6)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for text, label in zip(texts, labels, strict=True):
        buf = LOWER[np.frombuffer(text, np.uint8)]
        starts, ends, _ = word_spans(buf, np.array([0, len(buf)]), SPACE)
        if len(starts):
            f, n = features(buf, starts, ends, bits)
            edge, label = np.append(0, np.cumsum(n)), np.broadcast_to(label, len(starts))
            for low in range(0, len(starts), segment):
                high = min(low + segment, len(starts))
                parts.append((f[edge[low] : edge[high]], n[low:high], label[low:high]))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        shuffled = rng.permutation(len(parts))
        for low in range(0, len(parts), batch):
            some = [parts[i] for i in shuffled[low : low + batch]]
            f, n = np.concatenate([p[0] for p in some]), np.concatenate([p[1] for p in some])
            first = np.append(0, np.cumsum([len(p[1]) for p in some]))
            y = np.concatenate([p[2] for p in some])
            gold = np.zeros((len(n), count))
            gold[np.arange(len(n)), y] = 1
            scores = np.add.reduceat(weights[f], np.cumsum(n) - n, axis=0)
            p, expected = forward_backward(scores, first, transitions, pairs=True)
            g = (p - gold) / batch
            used, back = np.unique(f, return_inverse=True)
            per = np.repeat(g, n, axis=0)
            grad = np.stack([np.bincount(back, per[:, k], len(used)) for k in range(count)], 1)
            squares[used] += grad**2
            weights[used] -= rate * grad / np.sqrt(squares[used])
            inner = np.ones(len(n) - 1, bool)
            inner[first[1:-1] - 1] = False
            grad_t = (expected - gold[:-1][inner].T @ gold[1:][inner]) / batch
            squares_t += grad_t**2
            transitions -= 0.1 * grad_t / np.sqrt(squares_t)
    return weights.astype(np.float32), np.maximum(transitions, -6.0)


def stratified(rows: DataFrame, sample: int, sample_bytes: int = 64 << 20) -> DataFrame:
    """About ``sample`` of ``rows`` (h, lang, text), those with the smallest hash of each language, and at least one of every language.

    The texts kept of one language hold together at most its share of ``sample_bytes``, and the first whatever its size. Half is dealt evenly over the languages, as far as they have rows, and what is left by their counts. As in
    ``smallest``, a bound on the hash keeps what is sorted from growing with the table.
    """
    count = {x.lang: x["count"] for x in rows.groupBy("lang").count().collect()}  # one row for each label of the model
    every = sum(count.values())
    if not every:
        return rows
    least = {x: min(n, max(1, sample // (2 * len(count)))) for x, n in count.items()}
    spare, more = max(0, sample - sum(least.values())), every - sum(least.values())
    quota = {x: n if every <= sample else least[x] + spare * (n - least[x]) // max(1, more) for x, n in count.items()}
    bound = {x: 2**63 - 1 if n <= 4 * quota[x] + 256 else -(2**63) + 2**64 * (2 * quota[x] + 64) // n for x, n in count.items()}
    of = lambda d: F.element_at(F.create_map(*[F.lit(y) for x in d.items() for y in x]), F.col("lang"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    rows = rows.filter(F.col("h") <= of(bound)).withColumn("k", F.row_number().over(order)).withColumn("b", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    share = {x: sample_bytes * q // max(1, sum(quota.values())) for x, q in quota.items()}
    return rows.filter((F.col("k") <= of(quota)) & ((F.col("k") == 1) | (F.col("b") <= of(share)))).drop("k", "b")


def fit(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = 1500, sample_bytes: int = 64 << 20, bits: int = 16) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights and transitions, from about ``sample`` labelled documents (of each language those with the smallest hash of doc_id) of at most about ``sample_bytes`` of text, whole, in one task.

    Only text and non-null lang of documents whose crc32(doc_id) mod ``folds`` is not ``held`` are used. Repeated rows count as often as they
    stand; with one language alone every word has it; without any the model is empty.
    """
    text_id = F.col("doc_id").cast("long").cast("string")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(F.pmod(F.crc32(text_id.cast("binary")), F.lit(folds)) != held, F.lit(True)))
    rows = rows.select(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")).alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = stratified(rows, sample, sample_bytes)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("lang", "ascending"), ("text", "ascending")])
        lang = t.column("lang").to_pylist()
        names = sorted(set(lang))
        weights, transitions = train(t.column("text").to_pylist(), np.array([names.index(x) for x in lang]), len(names), bits)
        return pa.table({"names": pa.array([names], pa.list_(pa.string())), "weights": pa.array([weights.tobytes()], pa.binary()), "transitions": pa.array([transitions.tobytes()], pa.binary())})

    model = rows.groupBy(F.lit("all")).applyInArrow(run, "names array<string>, weights binary, transitions binary").collect()
    if not model:
        return [], np.zeros((1 << bits, 0), np.float32), np.zeros((0, 0))
    m, n = model[0], len(model[0].names)
    return list(m.names), np.frombuffer(m.weights, np.float32).reshape(-1, n), np.frombuffer(m.transitions).reshape(n, n)


def word_labels(text: str, model: tuple) -> list[tuple[str, str, float]]:
    """(word, language, probability) for each word of a text."""
    names, weights, transitions = model
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, first = word_spans(LOWER[raw], np.array([0, len(raw)]), SPACE)
    p = forward_backward(emissions(LOWER[raw], starts, ends, weights), first, transitions)
    return [(bytes(raw[a:b]).decode("utf-8", "replace"), names[k], float(row[k])) for a, b, row, k in zip(starts, ends, p, p.argmax(1) if len(p) else [], strict=True)]


def identify(docs: DataFrame, model: tuple) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score, the mean probability of that language over the words, and best, the mean of each word's highest probability.

    A text of several languages has a low score but a high best. ``und`` (score and best 0) if the text is null or has no letter, or if there is no learned language. Texts are whole.
    Repeated rows stay; a null doc_id stays null; other columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, transitions = shared.value
        for batch in batches:
            texts = batch.column(1)
            for low, high, raw, offsets in chunks(texts, 1 << 20):
                pred, score, sure = [UNKNOWN] * (high - low), np.zeros(high - low), np.zeros(high - low)
                if names:
                    buf = LOWER[raw]
                    starts, ends, first = word_spans(buf, offsets, SPACE)
                    p = forward_backward(emissions(buf, starts, ends, weights), first, transitions)
                    sums = np.zeros((high - low, len(names)))
                    filled = np.flatnonzero(np.diff(first))
                    if len(filled):
                        top = np.add.reduceat(p.max(1), first[:-1][filled], dtype=float) / np.diff(first)[filled]
                        sums[filled] = np.add.reduceat(p, first[:-1][filled], axis=0, dtype=float) / np.diff(first)[filled, None]
                    best = sums.argmax(1)
                    for k, i in enumerate(filled):
                        if LETTER.search(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")):
                            pred[i], score[i], sure[i] = names[best[i]], min(1.0, sums[i, best[i]]), min(1.0, top[k])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(pred), pa.array(score), pa.array(sure)], ["doc_id", "lang_pred", "score", "best"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, best double")


def held_out(folds: int, held: int):
    """The doc_id's fold is the held one; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False)).alias("held_out")


def op10_language_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs)).select("doc_id", held_out(4, 2), "lang_pred", "score")


QUERIES = {"op10_language_crf": op10_language_crf}
