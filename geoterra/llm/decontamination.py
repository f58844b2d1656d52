"""Benchmark decontamination by a prefix-filtered set join.

Each item window is a set of words; containment of the whole set is asked for, so of its words ordered by rarity
over the documents one prefix word is necessary. Document words join with the prefix words; a hit at word i fixes
the only window start (positional bound), which must leave room for the window's length (length bound). The windows that are left
meet the items' by hash, and are then compared word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernel import U, chunks, mix, prefix_sums, span_hashes, word_spans
from .store import written

#: A word is a run of digits, lower-case letters and characters beyond ASCII, after A-Z are lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MAP = np.frombuffer(WORD_BYTES, np.uint8)
_BREAK = np.arange(256) == 32
RESULT = "doc_id long, n_words long, hit_words array<int>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Words:
    """The words of a chunk of texts: normalised bytes, spans, hashes, and each text's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.buf = _MAP[raw]
        self.starts, self.ends, self.first = word_spans(self.buf, offsets, _BREAK)
        self.hashes = span_hashes(prefix_sums(self.buf), self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        self.of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def windows(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A hash of the ``length`` words from each place on."""
        total = length.astype(np.uint64) * U(0xD6E8FEB86659FD93)
        with np.errstate(over="ignore"):
            for k, factor in enumerate(mix(np.arange(1, int(length.max(initial=0)) + 1, dtype=np.uint64))):
                on = np.flatnonzero(length > k)
                total[on] += self.hashes[at[on] + k] * factor
        return mix(total)

    def text(self, at: int, length: int) -> bytes:
        """The words from a place on, one blank between them."""
        raw = self.buf[self.starts[at] : self.ends[at + length - 1]].tobytes()
        return raw if len(raw) == int((self.ends[at : at + length] - self.starts[at : at + length]).sum()) + length - 1 else b" ".join(raw.split())


class Index:
    """The windows of a block of items as packed arrays, some 50 bytes a word of the items."""

    def __init__(self, names: list[str], texts: list[bytes], size: int, rarity: tuple[np.ndarray, np.ndarray]):
        texts = [b" ".join(words(t)) for t in texts]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        w = Words(raw, np.append(0, np.cumsum([len(t) for t in texts])))
        self.names, many = names, np.diff(w.first)
        # A text of fewer words is one window, others have one from every word on that leaves room.
        count = np.where(many >= size, many - size + 1, np.minimum(many, 1))
        item = np.repeat(np.arange(len(texts)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][item]
        length = np.minimum(many, size)[item]
        hashes = w.windows(at, length)
        vocabulary, df = rarity
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.lexsort((vocabulary, df))] = np.arange(len(vocabulary))
        of_word = rank[np.searchsorted(vocabulary, w.hashes)]
        best = np.full(len(at), np.iinfo(np.int64).max)
        for k in range(size):
            on = np.flatnonzero(length > k)
            best[on] = np.minimum(best[on], of_word[at[on] + k] * 64 + k)
        place = best & 63
        self.prefixes, self.edge, self.place, self.length = self._combinations(w.hashes[at + place], place, length)
        order = np.lexsort((item, hashes))
        hashes, item, at, length = hashes[order], item[order], at[order], length[order]
        fresh = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        self.windows, self.items, self.item_edge = hashes[fresh], item.astype(np.int32), np.append(fresh, len(hashes)).astype(np.int32)
        self.text, self.begin, self.end = w.buf.tobytes(), w.starts[at].astype(np.int32), (w.ends[at + length - 1] if len(at) else at).astype(np.int32)

    @staticmethod
    def _combinations(words: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Prefix words, and for each the different (place of the word in a window, length of the window)."""
        order = np.lexsort((length, place, words))
        words, place, length = words[order], place[order], length[order]
        fresh = np.append(True, (words[1:] != words[:-1]) | (place[1:] != place[:-1]) | (length[1:] != length[:-1])) if len(words) else np.zeros(0, bool)
        words, place, length = words[fresh], place[fresh], length[fresh]
        found, first = np.unique(words, return_index=True)
        return found, np.append(first, len(words)), place, length

    def matches(self, w: Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which words of a chunk are hit, and the (text, item) with a window in it."""
        step = np.zeros(len(w.hashes) + 1, np.int64)
        found: set[tuple[int, int]] = set()
        if not len(self.prefixes) or not len(w.hashes):
            return step[:-1] > 0, []
        p = np.minimum(np.searchsorted(self.prefixes, w.hashes), len(self.prefixes) - 1)
        at = np.flatnonzero(self.prefixes[p] == w.hashes)
        every = self.edge[p[at] + 1] - self.edge[p[at]]
        # Some 100,000 candidates at a time, so that common prefix words need no more memory than rare ones.
        parts = np.searchsorted(np.cumsum(every) >> 17, np.arange(1 + int(every.sum() >> 17)))
        for low, high in zip(parts, [*parts[1:], len(at)], strict=True):
            i, many = at[low:high], every[low:high]
            c = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.edge[p[i]], many)
            i = np.repeat(i, many)
            start, length = i - self.place[c], self.length[c]
            fits = (start >= w.first[w.of[i]]) & (start + length <= w.first[w.of[i] + 1])
            start, length = start[fits], length[fits]
            h = w.windows(start, length)
            k = np.minimum(np.searchsorted(self.windows, h), len(self.windows) - 1)
            same = np.flatnonzero(self.windows[k] == h)
            for s, n, g in zip(start[same].tolist(), length[same].tolist(), k[same].tolist(), strict=True):
                mine, hit = w.text(s, n), False
                for e in range(self.item_edge[g], self.item_edge[g + 1]):
                    if self.text[self.begin[e] : self.end[e]] == mine:
                        found.add((int(w.of[s]), int(self.items[e])))
                        hit = True
                if hit:
                    step[s] += 1
                    step[s + n] -= 1
        return np.cumsum(step[:-1]) > 0, sorted(found)


def _rarity(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents each word (sorted hashes) stands, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most a word for each two bytes of a block

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total = np.zeros(len(v), np.int64)
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column(0), 1 << 19):
                w = Words(raw, offsets)
                at = np.minimum(np.searchsorted(v, w.hashes), len(v) - 1)
                known = v[at] == w.hashes
                pair = np.unique(w.of[known] * len(v) + at[known])
                total += np.bincount(pair % len(v), minlength=len(v))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": pa.array(some), "n": pa.array(total[some])})

    found = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = np.zeros(len(vocabulary), np.int64)
    for r in found.collect():  # at most one row for each word of the block
        df[r.word] = r.n
    return vocabulary, df


def _segments(benchmark: DataFrame, size: int, most: int) -> DataFrame:
    """(item_id, part, text): items, those of more than ``most`` words cut so that each window lies whole in one part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = words(text.as_py())
                for low in range(0, max(1, len(w) - size + 1), most - size + 1) if w else ():
                    rows.append((item, low, b" ".join(w[low : low + most])))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.binary())], ["item_id", "part", "text"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).dropna()
    return written(items.mapInArrow(cut, "item_id string, part long, text binary").distinct(), "benchmark-items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, the positions of its hit words, and the items with a window in it.

    ``benchmark`` (item_id, text) is taken in blocks of about ``block_bytes`` of text, longer items in parts, so what the
    driver and a task hold at once is bounded however many items there are; each block is two passes over the documents (rarity, search), and
    its hits are written before the next block. ``size`` is at most 64 words. Texts are whole. A null or empty text has no
    words; null items and items without words have no window; repeated rows stay repeated, in both tables; an item_id that is null
    takes no part; other columns are ignored. An empty benchmark gives rows without hits.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    items = _segments(benchmark, size, max(2 * size, block_bytes // 64))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    if blocks == 1:
        return _search(docs, items, size, "doc_id")
    # Rows get a written number, by which the hits of the blocks meet.
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    found = None
    for block in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "part", "text"), F.lit(blocks)) == block)
        hits = written(_search(rows, some, size, "row").filter(F.size("items") > 0).drop("n_words"), "benchmark-hits")
        found = hits if found is None else found.union(hits)
    every = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # at most one row for each block
    counted = _search(rows, items.limit(0), size, "row").select("row", "n_words")
    out = rows.select("row", "doc_id").join(counted, "row").join(every, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _search(docs: DataFrame, items: DataFrame, size: int, key: str) -> DataFrame:
    """(``key``, n_words, hit_words, items) of every row, against one block of items."""
    rows = items.collect()  # one block
    texts = [bytes(r.text) for r in rows]
    held = Words(np.frombuffer(b" ".join(texts), np.uint8), np.array([0, max(0, sum(map(len, texts)) + len(texts) - 1)]))
    vocabulary = np.unique(held.hashes)
    rarity = _rarity(docs, vocabulary) if len(vocabulary) else (vocabulary, np.zeros(0, np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], texts, size, rarity))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for low, high, raw, offsets in chunks(batch.column(1), 1 << 19):
                w = Words(raw, offsets)
                hit, found = index.matches(w)
                at = np.flatnonzero(hit)
                edge = np.searchsorted(at, w.first).astype(np.int32)
                names: list[list[str]] = [[] for _ in range(high - low)]
                for d, i in found:
                    names[d].append(index.names[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(w.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(edge), pa.array((at - w.first[w.of[at]]).astype(np.int32))), pa.array([sorted(set(x)) for x in names], pa.list_(pa.string()))],
                    [key, "n_words", "hit_words", "items"],
                )

    return docs.select(key, "text").mapInArrow(scan, RESULT.replace("doc_id", key))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


QUERIES = {"op2_decontamination": op2_decontamination}
