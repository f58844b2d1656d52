"""Questions of many shards about shared keys, packed: each shard asks once about each of its keys and hears one value.

A request is a row (bucket, shard, packed keys and values): the keys of a shard that fall into one bucket. Shards
stand in teams of ``fan``, and there are as many buckets as a team needs, so the number of rows grows in proportion to the
shards. With one team the buckets answer. With more, each bucket of a team merges its shards' requests, equal
keys into one, and asks finer buckets, as many as there are teams, which hear from teams in place of shards; answers go back
the same way. No group holds more than the requests of ``fan`` shards, or of all teams, to a range of keys that shrinks with their number.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

ANSWER = "shard int, bucket long, data binary, stats array<long>"


class Exchange(ABC):
    """``payload``: the columns of packed keys and values; ``kind``: the type of an answer; ``combine``: how values of equal keys merge."""

    payload: tuple[str, ...]
    kind: type
    combine: np.ufunc

    def __init__(self, shards: int, fan: int = 1024, per_shard: int = 4):
        self.fan, self.teams = fan, max(1, math.ceil(shards / fan))
        self.bits = max(4, (per_shard * min(shards, fan) - 1).bit_length())
        self.sub_bits = (self.teams - 1).bit_length()

    @abstractmethod
    def unpack(self, t: pa.Table) -> tuple[list[int], tuple[np.ndarray, ...], np.ndarray]:
        """Sizes of the rows, and the keys and values of all of them, one after another."""

    @abstractmethod
    def pack(self, keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[bytes, ...]:
        """The payload of one row."""

    @abstractmethod
    def hashed(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """64 bits whose upper ones are the bucket, and the next ones the finer bucket."""

    @abstractmethod
    def answer(self, keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """A value for every key of a bucket, and some numbers for the whole bucket."""

    def refine(self, answers: np.ndarray, values: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Answers to keys with these values, from those to their merged ones."""
        return answers

    @property
    def schema(self) -> str:
        return "bucket long, shard int, " + ", ".join(f"{c} binary" for c in self.payload)

    def bucket(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        return (self.hashed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, shard: int, keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[np.ndarray, pa.Table]:
        """The order in which a shard's keys are asked and answered, and its requests."""
        bucket = self.bucket(keys)
        order = np.argsort(bucket, kind="stable")
        return order, self._table(bucket[order], shard, tuple(k[order] for k in keys), values[order])

    def _table(self, bucket: np.ndarray, shard: int, keys: tuple[np.ndarray, ...], values: np.ndarray) -> pa.Table:
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
        packed = [self.pack(tuple(k[a:b] for k in keys), values[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        cols = list(zip(*packed, strict=True)) or [[]] * len(self.payload)
        return pa.table({"bucket": pa.array(bucket[edge[:-1]], pa.int64()), "shard": pa.array([shard] * len(packed), pa.int32()), **{c: pa.array(list(x), pa.binary()) for c, x in zip(self.payload, cols, strict=True)}})

    def _merged(self, t: pa.Table) -> tuple:
        """Finer bucket, keys and values of the different keys, and for each asked key its values and place among those."""
        sizes, keys, values = self.unpack(t)
        fine = (self.hashed(keys) >> np.uint64(64 - self.bits - self.sub_bits)).astype(np.int64)
        order = np.lexsort((*keys[::-1], fine))
        fresh = np.zeros(len(order), bool)
        for k in keys:
            k = k[order]
            fresh |= np.append(True, k[1:] != k[:-1])
        at = np.flatnonzero(fresh)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        return fine[order][at], tuple(k[order][at] for k in keys), self.combine.reduceat(values[order], at), sizes, values, place

    def lifted(self, requests: DataFrame) -> DataFrame:
        """The requests that buckets answer: those of the shards, or of the teams."""
        if self.teams == 1:
            return requests

        def run(t: pa.Table) -> pa.Table:
            fine, keys, values, *_ = self._merged(t)
            return self._table(fine, t.column("shard")[0].as_py() // self.fan, keys, values)

        return written(self._by_team(requests).applyInArrow(run, self.schema), "team-requests")

    def _by_team(self, requests: DataFrame):
        return requests.groupBy("bucket", F.floor(F.col("shard") / self.fan).cast("int").alias("team"))

    def answered(self, lifted: DataFrame) -> DataFrame:
        """(shard or team, bucket, data, stats): ``data`` in the order of the request; ``stats`` stand in one row of a bucket."""

        def run(t: pa.Table) -> pa.Table:
            sizes, keys, values = self.unpack(t)
            found, stats = self.answer(keys, values)
            parts = np.split(found.astype(self.kind), np.cumsum(sizes)[:-1])
            return pa.table({"shard": t.column("shard"), "bucket": t.column("bucket"), "data": pa.array([p.tobytes() for p in parts], pa.binary()), "stats": pa.array([stats] + [None] * (len(parts) - 1), pa.list_(pa.int64()))})

        return lifted.groupBy("bucket").applyInArrow(run, ANSWER)

    def lowered(self, requests: DataFrame, answers: DataFrame) -> DataFrame:
        """(shard, bucket, data, stats) for the shards' own requests."""
        if self.teams == 1:
            return answers
        asked = answers.select(F.shiftright("bucket", self.sub_bits).alias("bucket"), F.col("shard").alias("team"), F.col("bucket").alias("fine"), "data")

        def run(t: pa.Table, r: pa.Table) -> pa.Table:
            _, _, merged, sizes, values, place = self._merged(t)
            back = np.concatenate([np.frombuffer(d, self.kind) for _, d in sorted(zip(r.column("fine").to_pylist(), r.column("data").to_pylist(), strict=True))])
            found = self.refine(back[place], values, merged[place]).astype(self.kind)
            parts = np.split(found, np.cumsum(sizes)[:-1])
            return pa.table({"shard": t.column("shard"), "bucket": t.column("bucket"), "data": pa.array([p.tobytes() for p in parts], pa.binary()), "stats": pa.array([None] * len(parts), pa.list_(pa.int64()))})

        return self._by_team(requests).cogroup(asked.groupBy("bucket", "team")).applyInArrow(run, ANSWER)

    def values(self, answers: pa.Table, order: np.ndarray) -> np.ndarray:
        """A shard's answers, in the order of its keys before they were dealt."""
        rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))
        out = np.empty(len(order), self.kind)
        out[order] = np.frombuffer(b"".join(d for _, d in rows), self.kind)
        return out
