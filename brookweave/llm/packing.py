"""Problem 9: documents into containers of fixed capacity, along a space-filling curve.

A document's bag of words is hashed and projected to three dimensions (a sum of hash signs per dimension); the point's
key on the Hilbert curve orders the documents, so that neighbours share words.  The documents are range-partitioned by
that key and packed partition by partition: chunks of neighbours, largest first, each into the open container with the
least room that holds it.  Only documents larger than a container are split, into full containers and a rest that is
packed like the others.

Defined cases: null and empty texts have size 0 and are put like others; a document without id is left out; ties go by
doc_id; containers never span range partitions, whose number follows the total size, so what stays open at their ends
is a vanishing share.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, table
from .tokens import Bpe

BITS = 10
#: Neighbours that are packed largest first, and containers that stay open; both decide about fill alone.
CHUNK, OPEN = 512, 256
#: Tokens of one range partition.
PART_TOKENS = 24_000_000


def hilbert(x: np.ndarray, y: np.ndarray, z: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of points with `bits` bits a coordinate on the three-dimensional Hilbert curve."""
    p = [np.array(v, dtype=np.int64) for v in (x, y, z)]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(3):
            on = (p[i] & q) != 0
            swap = (p[0] ^ p[i]) & low
            p0 = np.where(on, p[0] ^ low, p[0] ^ swap)
            if i:
                p[i] = np.where(on, p[i], p[i] ^ swap)
            p[0] = p0
        q >>= 1
    for i in (1, 2):
        p[i] ^= p[i - 1]
    t = np.zeros_like(p[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((p[2] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    p = [v ^ t for v in p]
    key = np.zeros_like(p[0])
    for b in range(bits - 1, -1, -1):
        for v in p:
            key = (key << 1) | ((v >> b) & 1)
    return key


@F.pandas_udf(LongType())
def hilbert_key(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series(hilbert(x.to_numpy(), y.to_numpy(), z.to_numpy()))


def _axis(hashes: Column, bit: int) -> Column:
    total = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.when(F.shiftright(h, bit).bitwiseAND(F.lit(1).cast("bigint")) == 1, 1).otherwise(-1))
    # a sum of n signs has the spread of sqrt(n); four of them to either side fill the range
    unit = total / F.sqrt(F.greatest(F.size(hashes), F.lit(1)).cast("double"))
    return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor((unit + 4) * (1 << BITS) / 8))).cast("int")


def measured(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens, key), written once: the range partitioning reads it twice."""
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    bpe = Bpe(path).warm(docs)
    d = bpe.parts(docs).withColumn("_d", F.transform(F.array_distinct("_w"), lambda w: F.xxhash64(w)))
    d = d.select(
        "doc_id", F.aggregate(bpe.sizes(), F.lit(0), lambda a, x: a + x).alias("tokens"), *(_axis(F.col("_d"), 3 + 17 * i).alias(n) for i, n in enumerate("xyz"))
    )
    return cut(d.select("doc_id", "tokens", hilbert_key("x", "y", "z").alias("key")))


class Packer:
    """Best fit into a bounded number of open containers."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.open: list[tuple[int, int]] = []  # (room, container), sorted

    def _new(self) -> int:
        self.next += 1
        return self.next

    def put(self, doc: int, size: int) -> list[tuple[int, int, int, int]]:
        """(container, doc, part, tokens) of a document."""
        out, part = [], 0
        while size > self.capacity:
            out.append((self._new(), doc, part, self.capacity))
            size -= self.capacity
            part += 1
        i = bisect_left(self.open, (size, -1))
        room, box = self.open.pop(i) if i < len(self.open) else (self.capacity, self._new())
        out.append((box, doc, part, size))
        if room - size > 0:
            insort(self.open, (room - size, box))
            if len(self.open) > OPEN:
                self.open.pop(0)  # the fullest
        return out


def pack(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """(limit_id, container_id, doc_id, part, tokens): every document in a container of each size."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    limits = [(r["limit_id"], r["capacity"]) for r in table(spark, sf_dir, "size_limits").filter("purpose = 'container'").collect()]  # fixed
    sized = measured(docs)
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    parts = int(total // PART_TOKENS) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 32
        packers = {k: Packer(c, base) for k, c in limits}
        for b in batches:
            ids, sizes = b["doc_id"].to_numpy(), b["tokens"].to_numpy()
            rows = []
            for lo in range(0, len(ids), CHUNK):
                order = sorted(range(lo, min(lo + CHUNK, len(ids))), key=lambda i: (-sizes[i], ids[i]))
                for k, p in packers.items():
                    for i in order:
                        rows.extend((k, *r) for r in p.put(int(ids[i]), int(sizes[i])))
            yield pd.DataFrame(rows, columns=["limit_id", "container_id", "doc_id", "part", "tokens"])

    ranged = sized.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ranged.select("doc_id", "tokens").mapInPandas(run, "limit_id int, container_id bigint, doc_id bigint, part int, tokens int")


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(limit_id, containers, tokens, fill): how full the containers are."""
    limits = table(spark, sf_dir, "size_limits").select("limit_id", "capacity")
    boxes = pack(spark, sf_dir).groupBy("limit_id", "container_id").agg(F.sum("tokens").alias("used"))
    return (
        boxes.groupBy("limit_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens")).join(F.broadcast(limits), "limit_id")
        .select("limit_id", "containers", "tokens", (F.col("tokens") / F.col("containers") / F.col("capacity")).alias("fill"))
    )
