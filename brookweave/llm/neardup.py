"""Problem 2: near-duplicate records, by a binary-trie self-join over bit fingerprints.

Each main body becomes the set of its distinct runs of three words, 64-bit hashed.  Records with the same set are one
class that is compared once and named by its smallest ``scrape_id``.

Candidates are complete: all runs have one order, and two sets of n and m runs at the wanted similarity share one of
their first n - ceil(0.6 n) + 1 and m - ceil(0.6 m) + 1 runs in it, whatever the order is.  It goes by the counts of a
sketch of fixed size (COUNTERS counters over all sets, broadcast), then by hash, so that common runs come last and groups
stay small; a count that is too high costs nothing but that.  Only the first runs are shuffled, by ranges of their hash:
a class sends each range its fingerprint once, with its runs there.  Classes that share a run form a sub-trie.  A class
has a fingerprint of 512 counters modulo four, in Gray code (1,024 bits), of the runs that fall on them, so two fingerprints
differ in no more bits than their sets in runs.  The first 128 bits form a binary trie per sub-trie that is joined with itself: node pairs are
traversed together, differing bits are added up, and a pair is left as soon as they exceed a quarter of the runs of both,
the most that the similarity allows.  The other bits, sizes and the places of the shared run bound the overlap further,
exactly too.

Pairs of sub-tries of up to LEAF classes are compared at once, over all of them.  A run that by its count more than BLOCK
classes may hold is split: its classes fall into blocks, and all pairs of blocks are joined in separate sub-tries that
lie in different ranges.  Pairs within the bounds are checked on the whole sets.

Defined cases: null or empty markdown and bodies under MIN_WORDS words have no pairs; repeated deliveries of a
scrape_id count once; equal bodies are pairs; ties in similarity cannot matter as every pair is listed on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .body import Bodies
from .common import cut

RUN, SIMILARITY, MIN_WORDS = 3, 0.6, 50
BITS, COUNTERS_OF_SET, FINGERPRINT = 128, 512, 1024
BLOCK, LEAF = 4096, 512
#: Counters of the sketch and of one of its rows.
COUNTERS, PART = 1 << 20, 1 << 15
#: Rows of a range of runs, pairs compared at once, and the first of the two bits that hold a side.
RANGE_ROWS, PAIRS, FLAG = 2_000_000, 1_000_000, 1 << 29

WORDS = re.compile(r"[^\W_]+")
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Shingles:
    """Distinct hashed runs of three words; one per task, as it keeps the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        import xxhash

        words = WORDS.findall(text.lower())
        if len(words) < max(RUN, MIN_WORDS):
            return len(words), np.empty(0, np.uint64)
        known = self.known
        if len(known) > 2_000_000:
            known.clear()
        h = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            v = known.get(w)
            if v is None:
                v = known[w] = xxhash.xxh64_intdigest(w)
            h[i] = v
        return len(words), np.unique(mix(mix(h[:-2] * P1 + h[1:-1] * P2) + h[2:] * P3))


def signature(runs: np.ndarray) -> tuple[bytes, int]:
    """(fingerprint, hash of the whole set)."""
    with np.errstate(over="ignore"):
        count = np.bincount((runs >> np.uint64(55)).astype(np.int64), minlength=COUNTERS_OF_SET) & 3
        # in Gray code one run more or less changes one bit
        bits = np.concatenate([(count ^ (count >> 1)) & 1, count >> 1])
        whole = mix(runs).sum(dtype=np.uint64) ^ mix(runs * P3).sum(dtype=np.uint64) * P1
    return np.packbits(bits.astype(np.uint8)).tobytes(), int(np.int64(whole.astype(np.int64)))


def prefix(n: int) -> int:
    """How many runs of a set of n two similar sets may go without a common one, and one more."""
    return n - -(-3 * n // 5) + 1


def blocked(keys: np.ndarray, left: np.ndarray, seen: np.ndarray, whole: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and lefts with those of runs that more than `block` classes may hold replaced by one per pair of blocks that
    holds the class's own; the upper bits of left tell its side in it."""
    hot = seen > block
    out_k, out_l = [keys[~hot]], [left[~hot]]
    for key, l, n in zip(keys[hot], left[hot], seen[hot]):
        blocks = -(-int(n) // block)
        own = (whole * 0x9E3779B97F4A7C15 & (1 << 64) - 1) % blocks
        other = np.arange(blocks, dtype=np.uint64)
        low, high = np.minimum(other, np.uint64(own)), np.maximum(other, np.uint64(own))
        out_k.append(mix(key + mix(low * P1 + np.uint64(1)) + mix(high * P3 + np.uint64(2))))
        out_l.append(np.uint32(l) | np.where(other == own, 0, np.where(other > own, FLAG, 2 * FLAG)).astype(np.uint32))
    return np.concatenate(out_k), np.concatenate(out_l)


def first_runs(b: pd.DataFrame, count: np.ndarray, ranges: int, block: int = BLOCK) -> pd.DataFrame:
    """(part, whole, n, bits, runs): the first runs of each set by range, as pairs of a key and the runs left from it on."""
    out: list[tuple] = []
    with np.errstate(over="ignore"):
        for whole, n, runs, bits in zip(b["whole"], b["n_runs"], b["runs"], b["bits"]):
            runs = np.asarray(runs).view(np.uint64)
            seen = count[runs & np.uint64(len(count) - 1)]
            order = np.lexsort((runs, seen))[: prefix(n)]
            keys, left = runs[order], np.arange(n, n - len(order), -1, np.uint32)
            if seen[order[-1]] > block:
                keys, left = blocked(keys, left, seen[order], whole, block)
            keys = mix(keys * P2)
            part = (keys % np.uint64(ranges)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cells = np.stack([(keys[by] >> np.uint64(32)).astype(np.uint32), left[by]], 1)
            edges = np.flatnonzero(np.r_[True, np.diff(part[by]) != 0, True]).tolist()
            out.extend((int(part[by[i]]), whole, n, bits, cells[i:j].tobytes()) for i, j in zip(edges[:-1], edges[1:]))
    return pd.DataFrame(out, columns=["part", "whole", "n", "bits", "runs"])


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sketch of a task's sets, in rows of PART counters."""
    total = np.zeros(COUNTERS, np.int64)
    for b in batches:
        runs = np.concatenate([np.zeros(0, np.int64), *b["runs"]])
        total += np.bincount(runs & (COUNTERS - 1), minlength=COUNTERS)
    rows = total.astype(np.int32).reshape(-1, PART)
    yield pd.DataFrame({"part": range(len(rows)), "counts": [r.tobytes() for r in rows]})


def _summed(b: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PART, np.int64)
    for x in b["counts"]:
        total += np.frombuffer(x, np.int32)
    return pd.DataFrame({"part": b["part"].iloc[:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def _signatures(batch: pd.DataFrame, bodies: list[list[str]]) -> pd.DataFrame:
    """The runs are given once for equal sets of a batch."""
    make, rows, seen = Shingles(), [], set()
    with np.errstate(over="ignore"):
        for sid, lines in zip(batch["scrape_id"], bodies):
            n, runs = make("\n".join(lines))
            if len(runs):
                bits, whole = signature(runs)
                rows.append((sid, n, len(runs), None if whole in seen else runs.view(np.int64), bits, whole))
                seen.add(whole)
    return pd.DataFrame(rows, columns=["scrape_id", "n_words", "n_runs", "runs", "bits", "whole"])


# ---------------------------------------------------------------- the trie


def trie_join(hi: np.ndarray, lo: np.ndarray, side: np.ndarray | None = None, budget: int = BITS, bound=None) -> np.ndarray:
    """Index pairs of fingerprints within the Hamming budget; with sides, only pairs of different sides.

    bound(x, y) tells which of the index pairs to keep.

    A node is a range of the sorted fingerprints at a depth.  Ranges of up to LEAF entries are compared directly.
    """
    order = np.lexsort((lo.view(np.uint64), hi.view(np.uint64)))
    bits = np.unpackbits(np.stack([hi[order], lo[order]], 1).astype(">i8").view(np.uint8).reshape(len(order), 16), axis=1)
    h, w = hi[order].view(np.uint64), lo[order].view(np.uint64)
    s = None if side is None else side[order]
    out = [np.zeros((0, 2), np.int64)]
    # (first node's range, second node's range, depth, differing bits so far)
    todo = [(0, len(order), 0, len(order), 0, 0)]
    while todo:
        a0, a1, b0, b1, depth, diff = todo.pop()
        if diff > budget or a0 == a1 or b0 == b1:
            continue
        if depth == BITS or max(a1 - a0, b1 - b0) <= LEAF:
            d = np.bitwise_count(h[a0:a1, None] ^ h[None, b0:b1]) + np.bitwise_count(w[a0:a1, None] ^ w[None, b0:b1])
            near = d <= budget
            if s is not None:
                near &= s[a0:a1, None] != s[None, b0:b1]
            i, j = np.nonzero(near)
            once = a0 + i < b0 + j
            i, j = i[once], j[once]
            x, y = order[a0 + i], order[b0 + j]
            if bound is not None:
                good = bound(x, y)
                x, y = x[good], y[good]
            out.append(np.stack([x, y], 1))
            continue
        am = a0 + int(np.searchsorted(bits[a0:a1, depth], 1))
        bm = b0 + int(np.searchsorted(bits[b0:b1, depth], 1))
        todo.append((a0, am, b0, bm, depth + 1, diff))
        todo.append((am, a1, bm, b1, depth + 1, diff))
        todo.append((a0, am, bm, b1, depth + 1, diff + 1))
        if (a0, a1) != (b0, b1):
            todo.append((am, a1, b0, bm, depth + 1, diff + 1))
    return np.concatenate(out)


def _allowed(fx: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """Whether two rows of a sub-trie are to meet: in one of two blocks those of different sides alone (flags 1 and 2)."""
    return (fx == 0) | (fx != fy)


class Range:
    """The classes of one range of runs, and the pairs of them that share a run within the bounds."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        parts = [b for b in batches if len(b)]
        none = {"part": np.zeros(0, np.int32), "whole": np.zeros(0, np.int64), "n": np.zeros(0, np.int32), "bits": [], "runs": []}
        df = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(none)
        # a class of several batches was sent several times
        df = df.drop_duplicates(["part", "whole"])
        self.whole = df["whole"].to_numpy()
        self.n = df["n"].to_numpy().astype(np.int64)
        self.bits = np.frombuffer(b"".join(df["bits"]), ">u8").astype(np.uint64).reshape(len(df), FINGERPRINT // 64)
        self.columns = np.ascontiguousarray(self.bits.T)
        rows = np.frombuffer(b"".join(df["runs"]), np.uint32).reshape(-1, 2)
        self.own = np.repeat(np.arange(len(df)), [len(x) // 8 for x in df["runs"]])
        order = np.argsort(rows[:, 0], kind="stable")
        self.key, self.own = rows[order, 0], self.own[order]
        self.left, self.flag = (rows[order, 1] & FLAG - 1).astype(np.int32), rows[order, 1] >> 29
        self.size = self.n[self.own].astype(np.int32)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The indices of the pairs of rows that may be similar: of n + m runs at most a quarter differ, so three eighths of
        n + m are common, of those from the shared run on in both and of those that the fingerprints allow."""
        both = self.size[x] + self.size[y]
        at = np.flatnonzero(8 * np.minimum(self.left[x], self.left[y]) >= 3 * both)
        x, y, both = x[at], y[at], both[at]
        a, b = self.own[x], self.own[y]
        d = np.zeros(len(at), np.int32)
        for half in (self.columns[: len(self.columns) // 2], self.columns[len(self.columns) // 2 :]):
            for column in half:
                d += np.bitwise_count(column[a] ^ column[b])
            keep = np.flatnonzero(4 * d <= both)
            at, x, y, a, b, d, both = (v[keep] for v in (at, x, y, a, b, d, both))
        good = (4 * d <= both) & _allowed(self.flag[x], self.flag[y]) & (self.whole[a] != self.whole[b])
        return at[good]

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The pairs of classes of the pairs of rows that may be similar, each as one number."""
        good = self.near(x, y)
        a, b = self.own[x[good]], self.own[y[good]]
        return np.unique(np.minimum(a, b) * len(self.n) + np.maximum(a, b))

    def pairs(self) -> pd.DataFrame:
        edges = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1], True]) if len(self.key) else np.zeros(1, np.int64)
        start, size = edges[:-1], np.diff(edges)
        found = [np.zeros(0, np.int64)]
        for s in np.unique(size[(size > 1) & (size <= LEAF)]).tolist():
            i, j = np.triu_indices(s, 1)
            groups = start[size == s]
            step = max(1, PAIRS // len(i))
            for k in range(0, len(groups), step):
                g = groups[k : k + step, None]
                found.append(self.codes((g + i).ravel(), (g + j).ravel()))
        for a, s in zip(start[size > LEAF].tolist(), size[size > LEAF].tolist()):
            own = self.own[a : a + s]
            side = self.flag[a : a + s] if self.flag[a : a + s].all() else None
            hi, lo = self.bits[own, 0].view(np.int64), self.bits[own, 1].view(np.int64)
            budget = min(BITS, int(self.n[own].max()) // 2)
            xy = trie_join(hi, lo, side, budget, lambda x, y, a=a: self.near(x + a, y + a)) + a
            found.append(self.codes(xy[:, 0], xy[:, 1]))
        code = np.unique(np.concatenate(found))
        x, y = self.whole[code // max(1, len(self.n))], self.whole[code % max(1, len(self.n))]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def _join_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield Range(batches).pairs()


class NearDuplicates:
    """signatures, classes and links of one table of pages."""

    def __init__(self, pages: DataFrame):
        self.bodies = Bodies(pages)
        self.signatures = cut(
            self.bodies.apply(
                [], "scrape_id bigint, n_words int, n_runs int, runs array<bigint>, bits binary, whole bigint", _signatures
            )
        )
        s = self.signatures
        self.classes = s.groupBy("whole", "n_runs").agg(
            F.min("scrape_id").alias("rep"), F.max("scrape_id").alias("last"), F.first("bits").alias("bits")
        )
        self.members = s.select("scrape_id", "whole", "n_runs").distinct().join(
            self.classes.filter("rep <> last").select("whole", "n_runs", "rep"), ["whole", "n_runs"]
        ).select("scrape_id", "rep")

    def candidates(self) -> DataFrame:
        """(a, b), a < b by the hash of the set: all pairs of classes that may be similar."""
        sets = self.signatures.filter("runs is not null").select("whole", "n_runs", "runs", "bits")
        parts = sets.select("runs").mapInPandas(_counts, "part int, counts binary").groupBy("part").applyInPandas(_summed, "part int, counts binary").collect()
        counts = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r["counts"], np.int32) for r in sorted(parts, key=lambda r: r["part"]))])
        sketch = sets.sparkSession.sparkContext.broadcast(counts)  # COUNTERS counters
        rows = sets.agg(F.sum(F.col("n_runs") - F.ceil(F.col("n_runs") * 3 / F.lit(5)) + 1)).first()[0] or 0
        ranges = max(2 * sets.sparkSession.sparkContext.defaultParallelism, -(-int(rows) // RANGE_ROWS))

        def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield first_runs(b, sketch.value, ranges)

        rows = sets.mapInPandas(firsts, "part int, whole bigint, n int, bits binary, runs binary").repartitionById(ranges, "part")
        return rows.mapInPandas(_join_ranges, "a bigint, b bigint").distinct()

    def links(self) -> DataFrame:
        """(a, b, similarity) of the representatives that are similar enough, checked on the whole sets."""
        pairs = cut(self.candidates())
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("whole")).distinct()
        sets = self.signatures.filter("runs is not null").select("whole", "runs").join(wanted, "whole", "left_semi").dropDuplicates(["whole"])
        sets = sets.join(self.classes.select("whole", "rep"), "whole")
        both = pairs.join(sets.select(F.col("whole").alias("a"), F.col("runs").alias("ra"), F.col("rep").alias("x")), "a").join(
            sets.select(F.col("whole").alias("b"), F.col("runs").alias("rb"), F.col("rep").alias("y")), "b"
        )
        common = F.size(F.array_intersect("ra", "rb"))
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (common / (F.size("ra") + F.size("rb") - common)).alias("similarity")).filter(
            F.col("similarity") >= SIMILARITY - 1e-12
        )

    def membership(self) -> DataFrame:
        """(scrape_id, class_id, copies, links): one row per record; links counts its similar classes."""
        links = self.links()
        n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        size = self.signatures.select("scrape_id", "whole", "n_runs").distinct().groupBy("whole", "n_runs").agg(
            F.min("scrape_id").alias("rep"), F.count(F.lit(1)).alias("copies")
        )
        return (
            self.signatures.select("scrape_id", "whole", "n_runs").distinct().join(size, ["whole", "n_runs"]).join(n, "rep", "left")
            .select("scrape_id", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
        )

    def groups(self) -> DataFrame:
        """(scrape_id, class_id, group_id): connected groups by the smallest id, over the links of classes."""
        edges = cut(self.links().select("a", "b"))
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = edges.select(F.col("a").alias("rep")).distinct().withColumn("group_id", F.col("rep"))
        while True:
            near = edges.join(label, edges["b"] == label["rep"]).groupBy("a").agg(F.min("group_id").alias("g"))
            step = label.join(near, label["rep"] == near["a"], "left").select(
                "rep", F.least("group_id", F.coalesce("g", "group_id")).alias("to"), "group_id"
            )
            # pointer jumping: take the label of the label, so that long chains take few rounds
            up = step.select(F.col("rep").alias("to"), F.col("to").alias("top"))
            step = cut(step.join(up, "to", "left").select("rep", F.least("to", F.coalesce("top", "to")).alias("new"), "group_id"))
            changed = step.filter("new <> group_id").limit(1).count()
            label = step.select("rep", F.col("new").alias("group_id"))
            if not changed:
                break
        rows = self.membership()
        return rows.join(label, rows["class_id"] == label["rep"], "left").select(
            "scrape_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id")
        )

    def pairs(self) -> DataFrame:
        """(scrape_id_a, scrape_id_b), a < b: all pairs of records, those within a class of equal bodies included."""
        links = self.links().select("a", "b")
        m = self.members
        left = links.join(m.select(F.col("rep").alias("a"), F.col("scrape_id").alias("x")), "a", "left")
        both = left.join(m.select(F.col("rep").alias("b"), F.col("scrape_id").alias("y")), "b", "left").select(
            F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")
        )
        same = m.select("rep", F.col("scrape_id").alias("x")).join(m.select("rep", F.col("scrape_id").alias("y")), "rep").filter("x < y").select("x", "y")
        return both.unionByName(same).select(F.least("x", "y").alias("scrape_id_a"), F.greatest("x", "y").alias("scrape_id_b")).distinct()
