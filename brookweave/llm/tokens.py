"""Problem 8: encoding of the corpus with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern (JVM regular expression).  Each distinct word of a text is encoded
by a fold over its byte array: every step looks up the rank of each adjacent pair in a literal rank map, takes the
smallest and merges its occurrences from left to right, until no pair has a rank.  The rank map is a perfect hash laid
out in literal arrays, so that a lookup is two array reads.  Between the steps a word is a string of one character per
token, so that a merge is one replacement.  The words of a bounded sample (HOT_WORDS of SAMPLE_ROWS texts) are encoded
once by the same fold and looked up in the same way; all others are folded where they occur, so the sample decides about
speed alone.  Words over LONG bytes (sequences without any blank, some 20,000 bytes each), for which the fold's
quadratic time would not do, are encoded in the Python worker by a heap-based library with the same ranks; the ranks
reach the workers by broadcast.

Defined cases: null and empty text give an empty list; blank text is encoded like any other; strings that look like
special tokens are ordinary text.  Decoding concatenates the tokens' binary pieces.
"""

from __future__ import annotations

import base64
import json
import os
from functools import cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import bounded_sample

SAMPLE_ROWS, HOT_WORDS, LONG = 3000, 65_536, 96
#: Fixed value: the vocabulary's word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(path: str | None = None) -> str:
    """The rank file: an argument, BROOKWEAVE_VOCABULARY, or the machine's folder of public tokenizers."""
    return path or os.environ.get("BROOKWEAVE_VOCABULARY") or os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


load_ranks = cache(read_ranks)


@cache
def merges(path: str) -> list[tuple[int, int, int]]:
    """(left id, right id, merged id): the pair of smaller tokens that each token is merged of."""
    ranks = load_ranks(path)
    out = []
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((ranks[parts[0]], ranks[parts[1]], rank))
    return out


# ---------------------------------------------------------------- literal perfect-hash maps


def _literal(values, kind: str) -> Column:
    """A constant array; the optimizer folds the parsing of the text into one literal."""
    return F.split(F.lit("\x1f".join(map(str, values))), "\x1f").cast(f"array<{kind}>")


class LiteralMap:
    """hash (64 bits, as xxhash64 gives it) -> slot, by hash and displace; slots hold keys and values."""

    def __init__(self, hashes: list[int]):
        n = max(1, len(hashes))
        self.m = n * 4 // 3 + 8
        self.r = n // 3 + 1
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.r, []).append(i)
        # the first cut of the hash that tells the keys of every group apart
        for self.cut in range(8, 44):
            base = [(h >> self.cut) % self.m for h in hashes]
            if all(len({base[i] for i in items}) == len(items) for items in groups.values()):
                break
        else:
            raise ValueError("two keys have the same hash")
        self.slot = [0] * len(hashes)
        self.shift = [0] * self.r
        used = bytearray(self.m)
        for g, items in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            d = 0
            while any(used[(base[i] + d) % self.m] for i in items):
                d += 1
            self.shift[g] = d
            for i in items:
                self.slot[i] = (base[i] + d) % self.m
                used[self.slot[i]] = 1
        self.shifts = _literal(self.shift, "int")

    def at(self, h: Column) -> Column:
        return F.pmod(F.shiftright(h, self.cut) + F.get(self.shifts, F.pmod(h, F.lit(self.r)).cast("int")), F.lit(self.m)).cast("int")

    def spread(self, values: list, empty) -> list:
        out = [empty] * self.m
        for s, v in zip(self.slot, values):
            out[s] = v
        return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def hash_long(x: int) -> int:
    return _signed(xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), 42))


def hash_text(x: str) -> int:
    return _signed(xxhash.xxh64_intdigest(x.encode(), 42))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Between the steps of the fold a token is the character of this offset and its id.
BASE = 0x1000


class Bpe:
    """The encoder's expressions for one vocabulary."""

    def __init__(self, path: str | None = None):
        self.path = vocabulary_path(path)
        self.ranks = load_ranks(self.path)
        made = merges(self.path)
        self.wide = 1 << max(len(self.ranks), 2).bit_length()
        keys = [a * self.wide + b for a, b, _ in made]
        self.map = LiteralMap([hash_long(k) for k in keys])
        self.keys = _literal(self.map.spread(keys, -1), "bigint")
        self.merged = _literal(self.map.spread([m for _, _, m in made], -1), "int")
        n = max(self.ranks.values()) + 1
        if BASE + n > 0xD800:
            raise ValueError("the vocabulary has more ids than the fold has characters")
        pairs = [""] * n
        for x, y, m in made:
            pairs[m] = chr(BASE + x) + chr(BASE + y)
        self.pairs, self.chars = _literal(pairs, "string"), _literal([chr(BASE + i) for i in range(n)], "string")
        self.bytes = _literal([chr(BASE + self.ranks[bytes([i])]) for i in range(256)], "string")
        self.hot: LiteralMap | None = None

    # -------- the fold

    def _least(self, ids: Column) -> Column:
        """The least rank of adjacent pairs, which is the merged id; null where no pair has one."""
        k = F.size(ids) - 1
        keys = F.zip_with(F.slice(ids, F.lit(1), k), F.slice(ids, F.lit(2), k), lambda a, b: a.cast("bigint") * F.lit(self.wide) + b)

        def ranks(keys: Column) -> Column:
            at = F.transform(F.transform(keys, lambda x: F.xxhash64(x)), self.map.at)
            return F.array_min(F.zip_with(keys, at, lambda x, s: F.when(F.get(self.keys, s) == x, F.get(self.merged, s))))

        return F.when(k > 0, _let(keys, ranks))

    def fold(self, word: Column) -> Column:
        """ids of a word that is not empty."""
        ids = lambda s: F.transform(F.split(s, ""), lambda c: F.ascii(c) - BASE)
        raw = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        start = F.array_join(F.transform(raw, lambda c: F.get(self.bytes, F.ascii(c))), "")
        state = lambda s, done: F.struct(s.alias("s"), F.lit(done).alias("done"))

        def step(st: Column, _: Column) -> Column:
            s = st["s"]
            merged = _let(self._least(ids(s)), lambda m: F.when(m.isNull(), state(s, True)).otherwise(state(F.replace(s, F.get(self.pairs, m), F.get(self.chars, m)), False)))
            return F.when(st["done"], st).otherwise(merged)

        return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), state(start, False), step, lambda st: ids(st["s"]))

    # -------- texts

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))

    def warm(self, docs: DataFrame, text: str = "text") -> Bpe:
        """Encode the frequent words of a bounded sample and keep them as a literal map."""
        key = next(c for c in docs.columns if c != text)
        some = bounded_sample(docs, key, SAMPLE_ROWS).filter(F.length(text) > 0)
        count = some.select(F.explode(self.words(F.col(text))).alias("w")).groupBy("w").count()
        top = count.filter(F.octet_length("w") <= LONG).orderBy(F.desc("count"), "w").limit(HOT_WORDS)
        rows = top.repartition(16).select("w", self.fold(F.col("w")).alias("ids")).collect()
        words = sorted((r["w"], list(r["ids"])) for r in rows if "\x1f" not in r["w"])
        if words:
            self.hot = LiteralMap([hash_text(w) for w, _ in words])
            self.hot_words = _literal(self.hot.spread([w for w, _ in words], ""), "string")
            self.hot_ids = F.from_json(F.lit(json.dumps(self.hot.spread([i for _, i in words], []), separators=(",", ":"))), "array<array<int>>")
            self.hot_sizes = _literal(self.hot.spread([len(i) for _, i in words], 0), "int")
        return self

    def _long(self, docs: DataFrame):
        ranks = docs.sparkSession.sparkContext.broadcast(self.ranks)  # one vocabulary
        made = []

        @F.pandas_udf(ArrayType(ArrayType(IntegerType())))
        def encode(words: pd.Series) -> pd.Series:
            if not made and any(len(ws) for ws in words):
                made.append(library(ranks.value))
            return words.map(lambda ws: [made[0].encode_ordinary(w) for w in ws])

        return encode

    def parts(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with _w (words), _at (slot of a hot word or -1), _rare and _long with their ids _rids and _lids."""
        none = F.array().cast("array<string>")
        d = docs.withColumn("_w", F.when(F.length(text) > 0, self.words(F.col(text))).otherwise(none))
        if self.hot is None:
            d = d.withColumn("_at", F.transform("_w", lambda w: F.lit(-1)))
        else:
            slots = F.transform(F.transform("_w", lambda w: F.xxhash64(w)), self.hot.at)
            d = d.withColumn("_at", F.zip_with("_w", slots, lambda w, s: F.when(F.get(self.hot_words, s) == w, s).otherwise(-1)))
        rest = F.array_distinct(F.filter(F.zip_with("_w", "_at", lambda w, s: F.when(s < 0, w)), lambda w: w.isNotNull()))
        d = d.withColumn("_rest", F.when(F.array_contains("_at", F.lit(-1)), rest).otherwise(none))
        d = d.withColumn("_rare", F.filter("_rest", lambda w: F.octet_length(w) <= LONG)).withColumn("_long", F.filter("_rest", lambda w: F.octet_length(w) > LONG)).drop("_rest")
        d = d.withColumn("_rids", F.transform("_rare", self.fold))
        return d.withColumn("_lids", self._long(docs)(F.col("_long")))

    def _cold(self, w: Column) -> Column:
        # two references each keep the folds out of this lambda, where the optimizer would repeat them for every word
        short = F.when(F.size("_rids") > 0, F.get(F.col("_rids"), (F.array_position("_rare", w) - 1).cast("int")))
        return F.coalesce(short, F.when(F.size("_lids") > 0, F.get(F.col("_lids"), (F.array_position("_long", w) - 1).cast("int"))))

    def _each(self, hot, cold) -> Column:
        """hot(slot) or cold(word) of each word; a text of hot words alone takes the shorter way."""
        mixed = F.zip_with("_w", "_at", lambda w, s: F.when(s >= 0, hot(s)).otherwise(cold(w)))
        return F.when((F.size("_rare") == 0) & (F.size("_long") == 0), F.transform("_at", hot)).otherwise(mixed)

    def ids(self) -> Column:
        return F.flatten(self._each((lambda s: F.get(self.hot_ids, s)) if self.hot else (lambda s: F.lit(None).cast("array<int>")), self._cold))

    def sizes(self) -> Column:
        """The number of tokens of each word."""
        return self._each((lambda s: F.get(self.hot_sizes, s)) if self.hot else (lambda s: F.lit(0)), lambda w: F.size(self._cold(w)))

    def decode(self, ids: Column) -> Column:
        pieces = [""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            pieces[i] = token.hex()
        table = _literal(pieces, "string")
        return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")


def library(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids)."""
    docs = docs.select("doc_id", "text")
    bpe = Bpe(path).warm(docs)
    return bpe.parts(docs).select("doc_id", bpe.ids().alias("ids"))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with tokens, the number of tokens of text."""
    bpe = Bpe(path).warm(docs.select("doc_id", "text"))
    names = docs.columns
    return bpe.parts(docs).select(*names, F.aggregate(bpe.sizes(), F.lit(0), lambda a, x: a + x).alias("tokens"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens, same): whether the decoded ids give the text again."""
    docs = docs.select("doc_id", "text")
    bpe = Bpe(path).warm(docs)
    d = bpe.parts(docs).select("doc_id", "text", bpe.ids().alias("ids"))
    return d.select("doc_id", F.size("ids").alias("tokens"), (bpe.decode(F.col("ids")) == F.coalesce("text", F.lit(""))).alias("same"))
