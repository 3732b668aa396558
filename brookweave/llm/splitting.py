"""Problem 10: pieces of oversized documents, cut at natural boundaries by dynamic programming.

The boundaries of a text (claims, paragraphs, sentences, words) have token positions and a penalty by kind.  A piece
ends at a boundary and the next one begins `overlap` tokens before it, so both share exactly these tokens.  The program
over the boundaries minimises the sum of cut penalties and squared deviations from an even size, under the capacity.
Claims, paragraphs and sentences are all candidates; where two of them lie more than half a piece apart every word
boundary between them is one as well, and where a word itself is longer than that (a sequence without any blank) the
positions at each half piece inside it.  Texts are sized by the tokenizer's library in the worker that cuts them, since
a cut needs the bytes of every token, so a text travels once and pieces are slices of its bytes.

Defined cases: null and empty texts and those within the capacity have no pieces here (they stay whole); a text without
any boundary is cut by tokens; a capacity not above its overlap is an error; a first character of which the overlap
holds the end alone is left out of `text`, never of the tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import PATTERN, library, load_ranks, vocabulary_path

#: Kinds of cuts and their penalties.
KINDS = ("claim", "paragraph", "sentence", "word", "token")
PENALTY = np.array([0.0, 0.6, 2.0, 8.0, 30.0])
UNEVEN, PIECE = 6.0, 1.0
#: Characters of output that a worker holds before it gives them away.
OUT_CHARS = 4_000_000
#: Ends of pieces whose deviations are computed together.
ROWS = 256

#: A sentence's or a line's end; a line's end may be that of a paragraph or come before a claim.
MARK = re.compile(r"([.!?…;](?=[\s\"'”’)])|[。！？；])|\r\n?|\n|[\u2028\u2029]+")
CLAIM = re.compile(r"[ \t]*(?:\(?\d{1,3}\s?[.)．、]\s|claim \d|\[?請求項|权利要求)", re.I)
WORD = regex.compile(PATTERN)
PARAGRAPH = re.compile(r"(?:[ \t]*(?:\r\n?|\n))+|(?=[ \t]*(?:\[\d{2,5}\]|【))")


def marks(text: str) -> tuple[list[int], list[int]]:
    """(ends, kinds) of the marks of a text, in order."""
    at, kinds = [], []
    for m in MARK.finditer(text):
        end, kind = m.end(), 2
        if m[1] is None:
            if text[end - 1] in "\u2028\u2029":
                kind = 1
            else:
                if CLAIM.match(text, end):
                    kind = 0
                else:
                    blank = PARAGRAPH.match(text, end)
                    if blank:
                        end, kind = blank.end(), 1
                        if CLAIM.match(text, end):
                            kind = 0
        at.append(end)
        kinds.append(kind)
    return at, kinds


class Text:
    """A text with its tokens' ends in bytes; token position k is the one after k tokens."""

    def __init__(self, text: str, sizes: np.ndarray):
        self.text, self.raw = text, text.encode("utf-8", "surrogatepass")
        self.ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.total = len(sizes)
        self.starts = None if len(self.raw) == len(text) else np.append(np.flatnonzero((np.frombuffer(self.raw, np.uint8) & 0xC0) != 0x80), len(self.raw))

    def at(self, chars) -> np.ndarray:
        """The byte offsets of character offsets."""
        chars = np.asarray(chars, np.int64)
        return chars if self.starts is None else self.starts[chars]

    def boundaries(self) -> tuple[np.ndarray, np.ndarray]:
        """(token positions, kinds) of the marks, in order and each position once with its best kind."""
        chars, kinds = marks(self.text)
        # a mark inside a token (a line break before blanks) moves to the token's end
        pos = np.searchsorted(self.ends, self.at(chars))
        best = np.full(self.total + 1, 9, np.int8)
        np.minimum.at(best, pos, np.asarray(kinds, np.int8))
        pos = np.flatnonzero(best < 9)
        return pos, best[pos]

    def words(self, a: int, b: int) -> np.ndarray:
        """Token positions between a and b at which words end."""
        low, high = int(self.ends[a]), int(self.ends[b])
        part = self.raw[low:high].decode("utf-8", "ignore")
        sizes = np.fromiter((len(m[0].encode("utf-8", "surrogatepass")) for m in WORD.finditer(part)), np.int64)
        at = low + np.cumsum(sizes)
        pos = np.searchsorted(self.ends, at)
        pos = pos[(pos < len(self.ends)) & (self.ends[np.minimum(pos, self.total)] == at)]
        return pos[(pos > a) & (pos < b)]

    def piece(self, a: int, b: int) -> str:
        return self.raw[int(self.ends[a]) : int(self.ends[b])].decode("utf-8", "ignore")


def candidates(text: Text, pos: np.ndarray, kind: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with kinds such that no two neighbours lie further apart than room // 2; the ends are among them."""
    total, step = text.total, max(1, room // 2)
    inside = (pos > 0) & (pos < total)
    pos, kind = pos[inside], kind[inside]
    edge = np.concatenate([[0], pos, [total]])
    wide = np.flatnonzero(np.diff(edge) > step)
    if not len(wide):
        return edge, np.concatenate([[0], kind, [0]])
    out_p, out_k = [pos], [kind]
    for i in wide.tolist():
        a, b = int(edge[i]), int(edge[i + 1])
        words = text.words(a, b)
        out_p.append(words)
        out_k.append(np.full(len(words), 3, np.int8))
        inner = np.concatenate([[a], words, [b]])
        for j in np.flatnonzero(np.diff(inner) > step).tolist():
            tokens = np.arange(int(inner[j]) + step, int(inner[j + 1]), step)
            out_p.append(tokens)
            out_k.append(np.full(len(tokens), 4, np.int8))
    p, k = np.concatenate(out_p), np.concatenate(out_k)
    order = np.argsort(p, kind="stable")
    return np.concatenate([[0], p[order], [total]]), np.concatenate([[0], k[order], [0]])


def cuts(pos: np.ndarray, kind: np.ndarray, capacity: int, overlap: int) -> list[int]:
    """Indices into pos at which pieces end, the last one included."""
    total = int(pos[-1])
    room = capacity - overlap
    n = max(1, -(-(total - overlap) // room))
    target = (total - overlap) / n
    pay = PENALTY[kind]
    pay[-1] = 0.0
    # in units of room: the deviation of a piece from the even size is x[j] - x[i] - even
    x, even = pos / room, target / room
    cost = np.full(len(pos), np.inf)
    back = [0] * len(pos)
    cost[0] = 0.0
    low = np.searchsorted(pos, pos - room).tolist()
    fits = int(np.searchsorted(pos, capacity, side="right"))
    add = (pay + PIECE).tolist()
    at = (x - even).tolist()
    for top in range(1, len(pos), ROWS):
        # the deviations of ROWS ends from all starts within reach, at once
        end, base = min(top + ROWS, len(pos)), low[top]
        dev = (x[None, base:end] - np.asarray(at[top:end])[:, None]) ** 2 * UNEVEN
        for j in range(top, end):
            i = low[j]
            c = dev[j - top, i - base : j - base] + cost[i:j]
            m = int(c.argmin())
            least = float(c[m])
            m += i
            if i and j < fits:
                # the first piece has no overlap and may use the whole capacity
                c0 = UNEVEN * (at[j] - overlap / room) ** 2
                if c0 <= least:
                    least, m = c0, 0
            cost[j] = least + add[j]
            back[j] = m
    out = []
    j = len(pos) - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def pieces(text: str, sizes: np.ndarray, limits: list[tuple[int, int, int]]) -> Iterator[tuple]:
    """(limit_id, piece_no, start_token, end_token, cut, text) of each piece, for every limit that the text exceeds; sizes
    are the bytes of its tokens."""
    limits = [x for x in limits if len(sizes) > x[1]]
    if not limits:
        return
    whole = Text(text, sizes)
    pos0, kind0 = whole.boundaries()
    for limit_id, capacity, overlap in limits:
        pos, kind = candidates(whole, pos0, kind0, capacity - overlap)
        at = 0
        for no, j in enumerate(cuts(pos, kind, capacity, overlap)):
            end = int(pos[j])
            start = max(0, at - overlap) if no else 0
            yield limit_id, no, start, end, "end" if j == len(pos) - 1 else KINDS[kind[j]], whole.piece(start, end)
            at = end


def split(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, limit_id, piece_no, start_token, end_token, cut, text)."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    rows = table(spark, sf_dir, "size_limits").filter("purpose = 'piece'").orderBy("limit_id").collect()  # fixed
    limits = [(r["limit_id"], r["capacity"], r["overlap"]) for r in rows]
    if any(c <= o for _, c, o in limits):
        raise ValueError("a piece must be larger than its overlap")
    least = min((c for _, c, _ in limits), default=0)
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary_path(path)))  # one vocabulary
    # a token has at least one byte, so shorter texts are within every limit
    d = docs.filter(F.octet_length("text") > least)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("limit_id", pa.int32()), ("piece_no", pa.int32()), ("start_token", pa.int32()), ("end_token", pa.int32()), ("cut", pa.string()), ("text", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library(ranks.value)
        bytes_of = np.zeros(max(ranks.value.values()) + 1, np.int64)
        for token, i in ranks.value.items():
            bytes_of[i] = len(token)

        def give(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, text = doc.as_py(), text.as_py()
                for p in pieces(text, bytes_of[encoder.encode_ordinary(text)], limits):
                    rows.append((doc, *p))
                    held += len(p[-1])
                if held > OUT_CHARS:
                    yield give(rows)
                    rows, held = [], 0
            if rows:
                yield give(rows)

    return d.mapInArrow(run, "doc_id bigint, limit_id int, piece_no int, start_token int, end_token int, cut string, text string")
