"""Best-fit packing of token sequences by large-item matching.

Pieces of one length are interchangeable, so the packing is computed over the histogram of lengths (at most
``capacity`` rows, whatever the corpus) and is the exact packing of the whole corpus:

1. Pieces longer than a third of the capacity meet at most twice in a bin. The longest is matched greedily
   with the longest other one that still fits.
2. Shorter pieces, longest first, each go to the bin with the least sufficient gap, or open a new one.

Both steps move whole runs of equal bins at once. The result is a short table of runs: the pieces of length L
with ranks from..to lie in bins from..to at an offset. Ranks come from counts by (partition, length).
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, remembers, short_batches, turn_to, written

#: Chunks of text whose ids a worker remembers since it last began anew; those of the time before are kept as well.
REMEMBERED = 250_000
#: The ranks at which tasks begin, by length, are broadcast up to this many bytes (2,000 tasks of 2,048 lengths), so that
#: no piece is shuffled; beyond, they are joined by shuffle.
BROADCAST_BYTES = 32 << 20


class WordIds:
    """Token ids of whole texts, by the tokenizer's own library, with the ids of white-space-free chunks remembered.

    The normalizer and splitter that this knows (STEPS) never join characters across white space, so a text's ids
    are those of its chunks in a row. Texts with special tokens' strings, with letters whose lower case depends on
    what is around them or composes anew, and all texts of a vocabulary with other steps go to the library whole.
    """

    STEPS = {"normalizer": ["NFC", "Replace", "Lowercase"], "pre_tokenizer": ["Split", "ByteLevel"]}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = {k: [x["type"] for x in (made[k] or {}).get(v, [])] for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))}
        self.by_chunk = steps == self.STEPS and made["post_processor"] is None and made["model"]["type"] == "BPE"
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]
        self.bytes_as = {b: 256 + k for k, b in enumerate(moved)}

    def _ids(self, chunk: str) -> bytes:
        if chunk.isalpha():
            ids = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.bytes_as))]
        elif chunk[-1] in ".," and chunk[:-1].isalpha():
            return self.of_chunk(chunk[:-1]) + self.of_chunk(chunk[-1])
        else:
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def of_chunk(self, chunk: str) -> bytes:
        found = self.known.get(chunk)
        if found is None:
            found = self.before.get(chunk)
            found = self.known[chunk] = self._ids(chunk) if found is None else found
        return found

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        nfc = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        low = nfc.lower()
        if not self.by_chunk or "<|" in text or "Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", low):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = low.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            if len(known) > REMEMBERED:
                self.before, self.known = known, {"": b""}
            return b"".join(map(self.of_chunk, chunks))


_LOADED: dict[str, WordIds] = {}
remembers("packing", _LOADED.clear)


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian u32), part, rank: the pieces to be packed.

    A document is its ids and then ``end_id``; only one longer than ``capacity`` is cut, into pieces of that
    length, the last may be shorter. A null text is empty: one piece of one id. ``part`` numbers the task and
    ``rank`` the piece among those of its length there. The rows are written, so both stay as they are.
    """
    short_batches(docs.sparkSession)

    def run(batches):
        turn_to("packing")
        ids_of, part = word_ids(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "rank")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    length = len(cut) // 4
                    for k, v in zip(out, (doc_id, piece, at // 4, length, cut, seen[length]), strict=True):
                        out[k].append(v)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                    pa.array(out["length"], pa.int64()), pa.array(out["ids"], pa.binary()),
                    pa.array([part] * len(out["piece"]), pa.int32()), pa.array(out["rank"], pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids", "part", "rank"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return written(
        narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, part int, rank long"), "pieces"
    )


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset of the first in a bin), and the bins used.

    counts: pieces by length, 1 to ``capacity``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> runs [first bin, bins]
    bins = 0

    def put(length: int, pieces: int, first: int, a_bin: int, offset: int) -> None:
        runs.append((length, taken[length], pieces, first, a_bin, offset))
        taken[length] += pieces
        left[length] -= pieces

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            m = left[a]
            put(a, m, bins, 1, 0)
            gaps[capacity - a].append([bins, m])
        else:
            b = large[at]
            m = left[a] // 2 if a == b else min(left[a], left[b])
            if m == 0:  # the last one of its length: the next shorter partner, if any
                at -= 1
                b, m = (large[at], 1) if at >= 0 else (0, 1)
            put(a, m, bins, 1, 0)
            if b:
                put(b, m, bins, 1, a)
            gaps[capacity - a - b].append([bins, m])
        bins += m
        large = [n for n in large if left[n]]

    open_gaps = sorted(g for g in gaps if gaps[g])
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                gap = capacity
                each = gap // length
                new = max(1, left[length] // each)
                gaps[gap].append([bins, new])
                bins += new
                insort(open_gaps, gap)
            else:
                gap = open_gaps[at]
            first, n = gaps[gap][-1]
            each = gap // length
            m = min(n, left[length] // each)
            if m == 0:
                m, each = 1, left[length]
            put(length, m * each, first, each, capacity - gap)
            if m == n:
                gaps[gap].pop()
            else:
                gaps[gap][-1] = [first + m, n - m]
            rest = gap - each * length
            if rest:
                if not gaps[rest]:
                    insort(open_gaps, rest)
                gaps[rest].append([first, m])
            if not gaps[gap]:
                open_gaps.remove(gap)
    return runs, bins


def _before(counted: DataFrame, parts: int, capacity: int) -> np.ndarray:
    """How many pieces of a length the parts before have: a row for each part, a column for each length."""
    got = counted.toArrow()
    n = np.zeros((parts, capacity + 1), np.int64)
    n[got.column("part").to_numpy(), got.column("length").to_numpy()] = got.column("n").to_numpy()
    return np.cumsum(n, axis=0) - n


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (with part, rank, length: see token_pieces) with sequence_id and offset in place of part and rank.

    The driver gets one row for each length, and the counts by (part, length) if a table of them is to be broadcast.
    Beyond that they are joined on both columns, so no length gathers in one task.
    """
    counted = pieces.groupBy("part", "length").agg(F.max("rank").alias("top"))
    counted = written(counted.select("part", F.col("length").cast("int").alias("length"), (F.col("top") + 1).alias("n")), "lengths")
    counts = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("n")).collect()}
    runs, _ = plan(counts, capacity)
    runs.sort()
    firsts: dict[int, tuple[int, int]] = {}
    for k, run in enumerate(runs):
        firsts[run[0]] = (firsts.get(run[0], (k, k))[0], k + 1)
    table = np.array(runs, np.int64).reshape(-1, 6)
    parts = (counted.agg(F.max("part")).first()[0] or 0) + 1
    base, before = fresh(pieces, "_base"), None
    if 8 * parts * (capacity + 1) <= BROADCAST_BYTES:
        before = pieces.sparkSession.sparkContext.broadcast(_before(counted, parts, capacity))
        based = pieces.withColumn(base, F.col("part"))
    else:
        earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(base))
        based = pieces.join(bases.hint("merge"), ["part", "length"])
    at = fresh(pieces, "_at")

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def found(length: pa.Array, rank: pa.Array, base: pa.Array) -> pa.Array:
        turn_to("packing")
        n, r, b = (x.to_numpy(zero_copy_only=False) for x in (length, rank, base))
        r = r + (b if before is None else before.value[b, n])
        row = np.empty(len(n), np.int64)
        for one in np.unique(n):
            lo, hi = firsts[int(one)]
            here = n == one
            row[here] = lo + np.searchsorted(table[lo:hi, 1], r[here], side="right") - 1
        run = table[row]
        nth = r - run[:, 1]
        return pa.StructArray.from_arrays(
            [pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * n)], ["sequence_id", "offset"]
        )

    placed = based.withColumn(at, found(F.col("length"), F.col("rank"), F.col(base)))
    own = [c for c in pieces.columns if c not in ("part", "rank")]
    return placed.select(*own, F.col(f"{at}.sequence_id").alias("sequence_id"), F.col(f"{at}.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: every piece with its ids and its place.

    Sequences are gapless from offset 0 and hold at most ``capacity`` ids. Null doc_ids and repeated rows are
    packed like any other; an empty table gives an empty one.
    """
    return place(token_pieces(docs, tokenizer, capacity, end_id), capacity)


def op4_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = token_pieces(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
