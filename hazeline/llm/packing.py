"""Operator 8: best-fit packing of token sequences by large-item matching.

Packing depends on lengths alone, and there are at most ``capacity`` of them.
So the plan is made from the histogram of lengths, in runs of equal bins, and
its size is bounded by the capacity, not by the corpus. Each document then
finds its own place from its length and its rank among documents of that
length; ranks come from counts by (length, bucket), so no group of equal
lengths meets in one task.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazeline.llm.runtime import plain, restored, spool

CAPACITY = 2048
#: The id that ends each document.
END = 0
#: Rows that one (length, bucket) group should hold.
BUCKET_ROWS = 4096


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Bins for ``counts`` items of each length: runs (length, first rank, items, first bin, offset, items a bin).

    Items above a third of the capacity meet at most in pairs: the longest left
    takes the longest that still fits beside it. Smaller ones, longest first,
    go to the tightest gap that holds them; what fits nowhere opens new bins.
    A run of n items from rank r lies in bins b, b+1, ... with k items in each,
    one after another from the offset.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room -> [(first bin, bins)]
    bins = 0

    def put(n: int, items: int, first: int, offset: int, each: int) -> None:
        runs.append((n, used[n], items, first, offset, each))
        used[n] += items
        left[n] -= items

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        fits = bisect.bisect_right(large, capacity - a)
        b = large[fits - 1] if fits else 0
        if not b:
            c = left[a]
            put(a, c, bins, 0, 1)
            room = capacity - a
        elif b == a:
            c = left[a] // 2
            if c:
                put(a, 2 * c, bins, 0, 2)
                room = capacity - 2 * a
            else:  # one is left: it takes the next that fits
                large.pop(fits - 1)
                b = large[fits - 2] if fits > 1 else 0
                c = 1
                put(a, 1, bins, 0, 1)
                room = capacity - a - b
                if b:
                    put(b, 1, bins, a, 1)
        else:
            c = min(left[a], left[b])
            put(a, c, bins, 0, 1)
            put(b, c, bins, a, 1)
            room = capacity - a - b
        if room:
            gaps.setdefault(room, []).append((bins, c))
        bins += c
        large = [n for n in large if left[n]]

    rooms = sorted(gaps)
    for n in sorted((n for n in left if 3 * n <= capacity and left[n]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):  # new bins
                each = capacity // n
                full, rest = divmod(left[n], each)
                for c, k in ((full, each), (1 if rest else 0, rest)):
                    if c:
                        put(n, c * k, bins, 0, k)
                        if room := capacity - k * n:
                            if room not in gaps:
                                bisect.insort(rooms, room)
                            gaps.setdefault(room, []).append((bins, c))
                        bins += c
                break
            room = rooms[at]
            first, c = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], rooms[at]
            each = room // n
            full = min(c, left[n] // each)
            take, k = (full, each) if full else (1, left[n])
            put(n, take * k, first, capacity - room, k)
            for where, bins_there, free in ((first, take, room - k * n), (first + take, c - take, room)):
                if bins_there and free:
                    if free not in gaps:
                        bisect.insort(rooms, free)
                    gaps.setdefault(free, []).append((where, bins_there))
    return runs


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


_tokenizers: dict = {}


def token_ids(path: str):
    """A function from a text to its ids as uint32, for a ``tokenizers`` file of a byte-level BPE, without special tokens added.

    A text that spells one of the file's added tokens, such as <|endoftext|>,
    is encoded by ``tokenizers`` itself, which takes them for what they are. For
    all others the file's merges run in ``tiktoken``, which gives the same ids in
    a fifth of the CPU time (tests hold them against each other).
    """
    key = path, os.stat(path).st_mtime_ns
    if key not in _tokenizers:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        added = [t.content for t in whole.get_added_tokens_decoder().values()]
        shown = _byte_signs()
        vocab = whole.get_vocab(with_added_tokens=False)
        ranks = {bytes(shown[c] for c in token): i for token, i in vocab.items() if token not in added and all(c in shown for c in token)}
        enc = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            special = any(t in text for t in added)
            return np.asarray(whole.encode(text, add_special_tokens=False).ids if special else enc.encode_ordinary(text), np.uint32)

        _tokenizers.clear()
        _tokenizers[key] = encode
    return _tokenizers[key]


def _byte_signs() -> dict[str, int]:
    """How byte-level vocabulary files show bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut to the capacity: id, piece, start, length, ids_crc32, row (a number of its own).

    A null or empty text is the end id alone, a null id stays, repeated rows
    are cut as rows of their own, a text of any length is cut whole, and an
    empty table gives an empty one.
    """

    def run(batches):
        encode = token_ids(tokenizer_path)
        row = TaskContext.get().partitionId() << 40
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"].tolist(), pdf["text"].tolist(), strict=True):
                ids = np.append(encode(text), np.uint32(END)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), row))
                    row += 1
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "row"])

    out = "id string, piece int, start long, length long, ids_crc32 long, row long"
    return plain(docs, id_col, text_col).mapInPandas(run, out)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` ids.

    Returns one row per piece: id, piece, start, length, ids_crc32,
    sequence_id, offset. A null or empty text is the end id alone; null ids and
    repeated rows are packed as rows of their own; an empty table gives none.
    """
    found = spool(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    total = found.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    # row numbers are written with the pieces, so that a task run again comes to the same ranks
    keyed = found.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    by_bucket = keyed.groupBy("length", "bucket").count()
    by_bucket = spool(by_bucket, "length-counts")
    lengths = by_bucket.groupBy("length").agg(F.sum("count").alias("n")).collect()  # at most ``capacity`` rows
    runs = make_plan({r["length"]: r["n"] for r in lengths}, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)  # by (length, first rank)

    # first rank of each (length, bucket), in two steps so that no length's buckets meet in one task
    block = F.floor(F.col("bucket") / F.lit(1024)).cast("int")
    blocks = by_bucket.withColumn("block", block)
    of_blocks = blocks.groupBy("length", "block").agg(F.sum("count").alias("n"))
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    of_blocks = of_blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = W.partitionBy("length", "block").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = (
        blocks.withColumn("inside", F.coalesce(F.sum("count").over(within), F.lit(0)))
        .join(of_blocks, ["length", "block"])
        .select("length", "bucket", (F.col("before") + F.col("inside")).alias("first"))
    )
    order = W.partitionBy("length", "bucket").orderBy("row")
    ranked = (
        keyed.withColumn("nth", F.row_number().over(order) - 1)
        .join(firsts, ["length", "bucket"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    )

    def place(batches):
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for pdf in batches:
            n, rank = pdf["length"].to_numpy(np.int64), pdf.pop("rank").to_numpy(np.int64)
            run = table[np.searchsorted(keys, n * (1 << 48) + rank, "right") - 1].reshape(-1, 6)
            nth = rank - run[:, 1]
            each = np.maximum(run[:, 5], 1)
            yield pdf.assign(sequence_id=run[:, 3] + nth // each, offset=run[:, 4] + nth % each * n)

    out = "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return restored(ranked.mapInPandas(place, out), docs, id_col)
