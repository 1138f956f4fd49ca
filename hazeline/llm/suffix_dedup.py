"""Operator 1: exact removal of repeated byte strings by suffix arrays.

Every window of ``length`` bytes picks an anchor (its gram of least hash), so
equal windows pick equal anchors at equal distances. Anchors that occur once
are dropped; of the others, each distinct surroundings (all windows of the
anchor) are taken once, with their count. Windows fall into bands of near
distances. All windows of a band share their core, the bytes that lie in each of
them, so equal windows meet by core. A core in a single distinct string is
decided by its count. The strings of any other core meet in one task, where the
core itself shrinks to one symbol: the suffix array of all symbols there, built
by linear grouping, brings equal windows together, and suffixes that agree with
their neighbour in a whole window are the repeats. A core that very many distinct strings hold is dealt out in
narrower bands, whose cores are longer, until few strings share one.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.arrays import chunks, eights_of, mix, powers
from hazeline.llm.runtime import drop_spool, partitions, row_keys, spool, text_column, whole_groups
from hazeline.llm.suffix_array import suffix_array

LENGTH = 400
#: Bands that the distances from an anchor are cut into at first.
BANDS = 4
#: Distinct strings of one core that meet in a task; cores of more get narrower bands.
MANY = 256
#: Bytes hashed at a time, and strings whose suffixes are sorted at a time.
CHUNK, SORTED = 1 << 20, 800
#: A longer text is hashed in pieces; anchors' places then fit the low bits of their sort keys.
PIECE, PLACE_BITS = 8 << 20, 24


def gram_of(length: int) -> int:
    return max(1, length // 4)


def reach(length: int) -> int:
    """Distances that a window may have to its anchor."""
    return length - gram_of(length) + 1


def anchors(data: np.ndarray, ends: np.ndarray, length: int, key: bytes = b"") -> dict[str, np.ndarray]:
    """Anchors of texts laid end to end: text index, place, first window, windows, hash, and digest of the surroundings in two halves.

    The hash, which only proposes, is a polynomial over the mixed bits of each
    eight bytes on end; surroundings are named by 128 bits of BLAKE2b.
    """
    n, k = len(data), gram_of(length)
    w = reach(length)
    if n < length:
        return {c: np.zeros(0, np.int64) for c in ("text", "place", "first", "windows", "gram", "around", "check")}
    up, down = powers(n + 1)
    wide = min(8, k)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(eights_of(data)[:n] & np.uint64((1 << 8 * wide) - 1)) * up[:n], out=sums[1:])
    m = n - k + 1
    gram = mix((sums[k - wide + 1 : n - wide + 2] - sums[:m]) * down[:m])
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = np.full(-(-m // w) * w, ~np.uint64(0), np.uint64)
    keys[:m] = (gram & ~low) | np.arange(m, dtype=np.uint64)
    rows = keys.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = (np.minimum(back[:count], ahead[w - 1 : w - 1 + count]) & low).astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    last = np.repeat(ends, sizes)[:count]
    valid = np.arange(count) + length <= last
    fresh = valid.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(fresh)
    stop = np.append(np.flatnonzero(valid[:-1] & (fresh[1:] | ~valid[1:])) + 1, count) if count > 1 else np.array([count])
    stop = stop[: len(first)]
    place = least[first]
    shape = ((place - first).astype(np.uint64) << np.uint64(32) | (stop - first).astype(np.uint64)).tobytes()
    raw, named = memoryview(data), hashlib.blake2b
    spans = zip(first.tolist(), (stop + length - 1).tolist(), range(0, len(shape), 8), strict=True)
    digest = b"".join([named(raw[a:b], digest_size=16, key=key, salt=shape[k : k + 8]).digest() for a, b, k in spans])
    around = np.frombuffer(digest, np.int64).reshape(-1, 2)
    return {
        "text": np.searchsorted(ends, first, "right"), "place": place, "first": first, "windows": stop - first,
        "gram": gram[place].view(np.int64), "around": around[:, 0].copy(), "check": around[:, 1].copy(),
    }


def text_anchors(texts: list[bytes], length: int, key: bytes):
    """``anchors`` of many texts, in parts: (texts' index, base offset in the text, bytes, anchors)."""
    short = [i for i, t in enumerate(texts) if length <= len(t) <= PIECE]
    for a, b in chunks([texts[i] for i in short], CHUNK):
        part = short[a:b]
        data = np.frombuffer(b"".join([texts[i] for i in part]), np.uint8)
        ends = np.cumsum([len(texts[i]) for i in part])
        found = anchors(data, ends, length, key)
        begins = np.append(0, ends[:-1])
        yield np.array(part)[found["text"]], begins[found["text"]], data, found
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            for at in range(0, len(t) - length + 1, PIECE):
                data = np.frombuffer(t[at : at + PIECE + length - 1], np.uint8)
                found = anchors(data, np.array([len(data)]), length, key)
                yield np.full(len(found["place"]), i), np.full(len(found["place"]), -at), data, found


def bands(top: int, windows: int, size: int, low: int = 0, high: int = 1 << 40):
    """(band's first distance, farthest and nearest distance) of an anchor's windows within low..high, by bands of ``size``."""
    nearest, farthest = max(top - windows + 1, low), min(top, high)
    for u in range(low + (nearest - low) // size * size, farthest + 1, size):
        yield u, min(farthest, u + size - 1, high), max(nearest, u)


def shrunk(strings: list[bytes], offset: list[int], size: list[int], length: int) -> list[np.ndarray]:
    """Strings as symbols of 2 and more, with the core (from ``offset``, for bands of ``size``) as one symbol of its own bytes' number."""
    numbers: dict[bytes, int] = {}
    out = []
    for s, a, k in zip(strings, offset, size, strict=True):
        b = a + length - k + 1
        core = numbers.setdefault(s[a:b], 258 + len(numbers))
        left, right = np.frombuffer(s, np.uint8, a), np.frombuffer(s, np.uint8, len(s) - b, b)
        out.append(np.concatenate([left.astype(np.int64) + 2, [core], right.astype(np.int64) + 2]))
    return out


def repeated_windows(strings: list[np.ndarray], count: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """For each string: which of its suffixes start with ``size`` symbols (each string's own number) that occur again.

    ``count`` tells how often each string occurs. Suffixes that start with the
    same symbols are neighbours in the suffix array, so each is compared with
    the one before it only.
    """
    lengths = np.array([len(s) for s in strings])
    symbols = np.ones(int(lengths.sum()) + len(strings), np.int64)  # 1 ends a string
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.concatenate(strings)
    owner = np.repeat(np.arange(len(strings)), lengths + 1)
    order = suffix_array(symbols)
    order = order[ends[owner[order]] - order >= size[owner[order]]]
    need = size[owner[order]]
    # neighbours that still agree, one symbol a step
    alive, at = np.flatnonzero(need[1:] == need[:-1]) + 1, 0
    same = np.zeros(len(order), bool)
    while len(alive):
        done = need[alive] == at
        same[alive[done]] = True
        alive = alive[~done]
        alive = alive[symbols[order[alive] + at] == symbols[order[alive - 1] + at]]
        at += 1
    run = np.cumsum(~same) - 1
    times = np.bincount(run, count[owner[order]], minlength=1)
    out = np.zeros(len(symbols), bool)
    out[order[times[run] > 1]] = True
    return np.split(out[inside], np.cumsum(lengths)[:-1])


_BAND = "gram long, around long, n long, low int, size int, top int, windows int, core long, s1 long, s2 long"


def _banded(around: DataFrame, length: int, size: int) -> DataFrame:
    """The windows of ``around`` (gram, around, n, top, windows, low, high, bytes) between low and high in bands of ``size``.

    A row tells a band's first distance (low), its farthest window (top), how
    many windows, the hash of its core, and the digest of its string.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for g, r, n, top, windows, a, b, data in zip(*(pdf[c].tolist() for c in ("gram", "around", "n", "top", "windows", "low", "high", "bytes")), strict=True):
                for u, far, near in bands(top, windows, size, a, b):
                    core = hashlib.blake2b(data[top - u : top - u - size + 1 + length], digest_size=8, key=f"{g}:{u}".encode()).digest()
                    string = hashlib.blake2b(data[top - far : top - near + length], digest_size=16, key=f"{u - far}".encode()).digest()
                    s = np.frombuffer(core + string, np.int64).tolist()
                    rows.append((g, r, n, u, size, far, far - near + 1, *s))
            yield pd.DataFrame(rows, columns=["gram", "around", "n", "low", "size", "top", "windows", "core", "s1", "s2"])

    return around.select("gram", "around", "n", "top", "windows", "low", "high", "bytes").mapInPandas(run, _BAND)


def _repeats(members: DataFrame, length: int) -> DataFrame:
    """core, s1, s2, first, last: runs of windows of each string that occur again.

    ``members`` has core, s1, s2, n, offset (of the core), size and bytes, each string once.
    """

    def run(batches):
        for rows in whole_groups(batches, "core", SORTED):
            size = rows["size"].to_numpy(np.int64)
            strings = shrunk(rows["bytes"].tolist(), rows["offset"].tolist(), size.tolist(), length)
            flags = repeated_windows(strings, rows["n"].to_numpy(np.int64), size)
            which, first, last = [], [], []
            for i, own in enumerate(flags):
                edges = np.diff(np.pad(own, 1).astype(np.int8))
                if (edges > 0).any():
                    which.append(i)
                    first.append(np.flatnonzero(edges > 0).astype(np.int32))
                    last.append((np.flatnonzero(edges < 0) - 1).astype(np.int32))
            if which:
                yield pd.DataFrame({**{c: rows[c].to_numpy()[which] for c in ("core", "s1", "s2")}, "first": first, "last": last})

    dealt = members.repartition(partitions(members.sparkSession), "core").sortWithinPartitions("core")
    return dealt.mapInPandas(run, "core long, s1 long, s2 long, first array<int>, last array<int>")


def _judged(around: DataFrame, length: int, many: int, used: list[DataFrame]) -> DataFrame:
    """gram, around, low, high: distances of windows of ``around`` (gram, around, n, top, windows, bytes) that repeat, in runs.

    Tables written on the way are added to ``used``.
    """
    size = -(-reach(length) // BANDS)
    part = around.withColumn("low", F.lit(0)).withColumn("high", F.lit(reach(length)))
    strings, decided = None, None
    while True:
        cut = spool(_banded(part, length, size), "bands")
        once = cut.groupBy("core", "s1", "s2").agg(F.sum("n").alias("n"))
        cores = spool(once.groupBy("core").agg(F.count("*").alias("strings"), F.sum("n").alias("times")), "cores")
        here = cut.join(cores.where("strings = 1 and times > 1").select("core"), "core").select("gram", "around", (F.col("top") - F.col("windows") + 1).alias("low"), F.col("top").alias("high"))
        several = cut.join(cores.where(f"strings > 1 and strings <= {many}").select("core"), "core")
        used += [cut, cores]
        decided = here if decided is None else decided.unionByName(here)
        strings = several if strings is None else strings.unionByName(several)
        large = cores.where(f"strings > {many}").select("core")
        if size == 1 or not large.limit(1).count():
            break
        again = cut.join(large, "core").select("gram", "around", "low", (F.col("low") + size - 1).alias("high"))
        part = around.join(again, ["gram", "around"])
        size = -(-size // 2)
    strings = spool(strings, "strings")
    # one holder of each string, chosen by hash, so that bytes are read from all over
    pick = F.xxhash64("gram", "around")
    held = strings.groupBy("core", "s1", "s2").agg(F.sum("n").alias("n"), *(F.min_by(c, pick).alias(c) for c in ("gram", "around", "low", "size", "top", "windows")))
    held = held.withColumnsRenamed({"top": "far", "windows": "own"}).withColumn("offset", F.col("far") - F.col("low"))
    text = F.expr(f"substring(bytes, top - far + 1, own + {length - 1})").alias("bytes")
    members = held.join(around.select("gram", "around", "top", "bytes"), ["gram", "around"]).select("core", "s1", "s2", "n", "offset", "size", text)
    found = _repeats(members, length).withColumn("run", F.explode(F.arrays_zip("first", "last"))).select("core", "s1", "s2", "run.first", "run.last")
    found = spool(found, "runs")
    used += [strings, found]
    met = strings.join(found, ["core", "s1", "s2"]).select("gram", "around", (F.col("top") - F.col("last")).alias("low"), (F.col("top") - F.col("first")).alias("high"))
    return decided.unionByName(met)


def _marked(docs: DataFrame, length: int, text_col: str, id_col: str, many: int) -> DataFrame:
    """``docs`` with hazeline_starts and hazeline_ends: arrays (null if none) of the byte ranges of repeated strings, overlaps included."""
    keyed = docs.withColumn("hazeline_text", text_column(docs, text_col))
    one, two = row_keys(keyed[id_col].cast("string"), keyed["hazeline_text"])
    keyed = keyed.select("*", one.alias("hazeline_k1"), two.alias("hazeline_k2"))
    long = keyed.where(F.octet_length("hazeline_text") >= length)
    # a secret of this run, so that nobody can prepare texts whose digests agree in their first half
    key = os.urandom(16)

    def scan(batches):
        for pdf in batches:
            k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
            for index, begin, _, found in text_anchors([t.encode() for t in pdf["text"]], length, key):
                top, windows = (found["place"] - found["first"]).astype(np.int32), found["windows"].astype(np.int32)
                yield pd.DataFrame({"k1": k1[index], "k2": k2[index], "place": found["place"] - begin, "top": top, "windows": windows, "gram": found["gram"], "around": found["around"], "check": found["check"]})

    texts = long.select(F.col("hazeline_k1").alias("k1"), F.col("hazeline_k2").alias("k2"), F.col("hazeline_text").alias("text"))
    every = spool(texts.mapInPandas(scan, "k1 long, k2 long, place long, top int, windows int, gram long, around long, check long"), "anchors")
    # written, so that both sides of the join come from shuffles that Spark can split where one anchor is frequent
    again = spool(every.groupBy("gram").count().where("count > 1").select("gram"), "repeated")
    seen = spool(every.join(again, "gram"), "repeated-anchors")
    drop_spool(every)

    pick = F.xxhash64("k1", "k2", "place")
    distinct = seen.groupBy("gram", "around").agg(
        F.count("*").alias("n"), F.min("top").alias("top"), F.min("windows").alias("windows"), (F.min("check") == F.max("check")).alias("_one"),
        *(F.min_by(c, pick).alias(c) for c in ("k1", "k2")),
    )
    # surroundings are joined by the first half of their digest; should that ever be the same for two, the run fails and never errs
    distinct = distinct.withColumn("n", F.when(F.col("_one"), F.col("n")).otherwise(F.raise_error(F.lit("two surroundings share half a digest")).cast("long"))).drop("_one")
    distinct = spool(distinct, "surroundings")
    several = spool(distinct.groupBy("gram").count().withColumnRenamed("count", "kinds"), "kinds")
    alone = distinct.join(several.where("kinds = 1"), "gram").select("gram", "around", (F.col("top") - F.col("windows") + 1).alias("low"), F.col("top").alias("high"))
    wanted = distinct.join(several.where("kinds > 1").select("gram"), "gram").groupBy("k1", "k2").agg(F.collect_list("around").alias("around"), F.collect_list("n").alias("n"))

    def cut(batches):
        for pdf in batches:
            # digests wanted of each text, as one sorted key for both
            sizes = pdf["around"].map(len).to_numpy()
            keys = np.concatenate(pdf["around"].to_numpy()).view(np.uint64) ^ mix(np.repeat(np.arange(len(pdf)), sizes))
            order = np.argsort(keys)
            keys, counts = keys[order], np.concatenate(pdf["n"].to_numpy())[order]
            for index, _, data, found in text_anchors([t.encode() for t in pdf["text"]], length, key):
                own = found["around"].view(np.uint64) ^ mix(index)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == own)
                _, once = np.unique(own[hit], return_index=True)
                hit = hit[once]
                first, windows, place = (found[c][hit] for c in ("first", "windows", "place"))
                raw = data.tobytes()
                yield pd.DataFrame({
                    "gram": found["gram"][hit], "around": found["around"][hit], "n": counts[at[hit]],
                    "top": (place - first).astype(np.int32), "windows": windows.astype(np.int32),
                    "bytes": [raw[a : a + w - 1 + length] for a, w in zip(first.tolist(), windows.tolist(), strict=True)],
                })

    around = wanted.join(texts, ["k1", "k2"]).select("text", "around", "n").mapInPandas(cut, "gram long, around long, n long, top int, windows int, bytes binary")
    # a repeated row, or pieces of one text, may give the same surroundings again
    around = spool(around.dropDuplicates(["gram", "around"]), "around")
    used = [again, distinct, several, around]
    found = alone.unionByName(_judged(around, length, many, used))
    found = spool(found.groupBy("gram", "around").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")), "distances")
    for table in used:  # what follows reads only the anchors and these distances
        drop_spool(table)
    spans = (
        seen.join(found, ["gram", "around"])
        .select("k1", "k2", F.expr("transform(high, t -> place - t)").alias("s"), F.expr(f"transform(low, t -> place - t + {length})").alias("e"))
        .groupBy(F.col("k1").alias("hazeline_k1"), F.col("k2").alias("hazeline_k2"))
        .agg(F.flatten(F.collect_list("s")).alias("hazeline_starts"), F.flatten(F.collect_list("e")).alias("hazeline_ends"))
    )
    return keyed.join(spans, ["hazeline_k1", "hazeline_k2"], "left")


def merged(starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching intervals."""
    if starts is None or not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    a, b = np.asarray(starts, np.int64)[order], np.maximum.accumulate(np.asarray(ends, np.int64)[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], np.append(b[:-1][new[1:]], b[-1])


def kept_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def removals(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """What is repeated in each row: id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends, text (what is kept).

    A byte goes if a string of ``length`` bytes over it also starts elsewhere,
    in this row or another, judged on the input. Null and shorter texts lose
    nothing; a null id stays; a repeated row is another place, so both lose all
    that is long enough; an empty table gives an empty one.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches):
        for pdf in batches:
            rows = []
            for text, s, e in zip(pdf["hazeline_text"], pdf["hazeline_starts"], pdf["hazeline_ends"], strict=True):
                data = text.encode()
                a, b = merged(s, e)
                kept = kept_bytes(data, a, b)
                rows.append((len(data), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), a, b, kept.decode("utf-8", "ignore")))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "text"])
            yield out.assign(id=pdf["id"].to_numpy())

    marked = _marked(source, length, "text", "id", many).select(F.col("id").cast("string").alias("id"), "hazeline_text", "hazeline_starts", "hazeline_ends")
    found = marked.mapInPandas(run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, text string, id string")
    kind = docs.schema[id_col].dataType
    return found.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "text")


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """``docs`` without the repeated bytes (a character that loses a byte goes); all rows and columns stay.

    ``n_chars``, if there, is counted again for changed texts. Null texts stay
    null and null ids stay; a repeated row repeats itself, so both lose all that
    is long enough; texts of any length are searched whole; an empty table gives
    an empty one.
    """

    def run(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([kept_bytes(t.encode(), *merged(s, e)).decode("utf-8", "ignore") if t is not None else None for t, s, e in zip(text, starts, ends, strict=True)])

    marked = _marked(docs, length, text_col, id_col, many)
    cut = F.pandas_udf(run, "string")(F.col(text_col), F.col("hazeline_starts"), F.col("hazeline_ends"))
    same = F.col("hazeline_starts").isNull()
    out = marked.withColumn(text_col, F.when(same, F.col(text_col)).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
