"""Operator 13: how far the sources of a language differ in their words, by mergeable radix tries.

Each task counts the terms of its documents in byte tries, whose leaves hold a
counter for each (language, source). A trie's walk is its terms in byte order,
so tries merge as their walks do: walks are cut into prefix ranges, and a task
merges all walks of its range, a term at a time. It knows then in how many
documents of the language a term lies, and whether the term is kept.

Frequencies need the sums over all kept terms, so a second pass over the kept
counts, which are few, gives each term its rates: differences of pairs of
sources are summed in tiles of sources and slices of terms; candidates of a
source are ranked by (rate above the language, term in byte order).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazeline.llm.arrays import chunks, same_words, shared_bytes, word_hashes
from hazeline.llm.runtime import drop_spool, partitions, spool

#: Documents of its language that a kept term occurs in.
LEAST = 30
#: Added to each count, and what a rate of one is written as.
PRIOR, UNIT = 5, 1_000_000_000
#: Candidates of a source.
TOP = 50
#: Leaves of a trie in memory; a fuller one is written out and a new one begun.
LEAVES = 250_000
#: Rows that walks are merged by (about).
MERGED = 100_000
#: Characters cut into terms at a time in a task.
CHUNK = 1 << 21
#: Sources of a tile, and kept counts of a slice of terms (both about): a task compares two tiles over a slice.
TILE, SLICE = 256, 100_000
#: Terms whose rates are compared at a time.
ROWS = 1024

COUNTS = "lang string, source string, term string, n long, docs long"


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte belongs to a term (letters, and all bytes of signs beyond ASCII), and what it becomes (A-Z lower-cased)."""
    part, lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    for first in (0x41, 0x61):
        part[first : first + 26] = True
    part[0x80:] = True
    lower[0x41 : 0x41 + 26] += 0x20
    return part, lower


_PART, _LOWER = _byte_tables()


class RadixTrie:
    """Terms as paths of labelled edges; a node is [label, children by first byte or None, leaf or -1].

    Leaves are numbered as they come. Their counters are columns: leaf, group,
    occurrences, documents, added up from time to time.
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, -1]
        self.leaves = 0
        self.counters: list[np.ndarray] = []
        self.held = 0

    def numbers(self, terms: list[bytes], shared: list[int]) -> list[int]:
        """The leaves of terms in byte order, new ones where they had none; ``shared``: bytes in common with the term before.

        The path of the term before is kept open, and each term goes on from its last node on that path.
        """
        path, ends, out = [self.root], [0], []
        for term, same in zip(terms, shared, strict=True):
            while ends[-1] > same:
                path.pop()
                ends.pop()
            node, at, size = path[-1], ends[-1], len(term)
            while at < size:
                if node[1] is None:
                    node[1] = {}
                child = node[1].get(term[at])
                if child is None:
                    child = node[1][term[at]] = [term[at:], None, -1]
                label = child[0]
                if len(label) > 1 and not term.startswith(label, at):
                    cut = next(k for k in range(1, len(label) + 1) if term[at + k : at + k + 1] != label[k : k + 1])
                    middle = [label[:cut], {label[cut]: child}, -1]
                    child[0] = label[cut:]
                    child = node[1][term[at]] = middle
                node = child
                at += len(node[0])
                path.append(node)
                ends.append(at)
            if node[2] < 0:
                node[2] = self.leaves
                self.leaves += 1
            out.append(node[2])
        return out

    def leaf(self, term: bytes) -> int:
        return self.numbers([term], [0])[0]

    def count(self, leaf: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        """Add to the counters of (leaf, group), which may repeat."""
        self.counters.append(np.stack([leaf, group, n, docs]))
        self.held += len(leaf)
        if self.held > 4 * LEAVES and len(self.counters) > 1:
            self.counters = [self.summed()]
            self.held = self.counters[0].shape[1]

    def summed(self, place: np.ndarray | None = None) -> np.ndarray:
        """leaf, group, n, docs, one column for each (leaf, group), in the order of leaves or of their places."""
        if not self.counters:
            return np.zeros((4, 0), np.int64)
        every = np.concatenate(self.counters, axis=1)
        leaf = every[0] if place is None else place[every[0]]
        groups = int(every[1].max(initial=0)) + 1
        key = leaf * groups + every[1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return np.stack([*np.divmod(key[first], groups), *(np.add.reduceat(every[k][order], first) for k in (2, 3))])

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """(term, leaf) in byte order."""
        open_ = [(self.root, b"")]
        while open_:
            node, before = open_.pop()
            path = before + node[0]
            if node[2] >= 0:
                yield path, node[2]
            if node[1]:
                open_.extend((node[1][b], path) for b in sorted(node[1], reverse=True))


def _add(trie: RadixTrie, texts: list[str], groups: np.ndarray) -> None:
    """Count the terms of texts, each of its group, into the trie."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = _PART[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    data = _LOWER[data]
    doc_ends = np.cumsum([len(p) + 1 for p in parts])
    doc = np.repeat(np.arange(len(parts)), np.diff(np.searchsorted(starts, doc_ends), prepend=0))
    hashes = word_hashes(data, starts, ends)
    order = np.argsort(hashes, kind="stable")  # a term's occurrences side by side, by document
    first = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
    where, term = order[first], np.empty(len(order), np.int64)
    term[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    odd = np.flatnonzero(~same_words(data, starts, ends, where[term]))  # equal hashes of unequal terms: counted apart, the trie joins them
    if len(odd):
        term[odd] = len(where) + np.arange(len(odd))
        where = np.append(where, odd)
        order = np.lexsort((doc, term))
    of_term, of_doc = term[order], doc[order]  # a document's counts of its terms
    pair = np.flatnonzero(np.append(True, (np.diff(of_term) != 0) | (np.diff(of_doc) != 0)))
    of_term, of_doc, n = of_term[pair], of_doc[pair], np.diff(np.append(pair, len(order)))
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
    numbers = np.empty(len(words), np.int64)
    by_bytes = sorted(range(len(words)), key=words.__getitem__)
    shared = shared_bytes(data, starts[where[by_bytes]], ends[where[by_bytes]])
    numbers[by_bytes] = trie.numbers([words[k] for k in by_bytes], shared.tolist())
    trie.count(numbers[of_term], groups[of_doc], n, np.ones(len(n), np.int64))


def _walked(trie: RadixTrie, names: list[tuple[str, str]]) -> pd.DataFrame:
    terms, leaves = [], []
    for term, leaf in trie.walk():
        terms.append(term.decode())
        leaves.append(leaf)
    place = np.empty(len(leaves), np.int64)
    place[leaves] = np.arange(len(leaves))
    at, group, n, docs = trie.summed(place)
    langs, sources = (np.array([x[k] for x in names], object) for k in (0, 1))
    return pd.DataFrame({"lang": langs[group], "source": sources[group], "term": np.array(terms, object)[at], "n": n, "docs": docs})


def partial_counts(docs: DataFrame) -> DataFrame:
    """Walks of the tasks' tries: lang, source, term, n, docs; a term may come from many tasks, or several times from one."""

    def run(batches):
        trie, numbers = RadixTrie(), {}
        for pdf in batches:
            texts = pdf["text"].tolist()
            keys = zip(pdf["lang"].tolist(), pdf["source"].tolist(), strict=True)
            groups = np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64)
            for i, j in chunks(texts, CHUNK):
                _add(trie, texts[i:j], groups[i:j])
                if trie.leaves > LEAVES:
                    yield _walked(trie, list(numbers))
                    trie = RadixTrie()
        if trie.leaves:
            yield _walked(trie, list(numbers))

    return docs.mapInPandas(run, COUNTS)


def merged_counts(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """The kept terms: lang, term, source, n, total (of the language), first (on one row for each term)."""

    def run(batches):
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            size += len(pdf)
            if size < MERGED:
                continue
            every = pd.concat(held, ignore_index=True)
            last = ((every["term"] == every["term"].iloc[-1]) & (every["lang"] == every["lang"].iloc[-1])).to_numpy()
            if not last.all():
                yield kept(every[~last])
            every = every[last]
            if len(every) > MERGED // 2:  # a term of many partial counts: add up what is there
                every = every.groupby(["lang", "term", "source"], as_index=False, sort=False)[["n", "docs"]].sum()
            held, size = [every], len(every)
        if held:
            yield kept(pd.concat(held, ignore_index=True))

    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        term, lang = pdf["term"].to_numpy(object), pdf["lang"].to_numpy(object)
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])))
        docs = np.add.reduceat(pdf["docs"].to_numpy(np.int64), first)
        out = pdf[np.repeat(docs >= least, np.diff(np.append(first, len(pdf))))]
        out = out.groupby(["lang", "term", "source"], as_index=False, sort=False)["n"].sum()
        out["total"] = out.groupby(["lang", "term"], sort=False)["n"].transform("sum")
        out["first"] = ~out.duplicated(["lang", "term"])
        return out

    ranged = parts.repartitionByRange(partitions(parts.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return ranged.select("lang", "term", "source", "n", "docs").mapInPandas(run, "lang string, term string, source string, n long, total long, first boolean")


def _rate(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (n + PRIOR * v)) in whole numbers; null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (wide(count) + F.lit(PRIOR)) * F.lit(UNIT)
    below = wide(n) + wide(v) * F.lit(PRIOR)
    return F.when(v > 0, F.call_function("div", above, below) + F.lit(1))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, tile: int = TILE, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group.

    Part ``pair``: each other source of the language, by the sum of differences
    of rates over all kept terms; part ``term``: the ``top`` kept terms of the
    group whose rates lie most above the language's. Null texts, languages and
    sources count as empty; each row is a document, also a repeated one; an
    empty table gives an empty one; a group without terms has pairs, a source
    alone in its language has none. Ties go by the item's bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    parts = spool(partial_counts(rows), "term-counts")
    kept = spool(merged_counts(parts, least), "kept-counts")
    drop_spool(parts)

    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct()
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(tile)).alias("tiles"))
    groups = groups.join(sizes, "lang").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = spool(groups.select("lang", "source", "tiles", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "lang_n", "n"))), "source-sums")

    by_group = groups.select("lang", "source", "tiles", "v", "lang_n", F.col("n").alias("group_n"))
    rated = kept.join(by_group, ["lang", "source"]).withColumn("p", _rate(F.col("n"), F.col("group_n"), F.col("v")))
    over = F.col("p") - _rate(F.col("total"), F.col("lang_n"), F.col("v"))
    terms = rated.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    slices = max(1, -(-kept.count() // SLICE))
    pairs = _pair_sums(rated, by_group, slices).withColumn("rank", F.row_number().over(order))
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms.withColumn("part", F.lit("term")))
    out = spool(both, "divergence")
    for df in (kept, groups):
        drop_spool(df)
    return out


def _pair_sums(rated: DataFrame, groups: DataFrame, slices: int) -> DataFrame:
    """lang, source, item (another source), value: differences of rates over all kept terms of the language.

    A source's rate is the same for all terms that it lacks. So a task sums, over
    the terms that one of its sources has, what differs from that, and the tasks
    of the first slice add the rest.
    """
    own = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("own")
    tiles = F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))
    mine = F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice")
    counts = rated.select("lang", "source", "term", "p", F.col("v").alias("v"), own, mine, F.explode(tiles).alias("other"))
    absent = _rate(F.lit(0), F.col("group_n"), F.col("v"))
    rest = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce(absent, F.lit(0)).alias("p"), "v", own, tiles.alias("all"))
    rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")).select("*", F.explode("all").alias("other")).drop("all")
    rows = counts.unionByName(rest).select("lang", "source", "term", "p", "v", "own", "slice", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, slice_, low, high = pdf["lang"].iloc[0], pdf["slice"].iloc[0], pdf["low"].iloc[0], pdf["high"].iloc[0]
        base = pdf[pdf["term"].isna()].sort_values("source")
        present = pdf[pdf["term"].notna()]
        names, p0, tile = base["source"].to_numpy(object), base["p"].to_numpy(np.int64), base["own"].to_numpy()
        at = {s: i for i, s in enumerate(names)}
        col = np.array([at[s] for s in present["source"]], np.int64)
        row, words = pd.factorize(present["term"])
        order = np.argsort(row, kind="stable")
        row, col, p = row[order], col[order], present["p"].to_numpy(np.int64)[order]
        plain = np.abs(p0[:, None] - p0[None, :])
        total = plain * (int(pdf["v"].iloc[0]) if slice_ == 0 else 0) - plain * len(words)
        for first in range(0, len(words), ROWS):
            a, b = np.searchsorted(row, [first, first + ROWS])
            rates = np.repeat(p0[None, :], min(ROWS, len(words) - first), axis=0)
            rates[row[a:b] - first, col[a:b]] = p[a:b]
            for s in range(len(names)):
                total[s] += np.abs(rates - rates[:, s : s + 1]).sum(axis=0)
        x, y = np.nonzero((tile[:, None] == low) & (tile[None, :] == high) | (tile[:, None] == high) & (tile[None, :] == low))
        x, y = x[x != y], y[x != y]
        return pd.DataFrame({"lang": lang, "source": names[x], "item": names[y], "value": total[x, y]})

    found = rows.groupBy("lang", "low", "high", "slice").applyInPandas(sums, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sql(table: str, least: int = LEAST, top: int = TOP) -> str:
    """The same rows in SQL."""
    rate = lambda c, n: f"(1 + ({UNIT}::HUGEINT * ({c} + {PRIOR})) // ({n} + {PRIOR} * v))"
    upper = "".join(map(chr, range(65, 91)))
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM {table}),
        w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{upper}', '{upper.lower()}') AS term FROM d),
        k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {least}),
        g AS (SELECT DISTINCT lang, source FROM d),
        vs AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
        every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v FROM g JOIN k ON g.lang = k.lang JOIN vs ON vs.lang = g.lang
                  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (SELECT *, {rate("n", "sum(n) OVER (PARTITION BY lang, source)")} AS p,
                     {rate("sum(n) OVER (PARTITION BY lang, term)", "sum(n) OVER (PARTITION BY lang)")} AS q FROM every),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        every_part AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
        FROM every_part QUALIFY part = 'pair' OR rank <= {top}"""
