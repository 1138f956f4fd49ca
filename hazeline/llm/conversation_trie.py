"""Operator 12: the prefix trie of conversations by external mergesort that carries common prefixes.

A turn is named by 128 bits of SHA-256 of its role and text, so a conversation
is a string of such names and text travels no further. Strings are cut into
segments of SEGMENT turns; each segment is keyed by the digest of all before it,
so rows stay small however long a conversation grows. Segments of one depth
form a layer, and layers are done from the deepest, whose totals their parents
take over; short conversations make one layer.

In a layer, tasks sort their strings into runs that carry the length of the
common prefix (LCP) with the string before. The runs are cut into ranges, and a
task merges the runs of its range with a loser tree, which compares two strings
only from their common LCP with the last one on. From the merged stream and its
LCPs a stack of open nodes emits each node once no string can reach it any more.
Nodes on the paths of a range's first and last string may go on in other
ranges: their partial rows are merged by a second such stack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazeline.llm.runtime import drop_spool, partitions, spool

#: Bytes of a turn's name.
NAME = 16
#: Turns of a segment.
SEGMENT = 4096
#: Turn numbers of a block that rows are numbered in, and conversation ids of a block that ends are listed in.
TURNS, IDS = 1024, 4096
#: Strings of a run, and of a range (about).
RUN = RANGE = 32_768
#: Conversations that share a base, and the number of possible heads.
BASES, HEADS = 5, 9
_ROOT = bytes(NAME)

#: A distinct string of a layer: members whose segment it is, those of them that end here, what lies below.
_STRING = "key binary, sizes array<int>, n long, first long, ends_sha256 string, below_children long, below_leaves long, below_saved long, above long"
_RUNS = "run long, nth int, lcp int, " + _STRING
_NODE = "edge boolean, key binary, conv_id long, depth long, parent binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size int, ends_sha256 string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def named(turns: DataFrame) -> DataFrame:
    """conv_id, turn, name (of role and text), size (UTF-8 bytes of the text); rows without a conv_id go."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    name = F.unhex(F.substring(F.sha2(said, 256), 1, 2 * NAME))
    found = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), name.alias("name"))
    return found.withColumn("size", F.octet_length("text"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every conv_id, rows conv_id, place, name, size of the rebuilt conversations).

    A conversation c takes the first h turns of c - c % BASES and goes on with
    its own after the first h; h is crc32(decimal c) % HEADS. Turns are ordered
    by turn (null first), role and text.
    """
    rows = named(turns)
    block = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 62))).alias("block")
    rows = rows.select("*", block)
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    counts = spool(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "turn-counts")
    sizes = counts.groupBy("conv_id").agg(F.sum("n").alias("turns"))
    base = F.col("conv_id") - F.col("conv_id") % BASES
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    ids = sizes.select("conv_id", head.alias("head"), base.alias("base")).join(of_base, "base", "left")
    ids = ids.select("conv_id", "base", "head", F.least("head", F.coalesce("base_turns", F.lit(0))).alias("taken"))

    order = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    inside = rows.select("conv_id", "block", "name", "size", (F.row_number().over(order) - 1).alias("inside"))
    placed = inside.join(counts.join(ids, "conv_id"), ["conv_id", "block"])
    placed = placed.select("conv_id", "head", "taken", (F.col("before") + F.col("inside")).alias("nth"), "name", "size")
    placed = spool(placed, "placed-turns")
    own = placed.where("nth >= head").select("conv_id", (F.col("taken") + F.col("nth") - F.col("head")).alias("place"), "name", "size")
    givers = placed.where((F.col("nth") < HEADS - 1) & (F.col("conv_id") % BASES == 0)).select(F.col("conv_id").alias("base"), F.col("nth").alias("place"), "name", "size")
    given = givers.join(ids, "base").where("place < head").select("conv_id", "place", "name", "size")
    return ids.select("conv_id"), own.unionByName(given)


def sorted_run(rows: list[tuple]) -> tuple[list[tuple], list[int]]:
    """Strings (their key first) in order, and each one's LCP with the one before, in names."""
    rows.sort(key=lambda r: r[0])
    return rows, [0] + [lcp(a[0], b[0], 0) for a, b in zip(rows, rows[1:], strict=False)]


def lcp(a: bytes, b: bytes, known: int) -> int:
    """Names that two keys share at their start, ``known`` of which are known to be equal."""
    low, high = known, min(len(a), len(b)) // NAME
    step = 1
    while low < high:  # by doubling steps, then by halves
        end = min(high, low + step)
        if a[low * NAME : end * NAME] == b[low * NAME : end * NAME]:
            low, step = end, 2 * step
        elif step == 1 or end - low == 1:
            return low
        else:
            high, step = end, 1
    return low


class LoserTree:
    """Merges runs of (row, LCP with the row before) into one such stream; comparisons start behind what is known to be shared."""

    def __init__(self, runs: list[Iterator[tuple[tuple, int]]]):
        self.runs = runs
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.head: list = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.compared = 0
        # all first rows share nothing with the empty string before them
        self.shared = [0] * self.size
        self.loser = [0] * self.size
        winners = list(range(self.size))
        at = self.size
        while len(winners) > 1:
            at //= 2
            pairs = [self._play(winners[2 * k], winners[2 * k + 1]) for k in range(at)]
            for k, (_, lost) in enumerate(pairs):
                self.loser[at + k] = lost
            winners = [w for w, _ in pairs]
        self.winner = winners[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); ``shared`` of the loser becomes its LCP with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        s, t = self.shared[a], self.shared[b]
        if s != t:  # who shares more with the last row comes first, and the other one shares as much with it
            return (a, b) if s > t else (b, a)
        k, l = x[0][0], y[0][0]
        self.compared += 1
        same = lcp(k, l, s)
        first = k[same * NAME : (same + 1) * NAME] <= l[same * NAME : (same + 1) * NAME]
        won, lost = (a, b) if first else (b, a)
        self.shared[lost] = same
        return won, lost

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        while (top := self.head[self.winner]) is not None:
            run = self.winner
            yield top[0], self.shared[run]
            self.head[run] = found = next(self.runs[run], None)
            self.shared[run] = found[1] if found else 0
            at = (self.size + run) // 2
            while at:
                run, self.loser[at] = self._play(run, self.loser[at])
                at //= 2
            self.winner = run


def _string_rows(strings: DataFrame) -> DataFrame:
    """One row for each distinct key, from rows (key, sizes, block, ids, n, first, ...): a key's blocks of ids come in order and are hashed as they come."""

    def run(batches):
        held: list | None = None
        digest = None
        for pdf in batches:
            out = []
            for key, sizes, ids, n, first, children, leaves, saved, above in pdf[["key", "sizes", "ids", "n", "first", "below_children", "below_leaves", "below_saved", "above"]].itertuples(index=False, name=None):
                if held is None or held[0] != key:
                    if held is not None:
                        out.append((*held[:4], digest.hexdigest(), *held[4:]))
                    held, digest, some = [key, sizes, 0, first, 0, 0, 0, None], hashlib.sha256(), False
                held[2] += int(n)
                held[3] = min(held[3], first)
                held[4], held[5], held[6] = int(children), int(leaves), int(saved)  # the same on all rows of a key
                held[7] = None if above is None or above != above else int(above)
                if ids:
                    digest.update(b"," * some + ids.encode())
                    some = True
            if out:
                yield frame(out)
        if held is not None:
            yield frame([(*held[:4], digest.hexdigest(), *held[4:])])

    names = [c.split()[0] for c in _STRING.split(", ")]

    def frame(rows: list) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=names)
        df["above"] = df["above"].astype("Int64")
        return df

    return strings.mapInPandas(run, _STRING)


def _as_runs(strings: DataFrame) -> DataFrame:
    """Runs of each task's strings, sorted, each row with its LCP."""
    names = [c.split()[0] for c in _STRING.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def done() -> pd.DataFrame:
            rows, shared = sorted_run(held)
            df = pd.DataFrame(rows, columns=names)
            df["above"] = df["above"].astype("Int64")
            df.insert(0, "lcp", np.array(shared, np.int32))
            df.insert(0, "nth", np.arange(len(rows), dtype=np.int32))
            df.insert(0, "run", number)
            return df

        for pdf in batches:
            held += pdf[names].itertuples(index=False, name=None)
            if len(held) >= RUN:
                yield done()
                number, held = number + 1, []
        if held:
            yield done()

    return strings.mapInPandas(run, _RUNS)


def _number(v) -> int | None:
    return None if v is None or v != v else int(v)


class OpenPath:
    """The stack of open nodes over a sorted stream of strings; finished nodes go to ``done``."""

    def __init__(self, depth: int):
        self.depth = depth  # of a layer's roots
        self.stack: list[dict] = []
        self.done: list[dict] = []
        self.started = False

    def take(self, row: tuple, shared: int) -> None:
        key, sizes, n, first, ends, children, leaves, saved, above = row
        self.close(shared)
        for k in range(shared, len(key) // NAME):
            node = {"end": (k + 1) * NAME, "depth": self.depth + k, "n": 0, "first": None, "children": 0, "leaves": 0, "saved": 0, "size": 0 if not k else int(sizes[k - 1]), "ends": None, "edge": not self.started}
            node["key"], node["kids"], node["above"] = key, [], _number(above) if not k else None
            self.stack.append(node)
        self.started = True
        top = self.stack[-1]
        top["n"], top["first"], top["ends"] = int(n), int(first), ends
        top["children"] += int(children)
        top["leaves"] += int(leaves)
        top["saved"] += int(saved)

    def close(self, shared: int, last: bool = False) -> None:
        """Finish the nodes that share no string that is still to come; at the end of a range, the open ones may go on in the next."""
        while len(self.stack) > shared:
            node = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            node["edge"] = node["edge"] or last
            if not node["edge"]:
                settle(node, root=node["end"] == NAME)
            if above is not None:
                above["n"] += node["n"]
                above["first"] = node["first"] if above["first"] is None else min(above["first"], node["first"])
                if not node["edge"]:
                    above["children"] += 1
                    above["leaves"] += node["leaves"]
                    above["saved"] += node["saved"]
                above["kids"].append(node)
            for kid in node.pop("kids"):
                # children of a layer's root belong to a node of the layer above, which knew its smallest member beforehand
                kid["parent_conv"] = node["above"] if node["above"] is not None else None if node["edge"] else node["first"]
                kid["parent"] = node["key"][: node["end"]] if kid["parent_conv"] is None else None
                self.done.append(kid)
            if above is None:
                node["parent_conv"] = node["parent"] = None
                self.done.append(node)


def settle(node: dict, root: bool) -> None:
    """Add what a finished node itself counts for; a layer's root counts nothing more than its root in the layer above did."""
    if not node["children"]:
        node["leaves"] += 1
    if not root:
        node["saved"] += (node["n"] - 1) * node["size"]


def _frame(nodes: list[dict]) -> pd.DataFrame:
    columns = [c.split()[0] for c in _NODE.split(", ")]
    rows = [
        (x["edge"], x["key"][: x["end"]], x["first"], x["depth"], x["parent"], x["parent_conv"], x["n"], x["children"], x["leaves"], x["saved"], x["size"], x["ends"] or _NO_ENDS)
        for x in nodes
    ]
    return pd.DataFrame(rows, columns=columns).astype({"parent_conv_id": "Int64"})


def _merged(runs: DataFrame, depth: int, ranges: int) -> DataFrame:
    """Nodes of a layer from its runs; those of the edges of ranges are partial."""

    def run(batches):
        every = [pdf for pdf in batches if len(pdf)]
        if not every:
            return
        rows = pd.concat(every, ignore_index=True).sort_values(["run", "nth"], kind="stable")
        names = [c.split()[0] for c in _STRING.split(", ")]
        cuts = np.flatnonzero(np.append(True, rows["run"].to_numpy()[1:] != rows["run"].to_numpy()[:-1]))
        strings, shared = list(rows[names].itertuples(index=False, name=None)), rows["lcp"].tolist()
        for c in cuts:  # the string before lies in another range
            shared[c] = 0
        path = OpenPath(depth)
        runs_ = [zip(strings[a:b], shared[a:b], strict=True) for a, b in zip(cuts, [*cuts[1:], len(strings)], strict=True)]
        for row, same in LoserTree(runs_):
            path.take(row, same)
        path.close(0, last=True)
        yield _frame(path.done)

    return runs.repartitionByRange(ranges, "key").mapInPandas(run, _NODE)


def _edges(partial: DataFrame) -> DataFrame:
    """Whole nodes from the partial ones of the edges, all below one first turn in one task; roots stay partial."""

    def run(batches):
        stack: list[dict] = []
        done: list[dict] = []

        def close(key: bytes) -> None:
            while stack and not key.startswith(stack[-1]["key"]):
                node = stack.pop()
                settle(node, root=False)
                for kid in node.pop("kids"):
                    kid["parent_conv"], kid["parent"] = node["first"], None
                    done.append(kid)
                if stack:
                    above = stack[-1]
                    above["children"] += 1
                    above["leaves"] += node["leaves"]
                    above["saved"] += node["saved"]
                    above["kids"].append(node)
                else:
                    node["parent"], node["parent_conv"] = node["key"][:NAME], node["above"]
                    done.append(node)

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                close(r.key)
                if not stack or stack[-1]["key"] != r.key:
                    node = {"key": r.key, "end": len(r.key), "depth": r.depth, "n": 0, "first": r.conv_id, "children": 0, "leaves": 0, "saved": 0, "size": r.size, "ends": None, "kids": [], "edge": True, "above": _number(r.parent_conv_id)}
                    stack.append(node)
                node = stack[-1]
                node["n"] += r.n_convs
                node["first"] = min(node["first"], r.conv_id)
                node["children"] += r.n_children
                node["leaves"] += r.n_leaves
                node["saved"] += r.saved_tokens
                node["ends"] = r.ends_sha256 if r.ends_sha256 != _NO_ENDS else node["ends"]
            if len(done) >= RANGE:
                yield _frame(done)
                done.clear()
        close(b"\xff")
        if done:
            yield _frame(done)

    below = partial.where(F.octet_length("key") > NAME)
    dealt = below.repartition(partitions(partial.sparkSession), F.substring("key", 1, 2 * NAME)).sortWithinPartitions("key", "n_convs")
    return dealt.mapInPandas(run, _NODE)


def _layer(strings: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(nodes below the layer's roots, the roots, tables to delete once both are read)."""
    runs = spool(_as_runs(strings), "runs")
    cores = strings.sparkSession.sparkContext.defaultParallelism
    ranges = max(cores, -(-runs.count() // RANGE))
    nodes = spool(_merged(runs, depth, ranges), "nodes")
    drop_spool(runs)
    partial = nodes.where("edge")
    edges = spool(_edges(partial), "edges")
    root = F.octet_length("key") == NAME
    own = nodes.where(root).select("key", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", F.col("edge").alias("open"))
    tops = edges.where(F.octet_length("key") == 2 * NAME).select(
        F.col("parent").alias("key"), "conv_id", F.lit(0).alias("n_convs"), F.lit(1).alias("n_children"), "n_leaves", "saved_tokens", F.lit(_NO_ENDS).alias("ends_sha256"), F.lit(True).alias("open")
    )
    roots = own.unionByName(tops).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.coalesce(F.max(F.when(F.col("ends_sha256") != _NO_ENDS, F.col("ends_sha256"))), F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    roots = spool(roots, "roots")
    inner = nodes.where(~F.col("edge") & ~root).unionByName(edges)
    # nodes whose parent lies on an edge learn its smallest member here
    known = edges.select(F.col("key").alias("parent"), F.col("conv_id").alias("found")).unionByName(roots.select(F.col("key").alias("parent"), F.col("conv_id").alias("found")))
    asking = inner.where("parent_conv_id is null").drop("parent_conv_id").join(known, "parent", "left").withColumnRenamed("found", "parent_conv_id")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return inner.where("parent_conv_id is not null").select(*cols).unionByName(asking.select(*cols)), roots, [nodes, edges, roots]


def trie(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations.

    ``turns``: conv_id, turn, role, text and any more. Returns conv_id (smallest
    member), depth, parent_conv_id (of the root: null), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Null roles and texts count as empty;
    rows with a null conv_id belong to no conversation and go; null turns come
    first, equal turns by role and text; repeated rows are turns of their own;
    conversations without turns are members of the root; texts and
    conversations of any length are read whole; an empty table gives no node.
    """
    spark = turns.sparkSession
    ids, rows = rebuilt(turns)
    layers, made = _strings(spark, ids, rows, segment)
    below, out = None, None
    for k in reversed(range(len(layers))):
        strings = layers[k]
        if below is not None:
            totals = below.select(F.col("key").alias("next"), F.col("n_children").alias("c"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
            joined = strings.withColumn("next", F.unhex(F.substring(F.sha2("key", 256), 1, 2 * NAME))).join(totals, "next", "left")
            filled = {f"below_{c}": F.coalesce(F.col(c[0]), F.col(f"below_{c}")) for c in ("children", "leaves", "saved")}
            strings = joined.withColumns(filled).select(*strings.columns)
        nodes, below, used = _layer(strings, k * segment)
        made += used
        out = nodes if out is None else out.unionByName(nodes)
    first = below.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    out = spool(out.unionByName(first), "conversation-trie")
    for df in made:
        drop_spool(df)
    return out


def _strings(spark: SparkSession, ids: DataFrame, rows: DataFrame, segment: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The distinct strings of each layer, and tables to delete at the end."""
    part = F.floor(F.col("place") / segment)
    ordered = F.array_sort(F.collect_list(F.struct("place", "name", "size")))
    cut = rows.groupBy("conv_id", part.alias("part")).agg(ordered.alias("turns"))
    cut = cut.select("conv_id", "part", _joined("turns").alias("names"), F.transform("turns", lambda x: x["size"]).alias("sizes"))
    none = ids.join(rows.select("conv_id").distinct(), "conv_id", "left_anti")
    none = none.select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(b"").alias("names"), F.array().cast("array<int>").alias("sizes"))
    cut = spool(cut.unionByName(none), "segments")
    made = [cut]
    layers = (cut.agg(F.max("part")).first()[0] or 0) + 1
    if layers > 1:
        cut, more = _chained(cut)
        made.append(more)
    else:
        cut = cut.select("conv_id", "part", "names", "sizes", F.lit(_ROOT).alias("before"), F.lit(True).alias("ends"))
    out = []
    for k in range(layers):
        mine = cut.where(F.col("part") == k).withColumn("key", F.concat("before", "names"))
        blocks = mine.groupBy("key", F.floor(F.col("conv_id") / IDS).alias("block")).agg(
            F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("first"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ends"), F.col("conv_id")))), lambda x: x.cast("string")), ",").alias("ids"),
        )
        zero = [F.lit(0).cast("long").alias(f"below_{c}") for c in ("children", "leaves", "saved")]
        blocks = blocks.select("*", *zero, F.lit(None).cast("long").alias("above"))
        dealt = blocks.repartition(partitions(spark), "key").sortWithinPartitions("key", "block")
        strings = _string_rows(dealt)
        if k:  # the nodes that the layer's roots are, with their smallest members
            tops = out[k - 1].select(F.unhex(F.substring(F.sha2("key", 256), 1, 2 * NAME)).alias("top"), F.col("first").alias("known"))
            strings = strings.join(tops, F.substring("key", 1, NAME) == F.col("top")).withColumn("above", F.col("known")).drop("top", "known")
        out.append(spool(strings, f"strings-{k}"))
    return out, made + out


def _joined(turns: str) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda x: F.hex(x["name"])), ""))


def _chained(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with the digest of all before them, by a stream over each conversation's segments that keeps one digest."""

    def run(batches):
        conv, before = None, _ROOT
        for pdf in batches:
            out = []
            for c, names, last in zip(pdf["conv_id"].tolist(), pdf["names"].tolist(), pdf["last"].tolist(), strict=True):
                if c != conv:
                    conv, before = c, _ROOT
                out.append((before, last))
                before = hashlib.sha256(before + names).digest()[:NAME]
            yield pdf[["conv_id", "part", "names", "sizes"]].assign(before=[b for b, _ in out], ends=[e for _, e in out])

    whole = cut.groupBy("conv_id").agg(F.max("part").alias("top"))
    marked = cut.join(whole, "conv_id").withColumn("last", F.col("part") == F.col("top")).drop("top")
    dealt = marked.repartition(partitions(cut.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    found = spool(dealt.mapInPandas(run, "conv_id long, part long, names binary, sizes array<int>, before binary, ends boolean"), "chained")
    return found, found


def trie_sql(table: str) -> str:
    """The same rows in SQL; each turn and prefix by its text's SHA-256."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(len(s)), lambda i: list_prepend(ascii(s[i + 1])::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
    return f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS nth
                   FROM {table} WHERE conv_id IS NOT NULL),
        n AS (SELECT conv_id, strlen(text) AS size, sha256(strlen(role) || ':' || role || text) AS name, nth FROM t),
        c AS (SELECT conv_id, {crc} % {HEADS} AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM n)),
        r AS (SELECT c.conv_id, 0 AS own, nth, name, size FROM c JOIN n ON n.conv_id = c.conv_id - c.conv_id % {BASES} AND nth < h
              UNION ALL SELECT c.conv_id, 1, nth, name, size FROM c JOIN n ON n.conv_id = c.conv_id AND nth >= h),
        p AS (SELECT conv_id, list(name ORDER BY own, nth) AS names, list(size ORDER BY own, nth) AS sizes FROM r GROUP BY 1),
        s AS (SELECT conv_id, coalesce(names, []) AS names, coalesce(sizes, []) AS sizes FROM c LEFT JOIN p USING (conv_id)),
        x AS (SELECT conv_id, unnest(range(len(names) + 1)) AS depth, names, sizes FROM s),
        y AS (SELECT conv_id, depth, sha256(array_to_string(names[:depth], ',')) AS node, CASE WHEN depth > 0 THEN sha256(array_to_string(names[:depth - 1], ',')) END AS parent,
                     CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS size, depth = len(names) AS ends FROM x),
        z AS (SELECT node, depth, any_value(parent) AS parent, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM y GROUP BY 1, 2),
        k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM z WHERE depth > 0 GROUP BY 1, 2),
        w AS (SELECT z.*, coalesce(n_children, 0) AS n_children FROM z LEFT JOIN k USING (node, depth)),
        m AS (SELECT w.conv_id, w.depth AS low, w.n_children = 0 AS leaf, (w.n_convs - 1) * w.size AS saved FROM w),
        u AS (SELECT y.node, y.depth, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved_tokens FROM m JOIN y ON y.conv_id = m.conv_id AND y.depth <= m.low GROUP BY 1, 2)
        SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
        FROM w JOIN u USING (node, depth) LEFT JOIN z o ON o.node = w.parent AND o.depth = w.depth - 1"""
