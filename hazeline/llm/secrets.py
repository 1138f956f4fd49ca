"""Operator 3: secret scans, with corpus-wide ownership frequency of the values found.

Patterns propose candidates. Every candidate value is hashed, and the hashes
are counted by distinct repositories (documents) and owners (sources): a value
that several owners hold, or very many repositories of one owner, is a copied
example; one that few hold and that looks random is live. Live values of the wide pattern add spans to those
of the base patterns, which always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm.runtime import spool, text_column

# The base patterns; letters of the first in either case.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "wide")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Wide candidates: runs of 20 or more signs of keys, with at least this many bits of entropy a sign.
WIDE = r"(?a:(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2})"
MIN_ENTROPY = 3.2
#: Owners, and repositories of any owners, from which on a value counts as a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 25

_ASSIGN, _ACCESS, _HEX, _WIDE = re.compile(ASSIGN), re.compile(ACCESS), re.compile(r"[0-9a-f]{32,}"), re.compile(WIDE)
_HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the base patterns, by start and then kind."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # greedy runs of hex signs: those of 32 or more are what the bounded pattern finds
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def wide_spans(text: str, base: list) -> list[tuple[int, int, int, int, int]]:
    """Runs that look random (letters of both kinds or digits among them, enough entropy) and touch no base span."""
    out = []
    for m in _WIDE.finditer(text):
        v, a, b = m.group(), m.start(), m.end()
        mixed = any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
        if mixed and entropy(v) >= MIN_ENTROPY and not any(s < b and a < e for s, _, e, _, _ in base):
            out.append((a, 3, b, a, b))
    return out


_FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """id, owner, found: array of spans with each value's digest."""

    def run(batches):
        for pdf in batches:
            found = []
            for text in pdf.pop("text"):
                base = base_spans(text)
                every = base + wide_spans(text, base)
                found.append([(s, k, e, hashlib.blake2b(text[a:b].encode(), digest_size=16).hexdigest()) for s, k, e, a, b in every])
            yield pdf.assign(found=pd.Series(found, index=pdf.index, dtype=object))

    source = docs.select(
        docs[id_col].cast("string").alias("id"), F.coalesce(docs[owner_col].cast("string"), F.lit("")).alias("owner"), text_column(docs, text_col).alias("text")
    )
    return source.mapInPandas(run, f"id string, owner string, found {_FOUND}")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Secrets of each row: id, n_assign, n_access, n_hex, base_sha256, spans, found, n_live, n_example.

    ``found`` is an array of (start, kind, end, value digest, owners,
    repositories, live) by start and kind; ``spans`` is its text form,
    kind:start:end with commas. Null and empty texts have no spans; a null id
    or owner stays or counts as one empty owner; repeated rows give repeated
    results and are one repository; an empty table gives an empty one.
    """
    found = spool(candidates(docs, id_col, text_col, owner_col).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = found.select("row", "id", "owner", F.explode("found").alias("c")).select("row", "id", "owner", "c.*")
    held = each.groupBy("value", "owner").agg(F.count_distinct(F.coalesce("id", F.lit(""))).alias("repositories"))
    held = held.groupBy("value").agg(F.count("owner").alias("owners"), F.sum("repositories").alias("repositories"))
    held = spool(held, "ownership")  # the join below can then be split where one value is frequent
    live = ((F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)).alias("live")
    judged = each.join(held, "value").select("row", F.struct("start", "kind", "end", "value", "owners", "repositories", live).alias("s"))
    judged = judged.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("found"))
    kept = F.filter("found", lambda s: (s["kind"] < 3) | s["live"])
    examples = F.size(F.filter("found", lambda s: ~s["live"])).cast("long")
    # most rows have no candidate: they need no join
    none = F.lit(None).cast(judged.schema["found"].dataType)
    rows = (
        found.where(F.size("found") > 0).select("row", "id").join(judged, "row").select("id", kept.alias("found"), examples.alias("n_example"))
        .unionByName(found.where(F.size("found") == 0).select("id", F.coalesce(none, F.array().cast(judged.schema["found"].dataType)).alias("found"), F.lit(0).cast("long").alias("n_example")))
    )
    names = F.array(*map(F.lit, KINDS))
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    return rows.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        *(of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        "n_example",
        "found",
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mask: str = "[secret]") -> DataFrame:
    """``docs`` with the values of all spans but copied examples of the wide pattern replaced by ``mask``.

    Rows and columns stay; ``n_chars``, if there, is counted again for changed
    texts. Null texts stay null, null ids and owners stay, repeated rows are
    all changed alike, texts of any length are scanned whole, and an empty
    table gives an empty one. Overlapping spans are blanked together.
    """
    others = [c for c in docs.columns if c != text_col]
    keys = [F.xxhash64(docs[id_col], docs[text_col], docs[owner_col]), F.xxhash64(docs[owner_col], docs[text_col], docs[id_col])]
    keyed = docs.withColumn("hazeline_key", F.concat_ws(":", *keys))
    spans = scan(keyed.select(F.col("hazeline_key"), keyed[text_col], keyed[owner_col]), "hazeline_key", text_col, owner_col)
    spans = spans.where("spans != ''").select("hazeline_key", F.col("found").alias("hazeline_found")).dropDuplicates(["hazeline_key"])

    def blank(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(text, found, strict=True):
            if t is None or spans is None or len(spans) == 0:
                out.append(t)
                continue
            made, at = [], 0
            for s in spans:
                a, b = s["start"], s["end"]
                if a >= at:
                    made += [t[at:a], mask]
                at = max(at, b)
            out.append("".join([*made, t[at:]]))
        return pd.Series(out)

    blanked = F.pandas_udf(blank, T.StringType())(F.col(text_col), F.col("hazeline_found"))
    joined = keyed.join(spans, "hazeline_key", "left").withColumn(text_col, blanked)
    if "n_chars" in others:
        joined = joined.withColumn("n_chars", F.when(F.col("hazeline_found").isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
