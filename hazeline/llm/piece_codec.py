"""Operator 11: SentencePiece encoding and decoding of whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from hazeline.llm import pieces
from hazeline.llm.arrays import chunks
from hazeline.llm.runtime import plain, restored

#: Characters encoded at a time in a task.
CHUNK = 1 << 21


def _encoded(texts: list[str], path: str):
    """Ids of each text, in order, with the end id."""
    model = pieces.model(path)
    for i, j in chunks(texts, CHUNK):
        ids, offsets = model.encode_batch(texts[i:j])
        for k in range(j - i):
            yield [*ids[offsets[k] : offsets[k + 1]].tolist(), model.end]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>`` per row of ``docs``; each array ends with the end id.

    Null and empty texts give the end id alone, a null id stays null, repeated
    rows give repeated results, an empty table gives an empty one, and texts of
    any length are encoded whole. Characters without a piece become bytes, and
    the spelling of a control piece is ordinary text. ``path`` must be readable
    on every executor.
    """

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "ids": list(_encoded(pdf["text"].tolist(), path))})

    return restored(plain(docs, id_col, text_col).mapInPandas(run, "id string, ids array<int>"), docs, id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text string``: what each id array says; null arrays give an empty text, control ids say nothing."""

    def run(batches):
        model = pieces.model(path)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "text": ["" if ids is None else model.decode(list(ids)) for ids in pdf["ids"]]})

    source = encoded.select(encoded[id_col].cast("string").alias("id"), encoded[ids_col].alias("ids"))
    return restored(source.mapInPandas(run, "id string, text string"), encoded, id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text and digest both: id, n_tokens (with the end id), ids_sha256, decoded_sha256.

    Edge cases as in :func:`encode`.
    """

    def run(batches):
        model = pieces.model(path)
        said = [str(i) for i in range(len(model.shown))]
        for pdf in batches:
            rows = []
            for ids in _encoded(pdf["text"].tolist(), path):
                spoken = " ".join([said[i] for i in ids]).encode()
                rows.append((len(ids), hashlib.sha256(spoken).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out.astype({"n_tokens": np.int64})

    out = "id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return restored(plain(docs, id_col, text_col).mapInPandas(run, out), docs, id_col)
