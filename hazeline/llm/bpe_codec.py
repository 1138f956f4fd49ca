"""Operator 6: byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from hazeline.llm import bpe
from hazeline.llm.arrays import chunks
from hazeline.llm.runtime import plain, restored

#: Characters encoded at a time in a task.
CHUNK = 1 << 19


def _encoded(texts: list[str], rank_path: str):
    """Ids of each text, in order."""
    model = bpe.encoder(rank_path)
    if not hasattr(model, "batch"):
        model.batch = bpe.BatchEncoder(lambda w: model.encode(w.encode()))
    for i, j in chunks(texts, CHUNK):
        ids, offsets = model.batch.encode(texts[i:j])
        for k in range(j - i):
            yield ids[offsets[k] : offsets[k + 1]]


def encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>`` per row of ``docs``.

    Null and empty texts give an empty array, a null id stays null, repeated
    rows give repeated results, and an empty table gives an empty one. Special
    tokens are ordinary text. ``rank_path`` must be readable on every executor.
    """

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "ids": list(_encoded(pdf["text"].tolist(), rank_path))})

    return restored(plain(docs, id_col, text_col).mapInPandas(run, "id string, ids array<int>"), docs, id_col)


def decode(encoded: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``data binary``: the bytes of each id array; null arrays give empty bytes."""

    def run(batches):
        model = bpe.encoder(rank_path)
        for pdf in batches:
            data = [b"" if ids is None else model.decode(list(ids)) for ids in pdf["ids"]]
            yield pd.DataFrame({"id": pdf["id"], "data": data})

    source = encoded.select(encoded[id_col].cast("string").alias("id"), encoded[ids_col].alias("ids"))
    return restored(source.mapInPandas(run, "id string, data binary"), encoded, id_col)


def round_trip(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text and digest both: id, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    Edge cases as in :func:`encode`; the digests of an empty text are those of
    no bytes.
    """

    def run(batches):
        model = bpe.encoder(rank_path)
        for pdf in batches:
            rows = []
            texts = pdf["text"].tolist()
            for ids in _encoded(texts, rank_path):
                ids = ids.tolist()
                data = model.decode(ids)
                said = " ".join(map(str, ids))
                rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(data).hexdigest(), len(data)))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out.astype({"n_tokens": np.int64, "n_bytes": np.int64})

    out = "id string, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"
    return restored(plain(docs, id_col, text_col).mapInPandas(run, out), docs, id_col)
