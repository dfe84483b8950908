"""Pluggable model calls. A provider maps texts to texts, labels or vectors in batches; these stubs need no model.

``apply(rows, provider)`` runs one over a column with Arrow batches, so that a real model is loaded once a worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Width of stub vectors.
WIDTH = 64


def hashed_embedding(texts: list[str]) -> list[list[float]]:
    """Words hashed into WIDTH signed places, unit length (zero for no words)."""
    out = np.zeros((len(texts), WIDTH))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % WIDTH] += 1 if h >> 32 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).tolist()


def first_sentences(texts: list[str], most: int = 2) -> list[str]:
    """Extractive summary: the first sentences."""
    return [" ".join(re.split(r"(?<=[.!?])\s+", (t or "").strip())[:most]) for t in texts]


def unreachable(texts: list[str]) -> list[str | None]:
    """A model that never answers: callers fall back to what they have."""
    return [None] * len(texts)


def apply(rows: DataFrame, provider: Callable[[list[str]], list], text: str, out: str, kind: str) -> DataFrame:
    """``rows`` with ``provider``'s answer to the column ``text``."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: pd.Series(provider(f[text].tolist()), index=f.index, dtype=object)})

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out}` {kind}"
    return rows.mapInPandas(run, schema)


def first_json(text: str | None) -> str | None:
    """The first JSON object or array in a noisy answer; null where there is none."""
    import json

    for m in re.finditer(r"[\[{]", text or ""):
        try:
            return json.dumps(json.JSONDecoder().raw_decode(text[m.start() :])[0])
        except ValueError:
            continue
    return None
