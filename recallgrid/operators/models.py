"""Where models plug in: embeddings, captions and importance scores in batches of a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .episodes import caption_marker, captionable, uncaptioned

BATCH = 40


def fill_embeddings(facts: DataFrame, embed: Callable[[list[str]], list[list[float]] | None]) -> DataFrame:
    """facts with vectors where they were missing; a failed batch stays without."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), BATCH):
                part = f.iloc[k : k + BATCH].copy()
                try:
                    found = embed(part["content"].tolist())
                except Exception:  # noqa: BLE001  recall works without vectors
                    found = None
                part["embedding"] = pd.Series(found or [None] * len(part), index=part.index, dtype=object)
                yield part

    missing = F.col("embedding").isNull()
    return facts.where(~missing).unionByName(facts.where(missing).mapInPandas(run, facts.schema))


def caption_pending(attachments: DataFrame, captions: DataFrame, see: Callable[[str, str], str | None], model: str, now: float) -> DataFrame:
    """New caption rows for images without text: see(stored_name, mime) gives the words; nothing said, no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"attachment_id": f["id"], "words": [see(n, m) for n, m in zip(f["stored_name"], f["mime"], strict=True)]})

    seen = captionable(uncaptioned(attachments, captions)).select("id", "stored_name", "mime").mapInPandas(run, "attachment_id long, words string").where("words <> ''")
    return seen.select("attachment_id", caption_marker(F.lit(model), F.col("words")).alias("caption"), F.lit(model).alias("model"), F.lit(float(now)).alias("created_at"))


def score_importance(facts: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """pos, text: the model's replies for facts without importance, BATCH facts a call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), BATCH):
                part = f.iloc[k : k + BATCH]
                lines = "\n".join(f"{i}: {c}" for i, c in zip(part["id"], part["content"], strict=True))
                yield pd.DataFrame({"pos": [int(part["id"].iloc[0])], "text": [complete(lines) or ""]})

    return facts.where("importance is null").select("id", "content").mapInPandas(run, "pos long, text string")
