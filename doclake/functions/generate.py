"""Answers by a language model: a pluggable callable, errors as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_line(messages: list[dict]) -> str:
    """The stand-in for a model: the first line of the context part, the last text but one."""
    texts = [m["text"] for m in messages if m["type"] == "text" and m["text"]]
    return (texts[-2] if len(texts) > 1 else texts[-1] if texts else "").split("\n")[0]


def llm_answer(prompts: DataFrame, key: str, messages: str = "messages", model: Callable[[list[dict]], str] = first_line, retries: int = 1) -> DataFrame:
    """key, answer and error: an answer that fails after its retries is null, and its error is kept."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for parts in batch["messages"]:
                answer = error = None
                for _ in range(retries + 1):
                    try:
                        answer, error = model([dict(p) if isinstance(p, dict) else p.asDict() for p in parts]), None
                        break
                    except Exception as e:  # noqa: BLE001  a model's failure is that row's result
                        error = f"{type(e).__name__}: {e}"
                out.append((answer, error))
            yield pd.DataFrame({key: batch[key], "answer": [a for a, _ in out], "error": [e for _, e in out]})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, F.col(messages).alias("messages")).mapInPandas(ask, f"{key} {kind}, answer string, error string")
