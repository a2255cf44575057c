"""Calls of models that live elsewhere: the client is given by the caller and made once per partition."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[dict[str, Any]], str]


def called(df: DataFrame, make_client: Callable[[], Client], out: str = "answer", retries: int = 3, wait: float = 3.0, at_once: int = 8) -> DataFrame:
    """df with the client's answer to each row, and error where every try failed (answer null then).

    A partition keeps at most at_once calls open; tries are wait, 2 x wait, ... apart.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def one(row: dict[str, Any]) -> tuple[str | None, str | None]:
            for i in range(max(1, retries)):
                try:
                    return client(row), None
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                    if i + 1 < retries:
                        time.sleep(wait * (i + 1))
            return None, error

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(one, b.to_dict("records")))
                yield b.assign(**{out: [g[0] for g in got], "error": [g[1] for g in got]})

    return df.mapInPandas(run, schema)


def answer_text(content: Column | str, reasoning: Column | str) -> Column:
    """The content, or what was reasoned where the content is empty."""
    return F.coalesce(F.nullif(content, F.lit("")), F.col(reasoning) if isinstance(reasoning, str) else reasoning)


# Sampler settings by profile.
SAMPLERS = {"plain": {"temperature": 0.3}, "app": {"temperature": 0.7, "top_p": 0.8, "top_k": 20}, "greedy": {"temperature": 0.0}}
