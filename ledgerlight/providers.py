"""Model calls behind one protocol, with a deterministic offline default."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def generate(self, prompts: list[str]) -> list[str]: ...


class OfflineProvider:
    """Embeds by hashed words; answers with the facts of the prompt, lines that begin with a dash. For tests and dry runs."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    def generate(self, prompts: list[str]) -> list[str]:
        facts = [[x[2:] for x in (p or "").split("\n") if x.startswith("- ")] for p in prompts]
        return [f"FINAL ANSWER: {'; '.join(f)}" if f else "FINAL ANSWER: not available" for f in facts]


def embed_column(rows: DataFrame, provider: Provider, key: str, text: str) -> DataFrame:
    """(key, embedding); equal texts are embedded once and joined back."""
    own = rows.select(text).where(F.col(text).isNotNull()).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({text: pdf[text], "embedding": provider.embed(pdf[text].tolist())})

    return rows.select(key, text).join(own.mapInPandas(run, f"{text} string, embedding array<float>"), text).select(key, "embedding")


def generate_column(rows: DataFrame, provider: Provider, key: str, prompt: str) -> DataFrame:
    """(key, answer) for each prompt."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "answer": provider.generate(pdf[prompt].tolist())})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string")


def ensure_marker(rows: DataFrame, provider: Provider, key: str, marker: str = "FINAL ANSWER:") -> DataFrame:
    """Asks once more, naming what is missing, where the ``answer`` to a ``prompt`` has no final line; keeps the first answer if
    the second has none either."""
    again = F.concat("prompt", F.lit("\n\nYour previous answer had no line that begins with '" + marker + "':\n"), "answer", F.lit("\n\nAnswer the same question again from the same evidence and end with that line."))
    lacking = rows.where(~F.coalesce("answer", F.lit("")).contains(marker)).select(key, again.alias("prompt"))
    second = generate_column(lacking, provider, key, "prompt").where(F.col("answer").contains(marker)).withColumnRenamed("answer", "second_")
    return rows.join(second, key, "left").withColumn("answer", F.coalesce("second_", "answer")).drop("second_")


def retry_refusals(rows: DataFrame, provider: Provider, key: str, refused, marker: str = "FINAL ANSWER:") -> DataFrame:
    """Asks refused questions once more with the retrieved ``text`` alone; a second refusal, or no text, changes nothing."""
    from .functions.text import is_refusal

    prompt = F.concat("question", F.lit("\nAnswer from this text only, in your own words, and end with a line that begins with '" + marker + "'.\n"), "text")
    second = generate_column(rows.where(refused & (F.trim(F.coalesce("text", F.lit(""))) != "")).select(key, prompt.alias("prompt")), provider, key, "prompt")
    second = second.where(~is_refusal(F.col("answer"))).withColumnRenamed("answer", "second_")
    return rows.join(second, key, "left").withColumn("answer", F.coalesce("second_", "answer")).drop("second_")
