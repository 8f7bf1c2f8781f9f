"""A table of model answers by content: texts that were answered before are joined, only new ones are asked.

The address of a text is the SHA-256 of the model's name and the text, so equal texts share one call whatever asks for them. Answers
are committed a run at a time (``RunStore``): a run that is lost before its commit leaves nothing, and its texts are asked again.
Failures are rows of their run, never answers, so the next request asks them anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
import time

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skein.providers import ProviderError, with_retries
from skein.session import ship, stage
from skein.sources.runs import RunStore

EMPTY = "empty text"


@dataclass(frozen=True)
class ColumnModel:
    """A model that is a Column expression, as the offline ones are: no Python worker, no pacing."""

    name: str
    reader: Callable[[Column], Column]

    def answer(self, missing: DataFrame, kind: str) -> DataFrame:
        value = self.reader(F.col("text")).cast(kind)
        return missing.select("key", value.alias("answer")).withColumn("error", F.when(F.col("answer").isNull(), "no answer"))


@dataclass(frozen=True)
class PacedModel:
    """A model called from ``callers`` tasks, which together make no more than ``per_second`` calls.

    ``call(texts) -> answers`` gets up to ``batch`` texts. A batch whose call fails for good gives a failure row for each of its texts; any
    other exception fails the task, which Spark runs again, so a lost executor can repeat calls but never doubles answers.
    """

    name: str
    call: Callable[[list[str]], list]
    per_second: float = 10.0
    callers: int = 4
    batch: int = 1
    attempts: int = 3
    pause: float = 2.0

    def answer(self, missing: DataFrame, kind: str) -> DataFrame:
        ship(missing.sparkSession)
        call, size, gap = with_retries(self.call, self.attempts, self.pause), self.batch, self.callers / self.per_second

        def one(texts: list[str]) -> tuple[list, list]:
            try:
                found = list(call(texts))
            except ProviderError as problem:
                return [None] * len(texts), [str(problem) or "model call failed"] * len(texts)
            if len(found) != len(texts):
                return [None] * len(texts), ["the model returned another number of answers than texts"] * len(texts)
            return found, [None if f is not None else "no answer" for f in found]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            free = 0.0
            for frame in frames:
                texts = frame["text"].tolist()
                answers, errors = [], []
                for at in range(0, len(texts), size):
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = time.monotonic() + gap
                    found, problems = one(texts[at:at + size])
                    answers += found
                    errors += problems
                yield pd.DataFrame({"key": frame["key"], "answer": pd.Series(answers, index=frame.index, dtype=object),
                                    "error": pd.Series(errors, index=frame.index, dtype=object)})

        # a stated number of partitions is not coalesced, so the rate holds
        return missing.repartition(self.callers, "key").mapInPandas(run, f"key binary, answer {kind}, error string")


class AnswerMemo:
    """Answers of type ``kind`` below ``root``, which belongs to this memo alone."""

    TABLE = "calls"

    def __init__(self, store: RunStore, kind: str = "string"):
        self.store, self.kind = store, kind
        self.schema = f"key binary, answer {kind}, error string"

    def calls(self) -> DataFrame:
        """All committed calls: ``key, answer, error``."""
        paths = [f"{self.store.root}/{self.TABLE}/run={run}" for run in self.store.completed()]
        spark = self.store.spark
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def known(self) -> DataFrame:
        """One answer per key; two ingests at once may both have asked for a text, then the least answer counts."""
        return self.calls().filter("answer IS NOT NULL").groupBy("key").agg(F.min("answer").alias("answer"))

    def answers(self, requests: DataFrame, model) -> DataFrame:
        """``requests(id, text)`` to ``(id, text, answer, error)``, every row kept; null and empty texts are not asked."""
        rows = requests.select("id", "text").withColumn("key", F.when(F.col("text") != "", address(model.name, F.col("text"))))
        texts = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("text").alias("text"))
        missing = stage(texts.join(self.known().select("key"), "key", "left_anti"), "asked")
        failed = self.store.spark.createDataFrame([], "key binary, error string")
        if not missing.isEmpty():
            run = self.store.start()
            self.store.write(run, self.TABLE, model.answer(missing, self.kind))
            self.store.commit(run, [self.TABLE])
            failed = self.store.read(self.TABLE, run).filter("answer IS NULL").select("key", "error")
        told = rows.join(self.known(), "key", "left").join(failed, "key", "left")
        problem = F.when(F.col("key").isNull(), EMPTY).when(F.col("answer").isNull(), F.coalesce("error", F.lit("no answer")))
        return told.select("id", "text", "answer", problem.alias("error"))

    def ask(self, model) -> Callable[[DataFrame], DataFrame]:
        return lambda requests: self.answers(requests, model)

    def compact(self) -> str:
        """All answers as one run; failures and older runs go. An answer committed meanwhile may be lost, and is asked again."""
        run = self.store.save({self.TABLE: self.known().withColumn("error", F.lit(None).cast("string"))})
        self.store.retain(1)
        return run


def address(model: str, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(f"{model}\n"), text).cast("binary"), 256))
