"""Model completions: calling a backend, replaying stored answers, resuming."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.fixed_values import MAX_ATTEMPTS, RETRY_WAIT_SECONDS
from pagemill.sources.answers import AnswerLog

KEYS = ("seq", "stage", "category")
Backend = Callable[..., list[str | None]]


def _call_halving(backend: Backend, prompts: list[str]) -> list[str | None]:
    """Answers of one attempt. A call that raises is made again for each half, so that a
    bad prompt takes no other with it and costs few calls."""
    try:
        replies = backend(prompts)
        if len(replies) != len(prompts):
            raise ValueError(f"backend gave {len(replies)} answers to {len(prompts)} prompts")
        return list(replies)
    except Exception:  # noqa: BLE001 - whatever a backend raises counts as a failed attempt
        half = len(prompts) // 2
        if not half:
            return [None]
        return _call_halving(backend, prompts[:half]) + _call_halving(backend, prompts[half:])


def _call_with_retries(
    backend: Backend,
    prompts: list[str],
    attempts: int,
    wait: tuple[float, float],
    batch_size: int,
    keep: Callable[[list[tuple[int, str, int]]], None] = lambda answered: None,
) -> list[tuple[str | None, int]]:
    """Answer and attempts used per prompt.

    All prompts are sent once, in calls of ``batch_size``; those without an answer
    are then sent again together, after one wait for all of them. ``keep`` gets
    (place, answer, attempt) of what each call has answered.
    """
    answers: list[tuple[str | None, int]] = [(None, attempts)] * len(prompts)
    open_ = list(range(len(prompts)))
    for attempt in range(1, attempts + 1):
        failed = []
        for start in range(0, len(open_), batch_size):
            group = open_[start : start + batch_size]
            answered = []
            for i, reply in zip(group, _call_halving(backend, [prompts[i] for i in group])):
                if reply is None:
                    failed.append(i)
                else:
                    answers[i] = (reply, attempt)
                    answered.append((i, reply, attempt))
            keep(answered)
        open_ = failed
        if not open_:
            break
        if attempt < attempts:
            time.sleep(random.uniform(*wait))
    return answers


def _answers(
    batches: Iterator[tuple[pd.Series, ...]], send: Callable[..., list], log: AnswerLog | None, partition: int
) -> Iterator[pd.DataFrame]:
    """Answers to batches of (prompt, hash, known answer, its attempt). Only prompts that neither
    an earlier job nor an earlier attempt of the task has an answer to are sent."""
    earlier = log.of_partition(partition) if log else {}
    for prompts, hashes, answers, tries in batches:
        rows = [
            (answer, int(tried)) if answer is not None else earlier.get(key)
            for key, answer, tried in zip(hashes, answers, tries.fillna(0))
        ]
        open_ = [place for place, row in enumerate(rows) if row is None]
        keys = hashes.tolist()

        def keep(answered: list[tuple[int, str, int]]) -> None:
            if log:
                log.add(partition, [(keys[open_[i]], reply, attempt) for i, reply, attempt in answered])

        for place, row in zip(open_, send([prompts.iloc[place] for place in open_], keep=keep)):
            rows[place] = row
        yield pd.DataFrame(rows, columns=["completion", "attempts"])


def generate(
    df: DataFrame,
    prompt: Column,
    backend: Backend,
    *,
    options: Mapping[str, Any] | None = None,
    batch_size: int = 64,
    concurrency: int | None = None,
    attempts: int = MAX_ATTEMPTS,
    wait: tuple[float, float] = RETRY_WAIT_SECONDS,
    log: AnswerLog | None = None,
) -> DataFrame:
    """Add ``completion`` (null if all attempts failed), ``attempts`` and
    ``prompt_hash``.

    The backend is any picklable callable of a list of prompts that returns one
    answer or None for each; sampling ``options`` are handed to it as keywords.
    Only the prompt and its hash travel to Python. The UDF is marked
    nondeterministic, so that the optimizer never evaluates it twice for a row;
    write the result to a stage table before reading it more than once.
    ``concurrency`` bounds the calls in flight by joining partitions: rows are not
    shuffled and keep their order. For more calls at once than the scan has
    tasks, read it in smaller splits (``spark.sql.files.maxPartitionBytes``).

    With a ``log`` the answers of each call are kept before the next call. A task that is
    lost sends only what its lost call held again; a job that is started again joins what the log
    has by prompt hash. Rows of equal prompts may then share an answer.
    """

    send = partial(
        _call_with_retries, partial(backend, **(options or {})), attempts=attempts, wait=wait, batch_size=batch_size
    )

    @F.pandas_udf("completion string, attempts int")
    def call(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return _answers(batches, send, log, TaskContext.get().partitionId())

    if concurrency is not None:
        df = df.coalesce(concurrency)
    asked = df.withColumn("_prompt", prompt).withColumn("prompt_hash", F.sha2("_prompt", 256))
    kept = log.table(df.sparkSession) if log else None
    if kept is None:
        known = F.lit(None).cast("string"), F.lit(None).cast("int")
    else:
        kept = kept.select("prompt_hash", F.col("answer").alias("_kept"), F.col("attempt").alias("_kept_attempt"))
        asked = asked.join(kept, "prompt_hash", "left")
        known = F.col("_kept"), F.col("_kept_attempt")
    return (
        asked.withColumn("_answer", call.asNondeterministic()("_prompt", "prompt_hash", *known))
        .withColumn("completion", F.col("_answer.completion"))
        .withColumn("attempts", F.col("_answer.attempts"))
        .select(*df.columns, "prompt_hash", "completion", "attempts")
    )


def succeeded(df: DataFrame, answer: str = "completion") -> DataFrame:
    return df.filter(F.col(answer).isNotNull())


def failures(df: DataFrame, columns: Sequence[str], answer: str = "completion") -> DataFrame:
    """Rows that failed every attempt, to be listed and not to vanish."""
    return df.filter(F.col(answer).isNull()).select(*columns, "attempts", "prompt_hash")


def attach_completions(df: DataFrame, completions: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    """Replay stored completions, by key and never by position."""
    return df.join(completions, list(on), "left")


def pending_rows(df: DataFrame, done: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    """Rows with no completion yet."""
    return df.join(done.select(*on), list(on), "left_anti")
