"""The place of a language model: answers by key, from a table or from a backend on the executors.

Operators take answers as tables. table_answers() reads recorded ones;
model_answers() asks a backend that the caller brings, a batch at a time.
Nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions import logs


class Backend(Protocol):
    """What a model must offer."""

    def is_available(self) -> bool: ...

    def chat_completion(self, messages: list[dict[str, str]]) -> str: ...

    def get_backend_name(self) -> str: ...


#: Answers' schemas by kind.
ANSWERS = {
    "field": "answer string",
    "fields": "answers array<string>",
    "log": "start_entity string, end_entity string, intermediate_entities array<string>",
    "bridge": "bridge_type string, bridge_entity string, confidence double",
    "subgraphs": "names array<string>",
}


def decoded(text: Column, kind: str) -> Column:
    """A model's raw answer as a struct of its kind; null where it holds no such JSON."""
    return F.from_json(logs.fenced_json(text), ANSWERS[kind])


def table_answers(answers: DataFrame, kind: str) -> DataFrame:
    """(kind, key, answer) -> (key, answer's columns)."""
    return answers.where(F.col("kind") == kind).select("key", decoded(F.col("answer"), kind).alias("a")).select("key", "a.*")


def model_answers(prompts: DataFrame, make: Callable[[], Backend], kind: str) -> DataFrame:
    """(key, prompt) -> (key, answer's columns), from a backend that is made once for each task. An unavailable backend answers nothing."""

    def ask(batches: Iterator) -> Iterator:
        backend = make()
        for batch in batches:
            if backend.is_available():
                batch = batch.assign(answer=[backend.chat_completion([{"role": "user", "content": p}]) for p in batch["prompt"]])
                yield batch[["key", "answer"]]

    raw = prompts.select("key", "prompt").mapInPandas(ask, "key string, answer string")
    return raw.select("key", decoded(F.col("answer"), kind).alias("a")).select("key", "a.*")


def field_prompt(code: Column, callee: Column, size: int = 4000) -> Column:
    """Which field a caller hands to a deferring function."""
    return F.concat_ws("\n", F.concat(F.lit("The C function below defers work by calling "), callee, F.lit('. Name the structure field of the work item it passes. Answer as JSON: {"answer": "field"}, or {"answer": null}.')), F.substring(F.coalesce(code, F.lit("")), 1, size))


def fields_prompt(code: Column, size: int = 4000) -> Column:
    """Which fields a function calls through."""
    return F.concat_ws("\n", F.lit('Which structure fields does the C function below call as function pointers? Answer as JSON: {"answers": ["field"]}.'), F.substring(F.coalesce(code, F.lit("")), 1, size))


def log_prompt(text: Column) -> Column:
    """Which functions a log is about."""
    ask = 'Which kernel functions begin and end the call chain that led to this log, and which lie between? Answer as JSON: {"start_entity": "f", "end_entity": "g", "intermediate_entities": ["h"]}.'
    return F.concat_ws("\n", F.lit(ask), F.coalesce(text, F.lit("")))


def subgraphs_prompt(text: Column, names: list[str], k: int) -> Column:
    """Which subgraphs a log is about."""
    return F.concat_ws("\n", F.lit(f'Name the {k} subsystems that this log is most likely about, of: {", ".join(names)}. Answer as JSON: {{"names": ["subsystem"]}}.'), F.coalesce(text, F.lit("")))


def bridge_prompt(code_a: Column, code_b: Column, names: Column, size: int = 800) -> Column:
    """Whether one function reaches another: their texts, cut to size characters, and their neighbours' names."""
    part = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, size)
    return F.concat_ws("\n", F.lit("Does the first function reach the second through a pointer or deferred work? Answer as JSON."), part(code_a), part(code_b), F.concat_ws(", ", names))
