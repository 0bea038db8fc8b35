"""Where models plug in: embedding, one call a row, a loop of tool calls. A model is any function that can be pickled.

A model is made once for each Python worker, by make(); rows go to it in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedding(text: Column, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Column:
    """embed(texts) -> vectors, a call for each batch; null texts have null vectors."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for x in batches:
            given = x[x.notna()]
            out = pd.Series([None] * len(x), index=x.index, dtype=object)
            if len(given):
                for i, v in zip(given.index, embed(list(given)), strict=True):
                    out[i] = [float(y) for y in v]
            yield out

    return run(text)


def each(rows: DataFrame, keys: list[str], inputs: list[str], make: Callable[[], Callable[..., str]]) -> DataFrame:
    """keys, content, status: answer(**inputs) for each row. An exception is that row's content, with status error."""
    shape = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "content string", "status string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = make()
        for b in batches:
            content, status = [], []
            for r in b.select(inputs).to_pylist():
                try:
                    content.append(answer(**r))
                    status.append("processed")
                except Exception as e:
                    content.append(f"# Error: {e}")
                    status.append("error")
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(content, pa.string()), pa.array(status, pa.string())], [*keys, "content", "status"])

    return rows.select(*keys, *[c for c in inputs if c not in keys]).mapInArrow(run, shape)


def tool_loop(rows: DataFrame, keys: list[str], prompt: str, make: Callable[[], Callable[[list], tuple[str, list]]], tools: dict[str, Callable[..., str]], most: int = 150) -> DataFrame:
    """keys, iteration, call, tool, args, result: a row for each tool call and one, without a tool, for the last answer.

    turn(messages) -> (text, calls), a call is (tool, args). The loop ends with a turn without calls or after `most`
    turns. A tool that isn't there, wrong arguments and other errors are answered by a message.
    """
    shape = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "iteration int, call int, tool string, args string, result string"])

    def call(tool: str, args: dict) -> str:
        if tool not in tools:
            return f"Unknown tool: {tool}"
        try:
            return tools[tool](**args)
        except TypeError as e:
            return f"Invalid arguments for {tool}: {e}"
        except Exception as e:
            return f"Error calling {tool}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        turn = make()
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(len(keys)).to_pylist()):
                messages = [("user", text)]
                for n in range(1, most + 1):
                    said, calls = turn(messages)
                    messages.append(("assistant", said))
                    for k, (tool, args) in enumerate(calls):
                        result = call(tool, args)
                        messages.append(("tool", result))
                        at.append(i)
                        out.append((n, k, tool, json.dumps(args, sort_keys=True), result))
                    if not calls or n == most:
                        at.append(i)
                        out.append((n, len(calls), None, None, said))
                        break
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            cols = [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(pa.array(at, pa.int64())) for j in range(len(keys))), *cols], [*keys, "iteration", "call", "tool", "args", "result"])

    return rows.select(*keys, F.col(prompt).alias("_prompt")).mapInArrow(run, shape)


def evaluated(examples: DataFrame, metric: Callable[[DataFrame], Column] | Column, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """Each example with its score, and the mean of all: an example whose metric is null counts as 0."""
    x = examples.withColumn(score, F.coalesce(metric(examples) if callable(metric) and not isinstance(metric, Column) else metric, F.lit(0.0)))
    return x, x.agg(F.avg(score).alias("mean"), F.count("*").alias("n"))
