"""Run a user-supplied model over rows, and the registries that pick operators."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions.text import _LINE_END, WHITESPACE, clean_lines, short_hash, token_cost
from quillwork.operators.sequence import sequence_ratio as _ratio

# Attempts and the linear wait between them.
ATTEMPTS = 3
BACKOFF_SECONDS = 2.0

RESULT_FIELDS = (
    "content string, status string, attempts int, latency_ms long, input_tokens long, "
    "output_tokens long, error string"
)


def batch_infer(
    df: DataFrame,
    make_client: Callable[[], Callable[[Mapping], tuple[str, int, int]]],
    inputs: Sequence[str],
    attempts: int = ATTEMPTS,
    backoff: float = BACKOFF_SECONDS,
) -> DataFrame:
    """Add the model's answer, or its error, to every row.

    `make_client()` runs once per task and returns a function from the row's
    `inputs` to (text, input tokens, output tokens). A failing row is tried
    again after 1, 2, ... times `backoff` seconds and then carries its error;
    the other rows go on. Put filters ahead of this operator: Catalyst cannot
    move one through Python code.
    """
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(RESULT_FIELDS).fields])
    names = list(inputs)

    def ask(client, row: dict) -> tuple:
        error = ""
        for attempt in range(1, attempts + 1):
            started = time.monotonic()
            try:
                text, tokens_in, tokens_out = client(row)
                spent = int((time.monotonic() - started) * 1000)
                return text or "", "SUCCESS", attempt, spent, tokens_in, tokens_out, None
            except Exception as exc:  # noqa: BLE001 - the row carries it
                error = str(exc)
                if attempt < attempts:
                    time.sleep(backoff * attempt)
        return "", "FAILED", attempts, 0, 0, 0, error

    fields = [f.split()[0] for f in RESULT_FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            asked = [ask(client, r) for r in batch[names].to_dict("records")]
            answers = pd.DataFrame(asked, columns=fields, index=batch.index)
            yield pd.concat([batch, answers], axis=1)

    return df.mapInPandas(run, schema)


def session_status(answers: DataFrame, key: str) -> DataFrame:
    """A session fails only when every one of its rows failed."""
    good = F.count_if(F.col("status") == "SUCCESS")
    return answers.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"),
        good.alias("succeeded"),
        F.when(good > 0, "COMPLETED").otherwise("FAILED").alias("session_status"),
    )


def run_ledger(answers: DataFrame, stage: str, prompt: str, version: str) -> DataFrame:
    """One ledger row per model call; failed calls have no tokens and no cost."""
    return answers.select(
        "session_id",
        "document_id",
        F.lit(stage).alias("stage"),
        "model",
        F.lit(prompt).alias("prompt_name"),
        F.lit(version).alias("prompt_version"),
        short_hash(F.coalesce("system_prompt", F.lit(""))).alias("system_prompt_hash"),
        short_hash(F.coalesce("user_prompt", F.lit(""))).alias("user_prompt_hash"),
        "input_tokens",
        "output_tokens",
        token_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")).alias("estimated_cost"),
        "latency_ms",
        "status",
    )


class Registry:
    """Named operators. With a default, an unknown name stands for it; else it is an error."""

    def __init__(self, default: str | None = None):
        self._items: dict[str, Callable] = {}
        self._default = default

    def register(self, name: str, item: Callable) -> Callable:
        self._items[name] = item
        return item

    def names(self) -> list[str]:
        return sorted(self._items)

    def get(self, name: str | None) -> Callable:
        if name not in self._items and self._default is not None:
            name = self._default
        if name not in self._items:
            raise ValueError(f"unknown name: {name!r}; known: {self.names()}")
        return self._items[name]


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of two texts, by Arrow batches."""
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b)], index=a.index)


def register_functions(spark) -> None:
    """Make the functions below callable from SQL."""
    spark.udf.register("sequence_ratio", sequence_ratio)
    ends = _LINE_END.replace("\\", "\\\\")
    blanks = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION explode_lines(text STRING) RETURNS TABLE (pos INT, line STRING)
        RETURN SELECT * FROM (SELECT posexplode(filter(
            transform(split(text, '{ends}'), x -> btrim(x, '{blanks}')), x -> x <> '')) AS (pos, line))"""
    )


def explode_lines(df: DataFrame, text: str) -> DataFrame:
    """(…, pos, line): the built-in twin of the SQL table function."""
    rest = [c for c in df.columns if c != text]
    rows = df.select(*rest, F.posexplode_outer(clean_lines(F.col(text))).alias("pos", "line"))
    return rows.filter("line is not null")


def with_defaults(options: Column, defaults: Mapping[str, object]) -> Column:
    """JSON options -> struct; malformed JSON or a missing field gives the default."""
    parsed = F.try_parse_json(options)
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    return F.struct(
        *[
            F.coalesce(F.try_variant_get(parsed, f"$.{k}", kinds[type(v)]), F.lit(v)).alias(k)
            for k, v in defaults.items()
        ]
    )
