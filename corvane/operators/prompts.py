"""Prompt wrapping and guarded generation around a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of model files and the prompt formats they want; the first that matches counts.
FORMATS = (
    (("mistral", "llama", "orca", "vicuna", "solar"), "mistral"),
    (("phi-3", "phi3", "phi_3"), "phi3"),
    (("hermes", "openhermes", "qwen", "chatml", "nous"), "chatml"),
)
SYSTEM = "Answer only from the passages given. Cite each passage you use by its number. If they don't answer the question, say so."
DISCLAIMER = "This answer is drawn from the retrieved passages only and is not legal advice."


def prompt_format(model_file: Column) -> Column:
    name = F.lower(F.substring_index(model_file, "/", -1))
    out = None
    for marks, kind in FORMATS:
        hit = name.rlike("|".join(m.replace("-", "\\-") for m in marks))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("raw")


def wrap(kind: Column, system: Column, user: Column) -> Column:
    return (
        F.when(kind == "mistral", F.concat(F.lit("<s>[INST] "), system, F.lit("\n\n"), user, F.lit(" [/INST]")))
        .when(kind == "phi3", F.concat(F.lit("<|system|>\n"), system, F.lit("<|end|>\n<|user|>\n"), user, F.lit("<|end|>\n<|assistant|>\n")))
        .when(kind == "chatml", F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n")))
        .otherwise(F.concat(system, F.lit("\n\n"), user))
    )


def user_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Passages:\n"), context, F.lit("\n\nQuestion: "), question)


def with_disclaimer(answer: Column) -> Column:
    return F.when(F.contains(answer, F.lit(DISCLAIMER)), answer).otherwise(F.concat(answer, F.lit(f"\n\n{DISCLAIMER}")))


def generate(prompts: DataFrame, load: Callable[[], Callable[[list[str]], list[str | None]]]) -> DataFrame:
    """(query_id, answer) of (query_id, prompt, fallback); the model is loaded once for each worker.

    If loading or a call fails, or an answer is null or blank, the fallback stands in its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            model = load()
        except Exception:  # noqa: BLE001 - any failure of a plugged-in model means the fallback
            model = None
        for batch in batches:
            fallback = batch.column("fallback").to_pylist()
            try:
                said = model(batch.column("prompt").to_pylist()) if model else [None] * batch.num_rows
            except Exception:  # noqa: BLE001
                said = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array([s if s and s.strip() else f for s, f in zip(said, fallback)], pa.string())], names=["query_id", "answer"])

    kind = prompts.schema["query_id"].dataType.simpleString()
    out = prompts.select("query_id", "prompt", "fallback").mapInArrow(run, f"query_id {kind}, answer string")
    return out.withColumn("answer", with_disclaimer(F.col("answer")))
