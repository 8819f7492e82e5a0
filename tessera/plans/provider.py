"""Generation behind an interface: a provider is built once in each Python worker and gets requests in batches.

Engines for real models live outside; ``StubProvider`` is deterministic, needs nothing, and drives tests and demonstrations.
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonx
from ..operators.relational import spread


class Provider(Protocol):
    def generate(self, prompts: list[str], samples: list[int]) -> list[str | Exception]:
        """One reply for each prompt; an exception in its place if it failed."""


@lru_cache(8)
def _asked(prompt: str) -> tuple[str, str, int]:
    """The schema that a prompt names, its minimal instance, and the prompt's number; the samples of a prompt come one after another."""
    schema = jsonx.prompt_schema(prompt) or "{}"
    return schema, jsonx.minimal(schema) or "{}", int(hashlib.md5(prompt.encode()).hexdigest(), 16)


class StubProvider:
    """Replies that hang on prompt and sample number: minimal instances of the prompt's schema, some of them spoilt."""

    def __init__(self, spoil_every: int = 3, sections: bool = False):
        self.spoil_every, self.sections = spoil_every, sections

    def generate(self, prompts: list[str], samples: list[int]) -> list[str | Exception]:
        out: list[str | Exception] = []
        for p, s in zip(prompts, samples, strict=True):
            schema, made, number = _asked(p)
            if self.spoil_every and (number + s) % self.spoil_every == 0:
                made = made[:-1]
            out.append(f"=== JSON ===\n{made}\n=== JSON_SCHEMA ===\n{schema}" if self.sections else f"<think>{s}</think>\n```json\n{made}\n```")
        return out


def named(name: str) -> Callable[[], Provider]:
    """The provider that ``module:callable`` makes; ``stub`` and ``stub-sections`` are the deterministic ones."""
    if name.startswith("stub"):
        return lambda: StubProvider(sections=name == "stub-sections")
    module, _, made = name.partition(":")

    def make() -> Provider:
        return getattr(importlib.import_module(module), made)()

    return make


#: Rows at most, and bytes of their input times the samples, whose replies are handed on at once.
RUN_ROWS, RUN_BYTES = 512, 8 << 20
SAMPLES = T.ArrayType(T.StructType([T.StructField("sample_idx", T.IntegerType()), T.StructField("raw_output", T.StringType()), T.StructField("error", T.StringType()), T.StructField("ok", T.BooleanType())]))


def _replies(provider: Provider, prompts: list[str | None], n: int, batch: int) -> list[list[str | Exception] | None]:
    """The n replies to each prompt; None to a null prompt."""
    asked = [p for p in prompts if p is not None for _ in range(n)]
    numbers = list(range(n)) * (len(asked) // n)
    out: list[str | Exception] = []
    for a in range(0, len(asked), batch):
        part = asked[a : a + batch]
        try:
            replies = provider.generate(part, numbers[a : a + batch])
        except Exception as e:  # a batch that fails as a whole
            replies = [e] * len(part)
        if len(replies) != len(part):
            raise ValueError(f"{len(replies)} replies to {len(part)} prompts")
        out += replies
    starts = iter(range(0, len(out), n))
    return [None if p is None else out[(at := next(starts)) : at + n] for p in prompts]


def _array(replies: list[list[str | Exception] | None], check: Callable[[int, list[str | None]], list[bool]] | None, keep: Callable[[list[bool]], list[int]] | None) -> pa.Array:
    """Replies as an array of SAMPLES."""
    starts: list[int | None] = []
    numbers, raw, errors, oks = [], [], [], []
    for row, some in enumerate(replies):
        starts.append(None if some is None else len(raw))
        if some is None:
            continue
        texts = [None if isinstance(r, Exception) else r for r in some]
        ok = check(row, texts) if check else [None] * len(some)
        for i in keep(ok) if keep else range(len(some)):
            numbers.append(i)
            raw.append(texts[i])
            errors.append(str(some[i]) if isinstance(some[i], Exception) else None)
            oks.append(ok[i])
    made = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(raw, pa.string()), pa.array(errors, pa.string()), pa.array(oks, pa.bool_())], SAMPLES.elementType.names)
    return pa.ListArray.from_arrays(pa.array([*starts, len(raw)], pa.int32()), made)


def sampled(rows: DataFrame, make: Callable[[], Provider], prompts: dict[str, Column], n: int = 1, batch: int = 4, schema: str | None = None, mode: str = "", keep: Callable[[list[bool]], list[int]] | None = None) -> DataFrame:
    """The rows, and for each name in ``prompts`` an array of SAMPLES with the n samples of that prompt, in order.

    Rows carry what is needed later, so that nothing is joined or grouped afterwards. With a column ``schema`` each sample is
    checked in that mode; ``keep`` then says by the samples' ``ok`` which of them stay. A null prompt isn't asked: its array
    is null. Filters belong before this node, as nothing is pushed through it; so does ``spread``.
    """
    names = list(prompts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            kept = b.num_columns - len(names)
            step = max(1, min(RUN_ROWS, RUN_BYTES * b.num_rows // max(1, b.nbytes * n)))
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                schemas = part.column(part.schema.get_field_index(schema)).to_pylist() if schema else []
                check = (lambda row, texts: jsonx.outputs_ok(texts, schemas[row], mode)) if schema else None  # noqa: B023
                arrays = [_array(_replies(provider, part.column(kept + k).to_pylist(), n, batch), check, keep) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *arrays], names=b.schema.names)

    kinds = T.StructType([*rows.schema.fields, *[T.StructField(k, SAMPLES) for k in names]])
    return rows.select("*", *[c.alias(k) for k, c in prompts.items()]).mapInArrow(work, kinds)


def generate(requests: DataFrame, make: Callable[[], Provider], n: int = 1, prompt: str = "prompt", key: str = "stem", batch: int = 4) -> DataFrame:
    """(key, sample_idx, raw_output, error): n samples for each request; failures are rows with an error, not exceptions."""
    none = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("sample_idx"), F.lit(None).cast("string").alias("raw_output"), F.lit("no prompt").alias("error"), F.lit(None).cast("boolean").alias("ok")))
    rows = spread(requests.select(key, prompt), key, prompt)
    return sampled(rows, make, {"samples": F.col(prompt)}, n, batch).select(key, F.inline(F.coalesce("samples", none))).drop("ok")


def judged(rows: DataFrame, make: Callable[[], Provider], prompt: str = "judge_prompt", key: str = "stem") -> DataFrame:
    """(key, llm_score) from a judge's replies."""
    from ..functions.text import judge_score

    return generate(rows, make, 1, prompt, key).select(key, judge_score(F.col("raw_output")).alias("llm_score"))
