"""Answers to texts from something outside: a pluggable function run in batches, with retries."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import words

#: The least characters of a text, the words that count (longer than that) and the fewest of them.
TEXT_CHARS, WORD_CHARS, FEWEST = 20, 3, 2
#: A provider takes the prompts of one batch and gives an answer for each; it may raise.
Provider = Callable[[list[str]], list[str]]


def long_words(x: Column | str) -> Column:
    """The longer words in lower case, with their repeats."""
    return F.filter(words(F.lower(x)), lambda w: F.length(w) > WORD_CHARS)


def needed(n: Column) -> Column:
    """How many of ``n`` longer words must stand in a text: half up to five, else 45 %, three at least."""
    return F.when(n <= 5, n * 0.5).otherwise(F.greatest(n * F.lit(0.45), F.lit(3.0)))


def prompt(template: str, **parts: Column) -> Column:
    """The template with each ``{name}`` replaced by a column; NULL becomes ''."""
    x = F.lit(template)
    for name, part in parts.items():
        x = F.replace(x, F.lit("{" + name + "}"), F.coalesce(part.cast("string"), F.lit("")))
    return x


def answers(df: DataFrame, prompt_column: str, make: Callable[[], Provider], attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """``df`` with ``answer`` and ``error``. ``make`` builds the provider once per task.

    A batch that fails is tried again after ``wait`` seconds, twice as long each time; after the last try
    its rows have no answer but the error. NULL prompts are not asked.
    """
    names = df.columns

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            texts = b.column(prompt_column).to_pylist()
            asked = [i for i, t in enumerate(texts) if t is not None]
            out, error = [None] * len(texts), [None] * len(texts)
            for attempt in range(attempts):
                try:
                    for i, a in zip(asked, provider([texts[i] for i in asked]) if asked else [], strict=True):
                        out[i], error[i] = a, None
                    break
                except Exception as e:  # whatever the provider raises
                    for i in asked:
                        error[i] = f"{type(e).__name__}: {e}"
                    if attempt + 1 < attempts:
                        time.sleep(wait * 2**attempt)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array(error, pa.string())], [*names, "answer", "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "answer string", "error string"])
    return df.mapInArrow(ask, schema)


def fixed(claims: list[dict], share: float = 0.7) -> Callable[[], Provider]:
    """A provider that needs no model: of a few given claims it returns those most of whose longer words the text has."""

    def make() -> Provider:
        known = [(c, {w for w in c["source_quote"].lower().split() if len(w) > 3}) for c in claims]

        def answer(texts: list[str]) -> list[str]:
            words = [set(t.lower().split()) for t in texts]
            return [json.dumps({"claims": [c for c, w in known if len(w) > 1 and len(w & have) >= share * len(w)]}, ensure_ascii=False) for have in words]

        return answer

    return make
