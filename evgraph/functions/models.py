"""Plug-ins: language models and encoders by name, with a deterministic stub."""

from __future__ import annotations

import functools
import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class LanguageModel(Protocol):
    def count_image_tokens(self, size: tuple[int, int]) -> int: ...

    def generate(self, frames: Sequence[bytes], prompt: str) -> str: ...

    def generate_text(self, prompt: str) -> str: ...


class Encoder(Protocol):
    def image(self, frame: bytes) -> tuple[np.ndarray, np.ndarray]: ...

    def text(self, text: str) -> np.ndarray: ...


class RuleModel:
    """Replies by the length of the prompt, a rule that SQL can follow."""

    def count_image_tokens(self, size: tuple[int, int]) -> int:
        return (size[0] // 28) * (size[1] // 28)

    def generate(self, frames: Sequence[bytes], prompt: str) -> str:
        return self.generate_text(prompt) if "<letter>" in prompt else f"seen in {len(frames)} frames: {len(prompt) % 11}"

    def generate_text(self, prompt: str) -> str:
        if "Begin with Yes or No" in prompt:
            return f"Yes\nTied by {len(prompt) % 7}." if len(prompt) % 4 else "No"
        return f"The answer is {'ABCDE'[len(prompt) % 5]}."


class StubModel:
    """Replies that depend on the prompt alone, in the forms that the steps ask for."""

    def count_image_tokens(self, size: tuple[int, int]) -> int:
        """Patches of 14 pixels, merged two by two."""
        return (size[0] // 28) * (size[1] // 28)

    def generate(self, frames: Sequence[bytes], prompt: str) -> str:
        return self.generate_text(prompt) if "<letter>" in prompt else f"record {zlib.crc32(prompt.encode()):08x} of {len(frames)} frames"

    def generate_text(self, prompt: str) -> str:
        draw = zlib.crc32(prompt.encode())
        if "Begin with Yes or No" in prompt:
            return f"Yes\nThey share subject {draw % 97}." if draw % 4 else "No"
        return f"The answer is {'ABCD'[draw % 4]}."


class StubEncoder:
    """Unit vectors drawn from the bytes of an image or a text."""

    def __init__(self, size: int = 64, patches: int = 8) -> None:
        self.size, self.patches = size, patches

    def _draw(self, data: bytes, rows: int) -> np.ndarray:
        x = np.random.default_rng(zlib.crc32(data)).standard_normal((rows, self.size))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def image(self, frame: bytes) -> tuple[np.ndarray, np.ndarray]:
        return self._draw(frame, 1)[0], self._draw(frame + b"p", self.patches)

    def text(self, text: str) -> np.ndarray:
        return self._draw(text.encode(), 1)[0]


MODELS: dict[str, Callable[[], LanguageModel]] = {"stub": StubModel, "rule": RuleModel}
ENCODERS: dict[str, Callable[[], Encoder]] = {"stub": StubEncoder}


def with_retries(call: Callable[[], str], attempts: int = 5, wait: float = 5.0) -> str:
    """call(), again after a failure with a wait that grows by the attempt."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * (k + 1))
    raise AssertionError


@functools.cache
def image_tokens(model: str, size: int) -> int:
    """The tokens that a model needs for a square picture of so many pixels a side; asked once for each."""
    return MODELS[model]().count_image_tokens((size, size))


def _answered(call: Callable[[], str], attempts: int, wait: float) -> tuple[str | None, str | None]:
    try:
        return with_retries(call, attempts, wait), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


_REPLY = "text string, error string"


def reply(model: str, prompt: Column, images: Column | None = None, attempts: int = 5, wait: float = 5.0) -> Column:
    """(text, error): a model's reply to each prompt, or what its last attempt failed with; with images (array<binary>), one
    that looks at them. The model is loaded once for each run of batches. Replies can differ when asked for again, so
    they should be written before they are used twice."""
    make = MODELS[model]

    @F.pandas_udf(_REPLY)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lmm = make()
        for prompts in batches:
            yield pd.DataFrame([(None, None) if p is None else _answered(lambda p=p: lmm.generate_text(p), attempts, wait) for p in prompts], columns=["text", "error"], dtype=object)

    @F.pandas_udf(_REPLY)
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        lmm = make()
        for prompts, frames in batches:
            rows = [(None, None) if p is None else _answered(lambda p=p, own=own: lmm.generate([bytes(x) for x in own], p), attempts, wait) for p, own in zip(prompts, frames)]
            yield pd.DataFrame(rows, columns=["text", "error"], dtype=object)

    return ask.asNondeterministic()(prompt) if images is None else look.asNondeterministic()(prompt, images)


def encode_images(encoder: str, image: Column) -> Column:
    """(vec, patches): the global vector of a picture and those of its patches."""
    make = ENCODERS[encoder]

    @F.pandas_udf("vec array<double>, patches array<array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = make()
        for images in batches:
            rows = [found.image(bytes(x)) for x in images]
            yield pd.DataFrame({"vec": [list(v) for v, _ in rows], "patches": [[list(p) for p in own] for _, own in rows]})

    return run(image)


def encode_text(encoder: str, text: Column) -> Column:
    make = ENCODERS[encoder]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = make()
        for texts in batches:
            yield texts.map(lambda t: found.text(t or ""))

    return run(text)
