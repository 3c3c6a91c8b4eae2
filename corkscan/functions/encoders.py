"""Encoders that turn text into vectors, and the expression that runs them.

An encoder has two halves: ``prepare`` is a column expression that runs in the
JVM, ``encode`` turns one Arrow batch of prepared values into a matrix inside a
Python worker.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corkscan.functions.hashing import signed_slots
from corkscan.functions.matrices import list_array
from corkscan.functions.text import tokens


class Encoder(Protocol):
    def prepare(self, text: Column) -> Column: ...

    def encode(self, prepared: pa.Array) -> np.ndarray: ...


@dataclasses.dataclass(frozen=True)
class HashingEncoder:
    """Signed feature hashing of the words, scaled to length 1.

    Needs no model file. Words are cut and hashed in the JVM; a worker only adds
    up slots. A text without words has the zero vector.
    """

    dim: int = 256

    def prepare(self, text: Column) -> Column:
        return signed_slots(tokens(text), self.dim)

    def encode(self, prepared: pa.Array) -> np.ndarray:
        slots = prepared.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(prepared)), prepared.value_lengths().to_numpy(zero_copy_only=False))
        cells = rows * self.dim + np.abs(slots) - 1
        sums = np.bincount(cells, np.sign(slots), len(prepared) * self.dim).reshape(-1, self.dim)
        lengths = np.sqrt(np.square(sums).sum(axis=1, keepdims=True))
        return np.divide(sums, lengths, out=np.zeros_like(sums), where=lengths > 0)


_loaded: dict[str, Callable[[list[str]], np.ndarray]] = {}


@dataclasses.dataclass(frozen=True)
class ModelEncoder:
    """Any model that maps a list of texts to a matrix.

    ``load`` is called once per Python worker; ``name`` tells models apart.
    """

    name: str
    load: Callable[[], Callable[[list[str]], np.ndarray]]

    def prepare(self, text: Column) -> Column:
        return text

    def encode(self, prepared: pa.Array) -> np.ndarray:
        if self.name not in _loaded:
            _loaded[self.name] = self.load()
        return np.asarray(_loaded[self.name](prepared.to_pylist()))


def vector_of(text: Column, encoder: Encoder, dim: int) -> Column:
    """The first ``dim`` numbers of each text's vector, as 32-bit floats.

    Only the prepared text goes to the workers, in Arrow batches of
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows. A shorter vector, or
    a batch that comes back with another number of rows, is an error.
    """

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if len(batch) == 0:
                yield list_array(np.empty((0, dim), np.float32), pa.float32())
                continue
            vectors = np.asarray(encoder.encode(batch))
            if vectors.ndim != 2 or len(vectors) != len(batch) or vectors.shape[1] < dim:
                raise ValueError(f"expected vectors of shape ({len(batch)}, {dim}), got {vectors.shape}")
            yield list_array(np.ascontiguousarray(vectors[:, :dim], np.float32), pa.float32())

    # Annotations are looked up by the type that the function works on.
    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, ArrayType(FloatType(), False))(encoder.prepare(text))
