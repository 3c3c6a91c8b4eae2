"""Hashes that other engines can repeat, built on md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_number(text: Column) -> Column:
    """The first 32 bits of the md5 sum, as a BIGINT from 0."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def signed_slots(words: Column, dim: int) -> Column:
    """For each word a slot 1..dim, from the first eight hex digits of its md5
    sum, negative if the ninth is odd. Each word is hashed once."""
    numbers = F.transform(words, lambda word: F.conv(F.substring(F.md5(word), 1, 9), 16, 10).cast("bigint"))
    slot = lambda number: F.shiftright(number, 4) % dim + 1
    signed = lambda number: F.when(number % 2 == 1, -slot(number)).otherwise(slot(number)).cast("int")
    return F.transform(numbers, signed)


def draw(seed: int, position: Column, choices: int) -> Column:
    """A repeatable, uniform choice 0..choices-1 for each position."""
    return md5_number(F.concat_ws(":", F.lit(seed), position)) % choices
