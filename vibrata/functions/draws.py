"""Seeded random draws as hashes, the same under any partitioning and in any engine that has MD5."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def head(seed: int, parts: Sequence[Column]) -> Column:
    """The text of seed and parts that a draw's text begins with."""
    return F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def uniform(seed: int, parts: Sequence[Column], draw: str) -> Column:
    """A number in (0, 1) from the MD5 of seed, parts and draw: 52 bits, the same in any engine that has MD5."""
    text = F.concat_ws("|", head(seed, parts), F.lit(draw))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def normal(seed: int, parts: Sequence[Column], draw: str) -> Column:
    """A standard normal number, by Box and Muller."""
    return F.sqrt(-2 * F.ln(uniform(seed, parts, draw + "1"))) * F.cos(2 * F.pi() * uniform(seed, parts, draw + "2"))


def uniforms(start: str, numbers: np.ndarray, draw: str) -> np.ndarray:
    """``uniform`` in numpy, whose parts are those of the text ``start`` (see ``head``) and a number of ``numbers``."""
    before, after = f"{start}|".encode(), f"|{draw}".encode()
    digests = b"".join([md5(b"%b%d%b" % (before, n, after)).digest() for n in numbers.tolist()])
    return ((np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def normals(start: str, numbers: np.ndarray, draw: str) -> np.ndarray:
    """``normal`` in numpy, with parts as in ``uniforms``."""
    return np.sqrt(-2 * np.log(uniforms(start, numbers, draw + "1"))) * np.cos(2 * np.pi * uniforms(start, numbers, draw + "2"))


def uniform_of(start: str, draw: str) -> float:
    """``uniform`` of the text ``start`` alone."""
    return ((int.from_bytes(md5(f"{start}|{draw}".encode()).digest()[:8]) >> 12) + 0.5) / 2.0**52
