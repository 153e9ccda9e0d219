"""Distinct counts by mergeable sketches of maximum ranks and lower indicator bits, read by maximum likelihood."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Registers are 2**PRECISION bytes; one keeps its greatest rank and INDICATORS bits for the ranks just below it.
PRECISION, INDICATORS = 12, 2
#: Registers, and groups, that a task gathers before it gives out its partial sketches.
GATHERED, GROUPS = 2_000_000, 100_000
#: An entry of a sketch that is written sparsely: a register's number and state.
ENTRY = np.dtype([("reg", "<u2"), ("state", "u1")])


def standard_error(precision: int = PRECISION) -> float:
    """Relative standard error of an estimate for 8-bit registers with two indicator bits."""
    return math.sqrt(4.63 / 8 / 2**precision)


def _length(x: np.ndarray) -> np.ndarray:
    """The number of binary digits of unsigned longs."""
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int64)


def states(ranks: np.ndarray) -> np.ndarray:
    """The byte of a register that has met ``ranks`` (bits of an unsigned long, rank k at bit k - 1)."""
    top = _length(ranks)
    away = top - 1 - INDICATORS
    low = np.where(away >= 0, ranks >> np.maximum(away, 0).astype(np.uint64), ranks << np.maximum(-away, 0).astype(np.uint64))
    return (top << INDICATORS | (low & np.uint64((1 << INDICATORS) - 1)).astype(np.int64)).astype(np.uint8)


def ranks(state: np.ndarray) -> np.ndarray:
    """The greatest rank of a register's byte and those that its indicator bits name, as bits. Inverse of states()."""
    s = state.astype(np.int64)
    top, low = s >> INDICATORS, (s & (1 << INDICATORS) - 1) | 1 << INDICATORS
    away = top - 1 - INDICATORS
    return np.where(away >= 0, low << np.maximum(away, 0), low >> np.maximum(-away, 0)).astype(np.uint64)


def encode(reg: np.ndarray, state: np.ndarray, precision: int = PRECISION) -> bytes:
    """A sketch: one byte a register, or the filled registers only where that is shorter. ``reg`` is in order."""
    if len(reg) * ENTRY.itemsize >= 1 << precision:
        dense = np.zeros(1 << precision, np.uint8)
        dense[reg] = state
        return dense.tobytes()
    sparse = np.empty(len(reg), ENTRY)
    sparse["reg"], sparse["state"] = reg, state
    return sparse.tobytes()


def decode(sketch: bytes, precision: int = PRECISION) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and bytes of a sketch's filled registers."""
    if len(sketch) == 1 << precision:
        dense = np.frombuffer(sketch, np.uint8)
        reg = np.flatnonzero(dense)
        return reg, dense[reg]
    sparse = np.frombuffer(sketch, ENTRY)
    return sparse["reg"].astype(np.int64), sparse["state"]


class _Gathered:
    """Registers of many groups: ranks met by (group, register), reduced when they are many."""

    def __init__(self, precision: int):
        self.m = 1 << precision
        self.codes: dict[tuple, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.reduced = 0

    def code(self, group: tuple) -> int:
        return self.codes.setdefault(group, len(self.codes))

    def add(self, at: np.ndarray, met: np.ndarray) -> None:
        self.parts.append((at, met))
        self.size += len(at)
        if self.size > 2 * self.reduced + 200_000:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at, met = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(at, kind="stable")
        at, met = at[order], met[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
        self.parts = [(at[first], np.bitwise_or.reduceat(met, first))] if len(at) else []
        self.size = self.reduced = len(first)
        return self.parts[0] if self.parts else (at, met)


def _groups(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's group, and the groups, by the first n columns; null is a value."""
    at = np.zeros(batch.num_rows, np.int64)
    for c in range(n):
        d = pc.dictionary_encode(batch.column(c), null_encoding="encode")
        at = np.unique(at * max(1, len(d.dictionary)) + d.indices.to_numpy(), return_inverse=True)[1].ravel()
    first = np.unique(at, return_index=True)[1]
    return at, list(zip(*[batch.column(c).take(pa.array(first)).to_pylist() for c in range(n)])) if n else [()] * len(first)


def observe(df: DataFrame, groups: list[str], value: str, sets: list[list[str]] | None = None, precision: int = PRECISION) -> DataFrame:
    """level, groups, sketch: partial sketches of the distinct values of each group, at most a few for each task.

    ``sets`` are grouping sets over ``groups``: all are counted in one pass over the rows, ``level`` is the number of
    the set and groups that aren't in it are null. Each task gathers registers over all its rows and gives one sketch
    for each group, so hot groups and values cost nothing more; only if it meets very many groups it gives several.
    Nulls in ``value`` aren't counted; null groups form a group.
    """
    sets = sets or [groups]
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.xxhash64(value).alias("__hash"))
    kept = [tuple(g in s for g in groups) for s in sets]
    m = 1 << precision

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, schema = _Gathered(precision), None

        def out() -> Iterator[pa.RecordBatch]:
            at, met = got.reduce()
            names = list(got.codes)
            for level, keep in enumerate(kept):
                coarse = _Gathered(precision)
                to = np.array([coarse.code(tuple(v if k else None for v, k in zip(g, keep))) for g in names], np.int64)
                coarse.add(to[at // m] * m + at % m, met)
                yield from _sketches(coarse, level, schema, precision)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            schema = pa.schema(list(batch.schema)[:-1])
            h = batch.column(len(groups)).to_numpy().view(np.uint64)
            rest = h << np.uint64(precision)
            # rank, from 0: leading zeros of the remaining bits; a zero remainder has the greatest rank
            rank = np.minimum(64 - _length(rest), 64 - precision)
            at, names = _groups(batch, len(groups))
            code = np.array([got.code(g) for g in names], np.int64)[at]
            got.add(code * m + (h >> np.uint64(64 - precision)).astype(np.int64), np.uint64(1) << rank.astype(np.uint64))
            if got.size > GATHERED or len(got.codes) > GROUPS:
                got.reduce()
                if got.size > GATHERED // 2 or len(got.codes) > GROUPS:
                    yield from out()
                    got = _Gathered(precision)
        yield from out()

    kind = dict(df.dtypes)
    return rows.mapInArrow(gather, ", ".join(["level int", *[f"`{g}` {kind[g]}" for g in groups], "sketch binary"]))


def _sketches(got: _Gathered, level: int | None, schema: pa.Schema, precision: int) -> Iterator[pa.RecordBatch]:
    at, met = got.reduce()
    if not len(at):
        return
    state, m = states(met), got.m
    names = list(got.codes)
    ends = np.flatnonzero(np.r_[True, at[1:] // m != at[:-1] // m, True])
    for lo in range(0, len(ends) - 1, 2000):
        some = range(lo, min(lo + 2000, len(ends) - 1))
        keys = [names[at[ends[i]] // m] for i in some]
        sketches = [encode(at[ends[i] : ends[i + 1]] % m, state[ends[i] : ends[i + 1]], precision) for i in some]
        columns = [pa.array([k[c] for k in keys], schema.field(c).type) for c in range(len(schema))]
        head = [] if level is None else [pa.array([level] * len(keys), pa.int32())]
        yield pa.RecordBatch.from_arrays([*head, *columns, pa.array(sketches, pa.binary())], [*([] if level is None else ["level"]), *schema.names, "sketch"])


def merge(parts: DataFrame, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """groups, sketch: one sketch for each group, of all that its parts have met; nothing is lost.

    Parts meet by group and are merged as they stream in, so a group's parts are never held together.
    """
    kind = dict(parts.dtypes)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, schema, last, m = _Gathered(precision), None, None, 1 << precision
        for batch in batches:
            if batch.num_rows == 0:
                continue
            schema = pa.schema(list(batch.schema)[:-1])
            names = list(zip(*[c.to_pylist() for c in batch.columns[:-1]])) if len(groups) else [()] * batch.num_rows
            for name, sketch in zip(names, batch.column(len(groups)).to_pylist()):
                if name != last and got.size > GATHERED:
                    yield from _sketches(got, None, schema, precision)
                    got = _Gathered(precision)
                last = name
                reg, state = decode(sketch, precision)
                got.add(got.code(name) * m + reg, ranks(state))
        if schema is not None:
            yield from _sketches(got, None, schema, precision)

    sent = parts.select(*groups, "sketch")
    sent = sent.repartition(*groups).sortWithinPartitions(*groups) if groups else sent.repartition(1)
    return sent.mapInArrow(join, ", ".join([*[f"`{g}` {kind[g]}" for g in groups], "sketch binary"]))


def _solve(m: int, limit: int, counts: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """The number of distinct values of greatest likelihood, for each row.

    In a sketch of n values a register has met rank k with probability 1 - exp(-n rho_k / m). counts[k] registers are
    known to have met rank k, absent[k] known not to; the score function falls in n, so Newton in log n converges.
    """
    k = np.arange(1, limit + 1)
    rho = 2.0 ** -np.minimum(k, limit - 1)
    a, met = absent @ rho, counts.sum(1)
    x = np.log(np.clip(met / np.maximum(a, 1e-12), 1e-9, 2.0**limit))
    for _ in range(200):
        lam = np.exp(x)[:, None]
        z = np.minimum(lam * rho, 700.0)
        e = np.expm1(z)
        f = (counts * z / e).sum(1) - lam[:, 0] * a
        df = (counts * (z / e - z * z * np.exp(z) / (e * e))).sum(1) - lam[:, 0] * a
        step = np.clip(f / np.where(df == 0, -1, df), -1.0, 1.0)
        x -= step
        if np.abs(step).max() < 1e-12:
            break
    return np.where(met == 0, 0.0, np.where(a == 0, np.inf, m * np.exp(x)))


def likeliest(sketches: list[bytes], precision: int = PRECISION) -> np.ndarray:
    """The estimate of each sketch."""
    m, limit = 1 << precision, 64 - precision + 1
    counts, absent = np.zeros((len(sketches), limit)), np.zeros((len(sketches), limit))
    for i, sketch in enumerate(sketches):
        reg, state = decode(sketch, precision)
        n = np.bincount(state, minlength=1)
        s = np.flatnonzero(n)
        n, top = n[s], s >> INDICATORS
        tops = np.bincount(top, n, limit + 1)
        counts[i] = tops[1:]
        tops[0] = m - len(reg)  # registers that met nothing
        absent[i] = np.cumsum(tops)[:limit]  # nothing above the greatest rank was met
        for j in range(1, INDICATORS + 1):
            bit = (s >> (INDICATORS - j) & 1).astype(bool)
            for into, pick in ((counts, bit), (absent, ~bit)):
                pick = pick & (top > j)
                into[i] += np.bincount(top[pick] - j - 1, n[pick], limit)
    return _solve(m, limit, counts, absent)


def estimates(sketches: DataFrame, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """groups, estimate (long), low, high (two standard errors). Groups without a non-null value have no row."""
    kind = dict(sketches.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = likeliest(batch.column(len(groups)).to_pylist(), precision)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], [*groups, "n"])

    read_out = sketches.select(*groups, "sketch").mapInArrow(read, ", ".join([*[f"`{g}` {kind[g]}" for g in groups], "n double"]))
    e, n = standard_error(precision), F.round(F.col("n")).cast("long")
    return read_out.select(*groups, n.alias("estimate"), F.floor(F.col("n") * (1 - 2 * e)).alias("low"), F.ceil(F.col("n") * (1 + 2 * e)).alias("high"))


def count_distinct(df: DataFrame, groups: list[str], value: str, sets: list[list[str]] | None = None, precision: int = PRECISION) -> DataFrame:
    """level, groups, estimate, low, high of the distinct values of each group of each grouping set; see observe()."""
    keys = ["level", *groups]
    return estimates(merge(observe(df, groups, value, sets, precision), keys, precision), keys, precision)
