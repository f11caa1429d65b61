"""Scalar column builders of the data model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def persistence_score(count: Column, periods: Column) -> Column:
    """log1p(count) * sqrt(periods)."""
    return F.log1p(count.cast("double")) * F.sqrt(periods.cast("double"))


def gap_pct(cost: Column, best: Column) -> Column:
    """Percent over a reference; null for a null or zero one."""
    return F.when(best != 0, (cost - best) / best * 100.0)


def ratio_or_one(part: Column, whole: Column) -> Column:
    """part / whole, and 1 where the whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(1.0))


def used_vehicles(routes: Column) -> Column:
    """Routes that visit anything."""
    return F.size(F.filter(routes, lambda r: F.size(r) > 0))


def split_at_depot(sequence: Column) -> Column:
    """Routes of a node sequence in which 0 is the depot; empty routes are dropped."""
    blank = F.array().cast("array<array<bigint>>")
    start = F.struct(blank.alias("done"), F.array().cast("array<bigint>").alias("now"))

    def step(state: Column, node: Column) -> Column:
        closed = F.when(F.size(state["now"]) > 0, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"])
        return F.when(node == 0, F.struct(closed.alias("done"), F.array().cast("array<bigint>").alias("now"))).otherwise(
            F.struct(state["done"].alias("done"), F.concat(state["now"], F.array(node.cast("bigint"))).alias("now"))
        )

    return F.aggregate(sequence, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def join_at_depot(routes: Column) -> Column:
    """One node sequence with the depot (0) before, between and after the routes."""
    zero = F.array(F.lit(0).cast("bigint"))
    return F.concat(zero, F.flatten(F.transform(routes, lambda r: F.concat(r, zero))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(value: Column, window) -> Column:
    """Softmax over the rows of a window."""
    shifted = F.exp(value - F.max(value).over(window))
    return shifted / F.sum(shifted).over(window)


def tanh(x: Column) -> Column:
    return F.tanh(x)


def stable_seed(seed: int, key: Column) -> Column:
    """The first eight bytes of sha256("seed|key"), little-endian, as a whole number (decimal(20,0): it has 64 bits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), key), 256)
    turned = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def uniform(key: Column, salt: int = 0) -> Column:
    """A number in (0, 1) that a whole number from 0 and a salt decide, by arithmetic that any engine can follow."""
    x = F.pmod((key.cast("bigint") * 64 + F.lit(salt % 64)) * F.lit(1103515245) + F.lit(12345 + salt), F.lit(2147483648))
    y = F.pmod(F.floor(x / 1024).cast("bigint") * F.lit(1664525) + x * F.lit(69069) + F.lit(1013904223), F.lit(2147483648))
    return (y + 0.5) / 2147483648.0


def normal(key: Column, salt: int = 0) -> Column:
    """A standard normal number from two uniform ones (salt and the next)."""
    return F.sqrt(-2 * F.ln(uniform(key, salt))) * F.cos(F.lit(2 * math.pi) * uniform(key, salt + 1))


def rounded(value: Column, digits: int) -> Column:
    """``round(value, digits)`` of a double, in compiled arithmetic but where a value is large or near a half."""
    scaled = value * F.lit(10.0**digits)
    clear = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5).cast("double") / F.lit(10.0**digits)).otherwise(F.round(value, digits))
