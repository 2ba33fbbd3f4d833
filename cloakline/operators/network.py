"""Endpoint sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Seconds before each further try to warm a model up.
WARM_UP = (2, 4, 8, 16, 32)


def warm_up_schedule(tries: DataFrame, attempt: str = "attempt") -> DataFrame:
    """Adds wait_seconds before the next try, and gives_up after the last. attempt counts from 0."""
    wait = F.get(F.array(*map(F.lit, WARM_UP)), F.col(attempt).cast("int"))
    return tries.withColumn("wait_seconds", wait).withColumn("gives_up", F.col(attempt) >= len(WARM_UP))


def stale(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Endpoints (host, ip, port) that a host had and no longer has; a host that resolves to nothing keeps its own."""
    answered = known.join(fresh.select("host").distinct(), "host", "left_semi")
    return answered.join(fresh, ["host", "ip", "port"], "left_anti")


def refreshed(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """The set after a refresh: new ones in, stale ones out."""
    return known.unionByName(fresh).distinct().join(stale(known, fresh), ["host", "ip", "port"], "left_anti")


def ipv4_number(ip: Column) -> Column:
    """Octets packed into a number, first octet highest; null if it isn't an address."""
    parts = F.transform(F.split(ip, "\\."), lambda p: p.try_cast("long"))
    packed = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p)
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda p: p.between(0, 255)), packed)


def ipv6_words(ip: Column) -> Column:
    """Four 32-bit numbers of a full or shortened address."""
    halves = F.split(F.lower(ip), "::", -1)
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(F.expr("cast(array() as array<string>)"))
    middle = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    full = F.transform(F.concat(left, middle, right), lambda g: F.conv(g, 16, 10).cast("long"))
    return F.when(F.size(full) == 8, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(full, 2 * i) * 65536 + F.get(full, 2 * i + 1)))
