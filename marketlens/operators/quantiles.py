"""Quantile groups of several orders at once, from digit histograms.

``NTILE(k) OVER (ORDER BY value, id)`` needs only k - 1 borders. They are found by radix selection: a scan counts
the leading digit of every value, the counts say which digit holds each border, the next scan counts the next digit
of the rows that agree so far. Ties at a border are cut by their ids in the same way, two characters a scan. All
borders of all orders share the scans; only histograms come to the driver (at most ``2^DIGIT_BITS`` counts a border
and scan), and rows get their groups by comparing with literals: nothing is sorted and no row moves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from marketlens.session import ensure_checkpoint_dir

DIGIT_BITS, ID_CHARS = 12, 2


@dataclass(frozen=True)
class Tiles:
    """``NTILE(k)`` by ``value`` then ``id``, ascending, NULLs first."""

    value: str
    id: str
    k: int


@dataclass
class _Border:
    """The last row of a group: its value, and a prefix of its id beyond which its ties belong to the next group."""

    order: str
    rank: int  # among the rows not yet told apart
    value: int | None = None
    prefix: str | None = None  # None: all ties belong to the group
    ended: bool = False  # the prefix is a whole id


def _whole(df: DataFrame, c: str) -> Column:
    """The value as a whole number, order kept; raises where it doesn't fit a LONG."""
    kind = df.schema[c].dataType
    scale = kind.scale if isinstance(kind, DecimalType) else 0
    if not isinstance(kind, DecimalType) and kind.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{c}: quantile groups need whole numbers or decimals, not {kind.simpleString()}")
    return (F.col(c) * F.lit(10**scale).cast("decimal(38,0)") if scale else F.col(c)).cast("long")


def _ends(n: int, k: int) -> list[int]:
    """Rank of the last row of each group but the last; the first n mod k groups hold one more."""
    size, more = divmod(n, k)
    return [j * size + min(j, more) for j in range(1, k)]


def _pick(counts: list[tuple], rank: int) -> tuple:
    """The first of ascending (digit, count) that holds the rank, with the rows before it and its own."""
    before = 0
    for digit, n in counts:
        if before + n >= rank:
            return digit, before, n
        before += n
    raise AssertionError("rank beyond the rows")


def _histograms(df: DataFrame, parts: list[tuple[int, Column, Column]]) -> dict[int, list[tuple]]:
    """Counts of (part, digit) for parts given as (number, condition, digit), in one scan."""
    cells = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(i).alias("part"), digit.cast("string").alias("digit"))) for i, cond, digit in parts]))
    rows = df.select(F.explode(cells).alias("x")).groupBy("x.part", "x.digit").agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[int, list[tuple]] = {i: [] for i, _, _ in parts}
    for r in rows:
        out[r["part"]].append((r["digit"], r["n"]))
    return out


def borders(df: DataFrame, orders: dict[str, Tiles]) -> dict[str, list[_Border]]:
    """The borders of every order, by its name. ``df`` is read once a digit."""
    key = {name: _whole(df, t.value) for name, t in orders.items()}
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(key[o]).alias(f"{o}:{name}") for o in orders for f, name in ((F.min, "lo"), (F.max, "hi"), (lambda c: F.count_if(c.isNull()), "nulls"))],
    ).first()
    found: dict[str, list[_Border]] = {}
    for o, t in orders.items():
        found[o] = [_Border(o, r) for r in _ends(stats["n"], t.k)]
        for b in found[o]:
            if b.rank > stats[f"{o}:nulls"]:
                b.rank -= stats[f"{o}:nulls"]
                b.value = 0  # digits above those known, counted from the least value
    _value_digits(df, orders, key, stats, found)
    ties = [b for bs in found.values() for b in bs if b.rank > 0]
    _id_digits(df, orders, key, ties)
    return found


def _value_digits(df: DataFrame, orders: dict[str, Tiles], key: dict[str, Column], stats, found: dict[str, list[_Border]]) -> None:
    left = {}
    for o in orders:
        low, high = stats[f"{o}:lo"], stats[f"{o}:hi"]
        left[o] = 0 if low is None else (high - low).bit_length()
        if left[o] > 63:
            raise ValueError(f"{orders[o].value}: values span more than 63 bits")
    while any(left.values()):
        parts, of = [], []
        for o, bits in left.items():
            step = min(DIGIT_BITS, bits)
            left[o] = bits - step
            if not step:
                continue
            reached = F.shiftright(key[o] - F.lit(stats[f"{o}:lo"]), left[o])
            for prefix in sorted({b.value for b in found[o] if b.value is not None}):
                digit = reached - F.lit(prefix << step)
                parts.append((len(parts), digit.between(0, (1 << step) - 1), digit))
                of.append((step, [b for b in found[o] if b.value == prefix]))
        counts = _histograms(df, parts) if parts else {}
        for i, (step, held) in enumerate(of):
            ordered = sorted((int(d), n) for d, n in counts[i])
            for b in held:
                digit, before, _ = _pick(ordered, b.rank)
                b.value, b.rank = (b.value << step) + digit, b.rank - before
    for o, bs in found.items():
        for b in bs:
            if b.value is not None:
                b.value += stats[f"{o}:lo"]


def _id_digits(df: DataFrame, orders: dict[str, Tiles], key: dict[str, Column], ties: list[_Border]) -> None:
    """Cut the ties at each border: its rank among equal values says how many of them, by id, stay."""
    tied = [key[b.order].eqNullSafe(F.lit(b.value).cast("long")) for b in ties]
    names = [_name(orders[b.order]) for b in ties]
    sizes = _histograms(df, [(i, t, F.lit(0)) for i, t in enumerate(tied)]) if ties else {}
    still = [i for i, b in enumerate(ties) if sizes[i][0][1] > b.rank]
    for i in still:
        ties[i].prefix = ""
    while still:
        parts = []
        for i in still:
            at = len(ties[i].prefix)
            parts.append((i, tied[i] & (F.substring(names[i], 1, at) == ties[i].prefix), F.substring(names[i], at + 1, ID_CHARS)))
        counts, cut = _histograms(df, parts), still
        still = []
        for i in cut:
            b = ties[i]
            digit, before, n = _pick(sorted(counts[i], key=lambda x: x[0].encode()), b.rank)
            b.prefix, b.rank, b.ended = b.prefix + digit, b.rank - before, len(digit) < ID_CHARS
            if n > b.rank and not b.ended:  # rows of one id can't be told apart: they stay together
                still.append(i)


def _name(t: Tiles) -> Column:
    return F.coalesce(F.col(t.id).cast("string"), F.lit(""))


def _beyond(value: Column, name: Column, b: _Border) -> Column:
    higher = value.isNotNull() if b.value is None else F.coalesce(value > F.lit(b.value), F.lit(False))
    if b.prefix is None:
        return higher
    known = name if b.ended else F.substring(name, 1, len(b.prefix))
    return higher | (value.eqNullSafe(F.lit(b.value).cast("long")) & (known > F.lit(b.prefix)))


def with_tiles(df: DataFrame, orders: dict[str, Tiles]) -> DataFrame:
    """``df`` (checkpointed: it is scanned once a digit) with the group number of every order."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    found = borders(df, orders)
    out = {}
    for o, t in orders.items():
        beyond = [_beyond(_whole(df, t.value), _name(t), b).cast("int") for b in found[o]]
        out[o] = reduce(lambda a, b: a + b, beyond, F.lit(1))
    return df.withColumns(out)
