"""Column-expression helpers shared by every operator.

All rounding follows the reference's PostgreSQL NUMERIC semantics: divide
exactly in DECIMAL, then round once, half away from zero. Spark's DECIMAL
``round`` is HALF_UP on the magnitude, which is the same rule.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, IntegerType, ShortType

from marketlens.session import ensure_checkpoint_dir

# Working precision for exact ratios: 20 integer digits, 4 fractional.
_WORK = DecimalType(24, 4)

DELIVERED = "delivered"
CANCELED = "canceled"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column, scale: int = 2, mult: int = 1) -> Column:
    """``ROUND(mult * num / NULLIF(den, 0), scale)``, rounded once, half away from zero.

    A DECIMAL quotient is cut to 38 digits in all, so rounding it is a second rounding. Here both sides are
    whole numbers of 1/10000 and the quotient is an integer division: (2 |n| m + d) div 2 d.
    """
    n, d = col(num).cast(_WORK), F.nullif(col(den).cast(_WORK), F.lit(0).cast(_WORK))
    units = F.lit(10**4).cast("decimal(5,0)")
    top = (F.abs(n) * F.lit(2 * mult * 10 ** (scale + 4)).cast("decimal(11,0)")).cast("decimal(38,0)")
    below = (F.abs(d) * units).cast("decimal(28,0)")
    quotient = F.call_function("div", top + below, F.lit(2).cast("decimal(1,0)") * below)
    unit = F.lit(Decimal(1).scaleb(-scale)).cast(DecimalType(scale + 1, scale))
    signed = F.signum(n).cast("decimal(1,0)") * F.signum(d).cast("decimal(1,0)") * quotient.cast("decimal(19,0)") * unit
    # sized: products of DECIMALs widen, and sums of wide ones lose digits where they meet others (union, coalesce)
    return signed.cast(DecimalType(19, scale))


def pct(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """``ROUND(100.0 * num / NULLIF(den, 0), scale)``."""
    return ratio(num, den, scale, mult=100)


def avg_round(c: str | Column, scale: int = 2) -> Column:
    """Aggregate: ``ROUND(AVG(c), scale)`` without the binary-double detour (trap T1)."""
    c = col(c)
    return ratio(F.sum(c), F.count(c), scale)


def avg_round_if(cond: Column, c: str | Column, scale: int = 2) -> Column:
    """Aggregate: ``ROUND(AVG(c) FILTER (WHERE cond), scale)``."""
    return avg_round(F.when(cond, col(c)), scale)


def count_if(cond: Column) -> Column:
    """``COUNT(*) FILTER (WHERE cond)``; NULL conditions count as false."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def money_sum(c: str | Column, precision: int = 22, scale: int = 2) -> Column:
    """Exact ``SUM`` of a 2-dp money column, accumulated as LONG cents.

    Spark widens ``sum(decimal(12,2))`` past 18 digits and then adds
    BigDecimal objects row by row; summing unscaled cents keeps the hot loop
    on primitive longs (overflow raises under ANSI) and converts once per group.
    """
    return money_of(F.sum(cents(c, scale)), precision, scale)


def cents(c: str | Column, scale: int = 2) -> Column:
    """A money column as LONG cents; sums of sums stay LONG until ``money_of`` ends them."""
    return (col(c) * F.lit(10**scale)).cast("long")


def money_of(total: str | Column, precision: int = 22, scale: int = 2) -> Column:
    """LONG cents as money again: a product, as a DECIMAL quotient takes several times as long."""
    return (col(total).cast(DecimalType(precision, 0)) * F.lit(Decimal(1).scaleb(-scale))).cast(DecimalType(precision, scale))


def avg_money(c: str | Column, scale: int = 2) -> Column:
    """``ROUND(AVG(money), scale)`` with the cents-based sum."""
    return ratio(money_sum(c), F.count(col(c)), scale)


def money(c: str | Column, precision: int = 14) -> Column:
    return col(c).cast(DecimalType(precision, 2))


def round_money(c: str | Column) -> Column:
    return F.round(col(c), 2)


def is_completed(status: str = "order_status", payment: str = "payment_value_total") -> Column:
    """Shared "completed order" predicate: delivered and paid."""
    return (F.col(status) == F.lit(DELIVERED)) & F.col(payment).isNotNull()


def month_index(d: str | Column) -> Column:
    """12 * year + month, so month differences are plain subtraction."""
    d = col(d)
    return F.year(d) * 12 + F.month(d)


def months_between_int(later: str | Column, earlier: str | Column) -> Column:
    return month_index(later) - month_index(earlier)


def day_diff(later: str | Column, earlier: str | Column) -> Column:
    """PostgreSQL ``date - date``: whole calendar days as INTEGER."""
    return F.datediff(F.to_date(col(later)), F.to_date(col(earlier)))


def distinct_counts(df: DataFrame, keys: list[str], counts: dict[str, str], in_turn: bool = False) -> DataFrame:
    """``COUNT(DISTINCT column)`` per key for several columns (output name -> column), X4.

    Each column is grouped with the key first and counted then, over a scan of just these columns. One aggregate
    with several distincts would multiply every row by their number. ``df`` is a landed frame. With ``in_turn`` each
    count is checkpointed when this is called, so the pairs of one column are on the disks at a time.
    """
    out = None
    for name, column in counts.items():
        pairs = df.groupBy(*keys, F.col(column).alias("_v")).agg(F.lit(1).alias("_one"))
        part = pairs.groupBy(*keys).agg(F.count("_v").alias(name))
        if in_turn:
            ensure_checkpoint_dir(df.sparkSession)
            part = part.checkpoint()
        out = part if out is None else out.join(part, keys)
    return out


def finish(df: DataFrame) -> DataFrame:
    """Result contract: exact DECIMALs become DOUBLE and integers BIGINT, at the very end."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DecimalType):
            out.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, (ByteType, ShortType, IntegerType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
