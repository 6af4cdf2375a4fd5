"""Helper functions of model scripts, on Python values, with the Spark expression of the same rule where data may want it.

Truth follows the scripts' rule: null, zero, false and the empty string are false.
"""

from __future__ import annotations

import calendar
import json
import math
import time
import uuid as _uuid
from collections.abc import Callable, Iterable
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.types import to_datetime

Number = int | float | Decimal


def is_number(v: object) -> bool:
    return isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)


def truthy(v: object) -> bool:
    return not (v is None or v is False or v == "" or is_number(v) and v == 0)


# -- operators


def plus(a: object, b: object) -> object:
    """Sum of numbers, with null as nothing; text otherwise."""
    if a is None or b is None:
        return b if a is None else a
    if is_number(a) and is_number(b):
        return a + b if isinstance(a, int) and isinstance(b, int) else float(a) + float(b)
    return f"{text(a)}{text(b)}"


def text(v: object) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def minus(a: object, b: object | None = None) -> object:
    """Difference, or the negative of one value; what is no number counts as 0."""
    x, y = (v if is_number(v) else 0 for v in (a, b))
    return -x if b is None else x - y


def times(a: object, b: object) -> float | None:
    return None if a is None or b is None else float(a) * float(b)


def divide(a: object, b: object) -> float:
    if a is None:
        return 0.0
    if b is None:
        return math.nan
    try:
        return float(a) / float(b)
    except ZeroDivisionError:
        return math.nan if float(a) == 0 else math.copysign(math.inf, float(a))


def modulo(a: object, b: object) -> int:
    """Remainder of whole numbers, with the sign of the first."""
    return int(math.fmod(int(a or 0), int(b)))


def bit_and(a: object, b: object) -> int:
    return int(a or 0) & int(b or 0)


def equal(a: object, b: object) -> bool:
    if a is None or b is None:
        return a is b
    return float(a) == float(b) if is_number(a) and is_number(b) else a == b


def compare(a: object, b: object) -> int:
    """-1, 0 or 1: numbers by value, else as text; null is the least."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    x, y = (float(a), float(b)) if is_number(a) and is_number(b) else (text(a), text(b))
    return (x > y) - (x < y)


def both(a: object, b: object) -> bool:
    return truthy(a) and truthy(b)


def first_true(*values: object) -> object:
    """The first true value, else the last one."""
    return next((v for v in values if truthy(v)), values[-1] if values else None)


def negate(v: object) -> bool:
    return not truthy(v)


def iif(condition: object, a: object, b: object = None) -> object:
    return a if truthy(condition) else b


def case(*pairs: object) -> object:
    """case(c1, v1, c2, v2, ..., default): the value of the first true condition."""
    for i in range(0, len(pairs) - 1, 2):
        if truthy(pairs[i]):
            return pairs[i + 1]
    return pairs[-1] if len(pairs) % 2 else None


def ceil(v: Number) -> int:
    return math.ceil(v)


def to_int(v: object) -> int:
    """A whole number; null and blank text are 0."""
    return 0 if v is None or v == "" else int(float(v))


def to_ints(values: Iterable) -> list[int]:
    return [to_int(v) for v in values]


def each(values: Iterable) -> Iterable[tuple[object, int]]:
    """(item, index) pairs, as loops get them."""
    return ((v, i) for i, v in enumerate(values or ()))


# -- lists


def includes(values: list, v: object) -> bool:
    return v in values


def push(values: list, *more: object) -> int:
    values.extend(more)
    return len(values)


def keep(values: list, test: Callable[[object], object]) -> list:
    """Those items for which the test is exactly true."""
    return [v for v in values if test(v) is True]


def convert(values: list, f: Callable[[object], object]) -> list:
    return [f(v) for v in values]


def join(values: list, sign: str = ",") -> str:
    return sign.join(text(v) for v in values)


def without_empty(values: dict) -> dict:
    """Drops entries that are null, blank or empty."""
    return {k: v for k, v in values.items() if not (v is None or v == "" or isinstance(v, (list, dict, tuple)) and not v)}


# -- dates


def now() -> datetime:
    return datetime.now()


def date_text(v: object, pattern: str = "%Y-%m-%d") -> str | None:
    when = to_datetime(v)
    return None if when is None else when.strftime(pattern)


def datetime_text(v: object) -> str | None:
    return date_text(v, "%Y-%m-%d %H:%M:%S")


def to_date(v: object, pattern: str | None = None) -> datetime | None:
    if v is None or pattern is None:
        return to_datetime(v)
    return datetime.strptime(str(v), pattern)


def start_of(v: object, unit: str = "day") -> datetime | None:
    """First moment of the minute, hour, day, month, quarter or year."""
    t = to_datetime(v)
    if t is None:
        return None
    t = t.replace(second=0, microsecond=0)
    if unit == "minute":
        return t
    t = t.replace(minute=0)
    if unit == "hour":
        return t
    t = t.replace(hour=0)
    return {"day": t, "month": t.replace(day=1), "quarter": t.replace(month=(t.month - 1) // 3 * 3 + 1, day=1), "year": t.replace(month=1, day=1)}[unit]


def end_of(v: object, unit: str = "day") -> datetime | None:
    """Last whole second of the unit."""
    t = start_of(v, unit)
    if t is None:
        return None
    if unit in ("minute", "hour", "day"):
        return t + timedelta(**{unit + "s": 1}) - timedelta(seconds=1)
    return add_months(t, {"month": 1, "quarter": 3, "year": 12}[unit]) - timedelta(seconds=1)


def add(v: object, **amount: int) -> datetime | None:
    """v with days, hours, minutes, seconds or months more."""
    t = to_datetime(v)
    if t is None:
        return None
    months = amount.pop("months", 0)
    return add_months(t, months) + timedelta(**amount)


def add_months(t: datetime, n: int) -> datetime:
    """The same day n months on, or that month's last."""
    month = t.month - 1 + n
    year, month = t.year + month // 12, month % 12 + 1
    return t.replace(year=year, month=month, day=min(t.day, days_in_month(year, month)))


def days_in_month(year: int, month: int) -> int:
    return calendar.monthrange(year, month)[1]


def days_between(a: object, b: object) -> int:
    return (to_datetime(b).date() - to_datetime(a).date()).days


def same(a: object, b: object, unit: str = "day") -> bool:
    return start_of(a, unit) == start_of(b, unit)


def check_days_range(a: object, b: object, most: int, message: str | None = None) -> int:
    """Days from a to b; raises ValueError if they are more than most."""
    n = days_between(a, b)
    if n > most:
        raise ValueError(message or f"{n} days are more than {most}")
    return n


# -- numbers


def has_flag(v: int | None, flag: int) -> bool:
    return bit_and(v, flag) == flag


def with_flag(v: int | None, flag: int) -> int:
    return (v or 0) | flag


def without_flag(v: int | None, flag: int) -> int:
    return (v or 0) & ~flag


def fixed(v: Number | None, places: int) -> Decimal | None:
    """Rounded half up."""
    from decimal import ROUND_HALF_UP

    return None if v is None else Decimal(str(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def cents_to_units(v: int | None) -> Decimal | None:
    return None if v is None else Decimal(v).scaleb(-2).quantize(Decimal("0.01"))


def total(*values: Number | None) -> Number:
    return sum(v for v in values if v is not None)


def digits(v: int, start: int, length: int | None = None) -> int:
    """A stretch of a number's decimal digits."""
    shown = str(abs(v))[start : None if length is None else start + length]
    return int(shown or 0)


# -- utilities


def uuid() -> str:
    return str(_uuid.uuid4())


def sleep(milliseconds: int) -> None:
    time.sleep(milliseconds / 1000)


def stringify(v: object) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"), default=lambda x: datetime_text(x) if isinstance(x, (date, datetime)) else str(x))


def parse_json(v: str) -> object:
    return json.loads(v)


def is_array(v: object) -> bool:
    return isinstance(v, (list, tuple))


def type_name(v: object) -> str | None:
    return None if v is None else type(v).__name__


#: The rules that make sense on data, as expressions.
COLUMNS: dict[str, Callable[..., Column]] = {
    "truthy": lambda c: c.isNotNull() & F.when(F.typeof(c) == "string", ~c.cast("string").isin("", "0", "false")).when(F.typeof(c) == "boolean", c.cast("string") == "true").otherwise(F.coalesce(c.cast("string").try_cast("double") != 0, F.lit(True))),
    "equal": lambda a, b: a.eqNullSafe(b),
    "divide": lambda a, b: F.when(a.isNull(), 0.0).when(b.isNull() | (a.cast("double") == 0) & (b.cast("double") == 0), float("nan")).otherwise(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.signum(a.cast("double")) * F.lit(float("inf")))),
    "bit_and": lambda a, b: F.coalesce(a, F.lit(0)).bitwiseAND(F.coalesce(b, F.lit(0))),
    "iif": lambda c, a, b: F.when(COLUMNS["truthy"](c), a).otherwise(b),
    "ceil": F.ceil,
    "date_text": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "datetime_text": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
    "start_of": lambda c, unit="day": F.date_trunc(unit, c),
    "end_of_day": lambda c: F.date_trunc("day", c) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"),
    "add_months": F.add_months,
    "days_between": lambda a, b: F.datediff(b, a),
    "last_day": F.last_day,
    "quarter": F.quarter,
    "has_flag": lambda c, flag: F.coalesce(c, F.lit(0)).bitwiseAND(F.lit(flag)) == flag,
    "total": lambda *cs: sum((F.coalesce(c, F.lit(0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0))),
    "keep": F.filter,
    "convert": F.transform,
    "join": lambda c, sign=",": F.array_join(c, sign),
}
