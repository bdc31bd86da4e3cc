"""The metadata filter language of vector stores, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TESTS: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c != F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def where(spec: dict) -> Column:
    """The condition that a filter such as {"$and": [{"source": "a"}, {"page": {"$gte": 2}}]} states.

    Several fields, or several tests of one field, must all hold; an empty filter holds for every row. A field
    that is null passes no test. Comparisons are plain, so they reach the scan.
    """
    parts = []
    for name, value in spec.items():
        if name in ("$and", "$or"):
            if not isinstance(value, list) or not value:
                raise ValueError(f"{name} takes a list of filters")
            parts.append(reduce(Column.__and__ if name == "$and" else Column.__or__, map(where, value)))
        elif name.startswith("$"):
            raise ValueError(f"{name} is no connective; there are $and and $or")
        else:
            tests = value if isinstance(value, dict) else {"$eq": value}
            if unknown := set(tests) - set(TESTS):
                raise ValueError(f"{sorted(unknown)} are no tests; there are {sorted(TESTS)}")
            parts += [TESTS[k](F.col(name), v) for k, v in tests.items()]
    return reduce(Column.__and__, parts, F.lit(True))
