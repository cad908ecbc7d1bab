"""Names for values inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column], kind: str) -> Column:
    """``use`` of a value that is made once, however often it is named; ``kind`` is the result's type.

    A fold over the one value does not ask for the type of its body at every row, as taking an item would.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: use(x))
