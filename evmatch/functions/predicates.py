"""A matcher as a boolean Column over one leaf: its text ``v`` and, for numbers, its double ``d``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evmatch.functions import casefold, cidr, wildcard
from evmatch.functions.iregexp import escaped
from evmatch.plans.pattern import Matcher


def ignore_case_regex(text: str) -> str:
    parts = []
    for c in text:
        other = casefold.partner(c)
        parts.append(f"(?:{escaped(c)}|{escaped(other)})" if other else escaped(c))
    return "(?s)\\A" + "".join(parts) + "\\z"


def _bounds(d: Column, m: Matcher) -> Column:
    if m.low is None and m.high is None:
        return F.lit(False)
    fine = F.lit(True)
    if m.low is not None:
        fine = d >= m.low if m.low_in else d > m.low
        if m.high is None:
            fine = fine & ~F.isnan(d)  # which Spark sorts above all numbers
    if m.high is not None:
        upper = d <= m.high if m.high_in else d < m.high
        fine = upper if m.low is None else fine & upper
    return fine


def predicate(m: Matcher, v: Column, d: Column | None) -> Column:
    """Null, if it is, counts as no; ``d`` is None where no leaf of the field can be a number."""
    if m.op == "exists":
        return v.isNotNull()
    if m.op == "exact":
        return v == m.text
    if m.op == "number":
        return v == m.text if d is None else F.when(d.isNotNull(), d == m.number).otherwise(v == m.text)
    if m.op == "prefix":
        return v.startswith(m.text)
    if m.op == "suffix":
        return v.endswith(m.text)
    if m.op == "wildcard":
        return wildcard.column(v, m.pieces)
    if m.op == "anything-but":
        return ~v.isin(*m.texts)
    if m.op == "anything-but-numeric":
        return F.lit(True) if d is None else F.coalesce(~d.isin(*m.numbers), F.lit(True))
    if m.op == "equals-ignore-case":
        return F.lower(v) == m.text.lower() if casefold.plain_ascii(m.text) else v.rlike(ignore_case_regex(m.text))
    if m.op == "numeric":
        return F.lit(False) if d is None else _bounds(d, m)
    if m.op == "cidr":
        return cidr.within(v, m.block)
    if m.op == "regexp":
        fine = None
        for c in m.conditions:
            one = c.column(v)
            fine = one if fine is None else fine & one
        return fine
    raise ValueError(m.op)


def any_of(matchers: tuple[Matcher, ...], v: Column, d: Column | None) -> Column:
    """OR of a field's matchers but ``missing``; strings and numbers in one IN list each."""
    texts = [m.text for m in matchers if m.op == "exact"]
    parts = [v.isin(*texts) if len(texts) > 1 else v == texts[0]] if texts else []
    for m in matchers:
        if m.op not in ("exact", "missing"):
            parts.append(predicate(m, v, d))
    if not parts:
        return F.lit(False)
    fine = parts[0]
    for p in parts[1:]:
        fine = fine | p
    return fine
