"""One case partner per character, from the common foldings of Unicode's case-folding table."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: common foldings that Unicode 16 added, which Python's own tables may lack: (first, last, folded first)
ADDED = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70))
LAST = 0x1E943  # no character beyond has case


@lru_cache(maxsize=1)
def _partners() -> dict[str, str]:
    folds = {chr(k): f for k in range(LAST + 1) if len(f := chr(k).casefold()) == 1 and f != chr(k)}
    folds |= {chr(first + k): chr(to + k) for first, last, to in ADDED for k in range(last - first + 1)}
    back: dict[str, str] = {}
    for c in sorted(folds):
        back.setdefault(folds[c], c)
    return back | folds


def partner(c: str) -> str | None:
    """The single character that folds together with c, or None.

    A character that folds to another has that one; one that others fold to has the first of them.
    Foldings to several characters do not count.
    """
    return _partners().get(c)


def plain_ascii(text: str) -> bool:
    """Whether lower() alone decides: the Kelvin sign's lower case is k."""
    return text.isascii() and "k" not in text.lower()


@lru_cache(maxsize=1)
def _firsts() -> dict[str, str]:
    """Each character with partners as the first of all that partners lead to."""
    near: dict[str, set[str]] = {}
    for a, b in _partners().items():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found: dict[str, str] = {}
    for c in sorted(near):
        group = [c] if c not in found else []
        for x in group:
            found[x] = c
            group += [y for y in near[x] if y not in found and y not in group]
    return found


def folded(text: str) -> str:
    """Equal for all texts that one pattern can match without regard to case."""
    firsts = _firsts()
    return "".join(firsts.get(c, c) for c in text)


def folded_column(v: Column) -> Column:
    changed = {c: f for c, f in sorted(_firsts().items()) if c != f}
    return F.translate(v, "".join(changed), "".join(changed.values()))


@lru_cache(maxsize=1)
def third_of() -> str:
    """A class of the characters that are not the partner of their partner."""
    return "[" + "".join(sorted(c for c in _firsts() if partner(partner(c) or c) != c)) + "]"
