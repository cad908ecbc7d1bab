"""Regular expressions as trees, and how a value is matched in time that grows with its length alone.

The JVM's matcher calls itself for every turn of a loop over a group, and tries again what it tried before; a long
value ends in a stack overflow, or never.  So a tree is said to it only where that cannot happen:

* alternatives of one character become one class, loops of loops one loop, so that few loops over groups are left;
* where the position automaton (one state for each character of the expression) always knows by the next character
  where to go on, every loop is possessive: it is never left early and never entered again;
* an expression with one endless loop over single characters, and no other, cannot try more often than its length.

Anything else becomes a deterministic automaton, built here with a limit on its size.  Its states are eliminated one by
one into loops over first returns to a state, which are possessive as the next character always decides; where that
grows too long, a fold over the value's characters follows the transition table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

Ranges = tuple[tuple[int, int], ...]
LAST = 0x10FFFF
#: positions of an expression, states of its automaton, entries of its table, characters up to which trying again is cheap
POSITIONS, STATES, ENTRIES, SHORT = 1000, 2000, 50_000, 256
#: characters of a source made of an automaton, and loops within loops in it (each may read its part once more)
SOURCE, DEPTH = 4000, 4


@dataclass(frozen=True)
class Chars:
    """One character: how the JVM says its set, and the set's members as (ranges, categories, negated)."""

    text: str
    members: tuple[tuple[Ranges, tuple[tuple[str, bool], ...], bool], ...]


@dataclass(frozen=True)
class Seq:
    items: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Alt:
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Rep:
    item: Node
    low: int
    high: int | None


Node = Chars | Seq | Alt | Rep
NEVER = "(?!)"


def simple(node: Node) -> Node:
    """The same language with fewer loops over groups."""
    if isinstance(node, Seq):
        flat: list[Node] = []
        for x in map(simple, node.items):
            flat += x.items if isinstance(x, Seq) else [x]
        return flat[0] if len(flat) == 1 else Seq(tuple(flat))
    if isinstance(node, Alt):
        flat = []
        for x in map(simple, node.items):
            flat += x.items if isinstance(x, Alt) else [x]
        sets = [x for x in flat if isinstance(x, Chars) and x.text != NEVER]
        if len(sets) > 1:
            one = Chars("[" + "".join(x.text for x in sets) + "]", tuple(m for x in sets for m in x.members))
            flat = [one, *(x for x in flat if x not in sets)]
        return flat[0] if len(flat) == 1 else Alt(tuple(flat))
    if isinstance(node, Rep):
        item = simple(node.item)
        if (node.low, node.high) == (1, 1):
            return item
        if isinstance(item, Rep) and item.high is None and item.low <= 1 and node.high != 0:
            return Rep(item.item, item.low * node.low, None)
        return Rep(item, node.low, node.high)
    return node


def text(node: Node, possessive: bool = False) -> str:
    """The JVM's source of a tree."""
    if isinstance(node, Chars):
        return node.text
    if isinstance(node, Seq):
        return "".join(f"(?:{text(x, possessive)})" if isinstance(x, Alt) else text(x, possessive) for x in node.items)
    if isinstance(node, Alt):
        return "|".join(text(x, possessive) for x in node.items)
    inner = text(node.item, possessive) if isinstance(node.item, Chars) else f"(?:{text(node.item, possessive)})"
    low, high = node.low, node.high
    many = {(0, 1): "?", (0, None): "*", (1, None): "+"}.get((low, high)) or (f"{{{low}}}" if low == high else f"{{{low},{'' if high is None else high}}}")
    return inner + many + ("+" if possessive and high != 1 else "")


def nullable(node: Node) -> bool:
    if isinstance(node, Seq):
        return all(map(nullable, node.items))
    if isinstance(node, Alt):
        return any(map(nullable, node.items))
    return isinstance(node, Rep) and (node.low == 0 or nullable(node.item))


def _parts(node: Node) -> Iterator[Node]:
    yield node
    for x in (node.item,) if isinstance(node, Rep) else () if isinstance(node, Chars) else node.items:
        yield from _parts(x)


def group_loops(node: Node) -> list[Rep]:
    return [x for x in _parts(node) if isinstance(x, Rep) and not isinstance(x.item, Chars) and (x.high is None or x.high > 1)]


def endless(node: Node) -> int:
    return sum(isinstance(x, Rep) and x.high is None for x in _parts(node))


def first_choice_is_right(node: Node) -> bool:
    """Whether possessive loops may take the first alternative that fits: none of theirs, and no turn, is empty."""
    return not any(nullable(r.item) or any(isinstance(x, Alt) and any(map(nullable, x.items)) for x in _parts(r.item)) for r in group_loops(node))


# ---------------------------------------------------------------- characters


@lru_cache(maxsize=1)
def _categories() -> list[tuple[int, str]]:
    """(first character, category) of all stretches of one category."""
    found: list[tuple[int, str]] = []
    for c in range(LAST + 1):
        kind = unicodedata.category(chr(c))
        if not found or found[-1][1] != kind:
            found.append((c, kind))
    return found


class _Alphabet:
    """Characters in stretches that no set tells apart; sets of stretches are the bits of a number."""

    def __init__(self, sets: list[Chars]):
        cuts = {0, 0xD800, 0xE000}
        for s in sets:
            for ranges, _, _ in s.members:
                cuts |= {x for lo, hi in ranges for x in (lo, hi + 1) if x <= LAST}
        named = any(parts for s in sets for _, parts, _ in s.members)
        kinds = _categories() if named else [(0, "")]
        kind, k = "", 0
        self.stretches: list[tuple[int, str]] = []
        for c in sorted(cuts | {c for c, _ in kinds}):
            while k < len(kinds) and kinds[k][0] <= c:
                kind, k = kinds[k][1], k + 1
            if not 0xD800 <= c < 0xE000:
                self.stretches.append((c, kind))
        self.mask = {s: self._mask(s, False) for s in sets}
        #: with characters that one Unicode version has and another may not
        self.may = {s: self._mask(s, True) for s in sets} if named else self.mask

    def _mask(self, s: Chars, maybe: bool) -> int:
        found = 0
        for n, (c, kind) in enumerate(self.stretches):
            for ranges, parts, negated in s.members:
                inside = any(lo <= c <= hi for lo, hi in ranges) or any(kind.startswith(name) != not_ for name, not_ in parts)
                if inside != negated or maybe and parts and kind == "Cn":
                    found |= 1 << n
                    break
        return found


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


# ---------------------------------------------------------------- automata


class TooLarge(Exception):
    pass


class Positions:
    """The position automaton; sets of positions are the bits of a number, position 0 is the start."""

    def __init__(self, node: Node):
        self.symbols: list[Chars | None] = [None]
        self.follow: list[int] = [0]
        empty, self.follow[0], last = self._build(node)
        self.last = last | int(empty)
        self.sets = list(dict.fromkeys(s for s in self.symbols if s is not None))
        self.alphabet = _Alphabet(self.sets)

    def _build(self, node: Node) -> tuple[bool, int, int]:
        """(whether it can be empty, first positions, last positions)."""
        if isinstance(node, Chars):
            if len(self.symbols) > POSITIONS:
                raise TooLarge
            self.symbols.append(node)
            self.follow.append(0)
            return False, 1 << len(self.symbols) - 1, 1 << len(self.symbols) - 1
        if isinstance(node, Alt):
            made = [self._build(x) for x in node.items]
            return any(e for e, _, _ in made), self._or(f for _, f, _ in made), self._or(t for _, _, t in made)
        if isinstance(node, Seq):
            empty, first, last = True, 0, 0
            for e, f, t in map(self._build, node.items):
                self._link(last, f)
                first |= f if empty else 0
                last = t | (last if e else 0)
                empty &= e
            return empty, first, last
        copies = [self._build(node.item) for _ in range(max(node.low, 1) if node.high is None else node.high)]
        if not copies:
            return True, 0, 0
        for (_, _, last), (_, first, _) in pairwise(copies):
            self._link(last, first)
        if node.high is None:
            self._link(copies[-1][2], copies[-1][1])
        empty = node.low == 0 or copies[0][0]
        return empty, copies[0][1], self._or(t for k, (_, _, t) in enumerate(copies) if empty or k + 1 >= node.low)

    @staticmethod
    def _or(masks: Iterator[int]) -> int:
        whole = 0
        for m in masks:
            whole |= m
        return whole

    def _link(self, last: int, first: int) -> None:
        for p in _bits(last):
            self.follow[p] |= first

    def deterministic(self) -> bool:
        for after in set(self.follow):
            seen = 0
            for p in _bits(after):
                mask = self.alphabet.may[self.symbols[p]]
                if seen & mask:
                    return False
                seen |= mask
        return True

    def table(self) -> Table:
        kinds: dict[tuple[bool, ...], int] = {}
        for n in range(len(self.alphabet.stretches)):
            kinds.setdefault(tuple(bool(self.alphabet.mask[s] >> n & 1) for s in self.sets), n)
        classes = [k for k in kinds if any(k)]
        holding = [self._or(1 << p for p, s in enumerate(self.symbols) if s is not None and k[self.sets.index(s)]) for k in classes]
        states, moves = {1: 0}, []
        for state in (queue := [1]):
            after = self._or(self.follow[p] for p in _bits(state))
            for held in holding:
                to = after & held
                if to and to not in states:
                    states[to] = len(states)
                    queue.append(to)
                moves.append(states[to] if to else -1)
            if len(states) > STATES or len(states) * len(classes) > ENTRIES:
                raise TooLarge
        said = tuple("\\A" + "".join(f"(?={s.text})" if has else f"(?!{s.text})" for s, has in zip(self.sets, k, strict=True)) for k in classes)
        whole = {k: sum(1 << n for n in range(len(self.alphabet.stretches)) if tuple(bool(self.alphabet.mask[s] >> n & 1) for s in self.sets) == k) for k in classes}
        named = self.alphabet.may is not self.alphabet.mask
        own = tuple(None if named else next((s.text for s in self.sets if self.alphabet.mask[s] == whole[k]), None) for k in classes)
        return Table(said, tuple(moves), tuple(int(bool(m & self.last)) for m in states), own)


@dataclass(frozen=True)
class Table:
    """A deterministic automaton: classes of characters, the next state by state and class (-1: none), accepting states."""

    classes: tuple[str, ...]
    moves: tuple[int, ...]
    accepting: tuple[int, ...]
    #: how the JVM says a class that is one of the expression's own sets, the same in all versions of Unicode
    own: tuple[str | None, ...] = ()

    def column(self, v: Column) -> Column:
        said = self.source()
        return self.fold(v) if said is None else v.rlike(f"(?s)\\A(?:{said})\\z")

    def fold(self, v: Column) -> Column:
        def numbers(x: tuple[int, ...]) -> Column:  # becomes one constant
            return F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>")

        def step(state: Column, c: Column) -> Column:
            to = F.when(state < 0, state)
            for k, said in enumerate(self.classes):
                to = to.when(c.rlike(said), F.get(moves, state * len(self.classes) + k))
            return to.otherwise(F.lit(-1))

        moves = numbers(self.moves)
        end = F.aggregate(F.split(v, ""), F.lit(0), step)
        return F.when(v == "", F.lit(bool(self.accepting[0]))).otherwise(F.coalesce(F.get(numbers(self.accepting), end) == 1, F.lit(False)))

    def minimal(self) -> Table:
        """The automaton of fewest states for the same language, without those from which nothing is accepted."""
        width, many = len(self.classes), len(self.accepting)
        to = [self.moves[s * width : (s + 1) * width] for s in range(many)]
        live = {s for s in range(many) if self.accepting[s]}
        while more := {s for s in range(many) if s not in live and live.intersection(to[s])}:
            live |= more
        if 0 not in live:
            return Table((), (), (0,), ())
        group = [self.accepting[s] if s in live else -1 for s in range(many)]
        while True:
            said = {s: (group[s], *(group[t] if t >= 0 else -1 for t in to[s])) for s in range(many) if s in live}
            names = {x: n for n, x in enumerate(dict.fromkeys(said.values()))}
            after = [names[said[s]] if s in live else -1 for s in range(many)]
            if len(names) == len({g for g in group if g >= 0}):
                break
            group = after
        first = {after[s]: s for s in reversed(range(many)) if s in live}  # state 0 stays the first
        return Table(self.classes, tuple(after[t] if t >= 0 else -1 for g in range(len(first)) for t in to[first[g]]), tuple(self.accepting[first[g]] for g in range(len(first))), self.own)

    def source(self) -> str | None:
        """The JVM's source of the same language, with possessive loops alone; None if it grows too long.

        A loop at a state is over the first returns to it; of them, and of what follows, no one begins another.
        """
        width = len(self.classes)
        chars = [own or f"{said.removeprefix(chr(92) + 'A')}." for said, own in zip(self.classes, self.own, strict=True)]
        alone = {c for c, own in zip(chars, self.own, strict=True) if own}

        def moves(s: int) -> dict[int, str]:
            by: dict[int, list[str]] = {}
            for k, t in enumerate(self.moves[s * width : (s + 1) * width]):
                if t >= 0:
                    by.setdefault(t, []).append(chars[k])
            return {t: x[0] if len(x) == 1 else f"[{''.join(x)}]" if alone.issuperset(x) else f"(?:{'|'.join(x)})" for t, x in by.items()}

        def within(text: str) -> str:
            if len(text) > SOURCE:
                raise TooLarge
            return text

        def loops(s: int, closed: frozenset[int], depth: int) -> str:
            if depth > DEPTH:
                raise TooLarge
            some = []
            for t, c in moves(s).items():
                rest = "" if t == s else None if t in closed else onward(t, s, closed | {s}, depth + 1)
                some += [] if rest is None else [c + rest]
            return within(f"{some[0]}*+" if len(some) == 1 and some[0] == moves(s).get(s) and (some[0] in alone or some[0][0] == "[") else f"(?:{'|'.join(some)})*+") if some else ""

        def onward(s: int, goal: int | None, closed: frozenset[int], depth: int) -> str | None:
            """From a state to the goal, or to an accepting end, by states that are not closed; None if nothing is."""
            some = []
            for t, c in moves(s).items():
                rest = "" if t == goal else None if t == s or t in closed else onward(t, goal, closed | {s}, depth)
                some += [] if rest is None else [c + rest]
            if goal is None and self.accepting[s]:
                some.append("")
            return within(f"{loops(s, closed, depth)}(?:{'|'.join(some)})") if some else None

        try:
            return onward(0, None, frozenset(), 0) or NEVER
        except TooLarge:
            return None

    def holds(self, value: str) -> bool:
        state, known = 0, _classes_of(self.classes)
        for c in value:
            if c not in known:
                known[c] = next((k for k, r in enumerate(_compiled(self.classes)) if r.search(c)), -1)
            state = self.moves[state * len(self.classes) + known[c]] if known[c] >= 0 else -1
            if state < 0:
                return False
        return bool(self.accepting[state])


@lru_cache(1024)
def _classes_of(classes: tuple[str, ...]) -> dict[str, int]:
    return {}


@lru_cache(1024)
def _compiled(classes: tuple[str, ...]) -> list:
    import regex

    from evmatch.functions.iregexp import for_python

    return [regex.compile(for_python(c)) for c in classes]


def linear(node: Node) -> tuple[str, Table | None, bool]:
    """(source for the JVM, table to follow instead, whether the source will do for short values) of a tree."""
    node = simple(node)
    loops = group_loops(node)
    if not loops and endless(node) <= 1:
        return text(node), None, True
    try:
        automaton = Positions(node)
        if automaton.deterministic() and first_choice_is_right(node):
            return text(node, possessive=True), None, True
        return text(node), automaton.table().minimal(), not loops
    except TooLarge:
        if loops:
            raise
        return text(node), None, True  # loops over single characters: no recursion, and tries by a power of the length
