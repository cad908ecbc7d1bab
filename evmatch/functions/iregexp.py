"""The I-Regexp dialect: ``~`` escapes, whole-value anchoring, no captures.

``translate`` turns a source into conditions, each a regular expression for the JVM (and Python's
``regex`` module) that must, or must not, match the whole value.  A source without lookaround is one
condition.  Literals come out escaped one by one, classes as explicit ranges.  How a condition is matched in
time that grows with the value's length alone is ``automaton``'s part.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from evmatch.errors import InvalidPattern
from evmatch.functions import automaton
from evmatch.functions.automaton import Alt, Chars, Node, Rep, Seq, Table

LAST = 0x10FFFF
Ranges = list[tuple[int, int]]

#: fixed values: what a single character after ~ stands for
SINGLE = {c: c for c in "()*+-.?[\\]^{|}~"} | {"n": "\n", "r": "\r", "t": "\t"}
#: fixed values: ranges of the letters after ~
DIGIT: Ranges = [(0x30, 0x39)]
WORD: Ranges = [(0x61, 0x7A), (0x41, 0x5A), (0x30, 0x39), (0x5F, 0x5F)]
SPACE: Ranges = [(0x20, 0x20), (0x09, 0x09), (0x0A, 0x0A), (0x0D, 0x0D)]
NAME_START: Ranges = [
    (0x3A, 0x3A), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2FF), (0x370, 0x37D), (0x37F, 0x1FFF),
    (0x200C, 0x200D), (0x2070, 0x218F), (0x2C00, 0x2FEF), (0x3001, 0xD7FF), (0xF900, 0xFDCF), (0xFDF0, 0xFFFD), (0x10000, 0xEFFFF),
]
NAME: Ranges = [*NAME_START, (0x2D, 0x2E), (0x30, 0x39), (0xB7, 0xB7), (0x300, 0x36F), (0x203F, 0x2040)]
MULTI = {"d": DIGIT, "w": WORD, "s": SPACE, "i": NAME_START, "c": NAME}
#: fixed values: general categories
CATEGORIES = set("L Lu Ll Lt Lm Lo M Mn Mc Me N Nd Nl No P Pc Pd Ps Pe Pi Pf Po Z Zs Zl Zp S Sm Sc Sk So C Cc Cf Co Cn".split())
#: fixed values: Unicode blocks by name without spaces
BLOCKS = {
    "BasicLatin": (0x0, 0x7F), "Latin-1Supplement": (0x80, 0xFF), "LatinExtended-A": (0x100, 0x17F), "LatinExtended-B": (0x180, 0x24F),
    "LatinExtendedAdditional": (0x1E00, 0x1EFF), "IPAExtensions": (0x250, 0x2AF), "SpacingModifierLetters": (0x2B0, 0x2FF),
    "CombiningDiacriticalMarks": (0x300, 0x36F), "CombiningDiacriticalMarksforSymbols": (0x20D0, 0x20FF), "CombiningHalfMarks": (0xFE20, 0xFE2F),
    "GreekandCoptic": (0x370, 0x3FF), "Greek": (0x370, 0x3FF), "GreekExtended": (0x1F00, 0x1FFF), "Cyrillic": (0x400, 0x4FF),
    "Armenian": (0x530, 0x58F), "Hebrew": (0x590, 0x5FF), "Arabic": (0x600, 0x6FF), "ArabicPresentationForms-A": (0xFB50, 0xFDFF),
    "ArabicPresentationForms-B": (0xFE70, 0xFEFF), "Syriac": (0x700, 0x74F), "Thaana": (0x780, 0x7BF), "Devanagari": (0x900, 0x97F),
    "Bengali": (0x980, 0x9FF), "Gurmukhi": (0xA00, 0xA7F), "Gujarati": (0xA80, 0xAFF), "Oriya": (0xB00, 0xB7F), "Tamil": (0xB80, 0xBFF),
    "Telugu": (0xC00, 0xC7F), "Kannada": (0xC80, 0xCFF), "Malayalam": (0xD00, 0xD7F), "Sinhala": (0xD80, 0xDFF), "Thai": (0xE00, 0xE7F),
    "Lao": (0xE80, 0xEFF), "Tibetan": (0xF00, 0xFFF), "Myanmar": (0x1000, 0x109F), "Georgian": (0x10A0, 0x10FF), "HangulJamo": (0x1100, 0x11FF),
    "HangulCompatibilityJamo": (0x3130, 0x318F), "HangulSyllables": (0xAC00, 0xD7AF), "Ethiopic": (0x1200, 0x137F), "Cherokee": (0x13A0, 0x13FF),
    "UnifiedCanadianAboriginalSyllabics": (0x1400, 0x167F), "Ogham": (0x1680, 0x169F), "Runic": (0x16A0, 0x16FF), "Khmer": (0x1780, 0x17FF),
    "Mongolian": (0x1800, 0x18AF), "LetterlikeSymbols": (0x2100, 0x214F), "NumberForms": (0x2150, 0x218F), "Arrows": (0x2190, 0x21FF),
    "MathematicalOperators": (0x2200, 0x22FF), "MiscellaneousTechnical": (0x2300, 0x23FF), "ControlPictures": (0x2400, 0x243F),
    "OpticalCharacterRecognition": (0x2440, 0x245F), "EnclosedAlphanumerics": (0x2460, 0x24FF), "BoxDrawing": (0x2500, 0x257F),
    "BlockElements": (0x2580, 0x259F), "GeometricShapes": (0x25A0, 0x25FF), "MiscellaneousSymbols": (0x2600, 0x26FF), "Dingbats": (0x2700, 0x27BF),
    "BraillePatterns": (0x2800, 0x28FF), "CJKRadicalsSupplement": (0x2E80, 0x2EFF), "KangxiRadicals": (0x2F00, 0x2FDF),
    "IdeographicDescriptionCharacters": (0x2FF0, 0x2FFF), "CJKSymbolsandPunctuation": (0x3000, 0x303F), "Hiragana": (0x3040, 0x309F),
    "Katakana": (0x30A0, 0x30FF), "Bopomofo": (0x3100, 0x312F), "BopomofoExtended": (0x31A0, 0x31BF), "Kanbun": (0x3190, 0x319F),
    "EnclosedCJKLettersandMonths": (0x3200, 0x32FF), "CJKCompatibility": (0x3300, 0x33FF), "CJKUnifiedIdeographsExtensionA": (0x3400, 0x4DBF),
    "CJKUnifiedIdeographs": (0x4E00, 0x9FFF), "CJKUnifiedIdeographsExtensionB": (0x20000, 0x2A6DF), "CJKCompatibilityIdeographs": (0xF900, 0xFAFF),
    "CJKCompatibilityIdeographsSupplement": (0x2F800, 0x2FA1F), "CJKCompatibilityForms": (0xFE30, 0xFE4F), "YiSyllables": (0xA000, 0xA48F),
    "YiRadicals": (0xA490, 0xA4CF), "AlphabeticPresentationForms": (0xFB00, 0xFB4F), "SmallFormVariants": (0xFE50, 0xFE6F),
    "HalfwidthandFullwidthForms": (0xFF00, 0xFFEF), "Specials": (0xFFF0, 0xFFFF), "GeneralPunctuation": (0x2000, 0x206F),
    "SuperscriptsandSubscripts": (0x2070, 0x209F), "CurrencySymbols": (0x20A0, 0x20CF), "PrivateUseArea": (0xE000, 0xF8FF),
    "HighSurrogates": None, "LowSurrogates": None, "Tags": (0xE0000, 0xE007F), "SupplementaryPrivateUseArea-A": (0xF0000, 0xFFFFF),
    "SupplementaryPrivateUseArea-B": (0x100000, 0x10FFFF), "OldItalic": (0x10300, 0x1032F), "Gothic": (0x10330, 0x1034F),
    "Deseret": (0x10400, 0x1044F), "ByzantineMusicalSymbols": (0x1D000, 0x1D0FF), "MusicalSymbols": (0x1D100, 0x1D1FF),
    "MathematicalAlphanumericSymbols": (0x1D400, 0x1D7FF),
}


def escaped(c: str) -> str:
    if c.isascii() and c.isalnum():
        return c
    if c.isascii() and c.isprintable():
        return "\\" + c if c != " " else "[ ]"
    return f"\\u{ord(c):04x}" if ord(c) < 32 or ord(c) == 127 else c


def _item(c: str) -> str:
    return c if c.isascii() and c.isalnum() or ord(c) > 127 and not 0xD800 <= ord(c) <= 0xDFFF else f"\\x{ord(c):02x}" if ord(c) < 128 else c


def _range(lo: int, hi: int) -> str:
    parts = []
    for a, b in ((lo, min(hi, 0xD7FF)), (max(lo, 0xE000), hi)):  # no surrogates
        if a <= b:
            parts.append(_item(chr(a)) if a == b else f"{_item(chr(a))}-{_item(chr(b))}")
    return "".join(parts)


def _invert(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for lo, hi in sorted(ranges):
        if lo > at:
            out.append((at, lo - 1))
        at = max(at, hi + 1)
    return [*out, (at, LAST)] if at <= LAST else out


@dataclass
class Set:
    """Ranges and categories, possibly negated as a whole."""

    ranges: Ranges = field(default_factory=list)
    parts: list[str] = field(default_factory=list)  # \p{..} and \P{..}

    def text(self, negated: bool = False) -> str:
        inner = "".join(_range(a, b) for a, b in self.ranges) + "".join(self.parts)
        if not inner:
            return "[\\x00-\\x{10ffff}]" if negated else automaton.NEVER
        return f"[{'^' * negated}{inner}]"

    def chars(self, negated: bool = False) -> Chars:
        kinds = tuple((p[3:-1], p[1] == "P") for p in self.parts)
        return Chars(self.text(negated), ((tuple(self.ranges), kinds, negated),))


def literal(c: str) -> Chars:
    return Chars(escaped(c), ((((ord(c), ord(c)),), (), False),))


ANY = Chars("[\\x00-\\x{d7ff}\\x{e000}-\\x{10ffff}]", ((((0, LAST),), (), False),))


@dataclass
class Atom:
    node: Node
    width: int | None  # None: varies
    look: str = ""  # one of = ! <= <!
    top: bool = False


class Parser:
    def __init__(self, source: str):
        self.s, self.i, self.depth = source, 0, 0

    def fail(self, what: str) -> InvalidPattern:
        return InvalidPattern(f"regexp: {what} at {self.i} in {self.s!r}")

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        if self.i >= len(self.s):
            raise self.fail("unexpected end")
        self.i += 1
        return self.s[self.i - 1]

    def branches(self) -> list[list[Atom]]:
        out: list[list[Atom]] = [[]]
        while (c := self.peek()) and c != ")":
            if c == "|":
                self.i += 1
                out.append([])
            else:
                out[-1].append(self.piece())
        return out

    def piece(self) -> Atom:
        atom = self.atom()
        c = self.peek()
        if not c or c not in "?*+{":
            return atom
        if atom.look:
            raise self.fail("a lookaround cannot be repeated")
        if c == "{":
            lo, hi = self.counts()
        else:
            self.i += 1
            lo, hi = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if self.peek() == "?":  # lazy: the same for whole values
            self.i += 1
        return Atom(Rep(atom.node, lo, hi), atom.width * lo if lo == hi and atom.width is not None else None)

    def counts(self) -> tuple[int, int | None]:
        self.i += 1
        end = self.s.find("}", self.i)
        if end < 0:
            raise self.fail("unclosed {")
        low, comma, high = self.s[self.i : end].partition(",")
        if not (low.isascii() and low.isdigit()) or high and not (high.isascii() and high.isdigit()):
            raise self.fail("a quantifier needs numbers")
        self.i = end + 1
        lo, hi = int(low), int(high) if high else None if comma else int(low)
        if hi is not None and hi < lo or lo > 100 or (hi or 0) > 100:
            raise self.fail("a quantifier's bounds are 0 to 100, in order")
        return lo, hi

    def atom(self) -> Atom:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return Atom(self.char_class(), 1)
        if c == ".":
            return Atom(ANY, 1)
        if c == "~":
            return Atom(self.escape_atom(), 1)
        if c in "?*+{":
            raise self.fail("nothing to repeat")
        if c in "]}":
            raise self.fail(f"stray {c}")
        return Atom(literal(c), 1)

    def group(self) -> Atom:
        look = ""
        if self.peek() == "?":
            kind = next((k for k in ("?<=", "?<!", "?=", "?!", "?:") if self.s.startswith(k, self.i)), None)
            if kind is None:
                raise self.fail("named and other special groups are not supported")
            self.i += len(kind)
            look = kind[1:] if kind != "?:" else ""
        self.depth += 1
        inner = self.branches()
        self.depth -= 1
        if self.peek() != ")":
            raise self.fail("unclosed (")
        self.i += 1
        if look and any(a.look for b in inner for a in b):
            raise self.fail("a lookaround inside a lookaround")
        node, width = joined(inner)
        if look.startswith("<") and width is None:
            raise self.fail("a lookbehind of varying length")
        return Atom(node, width, look)

    def escape(self) -> tuple[str, Ranges | None, str]:
        """After ~: (character, None, ""), ("", ranges, "") or ("", None, category)."""
        c = self.take()
        if c in SINGLE:
            return SINGLE[c], None, ""
        if c.lower() in MULTI:
            ranges = MULTI[c.lower()]
            return "", ranges if c.islower() else _invert(ranges), ""
        if c in "pP":
            if self.take() != "{":
                raise self.fail("a category needs braces")
            end = self.s.find("}", self.i)
            if end < 0:
                raise self.fail("unclosed category")
            name, self.i = self.s[self.i : end], end + 1
            if name in CATEGORIES:
                return "", None, f"\\{c}{{{name}}}"
            block = name.removeprefix("Is")
            if name.startswith("Is") and block in BLOCKS:
                span = BLOCKS[block]
                ranges = [span] if span else []
                return "", ranges if c == "p" else _invert(ranges), ""
            raise self.fail(f"unknown category {name}")
        raise self.fail("back references are not supported" if c.isdigit() else f"unknown escape ~{c}")

    def escape_atom(self) -> Chars:
        c, ranges, category = self.escape()
        if c:
            return literal(c)
        return Set(list(ranges or []), [category] if category else []).chars()

    def char_class(self) -> Chars:
        negated = self.peek() == "^"
        self.i += negated
        found, empty = Set(), True
        while True:
            c = self.take()
            if c == "]":
                if empty:
                    raise self.fail("empty class")
                return found.chars(negated)
            if c == "[" or c == "-" and not empty and self.peek() not in ("]", "") and not self._after_set:
                raise self.fail(f"unescaped {c} in a class")
            empty, self._after_set = False, False
            lo = c
            if c == "~":
                lo, ranges, category = self.escape()
                if not lo:
                    found.ranges += ranges or []
                    found.parts += [category] if category else []
                    self._after_set = True
                    continue
            if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] not in ("]", ""):
                self.i += 1
                hi = self.take()
                if hi == "[":
                    raise self.fail("class subtraction is not supported")
                if hi == "~":
                    hi = self.escape()[0]
                    if not hi:
                        raise self.fail("a range cannot end in a class")
                if ord(hi) < ord(lo):
                    raise self.fail("a range in the wrong order")
                found.ranges.append((ord(lo), ord(hi)))
            else:
                found.ranges.append((ord(lo), ord(lo)))

    _after_set = False


def joined(branches: list[list[Atom]]) -> tuple[Node, int | None]:
    """Tree and width of alternatives; a lookaround below the top counts as plain content."""
    widths = {None if any(a.width is None for a in b) else sum(a.width for a in b) for b in branches}
    return Alt(tuple(Seq(tuple(a.node for a in b)) for b in branches)), widths.pop() if len(widths) == 1 else None


@dataclass(frozen=True)
class Condition:
    """What the whole value must match, or must not: the JVM's source, or a table for all values but short ones."""

    pattern: str
    positive: bool = True
    table: Table | None = None
    short: bool = True  # whether the source does for short values

    @property
    def anchored(self) -> str:
        return f"(?s)\\A(?:{self.pattern})\\z"

    def column(self, v: Column) -> Column:
        met = v.rlike(self.anchored) if self.short else None
        if self.table:
            fold = self.table.column(v)
            met = fold if met is None else F.when(F.char_length(v) <= automaton.SHORT, met).otherwise(fold)
        return met if self.positive else ~met

    def holds(self, value: str) -> bool:
        if self.table and not (self.short and len(value) <= automaton.SHORT):
            return self.table.holds(value) == self.positive
        return (_compiled(self.anchored).search(value) is not None) == self.positive


@lru_cache(4096)
def _compiled(pattern: str) -> Any:
    import regex

    return regex.compile(for_python(pattern))


def translate(source: str, strict_lookaround: bool = False) -> tuple[Condition, ...]:
    """Conditions on the whole value, cheapest first.

    ``A(?=B)`` asks that the value be AB, ``A(?!B)`` that it not be; ``(?<=B)A`` asks for BA,
    ``(?<!B)A`` that it not be BA.  ``strict_lookaround`` asks besides that A be at the value's start
    (lookahead) or end (lookbehind).
    """
    parser = Parser(source)
    branches = parser.branches()
    if parser.i < len(source):
        raise parser.fail("unbalanced )")

    def condition(node: Node, positive: bool = True) -> Condition:
        try:
            text, table, short = automaton.linear(node)
        except automaton.TooLarge:
            raise InvalidPattern(f"regexp: too many states in {source!r}") from None
        return Condition(text, positive, table, short)

    if not any(a.look for b in branches for a in b):
        return (condition(joined(branches)[0]),)
    if len(branches) > 1:
        raise InvalidPattern(f"regexp: lookaround beside alternatives in {source!r}")
    atoms = branches[0]
    primary = [a.node for a in atoms if not a.look]
    found: list[tuple[int, Condition]] = []
    for n, a in enumerate(atoms):
        before = [x.node for x in atoms[:n] if not x.look]
        if a.look in ("=", "!"):
            found.append((10 if a.look == "=" else 20, condition(Seq((*before, a.node)), a.look == "=")))
            extra = Seq((*before, Rep(ANY, 0, None)))
        elif a.look:
            found.append((30 if a.look == "<=" else 40, condition(Seq((a.node, *primary)), a.look == "<=")))
            extra = Seq((Rep(ANY, 0, None), *primary))
        if a.look and strict_lookaround:
            found.append((50, condition(extra)))
    return tuple(c for _, c in sorted(found, key=lambda x: x[0]))


def for_python(pattern: str) -> str:
    """The same for the ``regex`` module, version 1 sets."""
    import re

    return "(?V1)" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern).replace("\\z", "\\Z")
