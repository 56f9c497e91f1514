"""What a text must hold for a regular expression to match: the keys of a rule index.

:func:`pattern_keys` reads a pattern once and gives a few short keys such that
every text with a match has one of them at least: the literal that a pattern tied
to the start begins with (``HEAD`` and ``GRAM`` characters) or its possible first
characters (``HEAD`` and one), a literal piece that each match holds (up to
``GRAM`` characters, so it is shorter than the other keys), or ``ANY``.  Whatever the reader does not know counts as "anything", so a key
never excludes a match; :func:`text_keys` gives the keys of a text, as a Column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3                        # characters of a literal piece that are looked up
MAX_FIRST = 64                  # first characters of a pattern that are listed
HEAD = "^^^^"                   # marks what stands at a text's start
ANY = "****"

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
CLASSES = {"d": DIGITS, "w": LETTERS | DIGITS | {"_"}, "s": frozenset(" \t\n\x0b\f\r")}
CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "a": "\x07", "e": "\x1b"}


@dataclass(frozen=True)
class Need:
    """What a piece of a pattern asks of its match.

    ``exact``: the only text it matches (None: several); ``prefix``: a literal that
    every match begins with; ``must``: one that every match holds; ``first``: its possible first characters (None: any);
    ``empty``: it may match the empty text; ``start``: it matches at the text's start only.
    """
    exact: str | None = None
    must: str = ""
    first: frozenset | None = None
    empty: bool = True
    start: bool = False
    prefix: str = ""


NOTHING = Need(exact="", first=frozenset())
UNKNOWN = Need()


def _literal(c: str) -> Need:
    return Need(c, c, frozenset(c), False, prefix=c)


def _then(a: Need, b: Need, run: str) -> tuple[Need, str]:
    """``a`` followed by ``b``; ``run`` is the literal that ``a`` ends with."""
    run = run + b.exact if b.exact is not None else ""
    exact = a.exact + b.exact if a.exact is not None and b.exact is not None else None
    first = a.first if not a.empty else (None if a.first is None or b.first is None else a.first | b.first)
    must = max(a.must, b.must, run, key=len)
    prefix = a.exact + (b.exact if b.exact is not None else b.prefix) if a.exact is not None else a.prefix
    return Need(exact, must, first, a.empty and b.empty, a.start or (b.start and a.exact == ""), prefix), run


def _either(parts: list[Need]) -> Need:
    if len(parts) == 1:
        return parts[0]
    first = None if any(p.first is None for p in parts) else frozenset().union(*(p.first for p in parts))
    return Need(None, "", first, any(p.empty for p in parts), all(p.start for p in parts))


def _repeat(p: Need, least: int, most: int | None) -> Need:
    if least == 0:
        return Need(None, "", p.first, True, False)
    if p.exact is not None:
        text = p.exact * min(least, 16)
        same = least == most and least <= 16
        return Need(text if same else None, text, p.first, p.empty, p.start, text)
    return Need(None, p.must, p.first, p.empty, p.start, p.prefix)


class _Reader:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def more(self, text: str) -> bool:
        if self.p.startswith(text, self.i):
            self.i += len(text)
            return True
        return False

    def alternatives(self) -> Need:
        parts = [self.sequence()]
        while self.more("|"):
            parts.append(self.sequence())
        return _either(parts)

    def sequence(self) -> Need:
        need, run = NOTHING, ""
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            need, run = _then(need, self.quantified(), run)
        return need

    def quantified(self) -> Need:
        need = self.atom()
        while self.i < len(self.p):
            if self.more("*"):
                need = _repeat(need, 0, None)
            elif self.more("+"):
                need = _repeat(need, 1, None)
            elif self.more("?"):
                need = _repeat(need, 0, 1)
            elif self.p[self.i] == "{":
                body, _, _ = self.p[self.i + 1:].partition("}")
                low, comma, high = body.partition(",")
                if not low.isdigit() or (high and not high.isdigit()):
                    raise ValueError("quantifier")
                self.i += len(body) + 2
                need = _repeat(need, int(low), int(high) if high else None if comma else int(low))
            else:
                break
            if not (self.more("?") or self.more("+")):          # lazy and possessive forms ask for the same
                break
        return need

    def atom(self) -> Need:
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.char_class()
        if c == ".":
            return Need(None, "", None, False)
        if c == "^":
            return Need("", "", frozenset(), True, True)
        if c == "$":
            return NOTHING
        if c == "\\":
            return self.escape()
        return _literal(c)

    def group(self) -> Need:
        about = None
        if self.more("?"):
            if self.more(":") or self.more(">"):
                pass
            elif self.more("=") or self.more("!") or self.more("<=") or self.more("<!"):
                about = NOTHING                                  # looks around, takes no text
            elif self.more("<"):
                self.i = self.p.index(">", self.i) + 1           # a name
            else:
                raise ValueError("flags")
        need = self.alternatives()
        if not self.more(")"):
            raise ValueError("open group")
        return about or need

    def escape(self) -> Need:
        c = self.p[self.i]
        self.i += 1
        if c in CLASSES:
            return Need(None, "", CLASSES[c], False)
        if c in "DWSRXhHvV":
            return Need(None, "", None, False) if c != "X" else UNKNOWN
        if c in "bBAGzZ":
            return Need("", "", frozenset(), True, c == "A")
        if c in CONTROL:
            return _literal(CONTROL[c])
        if c.isalnum():
            raise ValueError("escape")                           # numbers, names, properties, quotes
        return _literal(c)

    def char_class(self) -> Need:
        if self.more("^"):
            self.skip_class()
            return Need(None, "", None, False)
        at, chars, start = self.i, set(), True
        while True:
            c = self.p[self.i]
            self.i += 1
            if c == "]" and not start:
                break
            start = False
            if c == "[" or (c == "&" and self.p[self.i] == "&"):
                self.i = at
                self.skip_class()
                return Need(None, "", None, False)
            one = None
            if c == "\\":
                e = self.p[self.i]
                self.i += 1
                if e in CLASSES:
                    chars |= CLASSES[e]
                    continue
                if e.isalnum() and e not in CONTROL:
                    self.i = at
                    self.skip_class()
                    return Need(None, "", None, False)
                one = CONTROL.get(e, e)
            else:
                one = c
            if self.p[self.i] == "-" and self.p[self.i + 1] not in "]\\[":
                last = self.p[self.i + 1]
                self.i += 2
                if ord(last) - ord(one) > 1000:
                    self.i = at
                    self.skip_class()
                    return Need(None, "", None, False)
                chars |= {chr(x) for x in range(ord(one), ord(last) + 1)}
            else:
                chars.add(one)
        if len(chars) == 1:
            c = next(iter(chars))
            return _literal(c)
        return Need(None, "", frozenset(chars), False)

    def skip_class(self) -> None:
        """To behind the bracket that closes the class."""
        depth = 1
        if self.p[self.i] == "]":
            self.i += 1
        while depth:
            c = self.p[self.i]
            self.i += 1
            if c == "\\":
                self.i += 1
            depth += (c == "[") - (c == "]")


def pattern_need(pattern: str) -> Need:
    """What ``pattern`` asks of a text; :data:`UNKNOWN` where the reader gives up."""
    if "\\Q" in pattern or "(?i" in pattern:
        return UNKNOWN
    r = _Reader(pattern)
    try:
        need = r.alternatives()
        return need if r.i == len(pattern) else UNKNOWN
    except (ValueError, IndexError, RecursionError):
        return UNKNOWN


def pattern_keys(pattern: str) -> list[str]:
    """Keys of which a text with a match has one; literal pieces come alone, and any single one of them will do."""
    need = pattern_need(pattern)
    if need.start and len(need.prefix) >= GRAM:
        return [HEAD + need.prefix[:GRAM]]
    if len(need.must) >= GRAM:
        return sorted({need.must[i:i + GRAM] for i in range(len(need.must) - GRAM + 1)})
    if need.start and not need.empty and need.first is not None and 0 < len(need.first) <= MAX_FIRST:
        return [HEAD + c for c in sorted(need.first)]
    return [need.must] if need.must else [ANY]


def is_piece(key: Column) -> Column:
    """True for literal pieces."""
    return F.length(key) <= GRAM


def key_kind(key: Column) -> Column:
    """Kind of a key: ``*``, ``^1``, ``^3`` (start) or ``1`` to ``3`` (pieces of that length)."""
    return F.when(is_piece(key), F.length(key).cast("string")).when(key == ANY, F.lit("*")).otherwise(F.concat(F.lit("^"), F.length(key) - len(HEAD)))


def witness(key: Column) -> Column:
    """A character of a literal piece, one that is rare in most texts if it has such."""
    return F.coalesce(*[F.nullif(F.regexp_extract(key, c, 0), F.lit("")) for c in (r"[^\p{L}\p{N}]", r"\p{N}", r"[^a-z]", "(?s).")])


def text_keys(text: Column, kinds: list[str], witnesses: list[str] | None = None) -> Column:
    """Keys of a text, of the given kinds, each once.  ``witnesses`` (None: unknown): the characters of which
    one is in every literal piece in use, so texts without any are not cut into pieces."""
    none = F.array().cast("array<string>")
    parts = [none]
    for kind in kinds:
        if kind == "*":
            parts.append(F.array(F.lit(ANY)))
        elif kind[0] == "^":
            q = int(kind[1:])
            parts.append(F.when(F.length(text) >= q, F.array(F.concat(F.lit(HEAD), F.substring(text, 1, q)))).otherwise(none))
        else:
            has = F.length(text) >= int(kind)
            if witnesses:
                has = has & text.rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in witnesses) + "]")
            # every position: a look ahead takes no text (and stays in generated code, unlike a lambda)
            pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{int(kind)}}}))"), F.lit(1))
            parts.append(F.when(has, F.array_distinct(pieces)).otherwise(none))
    return F.concat(*parts)
