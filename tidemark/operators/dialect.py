"""Regular expressions as Python means them, written for the executors' Java engine.

An expression is parsed by Python's own parser and written anew from its parse
tree, so classes, anchors, dots, groups and flags keep their meaning, and what
Java cannot say is refused instead of searched for differently.  The same tree
tells how short a match can be and which literals every match must hold.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as C
from re import _parser as parser

#: White space, digits and word characters as members of a Java class; (Unicode, ASCII).
SPACE = (r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}", r"\x09-\x0d\x20")
DIGIT = (r"\p{Nd}", "0-9")
WORD = (r"\p{L}\p{N}_", "A-Za-z0-9_")
#: Alternatives that the literals of one expression may grow to.
MAX_ALTERNATIVES = 16

_MEMBERS = {C.CATEGORY_SPACE: SPACE, C.CATEGORY_DIGIT: DIGIT, C.CATEGORY_WORD: WORD}
_OTHERS = {C.CATEGORY_NOT_SPACE: SPACE, C.CATEGORY_NOT_DIGIT: DIGIT, C.CATEGORY_NOT_WORD: WORD}
_REPEATS = {C.MAX_REPEAT: "", C.MIN_REPEAT: "?", C.POSSESSIVE_REPEAT: "+"}
#: Whether ``\\B`` matches an empty text depends on Python's version.
_NOT_EMPTY = "" if re.search(r"\B", "") else r"(?!\A\z)"
_ANY = r"[\x00-\x{10FFFF}]"


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() else rf"\x{{{code:x}}}"


class _Writer:
    def __init__(self, flags: int):
        self.flags = flags

    def _kind(self) -> int:
        """Which column of the fixed values holds."""
        return 1 if self.flags & re.ASCII else 0

    def members(self, items) -> str:
        out = []
        for op, value in items:
            if op is C.LITERAL:
                out.append(_char(value))
            elif op is C.RANGE:
                out.append(f"{_char(value[0])}-{_char(value[1])}")
            elif value in _MEMBERS:
                out.append(_MEMBERS[value][self._kind()])
            else:
                out.append(f"[^{_OTHERS[value][self._kind()]}]")
        return "".join(out)

    def one_of(self, items) -> str:
        if items[0][0] is not C.NEGATE:
            return f"[{self.members(items)}]"
        items = items[1:]
        if any(op is C.CATEGORY and value in _OTHERS for op, value in items):
            return f"(?:(?![{self.members(items)}]){_ANY})"
        return f"[^{self.members(items)}]"

    def anchor(self, where) -> str:
        lines, word = self.flags & re.MULTILINE, f"[{WORD[self._kind()]}]"
        return {
            C.AT_BEGINNING: r"(?<![^\n])" if lines else r"\A", C.AT_BEGINNING_STRING: r"\A",
            C.AT_END: r"(?![^\n])" if lines else r"(?=\n?\z)", C.AT_END_STRING: r"\z",
            C.AT_BOUNDARY: f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
            C.AT_NON_BOUNDARY: f"(?:{_NOT_EMPTY}(?<={word})(?={word})|{_NOT_EMPTY}(?<!{word})(?!{word}))",
        }[where]

    def group(self, opening: str, body, add: int = 0, drop: int = 0) -> str:
        before = self.flags
        if add & (re.ASCII | re.UNICODE):
            self.flags &= ~(re.ASCII | re.UNICODE)
        self.flags = (self.flags | add) & ~drop
        text = self.sequence(body)
        if (before ^ self.flags) & (re.IGNORECASE | re.ASCII):
            text = f"(?{self.case()}:{text})"
        self.flags = before
        return f"{opening}{text})"

    def case(self) -> str:
        if not self.flags & re.IGNORECASE:
            return "-iu"
        return "i-u" if self.flags & re.ASCII else "iu"

    def sequence(self, tree) -> str:
        return "".join(self.element(op, value) for op, value in tree)

    def element(self, op, value) -> str:
        if op is C.LITERAL:
            return _char(value)
        if op is C.NOT_LITERAL:
            return f"[^{_char(value)}]"
        if op is C.ANY:
            return _ANY if self.flags & re.DOTALL else r"[^\n]"
        if op is C.IN:
            return self.one_of(value)
        if op is C.BRANCH:
            return "(?:" + "|".join(self.sequence(b) for b in value[1]) + ")"
        if op is C.SUBPATTERN:
            number, add, drop, body = value
            return self.group("(?:" if number is None else "(", body, add, drop)
        if op is C.ATOMIC_GROUP:
            return self.group("(?>", value)
        if op in (C.ASSERT, C.ASSERT_NOT):
            behind, body = "<" if value[0] < 0 else "", value[1]
            return self.group(f"(?{behind}{'=' if op is C.ASSERT else '!'}", body)
        if op is C.AT:
            return self.anchor(value)
        if op is C.GROUPREF:
            if self.flags & re.IGNORECASE and not self.flags & re.ASCII:
                raise ValueError("a back reference that ignores the case of any letter has no counterpart on the executors")
            return rf"(?:\{value})"
        if op in _REPEATS:
            low, high, body = value
            if high is not C.MAXREPEAT and high >= 1 << 31:
                raise ValueError("a repeat that long is not supported")
            times = "*" if (low, high) == (0, C.MAXREPEAT) else f"{{{low},{'' if high is C.MAXREPEAT else high}}}"
            return self.group("(?:", body) + times + _REPEATS[op]
        raise ValueError(f"{str(op).lower()} has no counterpart on the executors")


def parse(regex: str, unicode: bool = True):
    """Python's parse tree; raises ``re.error``."""
    return parser.parse(regex, 0 if unicode else re.ASCII)


def to_java(regex: str, unicode: bool = True) -> str:
    """The expression for Java; ValueError where there is none.

    Groups keep their numbers and lose their names.  Letters and digits are
    those of Unicode as far as both engines know the same version of it.
    """
    tree = parse(regex, unicode)
    writer = _Writer(tree.state.flags)
    body = writer.sequence(tree)
    return f"(?{writer.case()}:{body})" if tree.state.flags & re.IGNORECASE else body


def can_be_empty(regex: str) -> bool:
    """Whether an empty string, somewhere, can be a match."""
    return parse(regex).getwidth()[0] == 0


def fold(text: str) -> str:
    """How literals are compared: A-Z in lower case, and the other letters that a case-blind ASCII letter matches."""
    return text.translate(FOLD)


#: What ``fold`` maps, beside A-Z; the letters outside ASCII whose case variants are ASCII.
FOLD_FROM, FOLD_TO = "ſıİK", "siik"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + FOLD_FROM, "abcdefghijklmnopqrstuvwxyz" + FOLD_TO)


def needed_literals(regex: str, unicode: bool = True) -> list[frozenset[str]]:
    """Alternatives of folded ASCII literals: the text of any match holds, once folded, all literals of at least one.

    ``[frozenset()]`` says that nothing is known.
    """
    return _needs(parse(regex, unicode))


def _needs(tree) -> list[frozenset[str]]:
    literals, run, nested = [], [], []

    def end() -> None:
        if run:
            literals.append("".join(run))
            run.clear()

    def walk(items) -> None:
        for op, value in items:
            if op is C.LITERAL and value < 128:
                run.append(fold(chr(value)))
                continue
            if op is C.IN and all(o is C.LITERAL and v < 128 for o, v in value) and len({fold(chr(v)) for _, v in value}) == 1:
                run.append(fold(chr(value[0][1])))
                continue
            if op is C.SUBPATTERN and all(o is C.LITERAL for o, _ in value[3]):
                walk(value[3])
                continue
            end()
            if op is C.SUBPATTERN:
                nested.append(_needs(value[3]))
            elif op is C.ATOMIC_GROUP:
                nested.append(_needs(value))
            elif op is C.BRANCH:
                either = [n for b in value[1] for n in _needs(b)]
                nested.append(either if len(either) <= MAX_ALTERNATIVES else [frozenset()])
            elif op in _REPEATS and value[0] >= 1:
                nested.append(_needs(value[2]))

    walk(tree)
    end()
    out = [frozenset(literals)]
    for alternatives in nested:
        if len(out) * len(alternatives) <= MAX_ALTERNATIVES:
            out = [a | b for a, b in product(out, alternatives)]
    return out
