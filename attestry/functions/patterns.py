"""Engine configurations' patterns, written for Spark's expressions."""

from __future__ import annotations

import re
import warnings
from re import _constants as op
from re import _parser as parser

# What a class of characters is, inside brackets: as the configurations mean it, and in
# their ASCII mode.
MEMBERS = {
    "DIGIT": (r"\p{Nd}", "0-9"),
    "SPACE": (r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\p{Z}", r"\x09-\x0D\x20"),
    "WORD": (r"\p{L}\p{N}_", "A-Za-z0-9_"),
}
PLACES = {
    op.AT_BEGINNING_STRING: r"\A", op.AT_END_STRING: r"\z",
    op.AT_BOUNDARY: r"(?U:\b)", op.AT_NON_BOUNDARY: r"(?U:\B)",
}


def java_pattern(pattern: str) -> str | None:
    """The pattern in Java's syntax with the same groups by number; None if it has no such form.

    Names of groups, comments and verbose blanks go; classes, line ends and word borders
    mean what they mean in the configurations.  Conditional groups have no counterpart.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(pattern)
            tree = parser.parse(pattern)
        return _written(tree, tree.state.flags, bool(tree.state.flags & re.IGNORECASE))
    except (re.error, NotImplementedError, RecursionError, OverflowError):
        return None


def _written(tree, flags: int, wrap: bool = False) -> str:
    text = "".join(_item(code, value, flags) for code, value in tree)
    return f"(?iu:{text})" if wrap else text


def _letter(point: int) -> str:
    return chr(point) if chr(point).isascii() and chr(point).isalnum() else f"\\x{{{point:X}}}"


def _category(code, flags: int) -> tuple[str, bool]:
    """What stands inside the brackets of a category, and whether it is what is left out."""
    name = str(code).removeprefix("CATEGORY_")
    return MEMBERS[name.removeprefix("NOT_")][bool(flags & re.ASCII)], name.startswith("NOT_")


def _set(items, flags: int) -> str:
    negated = items[0][0] is op.NEGATE
    inside, others = "", []
    for code, value in items[negated:]:
        if code is op.LITERAL:
            inside += _letter(value)
        elif code is op.RANGE:
            inside += f"{_letter(value[0])}-{_letter(value[1])}"
        else:
            members, left_out = _category(value, flags)
            if left_out:
                others.append(f"[^{members}]")
            else:
                inside += members
    if not others:
        return f"[{'^' * negated}{inside}]"
    either = "|".join([*([f"[{inside}]"] if inside else []), *others])
    return rf"(?!{either})[\s\S]" if negated else f"(?:{either})"


def _item(code, value, flags: int) -> str:
    lines = flags & re.MULTILINE
    if code is op.LITERAL:
        return _letter(value)
    if code is op.NOT_LITERAL:
        return f"[^{_letter(value)}]"
    if code is op.ANY:
        return r"[\s\S]" if flags & re.DOTALL else r"[^\n]"
    if code is op.IN:
        return _set(value, flags)
    if code is op.AT:
        if value is op.AT_BEGINNING:
            return r"(?:\A|(?<=\n))" if lines else r"\A"
        if value is op.AT_END:
            return r"(?=\n|\z)" if lines else r"(?=\n?\z)"
        return PLACES[value]
    if code is op.BRANCH:
        return "(?:" + "|".join(_written(branch, flags) for branch in value[1]) + ")"
    if code is op.SUBPATTERN:
        group, more, less, inner = value
        inside = (flags | more) & ~less
        text = _written(inner, inside)
        if (inside ^ flags) & re.IGNORECASE:
            text = f"(?iu:{text})" if inside & re.IGNORECASE else f"(?-i:{text})"
        return f"(?:{text})" if group is None else f"({text})"
    if code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, inner = value
        most = "" if high is op.MAXREPEAT else high
        kind = {op.MAX_REPEAT: "", op.MIN_REPEAT: "?", op.POSSESSIVE_REPEAT: "+"}[code]
        return f"(?:{_written(inner, flags)}){{{low},{most}}}{kind}"
    if code is op.GROUPREF:
        return rf"(?:\{value})"
    if code in (op.ASSERT, op.ASSERT_NOT):
        way, inner = value
        return f"(?{'<' if way < 0 else ''}{'=' if code is op.ASSERT else '!'}{_written(inner, flags)})"
    if code is op.ATOMIC_GROUP:
        return f"(?>{_written(value, flags)})"
    raise NotImplementedError(code)
