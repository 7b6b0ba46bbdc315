r"""Turning rule patterns into the regular expressions the JVM runs.

The case-sensitive line rules and the whole-file checks follow Unicode word, space and edge
classes and know only LF as line end: flags ``dU``.  Ignoring case folds ASCII letters only.
The case-insensitive line rules use ASCII classes with a Unicode-aware ``\b``; writing the
edge as ``(?U:\b)`` keeps that meaning the same on every JVM release.
"""

from __future__ import annotations

import re


def exact_line(pattern: str) -> str:
    return "(?dU)" + pattern


def folded_line(pattern: str) -> str:
    return "(?i)" + pattern.replace(r"\b", r"(?U:\b)")


def whole_file(pattern: str, flags: str = "", starts: str = "") -> str:
    """``starts`` lists the letters a match can begin with.

    The JVM tries a pattern at every character; a class of first letters in front turns most
    of them away before a look-behind or an alternation is tried.
    """
    ahead = ""
    if starts:
        letters = starts + starts.upper() if "i" in flags else starts
        ahead = f"(?=[{letters}])"
    return f"(?dU{flags}{'-u' if 'i' in flags else ''})" + ahead + pattern


def alternatives(pattern: str) -> list[str]:
    """Patterns of which at least one matches exactly where the pattern does: what stands between
    its outermost bars.  Itself, where flags, quotes or back references reach over these."""
    if "|" not in pattern or re.search(r"\(\?|\\[Qk1-9]|\[\^?\]", pattern):
        return [pattern]
    parts, depth, opened, begin, at = [], 0, 0, 0, 0
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            at += 1
        elif char == "[" or opened:
            opened += (char == "[") - (char == "]")
        elif char == "|" and not depth:
            parts.append(pattern[begin: at])
            begin = at + 1
        else:
            depth += (char == "(") - (char == ")")
        at += 1
    return [*parts, pattern[begin:]]


def plain_text(pattern: str) -> str | None:
    """The text a pattern stands for if it is nothing but that, else None."""
    bare = re.sub(r"\\([^A-Za-z0-9\s])", "", pattern)
    if not pattern or re.search(r"[\\.^$*+?{}\[\]()|]", bare):
        return None
    return re.sub(r"\\(.)", r"\1", pattern)


def first_suffices(pattern: str) -> str:
    r"""The same answer for one line, in time proportional to it.

    A pattern of parts with ``.*`` between them matches a line exactly when its first part does,
    the next part behind the first place of that, and so on.  As written, every place of the
    first part runs to the end of the line; here each part is looked for once, and where the rest
    is missing nothing is tried again.  Parts must not hold ``.*`` in a group or class.
    """
    *parts, last = pattern.split(".*")
    return "^" + "".join(f"(?>.*?{part})" for part in parts) + ".*" + last if parts else pattern


def first_of_part(opening: str, stop: str, rest: str, repeat: str = "*") -> str:
    """``opening`` followed by characters other than ``stop`` and then ``rest``, tried once a part.

    Parts are what lies between the stops.  If any opening of a part goes on so, its first does.
    """
    return f"(?<![^{stop}])(?>[^{stop}]*?{opening})[^{stop}]{repeat}+{rest}"


def marked_part(opening: str, stop: str, inside: str, closed: bool) -> str:
    """As ``first_of_part``, for text ``inside`` before the stop; groups: what is before, the match.

    A part has at most one match: from its first opening, if ``inside`` comes after that.
    """
    return (
        f"(?<![^{stop}])((?>[^{stop}]*?(?={opening})))"
        f"({opening}(?=[^{stop}]*?{inside})[^{stop}]*+{'[' + stop + ']' if closed else ''})"
    )
