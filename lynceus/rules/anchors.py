"""Texts that a line must hold for a pattern to match it."""

from __future__ import annotations

import re

# Escapes that stand for a place or a set of characters.
_SETS = frozenset("dDwWsSbBAzZGRhHvVXtnrfae")
_COUNTED = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_OPENING = re.compile(r"\(\?(?:(<?[=!])|([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])|(>)|(<[a-zA-Z][a-zA-Z0-9]*>))")
_ONE = re.compile(r"([^\\^\[\]&])|\\([^a-zA-Z0-9])")


class _Unknown(Exception):
    """A construct that this reader does not follow."""


def _class_end(pattern: str, at: int) -> int:
    """Behind the character class that opens at ``at``."""
    depth, i = 0, at
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[":
            depth += 1
            if pattern[i + 1 : i + 2] == "^":
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                i += 1
        elif pattern[i] == "]":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    raise _Unknown


def _quantifier(pattern: str, at: int) -> tuple[bool, bool, int]:
    """Whether one stands at ``at``, whether it allows none, and where it ends."""
    mark = pattern[at : at + 1]
    if mark in ("?", "*", "+") and mark:
        optional, end = mark != "+", at + 1
    elif mark == "{":
        found = _COUNTED.match(pattern, at)
        if not found:
            raise _Unknown
        optional, end = int(found[1]) == 0, found.end()
    else:
        return False, False, at
    return True, optional, end + 1 if pattern[end : end + 1] in ("?", "+") and pattern[end : end + 1] else end


def _branches(pattern: str, at: int, inside: bool) -> tuple[list[list[str]], int]:
    """For each alternative from ``at`` on, the texts that it must hold; where the group ends."""
    branches: list[list[str]] = []
    runs: list[str] = []
    run = ""

    def cut() -> None:
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    i = at
    while i < len(pattern):
        c = pattern[i]
        if c == ")":
            if not inside:
                raise _Unknown
            cut()
            return [*branches, runs], i + 1
        if c == "|":
            cut()
            branches.append(runs)
            runs = []
            i += 1
            continue
        literal, group = None, None
        if c == "\\":
            e = pattern[i + 1 : i + 2]
            if e == "Q":
                end = pattern.find("\\E", i + 2)
                end = len(pattern) if end < 0 else end
                cut()
                run = pattern[i + 2 : end]
                i = end + 2
                # the last character may be counted
                literal = run[-1:]
                run = run[:-1]
                if not literal:
                    continue
            elif e in ("p", "P") and pattern[i + 2 : i + 3] == "{":
                i = pattern.index("}", i) + 1
            elif e.isalnum() and e not in _SETS:
                if not e.isdigit() or e == "0":
                    raise _Unknown
                i += 2
            elif e.isalnum():
                i += 2
            elif e:
                literal, i = e, i + 2
            else:
                raise _Unknown
        elif c == "[":
            start, i = i + 1, _class_end(pattern, i)
            # a class of one character is that character
            only = _ONE.fullmatch(pattern, start, i - 1)
            literal = (only[1] or only[2]) if only else None
        elif c == "(":
            start, around = i + 1, None
            if pattern[i + 1 : i + 2] == "?":
                opened = _OPENING.match(pattern, i)
                if not opened or "x" in (opened[2] or "") or "c" in (opened[2] or ""):
                    raise _Unknown
                around, start = opened[1], opened.end()
                if opened[4] == ")":
                    cut()
                    i = start
                    continue
            elif pattern[i + 1 : i + 2] == "*":
                raise _Unknown
            found, i = _branches(pattern, start, True)
            group = [] if around or len(found) > 1 else found[0]
        elif c in ".^$":
            i += 1
        elif c in "*+?{}]":
            raise _Unknown
        else:
            literal, i = c, i + 1
        counted, optional, i = _quantifier(pattern, i)
        if literal is None:
            cut()
            if group and not optional:
                runs += group
        elif not literal.isascii():
            cut()
        elif optional:
            cut()
        else:
            run += literal
            if counted:
                cut()
    if inside:
        raise _Unknown
    cut()
    return [*branches, runs], i


def anchors(pattern: str | None, least: int) -> list[str]:
    """For each alternative of a Java pattern its longest required text, lower-cased in ASCII.

    A line that the pattern matches holds at least one of them, whatever its case. Empty where an alternative
    has no text of ``least`` characters, or where the pattern has something that is not followed here.
    """
    try:
        branches, _ = _branches(pattern or "", 0, False)
    except (_Unknown, ValueError, RecursionError):
        return []
    best = [max(runs, key=len, default="").lower() for runs in branches]
    return list(dict.fromkeys(best)) if all(len(b) >= least for b in best) else []
