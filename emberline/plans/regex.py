"""Translation of rule regexes (linear-time syntax, Unicode by default) to Java's."""

from __future__ import annotations

import re
from functools import lru_cache

from .catalog import RuleError

#: Escapes of signs that mean themselves in every dialect.
_PLAIN_ESCAPE = re.compile(r"\\[!-/:-@\[-`{-~]")
#: Signs whose meaning differs between dialects: what is left of escapes, flags, names, classes in classes.
_UNLIKE = re.compile(r"\\|\(\?|\[:|&&|--|~~|\|\||[*+?}][+]|\[[^\]]*\[|[^\x20-\x7e]")


@lru_cache(maxsize=4096)
def plain_pattern(pattern: str) -> re.Pattern | None:
    """``pattern`` for Python's own matcher, if it is of the part of the language that means the same there; else None."""
    if _UNLIKE.search(_PLAIN_ESCAPE.sub("", pattern)):
        return None
    try:
        return re.compile(translate(pattern).removeprefix("(?dU)").replace("\\z", "\\Z"))
    except re.error:
        return None


def translate(pattern: str) -> str:
    """The Java pattern with the same matches, for an unanchored search.

    Look-around and back-references have no meaning in the rule language and are errors. Without
    ``(?m)`` a ``$`` is the end of the text only; ``.`` stops at ``\\n`` alone; classes are Unicode.
    """

    def fail(reason: str) -> RuleError:
        return RuleError("InvalidRegex", f"Invalid regex '{pattern}': {reason}")

    if re.search(r"\(\?(=|!|<=|<!)", pattern):
        raise fail("look-around is not supported")
    out: list[str] = []
    i, in_class, multiline = 0, 0, bool(re.match(r"\(\?[a-z]*m", pattern))
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                raise fail("incomplete escape")
            nxt = pattern[i + 1]
            if nxt.isdigit() and nxt != "0" and not in_class or nxt == "k":
                raise fail("back-references are not supported")
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            if in_class and not pattern.startswith("[:", i):
                raise fail("nested classes are not supported")
            if pattern.startswith("[:", i) and in_class:
                end = pattern.find(":]", i)
                name = pattern[i + 2 : end]
                posix = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f", "word": "A-Za-z0-9_"}
                if end < 0 or name not in posix:
                    raise fail("unknown class")
                out.append(posix[name])
                i = end + 2
                continue
            in_class += 1
        elif c == "]" and in_class and out[-1] not in ("[", "[^"):
            in_class -= 1
        elif in_class and pattern.startswith(("--", "~~", "&&"), i):
            raise fail("class operators are not supported")
        elif c == "$" and not in_class:
            out.append("$" if multiline else "\\z")
            i += 1
            continue
        elif pattern.startswith("(?P<", i) and not in_class:
            out.append("(?<")
            i += 4
            continue
        if c == "^" and in_class and out and out[-1] == "[":
            out[-1] = "[^"
        else:
            out.append(c)
        i += 1
    if in_class:
        raise fail("unclosed class")
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", "".join(out)).replace("\\z", "$").replace("\\p", "p"))
    except re.error as e:
        if "flag" not in str(e):
            raise fail(str(e)) from e
    return "(?dU)" + "".join(out)


def required_piece(pattern: str) -> str:
    """The longest text that every match of ``pattern`` contains, as far as it can be told without its groups and classes; "" if none.

    Patterns with alternatives or flags have none, as they may match without any one text.
    """
    if "|" in pattern or "(?" in pattern:
        return ""
    best, run, i = "", "", 0
    while i < len(pattern):
        c, piece, width = pattern[i], "", 1
        if c == "\\" and i + 1 < len(pattern):
            width = 2
            if not pattern[i + 1].isalnum():
                piece = pattern[i + 1]
            elif pattern[i + 1] in "xuUpP":  # the digits or the name that follow are no text of their own
                return best if len(best) >= len(run) else run
        elif c in "[(":
            close, depth, j = {"[": "]", "(": ")"}[c], 0, i
            while j < len(pattern):
                if pattern[j] == "\\":
                    j += 1
                elif pattern[j] == c:
                    depth += 1
                elif pattern[j] == close and not (c == "[" and pattern[i:j] in ("[", "[^")):
                    depth -= 1
                    if not depth:
                        break
                elif c == "(" and pattern[j] == "[":  # a class in a group may hold brackets of any kind
                    return best if len(best) >= len(run) else run
                j += 1
            width = j + 1 - i
        elif c not in ".^$*+?{}":
            piece = c
        after = pattern[i + width : i + width + 1]
        if after and after in "*?{":
            piece = ""
        run, best = (run + piece, best) if piece else ("", max(best, run, key=len))
        if after and after in "*+?{":
            best, run = max(best, run, key=len), ""
            i += width
            if after == "{":
                end = pattern.find("}", i)
                width = (end if end >= 0 else len(pattern)) + 1 - i
            else:
                width = 1
            if pattern[i + width : i + width + 1] in ("?", "+"):
                width += 1
        i += width
    return max(best, run, key=len)
