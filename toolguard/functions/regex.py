"""Python ``re`` patterns on Spark: same matches, Java syntax.

The rule lists are written for Python's ``re``.  Java reads most of that syntax
alike, but ``\\w``, ``\\s``, ``\\d`` and ``\\b`` are ASCII there, ``.`` and ``$``
know more line ends, and ``{`` and ``[`` are stricter.  ``java`` rewrites just
those, so a rule matches the same text on the JVM, inside codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolguard.functions.constants import constant, let

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x1f \x85\p{Z}"
_SETS = {"w": WORD, "s": SPACE, "d": r"\p{Nd}"}
_ASCII_SETS = {"w": "a-zA-Z0-9_", "s": r"\t-\r ", "d": "0-9"}
_COUNT = re.compile(r"\{(\d*)(?:(,)(\d*))?\}")
_GLOBAL_FLAGS = re.compile(r"\(\?([a-zA-Z]+)\)")
_SCOPED_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?:")
_NAMED = re.compile(r"\(\?P(?:<(\w+)>|=(\w+)\))")
# Letters that mean something else to Java, or nothing.
_CONTROL = {"v": r"\x0b", "a": r"\x07"}


class Untranslatable(ValueError):
    """A pattern that Python reads but that has no equal here."""


def _edge(word: str) -> str:
    return f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"


def java(pattern: str, ignore_case: bool = False, dotall: bool = False) -> str:
    """Java form of a Python ``str`` pattern; ``Untranslatable`` if there is none.

    Inline flags for case, dots, lines and ASCII are followed group by group.
    """
    names = re.compile(pattern).groupindex
    active = {*("i" if ignore_case else ""), *("s" if dotall else "")}
    out, i, in_class, closing = [], 0, False, []
    while found := _GLOBAL_FLAGS.match(pattern, i):  # only at the start
        active |= _known(found[1], pattern)
        i = found.end()
    start_case = "i" in active
    while i < len(pattern):
        c = pattern[i]
        sets = _ASCII_SETS if "a" in active else _SETS
        if c == "\\" and i + 1 < len(pattern):
            text, i = _escape(pattern, i, in_class, sets)
            out.append(text)
            continue
        if in_class:
            if c == "]" and out[-1] not in ("[", "[^"):
                in_class = False
                out.append(c)
            else:
                out.append("\\" + c if c in "[]&" else c)
        elif c == "[":
            in_class = True
            negated = pattern[i + 1 : i + 2] == "^"
            out.append("[^" if negated else "[")
            i += negated
        elif c == "(":
            closing.append(active)
            text, i, active = _group(pattern, i, active, names)
            out.append(text)
            if text == "":
                closing.pop()
            continue
        elif c == ")":
            active = closing.pop() if closing else active
            out.append(c)
        elif c == ".":
            out.append(r"[\s\S]" if "s" in active else r"[^\n]")
        elif c == "^":
            out.append(r"(?<![^\n])" if "m" in active else r"\A")
        elif c == "$":
            out.append(r"(?![^\n])" if "m" in active else r"(?=\n?\z)")
        elif c == "{":
            count = _COUNT.match(pattern, i)
            if count and (count.group(1) or count.group(3)):
                low, comma, high = count.group(1) or "0", count.group(2) or "", count.group(3) or ""
                out.append("{" + low + comma + high + "}")
                i = count.end() - 1
            else:
                out.append(r"\{")
        else:
            out.append(c)
        i += 1
    return ("(?iu)" if start_case else "") + "".join(out)


def _known(flags: str | None, pattern: str) -> set[str]:
    found = set(flags or "") - {"u"}
    if found - set("imsa"):
        raise Untranslatable(f"flags {flags!r} in pattern {pattern!r}")
    return found


def _group(pattern: str, i: int, active: set[str], names: dict) -> tuple[str, int, set[str]]:
    """What opens a group, where its body starts, and the flags inside it."""
    if pattern.startswith("(?#", i):
        return "", pattern.index(")", i) + 1, active
    if pattern.startswith("(?(", i):
        raise Untranslatable(f"a condition in pattern {pattern!r}")
    if named := _NAMED.match(pattern, i):
        if named[1]:
            return "(", named.end(), active
        return f"(?:\\{names[named[2]]}", named.end() - 1, active  # its own bracket closes the group
    flags = _SCOPED_FLAGS.match(pattern, i)
    if flags and (flags[1] or flags[2]):
        off = _known(flags[2], pattern)
        inner = (active | _known(flags[1], pattern)) - off
        case = "(?iu:" if "i" in inner and "i" not in active else "(?-iu:" if "i" in active and "i" not in inner else "(?:"
        return case, flags.end(), inner
    end = i + 1
    while end < len(pattern) and pattern[i + 1 : i + 2] == "?" and pattern[end] in "?:=!<>":
        end += 1
    return pattern[i:end], end, active


def _escape(pattern: str, i: int, in_class: bool, sets: dict) -> tuple[str, int]:
    """Java form of the escape at ``i``, and where the pattern goes on."""
    kind, end = pattern[i + 1], i + 2
    word = sets["w"]
    if kind in sets:
        return (sets[kind] if in_class else f"[{sets[kind]}]"), end
    if kind in ("W", "S", "D"):
        return f"[^{sets[kind.lower()]}]", end
    if kind == "b" and in_class:
        return r"\x08", end
    if kind == "b":
        following = pattern[end : end + 1]
        # Before a literal word character an edge is simply "no word behind".
        return (f"(?<![{word}])" if following.isalnum() else _edge(word)), end
    if kind == "B":
        return f"(?!{_edge(word)})", end
    if kind in ("Z", "z"):
        return r"\z", end
    if kind == "N":
        raise Untranslatable(f"a named character in pattern {pattern!r}")
    if kind == "0" or (kind.isdigit() and in_class):
        while end < min(len(pattern), i + 4) and pattern[end] in "01234567":
            end += 1
        return f"\\x{{{int(pattern[i + 1 : end], 8):x}}}", end
    if kind == "U":
        return f"\\x{{{int(pattern[end : end + 8], 16):x}}}", end + 8
    if kind.isdigit():  # a group, or an octal number of three digits
        while end < min(len(pattern), i + 4) and pattern[end].isdigit():
            end += 1
        digits = pattern[i + 1 : end]
        if len(digits) == 3:
            return f"\\x{{{int(digits, 8):x}}}", end
        return f"(?:\\{digits})", end
    return _CONTROL.get(kind, "\\" + kind), end


def hint(pattern: str) -> str:
    """The longest literal that every match of the pattern contains ('' if there is none)."""
    runs, depth, i = [""], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|" and depth == 0:
            return ""
        width = 2 if c == "\\" else pattern.find("]", i + 2) + 1 - i if c == "[" else 1
        literal = pattern[i + 1] if width == 2 and not pattern[i + 1].isalnum() else c
        depth += (width == 1) * ((c == "(") - (c == ")"))
        plain = (width == 1 and c not in "()[].^$|?*+{") or (c == "\\" and literal != c)
        optional = pattern[i + width : i + width + 1] in ("?", "*", "{")
        if plain and depth == 0 and not optional:
            runs[-1] += literal
        elif runs[-1]:
            runs.append("")
        i += width
    return max(runs, key=len)


def any_of(text: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """True where any pattern is found.

    Looking for the literal that a pattern is built on is many times cheaper
    than running it, and most texts hold none of them: so a pattern runs only
    on texts that hold its literal, and the first that is found ends the search.
    """
    table = constant(searches(patterns, ignore_case))

    def search(literal: Column) -> Column:
        return F.exists(table, lambda r: occurs(r, text, literal))

    return let(folded(text), search) if ignore_case else search(text)


def searches(patterns: list[str], ignore_case: bool = False) -> list[dict]:
    """The patterns for Spark, each with the literal to look for first."""
    return [{"hint": hint(p), "pattern": java(p, ignore_case)} for p in patterns]


def occurs(search: Column, text: Column, literal_text: Column) -> Column:
    """True where a search's literal, then its pattern, is found."""
    return F.contains(literal_text, search["hint"]) & F.rlike(text, search["pattern"])


def contains_any(text: Column, words: list[str]) -> Column:
    """True where any word is a substring; stops at the first that is."""
    return F.exists(constant(words), lambda w: F.contains(text, w))


def folded(text: Column) -> Column:
    """Lowercase text for literals; two letters have variants that lowercasing keeps apart."""
    return F.replace(F.replace(F.lower(text), F.lit("\u017f"), F.lit("s")), F.lit("\u0131"), F.lit("i"))


def first_rule(rules: list[dict], text: Column, folded_text: Column | None = None) -> Column:
    """The first of the rules whose ``pattern`` occurs in the text, as a struct.

    The rules are one constant array, so a long list stays a small expression:
    generated code with a branch per rule outgrows what the JVM will compile.
    A pattern is tried where its rule's ``hint`` occurs, so rarely any is.
    """
    literal = text if folded_text is None else folded_text
    return F.get(F.filter(constant(rules), lambda r: occurs(r, text, literal)), F.lit(0))


def found(text: Column, pattern: Column, index: int) -> Column:
    """``regexp_extract`` with a pattern that comes from a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(index))


def whole_word(words: list[str]) -> str:
    """Java pattern for any of the words, not inside a longer word.

    The look at the first letter comes first: it is what most positions fail on.
    """
    first = "".join(sorted({re.escape(w[0]) for w in words}))
    return f"(?=[{first}])(?<![{WORD}])(?:{'|'.join(re.escape(w) for w in words)})(?![{WORD}])"


def group(text: Column, pattern: str, index: int, ignore_case: bool = False) -> Column:
    """A capture group of the first match ('' where there is none)."""
    return F.regexp_extract(text, java(pattern, ignore_case), index)


def strip(text: Column) -> Column:
    """``str.strip()``: all Unicode white space, at both ends."""
    start, end = f"^[{SPACE}]+", f"(?<![{SPACE}])[{SPACE}]++\\z"
    return F.regexp_replace(F.regexp_replace(text, start, ""), end, "")
