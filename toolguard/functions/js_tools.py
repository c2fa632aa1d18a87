"""Tools of one JS/TS file, by patterns and balanced brackets."""

from __future__ import annotations

import bisect
import re

from toolguard import rules

_CALL = re.compile(rules.JS_CALL)
_CALL_NAME = re.compile(rules.JS_CALL_NAME)
_CALL_DESCRIPTION = re.compile(rules.JS_CALL_DESCRIPTION)
_NAME = re.compile(rules.JS_NAME)
_DESCRIPTION = re.compile(rules.JS_DESCRIPTION)
_OBJECT = re.compile(rules.JS_OBJECT, re.DOTALL)
_BRACKET = re.compile(r"[(){}]")


class Brackets:
    """Where the brackets of a file close; both kinds share one depth, and strings are not special."""

    def __init__(self, content: str):
        self.content = content
        self.starts: list[int] = []
        self.closes: dict[int, int] = {}
        open_ones: list[int] = []
        for bracket in _BRACKET.finditer(content):
            at = bracket.start()
            if bracket[0] in "({":
                self.starts.append(at)
                open_ones.append(at)
            elif open_ones:
                self.closes[open_ones.pop()] = at + 1

    def balanced(self, start: int) -> str:
        """Text from ``start`` to where its first bracket closes, or to the end of the file."""
        at = bisect.bisect_left(self.starts, start)
        end = self.closes.get(self.starts[at]) if at < len(self.starts) else None
        return self.content[start:end]


def tools_in(content: str) -> list[tuple[str, str, str | None]]:
    """``(name, description, snippet)``; the first of each name in the file counts."""
    if not any(mark in content for mark in rules.JS_MARKS):
        return []
    found = {}
    brackets = Brackets(content)
    for name, description, snippet in (*_calls(brackets), *_objects(brackets)):
        found.setdefault(name, (name, description.strip(), snippet))
    return list(found.values())


def _calls(brackets: Brackets):
    """Registration calls, with a name in first place or in an options object."""
    for call in _CALL.finditer(brackets.content):
        snippet = brackets.balanced(call.start())
        placed = _CALL_NAME.match(snippet)
        name = placed or _NAME.search(snippet)
        if not name:
            continue
        described = (placed and _CALL_DESCRIPTION.match(snippet)) or _DESCRIPTION.search(snippet)
        yield name[1], described[1] if described else rules.NO_DESCRIPTION, snippet


def _objects(brackets: Brackets):
    """Object literals that hold both a name and a description."""
    for block in _OBJECT.finditer(brackets.content):
        name, description = _NAME.search(block[0]), _DESCRIPTION.search(block[0])
        if name and description and name[1] not in rules.JS_TYPE_WORDS:
            yield name[1], description[1], brackets.balanced(block.start())
