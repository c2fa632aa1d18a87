"""Tools of one Python file, by the standard parser; plain helpers for one task.

``tools_in`` yields ``(name, description, snippet)`` in source-walk order; a file
that does not parse is read by patterns instead.
"""

from __future__ import annotations

import ast
import re
import warnings

from toolguard import rules

_CLASS = re.compile(rules.ENUM_CLASS)
_MEMBER = re.compile(rules.ENUM_MEMBER)
_DECORATED = re.compile(rules.DECORATED_FUNCTION, re.DOTALL)
_NAME = re.compile(rules.NAME_ARGUMENT)
_DESCRIPTION = re.compile(rules.DESCRIPTION_ARGUMENT, re.DOTALL)
_BLOCK = re.compile(rules.TOOL_BLOCK, re.DOTALL)
_BLOCK_NAME = re.compile(rules.BLOCK_NAME)
_BLOCK_LONG = re.compile(rules.BLOCK_DESCRIPTION_LONG, re.DOTALL)
_BLOCK_SHORT = re.compile(rules.BLOCK_DESCRIPTION_SHORT)
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")


def tools_in(content: str) -> list[tuple[str, str, str | None]]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except Exception:  # any failure to parse selects the patterns
        return _by_patterns(content)
    return _by_tree(tree, content)


def enum_values(content: str) -> dict[str, str]:
    """``Class.MEMBER`` to its string value, for every class with string members."""
    return {
        f"{block[1]}.{member[1]}": member[2]
        for block in _CLASS.finditer(content)
        for member in _MEMBER.finditer(block[2])
    }


# --------------------------------------------------------------- parsed files
class _Source:
    """Text of nodes; lines are split once per file, not once per node."""

    def __init__(self, content: str):
        self._content, self._lines = content, None

    def text(self, node: ast.AST) -> str:
        if getattr(node, "end_lineno", None) is None:
            return ""
        if self._lines is None:
            self._lines = [m[0].encode() for m in _LINE.finditer(self._content)]
        first, last = node.lineno - 1, node.end_lineno - 1
        span = list(self._lines[first : last + 1])
        span[-1] = span[-1][: node.end_col_offset]
        span[0] = span[0][node.col_offset :]
        return b"".join(span).decode(errors="ignore")


def _by_tree(tree: ast.Module, content: str) -> list[tuple[str, str, str | None]]:
    source, enums, found = _Source(content), None, []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            described = _decorated(node)
        elif isinstance(node, ast.Call) and _called_name(node) == "Tool":
            enums = enum_values(content) if enums is None else enums
            described = _constructed(node, enums)
        else:
            continue
        if described:
            name, description = described
            found.append((name, description.strip(), source.text(node)))
    return found


def _called_name(call: ast.Call) -> str:
    return getattr(call.func, "id", None) or getattr(call.func, "attr", "")


def _constant(node: ast.AST) -> str | None:
    return str(node.value) if isinstance(node, ast.Constant) else None


def _marks_tool(target: ast.AST) -> bool:
    if isinstance(target, ast.Name):
        return target.id == "tool"
    if not isinstance(target, ast.Attribute):
        return False
    routed = getattr(target.value, "id", "") in ("app", "router") and target.attr in rules.HTTP_VERBS
    return target.attr == "tool" or routed


def _decorated(function) -> tuple[str, str] | None:
    """Name and description of a decorated tool; keyword arguments come first."""
    marked, given = False, {}
    for decorator in function.decorator_list:
        is_call = isinstance(decorator, ast.Call)
        # Once one decorator marks the function, arguments of later ones count too.
        marked = marked or _marks_tool(decorator.func if is_call else decorator)
        if marked and is_call:
            values = {k.arg: _constant(k.value) for k in decorator.keywords}
            given.update({k: v for k, v in values.items() if v is not None})
    if not marked:
        return None
    description = given.get("description") or ast.get_docstring(function) or rules.NO_DESCRIPTION
    return given.get("name") or function.name, description


def _constructed(call: ast.Call, enums: dict[str, str]) -> tuple[str, str] | None:
    """Name and description of an explicit constructor, from positions or keywords."""
    name, description = [*(_constant(a) for a in call.args[:2]), None, None][:2]
    for keyword in call.keywords:
        value = _constant(keyword.value)
        if keyword.arg == "description" and value is not None:
            description = value
        elif keyword.arg == "name" and value is not None:
            name = value
        elif keyword.arg == "name" and isinstance(keyword.value, ast.Attribute):
            name = enums.get(f"{getattr(keyword.value.value, 'id', '')}.{keyword.value.attr}")
    if not name and not description:
        return None
    return name or rules.UNKNOWN_NAME, description or rules.NO_DESCRIPTION


# -------------------------------------------------------- files that do not parse
def _by_patterns(content: str) -> list[tuple[str, str, str | None]]:
    explicit = list(_blocks(content)) if rules.TOOL_MARK in content else []
    names = {name for name, _, _ in explicit}
    marked = any(m in content for m in rules.DECORATOR_MARKS)
    decorated = _functions(content) if marked else []
    return explicit + [t for t in decorated if t[0] not in names]


def _blocks(content: str):
    """Constructor blocks; these come without a snippet."""
    enums = enum_values(content)
    for block in _BLOCK.findall(content):
        written = _BLOCK_NAME.search(block)
        name = _written_name(written[1], enums) if written else None
        text = _BLOCK_LONG.search(block) or _BLOCK_SHORT.search(block)
        if name or text:
            yield name or rules.UNKNOWN_NAME, text[1].strip() if text else rules.NO_DESCRIPTION, None


def _written_name(written: str, enums: dict[str, str]) -> str | None:
    written = written.strip()
    quoted = re.match(rules.QUOTED, written)
    if quoted:
        return quoted[1]
    return enums.get(written) or enums.get(written.rsplit(".value", 1)[0])


def _functions(content: str):
    """Decorated functions, with their indented body as snippet."""
    for match in _DECORATED.finditer(content):
        above, found, _ = match[0].partition("def ")
        above = above if found else ""
        name, description = _NAME.search(above), _DESCRIPTION.search(above)
        given = next((g for g in description.groups() if g), None) if description else None
        text = given or match[2] or match[3] or rules.NO_DESCRIPTION
        start = content.find("def ", match.start())
        yield (name[1] if name else match[1]), text.strip(), _body(content, start) if start >= 0 else ""


def _body(content: str, start: int) -> str:
    """From ``start`` up to the next line that is neither blank nor indented."""
    lines = content[start:].split("\n")
    end = next((i for i, line in enumerate(lines[1:], 1) if line.strip() and line[0] not in " \t"), len(lines))
    return "\n".join(lines[:end])
