"""The one Python step: Arrow batches of file contents to Arrow batches of tools."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from toolguard.functions import js_tools, python_tools

TOOLS = pa.list_(
    pa.struct([("seq", pa.int64()), ("name", pa.string()), ("description", pa.string()), ("code_snippet", pa.string())])
)
# Bytes of tools that a task remembers, and bytes of contents that it parses before it passes their tools on.
REMEMBERED = 16 << 20
PARSED = 4 << 20


def _encodable(text: str | None) -> str | None:
    """Text without lone surrogates, which no column can hold."""
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


def tools_of(language: str, content: str) -> list[dict]:
    parse = js_tools.tools_in if language == "JS/TS" else python_tools.tools_in
    return [
        {"seq": seq, "name": _encodable(name), "description": _encodable(description), "code_snippet": _encodable(snippet)}
        for seq, (name, description, snippet) in enumerate(parse(content))
    ]


def sliced(batches: Iterator[pa.RecordBatch], limit: int = PARSED) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``limit`` bytes of contents, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("content"))), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def size_of(tools: list[dict]) -> int:
    """Bytes of memory that tools take, about."""
    return 200 + sum(400 + sum(sys.getsizeof(text) for text in (t["name"], t["description"], t["code_snippet"])) for t in tools)


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column, ``content``, becomes the array ``tools``; the others stay.

    Copies within a task are parsed once, as far as their tools are remembered; a row without content
    has no tools. Tools are passed on for a few contents at a time, so that a task holds little.
    """
    known: dict[tuple, list[dict]] = {}
    held = 0
    for batch in sliced(batches):
        found = []
        languages, contents = (batch.column(batch.schema.get_field_index(n)) for n in ("language", "content"))
        for language, content in zip(languages, contents, strict=True):
            text = content.as_py()
            if text is None:
                found.append(None)
                continue
            key = language.as_py(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
            tools = known.get(key)
            if tools is None:
                tools = tools_of(key[0], text)
                held += size_of(tools)
                if held > REMEMBERED:
                    known, held = {}, size_of(tools)
                known[key] = tools
            found.append(tools)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, TOOLS)], [*batch.schema.names[:-1], "tools"])
