"""What a task holds while it parses files."""

import pyarrow as pa

from toolguard.functions import parsing


def batch(contents):
    languages = ["JS/TS" if i % 5 == 4 else "Python" for i in range(len(contents))]
    return pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(len(contents))]), pa.array(languages), pa.array(contents, pa.string())], ["file", "language", "content"])


def test_tools_of_a_large_batch_are_passed_on_in_parts():
    text = lambda i: f'@mcp.tool(name="t{i % 7}", description="{"é" * 50_000}")\ndef f{i % 7}(x):\n    return x\n'
    contents = [None if i % 11 == 3 else "" if i % 11 == 5 else text(i) for i in range(220)]
    one = batch(contents)
    parts = list(parsing.parse_batches(iter([one, one.slice(0, 0)])))
    sizes = [sum(len((contents[int(f[1:])] or "").encode()) for f in p.column(0).to_pylist()) for p in parts]
    assert len(parts) > 1 and max(sizes) <= parsing.PARSED
    rows = [row for p in parts for row in p.to_pylist()]
    languages = one.column(1).to_pylist()
    assert [r["file"] for r in rows] == one.column(0).to_pylist()
    assert [r["tools"] for r in rows] == [None if c is None else parsing.tools_of(g, c) for g, c in zip(languages, contents, strict=True)]


def test_a_content_larger_than_a_part_is_parsed_whole():
    text = f'@mcp.tool(name="t", description="{"x" * (parsing.PARSED + 1)}")\ndef f(x):\n    return x\n'
    (found,) = [row for p in parsing.parse_batches(iter([batch([text])])) for row in p.to_pylist()]
    assert len(found["tools"][0]["description"]) == parsing.PARSED + 1
