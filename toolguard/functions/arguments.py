"""Free-form call arguments: canonical JSON, rule text, truth and log form.

``arguments`` is a JSON object as text.  It is parsed twice: as variants, which
know each value's type, and as strings, which keep numbers as written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolguard.functions.constants import constant, constant_map

TOKEN = r'"(?:[^"\\]|\\.)*+"|[\[\]{},:]|[^"\[\]{},:\s]++'
FALSY = ('""', "0", "0.0", "-0.0", "false", "null", "[]", "{}")
LOG_LIMIT, LOG_KEPT, LOG_MARK = 50, 20, "...[truncated]"


def parsed(arguments: Column) -> Column:
    """Struct of both parses, and whether there was no object to parse; absent arguments are an empty object."""
    text = F.coalesce(arguments, F.lit("{}"))
    typed, plain = F.from_json(text, "map<string,variant>"), F.from_json(text, "map<string,string>")
    return F.struct(
        F.coalesce(typed, F.from_json(F.lit("{}"), "map<string,variant>")).alias("typed"),
        F.coalesce(plain, F.create_map().cast("map<string,string>")).alias("plain"),
        (typed.isNull() | plain.isNull()).alias("unreadable"),
    )


def _is(value: Column, *kinds: str) -> Column:
    kind = F.schema_of_variant(value)
    return F.regexp_extract(kind, r"^[A-Z]+", 0).isin(*kinds)


def python_number(text: Column) -> Column:
    """A JVM number text as Python prints it: ``1.0E10`` is ``10000000000.0``."""
    sign = F.regexp_extract(text, "^-?", 0)
    exponent = F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"\.0$|\.", "")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"\.0$", "")
    whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
    rest = F.substring(digits, exponent + 2, F.length(digits))
    plain = F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    small = F.concat(F.lit("0.000"), digits)
    return (
        F.when(exponent.isNull(), text)
        .when((exponent >= 0) & (exponent < 16), F.concat(sign, plain))
        .when(exponent == -4, F.concat(sign, small))
        .otherwise(F.concat(sign, scientific))
    )


def ascii_escaped(text: Column) -> Column:
    """JSON text with every character outside printable ASCII as ``\\uXXXX``."""

    def hex4(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        return (
            F.when(code < 0x7F, ch)
            .when(code > 0xFFFF, F.concat(hex4(high), hex4(low)))
            .otherwise(hex4(code))
        )

    return F.when(
        text.rlike(r"[^ -~]"), F.array_join(F.transform(F.split(text, ""), escape), "")
    ).otherwise(text)


def json_string(text: Column) -> Column:
    """The text as a JSON string literal in printable ASCII."""
    short = constant_map(
        {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    )

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        control = F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))
        return F.coalesce(F.try_element_at(short, ch), F.when(code < 0x20, control).otherwise(ascii_escaped(ch)))

    plain = ~text.rlike(r'[^ -~]|["\\\\]')
    body = F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), escape), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def spaced_json(compact: Column) -> Column:
    """Compact JSON with ``, `` and ``: `` between tokens, and ASCII escapes."""
    tokens = F.regexp_extract_all(compact, F.lit(TOKEN), F.lit(0))
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(ascii_escaped(t)),
        ),
        "",
    )


def _json_value(value: Column, plain: Column) -> Column:
    return (
        F.when(_is(value, "STRING"), json_string(plain))
        .when(_is(value, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), python_number(plain))
        # An array without objects has no keys to sort: its numbers stay as written.
        .when(_is(value, "ARRAY") & ~F.contains(plain, F.lit("{")), spaced_json(plain))
        .when(_is(value, "OBJECT", "ARRAY"), spaced_json(F.to_json(value)))
        .otherwise(F.to_json(value))
    )


def entries(args: Column) -> Column:
    """The arguments sorted by name: JSON of the name, of the value, and of a long string's start."""
    typed, plain = args["typed"], args["plain"]

    def entry(k: Column) -> Column:
        cut = F.concat(F.substring(plain[k], 1, LOG_KEPT), F.lit(LOG_MARK))
        is_long = (F.length(plain[k]) > LOG_LIMIT) & _is(typed[k], "STRING")
        return F.struct(
            json_string(k).alias("name"),
            _json_value(typed[k], plain[k]).alias("value"),
            F.when(is_long, json_string(cut)).alias("cut"),
        )

    return F.transform(F.array_sort(F.map_keys(typed)), entry)


def _json_object(pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def canonical(arg_entries: Column) -> Column:
    """The object as JSON with sorted keys, spaced separators and ASCII escapes."""
    return _json_object(F.transform(arg_entries, lambda e: F.concat(e["name"], F.lit(": "), e["value"])))


def log_form(arg_entries: Column) -> Column:
    """The same, but of long strings only their first characters."""
    return _json_object(
        F.transform(arg_entries, lambda e: F.concat(e["name"], F.lit(": "), F.coalesce(e["cut"], e["value"])))
    )


def call_id(tool_name: Column, canonical_arguments: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``name:canonical arguments``."""
    return F.substring(F.sha2(F.concat(tool_name, F.lit(":"), canonical_arguments), 256), 1, 16)


def rule_texts(args: Column, names: list[str]) -> Column:
    """Map from argument name to the text a rule sees for it."""
    wanted = constant(names)
    return F.map_from_entries(F.transform(wanted, lambda n: F.struct(n, rule_text(args, n))))


def rule_text(args: Column, name: Column) -> Column:
    """The lowercased text a rule sees for an argument; '' where it is missing."""
    value, plain = args["typed"][name], args["plain"][name]
    text = (
        F.when(_is(value, "STRING"), plain)
        .when(_is(value, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), python_number(plain))
        .when(_is(value, "OBJECT", "ARRAY"), printed(plain))
        .when(_is(value, "VOID"), "none")
        .otherwise(plain)
    )
    return F.lower(F.when(F.map_contains_key(args["plain"], name), text).otherwise(""))


def printed(compact: Column) -> Column:
    """Nested JSON as Python prints it: keys in their order, quotes by what a string holds, None for null."""
    tokens = F.regexp_extract_all(compact, F.lit(TOKEN), F.lit(0))

    def string(token: Column) -> Column:
        inner = F.substring(token, F.lit(2), F.length(token) - 2)
        text = F.when(F.contains(inner, F.lit("\\")), F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]).otherwise(inner)
        double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
        for char, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(char), F.lit(shown))
        quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(quoted)

    words = constant_map({"null": "None", "true": "True", "false": "False"})
    shown = F.transform(
        tokens,
        lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).when(t.startswith('"'), string(t)).otherwise(F.coalesce(F.try_element_at(words, t), t)),
    )
    return F.array_join(shown, "")


def truthy(args: Column, name: str) -> Column:
    """True where the argument is present and neither empty, zero, false nor null."""
    value = F.to_json(args["typed"][name])
    return F.map_contains_key(args["plain"], name) & ~F.coalesce(value, F.lit("null")).isin(*FALSY)
