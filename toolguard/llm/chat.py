"""Chat conversations as training texts with a loss mask, checked by a grammar round trip; DataFrame functions only.

A turn is a marker of its role, its text, and an end marker. A deterministic parser reads
the turns back: at each turn the text goes up to the first end marker of its role. A text
that does not come back identical, or that holds a control string, is escaped; then
none of its characters can begin one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolguard.scale import materialize

# Fixed values of the template: role, what opens a turn, what closes it.
TURNS = [
    ("user", "[INST] ", " [/INST]"),
    ("assistant", " ", "</s>"),
    ("system", "<<SYS>> ", " <</SYS>>"),
]
#: Any other role: its name in base64 and a blank follow the opening.
OTHER = ("[ROLE] ", " [/ROLE]")
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
#: In an escaped text each of these characters is two others, and a backslash always begins such a pair.
ESCAPES = [("\\", "\\-"), ("<", "\\+"), ("[", "\\*")]
TRAINED = "assistant"
PATTERN = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>> .*? <</SYS>>|\[ROLE\] .*? \[/ROLE\]| .*?</s>"


def escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def opening(role: Column) -> Column:
    other = F.concat(F.lit(OTHER[0]), F.regexp_replace(F.base64(role.cast("binary")), r"\s", ""), F.lit(" "))
    return reduce(lambda rest, t: F.when(role == t[0], F.lit(t[1])).otherwise(rest), TURNS, other)


def closing(role: Column) -> Column:
    return reduce(lambda rest, t: F.when(role == t[0], F.lit(t[2])).otherwise(rest), TURNS, F.lit(OTHER[1]))


def parse_turn(turn: Column) -> Column:
    """(role, text) of one rendered turn, unescaped."""

    def inside(start: Column, end: int) -> Column:
        return unescape(F.substring(turn, start, F.length(turn) - start + 1 - end))

    name_end = F.locate(" ", turn, len(OTHER[0]) + 1)
    name = F.substring(turn, F.lit(len(OTHER[0]) + 1), name_end - len(OTHER[0]) - 1)
    other = F.struct(F.unbase64(name).cast("string").alias("role"), inside(name_end + 1, len(OTHER[1])).alias("text"))
    cases = other
    for role, start, end in TURNS:
        made = F.struct(F.lit(role).alias("role"), inside(F.lit(len(start) + 1), len(end)).alias("text"))
        cases = F.when(F.startswith(turn, F.lit(start)), made).otherwise(cases)
    return cases


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(PATTERN), F.lit(0)), parse_turn)


def digest(turns: Column) -> Column:
    """Lower-case hex SHA-256 of role, line feed, text, line feed of each turn."""
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def render(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with their texts as they go into the format: raw, or escaped if that is needed."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    back = turns.withColumn("back", parse(F.concat(opening(F.col("role")), F.col("text"), closing(F.col("role")))))
    same = (F.size("back") == 1) & (F.col("back")[0]["role"] == F.col("role")) & (F.col("back")[0]["text"] == F.col("text"))
    clear = reduce(lambda a, c: a & ~F.contains("text", F.lit(c)), CONTROL, F.lit(True))
    return back.select(
        "conv_id", "turn", "role", "text", F.when(F.coalesce(same, F.lit(False)) & clear, F.col("text")).otherwise(escape(F.col("text"))).alias("body")
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask, source_sha256): one row a conversation.

    ``formatted`` is UTF-8, ``loss_mask`` an array of (start, length) in its bytes, which cover
    the assistant's texts as they stand there. Rows go by turn (NULL first), ties by role and text;
    NULL roles and texts are empty. Rows without conv_id are one conversation; repeated
    rows are turns of their own; an empty table gives no rows.
    """
    turns = render(conversations)
    start, end = opening(F.col("role")), closing(F.col("role"))
    sized = turns.select(
        "conv_id", "turn", "role", "text", F.concat(start, F.col("body"), end).alias("rendered"),
        F.octet_length(start).alias("before"), F.octet_length("body").alias("inside"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("at", F.coalesce(F.sum(F.octet_length("rendered").cast("long")).over(order), F.lit(0)))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "rendered", "before", "inside"))).alias("turns"))
    mask = F.transform(
        F.filter("turns", lambda t: t["role"] == TRAINED),
        lambda t: F.struct((t["at"] + t["before"]).alias("start"), t["inside"].cast("long").alias("length")),
    )
    return grouped.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").cast("binary").alias("formatted"),
        mask.alias("loss_mask"), digest(F.col("turns")).alias("source_sha256"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, n_turns, turns_sha256, loss_text, formatted_chars) from what ``format_chats`` returns.

    A conversation whose turns differ from the source ends the job with an error.
    """
    text = F.col("formatted").cast("string")
    parsed = formatted.select("conv_id", "formatted", "loss_mask", "source_sha256", parse(text).alias("turns"), F.length(text).cast("long").alias("formatted_chars"))
    # Bytes are cut out at their place, so long conversations cost no more than their length.
    pieces = F.transform(
        "loss_mask", lambda m: unescape(F.decode(F.substring(F.col("formatted"), m["start"].cast("int") + 1, m["length"].cast("int")), "UTF-8"))
    )
    read = parsed.select(
        "conv_id", "turns", F.size("turns").cast("long").alias("n_turns"), digest(F.col("turns")).alias("turns_sha256"),
        F.array_join(pieces, "").alias("loss_text"), "formatted_chars", "source_sha256",
    )
    lost = F.raise_error(F.concat(F.lit("turns differ from their source in conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("NULL"))))
    same = F.when(F.col("turns_sha256") == F.col("source_sha256"), F.col("turns_sha256")).otherwise(lost.cast("string"))
    return read.withColumn("turns_sha256", same).drop("source_sha256")


def round_trip(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the written format."""
    read = read_back(materialize(format_chats(conversations)))
    return read.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
