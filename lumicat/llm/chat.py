"""Chat formatting with DataFrame functions only.

A declarative template gives each role its opening, closing and loss flag; a finite-state machine over the roles checks
the order of turns.  Control strings inside texts are escaped, so that the formatted text can be read back exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> opening, closing, whether its text is learned.  Other roles get OTHER, with their name in it.
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s> ", " </s>", True),
}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
#: Control strings of the template; none holds a backslash.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")
#: state -> role -> next state; what isn't listed is an error.
MACHINE = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
#: States in which a conversation is complete.
ACCEPT = ("assistant",)


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string: none is left whole, and as
    other backslashes come in pairs, a single one marks an escaped control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROLS, text)


def unescape(text: Column) -> Column:
    text = reduce(lambda t, c: F.replace(t, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c)), CONTROLS, text)
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_chat(turns: DataFrame, template: dict = TEMPLATE, machine: dict = MACHINE, accept: tuple = ACCEPT) -> DataFrame:
    """(conv_id, n_turns, formatted, segments, valid, first_error) for each conversation.

    Rows are turns (conv_id, turn, role, text), in the order of turn, then role, then text (null turns first; repeated
    rows count each).  Null roles and texts count as empty.  ``segments`` are (text, loss) in order and concatenate to
    ``formatted``.  ``valid``: the machine accepts; ``first_error``: the index of the first turn it refuses, else null.
    Invalid conversations are formatted as well.  Other columns are ignored; an empty table gives an empty table.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    step = F.create_map(*[F.lit(x) for state, to in machine.items() for role, after in to.items() for x in (f"{state}>{role}", after)])

    def move(s: Column, t: Column) -> Column:
        after = F.when(s["bad"].isNull(), F.coalesce(F.element_at(step, F.concat(s["at"], F.lit(">"), t["role"])), F.lit("error"))).otherwise(F.lit("error"))
        return F.struct(after.alias("at"), F.coalesce(s["bad"], F.when(after == "error", s["i"])).alias("bad"), (s["i"] + 1).alias("i"))

    start = F.struct(F.lit("start").alias("at"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("i"))

    def pieces(t: Column) -> Column:
        """Opening, text and closing of a turn."""

        def three(opening: Column, closing: str, loss: bool) -> Column:
            parts = ((opening, False), (escape(t["text"]), loss), (F.lit(closing), False))
            return F.array(*[F.struct(p.alias("text"), F.lit(flag).alias("loss")) for p, flag in parts])

        out = three(F.concat(F.lit(OTHER[0]), escape(t["role"]), F.lit(OTHER[1])), OTHER[2], False)
        for role, (opening, closing, loss) in template.items():
            out = F.when(t["role"] == role, three(F.lit(opening), closing, loss)).otherwise(out)
        return out

    conv = conv.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.flatten(F.transform("t", pieces)).alias("segments"), F.aggregate("t", start, move).alias("end"))
    text = F.array_join(F.transform("segments", lambda x: x["text"]), "")
    return conv.select("conv_id", "n_turns", text.alias("formatted"), "segments", (F.col("end.bad").isNull() & F.col("end.at").isin(*accept)).alias("valid"), F.col("end.bad").alias("first_error"))


def learned(segments: Column) -> Column:
    """The original texts of the segments with a loss, one after another."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_chat(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Adds what parsing ``formatted`` finds: ``turns`` (role, text) and ``segments`` (text, loss), the flags from the template.

    Other columns stay (an earlier ``segments`` is replaced).  Text between turns, and a turn without its closing, is in neither;
    null text gives nulls, a text without turns empty arrays.
    """

    def quoted(s: str) -> str:
        return "\\Q" + s + "\\E"

    opening = "|".join(quoted(a) for a, _, _ in template.values())
    closing = "|".join(quoted(b) for _, b, _ in template.values())
    other = f"{quoted(OTHER[0])}.*?{quoted(OTHER[1])}"
    turn = f"(?s)({opening}|{other})(.*?)({closing}|{quoted(OTHER[2])})"
    parts = F.arrays_zip(*[F.regexp_extract_all("formatted", F.lit(turn), F.lit(g)).alias(n) for g, n in ((1, "head"), (2, "body"), (3, "tail"))])

    def known(head: Column, role: Column, values: dict[str, Column]) -> Column:
        for name, (start, _, _) in template.items():
            role = F.when(head == start, values[name]).otherwise(role)
        return role

    def role(head: Column) -> Column:
        named = unescape(F.regexp_replace(head, F.lit("(?s)^" + quoted(OTHER[0]) + "|" + quoted(OTHER[1]) + "$"), F.lit("")))
        return known(head, named, {name: F.lit(name) for name in template})

    def three(x: Column) -> Column:
        flag = known(x["head"], F.lit(False), {name: F.lit(loss) for name, (_, _, loss) in template.items()})
        return F.array(*[F.struct(x[n].alias("text"), loss.alias("loss")) for n, loss in (("head", F.lit(False)), ("body", flag), ("tail", F.lit(False)))])

    turns = F.transform(parts, lambda x: F.struct(role(x["head"]).alias("role"), unescape(x["body"]).alias("text")))
    return formatted.withColumns({"turns": turns, "segments": F.flatten(F.transform(parts, three))})
