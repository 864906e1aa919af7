"""Chat formatting: a state machine over roles and a declarative template, all in column expressions.

Each turn becomes three segments: an opening control string, the escaped text, a closing control
string. Only the text segment of a trained role is under the loss mask. Control strings start with
``<`` or ``[``; in texts these two characters and the escape character are replaced by two-character
codes, so a text can never contain a control string and unescaping restores it exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from residuum.llm.text import let


@dataclass(frozen=True)
class Template:
    """What is written around a turn, which roles are trained, and which role may follow which."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    #: Any other role is written out between these three.
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    trained: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; what is missing is an error. The machine begins in "start".
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    codes: dict[str, str] = field(default_factory=lambda: {"\\": "e", "<": "l", "[": "b"})


def escaped(text: Column, template: Template) -> Column:
    """The escape character first, so that codes written later are not touched again."""
    for char in sorted(template.codes, key=lambda c: c != template.escape):
        text = F.replace(text, F.lit(char), F.lit(template.escape + template.codes[char]))
    return text


def unescaped(text: Column, template: Template) -> Column:
    for char in sorted(template.codes, key=lambda c: c == template.escape):
        text = F.replace(text, F.lit(template.escape + template.codes[char]), F.lit(char))
    return text


def _by_role(role: Column, template: Template, part: int, other: Column) -> Column:
    out = other
    for name, marks in template.marks.items():
        out = F.when(role == name, marks[part]).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``segments``, ``valid``, ``complete``, ``bad_turn``.

    ``segments`` is an array of (text, loss); joined they are ``formatted``. ``valid`` is false if the
    machine finds no move for a turn, ``bad_turn`` is the 0-based place of the first such turn, and
    ``complete`` says whether it also ends in a final state. Nothing is dropped: invalid conversations
    are formatted too. Null text or role counts as empty; a null ``conv_id`` is a conversation of its
    own; ties of ``turn`` are ordered by role, then text; repeated rows are repeated turns; an empty
    table gives no rows; further columns are ignored. A conversation is one output value, so its turns
    meet in one row; nothing else is gathered.
    """
    clean = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                             F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    # Turns per conversation are first gathered per task, then merged: one shuffle of each text.
    grouped = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])

    def segments(row: Column) -> Column:
        role, text = row["role"], row["text"]
        head, middle, tail = template.other
        opening = _by_role(role, template, 0, F.concat(F.lit(head), escaped(role, template), F.lit(middle)))
        closing = _by_role(role, template, 1, F.lit(tail))
        return F.array(*[F.struct(value.alias("text"), loss.alias("loss")) for value, loss in (
            (opening, F.lit(False)), (escaped(text, template), role.isin(*template.trained)), (closing, F.lit(False)))])

    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, row: Column) -> Column:
        to = F.element_at(moves, F.concat(acc["state"], F.lit("\n"), row["role"]))
        known = F.array_contains(F.lit([*template.marks]), row["role"])
        # After an error the machine goes on from the role that came, so that only real breaks count.
        state = F.coalesce(to, F.when(known, row["role"]), acc["state"])
        return F.struct(state.alias("state"), (acc["place"] + 1).alias("place"),
                        F.coalesce(acc["bad"], F.when(to.isNull(), acc["place"])).alias("bad"))

    return (grouped
            .withColumn("segments", F.flatten(F.transform("rows", segments)))
            .withColumn("end", F.aggregate("rows", begin, step))
            .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
                    F.col("end.bad").isNull().alias("valid"),
                    (F.col("end.bad").isNull() & F.col("end.state").isin(*template.final)).alias("complete"),
                    F.col("end.bad").alias("bad_turn")))


def _pattern(marks: list[str]) -> str:
    return "|".join("\\Q" + m + "\\E" for m in sorted(marks, key=len, reverse=True))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation again: an array of (role, text)."""
    closing = _pattern([marks[1] for marks in template.marks.values()] + [template.other[2]])
    head, middle, _ = template.other

    def turn(chunk: Column) -> Column:
        role = F.replace(F.substring_index(chunk, middle, 1), F.lit(head), F.lit(""))
        text = let(F.instr(chunk, middle), lambda at: F.substring(chunk, at + len(middle), F.length(chunk)))
        for name, (opening, _) in template.marks.items():
            mine = F.startswith(chunk, F.lit(opening))
            role = F.when(mine, name).otherwise(role)
            text = F.when(mine, F.substring(chunk, F.lit(len(opening) + 1), F.length(chunk))).otherwise(text)
        return F.struct(unescaped(role, template).alias("role"), unescaped(text, template).alias("text"))

    # Every turn ends with a closing mark, so the last piece is always empty.
    return let(F.split(formatted, closing), lambda chunks: F.transform(F.slice(chunks, 1, F.size(chunks) - 1), turn))


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
