"""Chat formatting as column expressions: turns are sorted, merged, marked and joined to one text.

A conversation's turns are collected as structs and sorted; adjacent turns with one role merge
into one marked block, inside which a part mark keeps them apart. The texts are escaped, so no
control string of the template can come from a text: a backslash after the first sign of
whatever would read as a control string, one more than stood there already. Read back, blocks
are found by their marks, parts by the part mark, and one backslash goes: nothing is lost.

The loss mask is a list of byte spans of the formatted text, one for each assistant text. Every
step is an expression of arrays and strings that is linear in the conversation.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns in a block of running sums: inside it they are appended one by one.
BLOCK = 256


@dataclass(frozen=True)
class Template:
    """Marks around a block by role, marks for any other role, and the mark between parts.

    Control strings begin with ``<`` or ``[``, and none holds the begin of another after its first sign.
    """

    roles: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("<role>", "<text>", "</text>")
    part: str = "<part>"
    loss_role: str = "assistant"

    def controls(self) -> list[str]:
        return [m for _, *marks in self.roles for m in marks] + [*self.other, self.part]


LLAMA = Template()


def _tails(template: Template) -> str:
    """Places after the first sign of a control string, with any backslashes between; no width."""
    groups = []
    for sign in "<[":
        tails = "|".join(re.escape(c[1:]) for c in template.controls() if c[0] == sign)
        groups.append(rf"(?<={re.escape(sign)}){{0}}(?=\\*(?:{tails}))")
    return "|".join(groups)


def escaped(text: Column, template: Template = LLAMA) -> Column:
    """``text`` without control strings."""
    return F.regexp_replace(text, F.lit(_tails(template).replace("{0}", "")), F.lit("\\\\"))


def unescaped(text: Column, template: Template = LLAMA) -> Column:
    """What ``escaped`` made its text from."""
    return F.regexp_replace(text, F.lit(_tails(template).replace("{0}", r"\\")), F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(sizes: Column) -> Column:
    """The sum of all sizes before each place, as an array; blocks first, so that long arrays stay cheap."""
    def sums(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))

    def blocks(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: sums(F.slice(values, b * BLOCK + 1, BLOCK)))

    def joined(inner: Column, outer: Column) -> Column:
        return F.flatten(F.transform(inner, lambda x, b: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + F.get(outer, b))))

    return _let(_let(sizes, blocks), lambda inner: _let(sums(F.transform(inner, lambda x: F.element_at(x, -1))), lambda outer: joined(inner, outer)))


def _merged(turns: Column) -> Column:
    """Blocks (``role``, ``parts``) of adjacent turns with one role."""
    def cut(roles: Column, texts: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(texts)))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct(F.get(roles, x["a"]).alias("role"), F.slice(texts, x["a"] + 1, x["b"] - x["a"]).alias("parts")))

    def starts(roles: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(roles) - 1), lambda i: (i == 0) | (F.get(roles, i - 1) != F.get(roles, i)))

    return _let(
        F.transform(turns, lambda t: t["role"]),
        lambda roles: _let(F.transform(turns, lambda t: t["text"]), lambda texts: _let(starts(roles), lambda at: cut(roles, texts, at))),
    )


def formatted(conversations: DataFrame, template: Template = LLAMA) -> DataFrame:
    """``conv_id``, ``messages``, ``formatted`` and ``loss_mask`` for each conversation.

    ``messages`` are the merged blocks (``role``, ``parts``), ``loss_mask`` the byte spans
    (``start``, ``size``) of the escaped assistant texts in ``formatted``. Rows go by turn, null
    turns first, then by role and text; repeated rows stay. A null role or text counts as empty,
    rows without ``conv_id`` are one conversation, other columns are not looked at. A conversation
    is one string in the result, which Spark bounds at 2 GB.
    """
    rows = conversations.select(
        "conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t")
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def mark(role: Column, which: int) -> Column:
        at = F.concat(F.lit(template.other[0]), escaped(role, template), F.lit(template.other[1])) if which == 0 else F.lit(template.other[2])
        for name, *marks in template.roles:
            at = F.when(role == name, marks[which]).otherwise(at)
        return at

    def pieces(block: Column) -> Column:
        """What stands before, in and after each part of a block."""
        n = F.size(block["parts"])
        return F.transform(block["parts"], lambda x, i: F.struct(
            block["role"].alias("role"), F.when(i == 0, mark(block["role"], 0)).otherwise(template.part).alias("before"), escaped(x, template).alias("body"),
            F.when(i == n - 1, mark(block["role"], 1)).otherwise("").alias("after"),
        ))

    def spans(parts: Column) -> Column:
        starts = _running(F.transform(parts, lambda p: F.octet_length(p["before"]).cast("long") + F.octet_length(p["body"]) + F.octet_length(p["after"])))
        placed = F.filter(F.arrays_zip(parts.alias("p"), starts.alias("start")), lambda x: x["p"]["role"] == template.loss_role)
        return F.transform(placed, lambda x: F.struct((x["start"] + F.octet_length(x["p"]["before"])).alias("start"), F.octet_length(x["p"]["body"]).cast("long").alias("size")))

    def made(parts: Column) -> Column:
        whole = F.array_join(F.transform(parts, lambda p: F.concat(p["before"], p["body"], p["after"])), "")
        return F.struct(whole.alias("formatted"), spans(parts).alias("loss_mask"))

    blocks = turns.select("conv_id", _let(F.col("turns"), _merged).alias("messages"))
    out = blocks.select("conv_id", "messages", _let(F.flatten(F.transform("messages", pieces)), made).alias("made"))
    return out.select("conv_id", "messages", "made.formatted", "made.loss_mask")


def turns_of(text: Column, template: Template = LLAMA) -> Column:
    """The turns (``role``, ``text``) that a formatted text was made from."""
    def either(which: int) -> str:
        return "|".join(re.escape(marks[which]) for _, *marks in template.roles)

    name, begin, end = map(re.escape, template.other)
    block = rf"(?s)({either(0)}|{name}.*?{begin})(.*?)({either(1)}|{end})"
    heads, bodies = F.regexp_extract_all(text, F.lit(block), F.lit(1)), F.regexp_extract_all(text, F.lit(block), F.lit(2))
    first, second = (len(x) for x in template.other[:2])

    def role(head: Column) -> Column:
        found = unescaped(head.substr(F.lit(first + 1), F.char_length(head) - first - second), template)
        for known, opening, _ in template.roles:
            found = F.when(head == opening, known).otherwise(found)
        return found

    blocks = F.arrays_zip(heads.alias("head"), F.transform(bodies, lambda b: F.split(b, re.escape(template.part), -1)).alias("parts"))
    return F.flatten(F.transform(blocks, lambda b: F.transform(b["parts"], lambda p: F.struct(role(b["head"]).alias("role"), unescaped(p, template).alias("text")))))


def loss_texts(text: Column, mask: Column, template: Template = LLAMA) -> Column:
    """The texts under a loss mask, unescaped, in order."""
    raw = text.cast("binary")
    return F.transform(mask, lambda s: unescaped(F.substring(raw, (s["start"] + 1).cast("int"), s["size"].cast("int")).cast("string"), template))


def read_back(chats: DataFrame, template: Template = LLAMA) -> DataFrame:
    """Digests of what formatted conversations hold: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    ``turns_sha256`` is of role, newline, text, newline for each turn, ``loss_sha256`` of the texts
    under the loss mask in a row.
    """
    read = chats.select(
        "conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), turns_of(F.col("formatted"), template).alias("turns"),
        F.array_join(loss_texts(F.col("formatted"), F.col("loss_mask"), template), "").alias("loss"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
