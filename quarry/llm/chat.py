"""Chat formatting with Spark expressions only.

Turn structs are collected per conversation and sorted by (turn, role, text).  The places
where the role changes cut the sorted array into slices; each slice is aggregated to one
block with one header, in which the texts stay apart by a part mark, so the original turns
can be read back.  The result is one string and the spans of it that count for the loss,
as byte offsets into its UTF-8 form.

Template of a block: ``<|im_start|>ROLE<|body|>TEXT[<|part|>TEXT]...<|im_end|>\\n``.
Control strings in roles and texts get one backslash after their first character; strings
that already look so get one more, which makes the escape a bijection.  Control strings are
``<|any|>`` (with plain or full-width bars), ``<<any>>``, ``<name>``, ``</name>``,
``[NAME]`` and ``[/NAME]``.

Defined cases: null text or role reads as empty; a null ``turn`` sorts first; rows with a
null conversation id form one conversation; repeated rows are repeated turns; texts have
no length limit; an empty table gives an empty result; columns other than the four named
are ignored.  A conversation is one value, which a task must hold; work is linear in its
turns, but for sums of up to ``CHUNK`` lengths for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, PART, END = "<|im_start|>", "<|body|>", "<|part|>", "<|im_end|>\n"
#: What follows the first character (and backslashes) of a control string.
SINGLE = r"([|｜][^|｜<>\[]*[|｜]>|/?[A-Za-z0-9_][A-Za-z0-9_.:-]*>)"
SQUARE = r"(/?[A-Z][A-Z0-9_]*\])"
DOUBLE = r"(<\\*[^<>\[]*>>)"
#: Lengths summed one by one to find offsets.
CHUNK = 256


def escape(text: Column) -> Column:
    """Put one backslash into every control string."""
    # single forms hold no other "<" or "[", and double ones are the same whether their inner "<" has a backslash or not
    for first, rest in (("<", SINGLE), (r"\[", SQUARE), ("<", DOUBLE)):
        text = F.regexp_replace(text, rf"({first})(\\*){rest}", r"$1\\$2$3")
    return text


def unescape(text: Column) -> Column:
    for first, rest in (("<", DOUBLE), (r"\[", SQUARE), ("<", SINGLE)):
        text = F.regexp_replace(text, rf"({first})\\(\\*){rest}", "$1$2$3")
    return text


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it in a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _offsets(sizes: Column) -> Column:
    """For each of ``sizes`` (one at least) the sum of those before it."""

    def of(sizes: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK)))
        return _let(chunks, lambda cs: _let(F.transform(cs, _sum), lambda sums: F.flatten(F.transform(cs, lambda c, k: inside(c, _sum(F.slice(sums, F.lit(1), k)))))))

    def inside(chunk: Column, base: Column) -> Column:
        return _let(base, lambda b: F.transform(chunk, lambda _, i: b + _sum(F.slice(chunk, F.lit(1), i))))

    return _let(sizes, of)


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: id, ``formatted`` and ``mask``, the spans (start, bytes) that count for the loss.

    The spans are the texts of ``trained_role``, escaped as in the output, in order.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    ts, n = F.col("ts"), F.size("ts")
    # places where a block begins
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ts, i - 1)["role"] != F.get(ts, i)["role"]))

    def blocks_of(starts: Column) -> Column:
        def block(s: Column, k: Column) -> Column:
            merged = F.slice(ts, s + 1, F.coalesce(F.get(starts, k + 1), n) - s)
            return F.struct(F.get(ts, s)["role"].alias("role"), F.transform(merged, lambda t: escape(t["text"])).alias("texts"))

        return F.transform(starts, block)

    blocks = listed.select("conv_id", _let(starts, blocks_of).alias("blocks"))
    head = lambda b: F.concat(F.lit(START), escape(b["role"]), F.lit(BODY))
    written = blocks.select("conv_id", "blocks", F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], PART), F.lit(END))).alias("parts"))

    def spans(at: Column) -> Column:
        def of_block(b: Column, k: Column) -> Column:
            first = F.get(at, k) + _bytes(head(b))
            sizes = F.transform(b["texts"], lambda t: _bytes(t) + len(PART))
            own = F.zip_with(_offsets(sizes), b["texts"], lambda o, t: F.struct(o.alias("start"), _bytes(t).alias("bytes")))
            own = _let(first, lambda f: F.transform(own, lambda s: F.struct((f + s["start"]).alias("start"), s["bytes"].alias("bytes"))))
            return F.when(b["role"] == trained_role, own).otherwise(F.slice(own, F.lit(1), F.lit(0)))

        return F.flatten(F.transform("blocks", of_block))

    mask = _let(_offsets(F.transform("parts", _bytes)), spans)
    return written.select("conv_id", F.array_join("parts", "").alias("formatted"), mask.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), in order."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        sides = F.split(block, r"<\|body\|>")
        body = F.regexp_replace(F.get(sides, F.lit(1)), r"<\|im_end\|>\n$", "")
        return _let(
            F.get(sides, F.lit(0)),
            lambda role: F.transform(F.split(body, r"<\|part\|>"), lambda p: F.struct(unescape(role).alias("role"), unescape(p).alias("text"))),
        )

    return F.flatten(F.transform(blocks, turns_of))


def read_masked(formatted: Column, mask: Column) -> Column:
    """The text under the mask, unescaped: the spans cut out of the output itself."""
    cut = lambda whole: F.transform(mask, lambda m: unescape(F.decode(F.substring(whole, (m["start"] + 1).cast("int"), m["bytes"].cast("int")), "UTF-8")))
    return F.array_join(_let(F.encode(formatted, "UTF-8"), cut), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Figures read back from the output of :func:`format_conversations`."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_masked(F.col("formatted"), F.col("mask")).alias("loss"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
