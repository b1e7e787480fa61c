"""Chat formatting in one template, with Spark expressions only.

A window numbers the places of a conversation's turns; its turn structs are
collected and sorted; adjacent turns of one role become a run; a run is

    <|im_start|> role <|im_body|> text (<|im_sep|> text)* <|im_end|>

without the blanks. In texts and roles every control string, of this template
and of bracket templates, gets a backslash after its first character, or one
more where backslashes already stand there. So no control string of the output
comes from a text, and taking one backslash away restores each text.

Nulls and odd input: null text is empty; null turn sorts first; null role is its
own role and comes back as null would print, the empty string; ties of turn are
ordered by role and text as they are before escaping, and equal rows are all kept;
very long texts and conversations are formatted whole, in time in proportion to
their length; rows with a null conv_id form one conversation; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, BODY, SEP, END = "<|im_start|>", "<|im_body|>", "<|im_sep|>", "<|im_end|>"
#: What may follow the first character of a control string.
TAILS = r"\||s>|/s>|INST\]|/INST\]"
ESCAPE = rf"([<\[])(\\*)(?={TAILS})"
UNESCAPE = rf"([<\[])\\(\\*)(?={TAILS})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, the formatted string, and loss_spans: start and length in code points of each text under the loss mask."""
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = said.select("conv_id", escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), F.row_number().over(order).alias("n"), F.lag("role").over(order).alias("before"), F.col("role").alias("raw"))
    # What stands before a text: the run's head, and the end of the run before, or a separator.
    head = F.length("role") + len(START) + len(BODY)
    lead = F.when(F.col("before").isNull(), head).when(F.col("before") != F.col("raw"), head + len(END)).otherwise(len(SEP))
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    said = said.withColumn("start", F.sum((lead + F.length("text")).cast("long")).over(upto) - F.length("text"))
    own = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text", "start"))).alias("turns"))
    n = F.size("turns")
    # A run starts where the role differs from that of the turn before.
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.col("turns")[i - 1]["role"] != F.col("turns")[i - 2]["role"]))
    own = own.withColumn("starts", starts)
    # Runs as the array that is walked, not as a column named within the walk, which the optimizer may work out anew for each run.
    runs = F.transform("starts", lambda s, k: F.struct(s.alias("start"), (F.coalesce(F.get("starts", k + 1), n + 1) - s).alias("turns")))
    pieces = F.transform(
        runs,
        lambda r: F.concat(
            F.lit(START),
            F.col("turns")[r["start"] - 1]["role"],
            F.lit(BODY),
            F.array_join(F.transform(F.slice("turns", r["start"], r["turns"]), lambda t: t["text"]), SEP),
            F.lit(END),
        ),
    )
    under_loss = F.filter("turns", lambda t: t["role"] == escaped(F.lit(loss_role)))
    spans = F.transform(under_loss, lambda t: F.struct(t["start"].alias("start"), F.length(t["text"]).cast("long").alias("length")))
    return own.select("conv_id", F.array_join(pieces, "").alias("formatted"), spans.alias("loss_spans"))


#: Code points of a block that loss spans are read from.
BLOCK = 4096


def _bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often and in however many lambdas it is named."""
    return F.transform(F.array(value), use)[0]


def _span(blocks: Column, start: Column, length: Column) -> Column:
    """A span of the text that the blocks make up: only its own blocks are touched."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((start + length) / BLOCK).cast("int")
    own = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.substring(own, (start - first * BLOCK + 1).cast("int"), length.cast("int"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, the turns (role, text) and the text under the loss mask, from the formatted string and its spans."""

    def pieces(text: Column, mark: str) -> Column:
        return F.split(text, mark.replace("|", r"\|"), -1)

    runs = F.filter(pieces(F.col("formatted"), END), lambda r, i: r != "")

    def turns_of(run: Column) -> Column:
        def texts(head: Column) -> Column:
            return _bound(unescaped(head[0]), lambda role: F.transform(pieces(head[1], SEP), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))))

        return _bound(pieces(run.substr(F.lit(len(START) + 1), F.length(run)), BODY), texts)

    blocks = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{BLOCK}}}"), 0)
    loss = _bound(F.struct(blocks.alias("blocks"), F.col("loss_spans").alias("spans")), lambda x: F.transform(x["spans"], lambda s: unescaped(_span(x["blocks"], s["start"], s["length"]))))
    return formatted.select("conv_id", F.flatten(F.transform(runs, turns_of)).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    back = read_back(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
