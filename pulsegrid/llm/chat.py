"""Chat formatting with Spark expressions alone.

A run of adjacent turns of one role has one header; every turn ends with the end mark:

    ### user: first text</turn>
    second text of the same role</turn>
    ### assistant: answer</turn>

Inside roles and texts a backslash comes before every backslash, before `###`, and before the slash
of `</turn>`, and in roles also before a colon. No text then holds a mark, and taking the character
after each backslash gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "### ", "</turn>\n"
SPAN = 64  # code points that the loss mask is compared with at once


def escaped(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("###", "\\###"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def header(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.replace(escaped(role), F.lit(":"), F.lit("\\:")), F.lit(": "))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask) of every conversation: its rows by turn, adjacent turns of a role
    merged.

    `loss_mask` covers `formatted` in order, as runs of (n, loss): n code points, and whether the loss is
    taken on them, which it is on the texts of role `learn` without headers and end marks.

    Rows of equal turn come in order of role, then text; null turns come first. Null roles and texts
    count as empty; a null conv_id is one conversation. Repeated rows are turns of their own. An empty
    table gives none, further columns are ignored.
    """
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    starts = F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[i - 1]["role"])
    )
    opened = sorted_turns.withColumn("starts", F.array_append(starts, n))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("starts") - 2),
        lambda k: F.struct(
            F.col("turns")[F.col("starts")[k]]["role"].alias("role"),
            F.slice("turns", F.col("starts")[k] + 1, F.col("starts")[k + 1] - F.col("starts")[k]).alias("said"),
        ),
    )
    merged = opened.select("conv_id", runs.alias("runs"))
    text = F.array_join(
        F.transform(
            "runs",
            lambda r: F.concat(header(r["role"]), F.array_join(F.transform(r["said"], lambda t: F.concat(escaped(t["text"]), F.lit(TAIL))), "")),
        ),
        "",
    )
    def run_of(n: Column, loss: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), loss.alias("loss"))

    never = F.lit(False)
    mask = F.transform(
        "runs",
        lambda r: F.transform(
            r["said"],
            lambda t, i: F.array(
                run_of(F.when(i == 0, F.length(header(r["role"]))).otherwise(0), never),
                run_of(F.length(escaped(t["text"])), r["role"] == learn),
                run_of(F.lit(len(TAIL)), never),
            ),
        ),
    )
    return merged.select("conv_id", text.alias("formatted"), F.flatten(F.flatten(mask)).alias("loss_mask"))


def read_chats(chats: DataFrame) -> DataFrame:
    """`chats` with turns, the array of (role, text) that its column `formatted` was made of."""
    head = r"^### ([^\\:]*+(?:\\(?s:.)[^\\:]*+)*+): "
    pieces = chats.withColumn("_pieces", F.split("formatted", TAIL))
    pieces = pieces.withColumn("_pieces", F.slice("_pieces", 1, F.size("_pieces") - 1))  # after the last mark nothing follows
    parted = pieces.withColumn(
        "_pieces",
        F.transform("_pieces", lambda p: F.struct(p.startswith(HEAD).alias("opens"), F.regexp_extract(p, head, 1).alias("role"), p.alias("raw"))),
    )
    opens = F.filter(F.sequence(F.lit(0), F.size("_pieces") - 1), lambda i: F.col("_pieces")[i]["opens"])
    placed = parted.withColumn("_opens", F.array_append(opens, F.size("_pieces")))
    turns = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("_opens") - 2),
            lambda k: F.transform(
                F.slice("_pieces", F.col("_opens")[k] + 1, F.col("_opens")[k + 1] - F.col("_opens")[k]),
                lambda p: F.struct(
                    unescaped(F.col("_pieces")[F.col("_opens")[k]]["role"]).alias("role"),
                    unescaped(F.when(p["opens"], F.regexp_replace(p["raw"], head, "")).otherwise(p["raw"])).alias("text"),
                ),
            ),
        )
    )
    return placed.withColumn("turns", turns).drop("_pieces", "_opens")


def loss_text() -> Column:
    """What the loss is taken on: the code points of `formatted` that `loss_mask` covers with loss, in
    order, nothing between, unescaped.

    Text and mask are cut into spans of SPAN code points, so that the work grows with the text alone;
    only spans in which the mask changes are looked at by code point."""
    flags = F.array_join(F.transform("loss_mask", lambda r: F.repeat(F.when(r["loss"], "1").otherwise("0"), r["n"])), "")
    spans = F.zip_with(_spans(F.col("formatted")), _spans(flags), lambda text, flag: F.struct(text.alias("text"), flag.alias("flag")))

    def chosen(span: Column) -> Column:
        points = F.zip_with(
            F.split(span["text"], ""), F.split(span["flag"], ""), lambda point, flag: F.when(flag == "1", point).otherwise("")
        )
        return (
            F.when(~F.contains(span["flag"], F.lit("0")), span["text"])
            .when(F.contains(span["flag"], F.lit("1")), F.array_join(points, "")).otherwise("")
        )

    return unescaped(F.array_join(F.transform(spans, chosen), ""))


def _spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SPAN}}}"), F.lit(0))
