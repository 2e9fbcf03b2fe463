r"""Operator 10: chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation, by turns:  ``### role: text</turn>\n``. Inside roles and texts a backslash makes the
next character plain; ``###`` and ``</turn>`` never appear raw in a text, nor ``: `` in a role. The parser splits at
``</turn>``, checks each piece's header, and undoes the backslashes; anything else is malformed.

Formatting starts from the plain text. A turn whose own rendering doesn't parse back to exactly itself is escaped; then
the whole conversation is parsed, and if it still differs from the source, all its turns are escaped. Escaped text has no
raw control string and each backslash doubled, so its round trip is exact, which the result is held to once more.

The loss mask is a list of ranges (start, end) of code points of the formatted string, from the parser's own places: the texts
of one speaker's turns, escapes included, in order. What is trained on is read through these ranges alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before, let

END, HEAD = "</turn>", "### "


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(END), F.lit("<\\/turn>"))
    return F.regexp_replace(text, "#(?=##)", "#\\\\")


def escape_role(role: Column) -> Column:
    role = F.replace(escape(role), F.lit(": "), F.lit(":\\ "))
    return role


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def render(turns: Column, escaped: Column | None = None) -> Column:
    """The formatted string of an array of (role, text, escaped) turns; ``escaped`` overrides the turns' own flags."""

    def one(t: Column) -> Column:
        flag = t["escaped"] if escaped is None else escaped
        return F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit(": "), F.when(flag, escape(t["text"])).otherwise(t["text"]), F.lit(END + "\n"))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a formatted string, null for a malformed turn."""
    pieces = F.split(formatted, END)  # no character of it is special in a pattern

    def one(p: Column, i: Column) -> Column:
        p = F.when(i == 0, p).when(p.startswith("\n"), F.substr(p, F.lit(2)))
        head = F.substring_index(p, ": ", 1)
        text = F.substr(p, F.length(head) + 3)
        # each backslash starts a pair, so what is left without the pairs has none
        bare = F.regexp_replace(text, "(?s)\\\\.", "")
        good = p.startswith(HEAD) & F.contains(p, F.lit(": ")) & ~F.contains(bare, F.lit("\\")) & ~F.contains(text, F.lit("###"))
        return F.when(good, F.struct(unescape(F.substr(head, F.lit(len(HEAD) + 1))).alias("role"), unescape(text).alias("text")))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), one)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array<(role, text)> as parsed back, formatted string, ok boolean) per conversation of rows (conv_id, turn, role, text).

    Rows by turn (null first), ties by role and text; null role or text: empty. A null conv_id is a conversation. ``ok`` says that the
    parsed turns equal the source. A conversation is one row, so its text must fit in one: it is the unit that is formatted.
    An empty table gives an empty one.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    one = lambda r, t: F.struct(r.alias("role"), t.alias("text"))
    row = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    alone = F.struct(F.col("role"), F.col("text"), F.lit(False).alias("escaped"))
    back = parse(render(F.array(alone)))
    row = row.withColumn("escaped", ~F.coalesce(back == F.array(one(F.col("role"), F.col("text"))), F.lit(False)))
    conv = row.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "escaped"))).alias("t"))
    conv = conv.withColumn("source", F.transform("t", lambda t: one(t["role"], t["text"])))
    conv = conv.withColumn("_f", render(F.col("t")))
    conv = conv.withColumn("formatted", F.when(parse(F.col("_f")) == F.col("source"), F.col("_f")).otherwise(render(F.col("t"), F.lit(True))))
    conv = conv.withColumn("turns", parse(F.col("formatted")))
    return conv.select("conv_id", "turns", "formatted", F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("ok"))


def loss_mask(formatted: Column, speaker: str = "assistant") -> Column:
    """Ranges (start, end) of the formatted string in which ``speaker``'s texts lie."""

    def ranges(pieces: Column) -> Column:
        starts = before(F.transform(pieces, lambda p: (F.length(p) + len(END)).cast("long")))

        def one(p: Column, at: Column) -> Column:
            skip = F.when(p.startswith("\n"), 1).otherwise(0)  # the line end of the turn before
            head = F.substring_index(F.substr(p, skip + 1), ": ", 1)
            role = unescape(F.substr(head, F.lit(len(HEAD) + 1)))
            return F.when(role == speaker, F.struct((at + skip + F.length(head) + 2).cast("int").alias("start"), (at + F.length(p)).cast("int").alias("end")))

        return F.filter(F.zip_with(pieces, starts, one), lambda r: r.isNotNull())

    cut = F.split(formatted, END)
    return let(F.slice(cut, 1, F.size(cut) - 1), ranges)


def masked(formatted: Column, mask: Column) -> Column:
    """The unescaped text under a mask's ranges. Slices of four bytes a character, so that no range is searched from the start."""
    wide = F.encode(formatted, "UTF-32")
    cut = lambda w, r: F.decode(F.substr(w, 4 * r["start"] + 1, 4 * (r["end"] - r["start"])), "UTF-32")
    return let(wide, lambda w: F.array_join(F.transform(mask, lambda r: unescape(cut(w, r))), ""))


def digests(formatted: DataFrame, speaker: str = "assistant") -> DataFrame:
    """What reads back from the output: counts and digests of the turns, and of the text under the loss mask (``speaker``'s)."""
    read = formatted.withColumn("mask", loss_mask(F.col("formatted"), speaker))
    read = read.withColumn("loss", masked(F.col("formatted"), F.col("mask")))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.col("ok").alias("round_trip"),
    )
