"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it as context, and that reply
as the only part to train on. Turns after the last assistant turn become one example without a
target, so that no turn of a conversation is lost.

A turn is written `[INST]role[/INST]text</s>`. Inside roles and texts a control string gets a
backslash behind its opening bracket, and one that has backslashes there already gets one more;
taking one away again gives back every text.

Defined results: null role and null text count as empty. Turns are ordered by turn number (null
first), then role, then text; repeated rows are turns of their own. Rows with a null conversation
form one conversation. Columns other than the four named are not read. The expansion holds the
turns of one conversation together and grows with the square of their number, as its output does. An id column
that bears the name of a result comes back as <name>_id. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavefold.llm.common import own_id

# The control strings of the template.
HEAD, BODY, END = "[INST]", "[/INST]", "</s>"
#: The brackets that open a control string, the backslashes behind them, and what closes it.
_OPEN, _CLOSE = r"(\[/?|<<?/?)", r"(INST\]|SYS>>|s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + r"(\\*)" + _CLOSE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + r"\\(\\*)" + _CLOSE, r"$1$2$3")


@own_id("example", "n_examples", "n_turns", "formatted", "loss_start", "loss_end")
def format_chats(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, target_role: str = "assistant") -> DataFrame:
    """One row an example: conversation, example (from 0), n_examples, n_turns (in this example), formatted, loss_start and loss_end (characters from 0, the end excluded; both null without a target)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chats = df.select(F.col(conv_col).alias("__conv"), turn.alias("__turn")).groupBy("__conv").agg(F.array_sort(F.collect_list("__turn")).alias("turns"))
    written = F.transform("turns", lambda t: F.struct((t["role"] == target_role).alias("target"), F.concat(F.lit(HEAD), escape(t["role"]), F.lit(BODY)).alias("head"), escape(t["text"]).alias("body")))
    chats = chats.select("__conv", written.alias("turns"))
    numbers = F.sequence(F.lit(1), F.size("turns"))
    last = F.size("turns")
    targets = F.filter(numbers, lambda i: F.element_at("turns", i)["target"] | (i == last))
    spread = chats.select("__conv", "turns", targets.alias("targets")).select("__conv", "turns", F.size("targets").alias("n_examples"), F.posexplode("targets").alias("example", "n_turns"))
    target = F.element_at("turns", F.col("n_turns"))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n_turns") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    parts = spread.select("__conv", "example", "n_examples", "n_turns", F.concat(before, target["head"]).alias("before"), target["body"].alias("body"), target["target"].alias("target"))
    start = F.length("before").cast("bigint")
    return parts.select(
        F.col("__conv").alias(conv_col), "example", "n_examples", "n_turns",
        F.concat("before", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("target"), start).alias("loss_start"),
        F.when(F.col("target"), start + F.length("body")).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns written in a formatted text: array of (role, text)."""
    written = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    return F.transform(written, lambda x: F.struct(unescape(F.substring_index(F.substring(x, len(HEAD) + 1, 2**31 - 1), BODY, 1)).alias("role"), unescape(F.substring_index(x, BODY, -1)).alias("text")))


def read_back(examples: DataFrame, conv_col: str) -> DataFrame:
    """What the formatted texts say of each conversation: n_turns, turns_sha256 (over role, line end, text, line end of each turn), loss_chars, loss_sha256 (over the texts under the loss mask) and formatted_chars."""
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = F.col("example") == F.col("n_examples") - 1  # the last example has all turns
    under = unescape(F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    read = examples.select(
        F.col(conv_col), "example", F.length("formatted").cast("bigint").alias("chars"),
        F.when(whole, F.size(turns).cast("bigint")).alias("n_turns"), F.when(whole, F.sha2(said, 256)).alias("turns_sha256"), F.when(F.col("loss_start").isNotNull(), under).alias("reply"),
    )
    replies = F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply"))))
    found = read.groupBy(conv_col).agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), replies.alias("replies"), F.sum("chars").alias("formatted_chars"))
    text = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return found.select(conv_col, "n_turns", "turns_sha256", F.length(text).cast("bigint").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars")
