"""Chat formatting into budgeted windows, in DataFrame functions only.

A turn is ``<|turn|>role`` NEWLINE text ``<|end|>`` NEWLINE. Control strings inside roles and texts get a
backslash after their first character (one more where there are some already), which ``unescaped`` takes away.

Turns of a conversation have running token counts. A window's room, the budget less the system turn and
the history, cuts the running count into cells; the turns inside one cell form a span, and a turn that
crosses a border forms one of its own. Spans so follow turns, hold no more than the room (a longer turn is
alone in its window), and need nothing but prefix sums, which are summed in blocks of turns and then inside
them. Every window repeats the system turn and the last turns before its span that fit into the history.
The loss covers the texts of assistant turns in the window whose span they belong to; repeated turns are
masked.

Null roles and texts are empty, rows with a null conversation id form one conversation, and rows with a null
turn come first. Equal turn numbers are ordered by role and text; repeated rows are turns of their own. Only
the four columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkfold.llm.common import written

TURN, END = "<|turn|>", "<|end|>"
#: Strings that a template or a model may take for control, without their first character.
_CONTROL = r"\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>"
#: Turns whose counts are summed together first.
BLOCK = 512


@dataclass(frozen=True)
class Params:
    budget: int = 1024
    history: int = 256
    #: Tokens that a turn's marks count.
    overhead: int = 4
    #: Bytes of text for a token.
    bytes_per_token: int = 4


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def _role(role: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def role_of(tag: Column) -> Column:
    return F.replace(F.replace(unescaped(tag), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted_turns(conversations: DataFrame, p: Params) -> DataFrame:
    """Every turn with its formatted text, tokens, place and running count before it, without the system turn's tokens."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), escaped(text).alias("body"), _role(role).alias("tag"))
    tokens = (F.lit(p.overhead) + F.ceil(F.octet_length(F.concat("tag", "body")) / p.bytes_per_token)).cast("long")
    # A turn number may be anything: blocks are of equal numbers by BLOCK, nulls first.
    t = t.withColumn("tokens", tokens).withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    first = t.groupBy("conv_id").agg(F.min(F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 62))).alias("at"), "role", "text", "tokens")).alias("f"))
    has = F.col("f.role") == "system"
    system = first.select(F.col("conv_id").alias("_c"), has.alias("has_system"), F.when(has, F.col("f.tokens")).otherwise(0).alias("system_tokens"))
    sums = t.groupBy("conv_id", "block").agg(F.sum("tokens").alias("_t"), F.count("*").alias("_n"))
    over = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("conv_id").alias("_sc"), F.col("block").alias("_sb"), F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n0")
    )
    own = Window.partitionBy("conv_id", "block").orderBy(*order)
    t = t.withColumn("_k", F.row_number().over(own)).withColumn("_s", F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.join(starts, F.col("conv_id").eqNullSafe(F.col("_sc")) & F.col("block").eqNullSafe(F.col("_sb")))
    t = t.join(system, F.col("conv_id").eqNullSafe(F.col("_c")))
    place = F.col("_k") - 1 + F.col("_n0")
    is_system = F.col("has_system") & (place == 0)
    return t.select(
        "conv_id", place.alias("place"), "role", "tag", "body", "tokens", is_system.alias("is_system"), "system_tokens",
        (F.col("_s") - F.col("tokens") + F.col("_t0") - F.col("system_tokens")).alias("before"),
    )


def windows(conversations: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per window: text, where its loss lies, and how many of its first turns are repeated.

    conv_id, first_place (place of its first new turn), text, n_turns, n_repeated, n_tokens, loss (array of
    struct begin, length in characters of ``text``).
    """
    t = written(formatted_turns(conversations, p), "turns")
    room = F.greatest(F.lit(p.budget - p.history) - F.col("system_tokens"), F.lit(1))
    t = t.withColumn("room", room)
    cell = lambda at: F.floor(at / F.col("room"))
    turns = t.filter(~F.col("is_system"))
    spanned = turns.select("*", cell(F.col("before")).alias("from_cell"), cell(F.col("before") + F.col("tokens") - 1).alias("to_cell"))
    spans = spanned.groupBy("conv_id", "from_cell", "to_cell").agg(F.min("before").alias("start"), F.min("place").alias("first_place"))
    parts = ["place", "role", "tag", "body", "tokens"]
    new = spanned.select("conv_id", "from_cell", "to_cell", F.lit(False).alias("repeated"), *parts)
    # A turn that ends at e can be history of spans that begin from e to its own begin plus the history: a few cells.
    ends = F.col("before") + F.col("tokens")
    past = turns.filter(F.col("tokens") <= p.history).select(
        F.col("conv_id").alias("_c"), F.explode(F.sequence(cell(ends), cell(F.col("before") + p.history))).alias("_cell"), ends.alias("_end"), F.col("before").alias("_before"), *parts
    )
    s = spans.select("conv_id", "from_cell", "to_cell", "start")
    repeated = s.join(
        past,
        F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("from_cell") == F.col("_cell")) & (F.col("_end") <= F.col("start")) & (F.col("_before") >= F.col("start") - p.history),
    ).select("conv_id", "from_cell", "to_cell", F.lit(True).alias("repeated"), *parts)
    head = t.filter("is_system").select(F.col("conv_id").alias("_c"), *parts)
    # With other turns the system turn is repeated in all windows but the first; alone it is a window.
    headed = s.join(head, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "from_cell", "to_cell", (F.col("start") > 0).alias("repeated"), *parts)
    alone = head.join(s.select(F.col("conv_id").alias("_d")), F.col("_c").eqNullSafe(F.col("_d")), "left_anti").select(
        F.col("_c").alias("conv_id"), F.lit(0).cast("long").alias("from_cell"), F.lit(0).cast("long").alias("to_cell"), F.lit(False).alias("repeated"), *parts
    )
    rows = new.unionByName(repeated).unionByName(headed).unionByName(alone)
    # A window's turns are bounded by the budget, as every turn counts some tokens.
    got = rows.groupBy("conv_id", "from_cell", "to_cell").agg(F.array_sort(F.collect_list(F.struct("place", "repeated", "role", "tag", "body", "tokens"))).alias("turns"))
    shown = lambda x: F.concat(F.lit(TURN), x["tag"], F.lit("\n"), x["body"], F.lit(END + "\n"))
    lead = lambda x: F.length(x["tag"]) + len(TURN) + 1
    # Character places: sum what stands before each turn, then keep the new assistant turns.
    placed = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,length:int>>").alias("loss")),
        lambda a, x: F.struct(
            (a["at"] + F.length(shown(x))).alias("at"),
            F.when(
                (x["role"] == "assistant") & ~x["repeated"],
                F.concat(a["loss"], F.array(F.struct((a["at"] + lead(x)).alias("begin"), F.length(x["body"]).alias("length")))),
            )
            .otherwise(a["loss"])
            .alias("loss"),
        ),
    )
    return got.select(
        "conv_id",
        F.array_min(F.transform(F.filter("turns", lambda x: ~x["repeated"]), lambda x: x["place"])).alias("first_place"),
        F.array_join(F.transform("turns", shown), "").alias("text"),
        F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda x: x["repeated"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"),
        placed["loss"].alias("loss"),
        F.col("turns")[0]["role"].alias("first_role"),
    )


def read_back(found: DataFrame) -> DataFrame:
    """Digests per conversation from the windows' texts alone: turns that are not repeated, and the text under the loss.

    A digest of a conversation needs its text in one row; nothing else here gathers a conversation.
    """
    shown = F.split(F.col("text"), r"<\|end\|>\n")
    # The last part is what follows the last mark: nothing.
    bare = F.transform(F.slice(shown, 1, F.size(shown) - 1), lambda x: F.substring(x, len(TURN) + 1, 1 << 30))
    # A role has no newline, so the first one ends it.
    one = lambda x: F.concat(role_of(x.substr(F.lit(1), F.instr(x, "\n") - 1)), F.lit("\n"), unescaped(x.substr(F.instr(x, "\n") + 1, F.lit(1 << 30))), F.lit("\n"))
    # Repeated turns are those before the new ones; in the first window of a conversation with a system turn none is.
    new = F.slice(bare, F.col("n_repeated") + 1, F.size(bare))
    loss = F.array_join(F.transform("loss", lambda x: unescaped(F.col("text").substr(x["begin"] + 1, x["length"]))), "")
    w = found.select(
        "conv_id", "first_place", F.array_join(F.transform(new, one), "").alias("_turns"), loss.alias("_loss"), F.length("text").cast("long").alias("_chars"), (F.col("n_turns") - F.col("n_repeated")).cast("long").alias("_n")
    )
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_place", c))), lambda x: x[c]), "")
    return (
        w.groupBy("conv_id")
        .agg(F.sum("_n").alias("n_turns"), whole("_turns").alias("_t"), whole("_loss").alias("_l"), F.sum("_chars").alias("formatted_chars"))
        .select(
            "conv_id", "n_turns", F.sha2(F.col("_t").cast("binary"), 256).alias("turns_sha256"), F.length("_l").cast("long").alias("loss_chars"),
            F.sha2(F.col("_l").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
        )
    )
