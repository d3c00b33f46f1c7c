"""Chat formatting in budgeted windows, in DataFrame functions only.

Turns are sorted over range partitions and numbered through, so that neither a long conversation
nor many turns of one number meet in one task.  Prefix sums of the turns' tokens choose windows of
whole turns: a window takes turns as long as the retained system turn, the repeated history and
the turns themselves stay within the budget.  Where a window ends follows from where it begins;
this is worked out for every turn, page by page of turns, from token counts alone, and only the
pages' transitions (from a first turn in the page to the first window behind it) are followed in
order along a conversation.  Texts are then fetched by the turns' numbers and gathered window by
window.  Each window behind the conversation's first system turn begins with it, wherever it stands, and repeats at most
``HISTORY_TURNS`` turns of at most ``HISTORY_TOKENS`` tokens before its own; repeated assistant
turns are not targets again.

A turn is written as ``### role: text</turn>`` and a line end.  Texts and roles are escaped so
that neither marker can occur in them: backslash, ``###`` and ``</turn>`` become ``\\b``,
``\\h`` and ``\\t``, and in roles ``:`` becomes ``\\c``.  Since every backslash that remains is
followed by one of these letters, replacing them in the opposite order restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialise

BUDGET = 1024
HISTORY_TURNS, HISTORY_TOKENS = 2, 256
#: Turns that are looked at together; more if a window can hold more.
PAGE = 256
OPEN, CLOSE = "### ", "</turn>\n"
#: Tokens that a turn's markers count.
MARKER_TOKENS = 6
#: Characters of a text that decide its range; of monotonic ids, the bits of the place in the partition; rows of a partition table that may be broadcast.
RANGE_CHARS, PLACE_BITS, PARTITIONS = 64, 33, 1_000_000
_ESCAPES = (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h"))


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def word_tokens(text: Column) -> Column:
    """Words and single other characters, a cheap stand-in for a tokenizer."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def numbered(turns: DataFrame, tokens=word_tokens) -> DataFrame:
    """(at, conv_id, turn, role, text, k): all turns of all conversations numbered through from 0, in order; k are a turn's tokens."""
    text = F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), (tokens(text) + MARKER_TOKENS).cast("long").alias("k"))
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("conv_id", "turn", "role", "text")
    # The sort covers all columns: whatever order rows arrive in, a partition numbers them alike.
    rows = materialise(ranged.withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", PLACE_BITS)
    # A row for each partition.
    sizes = rows.groupBy(part.alias("part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = materialise(sizes.select("part", before.alias("begin")))
    placed = join_small(rows.withColumn("part", part), begins, "part", most=PARTITIONS)
    return placed.select((F.col("id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + F.col("begin")).alias("at"), "conv_id", "turn", "role", "text", "k")


def spans(turns: DataFrame, budget: int, history_turns: int, history_tokens: int, page: int) -> DataFrame:
    """(conv_id, page, first, h, s, e, system): of each window the turns h..e-1 that it holds, of which s..e-1 are its own.

    ``turns`` are numbered; first is the conversation's first number, system that of the system
    turn to be retained in front, the first one wherever it stands; null if there is none, or none
    before the window.  No text is touched.
    """
    most = max(1, budget // MARKER_TOKENS)  # turns of a window, at least so long each
    page = max(page, most + 1)
    slim = turns.select("conv_id", "at", "k", (F.col("role") == "system").alias("is_system"))
    convs = slim.groupBy("conv_id").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min(F.when(F.col("is_system"), F.struct("at", "k"))).alias("y"))
    opening = convs.select(F.col("conv_id").alias("c"), "first", "last", F.col("y.at").alias("system"), F.coalesce("y.k", F.lit(0).cast("long")).alias("system_k"))
    # A page also sees the turns before it that its first windows may repeat, and those that its last windows may reach.
    own, inside = F.floor(F.col("at") / page).cast("long"), F.pmod("at", F.lit(page))
    seen = F.concat(F.array(own), F.when(inside < most, F.array(own - 1)).otherwise(F.array().cast("array<bigint>")), F.when(inside >= page - history_turns, F.array(own + 1)).otherwise(F.array().cast("array<bigint>")))
    pages = slim.select("conv_id", "at", "k", F.explode(seen).alias("page")).groupBy("conv_id", "page").agg(F.sort_array(F.collect_list(F.struct("at", "k"))).alias("t"))
    pages = pages.join(opening, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    # low: the number of the array's first turn; begin, end: the page's own turns as places in it.
    begin, end = F.greatest(F.col("page") * page, "first"), F.least((F.col("page") + 1) * page - 1, "last") + 1
    pages = pages.where(begin < end).withColumn("low", F.get("t", F.lit(0))["at"]).withColumn("begin", (begin - F.col("low")).cast("int")).withColumn("end", (end - F.col("low")).cast("int"))
    sums = F.aggregate("t", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["k"])))
    pages = pages.select("conv_id", "page", "first", "last", "system", "system_k", "low", "begin", "end", sums.alias("sums"))

    def window(i: Column) -> Column:
        """The window whose first own turn is in place i; it needs no copy of a system turn that it begins with or that comes later."""
        upto = lambda x: F.get("sums", x)
        held = lambda h: F.when(F.col("low") + h <= F.col("system"), F.lit(0).cast("long")).otherwise(F.col("system_k"))
        options = F.sequence(F.greatest(F.lit(0), i - history_turns), i)
        fits = F.filter(options, lambda h: (h == i) | (upto(i) - upto(h) <= history_tokens) & (held(h) + upto(i + 1) - upto(h) <= budget))
        began = lambda h: F.struct(h.alias("h"), (budget - held(h) + upto(h)).alias("limit"))
        chosen = F.transform(F.slice(fits, 1, 1), began)
        # Sums rise, so that as many turns follow as sums stay within the limit.
        ends = F.transform(chosen, lambda w: F.struct((F.col("low") + w["h"]).alias("h"), (F.col("low") + i).alias("s"), (F.col("low") + i + 1 + F.size(F.filter(F.slice("sums", i + 3, most), lambda x: x <= w["limit"]))).alias("e")))
        return F.get(ends, F.lit(0))

    pages = materialise(pages.select("conv_id", "page", "first", "last", "system", "low", "begin", F.transform(F.sequence("begin", F.col("end") - 1), window).alias("w")))
    return _followed(pages, page)


def _followed(pages: DataFrame, page: int) -> DataFrame:
    """The windows that come to be, of those that could begin at each turn of each page."""
    long = F.floor(F.col("last") / page) != F.floor(F.col("first") / page)
    start = F.col("low") + F.col("begin")
    # From the back: where the window that begins here leads to, behind the page.
    past = start + F.size("w")
    leads = F.aggregate(F.reverse("w"), F.array().cast("array<bigint>"), lambda acc, x: F.concat(F.array(F.when(x["e"] >= past, x["e"]).otherwise(F.get(acc, (x["e"] - x["s"] - 1).cast("int")))), acc))
    # Of conversations over several pages, 8 bytes a turn meet in order; windows of others begin with their first turn.
    gathered = pages.where(long).select("conv_id", "page", "first", start.alias("start"), leads.alias("leads")).groupBy("conv_id", "first").agg(F.sort_array(F.collect_list(F.struct("page", "start", "leads"))).alias("p"))
    opened = F.struct(F.col("first").alias("at"), F.array().cast("array<struct<page:bigint,entry:bigint>>").alias("out"))
    entries = F.aggregate(
        "p",
        opened,
        lambda acc, x: F.struct(F.get(x["leads"], (acc["at"] - x["start"]).cast("int")).alias("at"), F.concat(acc["out"], F.array(F.struct(x["page"].alias("page"), acc["at"].alias("entry")))).alias("out")),
        lambda acc: acc["out"],
    )
    entered = gathered.select(F.col("first").alias("f"), F.inline(entries)).withColumnRenamed("page", "p")
    placed = pages.join(entered, (F.col("first") == F.col("f")) & (F.col("page") == F.col("p")), "left").withColumn("entry", F.coalesce("entry", "first"))
    begun = F.struct(F.col("entry").alias("at"), F.array().cast("array<struct<h:bigint,s:bigint,e:bigint>>").alias("out"))
    taken = F.aggregate(
        "w",
        begun,
        lambda acc, x: F.when(x["s"] == acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    return placed.select("conv_id", "page", "first", "last", "system", F.inline(taken)).withColumn("system", F.when(F.col("h") > F.col("system"), F.col("system")))


def windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    page: int = PAGE,
    tokens=word_tokens,
) -> DataFrame:
    """Windows of ``turns(conv_id, turn, role, text)``: one row for each.

    conv_id, window (the place of its first own turn in the conversation, from 0), formatted
    (the text), repeated (turns at its start that are not its own: system turn and history),
    n_turns, n_tokens, over_budget (a single turn that does not fit is a window by itself,
    uncut), loss_spans (array of start, length in code points of the formatted text: the escaped
    assistant texts that are targets).

    Nulls: null role and text are empty, a null turn sorts first, a null conv_id is a
    conversation.  Ties in turn are ordered by role, then text; repeated rows are turns of
    their own.  Turn numbers may be negative or leave gaps.  A text of any length stays whole.
    An empty table gives no windows.  Other columns, whatever their names, are ignored.
    """
    rows = numbered(turns, tokens)
    cut = materialise(spans(rows, budget, history_turns, history_tokens, page))
    listed = cut.select("conv_id", "first", F.col("s").alias("own"), F.explode(F.sequence("h", F.col("e") - 1)).alias("at"))
    texts = listed.join(rows.select("at", "role", "text", "k"), "at").withColumn("mine", F.col("at") >= F.col("own"))
    # The system turn goes to every page of its conversation, and there to the windows.
    kept = cut.where("system is not null")
    opening = kept.select(F.col("system").alias("at"), "page").distinct().join(rows.select("at", "role", "text", "k"), "at").withColumnRenamed("at", "system")
    system = kept.select("conv_id", "first", "system", "page", F.col("s").alias("own")).join(opening, ["system", "page"])
    pieces = texts.select("conv_id", "first", "own", "at", "role", "text", "k", "mine").unionByName(system.select("conv_id", "first", "own", F.lit(-1).cast("long").alias("at"), "role", "text", "k", F.lit(False).alias("mine")))
    gathered = pieces.groupBy("conv_id", "first", "own").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "k", "mine"))).alias("t"))
    written = F.transform(
        "t",
        lambda x: F.struct(
            F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit(": ")).alias("head"),
            escape(x["text"]).alias("body"),
            (x["mine"] & (x["role"] == "assistant")).alias("target"),
            x["mine"].alias("mine"),
        ),
    )
    out = gathered.select("conv_id", (F.col("own") - F.col("first")).alias("window"), F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + x["k"]).alias("n_tokens"), written.alias("x"))
    ends = F.aggregate("x", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE))))
    out = out.withColumn("ends", ends)
    loss = F.filter(F.transform("x", lambda x, i: F.struct((F.get("ends", i) + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"), x["target"].alias("target"))), lambda s: s["target"])
    return out.select(
        "conv_id",
        "window",
        F.array_join(F.transform("x", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.size(F.filter("x", lambda x: ~x["mine"])).alias("repeated"),
        F.size("x").alias("n_turns"),
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
        F.transform(loss, lambda s: F.struct(s["start"], s["length"])).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its windows say: the turns once each, and the text under the loss mask.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.  A
    digest over a whole conversation needs that conversation in one value (2 GB at most).
    """
    # A text ends in CLOSE, so the last piece is empty.
    pieces = F.filter(F.split("formatted", "</turn>\n"), lambda p: p != "")
    own = F.slice(pieces, F.col("repeated") + 1, F.size(pieces))
    # "### role: text": the role is escaped and holds no colon.
    head = lambda p: F.substring_index(p, ":", 1)
    told = F.transform(own, lambda p: F.concat(unescape_role(F.substring(head(p), len(OPEN) + 1, 2**31 - 1)), F.lit("\n"), unescape(F.substring(p, F.length(head(p)) + 3, 2**31 - 1)), F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    parts = formatted.select("conv_id", "window", F.array_join(told, "").alias("told"), F.size(own).alias("n"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("chars"))
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "told", "loss"))).alias("parts"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    text = F.array_join(F.col("parts.loss"), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.col("parts.told"), ""), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
