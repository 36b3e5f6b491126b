"""Chat formatting: quotation linking, in DataFrame functions only.

A line's quote level is the number of ``>`` at its start. Consecutive lines of
one level are a passage. Quoted passages and what messages say themselves
(passages of level 0, their paragraphs and their lines) are normalised (lower
case, runs of other than letters and digits to one space) and hashed. A quoted
passage joins the first message that says it: of the same conversation if that
message is earlier, else the first of the other conversations (conversation id,
then turn; an id is no clock, so it may be the greater one). Passages no message says in whole are tried line
by line (lines of ``least`` normalised characters or more). The parent of a
message is the original of its quotes with the lowest level, then the longest
unit, then the latest turn. Root and depth come by pointer doubling; depth is the
reply order. Messages that quote each other in a ring are cut at the smallest
(conversation, turn) of the ring: that message has no parent.

What is said is aggregated per hash (and conversation) before any join, so a
text that thousands of messages say is one row to a join. Hash ties are broken by a
second hash. Null text: no lines, no links, text null. Null conv_id or turn:
never a parent. Repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

QUOTE = r"^[ \t]*(>[ \t]?)+"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def clean(text: Column) -> Column:
    """The text without its quotes and without lines that only announce one (they end in ``wrote:``)."""
    lines = F.split(text, "\n")
    own = F.filter(lines, lambda x: ~x.rlike(QUOTE) & ~x.rlike(r"^[^>]{0,200} wrote:[ \t\r]*$"))
    return F.when(text.rlike(r"(?m)^[ \t]*>"), F.trim(F.array_join(own, "\n"))).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """nr, conv_id, turn, lvl, run, body of every passage. messages: nr, conv_id, turn, text."""
    some = messages.where("text IS NOT NULL")
    quoting = F.col("text").rlike(r"(?m)^[ \t]*>")
    plain = some.where(~quoting).select("nr", "conv_id", "turn", F.lit(0).alias("lvl"), F.lit(0).cast("long").alias("run"), F.col("text").alias("body"))
    lines = some.where(quoting).select("nr", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("lvl", level(F.col("line"))).withColumn("line", F.regexp_replace("line", QUOTE, ""))
    by = Window.partitionBy("nr").orderBy("pos")
    lines = lines.withColumn("new", (F.col("lvl") != F.coalesce(F.lag("lvl").over(by), F.lit(-1))).cast("long")).withColumn("run", F.sum("new").over(by))
    runs = lines.groupBy("nr", "conv_id", "turn", "lvl", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return plain.unionByName(runs)


def units(body: Column, least: int) -> Column:
    """array of (kind, norm): the whole (0), its paragraphs (1), its lines (2)."""
    def of(kind: int, parts: Column) -> Column:
        return F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), normal(x).alias("norm")))

    all_ = F.concat(of(0, F.array(body)), of(1, F.split(body, r"\n[ \t\r]*\n")), of(2, F.split(body, "\n")))
    return F.filter(all_, lambda x: (x["norm"] != "") & ((x["kind"] == 0) | (F.length(x["norm"]) >= least)))


def link(conversations: DataFrame, least: int = 12) -> DataFrame:
    """conv_id, turn, role, clean_text, n_quotes, n_linked, parent_conv_id, parent_turn, root_conv_id, root_turn, depth."""
    m = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    m = m.select(F.xxhash64("conv_id", "turn", "role", "text").alias("nr"), "*")
    p = settle(passages(m.select("nr", "conv_id", "turn", "text").distinct()), "passages")
    u = p.withColumn("u", F.explode(units(F.col("body"), least))).select("nr", "conv_id", "turn", "lvl", "run", "u.kind", F.length("u.norm").alias("size"), F.xxhash64("u.norm").alias("h"), F.xxhash64(F.lit(1), "u.norm").alias("g"))
    quoted = settle(u.where("lvl > 0"), "quoted-units")
    asked = quoted.select("h", "g").distinct()
    said = settle(u.where("lvl = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("h", "g", "conv_id").agg(F.min("turn").alias("turn")).join(asked, ["h", "g"], "left_semi"), "said")
    first = said.groupBy("h", "g").agg(F.min(F.struct("conv_id", "turn")).alias("o")).select(F.col("h").alias("fh"), F.col("g").alias("fg"), F.col("o.conv_id").alias("fc"), F.col("o.turn").alias("ft"))
    here = said.select(F.col("h").alias("sh"), F.col("g").alias("sg"), F.col("conv_id").alias("sc"), F.col("turn").alias("st"))
    q = quoted.join(here, (F.col("h") == F.col("sh")) & (F.col("g") == F.col("sg")) & (F.col("conv_id") == F.col("sc")) & (F.col("st") < F.col("turn")), "left")
    # the first of all conversations, or, if that is the quote's own, the next one
    other = said.join(first, (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")) & (F.col("conv_id") != F.col("fc"))).groupBy("h", "g").agg(F.min(F.struct("conv_id", "turn")).alias("o"))
    both = first.join(other.select("h", "g", "o"), (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")), "left").select("fh", "fg", "fc", "ft", F.col("o.conv_id").alias("oc"), F.col("o.turn").alias("ot"))
    q = q.join(both, (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")), "left")
    far = F.when(F.col("fc") != F.col("conv_id"), F.struct("fc", "ft")).when(F.col("fc") == F.col("conv_id"), F.struct(F.col("oc").alias("fc"), F.col("ot").alias("ft")))
    q = q.withColumn("far", far).withColumn("pc", F.coalesce("sc", "far.fc")).withColumn("pt", F.when(F.col("sc").isNotNull(), F.col("st")).otherwise(F.col("far.ft")))
    # the best unit of each passage: the whole, then paragraphs, then lines, the longest first
    found = F.when(F.col("pc").isNotNull(), F.struct(-F.col("kind"), F.col("size"), (F.col("pc") == F.col("conv_id")).alias("near"), F.col("pt"), F.col("pc")))
    best = q.groupBy("nr", "run", "lvl").agg(F.max(found).alias("b"))
    per = best.groupBy("nr").agg(F.count("*").alias("n_quotes"), F.count("b").alias("n_linked"), F.max(F.when(F.col("b").isNotNull(), F.struct(-F.col("lvl"), F.col("b.size"), F.col("b.pt"), F.col("b.pc")))).alias("x"))
    parents = settle(per.select(F.col("nr").alias("nr2"), "n_quotes", "n_linked", F.col("x.pc").alias("parent_conv_id"), F.col("x.pt").alias("parent_turn")), "parents")
    linked = settle(m.join(parents, F.col("nr") == F.col("nr2"), "left").drop("nr2"), "linked")
    roots, cut = rooted(linked.where("parent_turn IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("parent_conv_id", "parent_turn")).alias("p")).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("p.parent_conv_id").alias("ac"), F.col("p.parent_turn").alias("at"), F.lit(1).alias("depth")))
    if cut is not None:
        linked = linked.join(cut, (F.col("conv_id") == F.col("cc")) & (F.col("turn") == F.col("ct")), "left")
        free = F.col("cc").isNull()
        linked = linked.withColumn("parent_conv_id", F.when(free, F.col("parent_conv_id"))).withColumn("parent_turn", F.when(free, F.col("parent_turn")))
    out = linked.join(roots, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return out.select("conv_id", "turn", "role", clean(F.col("text")).alias("clean_text"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_conv_id", "parent_turn", F.coalesce("ac", "conv_id").alias("root_conv_id"), F.when(F.col("ac").isNotNull(), F.col("at")).otherwise(F.col("turn")).alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))


def rooted(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(c, t, ac, at, depth; cc, ct of the messages where rings were cut, if there were any).

    links: c, t, ac, at, depth 1. Pointer doubling until no ancestor has a parent: log2 of
    the longest thread rounds, and one more than log2 of all links if there is a ring.
    """
    links = settle(links, "threads")
    state, rounds = links.withColumn("depth", F.col("depth").cast("long")).withColumn("low", F.struct("c", "t")), links.count().bit_length() + 1
    for _ in range(rounds):
        up = state.select(F.col("c").alias("uc"), F.col("t").alias("ut"), F.col("ac").alias("nc"), F.col("at").alias("nt"), F.col("depth").alias("more"), F.col("low").alias("low2"))
        j = state.join(up, (F.col("ac") == F.col("uc")) & (F.col("at") == F.col("ut")), "left")
        state = settle(j.select("c", "t", F.coalesce("nc", "ac").alias("ac"), F.when(F.col("nc").isNotNull(), F.col("nt")).otherwise(F.col("at")).alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("nc").isNotNull().alias("moved")), "threads")
        if not state.where("moved").limit(1).count():
            return state.drop("moved", "low"), None
        moved = state.where("moved")
        state = state.drop("moved")
    # what a message still climbs to lies on a ring, and the least message it has passed is the ring's
    ends = moved.select(F.col("ac").alias("ec"), F.col("at").alias("et")).distinct()
    rings = state.join(ends, (F.col("c") == F.col("ec")) & (F.col("t") == F.col("et"))).select(F.col("low.c").alias("cc"), F.col("low.t").alias("ct")).distinct()
    rings = settle(rings, "rings")
    return rooted(links.join(rings, (F.col("c") == F.col("cc")) & (F.col("t") == F.col("ct")), "left_anti"))[0], rings
