"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A text's lines (split at \\n, trimmed of spaces for comparison) are kept at their
first occurrence, which is the smallest (doc_id, line number). Later copies go,
and so does a line within the allowed edits of a line whose first occurrence is
earlier. Equal lines are one class (two 64-bit hashes). The allowed edits t grow
with the length (``classes``: from so many characters on, so many edits); the
shorter line of a pair decides. A line of length l is cut into t + 1 even
segments; a line within t edits and no shorter than it shares one of them, at a place
that only the lengths decide (the multi-match window), so a longer line probes
for each shorter length the hashes of those substrings. Candidates are verified
with Spark's banded levenshtein(a, b, t). It is not bit-parallel: a bit-parallel
automaton would have to be a fold over characters, which Spark interprets.

Asked is only whether there is an earlier line within the edits, so no bucket of
a shared segment is turned into pairs unless it is small (``small`` rows). In
each bucket all lines meet the earliest one; buckets in which a line is still
open are cut on: what lies left and right of the shared segment may hold i and
t - i edits (i: the number of the segment), and the longer of the two is cut
into segments again, which makes smaller buckets that still hold every link.
The rows grow in proportion to a group, never with its square, and nothing is
capped or sampled. Lines shorter than the first class are equal or not.

Only hashes are shuffled until candidates are known; bitmaps of constant size
pass over most keys that no other line has, and most texts without a candidate.
They only leave out what could not match.

Empty lines stay where they are and are never duplicates. A null text has no
lines and stays null. Different texts of one doc_id (or of null) are documents
of their own, in the order of a hash; a row repeated whole is one document, and
each copy of the row gets its result. A text whose lines all go becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, settle

#: (least length, allowed edits).
CLASSES = ((16, 1),)
#: Powers of two.
FILTER_BITS = 1 << 20
KEY_FILTER_BITS = 1 << 25


def allowed(length: str, classes: tuple) -> str:
    """The edits allowed to a line of that length, as SQL."""
    out = "0"
    for least, t in classes:
        out = f"if({length} >= {least}, {t}, {out})"
    return out


def places(t: int) -> list[tuple[int, int, int, int]]:
    """(edits, how much longer, number of the segment, shift) of all substrings to look at (the multi-match window)."""
    return [(t, d, i, s) for d in range(t + 1) for i in range(t + 1) for s in range(max(-i, d - (t - i)), min(i, d + (t - i)) + 1)]


def cut(s: str, n: str, t: str, d: str, i: str, shift: str) -> dict[str, str]:
    """A segment of a string of n - d characters, where the string s (of length n) has it, as SQL.

    t characters or fewer cannot be cut into t + 1 segments: they are one empty one (`tiny`).
    """
    size = f"({n} - {d})"
    tiny = f"({size} <= {t})"
    at = f"cast(if({tiny}, 0, {size} * {i} div ({t} + 1) + {shift}) as int)"
    wide = f"cast(if({tiny}, 0, {size} * ({i} + 1) div ({t} + 1) - {size} * {i} div ({t} + 1)) as int)"
    fits = f"{size} >= 0 AND {at} >= 0 AND {at} + {wide} <= {n} AND (NOT {tiny} OR ({i} = 0 AND {shift} = 0))"
    return {"size": size, "tiny": tiny, "at": at, "wide": wide, "fits": fits, "mark": f"{t}, {size}, {i}, substring({s}, {at} + 1, {wide})"}


def _placed(rows: DataFrame, s: str, edits: list[int], fits: str, mark: str) -> DataFrame:
    """rows for every place of the string s of which `fits` is true, with t, d, i, s, at, wide, key, own and tiny."""
    options = f"array({', '.join(f"named_struct('t', {t}, 'd', {d}, 'i', {i}, 's', {x})" for t, d, i, x in (y for t in edits for y in places(t)))})"
    c = cut(s, f"length({s})", "o.t", "o.d", "o.i", "o.s")
    some = rows.withColumn("o", F.explode(F.expr(options))).where(fits.format(size=c["size"])).withColumn("at", F.expr(c["at"])).withColumn("wide", F.expr(c["wide"])).withColumn("tiny", F.expr(c["tiny"]))
    some = some.where(f"{c['size']} >= 0 AND at >= 0 AND at + wide <= length({s}) AND (NOT tiny OR (o.i = 0 AND o.s = 0))")
    return some.withColumn("key", F.expr(f"xxhash64({mark}o.t, {c['size']}, o.i, substring({s}, at + 1, wide))")).withColumn("own", F.expr("o.d = 0 AND o.s = 0"))


def keys(lines: DataFrame, classes: tuple) -> DataFrame:
    """The lines (line) at every place, with its key."""
    return _placed(lines.where(f"length(line) >= {classes[0][0]}"), "line", [t for _, t in classes], f"{allowed('{size}', classes)} = o.t", "")


def after(placed: DataFrame, s: str, rest: str) -> DataFrame:
    """key, own, tiny, c, ord, line, far (how much longer than the shorter line), parts: what is still to be compared beside the shared segment."""
    left, right = f"named_struct('s', substring({s}, 1, at), 't', o.i)", f"named_struct('s', substring({s}, at + wide + 1, length({s})), 't', o.t - o.i)"
    two = f"if(tiny, array(named_struct('s', {s}, 't', o.t)), filter(array({left}, {right}), x -> x.t > 0))"
    return placed.withColumn("parts", F.expr(f"concat({rest}, {two})")).select("key", "own", "tiny", "c", "ord", "line", "far", "parts")


def refined(state: DataFrame, most: int) -> DataFrame:
    """The rows (part number p is to be cut) in smaller buckets.

    If one part is left, all of the difference in length lies in it, so a row looks for that one only.
    """
    rows = state.withColumn("cut", F.expr("get(parts, p)")).withColumn("rest", F.expr("filter(parts, (x, i) -> i <> p)")).withColumnRenamed("key", "above").drop("own", "tiny")
    placed = _placed(rows, "cut.s", list(range(1, most + 1)), "cut.t = o.t AND (size(rest) > 0 OR far = o.d)", "above, p, ")
    return after(placed, "cut.s", "rest")


def _bit(column: str, bits: int) -> tuple[Column, Column]:
    bit = F.xxhash64(column).bitwiseAND(F.lit(bits - 1))
    return F.shiftright(bit, 6), bit.bitwiseAND(F.lit(63)).cast("int")


def marked(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of hashed ids in words of 64 bits (bits / 64 rows at most, whatever the input)."""
    word, at = _bit(column, bits)
    return ids.select(word.alias("word"), at.alias("at")).select("word", F.expr("shiftleft(1L, at)").alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits"))


def held(rows: DataFrame, column: str, bitmap: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose id may be in the bitmap (all that are, and a few more)."""
    word, at = _bit(column, bits)
    r = rows.withColumn("_word", word).withColumn("_at", at)
    r = r.join(F.broadcast(bitmap), F.col("_word") == F.col("word"))  # constant size
    return r.where("bit_get(bits, _at) = 1").drop("_word", "_at", "word", "bits")


def near(rows: DataFrame, classes: tuple, small: int = 16) -> list[DataFrame]:
    """Written tables of the lines (c) that have an earlier one within the allowed edits.

    rows: key, own, tiny, c (id of the line), ord, line, far, parts.
    """
    most, out = max(t for _, t in classes), []
    limit = lambda a, b: allowed(f"least(length({a}), length({b}))", classes)
    close = lambda a, b: F.expr(" OR ".join(f"({limit(a, b)} = {t} AND levenshtein({a}, {b}, {t}) >= 0)" for t in sorted({t for _, t in classes})))
    while True:
        longest = [F.max(F.expr(f"length(get(parts, {k}).s) - get(parts, {k}).t")).alias(f"l{k}") for k in range(most)]
        hubs = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any"), F.min(F.struct("ord", "c", "line")).alias("hub"), *longest).where("n > 1 AND any")
        p = F.expr(f"array_position(array({', '.join(f'l{k}' for k in range(most))}), greatest({', '.join(f'l{k}' for k in range(most))}, -1)) - 1")
        hubs = hubs.select(F.col("key").alias("key2"), "n", F.col("hub.c").alias("hub_c"), F.col("hub.line").alias("hub_line"), p.cast("int").alias("p"))
        met = settle(rows.join(hubs, F.col("key") == F.col("key2")).withColumn("done", (F.col("c") != F.col("hub_c")) & close("line", "hub_line")).drop("hub_line", "key2"), "line-hubs")
        got = settle(met.where("done").select("c").distinct(), "line-near")
        out.append(got)
        met2 = met.join(got.select(F.col("c").alias("c2")), F.col("c") == F.col("c2"), "left").withColumn("open", F.col("c2").isNull() & (F.col("c") != F.col("hub_c"))).drop("c2", "done", "hub_c")
        live = met2.groupBy("key").agg(F.max("open").alias("some")).where("some").select(F.col("key").alias("key2"))
        state = settle(met2.join(live, F.col("key") == F.col("key2")).drop("key2"), "line-open")
        few = state.where(F.col("tiny") | (F.col("n") <= small))
        y = few.where("open").select("key", F.col("c").alias("b"), F.col("ord").alias("bo"), F.col("line").alias("bl"), F.col("own").alias("bown"))
        x = few.select(F.col("key").alias("key2"), F.col("ord").alias("ao"), F.col("line").alias("al"), F.col("own").alias("aown"))
        pairs = y.join(x, (F.col("key") == F.col("key2")) & (F.col("ao") < F.col("bo")) & (F.col("aown") | F.col("bown"))).where(close("al", "bl"))
        out.append(settle(pairs.select(F.col("b").alias("c")).distinct(), "line-near"))
        smaller = settle(refined(state.where(~F.col("tiny") & (F.col("n") > small)), most), "line-cut")
        forget(rows, met, state)
        rows = smaller
        if not rows.limit(1).count():
            forget(rows)
            return out


def duplicates(docs: DataFrame, classes: tuple = CLASSES, small: int = 16) -> DataFrame:
    """nr, doc_id, places (positions of the lines that go), for documents that lose one. docs: nr, doc_id, text."""
    lines = docs.where("text IS NOT NULL").select("nr", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    lines = lines.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), "line"))
    ord_ = F.min(F.struct("doc_id", "nr", "pos")).alias("first")
    kinds = settle(lines.groupBy("h", "g").agg(ord_, F.count("*").alias("n")), "line-classes")
    long = keys(lines.select("h", "line"), classes).select("h", "key", "own")
    shared = long.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("any")).where("lo <> hi AND any").select(F.col("key").alias("key2"))
    shared = settle(shared, "line-buckets")
    some = held(long, "key", marked(shared, "key2", KEY_FILTER_BITS), KEY_FILTER_BITS)
    asked = settle(some.join(shared, F.col("key") == F.col("key2")).select("h").distinct().withColumnRenamed("h", "h2"), "line-asked")
    # texts of the candidates, from the documents of their first occurrences only
    places = settle(kinds.join(asked, F.col("h") == F.col("h2")).select("h", "g", "first", F.col("first.nr").alias("nr2"), F.col("first.pos").alias("pos2")), "line-places")
    texts = held(docs.where("text IS NOT NULL").select("nr", "text"), "nr", marked(places, "nr2"))
    at = texts.join(places.groupBy("nr2").agg(F.collect_list(F.struct("h", "g", "first", "pos2")).alias("want")), F.col("nr") == F.col("nr2"))
    at = at.select(F.split("text", "\n").alias("all"), F.explode("want").alias("w")).select(F.struct("w.h", "w.g").alias("c"), F.col("w.first").alias("ord"), F.trim(F.get("all", F.col("w.pos2"))).alias("line"))
    at = settle(at, "line-texts")
    rows = keys(at, classes).join(shared, F.col("key") == F.col("key2"), "left_semi").withColumn("far", F.col("o.d"))
    rows = settle(after(rows, "line", "cast(array() as array<struct<s: string, t: int>>)"), "line-cut")
    found = near(rows, classes, small)
    gone = found[0]
    for f in found[1:]:
        gone = gone.union(f)
    gone = gone.distinct().select(F.col("c.h").alias("nh"), F.col("c.g").alias("ng"))
    going = kinds.join(gone, (F.col("h") == F.col("nh")) & (F.col("g") == F.col("ng")), "left").where("n > 1 OR nh IS NOT NULL")
    going = settle(going.select(F.col("h").alias("dh"), F.col("g").alias("dg"), F.col("nh").isNotNull().alias("all"), F.col("first.nr").alias("fnr"), F.col("first.pos").alias("fpos")), "line-going")
    out = lines.select("nr", "doc_id", "pos", "h", "g").join(going, (F.col("h") == F.col("dh")) & (F.col("g") == F.col("dg"))).where("all OR nr <> fnr OR pos <> fpos")
    out = settle(out.groupBy("nr", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("places")), "line-places-going")
    forget(kinds, shared, asked, places, at, going, *found)
    return out


def dedup(docs: DataFrame, classes: tuple = CLASSES, small: int = 16) -> DataFrame:
    """docs with its text column deduplicated, and n_lines, n_removed (columns of these names are replaced).

    classes: (least length, allowed edits), both ascending, lengths over three times the edits.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base = docs.select(F.xxhash64("doc_id", "text").alias("nr"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"))
    gone = duplicates(base.select("nr", F.col("d.doc_id").alias("doc_id"), F.col("d.text").alias("text")), classes, small)
    rows = base.join(gone.select(F.col("nr").alias("nr2"), F.col("doc_id").alias("id2"), "places"), (F.col("nr") == F.col("nr2")) & F.col("d.doc_id").eqNullSafe(F.col("id2")), "left")
    parts = F.split("d.text", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("places", i)), "\n")
    text = F.when(F.col("places").isNull() | F.col("d.text").isNull(), F.col("d.text")).otherwise(kept)
    lost = F.coalesce(F.size("places"), F.lit(0))
    cols = [text.alias(c) if c == "text" else F.col(f"d.`{c}`").alias(c) for c in own]
    return rows.select(*cols, F.when(F.col("d.text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"), F.when(F.col("places").isNull(), 0).otherwise(lost).alias("n_removed"))
