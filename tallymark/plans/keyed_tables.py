"""Registered queries of the keyed detectors (green lists by context, n-grams under a gate, soft edit distances by blocks),
of candidates and alignment, and of tables that outlive a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection as D
from ..operators import keyed as K
from ..operators import results as C
from ..sources import files as IO
from .lake import GEN_SQL, POS_SQL, TOK_SQL, gen, green_sql, table, tail_sql
from .registry import _r, _toks, query

VOCABULARY, KEY = 256, 15485863


def _lists_sql() -> str:
    """The green list of each context of one id, made one by one: 64 hex digits of four ids each."""
    rows = []
    for c in range(VOCABULARY):
        own = set(K.permutation(VOCABULARY, K.context_seed(str(c), KEY))[: VOCABULARY // 2].tolist())
        rows.append(f"({c}, '{''.join(f'{sum((4 * d + k in own) << k for k in range(4)):x}' for d in range(VOCABULARY // 4))}')")
    return f"lists AS (SELECT * FROM (VALUES {', '.join(rows)}) v(c, bits))"


@query(f"""WITH {POS_SQL}, {_lists_sql()}, p AS (SELECT doc_id, CAST('0x' || substr(md5(t[i-1]), 1, 2) AS INTEGER) AS c, CAST('0x' || substr(md5(t[i]), 1, 2) AS INTEGER) AS x FROM pos WHERE i >= 2),
s AS (SELECT doc_id, count(*) AS n_scored, CAST(sum((CAST('0x' || substr(bits, 1 + x // 4, 1) AS INTEGER) >> (x % 4)) & 1) AS BIGINT) AS n_green FROM p JOIN lists USING (c) GROUP BY 1)
SELECT tok.doc_id, coalesce(n_scored, 0) AS n_scored, coalesce(n_green, 0) AS n_green FROM tok LEFT JOIN s ON tok.doc_id = s.doc_id""")
def d4_seeded_permutation(spark, d):
    """Green lists from a seeded permutation, the seed from a digest of the context: a table of bits by distinct context."""
    x = _toks(spark, d).select("doc_id", K.token_ids(F.col("t")).alias("ids"))
    return K.keyed_scores(x, ["doc_id"], "ids", VOCABULARY, 0.5, 2, KEY)


@query(f"""WITH {TOK_SQL}, x AS (SELECT doc_id, t[1:doc_id % 9] AS p, CASE WHEN doc_id % 5 = 0 THEN t[len(t):] ELSE t[doc_id % 9 + 1:] END AS s FROM tok), w AS (SELECT doc_id, len(p) AS k, CASE WHEN len(s) <= 1 THEN p ELSE list_concat(p, s) END AS t FROM x),
g AS (SELECT doc_id, unnest(range(greatest(k, 2) + 1, len(t) + 1)) AS i, t FROM w), c AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({green_sql("t[i-1] || ',' || t[i-2]", 't[i]')}) AS g FROM g GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_scored, coalesce(g, 0) AS n_green, coalesce(n, 0) < 1 AS invalid FROM w LEFT JOIN c ON w.doc_id = c.doc_id""")
def d1_segments(spark, d):
    """Prefix and suffix as one sequence, scored from the suffix on; a suffix of one token or none is dropped, which leaves nothing to score."""
    k = (F.col("doc_id") % 9).cast("int")
    suffix = F.when(F.col("doc_id") % 5 == 0, F.slice("t", F.greatest(F.size("t"), F.lit(1)), F.lit(1))).otherwise(F.slice("t", k + 1, F.greatest(F.size("t"), F.lit(1))))
    x = _toks(spark, d).select("doc_id", D.segments(F.slice("t", F.lit(1), k), suffix).alias("s"))
    x = D.scored(x, D.green_mask(F.col("s.tokens"), 3, start=F.greatest(F.col("s.prefix_len"), F.lit(2))))
    return x.select("doc_id", F.col("n_scored").cast("long").alias("n_scored"), F.col("n_green").cast("long").alias("n_green"), "invalid")


_BIT = "substr(md5(vec_id || '|' || r // 2), 1, 1) >= '8'"


@query(f"""WITH e AS (SELECT vec_id, label, embedding AS x, label % len(embedding) AS t FROM embeddings WHERE vec_id IS NOT NULL), u AS (SELECT vec_id, t, unnest(range(0, len(x))) AS i, unnest(x) AS v, x[t + 1] AS own, len(x) AS n FROM e),
k AS (SELECT vec_id, t, n, count(*) FILTER (v > own OR (v = own AND i < t)) AS r FROM u GROUP BY ALL)
SELECT vec_id, CAST(r AS INTEGER) AS rank, CASE WHEN r // 2 * 2 + 1 < n THEN (r % 2 = 1) = ({_BIT}) ELSE {_BIT} END AS green FROM k""")
def d14_pair_bits(spark, d):
    """Whether the labelled token is the green one of its pair by logit, in the row (D14 with bits that SQL can draw too)."""
    e = table(spark, d, "embeddings").where("vec_id IS NOT NULL")
    t = (F.col("label") % F.size("embedding")).cast("int")
    return e.select("vec_id", D.pair_rank(F.col("embedding"), t).alias("rank"), D.pair_bit_green(F.col("embedding"), t, F.col("vec_id")).alias("green"))


GATE_SQL = "CAST('0x' || substr(md5({c}), 1, 1) AS INTEGER) / 16.0 > 0.4"


def _gate(c, _):
    """A stand-in for a learned switch of the context."""
    return F.conv(F.substring(F.md5(c), 1, 1), 16, 10).cast("double") / 16


def _gated_sql(distinct: str) -> str:
    return f"""WITH {POS_SQL}, g AS (SELECT {distinct} doc_id, t[i-1] || ',' || t[i-2] AS c, t[i] AS x FROM pos WHERE i >= 3),
s AS (SELECT doc_id, count(*) FILTER ({GATE_SQL.format(c='c')}) AS n_scored, count(*) FILTER ({GATE_SQL.format(c='c')} AND {green_sql('c', 'x')}) AS n_green FROM g GROUP BY 1),
z AS (SELECT *, CASE WHEN n_scored = 0 THEN 0.0::DOUBLE ELSE (n_green - 0.5 * n_scored) / sqrt(n_scored * 0.25) END AS z FROM s)
SELECT doc_id, n_scored, n_green, round(z, 6) AS z, round(CASE WHEN n_scored = 0 THEN 1.0::DOUBLE ELSE {tail_sql('z')} END, 6) AS p FROM z"""


def _gated(spark, d, repeats):
    x = D.ngram_scores(_toks(spark, d), ["doc_id"], "t", 3, switch=_gate, threshold=0.4, repeats=repeats)
    return x.select("doc_id", "n_scored", "n_green", _r(F.col("z"), "z"), _r(F.col("p"), "p"))


@query(_gated_sql("DISTINCT"))
def d16_gated_ngram_score(spark, d):
    """Distinct n-grams whose context's switch is over the threshold; none: z 0, p 1."""
    return _gated(spark, d, False)


@query(_gated_sql(""))
def d16_repeated_ngram_score(spark, d):
    """The same with every n-gram as often as it occurs."""
    return _gated(spark, d, True)


@query()
def d20_edit_p_value(spark, d):
    """Soft edit distance of every document's ids to the key against a hundred random keys, in blocks of bounded size; the least distance and p."""
    x = _toks(spark, d).select(F.monotonically_increasing_id().alias("nr"), "doc_id", K.token_ids(F.col("t")).alias("ids"))
    x = IO.kept(x, "edit-ids")
    p = K.null_p_value(K.edit_statistics(x, ["nr"], "ids", VOCABULARY), ["nr"])
    return x.join(p, "nr", "left").select("doc_id", F.round("stat", 4).alias("stat"), F.coalesce("p", F.lit(1.0)).alias("p"))


@query("""WITH m AS (SELECT user_id, event_id % 20 AS run, min(value) AS stat FROM events GROUP BY 1, 2), o AS (SELECT user_id AS u, stat AS own FROM m WHERE run = 0)
SELECT user_id, own AS stat, CASE WHEN own IS NULL THEN 1.0::DOUBLE ELSE (count(*) FILTER (run <> 0 AND stat <= own) + 1.0::DOUBLE) / (count(*) FILTER (run <> 0) + 1) END AS p FROM m LEFT JOIN o ON user_id = u GROUP BY 1, 2""")
def d20_null_p_value(spark, d):
    """p of the statistic of run 0 against those of the other runs, each the least of its parts (the last steps of D20)."""
    e = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 20).alias("run")).agg(F.min("value").alias("stat"))
    return K.null_p_value(e, ["user_id"])


# --- candidates and alignment ----------------------------------------------------------------


@query(f"""WITH {GEN_SQL}, g AS (SELECT *, CASE WHEN passed AND id % 50 = 49 THEN NULL WHEN toxic THEN 'transform_failure' ELSE 'empty_suffix' END AS why FROM gen WHERE passed IS NOT NULL),
f AS (SELECT task, min(id) FILTER (why IS NULL) AS chosen FROM g GROUP BY 1)
SELECT f.task, chosen, why AS reason, id AS index FROM f JOIN g ON f.task IS NOT DISTINCT FROM g.task WHERE why IS NOT NULL AND (chosen IS NULL OR id < chosen)""")
def d24_skipped_by_reason(spark, d):
    """The indexes that were passed over before each task's first valid completion, by reason, kept as bitmaps."""
    why = F.when(F.col("passed") & (F.col("id") % 50 == 49), F.lit(None)).when(F.coalesce("toxic", F.lit(False)), "transform_failure").otherwise("empty_suffix")
    first, bitmaps = D.skipped(gen(spark, d).where("passed IS NOT NULL"), ["task"], "id", why)
    x = D.indexes(bitmaps, ["task"]).withColumnRenamed("task", "t")
    return x.join(first, F.col("t").eqNullSafe(F.col("task"))).select("task", "chosen", "reason", "index")


_PREFIX_SQL = "CASE doc_id % 4 WHEN 0 THEN t[1:20] WHEN 1 THEN list_concat(['x', 'y', 'z'], t[1:20]) WHEN 2 THEN list_concat(['x'], t[1:12], ['zz'], t[13:17]) ELSE ['q', 'r'] END"


@query(f"""WITH {TOK_SQL}, a AS (SELECT doc_id, t, {_PREFIX_SQL} AS p FROM tok WHERE len(t) >= 30), b AS (SELECT *, len(p) AS n, t[1:len(p) - 1] = p[1:len(p) - 1] AS whole FROM a),
f AS (SELECT *, coalesce(list_filter(range(0, n - 10), lambda i: p[i + 1:i + 10] = t[1:10])[1], -1) AS place FROM b), c AS (SELECT *, CASE WHEN whole THEN p WHEN place >= 0 THEN p[place + 1:] ELSE p[n:] END AS q FROM f)
SELECT doc_id, CAST(CASE WHEN whole THEN 0 ELSE place END AS INTEGER) AS "offset", CAST(len(q) AS INTEGER) AS prefix_len, len(t) >= len(q) - 1 AND t[1:len(q) - 1] = q[1:len(q) - 1] AS ok FROM c""")
def d22_prefix_equality(spark, d):
    """Where code begins in a prefix (by ten tokens, with a rolling hash), and whether both agree from there."""
    t, k = F.col("t"), F.col("doc_id") % 4
    words = lambda *w: F.array(*map(F.lit, w))
    p = F.when(k == 0, F.slice(t, 1, 20)).when(k == 1, F.concat(words("x", "y", "z"), F.slice(t, 1, 20))).when(k == 2, F.concat(words("x"), F.slice(t, 1, 12), words("zz"), F.slice(t, 13, 5))).otherwise(words("q", "r"))
    return _toks(spark, d).where("size(t) >= 30").select("doc_id", D.align_prefix(p, t).alias("a")).select("doc_id", "a.*")


# --- results that outlive a run --------------------------------------------------------------


@query("""WITH r AS (SELECT md5(text) AS h, min(doc_id % 2) AS odd FROM documents GROUP BY 1)
SELECT doc_id, CASE WHEN length(text) % 7 > 0 THEN 1 + odd END AS run, CASE WHEN length(text) % 7 > 0 THEN length(text) END AS n FROM documents JOIN r ON md5(text) = h""")
def x4_result_cache(spark, d):
    """Each distinct program is worked on once over two runs (the first sees half of them); failed work has no result (X4, without running anything)."""
    path, x = IO.scratch(spark, "results"), table(spark, d, "documents").select("doc_id", "text")
    work = lambda p: p.select("digest", F.length("program").alias("n"), (F.length("program") % 7 > 0).alias("ok"))
    C.cached_results(x.where("doc_id % 2 = 0"), "text", path, "n: long", work)
    return C.cached_results(x, "text", path, "n: long", work)[0].select("doc_id", "run", F.col("result.n").alias("n"))


@query("SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) > 100 AS flag FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def k3_merged_stream(spark, d):
    """Drops of events merged by key into one table: each batch counts once, replayed or not (streaming)."""
    from ..streaming import incremental as I

    src, sink, state = (IO.scratch(spark, n) for n in ("drops", "merged", "state"))
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    schema = "event_id long, user_id long, flag boolean"
    score = lambda x: x.select("event_id", "user_id", (F.col("value") > 100).alias("flag"))
    for part in (1, 0):  # later events come first
        IO.append_log(e.where(F.col("event_id") % 2 == part), src)
        I.merge_new(spark, src, "event_id long, user_id long, value double", score, sink, state, "user_id", "event_id")
    I.merge_batch(e.limit(0).select("event_id", "user_id", F.lit(True).alias("flag")), 0, sink, "user_id", "event_id")  # a replay
    return I.merged(spark, sink, schema, "user_id", "event_id").where("user_id IS NOT NULL")
