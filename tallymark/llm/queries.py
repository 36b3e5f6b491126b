"""One query for each operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, decontam, fim, langid, linededup, ordering, packing, quotes, shards, simhash, urltree, warc
from .common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quotes.link(table(spark, sf_dir, "conversations"))
    return x.select("conv_id", "turn", "role", "n_quotes", "n_linked", "parent_conv_id", "parent_turn", "root_conv_id", "root_turn", "depth", F.md5("clean_text").alias("text_md5"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(*warc.write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence with its slot, where it lies, and the CRC-32 of its record as read back from the shards."""
    index, shards = ordering.materialise(table(spark, sf_dir, "documents"), vocabulary())
    back = ordering.resume(shards, 0).select(F.col("slot").alias("s"), F.crc32("record").alias("record_crc32"))
    return index.join(back, F.col("slot") == F.col("s"), "left").select("doc_id", "start", "length", "slot", F.expr("slot div 2048").alias("shard"), F.expr("slot % 2048 * 2048").alias("byte_offset"), "record_crc32")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fim.transform(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_packing, op3_nearest, op4_quotations, op5_decontamination, op6_warc, op7_token_order, op8_simhash, op9_url_filter, op10_line_dedup, op11_fill_in_middle, op12_alignment, op13_sharding, pipeline)
    return {f.__name__: f for f in own}


def _base32_sql(hexed: str) -> str:
    """Twenty bits (five hex digits) at a time, four letters each."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    value = lambda k: f"CAST('0x' || substr({hexed}, {5 * k + 1}, 5) AS INTEGER)"
    return " || ".join(f"substr({letters}, 1 + (({value(k)} >> {s}) & 31), 1)" for k in range(8) for s in (15, 10, 5, 0))


WARC_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_base32_sql("p.h")} AS payload_digest,
       CASE WHEN p.page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p JOIN g ON p.h = g.h
"""


#: Lines one edit apart share a half at a place that the lengths decide; what differs is one character or one more.
LINE_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS pos FROM l),
x AS (SELECT doc_id, pos, raw, trim(raw, ' ') AS line FROM u),
k AS (SELECT line, min((doc_id, pos)) AS f, length(line) AS n FROM x WHERE line <> '' GROUP BY 1),
own AS (SELECT line, f, n, n AS l, 0 AS i, substr(line, 1, n // 2) AS s FROM k WHERE n >= 16 UNION ALL SELECT line, f, n, n, 1, substr(line, n // 2 + 1) FROM k WHERE n >= 16),
probe AS (SELECT line, f, n, n - 1 AS l, 0 AS i, substr(line, 1, (n - 1) // 2) AS s FROM k WHERE n >= 17 UNION ALL SELECT line, f, n, n - 1, 1, substr(line, (n - 1) // 2 + 2) FROM k WHERE n >= 17),
c AS (SELECT DISTINCT a.line AS a, b.line AS b, a.n AS na, b.n AS nb, a.f AS fa, b.f AS fb FROM own a JOIN (SELECT * FROM own UNION ALL SELECT * FROM probe) b ON a.l = b.l AND a.i = b.i AND a.s = b.s AND a.line <> b.line),
d AS (SELECT *, coalesce(list_filter(range(1, na + 1), lambda j: substr(a, j, 1) <> substr(b, j, 1))[1], na + 1) AS place FROM c),
near AS (SELECT DISTINCT CASE WHEN fa > fb THEN a ELSE b END AS line FROM d WHERE substr(a, CASE WHEN na = nb THEN place + 1 ELSE place END) = substr(b, place + 1)),
m AS (SELECT x.doc_id, x.pos, x.raw, x.line <> '' AND (near.line IS NOT NULL OR k.f <> (x.doc_id, x.pos)) AS gone FROM x LEFT JOIN k ON x.line = k.line LEFT JOIN near ON x.line = near.line),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t FROM m GROUP BY 1)
SELECT o.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(t) AS kept_chars, md5(t) AS kept_md5 FROM documents o LEFT JOIN g ON o.doc_id = g.doc_id
"""


FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": WARC_SQL, "op10_line_dedup": LINE_SQL, "op11_fill_in_middle": FIM_SQL}
