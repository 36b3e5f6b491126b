"""URL filters: stated rules first, a path-template tree for the rest.

The tree: a path's segments become shapes (with a digit or 24 characters: ``*``, a
file extension stays), and all later steps work on counts by (host, shape path).
From the host down, at the first place where the paths of a node differ:

1. a segment that fewer than the square root of the node's pages have is variable
   and becomes the wildcard ``*``, so a node of N pages keeps at most sqrt(N) others;
2. sibling branches that two-proportion tests (``z``) cannot tell apart are merged,
   and with them those that are alike in turn. Compared are the share of pages that
   end at the branch and, if both hold labelled urls, the share of blocked ones.
   Where labels lack it is the structure alone that decides;
3. a node of which one shape path is left is a template. There is no other limit
   of depth.

The urls that a rule fits are the labels (block or allow). A node's smoothed share
of blocked labels has its parent's as its prior of ``weight`` labels, down from the
whole table's, so a node without labels has its parent's purity. A template of
``reject`` or more is blocked if the nearest node above it (or it itself) that holds
labels holds ``support`` of them at least. Hosts without labels are allowed.

A url that is null or without ``://`` has an empty host and path, fits no rule
and belongs to the tree like any other. Repeated rows each get a row. Rules of one
length: the one with the longer host. Every step is an aggregate (combined before the shuffle)
or an equi-join; only the branches of one node, sqrt(N) at most, meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, settle

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    some = url.isNotNull() & (at > 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(some, F.translate(host, upper, upper.lower())).otherwise(""), F.when(some, path).otherwise("")


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments as shapes; none for an empty path."""
    def one(s: Column) -> Column:
        ext = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        return F.when(s.rlike(r"\d") | (F.length(s) >= 24), F.concat(F.lit("*"), ext)).otherwise(s)

    some = F.transform(F.split(F.substring(path, 2, F.length(path)), "/"), one)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(some)


def alike(a: int, n: int, b: np.ndarray, m: np.ndarray, z: float) -> np.ndarray:
    """Whether a of n and b of m may be of one share (two-proportion test); true where m is 0."""
    m1 = np.maximum(m, 1)
    pool = (a + b) / np.maximum(n + m, 1)
    return (np.abs(a / max(n, 1) - b / m1) <= z * np.sqrt(pool * (1 - pool) * (1 / max(n, 1) + 1 / m1)) + 1e-12) | (m == 0)


def merged(n: np.ndarray, ends: np.ndarray, labelled: np.ndarray, blocked: np.ndarray, z: float) -> np.ndarray:
    """For sibling branches the least number of a branch that each is merged with."""
    root = np.arange(len(n))
    for i in range(len(n)):
        like = alike(ends[i], n[i], ends, n, z)
        if labelled[i]:
            like &= alike(blocked[i], labelled[i], blocked, labelled, z)
        own = np.unique(root[like | (np.arange(len(n)) == i)])
        if len(own) > 1:
            root[np.isin(root, own)] = own[0]
    return root


def _merge(z: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, segs (struct of to, n, ends, labelled, blocked; in order): a row for each node."""
        for b in batches:
            node, to, name = [], [], []
            for k, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, e, l, x = (np.array([s[f] for s in segs], np.int64) for f in ("n", "ends", "labelled", "blocked"))
                root = merged(n, e, l, x, z)
                many = np.bincount(root, minlength=len(n))
                for s, r in zip(segs, root.tolist()):
                    node.append(k)
                    to.append(s["to"])
                    name.append(segs[r]["to"] if many[r] == 1 else f"{{{segs[r]['to']}+{many[r] - 1}}}")
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(to, pa.string()), pa.array(name, pa.string())], ["node2", "to2", "name"])

    return run


def templates(counts: DataFrame, z: float, weight: float, prior: float) -> tuple[DataFrame, list[DataFrame]]:
    """(host, shapes, template, purity, held: labels of the nearest node with any; the written tables it reads).

    counts: host, shapes, n, labelled, blocked. A level of the tree is four written tables; the templates that it
    ends are read from them.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    smooth = lambda b, l, p: (b + weight * p) / (l + weight)
    hosts = counts.groupBy(F.col("host").alias("host2")).agg(F.sum("labelled").alias("hl"), F.sum("blocked").alias("hb"))
    rows = counts.join(hosts, F.col("host") == F.col("host2")).withColumn("node", F.xxhash64("host")).withColumn("template", F.lit("")).withColumn("rest", F.col("shapes"))
    rows = rows.withColumn("purity", smooth(F.col("hb"), F.col("hl"), F.lit(prior))).withColumn("held", F.col("hl")).drop("host2", "hl", "hb")
    rows = settle(rows, "url-nodes")
    done, tables = [], [rows]
    while True:
        # skip: how far all the node's paths go on alike
        nodes = rows.groupBy("node").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum("n").alias("pages"))
        apart = F.expr("array_position(zip_with(lo, hi, (a, b) -> a <=> b), false)")
        skip = F.when(apart > 0, apart - 1).otherwise(F.least(F.size("lo"), F.size("hi")))
        nodes = nodes.select(F.col("node").alias("node2"), (F.col("lo") == F.col("hi")).alias("one"), "pages", skip.cast("int").alias("skip"))
        j = settle(rows.join(nodes, F.col("node") == F.col("node2")).drop("node2"), "url-level")
        common = F.expr("concat(template, concat_ws('', transform(slice(rest, 1, skip), x -> concat('/', x))))")
        done.append(j.where("one").select("host", "shapes", common.alias("template"), "purity", "held"))
        # stays: the path has a segment more, else it ends at the node
        more = j.where("NOT one").withColumn("template", common).withColumn("seg", F.coalesce(F.get("rest", F.col("skip")), F.lit(""))).withColumn("stays", F.expr("size(rest) > skip"))
        ends = F.when(F.expr("size(rest) <= skip + 1"), F.col("n")).otherwise(0)
        child = more.withColumn("ends", ends).groupBy("node", "stays", "seg", "pages").agg(*sums, F.sum("ends").alias("ends"))
        child = child.withColumn("to", F.when(F.col("stays") & (F.col("n") * F.col("n") < F.col("pages")), "*").otherwise(F.col("seg")))
        to = settle(child.select("node", "stays", "seg", "to", "n", "ends", "labelled", "blocked"), "url-children")
        kinds = to.where("stays").groupBy("node", "to").agg(*sums, F.sum("ends").alias("ends"))
        # sqrt(pages) + 1 branches of a node at most
        sets = kinds.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("to", "n", "ends", "labelled", "blocked"))).alias("segs")).where("size(segs) > 1")
        names = sets.mapInArrow(_merge(z), "node2 long, to2 string, name string")
        named = to.join(names, (F.col("node") == F.col("node2")) & (F.col("to") == F.col("to2")) & F.col("stays"), "left").withColumn("name", F.when(F.col("stays"), F.coalesce("name", "to")).otherwise(F.lit("")))
        named = settle(named.select("node", "stays", "seg", "name", "labelled", "blocked"), "url-names")
        labels = named.groupBy(F.col("node").alias("node3"), F.col("stays").alias("stays3"), F.col("name").alias("name3")).agg(F.sum("labelled").alias("bl"), F.sum("blocked").alias("bb"))
        of = named.join(labels, (F.col("node") == F.col("node3")) & (F.col("name") == F.col("name3")) & (F.col("stays") == F.col("stays3"))).select(F.col("node").alias("node4"), F.col("stays").alias("stays4"), F.col("seg").alias("seg4"), "name", "bl", "bb")
        down = more.join(of, (F.col("node") == F.col("node4")) & (F.col("seg") == F.col("seg4")) & (F.col("stays") == F.col("stays4")))
        down = down.withColumn("purity", smooth(F.col("bb"), F.col("bl"), F.col("purity"))).withColumn("held", F.when(F.col("bl") > 0, F.col("bl")).otherwise(F.col("held")))
        down = down.withColumn("template", F.when(F.col("stays"), F.concat("template", F.lit("/"), "name")).otherwise(F.col("template"))).withColumn("node", F.xxhash64("node", "stays", "name"))
        down = down.withColumn("rest", F.expr("slice(rest, skip + 2, size(rest))"))
        after = settle(down.select("host", "shapes", "rest", "n", "labelled", "blocked", "node", "template", "purity", "held", "stays"), "url-nodes")
        done.append(after.where("NOT stays").select("host", "shapes", "template", "purity", "held"))
        forget(to, named)
        tables += [j, after]
        rows = after.where("stays").drop("stays")
        if not rows.limit(1).count():
            return reduce(DataFrame.union, done), tables


def judge(pages: DataFrame, rules=RULES, z: float = 1.96, weight: float = 2.0, reject: float = 0.5, support: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of pages."""
    host, path = host_path(F.col("url").cast("string"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("shapes", shape(F.col("path")))
    counts = settle(p.groupBy("host", "shapes").agg(F.count("*").alias("n"), F.count("rule").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")), "url-shapes")
    whole = counts.agg(F.sum("blocked"), F.sum("labelled")).first()
    known, tables = templates(counts, z, weight, (whole[0] or 0) / max(whole[1] or 0, 1))
    known = settle(known.select(F.col("host").alias("h"), F.col("shapes").alias("s"), "template", "purity", "held"), "url-purity")
    forget(counts, *tables)
    out = p.join(known, (F.col("host") == F.col("h")) & (F.col("shapes") == F.col("s")))
    own = F.when((F.col("held") >= support) & (F.col("purity") >= reject), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")
