"""Fixity audit of WARC replicas by Merkle trees.

Every page is a WARC response record.  Records are laid in files of FILE_RECORDS page numbers each, in the order of page_id; a
record's hash is the SHA-256 of its bytes.  A leaf is a page number of the file: the hashes and lengths of its records, one as a
rule.  FANOUT neighbouring places make a node, hashed over its children's places, hashes and lengths in order, that is over
their offset ranges counted from the node's own start; and so on up to one root for a file.  Replicas are compared from the
roots, and only below nodes that differ are the children looked at.  As places are page numbers and ranges are relative, a
record that was altered, lost or added changes one node a level, whatever its length.

All of it is built-in expressions; the tree of every file is built in parallel, in as many steps as the tree has levels, a
number that FILE_RECORDS fixes.  Equal records of one page number are kept as one with a count, so that no group grows with
the number of copies.

Defined cases: null html and url are an empty body and URI.  Rows without page_id can't be placed in a file and are left out.
Repeated rows of one page_id are records of their own, in the order of their hashes.  Columns besides page_id, url and html are
ignored.  Empty replicas have no files; against an empty replica every record is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FILE_RECORDS, FANOUT = 4096, 16


def levels(records: int = FILE_RECORDS, fanout: int = FANOUT) -> int:
    n = 0
    while records > 1:
        records, n = -(-records // fanout), n + 1
    return max(1, n)


def record(url: Column, html: Column) -> Column:
    """A WARC/1.1 response record, as text; its length in bytes is that of its UTF-8 form."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, page_id, hash, size, times) of the distinct records of each page number."""
    text = record(F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text.alias("r")).where("page_id IS NOT NULL")
    # the text ends here; what is shuffled is a hash and a length
    rows = rows.select(F.floor(F.col("page_id") / file_records).alias("file"), "page_id", F.sha2("r", 256).alias("hash"), F.octet_length("r").cast("long").alias("size"))
    return rows.groupBy("file", "page_id", "hash", "size").agg(F.count(F.lit(1)).alias("times"))


def _node(key: list[str], node: Column, rows: DataFrame) -> DataFrame:
    """One level: rows (key, node, place, hash, size, times) to (key, node, hash, size)."""
    child = F.concat_ws(":", F.lpad(F.col("place").cast("string"), 20, "0"), "hash", F.col("size").cast("string"), F.col("times").cast("string"))
    up = rows.groupBy(*key, node.alias("node")).agg(F.array_sort(F.collect_list(child)).alias("h"), F.sum(F.col("size") * F.col("times")).alias("size"))
    return up.select(*key, "node", F.sha2(F.array_join("h", ";"), 256).alias("hash"), "size")


def leaves(rows: DataFrame, key: list[str], file_records: int = FILE_RECORDS) -> DataFrame:
    """The lowest level, a leaf for each page number."""
    return _node(key, F.pmod("page_id", F.lit(file_records)), rows.withColumn("place", F.lit(0)))


def parents(nodes: DataFrame, key: list[str], fanout: int = FANOUT) -> DataFrame:
    """The next level, from FANOUT places each."""
    return _node(key, F.floor(F.col("node") / fanout), nodes.withColumns({"place": F.pmod("node", F.lit(fanout)), "times": F.lit(1)}))


def roots(pages: DataFrame, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """(file, bytes, root): the root of every file's tree."""
    level = leaves(records(pages, file_records), ["file"], file_records)
    for _ in range(levels(file_records, fanout)):
        level = parents(level, ["file"], fanout)
    return level.select("file", F.col("size").alias("bytes"), F.col("hash").alias("root"))


def descend(both: DataFrame, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> list[DataFrame]:
    """From the records of both replicas (with a column side): the nodes (file, node) in which they differ, a frame for each
    level from the roots to the leaves.  Of a level, only the children of the differing nodes above are compared."""
    tree = [cut(leaves(both, ["side", "file"], file_records))]
    for _ in range(levels(file_records, fanout)):
        tree.append(cut(parents(tree[-1], ["side", "file"], fanout)))
    out: list[DataFrame] = []
    for level in reversed(tree):
        if out:
            above = out[-1].select(F.col("file").alias("_f"), F.col("node").alias("_n"))
            level = level.join(above, (F.col("file") == F.col("_f")) & (F.floor(F.col("node") / fanout) == F.col("_n")), "left_semi")
        one = level.groupBy("file", "node").agg(F.count(F.lit(1)).alias("c"), F.min("hash").alias("x"), F.max("hash").alias("y"))
        out.append(cut(one.where("c < 2 OR x <> y").select("file", "node")))
    return out


def audit(replica_a: DataFrame, replica_b: DataFrame, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """Rows (file, page_id, status, start_a, stop_a, start_b, stop_b): the records in which the replicas differ.

    status is altered, missing (not in b) or added (not in a); the offset ranges are those in either replica's file.  Records of
    one page_id are paired by their order.  Records that only moved are not reported.
    """
    both = records(replica_a, file_records).withColumn("side", F.lit("a")).unionByName(records(replica_b, file_records).withColumn("side", F.lit("b")))
    w, same = Window.partitionBy("side", "file"), Window.partitionBy("side", "file", "page_id")
    before = Window.unboundedPreceding
    stop = F.sum(F.col("size") * F.col("times")).over(w.orderBy("page_id", "hash", "size").rowsBetween(before, 0))
    last = F.sum("times").over(same.orderBy("hash", "size").rowsBetween(before, 0))
    both = cut(both.withColumns({"stop": stop, "last": last}))
    suspect = descend(both, file_records, fanout)[-1].select(F.col("file").alias("_f"), F.col("node").alias("_n"))
    rows = both.join(suspect, (F.col("file") == F.col("_f")) & (F.pmod("page_id", F.lit(file_records)) == F.col("_n")), "left_semi")
    # each copy again, with its place among the records of its page number
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("last") - F.col("times") + 1, F.col("last")))).withColumn("stop", F.col("stop") - (F.col("last") - F.col("k")) * F.col("size"))
    a, b = (rows.where(F.col("side") == s).select("file", "page_id", "k", (F.col("stop") - F.col("size")).alias(f"start_{s}"), F.col("stop").alias(f"stop_{s}"), F.col("hash").alias(f"hash_{s}")) for s in "ab")
    pairs = a.join(b, ["file", "page_id", "k"], "full").where("NOT (hash_a <=> hash_b)")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "added").otherwise("altered")
    return pairs.select("file", "page_id", status.alias("status"), "start_a", "stop_a", "start_b", "stop_b")
