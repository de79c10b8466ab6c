"""Fixity audit of web archives by Merkle trees.

A record's hash is the SHA-256 of its WARC form. A leaf is the records of one id, nearly always one. Leaves stand in
the archive's order, by id, each at its offset; runs of neighbouring leaves make a node, whose hash covers the run's
length in bytes and its children's hashes in order, and so on up to one root. A run begins where the hash of an id
ends in enough zero bits, four for each level, so a node has 16 children on average, and both replicas cut their
ranges at the same ids: a lost, added or repeated record changes the nodes above it and no others, though all
offsets after it shift. Two replicas are compared at the root; only children of nodes that differ are looked at,
down to the records.

Ordinals and offsets come from a range-partitioned table of leaves and running sums, within a part and over the
parts. A node has more than 500 children with a probability below 1e-13; a leaf of many records is an aggregate (a sum
of hashes), so no group is gathered.

Null urls and pages are empty, null ids are one id, first in order, rows that repeat an id are one leaf, texts are
hashed whole, other columns are not read, and an empty archive has no root: all of the other is missing or added.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ordered_parts, written

#: Bits of an id's hash that are zero where a run of the next level begins: 2 ** BITS children on average.
BITS = 4


def warc_record(url: Column, body: Column) -> Column:
    """A WARC resource record, as text; its UTF-8 bytes are what is hashed."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame, id_col: str, record: Column) -> DataFrame:
    """(id, name, n, n_bytes, digest, set, ordinal, offset) of an archive in the order of its ids. n: records of the
    id, n_bytes: of them all; digest: of the record, or of what many records' hashes sum up to; set: the same
    whatever n, where all are alike; ordinal, offset: of the first."""
    hashed = records.select(F.col(id_col).alias("id"), record.alias("r")).select("id", F.octet_length("r").cast("long").alias("n_bytes"), F.sha2("r", 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = hashed.groupBy("id").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.concat_ws(":", *(part(i) for i in range(4))).alias("all"))
    many = F.sha2(F.concat_ws("/", F.col("n").cast("string"), "all"), 256)
    leaf = sums.select("id", F.concat(F.when(F.col("id").isNull(), "n").otherwise("i"), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("name"), "n", "n_bytes", F.when(F.col("n") == 1, F.col("lo")).otherwise(many).alias("digest"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(many).alias("set"))
    parted = ordered_parts(leaf, [F.asc("id")], "fixity-leaves")
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    ahead = parted.groupBy("part").agg(F.sum("n_bytes").alias("b"), F.sum("n").alias("k")).select("part", F.coalesce(F.sum("b").over(over), F.lit(0)).alias("bytes"), F.coalesce(F.sum("k").over(over), F.lit(0)).alias("rows"))
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = parted.select("*", (F.sum("n_bytes").over(within) - F.col("n_bytes")).alias("b"), (F.sum("n").over(within) - F.col("n")).alias("k")).join(ahead, "part")
    return written(placed.select("id", "name", "n", "n_bytes", "digest", "set", "part", (F.col("rows") + F.col("k")).alias("ordinal"), (F.col("bytes") + F.col("b")).alias("offset")), "fixity-placed")


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """leaf: of `leaves`. The levels of its tree from the leaves up to the root: node (a name), parent, ordinal, digest,
    n_bytes. A node is named by the leaf at which it begins; what is before all such is the head."""
    zeros = F.xxhash64("name")
    begins = lambda j: F.when(zeros.bitwiseAND((1 << BITS * j) - 1) == 0, F.struct("ordinal", "name"))
    inner = range(1, levels)
    carried = leaf.groupBy("part").agg(*(F.max(begins(j)).alias(f"p{j}") for j in inner)) if levels > 1 else leaf.select("part").distinct()
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    carried = carried.select("part", *(F.max(f"p{j}").over(over).alias(f"p{j}") for j in inner))
    within = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    up = leaf.select("*", *(F.max(begins(j)).over(within).alias(f"w{j}") for j in inner)).join(carried, "part")
    named = lambda j: F.lit("root") if j == levels else F.coalesce(F.col(f"w{j}.name"), F.col(f"p{j}.name"), F.lit("head"))
    out = [written(up.select(F.col("name").alias("node"), *(named(j).alias(f"up{j}") for j in range(1, levels + 1)), "ordinal", "digest", "n_bytes"), "fixity-level")]
    for j in range(1, levels + 1):
        child = F.struct("ordinal", "digest")
        above = [F.min(f"up{i}").alias(f"up{i}") for i in range(j + 1, levels + 1)]
        grouped = out[-1].groupBy(F.col(f"up{j}").alias("node")).agg(*above, F.sum("n_bytes").alias("n_bytes"), F.min("ordinal").alias("ordinal"), F.array_sort(F.collect_list(child)).alias("c"))
        digest = F.sha2(F.concat_ws(":", F.col("n_bytes").cast("string"), F.array_join(F.transform("c", lambda x: x["digest"]), "")), 256)
        out.append(written(grouped.withColumn("digest", digest).drop("c"), "fixity-level"))
    return [df.select("node", F.col(f"up{j}").alias("parent") if j <= levels else F.lit("").alias("parent"), "digest") for j, df in enumerate(out, 1)]


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(node): the leaves in which two trees of as many levels differ, found from the root down."""
    frontier = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if frontier is not None:
            below = frontier.select(F.col("node").alias("parent"))
            x, y = x.join(below, "parent", "left_semi"), y.join(below, "parent", "left_semi")
        both = x.select("node", F.col("digest").alias("x")).join(y.select("node", F.col("digest").alias("y")), "node", "full_outer")
        frontier = written(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("node"), "fixity-differing")
    return frontier


def audit(original: DataFrame, replica: DataFrame, id_col: str, record: Column) -> DataFrame:
    """One row an id of either archive: id, and of the original n, n_bytes, ordinal, offset and digest, of the replica
    the same with copy_ before, null where an archive lacks the id; status: intact, missing, added, repeated (the same
    records another number of times) or changed.

    record: the record's text, of columns that both have. The trees say which ids differ; only these are compared.
    """
    a, b = leaves(original, id_col, record), leaves(replica, id_col, record)
    most, levels = max(a.count(), b.count()), 1
    while 2 ** (BITS * levels) < most:
        levels += 1
    wrong = differing(tree(a, levels), tree(b, levels)).withColumn("wrong", F.lit(True))
    columns = ["n", "n_bytes", "ordinal", "offset", "digest"]
    left = a.select("name", F.col("id").alias("id_a"), *columns, F.col("set").alias("set_a"))
    right = b.select("name", F.col("id").alias("id_b"), *(F.col(c).alias(f"copy_{c}") for c in columns), F.col("set").alias("set_b"))
    both = left.join(right, "name", "full_outer").join(wrong, F.col("name") == F.col("node"), "left")
    told = F.when(F.col("copy_n").isNull(), "missing").when(F.col("n").isNull(), "added").when(F.col("set_a") == F.col("set_b"), "repeated").otherwise("changed")
    return both.select(F.coalesce("id_a", "id_b").alias(id_col), *columns, *(f"copy_{c}" for c in columns), F.when(F.col("wrong"), told).otherwise("intact").alias("status"))
