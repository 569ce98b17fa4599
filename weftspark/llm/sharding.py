"""Operator 4: sharding by a hierarchical weighted hash tree.

A row descends from the root through region and rack to a shard; on each level the child with the largest draw wins.  A
shard draws ln(u) / weight, u being a hash of the row's id and the shard's place in (0, 1]; a rack's draw is the largest of
its shards', a region's the largest of its racks'.  The largest of such draws is distributed like one draw with the sum of
their weights, so every child gets its weight's share of the rows.  No draw depends on anything outside its subtree: a
changed weight moves rows only into or out of the shards whose weights change, and one more shard takes rows only into
itself, wherever it stands.  The law is `key`: the id and the number of shards decide.

Slots number the rows of a shard without gaps from 0: rows are counted per shard and bucket, the buckets' counts are summed
up in bucket order, and rows are numbered inside their bucket, so no task sees a whole shard.  Buckets are dealt by the
place at which a row was stored, so rows that repeat one id spread over them too.

Edge cases: a null text has no bytes, CRC-32 0 and size 8; rows whose id is null, or repeats, all go to the id's shard and
still have slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.session import stored

LAW = "key"
RACKS, SHARDS_PER_RACK = 2, 4
#: Rows that a bucket of slots has on average.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Tree:
    """Regions of racks of (shard, weight) leaves."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard: in the last rack, or in a new one of its region or of a new region where that is full."""
        new = (self.shards(), weight)
        if not self.regions or len(self.regions[-1]) == RACKS and len(self.regions[-1][-1]) >= SHARDS_PER_RACK:
            return Tree((*self.regions, ((new,),)))
        *full, last = self.regions[-1]
        racks = (*full, (*last, new)) if len(last) < SHARDS_PER_RACK else (*full, last, (new,))
        return Tree((*self.regions[:-1], racks))


def tree_of(shards: int) -> Tree:
    """The tree that has grown to so many equal shards."""
    tree = Tree(())
    for _ in range(shards):
        tree = tree.grown()
    return tree


def _draw(key: Column, name: str, weight: float) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 1) / float(1 << 53)
    return F.log(unit) / weight


def _best(draws: list[Column]) -> Column:
    """The largest of the children's draws (struct of draw and minus the shard it comes from)."""
    return draws[0] if len(draws) == 1 else F.greatest(*draws)


def place(key: Column, tree: Tree) -> Column:
    """The shard of a row; the smaller number on equal draws."""
    regions = []
    for r, region in enumerate(tree.regions):
        racks = []
        for k, rack in enumerate(region):
            racks.append(_best([F.struct(_draw(key, f"region {r}/rack {k}/shard {s}", w).alias("draw"), F.lit(-s).alias("rank")) for s, w in rack]))
        regions.append(_best(racks))
    return (-_best(regions)["rank"]).cast("int")


def assign(docs: DataFrame, tree: Tree, text: str = "text", id_column: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    key = F.col(id_column)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(
        key.alias("doc_id"),
        (F.length(body) + 8).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        place(key, tree).alias("shard"),
        place(key, tree.grown()).alias("grown_shard"),
        F.monotonically_increasing_id().alias("stored_at"),
    )
    slim = stored(slim, "shards")
    buckets = max(1, -(-slim.count() // (tree.shards() * bucket_rows)))
    slim = slim.withColumn("bucket", F.pmod(F.xxhash64("stored_at"), F.lit(buckets)))
    counts = slim.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32", "stored_at"))
    return slim.withColumn("within", within).join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("offset") + F.col("within") - 1).cast("bigint").alias("slot"), "grown_shard"
    )
