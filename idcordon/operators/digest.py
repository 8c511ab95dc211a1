"""Digests of stretches of a chain, and a tree over them: a long chain is checked in parallel, and where it was harmed is found.

The link of a chain is serial, so a walk over a very long chain is one task. Beside it stand digests:
a stretch of ``stretch`` sequence numbers has the hash of its records' hashes, taken anew from the
records, and a node above the hash of its ``fan`` children. Stretches are grouped without regard to each other.
Two trees, one stored when the trail was written and one of the trail as it is, are compared
from the top: only below nodes that differ are children looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.functions.canonical import event_hash
from idcordon.functions.sql import name
from idcordon.operators.audit import UNLINKED
from idcordon.sources.shared import stored


def _digest(parts: str, order: str) -> str:
    """Hash of the parts of a group in order; a part that is null counts as empty."""
    return f"sha2(array_join(transform(array_sort(collect_list(struct({order}, coalesce({parts}, '') AS part))), x -> x.part), ''), 256)"


def stretch_digests(trail: DataFrame, salt: str, stretch: int = 1000, chain: str = "chain_id", seq: str = "seq") -> DataFrame:
    """(chain, level 0, node, digest, n): node is the stretch's number, n its records. Records without a place are left out.

    A record's hash is taken of what is stored of it, its link included, so any change shows. Its
    stored hash is part of the digest too.
    """
    placed = trail.where(f"{name(seq)} IS NOT NULL AND NOT ({UNLINKED})").selectExpr(
        name(chain), f"cast(floor({name(seq)} / {stretch}) AS bigint) AS node", f"{name(seq)} AS _seq", "event_id AS _id",
        f"concat(coalesce({event_hash(salt)}, ''), coalesce(event_hash, '')) AS _hash",
    )
    return placed.groupBy(chain, "node").agg(F.expr(_digest("_hash", "_seq, _id")).alias("digest"), F.count("*").alias("n")).select(
        chain, F.lit(0).alias("level"), "node", "digest", "n"
    )


def digest_tree(
    trail: DataFrame, salt: str, stretch: int = 1000, fan: int = 16, levels: int = 3, chain: str = "chain_id", seq: str = "seq"
) -> DataFrame:
    """The stretches' digests and ``levels`` levels of nodes above them; each level is stored once."""
    level = stored(stretch_digests(trail, salt, stretch, chain, seq), "digests")
    tree = level
    for height in range(1, levels + 1):
        up = level.select(chain, F.expr(f"cast(floor(node / {fan}) AS bigint)").alias("above"), "node", "digest", "n")
        level = up.groupBy(chain, "above").agg(F.expr(_digest("digest", "node")).alias("digest"), F.sum("n").alias("n")).select(
            chain, F.lit(height).alias("level"), F.col("above").alias("node"), "digest", "n"
        )
        level = stored(level, "digests")
        tree = tree.unionByName(level)
    return tree


def harmed_stretches(before: DataFrame, after: DataFrame, fan: int = 16, levels: int = 3, chain: str = "chain_id") -> DataFrame:
    """(chain, node, n_before, n_after) of the stretches whose digests differ between two trees, or that only one has."""
    differing = None
    for height in range(levels, -1, -1):
        a, b = (t.where(F.col("level") == height).alias(x) for t, x in ((before, "a"), (after, "b")))
        if differing is not None:  # children of nodes that differ
            above = differing.select(F.col(name(chain)).alias("_chain"), F.col("node").alias("_above"))
            below = F.expr(f"{name(chain)} <=> _chain AND cast(floor(node / {fan}) AS bigint) = _above")
            a, b = (t.join(above, below, "left_semi").alias(x) for t, x in ((a, "a"), (b, "b")))
        same = F.expr(f"a.{name(chain)} <=> b.{name(chain)} AND a.node = b.node")
        both = a.join(b, same, "full").where("NOT (a.digest <=> b.digest)")
        differing = both.select(
            F.expr(f"coalesce(a.{name(chain)}, b.{name(chain)})").alias(chain), F.coalesce("a.node", "b.node").alias("node"),
            F.coalesce("a.n", F.lit(0)).alias("n_before"), F.coalesce("b.n", F.lit(0)).alias("n_after"),
        )
        if height:  # the level below reads it twice
            differing = stored(differing, "differing")
    return differing
