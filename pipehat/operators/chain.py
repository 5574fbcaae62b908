"""Hash chains over rows with ascending ids, dense or not, made and checked in parallel.

Ids fall into blocks of SIZE. A block's seal is the hash of its rows' hashes in order; the seals form a chain of the same kind,
with block numbers as ids, and so on until one block is left. A row's checksum covers its own hash and the checksum before it
in its block; a block's first row is preceded by the checksum that the chain of seals reaches before that block. So every
checksum depends on all rows before it, while no task sees more than SIZE rows of a block.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipehat.runtime import remove, written

SIZE = 64
#: Seals that the driver chains by itself.
LOCAL = 20_000


def linked(rows: DataFrame, first: str = "") -> DataFrame:
    """(id, before, previous_id, checksum) of rows (id, hash): `before` and `previous_id` are the checksum and id before a row;
    the very first has `first` and NULL. Rows of one id go by their hash."""
    return _linked(rows.select("id", "hash", F.col("id").alias("last_id")), first).select("id", "before", "previous_id", "checksum")


def _linked(rows: DataFrame, first: str) -> DataFrame:
    """rows: (id, hash, last_id), last_id being the last row's id below a seal."""
    members = F.array_sort(F.collect_list(F.struct("id", "hash", "last_id")))
    blocks = rows.groupBy(F.floor(F.col("id") / SIZE).cast("bigint").alias("block")).agg(members.alias("rows"))
    seals = blocks.select(F.col("block").alias("id"), F.sha2(F.array_join("rows.hash", ""), 256).alias("hash"), F.element_at("rows", -1)["last_id"].alias("last_id"))
    blocks = blocks.join(_before(seals, first), "block")
    sums = F.aggregate("rows", F.array("before"), lambda done, r: F.concat(done, F.array(F.sha2(F.concat(F.element_at(done, -1), F.lit("|"), r["hash"]), 256))))
    ids = F.concat(F.array("previous_id"), F.col("rows.last_id"))
    each = F.transform("rows", lambda r, i: F.struct(r["id"].alias("id"), F.get("sums", i).alias("before"), F.get("ids", i).alias("previous_id"), F.get("sums", i + 1).alias("checksum")))
    return blocks.withColumns({"sums": sums, "ids": ids}).select(F.inline(each))


def _before(seals: DataFrame, first: str) -> DataFrame:
    """(block, before, previous_id) of every seal: at most LOCAL of them on the driver, more by the same chain over them."""
    spark = seals.sparkSession
    few = seals.limit(LOCAL + 1).collect()
    if len(few) <= LOCAL:
        chain, out, last = Chain(first=first), [], None
        for r in sorted(few):
            out.append((r.id, chain.before(r.id), last))
            chain.add(r.id, r.hash)
            last = r.last_id
        return F.broadcast(spark.createDataFrame(out, "block bigint, before string, previous_id bigint"))
    kept = written(seals, "seals")
    out = written(_linked(kept, first).select(F.col("id").alias("block"), "before", "previous_id"), "chain")
    remove(spark, kept.path)
    return out


class Chain:
    """The same chain, grown row by row. state is plain data: for each level its block, the block's hashes and the last
    checksum."""

    def __init__(self, state: list[dict] | None = None, first: str = ""):
        self.state, self.first = [dict(s, hashes=list(s["hashes"])) for s in state or []], first

    def before(self, n: int) -> str:
        """The checksum that a row of id n, higher than those before, would follow."""
        return self._block(n, 0)["last"]

    def add(self, n: int, own: str, level: int = 0) -> str:
        """The checksum of the row of id n, which is higher than those before."""
        at = self._block(n, level)
        at["hashes"].append(own)
        at["last"] = hashlib.sha256(f"{at['last']}|{own}".encode()).hexdigest()
        return at["last"]

    def _block(self, n: int, level: int) -> dict:
        """The state of a level once the block of n has begun there."""
        if level == len(self.state):
            self.state.append({"block": n // SIZE, "hashes": [], "last": self.first})
        at = self.state[level]
        if at["block"] != n // SIZE:
            self.add(at["block"], hashlib.sha256("".join(at["hashes"]).encode()).hexdigest(), level + 1)
            at |= {"block": n // SIZE, "hashes": [], "last": self._block(n // SIZE, level + 1)["last"]}
        return at
