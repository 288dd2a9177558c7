"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard levels. At each level every child draws ``ln(u) / weight`` with ``u`` in (0, 1)
hashed from the seed, the child's own name and the key, and the largest draw wins. A child's draw depends on nothing
but its own name and weight, so a changed weight moves keys only into or out of the subtree that changed.

Defined cases: a null key is hashed as the text ``null`` and placed like any other; null text has size 1 and CRC 0;
repeated rows share a shard and get slots of their own; an empty table gives an empty result; columns other than the
key and the text are ignored, so clashing names in the input do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are numbered in blocks of one shard, so many blocks a shard: 16 to the number of hash digits that name a block.
BLOCK_DIGITS = 3
BLOCKS = 16**BLOCK_DIGITS


@dataclass(frozen=True)
class Shard:
    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Rack:
    name: str
    shards: tuple[Shard, ...]

    @property
    def weight(self) -> float:
        return sum(s.weight for s in self.shards)


@dataclass(frozen=True)
class Region:
    name: str
    racks: tuple[Rack, ...]

    @property
    def weight(self) -> float:
        return sum(r.weight for r in self.racks)


@dataclass(frozen=True)
class Topology:
    """Regions of racks of shards. ``seed`` separates independent placements."""

    regions: tuple[Region, ...]
    seed: str = "t0"

    @classmethod
    def balanced(cls, regions: int, racks: int, shards: int, seed: str = "t0") -> Topology:
        """``regions`` x ``racks`` x ``shards`` of equal weight, numbered from 0."""
        number = iter(range(regions * racks * shards))
        return cls(
            tuple(
                Region(f"g{g}", tuple(Rack(f"g{g}r{r}", tuple(Shard(next(number)) for _ in range(shards))) for r in range(racks)))
                for g in range(regions)
            ),
            seed,
        )

    @property
    def n_shards(self) -> int:
        return sum(len(rack.shards) for region in self.regions for rack in region.racks)

    def grown(self, weight: float = 1.0) -> Topology:
        """One more shard, in a region and rack of its own: no weight that was there changes, so rows move only into it."""
        number = 1 + max(s.number for region in self.regions for rack in region.racks for s in rack.shards)
        name = f"x{number}"
        return replace(self, regions=(*self.regions, Region(name, (Rack(f"{name}r0", (Shard(number, weight),)),))))


def _pick(key: Column, seed: str, children: Column) -> Column:
    """The place of the child with the largest ln(u) / weight; u from the first 52 bits of an MD5, never 0 or 1."""

    def draw(c: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), c["name"], F.lit("/"), key)), 1, 13), 16, 10).cast("double")
        return F.struct((F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / c["weight"]).alias("draw"), c["at"].alias("at"))

    return F.array_max(F.transform(children, draw))["at"]


def _children(names: list[tuple[str, float, int]]) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(at).alias("at")) for n, w, at in names))


def locate(key: Column, topology: Topology) -> Column:
    """The shard number of a key: one draw among the regions, then among the racks of that region, then among its shards."""
    name = F.coalesce(key.cast("string"), F.lit("null"))
    racks = [[r for r in g.racks] for g in topology.regions]
    flat = [r for g in racks for r in g]
    regions = _children([(g.name, g.weight, i) for i, g in enumerate(topology.regions)])
    by_region = F.array(*(_children([(r.name, r.weight, flat.index(r)) for r in g]) for g in racks))
    by_rack = F.array(*(_children([(f"{r.name}s{s.number}", s.weight, s.number) for s in r.shards]) for r in flat))
    # a one-element transform names each level's result, so that it is worked out once
    region = F.array(_pick(name, topology.seed, regions))
    rack = F.transform(region, lambda g: _pick(name, topology.seed, F.get(by_region, g)))
    return F.element_at(F.transform(rack, lambda r: _pick(name, topology.seed, F.get(by_rack, r))), 1)


def shard(docs: DataFrame, topology: Topology, grown: Topology | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of each row.

    Slots are gapless from 0 in each shard. They are numbered in hashed blocks, each block from the sum of the blocks
    before it, so a shard is never gathered in one task: the only thing ranked whole is the table of block counts, whose
    size is shards x BLOCKS. The rows are joined with it where the ranking left them, without a shuffle of their own.
    """
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def placed(df: DataFrame) -> DataFrame:
        name = F.concat(F.lit("slot/"), F.coalesce(F.col("k").cast("string"), F.lit("null")))
        block = F.conv(F.substring(F.md5(name), 1, BLOCK_DIGITS), 16, 10).cast("int")
        return df.withColumn("shard", locate(F.col("k"), topology)).withColumn("block", block)

    counts = placed(docs.select("k")).groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    body = F.coalesce(F.col("t"), F.lit(""))
    rows = placed(docs.select("k", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")))
    within = Window.partitionBy("shard", "block").orderBy("k", "text_crc32", "size")
    rows = rows.withColumn("rank", F.row_number().over(within) - 1)
    return rows.join(starts, ["shard", "block"]).select(
        F.col("k").alias(key),
        "size",
        "text_crc32",
        "shard",
        (F.col("start") + F.col("rank")).cast("long").alias("slot"),
        (locate(F.col("k"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
