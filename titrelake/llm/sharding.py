"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until splitters fit.

Rows are ordered by a 128-bit key: the hash of the text, then the hash of all other columns. Rounds of
pre-aggregated counts refine only those key ranges that hold a wanted shard boundary or too large a share of
the rows, so copies of one text (equal first halves) are split like any other range. A boundary stays at the
edge of a group of equal texts if that meets the tolerance. Rows then move once, by key range.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, number_array, row_hash, without

#: (key half, bits to shift right, mask) by depth: 10 bits, then 9 at a time, for each half.
DIGITS = [(half, shift, mask) for half in (0, 1) for shift, mask in [(54, 1023), *((s, 511) for s in (45, 36, 27, 18, 9, 0))]]


@dataclass
class Cell:
    """A range of keys: rows and bytes in it, the depth of its next digit, and its first and last key halves."""

    rows: int
    bytes: int
    depth: int
    span: tuple[int, int, int, int]
    children: list[int] = field(default_factory=list)

    @property
    def next_depth(self) -> int | None:
        """None if all keys are equal. Digits that all of the cell's keys share are skipped by half."""
        lo1, hi1, lo2, hi2 = self.span
        if lo1 == hi1:
            return None if lo2 == hi2 else max(self.depth, len(DIGITS) // 2)
        return self.depth


@dataclass
class ShardPlan:
    """Splitters and cells; `rounds` holds, for each refinement, the arrays that route a row to its child cell."""

    shards: int
    rounds: list[tuple[list[int], list[int]]]
    shard_of: list[int]
    slot_of: list[int]
    bytes_of: list[int]


def _keys(df: DataFrame, text: str) -> DataFrame:
    top = F.lit(-(2**63)).cast("long")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.withColumns(
        {
            "__k0": F.xxhash64(body).bitwiseXOR(top),
            "__k1": row_hash(df, (text,)).bitwiseXOR(top),
            "__bytes": F.octet_length(body).cast("long") + 1,
        }
    )


def _digit(depth: Column) -> Column:
    """The digit of the row's key at a depth that differs from row to row."""
    half, shift = number_array([d[0] for d in DIGITS], "int"), number_array([d[1] for d in DIGITS], "int")
    key = F.when(F.get(half, depth) == 0, F.col("__k0")).otherwise(F.col("__k1"))
    mask = F.get(number_array([d[2] for d in DIGITS]), depth)
    return F.call_function("shiftrightunsigned", key, F.get(shift, depth)).bitwiseAND(mask)


def _routed(df: DataFrame, rounds: list[tuple[list[int], list[int]]]) -> DataFrame:
    """Add __cell: the root digit, then one step for each round of refinement."""
    df = df.withColumn("__cell", F.shiftrightunsigned("__k0", 54))
    for base, depth in rounds:
        at = F.col("__cell").cast("int")
        first = F.coalesce(F.get(number_array(base), at), F.lit(-1))
        df = df.withColumn("__cell", F.when(first >= 0, first + _digit(F.get(number_array(depth, "int"), at))).otherwise(F.col("__cell")))
    return df


def _counts(df: DataFrame, by: list[str]) -> list:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("__bytes").alias("b"), *[f(c).alias(f"{f.__name__}{c}") for c in ("__k0", "__k1") for f in (F.min, F.max)]).collect()


def plan_shards(df: DataFrame, shards: int = 16, text: str = "text", tolerance: float = 0.002, share: int = 256, cell_bytes: int = 1 << 30) -> ShardPlan:
    """Find splitters so that each shard's bytes are within `tolerance` of the mean, by rounds of exact counts.

    Cells end with at most 1/`share` of all rows and bytes and `cell_bytes`, unless all their keys are equal
    (rows equal in every column cannot be told apart and stay together). The driver gets counts of cells only.
    """
    slim = cut(_keys(df, text).select("__k0", "__k1", "__bytes"))
    cells = [Cell(0, 0, 1, (0, 0, 0, 0)) for _ in range(1024)]
    for r in _counts(_routed(slim, []), ["__cell"]):
        cells[r[0]] = Cell(r.n, r.b, 1, tuple(r)[3:])
    rows, size = sum(c.rows for c in cells), sum(c.bytes for c in cells)
    slack = max(1.0, tolerance * size / shards)
    rounds: list[tuple[list[int], list[int]]] = []

    def leaves() -> list[int]:
        out, stack = [], list(range(1023, -1, -1))
        while stack:
            i = stack.pop()
            if cells[i].children:
                stack.extend(reversed(cells[i].children))
            else:
                out.append(i)
        return out

    while True:
        order, below, refine = leaves(), 0, []
        for i in order:
            c = cells[i]
            if c.bytes:
                first, last = int(below * shards // size), int((below + c.bytes) * shards // size)
                wide = any(min(t - below, below + c.bytes - t) > slack for t in (k * size / shards for k in range(max(1, first), min(shards - 1, last) + 1)) if below < t < below + c.bytes)
                big = c.rows > max(1, rows / share) or c.bytes > min(size / share, cell_bytes)
                if (wide or big) and c.rows > 1 and c.next_depth is not None and c.next_depth < len(DIGITS):
                    refine.append(i)
            below += c.bytes
        if not refine:
            break
        base, depth = [-1] * len(cells), [0] * len(cells)
        for i in refine:
            depth[i] = cells[i].next_depth
            base[i] = len(cells)
            cells[i].children = list(range(len(cells), len(cells) + DIGITS[depth[i]][2] + 1))
            cells.extend(Cell(0, 0, depth[i] + 1, (0, 0, 0, 0)) for _ in cells[i].children)
        before = _routed(slim, rounds).where(F.coalesce(F.get(number_array(base), F.col("__cell").cast("int")), F.lit(-1)) >= 0)
        rounds.append((base, depth))
        at = F.col("__cell").cast("int")
        inner = before.withColumn("__cell", F.get(number_array(base), at) + _digit(F.get(number_array(depth, "int"), at)))
        for r in _counts(inner, ["__cell"]):
            cells[r[0]] = Cell(r.n, r.b, cells[r[0]].depth, tuple(r)[3:])
    shard_of, slot_of, bytes_of = [0] * len(cells), [0] * len(cells), [0] * shards
    below, shard, slot = 0, 0, 0
    for i in leaves():
        c = cells[i]
        while shard < shards - 1 and c.rows and (shard + 1) * size / shards - below <= below + c.bytes - (shard + 1) * size / shards:
            shard, slot = shard + 1, 0
        shard_of[i], slot_of[i] = shard, slot
        bytes_of[shard] += c.bytes
        below, slot = below + c.bytes, slot + c.rows
    return ShardPlan(shards, rounds, shard_of, slot_of, bytes_of)


def assign_shards(df: DataFrame, shards: int = 16, text: str = "text", returns: dict[str, Column] | None = None, **options) -> DataFrame:
    """df with shard (0 to shards-1, near-equal bytes) and slot (gapless from 0 in each shard, in key order).

    Null texts count as empty, with size 1. Columns named shard or slot are replaced. Equal rows share a key and
    get neighbouring slots. An empty table gives an empty result. Reruns agree whatever the partitioning.
    returns: columns to give instead of df's own; they are computed before rows move, so that texts can stay.
    """
    df = without(df, ["shard", "slot"])
    plan = plan_shards(df, shards, text, **options)
    names = list(returns or df.columns)
    keyed = _keys(df, text)
    if returns:
        keyed = keyed.select(*[c.alias(n) for n, c in returns.items()], "__k0", "__k1", "__bytes")
    routed = _routed(keyed, plan.rounds)
    at = F.col("__cell").cast("int")
    as_unsigned = [F.col(k).bitwiseXOR(F.lit(-(2**63)).cast("long")) for k in ("__k0", "__k1")]
    place = F.row_number().over(Window.partitionBy("__cell").orderBy(*as_unsigned)) - 1
    return routed.withColumn("slot", (F.get(number_array(plan.slot_of), at) + place).cast("long")).select(*[F.col(f"`{c}`") for c in names], F.get(number_array(plan.shard_of, "int"), at).alias("shard"), "slot")


def write_shards(df: DataFrame, path: str, shards: int = 16, text: str = "text", **options) -> None:
    """Write one folder of Parquet files for each shard, rows in slot order within each file.

    Nulls, repeated rows and clashing names are as in assign_shards; of an empty table no file is written.
    """
    assign_shards(df, shards, text, **options).repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_report(df: DataFrame, shards: int = 16) -> DataFrame:
    """The contract of op10: law `bytes`, one row for each document."""
    body = F.coalesce(F.col("text"), F.lit(""))
    digest = {"doc_id": F.col("doc_id"), "size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body).cast("long")}
    out = assign_shards(df, returns=digest)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
