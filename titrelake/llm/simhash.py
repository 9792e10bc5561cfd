"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into two halves of 32 bits. Two fingerprints that differ in at most 3 bits agree in one half
up to one bit, so each fingerprint is looked up by both halves and by the halves one bit away (the ball of radius
1; of the two fingerprints the one that has the bit set looks). What is fetched is verified on all 64 bits. Only
distinct fingerprints take part, and each table entry keeps a spanning forest of its links rather than all pairs,
which leaves the components as they are.

similar_groups takes its own fingerprints, as at a similarity of 0.8 some 15 % of the bits differ: wide ones, cut into as many
segments as recall needs, with balls over the least certain bits of each segment; it compares what is fetched as sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded, cut, cut_table, row_hash
from .textarrays import BASE, LOWER, MASK, SPACED, mixed, slices, word_bounds, word_hashes

PIECE = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash over XXH64 of the word shingles of a lower-cased text; 0 if it has no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    h, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        a, b = starts[at : min(n, at + PIECE)].tolist(), ends[at : at + PIECE].tolist()
        hashes = np.array([h(joined[i:j], seed) for i, j in zip(a, b)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3, seed: int = 42) -> DataFrame:
    """The kept columns and fp, the fingerprint as a signed long. Null texts count as empty (0)."""
    cols = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*[F.col(f"`{c}`") for c in keep]).dtypes) + ", fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offs in slices(batches, "__text"):
            data, at = raw.tobytes(), offs.tolist()
            fps = np.array([fingerprint(data[i:j], width, seed) for i, j in zip(at, at[1:])], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [pa.array(fps)], names=[*keep, "fp"])

    return cols.mapInArrow(run, schema)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints (uint64) that share a table entry.

    Breadth-first from each unseen fingerprint: a member is compared with the unseen rest once, so memory stays
    linear whatever the number of links.
    """
    rest, out = fps, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                out += [(int(x), int(y)) for y in found]
                queue.extend(found)
    return out


def links(fps: DataFrame, radius: int = 3, entry: int = 2048) -> DataFrame:
    """fps (fp long, distinct) to a spanning set (a, b) of the links within `radius` (3 at most).

    Table entries with over `entry` fingerprints are split by the pieces of 8 bits of the other half: of four
    pieces at least one is equal, so nothing is lost. A larger radius is refused: halves and balls would miss links.
    """
    if radius > 3:
        raise ValueError(f"links() finds all links within 3 bits, not within {radius}")
    half = lambda x, k: F.shiftrightunsigned(x, 32) if k else x.bitwiseAND(F.lit(0xFFFFFFFF))
    halves = F.array(*[F.struct(F.lit(k).alias("half"), half(F.col("fp"), k).alias("key")) for k in (0, 1)])
    table = fps.select("fp", F.inline(halves)).select("half", "key", "fp")
    # flipping a set bit only: of two halves one bit apart, exactly one has that bit set
    bit = F.explode(F.sequence(F.lit(0), F.lit(31)))
    flips = table.select("half", "key", "fp", bit.alias("bit")).where("key & shiftleft(1L, bit) <> 0")
    flips = flips.select("half", (F.col("key").bitwiseXOR(F.expr("shiftleft(1L, bit)"))).alias("key"), "fp")
    fetched = flips.join(table.select("half", "key"), ["half", "key"], "left_semi")
    members = cut(table.unionByName(fetched))
    sizes = members.groupBy("half", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = members.join(sizes, ["half", "key"])
    other = half(F.col("fp"), 1) * F.when(F.col("half") == 0, 1).otherwise(0) + half(F.col("fp"), 0) * F.when(F.col("half") == 1, 1).otherwise(0)
    parts = F.when(F.col("n") <= entry, F.array(F.lit(-1).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i * 256 + F.call_function("shiftrightunsigned", other, i * 8).bitwiseAND(F.lit(255))))
    entries = shared.select("half", "key", F.explode(parts).alias("part"), "fp").repartition("half", "key", "part").sortWithinPartitions("half", "key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last entry of what came so far; it may go on in the next batch

        def done(rows: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
            out = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if j - i > 1:
                    out += forest(np.unique(rows[i:j, 3]).view(np.uint64), radius)
            ab = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            rows = rows if held is None else np.concatenate([held, rows])
            if len(rows):
                cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
                edges = np.concatenate(([0], cuts))
                held = rows[edges[-1] :]
                yield done(rows, edges)
        if held is not None:
            yield done(held, np.array([0, len(held)]))

    return entries.mapInArrow(run, "a bigint, b bigint")


def near_groups(df: DataFrame, text: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One row for each document: doc_id, __row (hash of the row), fp and component_id, the smallest doc_id reachable.

    Null texts count as empty; documents without words share fingerprint 0. Null doc_ids never win; a group of
    nothing else has a null component_id. Repeated rows are reported once each. Empty tables give empty results.
    """
    named = df.withColumn("__row", row_hash(df))
    docs = cut(fingerprints(named, text, ("doc_id", "__row"), width))
    reps = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(reps.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(ids, "fp").select("doc_id", "__row", "fp", "component_id")


def simhash_report(df: DataFrame) -> DataFrame:
    """The contract of op5."""
    return near_groups(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similar documents: wide fingerprints of five-word shingles, and exact similarity of what they fetch.

LANES = np.uint64(0x0101010101010101)
#: Bits of a shingle's hash within one document.
SHINGLE_BITS = 44


@dataclass(frozen=True)
class Balls:
    """How fingerprints are cut and looked up: `segments` segments of `bits` bits; a segment's ball holds it and what the
    flip of one of its `flips` least certain bits gives; fingerprints within `radius` are compared as sets of shingles."""

    bits: int
    segments: int
    flips: int
    radius: int


def plan_balls(rows: int, similarity: float = 0.8, recall: float = 0.97, flips: int = 6) -> Balls:
    """Segments long enough that balls of unlike documents seldom meet (64 times as many values as rows), and as many
    segments as it takes for two documents of exactly this similarity to meet with probability `recall`.

    A bit of two sets of similarity s differs with probability acos(2s / (1 + s)) / pi or less; how often balls of such
    segments meet is drawn from a fixed seed. The longer the segments, the more there are: recall does not fall with rows.
    """
    bits = min(40, max(16, (max(1, rows) - 1).bit_length() + 6))
    rng, rho = np.random.default_rng(1), 2 * similarity / (1 + similarity)
    x, noise = rng.standard_normal((2, 20_000, bits))
    y = rho * x + np.sqrt(1 - rho**2) * noise
    weak = [np.abs(z).argsort(axis=1).argsort(axis=1) < flips for z in (x, y)]
    differ = (x > 0) != (y > 0)
    n, in_x, in_y, in_both = (m.sum(axis=1) for m in (differ, differ & weak[0], differ & weak[1], differ & weak[0] & weak[1]))
    # one bit apart: either side flips it; two bits apart: each side flips one of them
    meet = float(((n == 0) | (n == 1) & (in_x + in_y > 0) | (n == 2) & (in_x > 0) & (in_y > 0) & ((in_x + in_y > 2) | (in_both == 0))).mean())
    segments = max(2, int(np.ceil(np.log(1 - recall) / np.log(1 - meet))))
    p, width = float(np.arccos(rho) / np.pi), segments * bits
    return Balls(bits, segments, flips, int(np.ceil(width * p + 3 * np.sqrt(width * p * (1 - p)))))


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each lower-cased text, by row; fewer words than `width` are one shingle."""
    lowered = LOWER[raw]
    starts, ends, rows = word_bounds(lowered, offs, SPACED)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.concatenate([word_hashes(lowered, starts, ends), np.zeros(width, np.uint64)])
    of = np.concatenate([rows, np.full(width, -1, rows.dtype)])
    whole, sums = of[width - 1 : width - 1 + n] == rows, np.zeros(n, np.uint64)
    first = np.concatenate(([True], rows[1:] != rows[:-1]))
    with np.errstate(over="ignore"):
        for k in range(width):
            sums += np.where(of[k : k + n] == rows, mixed(h[k : k + n] + np.uint64(2 * k + 1)), np.uint64(0))
    take = whole | first
    key = np.sort((rows[take].astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (mixed(sums[take]) >> np.uint64(64 - SHINGLE_BITS)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(SHINGLE_BITS)).astype(np.int64), key & np.uint64((1 << SHINGLE_BITS) - 1)


def bit_counts(rows: np.ndarray, hashes: np.ndarray, n: int, words: int) -> np.ndarray:
    """For each row how many of its hashes set each of 64 * words bits: bytes of a word add up in eight lanes of bits."""
    out = np.zeros((n, words, 8, 8), np.int32)
    if len(rows):
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        inside = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        cuts = np.flatnonzero(inside % 255 == 0)  # a lane holds 255
        of = rows[cuts]
        for w in range(words):
            g = mixed(hashes * np.uint64(2) + np.uint64((2 * w + 1) * BASE & MASK))
            for k in range(8):
                lanes = np.add.reduceat((g >> np.uint64(k)) & LANES, cuts).view(np.uint8).reshape(-1, 8)
                np.add.at(out[:, w, :, k], of, lanes)
    return out.reshape(n, words * 64)


def wide_fingerprints(df: DataFrame, balls: Balls, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 5) -> DataFrame:
    """The kept columns with fp (segments * bits bits) and weak, the places of each segment's least certain bits."""
    cols = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*[F.col(f"`{c}`") for c in keep]).dtypes) + ", fp binary, weak binary"
    total = balls.bits * balls.segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in slices(batches, "__text"):
            n = len(offs) - 1
            rows, hashes = shingle_sets(raw, offs, width)
            ones = bit_counts(rows, hashes, n, -(-total // 64))[:, :total]
            lead = 2 * ones - np.bincount(rows, minlength=n)[:, None]
            fps = np.packbits(lead > 0, axis=1, bitorder="little")
            weak = np.abs(lead).reshape(n, balls.segments, balls.bits).argsort(axis=2, kind="stable")[:, :, : balls.flips].astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [_binary(fps), _binary(weak.reshape(n, -1))], names=[*keep, "fp", "weak"])

    return cols.mapInArrow(run, schema)


def _binary(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.Array.from_buffers(pa.binary(k), n, [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of byte strings of one length as rows of bytes."""
    a = column.cast(pa.large_binary())
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(len(a), -1)


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places, of the links within `radius` between fingerprints (rows of uint64).

    Each fingerprint joins the first leader within half the radius. Two groups can only hold a link if their leaders are
    within twice the radius (triangle inequality); such groups are joined by their closest pair, near leaders first.
    """
    apart = lambda x, rest: np.bitwise_count(rest ^ x).sum(axis=1, dtype=np.int64)
    rest, leaders, groups, out = np.arange(len(fps)), [], [], []
    while len(rest):
        near = apart(fps[rest[0]], fps[rest]) <= radius // 2
        leaders.append(rest[0])
        groups.append(rest[near])
        out += [(int(rest[0]), int(y)) for y in groups[-1][1:]]
        rest = rest[~near]
    at = fps[leaders]
    pairs = [(d, i, i + 1 + j) for i in range(len(at) - 1) for j, d in enumerate(apart(at[i], at[i + 1 :]).tolist()) if d <= 2 * radius]
    root = list(range(len(at)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, i, j in sorted(pairs):
        if find(i) != find(j):
            few, many = sorted((groups[i], groups[j]), key=len)
            best = min((int((d := apart(fps[x], fps[many])).min()), int(x), int(many[d.argmin()])) for x in few)
            if best[0] <= radius:
                root[find(j)] = find(i)
                out.append(best[1:])
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in pieces that hold every run of equal keys (the first `keys` columns) whole, with the runs' edges."""
    held = None
    for b in batches:
        held = b if held is None or not len(held) else pa.concat_batches([held, b])
        if not len(held):
            continue
        k = np.column_stack([held.column(i).to_numpy() for i in range(keys)])
        edges = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1))
        if edges[-1]:
            yield held.slice(0, int(edges[-1])), edges
            held = held.slice(int(edges[-1]))
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def candidate_links(fps: DataFrame, balls: Balls, entry: int = 1 << 15) -> DataFrame:
    """fps (fid long, fp, weak; distinct) to pairs (a, b) of fid: a spanning set of the links within the balls' radius
    among those that share a table entry. Entries with more than `entry` fingerprints are compared block by block."""
    bits, segments, flips = balls.bits, balls.segments, balls.flips

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                n = len(b)
                on = np.unpackbits(_matrix(b.column("fp")), axis=1, count=bits * segments, bitorder="little").reshape(n, segments, bits)
                value = on.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                flipped = value[:, :, None] ^ (np.int64(1) << _matrix(b.column("weak")).reshape(n, segments, flips).astype(np.int64))
                keys = np.concatenate([value[:, :, None], flipped], axis=2) + (np.arange(segments, dtype=np.int64) << 44)[None, :, None]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("fid").to_numpy(), segments * (flips + 1)))], names=["key", "fid"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, None  # the key and the row of a run that so far has one row
        for b in batches:
            if not len(b):
                continue
            k = b.column(0).to_numpy()
            same = np.concatenate(([k[0] == last], k[1:] == k[:-1]))
            keep = same | np.concatenate((same[1:], [False]))
            if open_ is not None and same[0]:
                yield open_
            last = k[-1]
            open_ = b.slice(len(b) - 1) if not keep[-1] else None
            yield b.filter(pa.array(keep))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, edges in _runs(batches, 2):
            ids, rows = b.column("fid").to_numpy(), _matrix(b.column("fp"))
            rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8))).view(np.uint64)
            out = []
            for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(b)]):
                if j - i > 1:
                    out += [(i + x, i + y) for x, y in spanning_links(rows[i:j], balls.radius)]
            ab = ids[np.array(out, dtype=np.int64).reshape(-1, 2)]
            ab = ab[ab[:, 0] != ab[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["a", "b"])

    table = fps.mapInArrow(spread, "key bigint, fid bigint").repartition("key").sortWithinPartitions("key")
    entries = cut_table(table.mapInArrow(shared, "key bigint, fid bigint"))
    crowded = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > entry)
    members = entries.join(fps.select("fid", "fp"), "fid").withColumn("part", F.lit(0))
    if not crowded.isEmpty():
        blocks = F.ceil(F.col("n") / entry)
        own = F.pmod(F.xxhash64("fid"), blocks)
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: (F.least(own, j) * blocks + F.greatest(own, j)).cast("int"))
        members = members.drop("part").join(crowded, "key", "left").select("key", "fid", "fp", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part"))
    members = members.select("key", "part", "fid", "fp").repartition("key", "part").sortWithinPartitions("key", "part", "fid")
    return members.mapInArrow(joined, "a bigint, b bigint").distinct()


def similar_groups(df: DataFrame, text: str = "text", similarity: float = 0.8, width: int = 5, recall: float = 0.97, entry: int = 1 << 15) -> DataFrame:
    """One row for each document: doc_id, __row (hash of the row) and root, equal for documents that a chain of pairs links
    whose sets of `width`-word shingles have a Jaccard similarity of `similarity` or more.

    Every pair that is linked has that similarity (of 44-bit hashes of shingles); a pair of exactly that similarity is
    found with probability `recall`, one of a higher similarity more surely. Texts are lower-cased (A-Z); fewer words than
    `width` are one shingle; documents without words (null texts too) are a group. Rows that are equal are reported once
    each. An empty table gives an empty result.
    """
    base = df.select("doc_id", row_hash(df).alias("__row"), F.col(f"`{text}`").alias("__text"))
    balls = plan_balls(df.count(), similarity, recall)
    docs = cut_table(wide_fingerprints(base, balls, "__text", ("doc_id", "__row"), width))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    reps = cut_table(docs.groupBy("fp").agg(F.min(who).alias("who"), F.max("weak").alias("weak")).withColumn("fid", F.xxhash64("fp")))
    links = cut(candidate_links(reps.select("fid", "fp", "weak"), balls, entry))
    wanted = cut(links.select(F.explode(F.array("a", "b")).alias("fid")).distinct().join(reps.select("fid", "who.doc_id", "who.__row"), "fid"))
    ids = wanted.select("fid", F.col("doc_id").alias("__id"), F.col("__row").alias("__hash"))
    linked = base.join(bounded(ids), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in slices(batches, "__text"):
            rows, hashes = shingle_sets(raw, offs, width)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(offs))).astype(np.int32)), pa.array(hashes.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("fid"), lists], names=["fid", "s"])

    sets = linked.select("fid", "__text").mapInArrow(run, "fid bigint, s array<bigint>").dropDuplicates(["fid"])
    both = F.size(F.array_intersect("sa", "sb"))
    # a leader has many links: its set joins last, when a skewed join can be split
    checked = links.join(sets.select(F.col("fid").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("fid").alias("a"), F.col("s").alias("sa")), "a")
    checked = checked.where(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")
    roots = components(checked).withColumnRenamed("node", "fid")
    named = reps.select("fp", "fid").join(roots, "fid", "left").select("fp", F.coalesce("root", "fid").alias("root"))
    return docs.join(named, "fp").select("doc_id", "__row", "root")


def drop_near_copies(df: DataFrame, text: str = "text", similarity: float = 0.8, width: int = 5, **options) -> DataFrame:
    """df with one document of each group of similar_groups: the one with the smallest doc_id (null last; then by row
    hash). Rows equal in all columns count as one document. Columns keep their names and order, whatever they are called.
    """
    groups = cut(similar_groups(df, text, similarity, width, **options))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    first = groups.groupBy("root").agg(F.min(order).alias("first"))
    marked = groups.join(first, "root")
    gone = cut(marked.where(order > F.col("first")).select(F.col("doc_id").alias("__id"), F.col("__row").alias("__hash")).distinct())
    again = cut(marked.where(order == F.col("first")).groupBy(F.col("doc_id").alias("__id"), F.col("__row").alias("__hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    rows = df.select(F.col("doc_id").alias("__doc"), row_hash(df).alias("__row"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__all"))
    on = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash"))
    kept = rows.join(bounded(gone), on, "left_anti")
    if not again.isEmpty():
        once = kept.join(bounded(again), on, "left_semi").dropDuplicates(["__doc", "__row"])
        kept = kept.join(bounded(again), on, "left_anti").unionByName(once)
    return kept.select("__all.*")
