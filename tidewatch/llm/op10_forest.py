"""Approximate nearest neighbours by a hash-prefix forest.

Each of TREES trees gives a vector a string of BITS bits, the sides of random hyperplanes it lies
on. A tree is its vectors in the order of their strings, in blocks: one for each prefix of a
few bits, so that a block has about BLOCK_ROWS vectors. A prefix with many more is dealt to
several blocks by a hash of the id, and its queries go to all of them.

A query descends to its longest-prefix matches in PROBES trees, and scores about MATCHES of them
in each. The fifth best score s says how often a vector as near agrees with the query in a bit,
p = 1 - acos(s) / pi. All trees then ascend together to the depth x at which a vector that near
would be missed by every tree with probability MISS at most, (1 - p ** x) ** TREES, and everything
that shares x bits in any tree is scored. Near neighbours thus are found deep down, in small
parts of the blocks; where nothing is near, the search widens by itself. No number of candidates
is fixed.

Scores are cosines in double precision on the original vectors, ties go to the smaller id.
Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
null ids. Rows with one id count once, with the least vector. Only vectors of one length are
compared. An empty table, or one without queries, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.registry import register
from tidewatch.session import cut_lineage

TREES, BITS = 32, 64
PROBES, MATCHES = 8, 64
MISS = 0.04
BLOCK_ROWS = 8192
NEAREST = 5
SEED = 20240601
U64 = np.uint64

HOME = ["dim", "tree", "leaf", "part"]


def planes(dim: int, trees: int) -> np.ndarray:
    """Normals of the hyperplanes, the same in every task."""
    return np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((dim, trees * BITS))


def strings(vectors: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """One BITS-bit number per vector and tree, the first hyperplane as the highest bit."""
    out = np.empty((len(vectors), normals.shape[1] // BITS), dtype=U64)
    for tree in range(out.shape[1]):
        side = vectors @ normals[:, tree * BITS : (tree + 1) * BITS] > 0
        out[:, tree] = np.packbits(side, axis=1).view(">u8").reshape(-1)
    return out


def hashed(vectors: DataFrame, id_col: str, vector_col: str, trees: int) -> DataFrame:
    """(id, dim, vector, strings) of the vectors that take part; vectors as numbers of 32 or 64 bits in a binary, as given."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    own = F.col(f"`{vector_col}`") if single else F.col(f"`{vector_col}`").cast("array<double>")
    usable = own.isNotNull() & F.col(f"`{id_col}`").isNotNull()
    usable &= F.coalesce(F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(own, lambda x: x != 0)
    given = vectors.where(usable).select(F.col(f"`{id_col}`").cast("long").alias("id"), own.alias("v")).groupBy("id").agg(F.min("v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dims = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    if dim not in normals:
                        normals[dim] = planes(dim, trees)
                    part = batch.filter(pa.array(dims == dim))
                    flat = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    bits = strings(scaled(flat), normals[dim]).view(np.int64)
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * trees)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id"), pa.array([dim] * len(part), pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary()),
                            pa.ListArray.from_arrays(offsets, pa.array(bits.reshape(-1))),
                        ],
                        ["id", "dim", "vector", "strings"],
                    )

    return given.mapInArrow(run, "id long, dim int, vector binary, strings array<long>")


def leaf_of(bits: Column, depth: int) -> Column:
    return F.shiftrightunsigned(bits, BITS - depth) if depth else F.lit(0).cast("long")


def placed(rows: DataFrame, parts: DataFrame, depth: int, trees: int) -> DataFrame:
    """Every vector once per tree, at its place: HOME names its block, bits its string."""
    each = rows.select("id", "dim", "vector", F.posexplode(F.slice("strings", 1, trees)).alias("tree", "bits"))
    dealt = each.withColumn("leaf", leaf_of(F.col("bits"), depth)).join(parts, ["dim", "tree", "leaf"], "left")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    return dealt.withColumn("part", part).select(*HOME, "id", "bits", "vector")


def scaled(vectors: np.ndarray) -> np.ndarray:
    """As doubles, the largest component 1, so that lengths near the limits of a number do no harm."""
    vectors = vectors.astype(np.float64)
    return vectors / np.abs(vectors).max(axis=1)[:, None]


class Block:
    """Vectors in the order of their strings."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray, vectors: np.ndarray):
        self.ids, self.bits, self.vectors = ids, bits, vectors
        self.unit = unit(vectors)

    def range(self, bits: int, depth: int) -> tuple[int, int]:
        """The vectors that share at least `depth` bits with a string."""
        if depth <= 0:
            return 0, len(self.ids)
        low = bits >> (BITS - depth) << (BITS - depth)
        high = low + (1 << (BITS - depth))
        end = len(self.bits) if high >= 1 << BITS else int(np.searchsorted(self.bits, U64(high)))
        return int(np.searchsorted(self.bits, U64(low))), end

    def descend(self, bits: int, least: int) -> int:
        """The greatest depth at which at least `least` vectors match (0: never so many)."""
        if len(self.bits) < least:
            return 0
        at = int(np.searchsorted(self.bits, U64(bits)))
        around = self.bits[max(0, at - least) : at + least] ^ U64(bits)
        nth = int(np.sort(around)[least - 1])
        return BITS - nth.bit_length()


def unit(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, the same for equal vectors wherever they stand."""
    v, q = scaled(vectors), scaled(query[None])[0]
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


FOUND = "query_id long, vec_id long, score double"


def visits(vectors: DataFrame, queries: DataFrame, nearest: int, kind: str) -> DataFrame:
    """The best `nearest` of each block that a query visits.

    `vectors` is what `placed` gives; `queries` has depth too (null: by descent). `kind` is the
    numbers' type. A task holds one block at a time; its queries stream past it.
    """
    columns = [*HOME, "id", "bits", "vector"]
    left = vectors.select(*columns, F.lit(None).cast("int").alias("depth"), F.lit(0).alias("asks"))
    right = queries.select(*columns, F.col("depth").cast("int").alias("depth"), F.lit(1).alias("asks"))
    # Within a block by the strings as unsigned numbers; its queries come last.
    order = [*HOME, "asks", F.col("bits").bitwiseXOR(F.lit(-(1 << 63)))]
    both = left.union(right).repartition(*HOME).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held, block = None, [], None
        for batch in batches:
            homes = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*HOME, "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((homes[1:] != homes[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                here, asks = tuple(homes[a, :4].tolist()), bool(homes[a, 4])
                ids = batch.column("id").slice(a, b - a).to_numpy(zero_copy_only=False)
                bits = batch.column("bits").slice(a, b - a).to_numpy(zero_copy_only=False).view(U64)
                data = np.frombuffer(b"".join(batch.column("vector").slice(a, b - a).to_pylist()), dtype=kind).reshape(b - a, here[0])
                if here != home:
                    home, held, block = here, [], None
                if not asks:
                    held.append((ids, bits, data))
                    continue
                if block is None and held:
                    block, held = Block(*map(np.concatenate, zip(*held))), []
                if block is not None:  # else no vector has this prefix
                    yield answers(block, ids, bits, data, batch.column("depth").slice(a, b - a).to_pylist(), nearest)

    return both.mapInArrow(run, FOUND)


def answers(block: Block, ids: np.ndarray, bits: np.ndarray, queries: np.ndarray, depths: list[int | None], nearest: int) -> pa.RecordBatch:
    """The best of one block for some queries."""
    own, found, scores = [], [], []
    for k, direction in enumerate(unit(queries)):
        string = int(bits[k])
        a, b = block.range(string, block.descend(string, MATCHES) if depths[k] is None else depths[k])
        rough = block.unit[a:b] @ direction
        rough[block.ids[a:b] == ids[k]] = -np.inf
        if len(rough) > nearest:  # some more than the best, told apart exactly below
            chosen = np.flatnonzero(rough >= np.partition(rough, -nearest)[-nearest] - 1e-9)
        else:
            chosen = np.arange(len(rough))
        chosen = chosen[rough[chosen] > -np.inf] + a
        score = cosines(block.vectors[chosen], queries[k]) if len(chosen) else np.empty(0)
        best = np.lexsort((block.ids[chosen], -score))[:nearest]
        own.append(np.full(len(best), ids[k]))
        found.append(block.ids[chosen[best]])
        scores.append(score[best])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (own, found, scores)], ["query_id", "vec_id", "score"])


def best_of(found: DataFrame, nearest: int) -> DataFrame:
    """(query_id, best): the nearest found, best first, each once."""
    each = F.struct((-F.col("score")).alias("far"), "vec_id")
    return found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set(each)), 1, nearest).alias("best"))


def search(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST,
    trees: int = TREES, miss: float = MISS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest found of each row for which `is_query` (on `id`) holds."""
    rows = cut_lineage(hashed(vectors, id_col, vector_col, trees), "forest-strings")
    depth = max(0, (rows.count() - 1) // block_rows).bit_length()
    leaves = rows.select("dim", F.posexplode("strings").alias("tree", "bits")).select("dim", "tree", leaf_of(F.col("bits"), depth).alias("leaf"))
    parts = leaves.groupBy("dim", "tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * block_rows)).cast("int").alias("parts"))
    parts = cut_lineage(parts.where("parts > 1"), "forest-parts")
    asked = cut_lineage(rows.where(is_query), "forest-queries")
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"

    def sent(queries: DataFrame) -> DataFrame:
        """Queries (dim, tree, leaf, ...) to all parts of their leaf."""
        return queries.join(parts, ["dim", "tree", "leaf"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))

    each = asked.select("id", "dim", "vector", F.posexplode("strings").alias("tree", "bits"))
    probes = each.where(F.col("tree") < PROBES).withColumn("leaf", leaf_of(F.col("bits"), depth)).withColumn("depth", F.lit(None).cast("int"))
    first = cut_lineage(best_of(visits(placed(rows, parts, depth, PROBES), sent(probes), nearest, kind), nearest), "forest-first")
    # Agreement in a bit of what is as near as the last of the best; fewer than asked for: everything is searched.
    agree = 1 - F.acos(F.least(F.lit(1.0), -F.element_at("best", nearest)["far"])) / np.pi
    deep = F.floor(F.log(F.lit(1 - miss ** (1 / trees))) / F.log(agree))
    deep = F.when(F.size("best") < nearest, 0).when(agree >= 1, BITS).otherwise(F.least(F.lit(BITS), deep)).cast("int")
    levels = cut_lineage(first.select(F.col("query_id").alias("id"), deep.alias("depth")), "forest-levels")
    climbing = each.join(levels, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    # Above the blocks' own depth, every block below the prefix is visited.
    leaf, wide = f"shiftrightunsigned(bits, {BITS - depth})" if depth else "0L", f"greatest(0, {depth} - depth)"
    base, step = F.expr(f"shiftright({leaf}, {wide})"), F.expr(f"shiftleft(1L, {wide})")
    climbing = climbing.withColumn("leaf", F.explode(F.sequence(base * step, base * step + step - 1)))
    climbed = visits(placed(rows, parts, depth, trees), sent(climbing), nearest, kind)
    found = best_of(climbed.union(first.select("query_id", F.inline("best")).selectExpr("query_id", "vec_id", "-far AS score")), nearest)
    ranked = found.select("query_id", F.posexplode("best").alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))


@register("op10_forest")
def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
