"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, components.

Unit vectors are assigned to the nearest of some centres, fitted for each length on a bounded sample (``SAMPLE`` rows). A vector is also a guest of
each lower-numbered cell whose border with its own is within the threshold's angle: if x and y are within an angle a and
lie in different cells, y's distance to the border plane is at most sin(a). So each linked pair meets in
the smaller of its two cells, and recall is 1 whatever the centres. Cells are cut into blocks of ``ROWS`` vectors, and block pairs are
multiplied; each task gives counts and one link per linked vector to its group's least, never all pairs.

Only vectors of one label (not null) and one length are compared. Vectors that are null, zero, or hold null
or non-finite components link with nothing. Equal vectors are compared once. Repeated ids are vectors of their own; a component's
id is its least non-null vec_id. The cosine is taken in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch
from lectern.llm.components import components

#: Rows a length's centres are fitted on at most, vectors a cell, least and most cells; beyond the most, cells grow and are cut into more blocks.
SAMPLE, PER_CELL, LEAST_CELLS, MAX_CELLS = 20_000, 4_000, 8, 4_096
#: Lengths that get centres of their own, the commonest; vectors of any others are in one cell a length, in blocks as well.
MAX_DIMS = 16
ROWS = 1_024
_ROUNDS = 8


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the unit vector's bytes and its dimension; null where the vector can't be compared."""
    for batch in batches:
        column = batch.column("embedding")
        flat = column.flatten()
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        values = np.where(bad, np.nan, flat.fill_null(0.0).to_numpy(zero_copy_only=False))
        sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        named = batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        start = np.cumsum(sizes) - sizes
        out: list[bytes | None] = [None] * batch.num_rows
        for dim in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero((sizes == dim) & named)
            x = values[start[rows][:, None] + np.arange(dim)]
            peak = np.abs(x).max(axis=1, initial=0)
            good = np.isfinite(x).all(axis=1) & (peak > 0)
            x = x[good] / peak[good][:, None]
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            for i, unit in zip(rows[good].tolist(), x):
                out[i] = unit.tobytes()
        dims = [len(u) // 8 if u else None for u in out]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "unit"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = _ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centres of unit vectors."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return np.unique(centres, axis=0)


def cells_for(n: int, sampled: int) -> int:
    """Cells for n vectors: in proportion to n between the least and the most, and at least four sampled vectors each."""
    return max(1, min(max(LEAST_CELLS, n // PER_CELL), MAX_CELLS, sampled // 4))


def fit(units: DataFrame) -> dict[int, np.ndarray]:
    """Centres by length, each from at most ``SAMPLE`` vectors picked by their hash."""
    found = {}
    for r in units.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MAX_DIMS).collect():
        share = min(1.0, 1.2 * SAMPLE / r["count"])
        of_dim = units.where(F.col("dim") == r.dim).where(F.pmod(F.xxhash64("unit"), F.lit(1_000_003)) < share * 1_000_003)
        rows = of_dim.select("unit").limit(SAMPLE).collect()
        if rows:
            x = np.stack([np.frombuffer(v.unit) for v in rows])
            found[r.dim] = spherical_kmeans(x, cells_for(r["count"], len(x)))
    return found


def _place(by_dim: dict[int, np.ndarray], threshold: float):
    sine = math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = {d: np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T))) + 1e-7 for d, c in by_dim.items()}
        for batch in batches:
            units, dims = batch.column("unit").to_pylist(), batch.column("dim").to_numpy()
            rest = np.flatnonzero(~np.isin(dims, list(by_dim)))
            rows, cells, homes = [rest], [np.zeros(rest.size, np.int64)], [np.zeros(rest.size, np.int64)]
            for dim, centres in by_dim.items():
                own = np.flatnonzero(dims == dim)
                for a in range(0, own.size, 512):
                    part = own[a : a + 512]
                    near = np.stack([np.frombuffer(units[i]) for i in part.tolist()]) @ centres.T
                    home = np.argmax(near, axis=1)
                    margin = near[np.arange(part.size), home][:, None] - near
                    # a pair meets in the smaller of its cells, so no vector is a guest of a cell above its own
                    i, c = np.nonzero((margin <= sine * gaps[dim][home]) & (np.arange(len(centres))[None, :] <= home[:, None]))
                    rows.append(part[i])
                    cells.append(c)
                    homes.append(home[i])
            taken = batch.take(pa.array(np.concatenate(rows), pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(homes), pa.int32())], names=[*batch.schema.names, "cell", "home"])

    return run


def _products(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        cell = table["cell"][0].as_py()
        block = table["block"].to_numpy()
        x = np.stack([np.frombuffer(u) for u in table["unit"].to_pylist()])
        uid, copies, home = (table[c].to_numpy() for c in ("uid", "copies", "home"))
        one = bool((block == block[0]).all())
        left = np.arange(len(x)) if one else np.flatnonzero(block == block.min())
        right = left if one else np.flatnonzero(block != block.min())
        linked = x[left] @ x[right].T >= threshold
        linked &= np.minimum(home[left][:, None], home[right][None, :]) == cell
        if one:
            np.fill_diagonal(linked, False)
        label = uid.copy()
        while True:
            top = np.iinfo(np.int64).max
            before = label.copy()
            label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], top).min(axis=1))
            label[right] = np.minimum(label[right], np.where(linked, label[left][:, None], top).min(axis=0))
            if (label == before).all():
                break
        links = np.zeros(len(x), np.int64)
        links[left] += linked @ copies[right]
        if not one:
            links[right] += copies[left] @ linked
        some = np.flatnonzero(links)
        return pa.table({"uid": uid[some], "links": links[some], "least": label[some]})

    return run


def dedup(df: DataFrame, scratch: Scratch, threshold: float = 0.98) -> DataFrame:
    """Per row of ``df`` (vec_id, embedding, label): n_links, component_id and kept."""
    picked = df.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    rows = picked.mapInArrow(_units, "vec_id bigint, label string, dim int, unit binary").withColumn("uid", F.monotonically_increasing_id())
    rows = scratch.save(rows, "rows")
    same = rows.where("unit IS NOT NULL").groupBy("label", "dim", "unit").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies"))
    units = scratch.save(same, "units")
    placed = scratch.save(units.mapInArrow(_place(fit(units), threshold), "label string, dim int, unit binary, uid bigint, copies bigint, cell int, home int"), "placed")
    sizes = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("blocks"))
    cut = placed.join(sizes, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    found = met.groupBy("label", "dim", "cell", "lo", "hi").applyInArrow(_products(threshold), "uid bigint, links bigint, least bigint")
    found = scratch.save(found, "found")
    scratch.drop("placed")
    counted = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("least").alias("b")), scratch, "links")
    reps = units.select("label", "dim", "unit", "copies", "uid").join(counted, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    reps = reps.select("label", "dim", "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "uid").alias("root"))
    named = rows.join(reps, ["label", "dim", "unit"], "left").withColumn("root", F.coalesce("root", "uid")).select("vec_id", "links", "root")
    least = named.groupBy("root").agg(F.min("vec_id").alias("least"))
    out = named.join(least, "root").select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
