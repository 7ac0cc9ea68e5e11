"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are normalised in double precision and rotated to the principal axes of a bounded sample (a rotation keeps
cosines, so the sample decides only the speed). Equal vectors of a label are one class with a multiplicity. Classes lie
in cells of their three leading coordinates; unit vectors whose cosine reaches t are at most sqrt(2 - 2t) apart in every
coordinate, so only neighbouring cells can hold links. Cells are cut into blocks of at most BLOCK classes, and each pair
of blocks of neighbouring cells is one tile, compared in one task: the products of the leading dimensions are accumulated
first, what the rest can still add is bounded by the product of the suffix norms, and a pair is left as soon as its
cosine cannot reach the threshold. What remains is decided by the cosine of the vectors themselves in double precision.
A tile returns counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .components import components

THRESHOLD = 0.93
#: Vectors that the rotation is fitted on.
SAMPLE = 20_000
#: Classes in a block; a tile holds two blocks.
BLOCK = 2048
#: Dimensions accumulated before each look at the bound.
STEPS = (8, 16, 32)
STRIP = 256
SLACK = 1e-9


def _unit(batch: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Positions and doubles of the usable vectors."""
    at, rows = [], []
    for i, v in enumerate(batch):
        if v.is_valid and (x := v.values).null_count == 0:
            x = x.to_numpy(zero_copy_only=False).astype(np.float64)
            # scaled by the largest component first, so that squares neither overflow nor vanish
            if len(x) and np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                at.append(i)
                rows.append((x / top) / np.linalg.norm(x / top))
    return at, rows


def fit_rotations(usable: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Principal axes by dimension, from at most ``sample`` vectors chosen by the hash of their id."""
    got = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("dim", "x").toPandas()
    out = {}
    for dim, part in got.groupby("dim"):
        x = np.stack([np.frombuffer(v, np.float64) for v in part["x"]])
        out[int(dim)] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def _rotate(x: np.ndarray, rotations: dict[int, np.ndarray]) -> np.ndarray:
    axes = rotations.get(x.shape[1])
    return x if axes is None else x @ axes


def tile_links(pa_: np.ndarray, pb: np.ndarray, xa: np.ndarray, xb: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine >= threshold, in strips; i < j within one block. pa_, pb: rotated, xa, xb: as given."""
    dim = pa_.shape[1]
    cuts = [c for c in STEPS if c < dim] + [dim]
    rest = lambda p, c: np.sqrt(np.maximum((p[:, c:] ** 2).sum(axis=1), 0))
    suffix = {c: (rest(pa_, c), rest(pb, c)) for c in cuts}
    for s in range(0, len(pa_), STRIP):
        part, c = pa_[s : s + STRIP], cuts[0]
        acc = part[:, :c] @ pb[:, :c].T
        alive = acc + suffix[c][0][s : s + STRIP, None] * suffix[c][1][None, :] >= threshold - SLACK
        if same:
            alive &= np.arange(len(pb))[None, :] > np.arange(s, s + len(part))[:, None]
        i, j = np.nonzero(alive)
        acc = acc[i, j]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if not len(i):
                break
            acc = acc + np.einsum("nd,nd->n", part[i, lo:hi], pb[j, lo:hi])
            keep = acc + suffix[hi][0][s + i] * suffix[hi][1][j] >= threshold - SLACK
            i, j, acc = i[keep], j[keep], acc[keep]
        if len(i):
            keep = np.einsum("nd,nd->n", xa[s + i], xb[j]) >= threshold
            yield s + i[keep], j[keep]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Two rows link when their labels are equal and not null, their vectors equally long and their cosine in double
    precision at least ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null label or vec_id, link with nothing: n_links 0, component_id = vec_id. Rows that repeat a vec_id are
    vectors of their own and link like others. Columns other than the three are not read. kept is false where vec_id
    is null. An empty table gives no rows."""
    spark = vectors.sparkSession
    bound_batches(spark)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            at, rows = _unit(b.column(2))
            x: list[bytes | None] = [None] * b.num_rows
            for i, v in zip(at, rows, strict=True):
                x[i] = (v + 0.0).tobytes()
            dim = [None if v is None else len(v) // 8 for v in x]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(dim, pa.int32()), pa.array(x, pa.binary()), pa.array([v and hashlib.sha256(v).digest() for v in x], pa.binary())], names=["vec_id", "label", "dim", "x", "digest"])

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(given.mapInArrow(prepare, "vec_id long, label long, dim int, x binary, digest binary"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("digest").isNotNull()
    usable = rows.filter(ok)
    rotations = fit_rotations(usable, sample)
    width = float(np.sqrt(2 - 2 * threshold) + 1e-6)

    keys = ["label", "dim", "digest"]
    classes = usable.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    # a class is told by its place, not by its smallest id, which rows of other classes may repeat
    numbered = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    # small groups need no cells: each coordinate used cuts a group into a few cells and triples the neighbours
    group = materialize(numbered.groupBy("label", "dim").agg(F.count("*").alias("classes")))
    cuts = sum(F.when(F.col("classes") > block * 6**k, 1).otherwise(0) for k in range(3))
    vec = usable.select(*keys, "vec_id", "x").join(numbered.select(*keys, "node", "rep", "m"), keys).filter("vec_id = rep").dropDuplicates(["node"])
    vec = vec.select("node", "m", "label", "dim", "x").join(group.select("label", "dim", cuts.alias("cuts")), ["label", "dim"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.schema.get_field_index("x")).to_pylist()
            used = b.column(5).to_numpy()
            cell = [np.floor(np.pad(_rotate(np.frombuffer(v, np.float64)[None, :], rotations)[0, :3], (0, 3))[:3] / width).astype(int) * (np.arange(3) < n) for v, n in zip(x, used, strict=True)]
            yield pa.record_batch([*b.columns[:5], *(pa.array([int(c[k]) for c in cell], pa.int32()) for k in range(3))], names=[*b.schema.names[:5], "c0", "c1", "c2"])

    placed = materialize(vec.select("node", "m", "label", "dim", "x", "cuts").mapInArrow(place, "node long, m long, label long, dim int, x binary, c0 int, c1 int, c2 int"))
    cell = ["label", "dim", "c0", "c1", "c2"]
    blocks = materialize(placed.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("nb")))
    offsets = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    around = blocks.withColumn("o", F.explode(F.array(*[F.array(*map(F.lit, o)) for o in offsets])))
    around = around.select("label", "dim", *[(F.col(f"c{k}") + F.col("o")[k]).alias(f"c{k}") for k in range(3)], F.struct(F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("nb").alias("dn")).alias("near"))
    beside = materialize(blocks.join(around, cell).groupBy(*cell, "nb").agg(F.collect_list("near").alias("near")))  # at most 27 each
    dealt = placed.join(beside, cell).withColumn("part", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    me = F.struct("c0", "c1", "c2", F.col("part").alias("p"))
    other = dealt.withColumn("n", F.explode("near")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n.dn") - 1)))
    them = F.struct(F.col("n.d0").alias("c0"), F.col("n.d1").alias("c1"), F.col("n.d2").alias("c2"), F.col("q").alias("p"))
    sent = other.select("label", "dim", F.least(me, them).alias("lo"), F.greatest(me, them).alias("hi"), (me > them).cast("int").alias("side"), "node", "m", "x")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        same = bool((part["lo0"] == part["hi0"]).all() and (part["lo1"] == part["hi1"]).all() and (part["lo2"] == part["hi2"]).all() and (part["lo3"] == part["hi3"]).all())
        a = part[part["side"] == 0]
        b = a if same else part[part["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": [], "to": []}).astype("int64")
        xa, xb = (np.frombuffer(b"".join(s["x"]), np.float64).reshape(len(s), -1) for s in (a, b))
        ma, mb = a["m"].to_numpy(np.int64), b["m"].to_numpy(np.int64)
        ca, cb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        forest: list[tuple[int, int]] = []
        up = list(range(len(a) + len(b)))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for i, j in tile_links(_rotate(xa, rotations), _rotate(xb, rotations), xa, xb, threshold, same):
            np.add.at(ca, i, mb[j])
            np.add.at(ca if same else cb, j, ma[i])
            shift = 0 if same else len(a)
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                if up[p] != up[q + shift] and (x := root(p)) != (y := root(q + shift)):
                    up[max(x, y)] = min(x, y)
                    forest.append((p, q))
        na, nb = a["node"].to_numpy(), b["node"].to_numpy()
        node = np.concatenate((na[ca > 0], nb[cb > 0] if not same else na[:0], [na[p] for p, _ in forest]))
        links = np.concatenate((ca[ca > 0], cb[cb > 0] if not same else ca[:0], [0] * len(forest)))
        to = np.concatenate((np.full((ca > 0).sum() + (0 if same else (cb > 0).sum()), -1), [nb[q] for _, q in forest]))
        return pd.DataFrame({"node": node, "links": links, "to": to}).astype("int64")

    flat = sent.select("label", "dim", *[F.col(f"{s}.{f}").alias(f"{s}{k}") for s in ("lo", "hi") for k, f in enumerate(("c0", "c1", "c2", "p"))], "side", "node", "m", "x")
    tile = ["label", "dim", *[f"{s}{k}" for s in ("lo", "hi") for k in range(4)]]
    found = materialize(flat.groupBy(*tile).applyInPandas(compare, "node long, links long, to long"))

    linked = found.filter("to < 0").groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.filter("to >= 0").select(F.col("node").alias("a"), F.col("to").alias("b")))
    base = numbered.join(linked, "node", "left").join(comp, "node", "left").withColumn("root", F.coalesce("component", "node"))
    base = materialize(base.select(*keys, "rep", "root", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    least = materialize(base.groupBy("root").agg(F.min("rep").alias("component_id")))
    member = materialize(base.join(least, "root").select(*keys, "n_links", "component_id"))
    good = rows.filter(ok).join(member, keys).select("vec_id", "n_links", "component_id")
    bad = rows.filter(~F.coalesce(ok, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
