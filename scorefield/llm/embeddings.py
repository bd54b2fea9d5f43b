"""Embedding near-dedup: all pairs of one label whose cosine reaches a threshold, by tiles in the order of principal axes.

The axes come from the second moments of all vectors. Vectors of a label are cut into tiles along the first axis and then
along the second; tile pairs too far apart on the first axes together cannot link, and no vector is copied for them. Inside
a tile pair products are accumulated over the leading axes first; with the norms of what is left they bound each cosine, and a block stops once no pair can reach the threshold.
What the bound leaves is decided by the cosine of the given vectors in double precision.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, list_column, materialize, read_table, star_edges

THRESHOLD = 0.93
#: Vectors of a tile at most, the width of the bins along an axis that tiles are made of, and the axes that tile pairs are told apart on.
TILE, BIN, AXES = 2048, 0.005, 4
BLOCK, SLACK = 256, 1e-9


def _matrix(column) -> np.ndarray:
    at, values = list_column(column)
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at) - 1, -1) if len(at) > 1 else np.zeros((0, 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that their largest component is near one and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns: the axes of the second moments of all unit vectors of this dimension, the strongest first."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _scaled(_matrix(batch.column(0)))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    sums = vectors.where(F.size("embedding") == dim).select("embedding").mapInArrow(moments, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((dim, dim))
    for i, j, v in sums.collect():  # dim * dim numbers
        out[i, j] = v
    return np.linalg.eigh((out + out.T) / 2)[1][:, ::-1].copy()


def _tile_pair(axes: dict, threshold: float):
    def judge(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        x = _scaled(_matrix(table["embedding"])[order])
        cid, node, many = (table[c].to_numpy()[order] for c in ("cid", "node", "many"))
        n_a = int((side == 0).sum())
        same = n_a == len(side)  # a tile with itself has one side only
        b_from = 0 if same else n_a
        norm = np.sqrt((x * x).sum(axis=1))
        z = x / norm[:, None]
        if x.shape[1] in axes:
            z = z @ axes[x.shape[1]]
        dim = z.shape[1]
        cuts = sorted({min(c, dim) for c in (8, 16, 32, dim)})
        rest = [np.sqrt(np.maximum((z[:, c:] ** 2).sum(axis=1), 0)) for c in cuts]
        links = np.zeros(len(x), np.int64)
        star_a, star_b = [], []
        zb, xb, nb = z[b_from:], x[b_from:], norm[b_from:]
        for lo in range(0, n_a, BLOCK):
            hi = min(lo + BLOCK, n_a)
            product = np.zeros((hi - lo, len(zb)))
            done = 0
            a = b = np.zeros(0, np.int64)
            for cut, left in zip(cuts, rest):
                product += z[lo:hi, done:cut] @ zb[:, done:cut].T
                done = cut
                may = product + left[lo:hi, None] * left[None, b_from:] >= threshold - SLACK
                if same:
                    may &= np.arange(lo, hi)[:, None] < np.arange(len(zb))[None, :]
                found = int(may.sum())
                if not found:
                    break
                if cut == dim or found <= may.size // 64:
                    a, b = np.nonzero(may)
                    break
            if not len(a):
                continue
            if len(a) <= product.size // 64:
                cosine = np.einsum("ij,ij->i", x[lo + a], xb[b]) / (norm[lo + a] * nb[b])
            else:
                cosine = ((x[lo:hi] @ xb.T) / (norm[lo:hi, None] * nb[None, :]))[a, b]
            a, b = a[cosine >= threshold] + lo, b[cosine >= threshold] + b_from
            if len(a):
                links += np.bincount(a, weights=many[b], minlength=len(x)).astype(np.int64) + np.bincount(b, weights=many[a], minlength=len(x)).astype(np.int64)
                nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = star_edges(len(nodes), flat[: len(a)], flat[len(a) :])
                star_a.append(nodes)
                star_b.append(nodes[root])
        root = np.arange(len(x))
        if star_a:
            root = star_edges(len(x), np.concatenate(star_a), np.concatenate(star_b))
        keep = links > 0
        return pa.table({"cid": cid[keep], "links": links[keep], "a": node[keep], "b": node[root][keep]})

    return judge


def tiled(placed: DataFrame, tile: int) -> DataFrame:
    """Vectors with the number of their tile. placed: label, dim, b0, b1 (bins on the first two axes) and cid among the columns.

    A label is cut into slabs along the first axis, about as many as each has tiles along the second; a bin on the second axis
    that holds more than a tile is dealt out by cid.
    """
    grid = materialize(placed.groupBy("label", "dim", "b0", "b1").agg(F.count("*").alias("n")), "vector-grid")
    so_far = "sum(n) over (partition by label, dim order by b0 rows between unbounded preceding and current row) - n"
    total = "sum(n) over (partition by label, dim)"
    slabs = grid.groupBy("label", "dim", "b0").agg(F.sum("n").alias("n")).selectExpr("label", "dim", "b0", f"({so_far}) div cast({tile} * ceil(sqrt(ceil(({total}) / {tile}))) as bigint) as slab")
    slabs = materialize(slabs, "vector-slabs")
    so_far = "sum(n) over (partition by label, dim, slab order by b1 rows between unbounded preceding and current row) - n"
    cells = grid.join(slabs, ["label", "dim", "b0"]).groupBy("label", "dim", "slab", "b1").agg(F.sum("n").alias("n"))
    cells = materialize(cells.selectExpr("label", "dim", "slab", "b1", f"({so_far}) div {tile} as first", f"cast(ceil(n / {tile}) as int) as parts"), "vector-cells")
    put = placed.join(slabs, ["label", "dim", "b0"]).join(cells, ["label", "dim", "slab", "b1"])
    return put.withColumn("tile", F.shiftleft("slab", 32) + F.col("first") + F.pmod("cid", "parts")).drop("slab", "first", "parts")


def tile_pairs(put: DataFrame, threshold: float) -> DataFrame:
    """label, dim, ta, tb of the tiles (ta <= tb) whose boxes on the first axes are near enough for a link."""
    axes = [c for c in put.columns if c.startswith("b")]
    boxes = put.groupBy("label", "dim", "tile").agg(*(f(c).alias(f"{n}_{c}") for c in axes for f, n in ((F.min, "lo"), (F.max, "hi"))))
    boxes = materialize(boxes, "vector-boxes")
    gaps = " + ".join(f"pow(greatest(0, r.lo_{c} - l.hi_{c} - 1, l.lo_{c} - r.hi_{c} - 1) * {BIN}D, 2)" for c in axes)
    near = F.expr(f"l.label = r.label and l.dim = r.dim and l.tile <= r.tile and {gaps} <= {max(0.0, 2 - 2 * threshold) + 1e-6}D")
    return boxes.alias("l").join(boxes.alias("r"), near).selectExpr("l.label as label", "l.dim as dim", "l.tile as ta", "r.tile as tb")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included), kept.

    Rows link if their labels are equal and not null and their cosine reaches the threshold, ties with it included. Null, empty
    and zero vectors and those with null or non-finite components link with nothing, nor do vectors of different lengths.
    Repeated rows are vectors of their own. Only vectors link: rows that share a vec_id, or have none, are not linked by that. A
    null vec_id names no component; where a component has no other, its component_id is null. Vectors of any finite size and
    length are taken, an empty table gives no rows, and other columns are ignored.
    """
    spark = embeddings.sparkSession
    kept_as = embeddings.schema["embedding"].dataType.simpleString()
    kept_as = kept_as if kept_as in ("array<float>", "array<double>") else "array<double>"
    given = embeddings.select("vec_id", "label", F.col("embedding").cast(kept_as).alias("embedding"), F.col("vec_id").cast("long").alias("id"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    valid = given.where(good)
    classes = valid.groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("many")).withColumn("cid", F.monotonically_increasing_id())
    classes = materialize(classes.withColumn("node", F.col("cid")), "vector-classes")
    dims = [r[0] for r in classes.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count")).limit(1).collect()]
    axes = spark.sparkContext.broadcast({d: principal_axes(classes, d) for d in dims})

    def bins_of(batches):
        for batch in batches:
            at, values = list_column(batch.column(1))
            n = np.diff(at)
            out = np.zeros((batch.num_rows, AXES))
            for dim in np.unique(n):
                rows = np.flatnonzero(n == dim)
                x = _scaled(values.to_numpy(zero_copy_only=False)[at[rows][:, None] + np.arange(dim)].astype(np.float64))
                turned = x @ (axes.value[dim] if dim in axes.value else np.eye(dim))[:, :AXES]
                out[rows, : turned.shape[1]] = turned / np.linalg.norm(x, axis=1, keepdims=True)
            out = np.floor(out / BIN).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(b)) for b in out.T)], [*batch.schema.names, *(f"b{i}" for i in range(AXES))])

    kind = classes.schema["label"].dataType.simpleString()
    bins = ", ".join(f"b{i} int" for i in range(AXES))
    placed = classes.select("label", "embedding", "node", "many", "cid").mapInArrow(bins_of, f"label {kind}, embedding {kept_as}, node long, many long, cid long, {bins}")
    placed = materialize(placed.withColumn("dim", F.size("embedding")), "placed-vectors")
    put = materialize(tiled(placed, tile), "tiled-vectors")
    discard(placed)
    pairs = tile_pairs(put, threshold)
    sides = pairs.selectExpr("label", "dim", "ta as tile", "ta", "tb", "0 as side").unionByName(pairs.where("ta <> tb").selectExpr("label", "dim", "tb as tile", "ta", "tb", "1 as side"))
    dealt = put.join(sides, ["label", "dim", "tile"]).select("label", "dim", "ta", "tb", "side", "embedding", "node", "many", "cid")
    found = dealt.groupBy("label", "dim", "ta", "tb").applyInArrow(lambda key, table: _tile_pair(axes.value, threshold)(table), "cid long, links long, a long, b long")
    found = materialize(found, "vector-links")
    components = connected_components(found.select("a", "b"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    done = classes.join(links, "cid", "left").join(components, "node", "left")
    done = done.select("label", "embedding", "id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("c"))
    done = materialize(done, "vector-components")
    done = done.join(done.groupBy("c").agg(F.min("id").alias("component_id")), "c")
    linked = valid.join(done.select("label", "embedding", "n_links", "component_id"), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = given.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, count(link.b) AS n_links, any_value(component_id) AS component_id, v.vec_id = any_value(component_id) AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN link ON link.a = v.vec_id GROUP BY v.vec_id
"""
