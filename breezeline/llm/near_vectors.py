"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors are folded into one node. Nodes are rotated to their principal
axes, laid out in strips of the first coordinate and cut into blocks; a tile is
a pair of blocks whose strips are near enough to hold a link. Within a tile the
leading coordinates are multiplied first, together with the norm of what is
left of each vector, which bounds the rest of the product; only pairs that may
still reach the threshold go on to more coordinates, and last to the full
product in double precision. Tiles return, for each node, a count of links and
one edge of a spanning forest, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components, landed

BLOCK = 2048  # nodes of a block; a tile is two blocks
AXES_SAMPLE = 10_000  # vectors that the axes are fitted on; they only order the work
LEADS = (16, 32)  # coordinates multiplied before each test of the bound
STRIPS = 32  # of the first coordinate, from -1 to 1
ROWS = 256  # rows of a tile worked on at once


def _unit(lists: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision, shorter ones padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    out /= np.abs(out).max(1, keepdims=True)  # squares of very large or small parts stay in range
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _bounded(x: np.ndarray, lead: int) -> np.ndarray:
    """Leading coordinates, and the norm of the rest."""
    rest = np.sqrt(np.maximum((x[:, lead:] ** 2).sum(1, keepdims=True), 0))
    return np.concatenate([x[:, :lead], rest], axis=1).astype(np.float32)


def _hits(left, right, axes, cosine):
    """For strips of left rows: (first row, boolean rows x right of the pairs with the cosine)."""
    a, b = left @ axes, right @ axes
    leads = [n for n in LEADS if n < a.shape[1]]
    tables = [(_bounded(a, n), _bounded(b, n)) for n in leads]
    for low in range(0, len(left), ROWS):
        part = slice(low, low + ROWS)
        hit = np.zeros((min(ROWS, len(left) - low), len(right)), bool)
        if leads:
            i, j = np.nonzero(tables[0][0][part] @ tables[0][1].T >= cosine - 1e-5)
        if not leads or len(i) > hit.size // 20:
            yield low, left[part] @ right.T >= cosine
            continue
        for x, y in tables[1:]:
            may = np.einsum("nd,nd->n", x[i + low], y[j]) >= cosine - 1e-5
            i, j = i[may], j[may]
        full = np.einsum("nd,nd->n", left[i + low], right[j]) >= cosine
        hit[i[full], j[full]] = True
        yield low, hit


def _tile(width, axes, cosine):
    def run(table):
        table = table.combine_chunks()
        blocks, nodes, copies = (table.column(c).to_numpy() for c in ("block", "node", "copies"))
        order = np.argsort(blocks, kind="stable")
        nodes, copies = nodes[order], copies[order].astype(np.float64)
        x = _unit(table.column("vector").take(pa.array(order)), width)
        first = int(np.searchsorted(blocks[order], blocks.max()))
        alone = first == 0  # one block meets itself
        left = slice(0, len(nodes)) if alone else slice(0, first)
        right = slice(0, len(nodes)) if alone else slice(first, len(nodes))
        links, label = np.zeros(len(nodes)), np.arange(len(nodes))
        for low, hit in _hits(x[left], x[right], axes, cosine):
            if alone:
                hit[np.arange(len(hit)), np.arange(len(hit)) + low] = False
            links[low : low + len(hit)] += hit @ copies[right]
            if not alone:
                links[right] += hit.T @ copies[low : low + len(hit)]
            for i in np.flatnonzero(hit.any(1)):
                met = np.unique(np.append(label[right][hit[i]], label[low + i]))
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        some = links > 0
        return pa.table({
            "node": pa.array(nodes[some]), "other": pa.array(nodes[label[some]]),
            "links": pa.array(links[some].astype(np.int64)),
        })

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    n_links counts the other rows with a cosine of at least ``cosine`` (above
    0), component_id is the smallest id reached over links. Null, empty and zero
    vectors and those with null or non-finite parts link with nothing; shorter
    vectors count as padded with zeros. Repeated rows are rows of their own. Null
    ids take part but name nothing: a component's name is its smallest id that is
    not null, and rows with a null id are kept. Other columns are ignored; an
    empty table gives an empty result.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    part = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.forall("vector", part) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", F.when(good, F.col("vector")).alias("vector"))
    nodes = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    nodes = landed(nodes.withColumn("node", F.monotonically_increasing_id()))
    width = nodes.agg(F.max(F.size("vector"))).first()[0] or 1
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(AXES_SAMPLE).select("vector").toArrow()
    seen = _unit(sample.column(0), width) if len(sample) else np.eye(width)
    axes = np.linalg.eigh(seen.T @ seen)[1][:, ::-1]

    def strip(batches):
        for batch in batches:
            first = _unit(batch.column(1), width) @ axes[:, 0]
            number = np.clip(((first + 1) / 2 * STRIPS).astype(np.int64), 0, STRIPS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=["node", "vector", "copies", "strip"])

    laid = nodes.select("node", "vector", "copies")
    laid = landed(laid.mapInArrow(strip, laid.withColumn("strip", F.lit(0).cast("long")).schema))
    sizes = np.zeros(STRIPS, np.int64)
    for at, n in laid.groupBy("strip").count().collect():  # one row for each strip
        sizes[at] = n
    each = -(-sizes // BLOCK)
    start = np.concatenate([[0], np.cumsum(each)])
    reach = 1 + math.floor(math.sqrt(2 - 2 * cosine) / (2 / STRIPS) + 1e-6)

    def literal(values):
        return F.array(*(F.lit(int(v)) for v in values))

    at = F.col("strip").cast("int")
    block = F.get(literal(start), at) + F.pmod(F.xxhash64("node"), F.greatest(F.get(literal(each), at), F.lit(1)))
    low = F.get(literal(start), F.greatest(at - reach, F.lit(0)))
    high = F.get(literal(start), F.least(at + reach + 1, F.lit(STRIPS))) - 1
    laid = laid.select("node", "vector", "copies", block.cast("long").alias("block"), low.alias("low"), high.alias("high"))
    met = laid.select("node", "vector", "copies", "block", F.explode(F.sequence("low", "high")).alias("other"))
    met = met.select(
        "node", "vector", "copies", "block",
        F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
    )
    found = landed(met.groupBy("x", "y").applyInArrow(_tile(width, axes, cosine), "node long, other long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    names = nodes.join(group, "node").groupBy("component").agg(F.min("least").alias("name"))
    group = group.join(names, "component").select("node", "name")
    known = nodes.join(links, "node", "left").join(group, "node", "left").select(
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("name", "least").alias("name"),
    )
    out = rows.join(known, "vector", "left")
    name = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("name"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        name.alias("component_id"),
        F.coalesce(F.col("id") == name, F.lit(True)).alias("kept"),
    )
