"""Near-duplicate documents by MinHash bands, odd sketches and an exact check.

Every text becomes the set of its distinct word shingles. Equal sets are folded
into one node before anything is compared. A node has 384 MinHash samples: six
at a time they form 64 bands whose equal values propose pairs, and all of them
are folded into a parity bitmap (odd sketch) whose XOR population count tells
how similar two sets are. A second parity bitmap, of the shingles themselves,
never differs in more bits than the sets do in shingles, so it and the set sizes
rule pairs out for certain; it is sharp where texts are short. Pairs that may
reach the threshold are then counted on the full sets.

Within a band's bucket, nodes are first paired with the bucket's leader, the node
that shares most buckets with others: the text that most copies are made from.
Only nodes that this leaves in another component than their leader meet other
nodes of the bucket, and by the triangle inequality only those at about the same
distance from the leader, so a bucket of many copies costs about as many pairs
as it has nodes. A pair of similarity 0.8 shares no band with probability
(1 - 0.8^6)^64 = 4e-9.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._graph import components, landed
from ._memory import lean

BANDS, ROWS = 64, 6
SKETCHED = BANDS * ROWS  # samples in the bitmap
SKETCH_WORDS = 16  # the bitmap's 64-bit words
SKETCH_FLOOR = 0.68  # five deviations of the estimate below a similarity of 0.8
MARGIN = 0.15  # for the error of an estimated distance
PAIRS = 256  # pairs whose sets a task holds at once
BROADCAST_IDS = 2_000_000  # more ids than this are joined by a shuffle

_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 2**32, BANDS * ROWS, np.uint32)
_PLACE = _rng.integers(0, 2**64, ROWS, np.uint64) | np.uint64(1)
_SALT = _rng.integers(0, 2**64, SKETCHED, np.uint64)

SIGNATURE = (
    "id long, n_shingles long, k1 long, k2 long, bands array<long>, "
    + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS))
    + ", "
    + ", ".join(f"t{i} long" for i in range(SKETCH_WORDS))
)


def _shingles(data, offsets, size):
    """Distinct shingles of each row in order, and each row's number of them."""
    words = W.Words(data, offsets)
    hashes = words.hashes(fold=True)
    starts, each = W.window_starts(words, size)
    values, rows = W.windows(hashes, size)[starts], np.repeat(np.arange(len(each)), each)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):  # the whole sequence is the one shingle
        whole = [W.windows(hashes[words.ptr[r] : words.ptr[r + 1]], int(words.count[r]))[0] for r in short]
        values, rows = np.concatenate([values, np.array(whole, np.uint64)]), np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], np.bincount(rows[new], minlength=len(each))

BITMAPS = [f"{kind}{i}" for kind in "st" for i in range(SKETCH_WORDS)]


def _parities(spots: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Packed bitmaps of ``rows`` times ``bits``, set where a place occurs an odd number of times."""
    odd = np.bincount(spots, minlength=rows * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1)


def _signatures(size):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for low, high, data, offsets in W.pieces(batch.column(1), 1 << 20):
                values, count = _shingles(data, offsets, size)
                full = np.flatnonzero(count)
                first = (np.cumsum(count) - count)[full]
                keys = np.zeros((2, high - low), np.uint64)
                bands = np.zeros((high - low, BANDS), np.uint64)
                sketch = np.zeros((high - low, SKETCH_WORDS * 8), np.uint8)
                parity = np.zeros((high - low, SKETCH_WORDS * 8), np.uint8)
                if len(full):
                    for i, salt in enumerate((3, 5)):
                        keys[i, full] = np.add.reduceat(W.mix(values ^ np.uint64(salt)), first)
                    short = (values >> np.uint64(32)).astype(np.uint32)
                    least = np.empty((len(full), BANDS * ROWS), np.uint64)
                    for i in range(BANDS * ROWS):
                        least[:, i] = np.minimum.reduceat((short ^ _FLIP[i]) * _MULTIPLY[i], first)
                    rows = least.reshape(len(full), BANDS, ROWS)
                    bands[full] = W.mix((rows * _PLACE).sum(2, dtype=np.uint64))
                    bits = SKETCH_WORDS * 64
                    spot = (W.mix(least[:, :SKETCHED] + _SALT) % np.uint64(bits)).astype(np.int64)
                    spot += (np.arange(len(full)) * bits)[:, None]
                    sketch[full] = _parities(spot.ravel(), len(full), bits)
                    spot = (W.mix(values ^ np.uint64(7)) % np.uint64(bits)).astype(np.int64)
                    spot += np.repeat(np.arange(len(full)) * bits, count[full])
                    parity[full] = _parities(spot, len(full), bits)
                signed = bands.view(np.int64)
                arrays = [ids.slice(low, high - low), pa.array(count.astype(np.int64))]
                arrays += [pa.array(k.view(np.int64)) for k in keys]
                ends = pa.array(np.arange(high - low + 1, dtype=np.int32) * BANDS)
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(signed.ravel())))
                for longs in (sketch.view(np.int64), parity.view(np.int64)):
                    arrays += [pa.array(longs[:, i]) for i in range(SKETCH_WORDS)]
                names = ["id", "n_shingles", "k1", "k2", "bands", *BITMAPS]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _apart(left: str, right: str, kind: str = "s"):
    """Bits in which two bitmaps differ; kind: s for MinHash samples, t for shingles."""
    words = (f"{kind}{i}" for i in range(SKETCH_WORDS))
    terms = [F.bit_count(F.col(f"{left}.{w}").bitwiseXOR(F.col(f"{right}.{w}"))) for w in words]
    return reduce(lambda x, y: x + y, terms)


def _may_link(left: str, right: str, percent: int):
    """Whether sizes, sketches and shingle bitmaps allow a similarity of ``percent``.

    Of S shingles in both sets together, at most S * (100 - percent) / (100 + percent)
    may be in one set only.
    """
    n, m = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    sizes = (100 * F.least(n, m)) >= percent * F.greatest(n, m)
    differing = (100 + percent) * _apart(left, right, "t") <= (100 - percent) * (n + m)
    return sizes & (_apart(left, right) <= _most_apart()) & differing


def _most_apart() -> int:
    """The bits expected to differ at ``SKETCH_FLOOR``."""
    bits = SKETCH_WORDS * 64
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * SKETCHED * (1 - SKETCH_FLOOR))))


def _alike(size, percent):
    def run(batches):
        for table in (
            pa.Table.from_batches([batch.slice(i, PAIRS)]) for batch in batches for i in range(0, batch.num_rows, PAIRS)
        ):
            keep = np.zeros(len(table), bool)
            sides = []
            for name in ("left_text", "right_text"):
                sets = []
                for _, _, data, offsets in W.pieces(table.column(name)):
                    values, count = _shingles(data, offsets, size)
                    sets += np.split(values, np.cumsum(count)[:-1])
                sides.append(sets)
            keys = [table.column(c).to_numpy() for c in ("left_key", "right_key")]
            for i, pair in enumerate(zip(*sides)):
                same = all(
                    np.add.reduce(W.mix(x ^ np.uint64(3))).astype(np.uint64).view(np.int64) == k[i]
                    for x, k in zip(pair, keys)
                )
                if same:  # else another text under the same id
                    both = len(np.intersect1d(*pair, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(pair[0]) + len(pair[1]) - both)
            yield from table.select(["a", "b"]).filter(pa.array(keep)).to_batches()

    return run


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are similar enough."""
    named = nodes.select("node", "id", "k1")
    left = named.select(F.col("node").alias("a"), F.col("id").alias("left_id"), F.col("k1").alias("left_key"))
    right = named.select(F.col("node").alias("b"), F.col("id").alias("right_id"), F.col("k1").alias("right_key"))
    pairs = landed(pairs.join(left, "a").join(right, "b"))
    ids = pairs.select(F.col("left_id").alias("id")).unionAll(pairs.select(F.col("right_id").alias("id")))
    ids = landed(ids.distinct())
    few = ids.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    out = pairs.join(wanted.select(F.col("id").alias("left_id"), F.col("text").alias("left_text")), "left_id")
    out = out.join(wanted.select(F.col("id").alias("right_id"), F.col("text").alias("right_text")), "right_id")
    out = out.select("a", "b", "left_key", "right_key", "left_text", "right_text")
    return landed(out.mapInArrow(lean(_alike(size, percent)), "a long, b long").distinct())


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are folded from A-Z to a-z; a text of fewer than ``size`` words is one
    shingle. Texts are linked if 100 * intersection >= ``percent`` * union.
    Null and empty texts have no shingle and are linked with nothing, and so
    are rows with a null id, which are kept and have a null component. Rows
    with one id are judged each by its own text. Other columns are ignored;
    an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = landed(texts.mapInArrow(lean(_signatures(size)), SIGNATURE))
    whole = marks.where("id is not null and n_shingles > 0")
    rest = [F.first(c).alias(c) for c in ("n_shingles", "bands", *BITMAPS)]
    nodes = whole.groupBy("k1", "k2").agg(F.min("id").alias("id"), *rest)
    nodes = landed(nodes.withColumn("node", F.monotonically_increasing_id()))
    spread = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    buckets = spread.groupBy("band", "value").agg(F.count("*").alias("held")).where("held > 1")
    held = landed(
        spread.join(buckets, ["band", "value"]).select(F.xxhash64("band", "value").alias("bucket"), "node", "held")
    )
    fame = held.groupBy("node").agg(F.sum("held").alias("fame"))
    held = held.join(fame, "node")
    leaders = held.groupBy("bucket").agg(F.max_by("node", F.struct("fame", "node")).alias("leader"))
    shared = landed(held.join(leaders, "bucket").select("bucket", "leader", "node"))
    sketches = nodes.select("node", "n_shingles", *BITMAPS)

    def measured(pairs):
        """Pairs (a, b) with the bits their sketches differ in and whether they may be links."""
        x, y = sketches.alias("x"), sketches.alias("y")
        joined = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
        return joined.select(*pairs.columns, _apart("x", "y").alias("apart"), _may_link("x", "y", percent).alias("may"))

    def confirmed(pairs):
        return _confirmed(pairs, nodes, texts, size, percent)

    star = shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = landed(measured(star))
    best = star.where("may").groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")
    links = confirmed(best)
    group = components(links)
    # the other leaders of a node, where that would join two components
    label = group.withColumnRenamed("component", "label")
    others = star.where("may").select("a", "b").join(best, ["a", "b"], "left_anti")
    others = others.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
    others = others.join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    apart = F.coalesce("la", "a") != F.coalesce("lb", "b")
    others = landed(others.where(apart).select("a", "b"))
    if not others.isEmpty():
        links = landed(links.unionAll(confirmed(others)).distinct())
        group = components(links)
    tested = None
    for last in (False, True):
        pairs = _across(star, links, group.withColumnRenamed("component", "label"), sketches, percent)
        if last:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        else:  # the closest pair of every two components first
            pairs = pairs.groupBy("low", "high").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p"))
            pairs = pairs.select("p.a", "p.b")
        pairs = tested = landed(pairs.select("a", "b"))
        if pairs.isEmpty():
            break
        found = confirmed(pairs)
        if not found.isEmpty():
            links = landed(links.unionAll(found).distinct())
            group = components(links)
    marked = marks.select("id", "n_shingles", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"], "left")
    own = nodes.select("node", F.col("id").alias("least"))
    names = own.join(group, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    group = group.join(names, "component").select("node", "component_id")
    member = own.join(group, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    out = marked.join(member, "node", "left")
    named = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        named.alias("component_id"),
        F.coalesce(F.col("id") == named, F.lit(True)).alias("kept"),
    )


def _across(
    star: DataFrame, links: DataFrame, label: DataFrame, sketches: DataFrame, percent: int
) -> DataFrame:
    """Pairs of one leader and two components that may be links (a, b, low, high, apart).

    One side has only nodes outside the component of their bucket's leader.
    Jaccard distances obey the triangle inequality: two linked texts differ by at
    most ``reach`` (0.2 for 80 percent) in their distance from the leader, and a text
    beyond twice the reach has no link with those that are linked to it. The
    distances are estimates, so ``MARGIN`` is added to both.
    """
    reach = 1 - percent / 100
    bits = SKETCH_WORDS * 64
    folded = F.least(F.col("apart") / (bits / 2), F.lit(0.98))
    distance = F.least(-F.log(1 - folded) * (bits / 2) / (2 * SKETCHED), F.lit(1.0))
    direct = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    direct = direct.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.lit(True).alias("direct")).distinct()
    from_leader = star.select(F.col("a").alias("leader"), F.col("b").alias("node"), "apart", distance.alias("d"))
    from_leader = from_leader.join(direct, ["leader", "node"], "left")
    names = label.select(F.col("node").alias("leader"), F.col("label").alias("leading"))
    known = from_leader.join(label, "node", "left").join(names, "leader", "left")
    known = known.select(
        "leader", "node", F.coalesce("label", "node").alias("label"), F.coalesce("leading", "leader").alias("leading"),
        "d", (F.col("d") <= 2 * reach + MARGIN).alias("near"), F.coalesce("direct", F.lit(False)).alias("direct"),
    )
    known = landed(known)
    bitmap = ["n_shingles", *BITMAPS]
    odd = known.where("label <> leading").join(sketches, "node").select(
        "leader", F.col("node").alias("a"), F.col("label").alias("la"), F.col("d").alias("da"), "near", *bitmap
    )
    rest = known.join(odd.select("leader").distinct(), "leader", "left_semi").join(sketches, "node").select(
        "leader", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("d").alias("db"), "direct", *bitmap
    )
    x, y = odd.alias("x"), rest.alias("y")
    apart = _apart("x", "y")
    alike = (F.col("la") != F.col("lb")) & (F.abs(F.col("da") - F.col("db")) <= reach + MARGIN)
    alike = alike & (F.col("near") | ~F.col("direct")) & _may_link("x", "y", percent)
    met = x.join(y, (F.col("x.leader") == F.col("y.leader")) & alike)
    return met.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.least("la", "lb").alias("low"), F.greatest("la", "lb").alias("high"), apart.alias("apart"),
    ).distinct()
