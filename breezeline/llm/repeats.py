"""Removal of word windows that an earlier document has too, by level-wise doubling.

Short windows come first: for 13 words, windows of 7. Of the seven 7-word
windows inside a 13-word window, the one with the least hash stands for it, so
equal windows have equal stand-ins. Where a stand-in is repeated in another
document, and only there, the window is extended to twice the length (7 + 7
words, one shared) and compared again. Levels double until ``length`` is reached;
once no candidate survives, the later ones have no rows. The repeated stand-ins
reach the texts as a bitmap of fixed size, so that no text is moved between
levels. It may let others through, which the next level finds out; where it would
be too full to part many, the stand-ins go to their texts by a join instead.

Hashes travel packed by hash range. Of a map batch, only the smallest document
with a hash is sent to meet the other batches; the verdict on its other holders
is known and goes straight on. A passage that a third of all documents share is
thus one entry for each batch, and the number of ranges grows with the text.
The last level's hashes have as many bits as twice the logarithm of the number
of windows asks for, and ten more.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _filter
from . import _words as W

SHORTEST = 6  # words; levels below this length would repeat by chance
PART_BYTES = 8 << 20  # text whose windows meet in one task
LEAST_PARTS = 64
FLUSH_BYTES = 32 << 20  # text gathered before a message is sent
FULL = 0.25  # share of the bitmap's bits beyond which stand-ins are joined with their texts

MESSAGE = "part long, ids binary, counts binary, hashes binary, more binary"
_SECOND = np.uint64(0xD6E8FEB86659FD93)  # for hashes of hashes


def levels(length: int) -> list[int]:
    """Window lengths from the shortest to ``length``, each nearly twice the one before."""
    out = [length]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _stand_ins(hashes: np.ndarray, level: int, length: int) -> np.ndarray:
    """For each window of ``length`` words, the least hash of its windows of ``level`` words."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    return _least_of(W.windows(hashes, level), length - level + 1)


def _marked(marks, row: int) -> np.ndarray | None:
    """The hashes that arrived for a row; None if none did."""
    lists = marks[row].as_py()
    return np.frombuffer(b"".join(lists), np.uint64) if lists else None


def _surviving(words, hashes, starts, each, marks, low, level, length):
    """Which window starts have a stand-in of ``level`` words among their row's marks."""
    keep = np.zeros(len(starts), bool)
    rows = np.flatnonzero(each)
    if not len(rows):
        return keep
    stand = _stand_ins(hashes, level, length)[starts]
    ends = np.cumsum(each)
    for r in rows:
        known = _marked(marks, low + int(r))
        if known is not None:
            part = slice(ends[r] - each[r], ends[r])
            keep[part] = np.isin(stand[part], known)
    return keep


def _messages(ids, hashes, parts, extra, last):
    """What a batch sends: entries for the hash ranges, and verdicts it knows already."""
    order = np.lexsort((ids, hashes))
    ids, hashes = ids[order], hashes[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    ids, hashes, more = ids[new], hashes[new], extra[order][new]
    first = np.ones(len(ids), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    alone = first.copy()
    alone[:-1] &= first[1:]
    known = ~first if last else ~alone
    part = (W.mix(hashes + _SECOND) % np.uint64(parts)).astype(np.int64)
    to = np.concatenate([part[first], parts + (W.mix(ids[known].view(np.uint64)) % np.uint64(parts)).astype(np.int64)])
    pick = np.concatenate([np.flatnonzero(first), np.flatnonzero(known)])
    order = np.lexsort((ids[pick], to))
    to, pick = to[order], pick[order]
    keys, at = np.unique(to, return_index=True)
    rows = []
    for key, one in zip(keys, np.split(pick, at[1:])):
        names, counts = np.unique(ids[one], return_counts=True)
        fields = (names, counts.astype(np.uint32), hashes[one], more[one] if key < parts else more[:0])
        rows.append((int(key), *(x.tobytes() for x in fields)))
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), *[pa.binary()] * 4)
    names = [x.split()[0] for x in MESSAGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _sender(level, before, length, parts, width, known=None):
    """Map side of a level; ``before`` is the level whose survivors come as marks, or as the bitmap ``known``."""
    last = level == length

    def run(batches):
        held, size = [], 0
        bits = np.frombuffer(known.value, np.uint8) if known else None
        for batch in batches:
            ids = batch.column(0)
            marks = batch.column(2) if before and not known else None
            for low, high, data, offsets in W.pieces(batch.column(1)):
                words = W.Words(data, offsets)
                hashes = words.hashes()
                starts, each = W.window_starts(words, length)
                names = np.repeat(ids.slice(low, high - low).fill_null(0).to_numpy(), each)
                keep = np.repeat(ids.slice(low, high - low).is_valid().to_numpy(zero_copy_only=False), each)
                if known:
                    keep &= _filter.holds(bits, _stand_ins(hashes, before, length)[starts])
                elif before:
                    keep &= _surviving(words, hashes, starts, each, marks, low, before, length)
                starts, names = starts[keep], names[keep]
                stand = _stand_ins(hashes, level, length)[starts]
                extra = np.zeros((len(stand), width), np.uint8)
                if width and len(stand):
                    other = W.windows(words.hashes(key=1), level)[starts]
                    extra = other.view(np.uint8).reshape(-1, 8)[:, :width]
                if not last:  # neighbours mostly share their stand-in
                    new = np.ones(len(stand), bool)
                    new[1:] = (stand[1:] != stand[:-1]) | (names[1:] != names[:-1])
                    stand, names, extra = stand[new], names[new], extra[new]
                held.append((names, stand, extra))
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield _messages(*(np.concatenate(x) for x in list(zip(*held))[:2]), parts,
                                    np.concatenate([x[2] for x in held]), last)
                    held, size = [], 0
        if held:
            yield _messages(*(np.concatenate(x) for x in list(zip(*held))[:2]), parts,
                            np.concatenate([x[2] for x in held]), last)

    return run


def _judge(parts, width, last):
    """Reduce side of a level: (id, marks) of the hashes that are repeated."""

    def run(table):
        columns = {n: table.column(n).to_pylist() for n in ("part", "ids", "counts", "hashes", "more")}
        glue = lambda name, kind: np.frombuffer(b"".join(columns[name]), kind)
        ids = np.repeat(glue("ids", np.int64), glue("counts", np.uint32))
        hashes = glue("hashes", np.uint64)
        if columns["part"][0] < parts:
            more = glue("more", np.uint8).reshape(-1, width) if width else np.zeros((len(ids), 0), np.uint8)
            order = np.lexsort((ids, *more.T, hashes))
            ids, hashes, more = ids[order], hashes[order], more[order]
            new = np.ones(len(ids), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1]).any(1)
            run_of = np.cumsum(new) - 1
            least = ids[new][run_of]
            most = np.maximum.reduceat(ids, np.flatnonzero(new))[run_of] if len(ids) else ids
            hit = ids > least if last else least < most
            ids, hashes = ids[hit], hashes[hit]
        order = np.argsort(ids, kind="stable")
        ids, hashes = ids[order], hashes[order]
        names, at = np.unique(ids, return_index=True)
        marks = [x.tobytes() for x in np.split(hashes, at[1:])] if len(names) else []
        return pa.table({"id": pa.array(names, pa.int64()), "marks": pa.array(marks, pa.binary())})

    return run


def _repeated(judge, size):
    """Reduce side of a level before the last: the bits of the hashes that are repeated."""

    def run(table):
        marks = judge(table).column("marks").to_pylist()
        return pa.table({"place": _filter.places(np.unique(np.frombuffer(b"".join(marks), np.uint64)), size)})

    return run


def _cleaner(length):
    def run(batches):
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            for low, high, data, offsets in W.pieces(batch.column(1)):
                words = W.Words(data, offsets)
                starts, each = W.window_starts(words, length)
                gone = np.zeros(len(words.start) + 1, np.int64)
                if any(marks[i].is_valid for i in range(low, high)):
                    hits = starts[_surviving(words, words.hashes(), starts, each, marks, low, length, length)]
                    np.add.at(gone, hits, 1)
                    np.add.at(gone, hits + length, -1)
                kept = np.cumsum(gone[:-1]) == 0
                texts, raw = [], data.tobytes()
                for r in range(high - low):
                    a, b = words.ptr[r], words.ptr[r + 1]
                    own = raw[offsets[r] : offsets[r + 1]].split()
                    texts.append(b" ".join(own if kept[a:b].all() else compress(own, kept[a:b].tolist())))
                total = np.concatenate([[0], np.cumsum(~kept)])
                removed = total[words.ptr[1:]] - total[words.ptr[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(words.count.astype(np.int64)), pa.array(removed),
                     pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "n_removed", "kept_text"],
                )

    return run


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 13,
    filter_size: int = _filter.BITS,
) -> DataFrame:
    """(id, n_words, n_removed, kept_text) for every row of ``docs``.

    A word goes if a window of ``length`` words covers it whose words also start
    somewhere in a row with a smaller id. Windows are judged on the input. Words
    are compared unchanged; kept ones are joined by one space. Null and empty
    texts have no words. Rows with a null id have no place in the order: they
    lose nothing and take nothing from others. Rows with one id are one place in
    the order, each judged by its own text. Other columns are ignored; an empty
    table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, math.ceil(size / PART_BYTES))
    bits = 2 * math.log2(max(size / 2, 2)) + 10
    before, marked, known = None, texts, None
    for level in levels(length):
        last = level == length
        width = min(8, max(0, math.ceil((bits - 64) / 8))) if last else 0
        sent = marked.mapInArrow(_sender(level, before, length, parts, width, known), MESSAGE).groupBy("part")
        before, known = level, None
        if not last:
            found = _filter.gathered(sent.applyInArrow(_repeated(_judge(parts, width, last), filter_size), "place long"), filter_size)
            if np.bitwise_count(np.frombuffer(found, np.uint8)).sum(dtype=np.int64) <= FULL * filter_size:
                marked, known = texts, docs.sparkSession.sparkContext.broadcast(found)
                continue
        judged = sent.applyInArrow(_judge(parts, width, last), "id long, marks binary")
        marks = judged.groupBy("id").agg(F.collect_list("marks").alias("marks"))
        marked = texts.join(marks, "id", "inner" if not last else "left").select("id", "text", "marks")
    out = marked.mapInArrow(_cleaner(length), "id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id_col)
