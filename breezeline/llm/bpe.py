"""Byte-level BPE: ranked merges folded by Spark over the distinct words of packs of texts.

Texts are packed, a few MiB at a time, into rows that hold the pack's distinct
words as arrays of ranked byte tokens, and for every text the numbers of its words. A
fold over each distinct word then merges, again and again, the leftmost of the
neighbours with the lowest rank. Texts are put together from the merged words
in the same row, by Spark functions too, so nothing is shuffled and a task needs
one Python worker only, the one that splits texts into words. Decoding
concatenates the tokens' pieces, written as hexadecimal digits, which are turned
into bytes at the end.

The fold's state is one array of whole numbers, one for each token left: the rank
of its pair with the next token, its place among the tokens and the token, from
high bits to low. The least of them is the leftmost of the lowest rank, and a
merge works out two ranks anew and moves the places behind it down by one, so that
the least one tells where it is and no search is needed. Spark interprets the fold:
an ``aggregate`` over one value names it without copying the states, ``flatten``
joins arrays in less time than ``concat``, and the first ranks come with the pack.

The rank map travels in the pack as two arrays instead of as a literal map,
which Spark would search entry by entry: the pair (a, b) is at ``shift[a] + b``,
where an entry of another a means that the pair has no rank. An entry has its a
above 16 bits of rank, so that XOR with the a asked for leaves the rank, or more
than 16 bits.

The words that most packs share are folded once, ahead of the packs, and handed
to the packs as a cache of at most ``COMMON`` words, two Arrow arrays that a pack
looks all its words up in at once. Which words are in it changes the time only: a
pack folds every word that the cache does not hold.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._memory import lean, small_batches

PACK_BYTES = 6 << 20  # text of a pack; a longer text is a pack of its own
COMMON = 600_000  # words of the cache
COMMON_DOCS = 60_000  # documents, as many as are expected, that the cache's words are counted in
LONG = 256  # bytes; longer words are merged with a heap, as a fold over them would be quadratic

NO_RANK = 1 << 36  # above all entries of the pair table, and 24 bits below the sign
LOW = 24  # bits of the fold's state below the rank: 8 for the place, 16 for the token

PACK = (
    "ids array<long>, kept array<long>, places array<array<int>>, done array<array<int>>,"
    " words array<array<long>>, shift array<int>, pairs array<long>, pieces array<string>"
)


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """token: rank, from a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(shift, pairs): pairs[shift[a] + b] is a << 16 | rank of the merged pair, if a and b merge."""
    ranks = read_ranks(path)
    size = max(ranks.values()) + 1
    if size > 0xFFFF:
        raise ValueError("ranks of more than 16 bits")
    follow: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                follow.setdefault(a, []).append((b, rank))
    shift, pairs = np.zeros(size, np.int32), np.full(4 * size, 0xFFFFFFFF, np.uint32)
    used = np.zeros(len(pairs), bool)
    free, rng = 0, np.random.default_rng(1)
    for a, row in sorted(follow.items(), key=lambda x: -len(x[1])):
        b, rank = np.array(sorted(row)).T
        low, many = free, max(16, 100_000 // len(b))
        while True:
            if len(b) <= 8:  # a third of the table is used: chance finds a place for a short row at once
                spots = rng.integers(0, len(pairs) - b[-1], 100)
            else:
                spots = low + np.flatnonzero(~used[low : low + many])
                spots = spots[spots >= b[0]] - b[0]
                spots = spots[spots + b[-1] < len(pairs)]
            fits = ~used[spots[:, None] + b].any(1)
            if fits.any():
                at = int(spots[np.argmax(fits)])
                break
            low += many
            if low >= len(pairs):
                pairs = np.concatenate([pairs, np.full(size, 0xFFFFFFFF, np.uint32)])
                used = np.concatenate([used, np.zeros(size, bool)])
                low = free
        shift[a] = at
        used[at + b] = True
        pairs[at + b] = (a << 16) | rank
    last = int(np.flatnonzero(used)[-1]) + size + 1 if used.any() else size
    table = pairs[:last].astype(np.int64)
    table[~used[:last]] = NO_RANK
    return shift, table


def heap_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one word, in n log n."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    gone = [False] * n

    def rank(i):
        j = after[i]
        return ranks.get(word[i : end[j]]) if j < n else None

    queue = [(r, i, after[i], end[after[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, j, stop = heapq.heappop(queue)
        if gone[i] or j != after[i] or j >= n or end[j] != stop:
            continue
        gone[j], end[i], after[i] = True, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(queue, (r, k, after[k], end[after[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


def _spaced(text: str) -> bool:
    """Whether the text is empty or has white space at an end, so that its words depend on what is beside it."""
    return not text or text[0].isspace() or text[-1].isspace()


def _words_of(chunks: list[str], split) -> tuple[list[str], np.ndarray]:
    """The words of all chunks, a space ahead of each, and how many each has; no chunk is spaced."""
    ends = np.cumsum([len(c) + 1 for c in chunks], dtype=np.int64)
    words = split(" " + " ".join(chunks)) if chunks else []
    stops = np.cumsum([len(w) for w in words], dtype=np.int64)
    upto = np.searchsorted(stops, ends, side="right")
    if len(chunks) and (upto[-1] != len(words) or not upto.all() or (stops[upto - 1] != ends).any()):
        found = [split(" " + c) for c in chunks]  # a pattern that leaves something out or reaches over chunks
        return list(chain.from_iterable(found)), np.array([len(f) for f in found], np.int64)
    return words, np.diff(upto, prepend=0)


def _split_texts(texts: list[str], split) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(how many words each text has, the words' numbers text by text, the distinct words).

    Texts are cut at single spaces, and the distinct chunks between these are split
    into words all at once. A text in which white space meets a cut is split as a whole.
    """
    parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
    many = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(many) - many
    coded = parts.flatten().dictionary_encode()
    del parts
    place, chunks = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    del coded
    spaced = np.fromiter(map(_spaced, chunks), bool, len(chunks))
    later = np.ones(len(place), bool)
    later[first] = False
    heads = [chunks[i] for i in place[first].tolist()]
    odd = np.array([not h or h[-1].isspace() for h in heads], bool)
    whole = (odd | (np.add.reduceat(spaced[place] & later, first) > 0)) & (many > 1)

    used = ~spaced
    words, counts = _words_of([c for c, u in zip(chunks, used.tolist()) if u], split)
    count = np.zeros(len(chunks), np.int64)
    count[used] = counts
    low = np.cumsum(count) - count
    own = [split(text if all_of_it else head) for text, head, all_of_it in zip(texts, heads, whole.tolist())]
    size = np.array([len(o) for o in own], np.int64)

    count, start = count[place], low[place]
    count[np.repeat(whole, many)] = 0
    count[first], start[first] = size, len(words) + np.cumsum(size) - size
    words += chain.from_iterable(own)
    coded = pa.array(words, pa.string()).dictionary_encode()
    ends = np.cumsum(count)
    index = np.repeat(start - ends + count, count) + np.arange(count.sum())
    return np.add.reduceat(count, first), coded.indices.to_numpy(zero_copy_only=False)[index], coded.dictionary


@lru_cache(maxsize=4)
def _tokens(path: str) -> tuple[pa.Array, np.ndarray]:
    """All tokens and their ranks."""
    ranks = read_ranks(path)
    return pa.array(list(ranks), pa.binary()), np.array(list(ranks.values()), np.int32)


@lru_cache(maxsize=4)
def _pieces(path: str) -> pa.Array:
    """The bytes of each token, as hexadecimal digits at its rank; ranks without a token have none."""
    ranks = read_ranks(path)
    found = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        found[rank] = token.hex()
    return pa.array(found, pa.string())


def _found(words: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each word in another array, -1 if it is not there; neither array has a value twice.

    The other one may be much larger, so the hash table is of the words.
    """
    at = pc.fill_null(pc.index_in(among, value_set=words), -1).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(at >= 0)
    found = np.full(len(words), -1, np.int32)
    found[at[there]] = there
    return found


def _byte_states(words: pa.Array, ranks: dict[bytes, int], table: tuple[np.ndarray, np.ndarray]) -> pa.ListArray:
    """The fold's states of each word's single bytes, behind a null; words have at most ``LONG`` bytes.

    With the null, the first token has a place before it as well, and null merges with nothing.
    """
    shift, pairs = table
    byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
    token = byte[np.frombuffer(b"".join(words.to_pylist()), np.uint8)]
    rank = np.full(len(token), NO_RANK)
    rank[:-1] = pairs[shift[token[:-1]] + token[1:]] ^ (token[:-1] << 16)
    rank[ends[1:][np.diff(ends) > 0] - 1] = NO_RANK
    word = np.repeat(np.arange(len(words)), np.diff(ends))
    at = np.arange(len(token)) + word + 1
    states, none = np.zeros(len(token) + len(words), np.int64), np.ones(len(token) + len(words), bool)
    states[at] = (rank << LOW) | (np.arange(len(token)) - ends[word] << 16) | token
    none[at] = False
    return pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(states, mask=none))


def _text_packs(batches, size: int):
    """The batches' columns as lists, the last of them texts, in packs of so many characters; a null text is empty."""
    kept, chars = None, 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            kept = kept or [[] for _ in part.columns]
            for *values, text in zip(*(column.to_pylist() for column in part.columns)):
                for column, value in zip(kept, (*values, text or "")):
                    column.append(value)
                chars += len(text or "")
                if chars >= size:
                    yield kept
                    kept, chars = [[] for _ in part.columns], 0
    if kept and kept[0]:
        yield kept


def _one_row(values) -> pa.ListArray:
    return pa.ListArray.from_arrays([0, len(values)], values)


def _common_words(texts: DataFrame, path: str, pattern: str, table, pack_bytes: int) -> tuple[pa.Array, pa.ListArray]:
    """Words and their tokens, of at most ``COMMON`` words that several parts of a sample of the texts share.

    The sample and so the cache have a fixed expected size, whatever the table's.
    """
    split = regex.compile(pattern).findall
    rows = texts.count()
    none = pa.array([], pa.binary()), pa.array([], pa.list_(pa.int32()))
    if not rows:
        return none

    def seen(batches):
        ranks, words = read_ranks(path), set()
        for part in _text_packs(batches, pack_bytes):
            words.update(_split_texts(part[-1], split)[2].to_pylist())
        found = [w for w in words if len(raw := w.encode()) <= LONG and raw not in ranks]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    def pack(batches):
        words = [w for batch in batches for w in batch.column(0).to_pylist()]
        if words:
            names = pa.array(words, pa.string()).cast(pa.binary())
            states = _byte_states(names, read_ranks(path), table.value)
            values = [_one_row(names), _one_row(states), *map(_one_row, map(pa.array, table.value))]
            yield pa.RecordBatch.from_arrays(values, names=["names", "words", "shift", "pairs"])

    sample = texts.select("text").sample(fraction=min(1.0, COMMON_DOCS / rows), seed=1)
    counts = sample.mapInArrow(lean(seen), "word string").groupBy("word").agg(F.count("*").alias("parts"))
    most = counts.where("parts > 1").orderBy(F.desc("parts"), "word").limit(COMMON).select("word")
    packs = most.repartition(16).mapInArrow(
        pack, "names array<binary>, words array<array<long>>, shift array<int>, pairs array<long>"
    )
    merged = F.transform("words", lambda word: _folded(word, F.col("shift"), F.col("pairs")))
    found = packs.select("names", merged.alias("words")).toArrow()
    if not found.num_rows:
        return none
    names, tokens = (pa.concat_arrays([c.flatten() for c in found.column(i).chunks]) for i in (0, 1))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return names.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(ends), tokens.flatten().cast(pa.int32()))


def _packer(path, pattern, table, cache, pack_bytes, decoded):
    split = regex.compile(pattern).findall

    def pack(ids, kept, texts, ranks):
        names, merged = cache.value
        tokens, rank = _tokens(path)
        sizes, numbers, words = _split_texts(texts, split)
        words = words.cast(pa.binary())
        whole, common = _found(words, tokens), _found(words, names)
        known = whole >= 0
        cached = ~known & (common >= 0)
        large = ~known & ~cached & (pc.binary_length(words).to_numpy(zero_copy_only=False) > LONG)
        short = ~known & ~cached & ~large
        order = np.concatenate([np.flatnonzero(mask) for mask in (known, cached, large, short)])
        number = np.empty(len(order), np.int32)  # of each word among those that are done and those to fold
        number[order] = np.arange(len(order), dtype=np.int32)
        single = rank[whole[known]]
        heaps = [heap_merged(words[int(i)].as_py(), ranks) for i in np.flatnonzero(large)]
        done = pa.concat_arrays(
            [
                pa.ListArray.from_arrays(pa.array(np.arange(len(single) + 1, dtype=np.int32)), pa.array(single)),
                merged.take(pa.array(common[cached])),
                pa.array(heaps, pa.list_(pa.int32())),
            ]
        )
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        places = number[numbers]
        shift, pairs = table.value
        values = [
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([kept], pa.list_(pa.int64())),
            _one_row(pa.ListArray.from_arrays(pa.array(ends), pa.array(places))),
            _one_row(done),
            _one_row(_byte_states(words.filter(pa.array(short)), ranks, table.value)),
            _one_row(pa.array(shift)),
            _one_row(pa.array(pairs)),
            _one_row(_pieces(path) if decoded else pa.array([], pa.string())),
        ]
        return pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in PACK.split(", ")])

    def run(batches):
        ranks = read_ranks(path)
        for part in _text_packs(batches, pack_bytes):
            yield pack(*part, ranks)

    return run


def _joined(lists: pa.ListArray, pieces: dict[int, bytes]) -> pa.Array:
    """For each list of tokens, their pieces in one binary; a null list gives none."""
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    rows = (flat[ends[i] : ends[i + 1]].tolist() if valid[i] else () for i in range(len(lists)))
    return pa.array([b"".join(map(pieces.__getitem__, row)) for row in rows], pa.binary())


def _folded(word: Column, shift: Column, pairs: Column) -> Column:
    """The tokens that the word's byte tokens merge into; they come as states (``_byte_states``)."""

    def bits(state, mask):
        return state.bitwiseAND(F.lit(mask).cast("long"))

    def token(state):
        return bits(state, 0xFFFF).cast("int")

    def ranked(a, b, low):
        rank = F.get(pairs, F.get(shift, a) + b).bitwiseXOR(F.shiftleft(a.cast("long"), 16))
        return F.shiftleft(F.coalesce(rank, F.lit(NO_RANK)), LOW).bitwiseOR(low)

    def merged(states, least):
        made = F.shiftright(least, LOW)
        whole = made.cast("int")
        place = F.shiftright(bits(least, 0xFF0000), 16).cast("int")
        before, after = F.get(states, place), F.get(states, place + 3)
        left = ranked(token(before), whole, bits(before, (1 << LOW) - 1))
        right = ranked(whole, token(after), bits(least, 0xFF0000).bitwiseOR(made))
        head, tail = F.slice(states, F.lit(1), place), F.slice(states, place + 4, most)
        moved = F.transform(tail, lambda state: state - F.lit(1 << 16))
        found = F.flatten(F.array(head, F.array(left, right), moved))
        return F.when(least < (0x10000 << LOW), found).otherwise(states)

    def step(states, _):
        return F.aggregate(F.array(F.array_min(states)), states, merged)

    most = F.lit(LONG + 1)  # states of a word; a slice ends where the array does
    # as many steps as there are states are more than there can be merges
    return F.aggregate(word, word, step, lambda end: F.transform(F.slice(end, F.lit(2), most), token))


def _unpacked(packs: DataFrame, decoded: bool) -> DataFrame:
    """A row for every text of the packs: (id, kept, tokens), and decoded if asked for."""

    def of_pack(words, pieces):
        def row(tokens):
            if not decoded:
                return F.struct(tokens.alias("tokens"))
            digits = F.array_join(F.transform(tokens, lambda token: F.get(pieces, token)), "")
            return F.struct(tokens.alias("tokens"), F.unhex(digits).alias("decoded"))

        def of_places(places):
            tokens = F.flatten(F.transform(places, lambda place: F.get(words, place)))
            return F.transform(F.array(tokens), row)[0]

        return F.transform("places", of_places)

    # taken out of the row once, not anew at each of the many places that share them
    done = F.transform("done", lambda word: F.transform(word, lambda token: token))
    pieces = F.transform("pieces", lambda piece: piece)
    folded = F.transform("words", lambda word: _folded(word, F.col("shift"), F.col("pairs")))
    texts = F.transform(
        F.array(F.concat(done, folded)), lambda words: F.transform(F.array(pieces), lambda each: of_pack(words, each))[0]
    )[0]
    rows = packs.select("ids", "kept", texts.alias("texts"))
    rows = rows.select(F.inline(F.arrays_zip("ids", "kept", "texts")).alias("id", "kept", "text"))
    return rows.select("id", "kept", "text.*")


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
    keep: str | None = None,
    pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """(id, tokens) for every row of ``docs``: the ids that the rank file's encoding gives the text.

    ``path`` is read on the driver and by every worker. ``docs`` is counted and
    sampled before (``COMMON_DOCS``), for the cache of common words. Each match of
    ``pattern`` is encoded by itself, without special tokens. Null and empty
    texts have no tokens. Rows may repeat and ids may be null; other columns
    are ignored; an empty table gives an empty result. With ``decoded``, the
    column decoded has the bytes that ``decode`` would make of the tokens. ``keep``
    names a column of whole numbers that comes out beside the id. Smaller packs
    take less memory and fold more words anew. The session sends smaller Arrow
    batches from then on (``_memory.small_batches``).
    """
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    table = share(pair_table(path))
    kept = (F.col(keep) if keep else F.lit(None)).cast("long").alias("kept")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), kept, F.col(text_col).alias("text"))
    cache = share(_common_words(texts, path, pattern, table, pack_bytes))
    packs = texts.mapInArrow(lean(_packer(path, pattern, table, cache, pack_bytes, decoded)), PACK)
    out = _unpacked(packs, decoded)
    out = out.withColumnRenamed("kept", keep) if keep else out.drop("kept")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, tokens_col: str = "tokens", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its tokens stand for; null tokens give no bytes."""
    schema = encoded.drop(into).withColumn(into, F.lit(b"")).schema
    columns = [c for c in encoded.columns if c != into]
    place = columns.index(tokens_col)

    def run(batches):
        pieces = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            made = _joined(batch.column(place), pieces)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*columns, into])

    return encoded.select(*columns).mapInArrow(run, schema)


def default_path(spark: SparkSession) -> str:
    """The rank file named by ``breezeline.bpe.ranks``, else that of the installed vocabularies."""
    import public_tokenizers

    return spark.conf.get("breezeline.bpe.ranks", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
