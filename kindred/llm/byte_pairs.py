"""Byte-level BPE encoding and decoding by replaying the merges over the words of a block of texts.

Each task gathers texts to a block of bounded size and cuts them into pieces by the
tokenizer's pattern.  The distinct pieces form the block's word list.  An inverted index
holds, for every merge rank, the word positions where a pair of that rank stands.  Ranks are
taken in order; a rank's merges are applied to all its positions at once, and only the pairs
at touched neighbours are looked up again and filed.  A text's ids are the ids of its pieces.

Ids travel as binary: little-endian unsigned 32-bit integers.  Null and empty texts have no
ids and decode to empty bytes.  Rows are independent: repeated rows, any doc_id and further
columns pass through unchanged; a column that has the name of the new one is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, released, small_batches, spread, text_bytes

#: Bytes of text whose distinct pieces are merged together.
REPLAY_BYTES = 1024 * 1024
#: Bytes of an output batch at most (or one text's).
OUT_BYTES = 2 * 1024 * 1024
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file (base64 token, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def tables(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """What tasks need of a vocabulary: bytes of each token, ids of single bytes, and every mergeable pair."""
    size = max(ranks.values()) + 1
    words = [b""] * size
    keys, found = [], []
    for token, rank in ranks.items():
        words[rank] = token
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                found.append(rank)
    order = np.argsort(np.array(keys, np.int64))
    keys, found = np.array(keys, np.int64)[order], np.array(found, np.int32)[order]
    lengths = np.array([len(w) for w in words], np.int64)
    # The lowest rank that a pair with a token can have: a rank above it must be applied one by one.
    lowest = np.full(size, NONE, np.int32)
    np.minimum.at(lowest, keys >> 32, found)
    np.minimum.at(lowest, keys & 0xFFFFFFFF, found)
    codes = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        kinds[[ord(c) for c in regex.findall(pattern, codes)]] = kind
    return {
        "single": np.array([ranks[bytes([b])] for b in range(256)], np.int32),
        "keys": keys,
        "found": found,
        "lowest": lowest,
        "kinds": kinds,
        "lengths": lengths,
        "starts": np.cumsum(lengths) - lengths,
        "bytes": np.frombuffer(b"".join(words), np.uint8),
    }


def piece_starts(codes: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces begin in code points; ``first`` marks the first code point of each text.

    A piece is a run of letters, of numbers or of other signs, with one blank before it.  A
    run of white space loses its last character to what follows it in the text.  An
    apostrophe that begins a piece takes s, t, re, ve, m, ll or d with it.
    """
    kind = kinds[codes]
    n = len(codes)
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    begin = change | first
    space = kind == SPACE
    ends = np.ones(n, bool)  # last code point of a run
    ends[:-1] = begin[1:]
    final = np.ones(n, bool)  # last code point of a text
    final[:-1] = first[1:]
    given = space & ends & ~final  # white space just before something else
    begin |= given
    blank = given & (codes == 32)
    after = np.flatnonzero(blank) + 1
    begin[after] = False
    mark = np.flatnonzero(begin & (codes == 39) & ends & ~final)
    if len(mark):
        one = codes[mark + 1]
        two = np.where(mark + 2 < n, codes[np.minimum(mark + 2, n - 1)], 0)
        two = np.where(final[np.minimum(mark + 1, n - 1)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(mark), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        taken = np.where(short, 1, np.where(long, 2, 0))
        mark, taken = mark[taken > 0], taken[taken > 0]
        begin[mark + 1] = False
        rest = mark + 1 + taken
        inside = rest < n
        rest = rest[inside]
        # What follows begins a piece: within the letters that were cut, or where one began anyway.
        begin[rest] |= (kind[rest] == LETTER) & ~first[rest]
    return np.flatnonzero(begin)


def rank_of(left: np.ndarray, right: np.ndarray, t: dict) -> np.ndarray:
    """Rank of each pair, or NONE."""
    key = left.astype(np.int64) << 32 | right
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    return np.where(t["keys"][at] == key, t["found"][at], NONE).astype(np.int32)


def replay(word_bytes: np.ndarray, lengths: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a list of words, one after the other, and how many each word has.

    ``index`` is the inverted index: rank to arrays of positions of a pair's left token.
    """
    n = len(word_bytes)
    if not n:
        return np.empty(0, np.int32), np.zeros(len(lengths), np.int64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    token = t["single"][word_bytes].astype(np.int32)
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    after[ends[lengths > 0] - 1] = -1
    before[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    ready: list[int] = []

    def file(at: np.ndarray, ranks: np.ndarray) -> None:
        if len(at) == 1:
            groups = [(int(ranks[0]), at)]
        else:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            groups = zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True)
        for rank, some in groups:
            held = index.get(rank)
            if held is None:
                index[rank] = [some]
                heapq.heappush(ready, rank)
            else:
                held.append(some)

    def look(at: np.ndarray) -> None:
        at = at[after[at] >= 0]
        if len(at):
            ranks = rank_of(token[at], token[after[at]], t)
            known = ranks != NONE
            if known.any():
                file(at[known], ranks[known])

    look(np.arange(n, dtype=np.int32))
    while ready:
        rank = heapq.heappop(ready)
        held = index.pop(rank)
        at = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
        at = at[alive[at]]
        at = at[after[at] >= 0]
        if len(at):
            at = at[rank_of(token[at], token[after[at]], t) == rank]
        if not len(at):
            continue
        if t["lowest"][rank] <= rank:
            # A pair with the new token may come before this rank: one merge a word, then look again.
            lead = np.r_[True, word[at[1:]] != word[at[:-1]]]
            if not lead.all():
                index[rank] = [at[~lead]]
                heapq.heappush(ready, rank)
            at = at[lead]
        elif len(at) > 1:
            # Overlapping positions (a pair of equal tokens): every second one of a chain.
            chained = np.r_[False, after[at[:-1]] == at[1:]]
            if chained.any():
                step = np.arange(len(at))
                base = np.maximum.accumulate(np.where(chained, 0, step))
                at = at[(step - base) % 2 == 0]
        gone = after[at]
        token[at] = rank
        alive[gone] = False
        beyond = after[gone]
        after[at] = beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        left = before[at]
        look(np.unique(np.r_[at, left[left >= 0]]))
    return token[alive], np.bincount(word[alive], minlength=len(lengths))


def encode_block(data: np.ndarray, offsets: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts, one after the other, and how many each text has."""
    counts, starts_all, lengths_all = [], [], []
    for lo, hi in blocks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        if not len(part):
            counts.append(np.zeros(hi - lo, np.int64))
            continue
        codes = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((part & 0xC0) != 0x80)  # byte where each code point begins
        own = offsets[lo : hi + 1] - offsets[lo]
        first = np.zeros(len(codes), bool)
        first[np.searchsorted(lead, own[:-1][own[1:] > own[:-1]])] = True
        at = lead[piece_starts(codes, first, t["kinds"])]
        end = np.r_[at[1:], len(part)]
        starts_all.append(at + offsets[lo])
        lengths_all.append(end - at)
        counts.append(np.diff(np.searchsorted(at, own)))
    pieces = np.concatenate(counts) if counts else np.empty(0, np.int64)
    if not starts_all:
        return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    at, length = np.concatenate(starts_all), np.concatenate(lengths_all)
    # Pieces follow each other without gaps; equal ones are found by their bytes.
    ends = np.r_[at, at[-1] + length[-1]].astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    which = spans.dictionary_encode().indices.to_numpy()
    sample = np.zeros(which.max() + 1, np.int64)
    sample[which[::-1]] = np.arange(len(which))[::-1]
    words = data[spread(at[sample], length[sample])]
    ids, sizes = replay(words, length[sample], t)
    begin = np.cumsum(sizes) - sizes
    per_piece = sizes[which]
    out = ids[spread(begin[which], per_piece)]
    upto = np.r_[0, np.cumsum(per_piece)]
    last = np.cumsum(pieces)
    return out, upto[last] - upto[last - pieces]


def packed(values: np.ndarray, counts: np.ndarray) -> Iterator[pa.Array]:
    """Binary arrays of at most OUT_BYTES (or one value) with counts[i] items of ``values`` in row i."""
    at = np.r_[0, np.cumsum(counts)] * values.itemsize
    raw = values.view(np.uint8)
    for lo, hi in blocks(at, OUT_BYTES):
        part = np.ascontiguousarray(raw[at[lo] : at[hi]])
        own = (at[lo : hi + 1] - at[lo]).astype(np.int64)
        large = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(own), pa.py_buffer(part)])
        yield large.cast(pa.binary())


def in_turn(rows: list[int], parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same rows dealt out again as batches of the given lengths."""
    held: list[pa.Array] = []
    for part in parts:
        held.append(part)
        while rows and sum(map(len, held)) >= rows[0]:
            whole = pa.concat_arrays(held) if len(held) > 1 else held[0]
            yield whole[: rows[0]]
            held = [whole[rows.pop(0) :]]


def encoder(t):
    """Iterator over string batches giving binary ids; ``t`` is a broadcast of ``tables``."""

    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, size = [], 0

        def flush() -> Iterator[pa.Array]:
            data, offsets = text_bytes(pa.concat_arrays(held))
            ids, counts = encode_block(data, offsets, t.value)
            yield from in_turn([len(x) for x in held], packed(ids.astype("<u4"), counts))

        for batch in batches:
            held.append(batch.cast(pa.large_string()))
            size += batch.nbytes
            if size >= REPLAY_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return encode_texts


def decoder(t):
    """Iterator over batches of binary ids giving the bytes of their tokens."""

    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = t.value
        for batch in batches:
            large = batch.cast(pa.large_binary()).fill_null(b"")
            _, offsets, data = large.buffers()
            at = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            ids = np.ascontiguousarray(raw[at[0] : at[-1]]).view("<u4")
            at = (at - at[0]) // 4
            parts = []
            for lo, hi in blocks(at, OUT_BYTES // 16):
                some = ids[at[lo] : at[hi]]
                lengths = v["lengths"][some]
                out = v["bytes"][spread(v["starts"][some], lengths)]
                upto = np.r_[0, np.cumsum(lengths)]
                parts += packed(out, np.diff(upto[at[lo : hi + 1] - at[lo]]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return decode_ids


def vocabulary(spark: SparkSession, path: str):
    """Broadcast of a rank file's tables: a few MB, bounded by the vocabulary and not by the data."""
    return spark.sparkContext.broadcast(tables(read_ranks(path)))


def encode(docs: DataFrame, vocab, text: str | Column = "text", out: str = "ids") -> DataFrame:
    """Add the ids of ``text`` as little-endian unsigned 32-bit integers in a binary column."""
    small_batches(docs.sparkSession)
    fn = F.arrow_udf(encoder(vocab), "binary")
    return docs.withColumn(out, fn(F.col(text) if isinstance(text, str) else text))


def decode(docs: DataFrame, vocab, ids: str | Column = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that binary ``ids`` stand for."""
    small_batches(docs.sparkSession)
    fn = F.arrow_udf(decoder(vocab), "binary")
    return docs.withColumn(out, fn(F.col(ids) if isinstance(ids, str) else ids))


def encode_and_decode(docs: DataFrame, vocab) -> DataFrame:
    """Per row: doc_id, number of ids, and SHA-256 of the packed ids and of the decoded bytes.

    Encoder and decoder follow each other in one function, so that a task has one Python worker.
    """
    small_batches(docs.sparkSession)
    encode_texts, decode_ids = encoder(vocab), decoder(vocab)

    def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def pairs() -> Iterator[pa.Array]:
            for ids in encode_texts(batches):
                (decoded,) = decode_ids(iter([ids]))
                yield pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])

        yield from released(pairs())

    both = docs.select("doc_id", F.arrow_udf(round_trip, "struct<ids:binary,decoded:binary>")("text").alias("__x"))
    return both.select(
        "doc_id",
        (F.octet_length("__x.ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("__x.ids", 256).alias("ids_sha256"),
        F.sha2("__x.decoded", 256).alias("decoded_sha256"),
    )
