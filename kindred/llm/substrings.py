"""Exact substring dedup: every word of a window of ``words`` words that stands elsewhere goes.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Two equal windows anywhere, in one document or in
two, mark all their words; windows are judged on the input.

Sharding.  A window's anchor is the run of ``GRAM`` words in it with the least hash (the first of
equal ones), so equal windows have equal anchors.  Consecutive windows with one anchor form a
piece of at most 2 * words - GRAM words.  A first pass counts anchors over the corpus; a window
whose anchor stands once stands once.  Pieces whose anchor repeats go to the shard of the anchor's
hash, and so all equal windows meet in one shard.  An anchor that stands more than ``HOT`` times
sends its windows one by one to the shard of the window's own digest: a passage in a third of all
documents is spread out, and its equal windows are merged before they are sent.

A shard has a compressed FM-index (``fm_index``) over its distinct pieces.  Those that came once
are streamed through it, without words that can be in no repeated window: backward search over the wavelet tree gives their matching statistics, the
longest run from each word that stands at least twice in the shard, and places where it reaches
``words`` are reported as windows; of a piece that came several times, all windows are.  Only digests and window
masks return to the documents.  Hashes choose shards and anchors; equality is decided by the index
on the words themselves, and digests that carry results back have 128 bits.

Shards hold ``SHARD_PIECES`` pieces on average, whatever the input.  Documents and their candidates
meet by a hash of the text in joins that adaptive execution splits where one text is hot.

Null texts have no words; texts of fewer words than a window lose none.  Wholly repeated documents
of a window or more lose all their words.  No rows give no rows; further columns are ignored by
the report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, blocks, mixed, released, small_batches, spread, stored, text_bytes
from .fm_index import FMIndex

WORDS, GRAM = 35, 8
#: Pieces of a shard on average: an index of a few MB.
SHARD_PIECES = 8000
#: Anchors with more pieces send their windows one by one.
HOT = 2000
#: Longest run of words that is counted before a shard's index is built.
RUN = 8
#: Distinct pieces that a task merges before it sends them.
MERGED = 100_000

_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_PIECES = "shard int, piece string, n bigint"
_PLACES = "t bigint, own binary, first int, digest binary"


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with one space after each word; start and end of the words, and the words of each text."""
    sign = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(sign & (edge[:-1] | np.r_[True, ~sign[:-1]]))
    size = np.flatnonzero(sign & (edge[1:] | np.r_[~sign[1:], True])) + 1 - start
    end = np.cumsum(size + 1) - 1
    first = end - size
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    out[spread(first, size)] = data[spread(start, size)]
    owner = np.searchsorted(offsets, start, "right") - 1
    return out, first, end, np.bincount(owner, minlength=len(offsets) - 1)


def first_least(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, the place of its first least value."""
    n = len(h) - width + 1
    at, span = np.arange(len(h)), 1
    while span * 2 <= width:
        a, b = at[:-span], at[span:]
        at, span = np.where(h[a] <= h[b], a, b), span * 2
    a, b = at[:n], at[width - span : width - span + n]
    return np.where(h[a] <= h[b], a, b)


class Pieces:
    """Pieces of a block of texts: runs of windows with one anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: int, hashes: RangeHash):
        self.data, self.start, self.end, self.each = normalised(data, offsets)
        self.words = words
        gram = min(GRAM, words)
        n, last = len(self.start), np.cumsum(self.each)
        self.before = last - self.each
        self.anchor = self.first = self.windows = self.owner = np.empty(0, np.int64)
        if n < words:
            return
        of = np.repeat(np.arange(len(self.each)), self.each)
        h = hashes(self.data, self.start[: n - gram + 1], self.end[gram - 1 :])
        place = first_least(h, words - gram + 1)
        valid = np.flatnonzero(of[: n - words + 1] == of[words - 1 :])
        if not len(valid):
            return
        place = place[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)
        cut = np.flatnonzero(new)
        self.first = valid[cut]
        self.windows = np.diff(np.r_[cut, len(valid)])
        self.anchor = h[place[cut]].astype(np.int64)
        self.owner = of[self.first]

    def cut(self, hot: np.ndarray, repeated: np.ndarray) -> None:
        """Keep pieces with a repeated anchor; cut those of hot anchors into windows."""
        keep = np.isin(self.anchor, repeated)
        self.first, self.windows, self.anchor, self.owner = (
            x[keep] for x in (self.first, self.windows, self.anchor, self.owner)
        )
        self.single = np.isin(self.anchor, hot)
        times = np.where(self.single, self.windows, 1)
        self.first = spread(self.first, times) if len(times) else self.first
        again = np.repeat(np.arange(len(times)), times)
        self.anchor, self.owner, self.single = self.anchor[again], self.owner[again], self.single[again]
        self.windows = np.where(self.single, 1, self.windows[again])

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        a, b = self.start[self.first].tolist(), self.end[self.first + self.windows + self.words - 2].tolist()
        return [raw[x:y] for x, y in zip(a, b)]


def digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def text_blocks(texts: pa.Array, *others: pa.Array) -> Iterator[tuple]:
    """(bytes, offsets, first, last) of runs of texts of bounded size."""
    data, offsets = text_bytes(texts)
    for a, b in blocks(offsets):
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, b


def anchors(docs: DataFrame, words: int) -> DataFrame:
    """(t, h, n): hashes of the text and of its anchors, and how many pieces have the anchor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RangeHash(1)
        for batch in batches:
            t = batch.column(1).to_numpy()
            for data, offsets, a, b in text_blocks(batch.column(0)):
                p = Pieces(data, offsets, words, hashes)
                if len(p.anchor):
                    order = np.lexsort((p.anchor, p.owner))
                    own, h = p.owner[order], p.anchor[order]
                    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (h[1:] != h[:-1])])
                    n = np.diff(np.r_[new, len(h)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t[a:b][own[new]]), pa.array(h[new]), pa.array(n)], names=["t", "h", "n"]
                    )

    return docs.select("text", "t").mapInArrow(lambda x: released(find(x)), "t bigint, h bigint, n bigint")


def _cut_blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple]:
    """(pieces, hashes of the texts, digests of the texts) of rows (text, t, candidates)."""
    hashes = RangeHash(1)
    for batch in batches:
        t = batch.column("t").to_numpy()
        lists = batch.column("candidates")
        for data, offsets, a, b in text_blocks(batch.column("text")):
            flat = lists.slice(a, b - a).flatten()
            h, hot = flat.field("h").to_numpy(), flat.field("hot").to_numpy(zero_copy_only=False)
            p = Pieces(data, offsets, words, hashes)
            p.cut(np.unique(h[hot]), np.unique(h))
            own = [digest(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(b - a)]
            yield p, t[a:b], own


def _pieces(words: int, shards: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in held.values()], pa.int32()),
                    pa.array(list(held), pa.binary()).cast(pa.string()),
                    pa.array([x[1] for x in held.values()], pa.int64()),
                ],
                names=["shard", "piece", "n"],
            )
            held.clear()
            return rows

        for p, _, _ in _cut_blocks(batches, words):
            shard = (mixed(p.anchor) % np.uint64(shards)).tolist()
            for text, at, single in zip(p.texts(), shard, p.single.tolist()):
                found = held.get(text)
                if found:
                    found[1] += 1
                else:
                    held[text] = [int.from_bytes(digest(text)[:6], "big") % shards if single else at, 1]
            if len(held) >= MERGED:
                yield flush()
        if held:
            yield flush()

    return lambda x: released(send(x))


def _places(words: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, t, own in _cut_blocks(batches, words):
            if len(p.first):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(t[p.owner]),
                        pa.array([own[i] for i in p.owner.tolist()], pa.binary()),
                        pa.array((p.first - p.before[p.owner]).astype(np.int32)),
                        pa.array([digest(x) for x in p.texts()], pa.binary()),
                    ],
                    names=["t", "own", "first", "digest"],
                )

    return lambda x: released(send(x))


def repeated_windows(pieces: list[bytes], twice: np.ndarray, words: int) -> np.ndarray:
    """For distinct pieces, a mask of their windows that stand twice among them (bit i: window i).

    ``twice`` marks pieces that came several times: all their windows do.  A run of 2, 4 or 8 words
    that stands once in the shard lies in no repeated window, and a word that is only in such runs
    is in none.  The index is built over the stretches of other words, where they hold a window,
    and those of pieces that came once are searched in it.
    """
    flat = pc.split_pattern(pa.array(pieces, pa.binary()).cast(pa.string()), " ")
    size = np.diff(flat.offsets.to_numpy())
    coded = flat.flatten().dictionary_encode()
    numbers, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    windows = size - words + 1
    mask = np.where(twice, (np.int64(1) << windows) - 1, 0)
    owner = np.repeat(np.arange(len(pieces)), size)
    begin, place = np.cumsum(size) - size, np.arange(len(numbers))
    to_end = (begin + size)[owner] - place
    weight = (1 + twice)[owner]
    gram, length = numbers, 1
    common = np.bincount(gram, weight, n) >= 2
    good = common[gram]
    while length < RUN and 2 * length <= words:
        ahead = np.r_[gram[length:], np.zeros(length, np.int64)]
        kinds, gram = np.unique(gram * n + ahead, return_inverse=True)
        n, length = len(kinds), 2 * length
        # Runs across the end of a piece count for nothing.
        common = np.bincount(gram, weight * (to_end >= length), n) >= 2
    upto = np.r_[0, np.cumsum(common[gram] & (to_end >= length))]
    good &= upto[place + 1] > upto[np.maximum(place - length + 1, 0)]
    # Stretches of words left, inside one piece, that hold a window.
    starts = np.flatnonzero(good & (np.r_[True, ~good[:-1]] | (place == begin[owner])))
    ends = np.flatnonzero(good & (np.r_[~good[1:], True] | (to_end == 1))) + 1
    long = ends - starts >= words
    starts, span = starts[long], (ends - starts)[long]
    once = ~twice[owner[starts]]
    if not once.any():
        return mask
    at = np.cumsum(span + 1) - span - 1
    symbols = np.zeros(int((span + 1).sum()), np.int64)
    kinds, coded = np.unique(numbers[spread(starts, span)], return_inverse=True)
    symbols[spread(at, span)] = coded + 1
    reach = FMIndex(symbols, len(kinds) + 1).matching_statistics(symbols, at[once], span[once])
    inside = span[once] - words + 1
    found = reach[spread(at[once], inside)] >= words
    first = spread(starts[once], inside)[found]
    np.bitwise_or.at(mask, owner[first], np.int64(1) << (first - begin[owner[first]]))
    return mask


def _searched(words: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for piece, n in zip(batch.column("piece").cast(pa.binary()).to_pylist(), batch.column("n").to_pylist()):
                held[piece] = held.get(piece, 0) + n
        pieces = list(held)
        mask = repeated_windows(pieces, np.fromiter(held.values(), np.int64, len(held)) > 1, words)
        some = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays(
            [pa.array([digest(pieces[i]) for i in some.tolist()], pa.binary()), pa.array(mask[some])],
            names=["digest", "mask"],
        )

    return search


def _removed(words: int, id_type):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            for data, offsets, a, b in text_blocks(batch.column("text")):
                out, start, end, each = normalised(data, offsets)
                before = np.cumsum(each) - each
                part = lists.slice(a, b - a)
                flat = part.flatten()
                owner = pc.list_parent_indices(part).to_numpy()
                own = flat.field("own").to_pylist()
                digests = {}
                mine = np.zeros(len(owner), bool)
                for i, (o, x) in enumerate(zip(owner.tolist(), own)):
                    if o not in digests:
                        digests[o] = digest(data[offsets[o] : offsets[o + 1]].tobytes())
                    mine[i] = digests[o] == x
                mask = flat.field("mask").to_numpy()[mine]
                at = before[owner[mine]] + flat.field("first").to_numpy()[mine]
                gone = np.zeros(len(start) + 1, np.int64)
                for bit in range(int(mask.max(initial=0)).bit_length()):
                    first = at[(mask >> bit) & 1 == 1] + bit
                    np.add.at(gone, first, 1)
                    np.add.at(gone, first + words, -1)
                stays = np.cumsum(gone)[:-1] == 0
                n_kept = np.bincount(np.repeat(np.arange(b - a), each)[stays], minlength=b - a)
                size = end - start + 1
                kept = out[spread(start[stays], size[stays])].tobytes()
                reach = np.r_[0, np.cumsum(np.bincount(np.repeat(np.arange(b - a), each)[stays], size[stays], b - a))].astype(np.int64)
                hashes = [
                    hashlib.sha256(kept[x : max(x, y - 1)]).hexdigest() for x, y in zip(reach[:-1].tolist(), reach[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        pa.array(each.astype(np.int64)),
                        pa.array((each - n_kept).astype(np.int64)),
                        pa.array(hashes),
                        pa.array([kept[x : max(x, y - 1)] for x, y in zip(reach[:-1].tolist(), reach[1:].tolist())], pa.binary()).cast(pa.string()),
                    ],
                    names=["id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return lambda x: released(judge(x))


def dedup(docs: DataFrame, id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) of each document; ``kept`` are the words left, one space between.

    ``words`` is at least 2 and at most 70: a piece's windows have one bit each.
    """
    if not 2 <= words <= 70:
        raise ValueError("windows of 2 to 70 words")
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id).alias("id"), F.col("text"), F.xxhash64("text").alias("t"))
    counts = anchors(base, words).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    repeated = stored(counts.select("h", "n", (F.col("n") > HOT).alias("hot")))
    pieces = repeated.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-pieces // SHARD_PIECES))
    candidates = stored(
        anchors(base, words)
        .select("t", "h")
        .join(repeated.select("h", "hot"), "h")
        .groupBy("t")
        .agg(F.collect_set(F.struct("h", "hot")).alias("candidates"))
    )
    some = base.join(candidates, "t")
    searched = _searched(words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from released(searched(batches))

    masks = some.mapInArrow(_pieces(words, shards), _PIECES).groupBy("shard").applyInArrow(search, "digest binary, mask bigint")
    found = (
        some.mapInArrow(_places(words), _PLACES)
        .join(masks, "digest")
        .groupBy("t")
        .agg(F.collect_set(F.struct("own", "first", "mask")).alias("found"))
    )
    id_type = base.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    return base.join(found, "t", "left").select("id", "text", "found").mapInArrow(_removed(words, id_type), schema).withColumnRenamed("id", id)


def dedup_report(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("kept")


#: The same in SQL, over whole tables.
DEDUP_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents),
windows AS (
  SELECT row, i, array_to_string(list_slice(words, i, i + 34), ' ') AS piece
  FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM texts WHERE len(words) >= 35) z),
repeated AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY piece) AS n FROM windows) z WHERE n > 1),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS j FROM repeated),
lost AS (SELECT row, list(j) AS js FROM gone GROUP BY row),
kept AS (
  SELECT t.row, t.doc_id, t.words, coalesce(len(l.js), 0) AS n_removed,
         CASE WHEN l.js IS NULL THEN t.words
              ELSE list_transform(list_filter(range(1, len(t.words) + 1), lambda x: NOT list_contains(l.js, x)),
                                  lambda x: t.words[x]) END AS left_words
  FROM texts t LEFT JOIN lost l USING (row))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(left_words, ' ')) AS kept_sha256
FROM kept
"""
