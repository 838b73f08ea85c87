"""Ranked lexical search: the best documents of each item, by range-maximum queries.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, with
A-Z in lower case.  Documents stay where they are read: a task builds posting lists, sorted by
document, for the items' terms in blocks of bounded size.  Every posting has its impact (the
term's weight times the document's damped frequency), and every list a sparse table that gives
the largest impact between two postings in two look-ups.

An item is answered best first.  The sum of its lists' range maxima bounds the score of every
document in an interval.  The interval with the highest bound is taken, the document of its
largest impact is scored, and the intervals left and right of it go back with bounds of their
own.  The search ends when no bound reaches the k-th score; nothing is cut off before.  A task
keeps its k best per item from block to block, so later blocks start with a high threshold, and
Spark merges the tasks' lists in two steps.

The statistics (documents with terms, all terms, documents per term) are partial sums of a first
pass.  Items are held in blocks of ``ITEM_BYTES`` of text: a larger item table takes more passes
over the documents, and what is sent to the tasks stays bounded.

Integer arithmetic throughout; weights come from one logarithm in doubles.  Null and empty texts
have no terms, and items without terms, or whose terms no document holds, have no rows.  Equal
scores go by ascending id, null ids last.  Repeated documents are ranked one by one, and a
repeated item has its rows once for each repetition.  Further columns of both tables are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import blocks, released, small_batches, text_bytes

#: Bytes of item texts that are searched in one pass over the documents (or one item).
ITEM_BYTES = 4 << 20
#: Postings of a block of documents (or one document).
POSTINGS = 500_000
#: Intervals of one item that are split at once.
AT_ONCE = 16
#: First step of the merge: lists of an item are merged in so many parts.
PARTS = 64

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_TERM = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts, one after the other, and the number of the text that holds each."""
    low = _LOWER[data]
    sign = _TERM[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(sign & (edge[:-1] | np.r_[True, ~sign[:-1]]))
    end = np.flatnonzero(sign & (edge[1:] | np.r_[~sign[1:], True])) + 1
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    terms = pa.Array.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(low[sign].tobytes())]
    )
    return terms, np.searchsorted(offsets, start, "right") - 1


def in_vocabulary(terms: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Place of each term in the vocabulary, or -1."""
    return pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def item_terms(texts: list[str | None]) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The vocabulary of items, and for each its distinct terms and how often it holds them."""
    terms, owner = terms_of(*text_bytes(pa.array(texts, pa.string())))
    vocabulary = terms.unique()
    at = in_vocabulary(terms, vocabulary)
    found = []
    for i in range(len(texts)):
        times = Counter(at[owner == i].tolist()) if len(texts) < 64 else None
        if times is None:
            lo, hi = np.searchsorted(owner, [i, i + 1])
            times = Counter(at[lo:hi].tolist())
        found.append((np.array(list(times), np.int64), np.array(list(times.values()), np.int64)))
    return vocabulary, found


def counted(texts: DataFrame, vocabulary: pa.Array) -> tuple[int, int, np.ndarray]:
    """Texts with a term, all terms, and the number of texts that hold each word of the vocabulary."""
    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        n_texts = n_terms = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in blocks(offsets):
                cut = offsets[a : b + 1] - offsets[a]
                terms, owner = terms_of(data[offsets[a] : offsets[b]], cut)
                n_texts += len(np.unique(owner))
                n_terms += len(owner)
                at = in_vocabulary(terms, vocabulary)
                pairs = np.unique(owner[at >= 0] * size + at[at >= 0])
                held += np.bincount(pairs % max(size, 1), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[[-2, -1], some]), pa.array(np.r_[[n_texts, n_terms], held[some]])], names=["what", "n"]
        )

    sums = texts.mapInArrow(lambda x: released(count(x)), "what bigint, n bigint").groupBy("what").agg(F.sum("n").alias("n"))
    held = np.zeros(size, np.int64)
    totals = {-2: 0, -1: 0}
    # At most one row per word of the vocabulary, which ITEM_BYTES bounds.
    for what, n in sums.collect():
        if what < 0:
            totals[what] = n
        else:
            held[what] = n
    return totals[-2], totals[-1], held


def weights(n_texts: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_texts + 2) / (2 * int(d) + 1))) for d in held], np.int64)


class Postings:
    """Posting lists of a block of documents, with impacts and one sparse table over all lists.

    Lists follow each other; look-ups stay inside a list, so one table serves them all.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray, n: int, total: int, weight: np.ndarray):
        self.docs = max(len(lengths), 1)
        damp = 8 * (100 - 75 + (75 * lengths * n) // max(total, 1))
        key = term * self.docs + doc
        order = np.argsort(key, kind="stable")
        self.key, self.doc = key[order], doc[order]
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + damp[doc]))
        #: One entry more: the value of an empty range.
        self.impact = np.r_[impact[order], 0]
        count = len(key)
        longest = int(np.bincount(term).max()) if count else 0
        self.table = [np.arange(count, dtype=np.int32)]
        while 1 << len(self.table) <= longest:
            step = 1 << len(self.table) - 1
            left = self.table[-1]
            right = left[np.minimum(np.arange(count) + step, count - 1)]
            self.table.append(np.where(self.impact[left] >= self.impact[right], left, right))
        self.table = np.concatenate(self.table) if count else np.empty(0, np.int32)
        self.count = count
        self.log = np.zeros(longest + 2, np.int64)
        for i in range(2, longest + 2):
            self.log[i] = self.log[i // 2] + 1

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.key, terms * self.docs), np.searchsorted(self.key, (terms + 1) * self.docs)

    def largest(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of the largest impact in each range; ``count``, whose impact is 0, in an empty one."""
        size = right - left
        some = size > 0
        level = self.log[np.where(some, size, 1)]
        base = level * self.count
        a = self.table[base + np.where(some, left, 0)]
        b = self.table[base + np.where(some, right - (1 << level), 0)]
        return np.where(some, np.where(self.impact[a] >= self.impact[b], a, b), self.count)

    def search(self, terms: np.ndarray, times: np.ndarray, ids: list, best: list, k: int) -> int:
        """Bring ``best``, the k least (-score, no id, id), up to date; returns how many documents were scored."""
        left, right = self.lists(terms)
        there = right > left
        terms, times, left, right = terms[there], times[there], left[there], right[there]
        if not len(terms):
            return 0
        first = terms * self.docs
        top = self.largest(left, right)
        heap = [(-int((times * self.impact[top]).sum()), 0, self.docs, left, right, top)]
        scored = 0

        def hopeless(bound: int, lo: int) -> bool:
            return len(best) >= k and (bound, ids[lo] is None, ids[lo] or 0) >= best[-1]

        while heap:
            taken = []
            while heap and len(taken) < AT_ONCE:
                item = heapq.heappop(heap)
                if len(best) >= k and item[0] > best[-1][0]:
                    heap.clear()
                elif not hopeless(item[0], item[1]):
                    taken.append(item)
            if not taken:
                break
            left, right, top = (np.stack([x[i] for x in taken]) for i in (3, 4, 5))
            row = np.arange(len(taken))
            most = top[row, (times * self.impact[top]).argmax(1)]
            doc = self.doc[most]
            at = np.searchsorted(self.key, first + doc[:, None])
            at = np.minimum(np.maximum(at, left), right)
            hit = (at < right) & (self.doc[np.minimum(at, self.count - 1)] == doc[:, None])
            scores = (times * self.impact[np.where(hit, at, self.count)]).sum(1)
            scored += len(taken)
            for d, score in zip(doc.tolist(), scores.tolist()):
                if score > 0:
                    insort(best, (-score, ids[d] is None, ids[d] or 0))
            del best[k:]
            lefts, rights = np.concatenate([left, at + hit]), np.concatenate([at, right])
            tops = self.largest(lefts, rights)
            bounds = (times * self.impact[tops]).sum(1).tolist()
            m = len(taken)
            for i, bound in enumerate(bounds):
                lo, hi = (taken[i][1], int(doc[i])) if i < m else (int(doc[i - m]) + 1, taken[i - m][2])
                if bound > 0 and lo < hi and not hopeless(-bound, lo):
                    heapq.heappush(heap, (-bound, lo, hi, lefts[i], rights[i], tops[i]))
        return scored


def _order(ids: pa.Array) -> np.ndarray:
    return pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()


def search_block(docs: DataFrame, items: list, vocabulary: pa.Array, wanted: list, k: int, id: str, item_type: pa.DataType) -> DataFrame:
    """(item number, item id, document id, score): the k best of each task for each item."""
    n_texts, n_terms, held = counted(docs.select("text"), vocabulary)
    weight, size = weights(n_texts, held), len(vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in wanted]
        ids, lengths, pairs, tfs, waiting = [], [], [], [], 0
        kind = None

        def answer():
            nonlocal ids, lengths, pairs, tfs, waiting
            named = pa.concat_arrays(ids)
            order = _order(named)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            pair, n = np.concatenate(pairs), np.concatenate(lengths)
            lists = Postings(pair % size, rank[pair // size], np.concatenate(tfs), n[order], n_texts, n_terms, weight)
            named = named.take(pa.array(order)).to_pylist()
            for (terms, times), top in zip(wanted, best):
                lists.search(terms, times, named, top, k)
            ids, lengths, pairs, tfs, waiting = [], [], [], [], 0

        docs_before = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            kind = batch.column(0).type
            for a, b in blocks(offsets):
                cut = offsets[a : b + 1] - offsets[a]
                terms, owner = terms_of(data[offsets[a] : offsets[b]], cut)
                at = in_vocabulary(terms, vocabulary)
                docs_before = sum(map(len, lengths))
                pair, tf = np.unique((owner[at >= 0] + docs_before) * size + at[at >= 0], return_counts=True)
                ids.append(batch.column(0).slice(a, b - a))
                lengths.append(np.bincount(owner, minlength=b - a).astype(np.int64))
                pairs.append(pair)
                tfs.append(tf.astype(np.int64))
                waiting += len(pair)
                if waiting >= POSTINGS:
                    answer()
        if ids:
            answer()
        rows = [(i, items[i], None if no_id else doc, -score) for i, top in enumerate(best) for score, no_id, doc in top]
        if rows:
            number, item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), pa.array(item, item_type), pa.array(doc, kind), pa.array(score, pa.int64())],
                names=["number", "item_id", "doc_id", "score"],
            )

    id_type = docs.schema[id].dataType.simpleString()
    from pyspark.sql.pandas.types import from_arrow_type

    schema = f"number int, item_id {from_arrow_type(item_type).simpleString()}, doc_id {id_type}, score bigint"
    return docs.select(F.col(id), "text").mapInArrow(lambda x: released(search(x)), schema)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item; lists of many tasks are merged in parts first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
    some = (
        found.withColumn("part", part)
        .withColumn("rank", F.row_number().over(W.partitionBy("number", "part").orderBy(*order)))
        .filter(F.col("rank") <= k)
    )
    return (
        some.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(*order)))
        .filter(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", item_id: str = "item_id", item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id), F.col("text"))
    item_type = to_arrow_type(items.schema[item_id].dataType)
    items = items.select(F.col(item_id).alias("item_id"), F.col("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // item_bytes))
    found = None
    for part in range(parts):
        # Bounded by ITEM_BYTES on average, as the table's size was measured above.
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect() if parts > 1 else items.collect()
        vocabulary, wanted = item_terms([r[1] for r in rows])
        some = best_of(search_block(docs, [r[0] for r in rows], vocabulary, wanted, k, id, item_type), k)
        found = some if found is None else found.unionByName(some)
    return found


def search_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(docs, items).select("item_id", "rank", "doc_id", "score")


#: The same ranking in SQL, over whole tables.
SEARCH_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
wanted AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) z GROUP BY ALL),
lengths AS (SELECT row, count(*) AS n FROM words GROUP BY row),
totals AS (SELECT count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
postings AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words
             WHERE term IN (SELECT term FROM wanted) GROUP BY row, term),
weighted AS (SELECT term, CAST(floor(1000 * ln((2 * n_texts + 2) / (2 * df + 1))) AS BIGINT) AS w
             FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) d, totals),
impacts AS (
  SELECT p.row, p.doc_id, p.term,
         w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + ((75 * l.n * t.n_texts) // t.n_terms)))) AS impact
  FROM postings p JOIN lengths l USING (row) JOIN weighted w USING (term), totals t),
scores AS (
  SELECT q.item, any_value(q.item_id) AS item_id, i.row, any_value(i.doc_id) AS doc_id,
         CAST(sum(q.times * i.impact) AS BIGINT) AS score
  FROM wanted q JOIN impacts i USING (term) GROUP BY q.item, i.row)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) z
WHERE rank <= 10
"""
