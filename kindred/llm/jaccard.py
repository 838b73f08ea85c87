"""Exact Jaccard self-join of shingle sets: universe partition, pigeonhole, verification.

A document's set holds the hashes of its distinct word k-shingles.  Equal sets are collapsed to
one.  Sizes are cut into bands so that two linked sets lie in the same band or in neighbouring
ones; each band has a scheme, in which its own sets and those of the band below take part.

Universe partition: a scheme hashes tokens into m segments.  Two sets of the scheme that link
differ in at most H tokens, so of any H + 1 segments one is equal in both (pigeonhole), and of
any ceil((H + 1) / 2) one differs in at most one token.  A scheme indexes either its segments'
hashes, or these and the hashes of their one-deletion neighbourhoods; ``layout`` takes the
cheaper one by the expected number of signatures and of segments too thin to tell sets apart.

Allocation: there are more segments than needed.  A set probes the subset that is cheapest by
the sizes of the signature lists; segments that no other set shares cost nothing and count
first, so a set with enough of them is done.  Lists that are not probed are dropped: common
lines, passages and empty segments.  What remains connects sets into clusters; every linked pair
lies in one.  A cluster is verified in blocks of at most 2 * CHUNK sets with an exact lower bound
on the difference (parity bitmaps) and then the sets themselves; a block gives a spanning forest
of its links, never pairs.  Chance signatures join many unlike sets into one cluster as a corpus
grows, so a cluster of several chunks is first taken apart by the bound alone: its blocks hold
bitmaps, a tenth of the sets' bytes, in larger chunks.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  With fewer than k words the whole
sequence is the one shingle; null texts and texts without words have an empty set and link with
nothing.  Shingles and sets are told apart by 64-bit hashes.  Equal sets link, so repeated rows
share a component; rows with a null id take part, and a component without any id has a null one.
No rows give no rows; further columns are left out of the report.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import PrimeHash, blocks, drop_stored, give_back, id_filter, mixed, packed_rows, released, small_batches, stored
from .common import text_bytes, unpacked_rows
from .components import components

#: Sets, and about as many tokens, of one chunk of a cluster; a block compares two chunks.
CHUNK, CHUNK_TOKENS = 4096, 1 << 20
#: Sets, and bytes of bitmaps, of a chunk of a cluster that is taken apart.
MAPS, MAP_BYTES = 16384, 1 << 22
#: Bytes of text whose shingles are hashed at once (or one text): tables and sums of the hash are that long.
SET_BYTES = 256 * 1024
#: Signatures held by a task before they are sent on.
HELD = 500_000
#: Cost of a segment that has next to no tokens, in signatures.
THIN = 40.0
#: Segments beyond the needed ones, as a share.
SPARE = 0.2
LARGEST = 1 << 31

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, hashes: PrimeHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts, sorted in each, one text after the other; and their numbers."""
    n = len(offsets) - 1
    low = _LOWER[data]
    sign = ~_BLANK[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(sign & np.r_[True, ~sign[:-1]] | sign & edge[:-1])
    end = np.flatnonzero(sign & np.r_[~sign[1:], True] | sign & edge[1:]) + 1
    owner = np.searchsorted(offsets, start, "right") - 1
    words = hashes(low, start, end)
    each = np.bincount(owner, minlength=n)
    # Fold the words of a shingle; texts with fewer than k words fold all they have.
    size = np.minimum(each, k)
    last = np.cumsum(each)
    ok = np.arange(len(words)) <= (last - size)[owner]
    first = np.flatnonzero(ok)
    of = owner[first]
    h = mixed(words[first] + size[of].astype(np.uint64))
    for j in range(1, k):
        more = size[of] > j
        h[more] = mixed(h[more] * np.uint64(0x9E3779B97F4A7C15) + words[first[more] + j])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[keep], np.bincount(of[keep], minlength=n)


def set_ids(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One even, positive 63-bit id per set from sums over its tokens; 0 for the empty set."""
    owner = np.repeat(np.arange(len(counts)), counts)
    high, lower = halves(mixed(tokens + np.uint64(77)))
    a, b = (np.bincount(owner, x, minlength=len(counts)).astype(np.uint64) for x in (high, lower))
    ids = mixed(mixed(a + np.uint64(5)) ^ (b * np.uint64(0x9E3779B97F4A7C15)) + counts.astype(np.uint64))
    ids = (ids >> np.uint64(1)) & ~np.uint64(1)
    return np.where(counts > 0, np.maximum(ids, np.uint64(2)), 0).astype(np.int64)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower 32 bits as doubles: sums of them over a text are exact."""
    return (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)


def layout(hi: int, percent: int) -> dict:
    """Segments of the scheme for sets of up to ``hi`` tokens, and which signatures they have."""
    differ = (100 - percent) * 2 * hi // (100 + percent)
    need = {False: differ + 1, True: differ // 2 + 1}
    best = None
    for deletions in (False, True):
        m = need[deletions] + (int(need[deletions] * SPARE) + 1 if need[deletions] > 2 else need[deletions] - 1)
        load = hi * 0.92 / m
        thin = exp(-load) * (1 + load + (load * load / 2 if deletions else 0))
        signatures = m * (1 + load) if deletions else m
        cost = signatures * (1 + THIN * thin)
        if best is None or cost < best["cost"]:
            best = {"cost": cost, "differ": differ, "m": m, "need": need[deletions], "deletions": deletions}
    return best


def schemes(percent: int) -> tuple[np.ndarray, list[dict]]:
    """First size of each band, and the scheme of each band.

    A signature has eight bits for the scheme: from 95 % on there are more bands than that.
    """
    if not 50 <= percent <= 94:
        raise ValueError("a similarity of 50 to 94 percent")
    edges = [1]
    while edges[-1] < LARGEST:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges), [layout(b - 1, percent) for a, b in zip(edges, edges[1:], strict=False)]


def signatures(tokens: np.ndarray, counts: np.ndarray, ids: np.ndarray, percent: int, plan=None):
    """(signature, set id with the role in its lowest bit) of the given sets.

    Role 0 is a set in its own band's scheme, role 1 in that of the band above.  A signature holds
    48 bits of hash, the scheme, and (with deletions) the segment, else 0.
    """
    edges, plans = plan or schemes(percent)
    band = np.searchsorted(edges, counts, "right") - 1
    owner = np.repeat(np.arange(len(counts)), counts)
    high, lower = halves(tokens)
    out_sig, out_id = [], []
    eight = np.uint64(8)
    for role in (0, 1):
        scheme = band + role
        m = np.array([p["m"] for p in plans])[np.minimum(scheme, len(plans) - 1)]
        live = np.array([p["differ"] > 0 for p in plans])[np.minimum(scheme, len(plans) - 1)] & (counts > 0)
        dele = np.array([p["deletions"] for p in plans])[np.minimum(scheme, len(plans) - 1)]
        m = np.where(live, m, 0)
        base = np.cumsum(m) - m
        some = live[owner]
        mine = owner[some]
        mix = mixed(tokens[some] + scheme[mine].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        seg = ((mix >> np.uint64(32)) * m[mine].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        at = base[mine] + seg
        total = int(m.sum())
        a = np.bincount(at, high[some], minlength=total)
        b = np.bincount(at, lower[some], minlength=total)
        who = np.repeat(np.arange(len(counts)), m)
        place = np.arange(total) - base[who]

        def sign(a, b, who, place, scheme=scheme, dele=dele):
            h = mixed(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(b.astype(np.uint64) + np.uint64(3)))
            h = mixed(h + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + scheme[who].astype(np.uint64))
            tail = np.where(dele[who], place.astype(np.uint64) & np.uint64(255), np.uint64(0))
            return h & ~np.uint64(0xFFFF) | scheme[who].astype(np.uint64) << eight | tail

        out_sig.append(sign(a, b, who, place))
        out_id.append(ids[who] | role)
        gone = dele[mine]
        if gone.any():
            out_sig.append(sign((a[at] - high[some])[gone], (b[at] - lower[some])[gone], mine[gone], seg[gone]))
            out_id.append(ids[mine[gone]] | role)
    return np.concatenate(out_sig), np.concatenate(out_id)


#: Bits of a set id by which signature lists and clusters name a set.  Sets that share them are one
#: node there: their clusters are one, which verification takes apart.
NODE = (1 << 48) - 2

#: Fields of a row of packed signatures, sorted by signature: steps between their upper 32 bits (two
#: fields, the upper one nearly all zeros), the rest of the hash, the scheme, the segment, and the key.
PACKED = [("step", "<u2"), ("far", "<u2"), ("rest", "<u2"), ("scheme", "u1"), ("segment", "u1"), ("key", "<u4"), ("key_high", "<u2")]


def pack(sig: np.ndarray, key: np.ndarray) -> dict[str, np.ndarray]:
    """The fields of sorted signatures and their keys of 48 bits, 11 bytes for most and compressible zeros."""
    upper = (sig >> np.uint64(32)).astype(np.int64)
    step = np.diff(upper, prepend=0)
    of = {
        "step": step, "far": step >> 16, "rest": sig >> np.uint64(16), "scheme": sig >> np.uint64(8), "segment": sig,
        "key": key, "key_high": key >> 32,
    }
    return {name: of[name].astype(kind) for name, kind in PACKED}


def unpack(rows: dict[str, list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and keys of packed rows, one row after the other."""
    of = {name: np.frombuffer(b"".join(rows[name]), kind) for name, kind in PACKED}
    n = np.array([len(x) for x in rows["segment"]], np.int64)
    upper = np.cumsum(of["step"].astype(np.int64) | of["far"].astype(np.int64) << 16)
    before = np.r_[np.int64(0), upper][np.cumsum(n) - n]
    upper = (upper - np.repeat(before, n)).astype(np.uint64)
    sig = upper << np.uint64(32) | of["rest"].astype(np.uint64) << np.uint64(16)
    sig |= of["scheme"].astype(np.uint64) << np.uint64(8) | of["segment"].astype(np.uint64)
    return sig, of["key"].astype(np.int64) | of["key_high"].astype(np.int64) << 32


def id_columns(doc_id: str) -> list[Column]:
    """A row's id as (is null, id)."""
    return [
        F.col(doc_id).isNull().alias("no_id"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0).cast("bigint")).alias("id"),
    ]


def set_sizes(docs: DataFrame, k: int, text: str = "text", out: str = "__set") -> DataFrame:
    """Add a struct with the id and the size of each row's shingle set."""
    small_batches(docs.sparkSession)
    kind = pa.struct([("set_id", pa.int64()), ("n", pa.int64())])

    def of_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(sized(batches))

    def sized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = PrimeHash(1)
        for batch in batches:
            data, at = text_bytes(batch)
            ids, sizes = [], []
            for lo, hi in blocks(at, SET_BYTES):
                tokens, counts = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k, hashes)
                ids.append(set_ids(tokens, counts))
                sizes.append(counts)
            if ids:
                parts = [pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes).astype(np.int64))]
                yield pa.StructArray.from_arrays(parts, fields=list(kind))
            else:
                yield pa.array([], kind)

    return docs.withColumn(out, F.arrow_udf(of_texts, "struct<set_id:bigint,n:bigint>")(text))


def signature_lists(docs: DataFrame, k: int, percent: int, text: str = "text") -> DataFrame:
    """(sig, key, members) of every signature that sets of its scheme share, one row per set in it.

    A key has a set's NODE bits and the role.  Tasks deal their signatures out to buckets by the upper
    bits and send them packed, one row per bucket; a bucket is sorted in numpy.  Sets that repeat in
    a task are sent once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    plan = schemes(percent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from released(dealt_out(batches))

    def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = PrimeHash(1), np.empty(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            sig = np.concatenate([s for s, _ in held])
            key = np.concatenate([x for _, x in held])
            order = np.argsort(sig)
            sig, key = sig[order], key[order] & (NODE | 1)
            bucket = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[first[1:], len(bucket)]
            rows = [pack(sig[a:b], key[a:b]) for a, b in zip(first, ends, strict=True)]
            fields = [pa.array([row[name].tobytes() for row in rows], pa.binary()) for name, _ in PACKED]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *fields], ["bucket", *dict(PACKED)])

        size = 0
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for lo, hi in blocks(at, SET_BYTES):
                tokens, counts = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k, hashes)
                ids = set_ids(tokens, counts)
                _, where = np.unique(ids, return_index=True)
                fresh = np.zeros(len(ids), bool)
                fresh[where] = True
                fresh &= ~np.isin(ids, seen) & (counts > 0)
                seen = np.union1d(seen, ids[fresh])
                tokens = tokens[np.repeat(fresh, counts)]
                if fresh.any():
                    held.append(signatures(tokens, counts[fresh], ids[fresh], percent, plan))
                    size += len(held[-1][0])
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def shared(table: pa.Table) -> pa.Table:
        try:
            return shared_in(table)
        finally:
            give_back()

    def shared_in(table: pa.Table) -> pa.Table:
        sig, key = unpack({name: table[name].to_pylist() for name, _ in PACKED})
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        keep = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
        sig, key = sig[keep], key[keep]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        ends = np.r_[first[1:], len(sig)]
        members = ends - first
        own = np.add.reduceat((key & 1) == 0, first)
        good = np.repeat((members > 1) & (own > 0), members)
        return pa.table(
            {
                "sig": sig[good].view(np.int64),
                "key": key[good],
                "members": np.repeat(members, members)[good].astype(np.int64),
            }
        )

    dealt = docs.select(F.col(text)).mapInArrow(deal, "bucket int, " + ", ".join(f"{name} binary" for name, _ in PACKED))
    return dealt.groupBy("bucket").applyInArrow(shared, "sig bigint, key bigint, members bigint")


def clusters(lists: DataFrame, percent: int) -> DataFrame:
    """(node, cluster): nodes of sets that cheapest-first probing leaves connected."""
    _, plans = schemes(percent)
    scheme = F.shiftright(F.col("sig"), 8).bitwiseAND(F.lit(255).cast("bigint")).cast("int")
    lists = stored(lists)

    def of(name: str) -> Column:
        return F.get(F.array(*[F.lit(int(p[name])) for p in plans]), scheme)

    segment = F.when(of("deletions") == 1, F.col("sig").bitwiseAND(F.lit(255).cast("bigint"))).otherwise(F.col("sig"))
    probing = lists.filter(F.col("key").bitwiseAND(F.lit(1).cast("bigint")) == 0).withColumn("seg", segment)
    probing = probing.withColumn("spare", of("m") - of("need"))
    cost = F.sum("members").over(W.partitionBy("key", "seg"))
    ranked = probing.withColumn("cost", cost).withColumn(
        "place", F.dense_rank().over(W.partitionBy("key").orderBy("cost", "seg"))
    )
    alive = F.max("place").over(W.partitionBy("key"))
    chosen = ranked.withColumn("alive", alive).filter(F.col("place") <= F.col("alive") - F.col("spare"))
    pivots = chosen.groupBy("sig").agg(F.min("key").alias("b"))
    own = F.col("key").bitwiseAND(F.lit(~1).cast("bigint"))
    edges = lists.join(pivots, "sig").select(own.alias("a"), "b").filter("a <> b").distinct()
    found = components(edges)
    drop_stored(lists)  # the components are stored
    return found.select("node", F.col("component").alias("cluster"))


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the tokens in each of ``bits`` cells, as words."""
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def bits_for(size: int) -> int:
    """Cells of the bitmap of a set: four to eight a token, at least 256 and at most 65,536."""
    return 1 << min(16, max(8, int(4 * size).bit_length()))


def near_forest(size: np.ndarray, maps: list[np.ndarray], chunk: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose bitmaps don't show that they differ in too many tokens.

    With two chunks only pairs between them are looked at.  A bitmap is folded to the length of the
    smaller set's.
    """
    order = np.argsort(size, kind="stable")
    size, chunk = size[order], chunk[order]
    words = np.array([len(maps[o]) for o in order])
    two = chunk.min() != chunk.max()
    label = np.arange(len(order))
    out = []
    for w in np.unique(words):
        first, last = np.searchsorted(words, w), np.searchsorted(words, w, "right")
        reach = np.searchsorted(size, size[first:last] * 100 // percent, "right")
        table = np.empty((reach[-1] - first, w), np.uint64)
        for r in range(first, reach[-1]):
            table[r - first] = np.bitwise_xor.reduce(maps[order[r]].reshape(-1, w), axis=0)
        for i, upto in enumerate(reach, first):
            apart = np.bitwise_count(table[i + 1 - first : upto - first] ^ table[i - first]).sum(axis=1, dtype=np.int64)
            near = apart <= (100 - percent) * (size[i] + size[i + 1 : upto]) // (100 + percent)
            if two:
                near &= chunk[i + 1 : upto] != chunk[i]
            near &= label[i + 1 : upto] != label[i]
            js = np.flatnonzero(near) + i + 1
            _, pick = np.unique(label[js], return_index=True)
            for j in js[pick].tolist():
                label[label == label[j]] = label[i]
                out.append((int(order[i]), int(order[j])))
    return out


def forest(sets: list[np.ndarray], chunk: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets; with two chunks only links between them are looked for."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, chunk = size[order], chunk[order]
    bits = bits_for(size[-1])
    packed = np.empty((len(sets), bits // 64), np.uint64)
    for i, o in enumerate(order):
        packed[i] = bitmap(sets[o], bits)
    two = chunk.min() != chunk.max()
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(sets) - 1):
        upto = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        if upto <= i + 1:
            continue
        most = (100 - percent) * (size[i] + size[i + 1 : upto]) // (100 + percent)
        apart = np.bitwise_count(packed[i + 1 : upto] ^ packed[i]).sum(axis=1, dtype=np.int64)
        near = apart <= most
        if two:
            near &= chunk[i + 1 : upto] != chunk[i]
        js = np.flatnonzero(near)
        for j in (js[np.argsort(apart[js], kind="stable")] + i + 1).tolist():
            a, b = find(i), find(j)
            if a == b:
                continue
            same = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
            if 100 * same >= percent * (size[i] + size[j] - same):
                root[max(a, b)] = min(a, b)
                out.append((int(order[i]), int(order[j])))
    return out


def taken_apart(sets: DataFrame, percent: int) -> DataFrame:
    """(set_id, cluster, chunks) of the sets that may link with another of their cluster, in finer clusters.

    ``sets`` has (set_id, cluster, tokens); two sets of a cluster that link lie in one finer cluster.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from released(maps_of(batches))

    def maps_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(2)]
            maps = pa.array([bitmap(x, bits_for(len(x))).tobytes() for x in tokens], pa.binary())
            n = pa.array([len(x) for x in tokens], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, maps], ["set_id", "cluster", "n", "map"])

    mapped_sets = sets.select("set_id", "cluster", "tokens").mapInArrow(
        mapped, "set_id bigint, cluster bigint, n bigint, map binary"
    )
    mapped_sets = stored(mapped_sets)
    parts = mapped_sets.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum(F.length("map")) / MAP_BYTES), F.ceil(F.count("*") / MAPS)).cast("int").alias("parts")
    )
    # A row for thousands of sets or a million tokens at least; a cluster's sets are not gathered by it.
    dealt = mapped_sets.join(F.broadcast(parts), "cluster").withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cluster", "set_id", "n", "map", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")
    )

    def near(table: pa.Table) -> pa.Table:
        try:
            return near_in(table)
        finally:
            give_back()

    def near_in(table: pa.Table) -> pa.Table:
        ids, n, chunk = (table[c].to_numpy() for c in ("set_id", "n", "chunk"))
        maps = [np.frombuffer(x.as_py(), np.uint64) for x in table["map"]]
        found = near_forest(n, maps, chunk, percent)
        return pa.table({"a": pa.array([ids[a] for a, _ in found], pa.int64()), "b": pa.array([ids[b] for _, b in found], pa.int64())})

    edges = dealt.groupBy("cluster", "lo", "hi").applyInArrow(near, "a bigint, b bigint")
    finer = components(edges).select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))
    finer = stored(finer.join(mapped_sets.groupBy("set_id").agg(F.max("n").alias("n")), "set_id"))
    drop_stored(mapped_sets)
    return finer.join(finer.groupBy("cluster").agg(chunks_of().alias("chunks")), "cluster").drop("n")


def chunks_of() -> Column:
    """Chunks of a cluster of sets of ``n`` tokens."""
    return F.greatest(F.ceil(F.sum("n") / CHUNK_TOKENS), F.ceil(F.count("*") / CHUNK))


def links(docs: DataFrame, rows: DataFrame, grouped: DataFrame, k: int, percent: int, text: str = "text") -> DataFrame:
    """(a, b) set ids: spanning forests of the verified links of each cluster.

    ``rows`` has (no_id, id, set_id, n) of every document.  One document is fetched per clustered set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    node = F.col("set_id").bitwiseAND(F.lit(NODE).cast("bigint"))
    reps = rows.filter("n > 0").withColumn("node", node).join(grouped, "node").groupBy("set_id", "cluster").agg(
        F.min(F.struct("no_id", "id")).alias("r"), F.max("n").alias("n")
    )
    reps = stored(reps)
    sizes = reps.groupBy("cluster").agg(chunks_of().alias("chunks"))
    most = sizes.agg(F.max("chunks")).first()[0] or 0
    bins = 1 + (reps.agg(F.sum("n")).first()[0] or 0) // CHUNK_TOKENS
    wanted = reps.join(sizes, "cluster").select(
        F.col("r.no_id").alias("no_id"), F.col("r.id").alias("id"), F.col("set_id").alias("want"), "cluster", "chunks"
    )
    # Most documents are not wanted: they go before the texts are dealt out.
    here = id_filter(reps.select(F.xxhash64("r.no_id", "r.id").alias("h")), "h")
    named = docs.select(*id_columns("doc_id"), F.col(text).alias("t")).filter(here(F.xxhash64("no_id", "id")))
    texts = named.join(wanted, ["no_id", "id"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from released(picked(batches))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = PrimeHash(1), set()
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            want = batch.column(1).to_numpy()
            for lo, hi in blocks(at, SET_BYTES):
                tokens, counts = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k, hashes)
                ids = set_ids(tokens, counts)
                upto = np.r_[0, np.cumsum(counts)]
                pick = []
                for i in range(hi - lo):
                    # Ids may repeat with other texts, and rows may repeat wholly.
                    if ids[i] == want[lo + i] and int(ids[i]) not in seen:
                        seen.add(int(ids[i]))
                        pick.append(i)
                if pick:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[pick]),
                            batch.column(2).take(pa.array([lo + i for i in pick])),
                            batch.column(3).take(pa.array([lo + i for i in pick])),
                            pa.array([tokens[upto[i] : upto[i + 1]].tobytes() for i in pick], pa.binary()),
                        ],
                        ["set_id", "cluster", "chunks", "tokens"],
                    )

    fetched = texts.select("t", "want", "cluster", "chunks").mapInArrow(
        sets_of, "set_id bigint, cluster bigint, chunks bigint, tokens binary"
    )
    sets = fetched
    if most > 1:
        fetched = stored(fetched)
        large = fetched.filter("chunks > 1")
        finer = large.select("set_id", "tokens").join(taken_apart(large, percent), "set_id")
        sets = fetched.filter("chunks = 1").unionByName(finer)
    # A cluster of one chunk shares a bin with others; of a larger one, each pair of chunks is a block.
    chunks = F.col("chunks").cast("int")
    mine = F.pmod(F.xxhash64("set_id"), chunks).cast("int")
    dealt = sets.withColumn("chunk", mine).withColumn(
        "other", F.explode_outer(F.sequence(F.lit(0), chunks - 1))
    )
    single = chunks == 1
    dealt = dealt.select(
        "set_id",
        "cluster",
        "chunk",
        "tokens",
        F.when(single, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")).alias("bin"),
        F.least("chunk", "other").alias("lo"),
        F.greatest("chunk", "other").alias("hi"),
    )

    def verify(table: pa.Table) -> pa.Table:
        try:
            return verified(table)
        finally:
            give_back()

    def verified(table: pa.Table) -> pa.Table:
        cluster, ids, chunk = (table[c].to_numpy() for c in ("cluster", "set_id", "chunk"))
        tokens = table["tokens"]
        order = np.lexsort((ids, cluster))
        found: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.diff(cluster[order])) + 1
        for part in np.split(order, cuts):
            part = part[np.r_[True, np.diff(ids[part]) != 0]]
            if len(part) > 1:
                sets = [np.frombuffer(tokens[int(i)].as_py(), np.uint64) for i in part]
                found += [(int(ids[part[a]]), int(ids[part[b]])) for a, b in forest(sets, chunk[part], percent)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    found = stored(dealt.groupBy("bin", "lo", "hi").applyInArrow(verify, "a bigint, b bigint"))
    if most > 1:
        drop_stored(fetched)
    return found


def classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(no_id, id, set_id, n) of every row, and (set_id, no_id, id, first_set) of each set's component.

    The second gives the least id of the component, ids before null, and a set that has it.
    """
    sized = set_sizes(docs.select("doc_id", "text"), k)
    rows = stored(sized.select(*id_columns("doc_id"), "__set.set_id", "__set.n"))
    edges = links(docs, rows, clusters(signature_lists(docs, k, percent), percent), k, percent)
    found = components(edges).select(F.col("node").alias("set_id"), "component")
    per_set = rows.filter("n > 0").groupBy("set_id").agg(F.min(F.struct("no_id", "id", "set_id")).alias("r"))
    named = per_set.join(found, "set_id", "left").withColumn("c", F.coalesce("component", "set_id"))
    named = stored(named.select("set_id", "c", "r"))
    least = named.groupBy("c").agg(F.min("r").alias("least"))
    out = named.join(least, "c").select("set_id", "least.no_id", "least.id", F.col("least.set_id").alias("first_set"))
    return rows, stored(out)


def join_report(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Every document's set size and the smallest doc_id that links lead to."""
    rows, found = classes(docs, k, percent)
    of = found.select("set_id", F.col("no_id").alias("c_null"), F.col("id").alias("c_id"))
    mine = F.when(~F.col("no_id"), F.col("id"))
    component = F.when(F.col("c_id").isNull(), mine).otherwise(F.when(~F.col("c_null"), F.col("c_id")))
    return rows.join(of, "set_id", "left").select(
        mine.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")
    )


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one with its least id; documents without words all stay.

    Only documents that share their id or their component with others are dealt out; the rest pass
    where they are read.
    """
    rows, found = classes(docs, k, percent)
    first = found.select(F.col("first_set").alias("s"), "no_id", "id").distinct()
    rows_of = rows.filter("n > 0").groupBy("no_id", "id", "set_id").agg(F.count("*").alias("copies"))
    mine = (rows_of["set_id"] == first["s"]) & (rows_of["no_id"] == first["no_id"]) & (rows_of["id"] == first["id"])
    alone = rows_of.join(first, mine, "left").filter(first["s"].isNull() | (rows_of["copies"] > 1))
    doubtful = id_filter(alone.select(F.xxhash64(rows_of["no_id"], rows_of["id"]).alias("h")), "h")
    named = packed_rows(docs, "doc_id", "text").select(
        "__row", "text", *id_columns("doc_id")
    ).withColumn("__doubt", doubtful(F.xxhash64("no_id", "id")))
    keyed = set_sizes(named.filter("__doubt"), k).select(
        "__row", F.col("no_id").alias("own_no_id"), F.col("id").alias("own_id"), "__set"
    )
    on = (F.col("__set.set_id") == F.col("s")) & (F.col("own_no_id") == F.col("no_id")) & (F.col("own_id") == F.col("id"))
    matched = keyed.filter("__set.n > 0").join(first, on)
    copies = W.partitionBy("s", "no_id", "id").orderBy("s")
    kept = matched.withColumn("nth", F.row_number().over(copies)).filter("nth = 1")
    parts = named.filter("NOT __doubt"), kept, keyed.filter("__set.n = 0")
    return unpacked_rows(parts[0].select("__row").unionByName(parts[1].select("__row")).unionByName(parts[2].select("__row")))
