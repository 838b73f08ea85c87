"""Alignment of two tokenizers' tokens by byte offsets.

A is a byte-level BPE read from a JSON file and encodes a space and the text; B is a sentence-piece
model, which puts the space in front by itself.  Special tokens in texts are plain text.  A text is
aligned if the bytes of its A tokens and of its B tokens are both the space and the text; a null,
empty or otherwise changed text has no tokens, zeros, and an empty string for the digest.

Everything on a batch is columnar: the token lists of a block of texts are flattened with their
parent indices, ends are running sums of the tokens' byte lengths less the sum at the start of
each text, and a hash join on (text, end) gives the places where both tokenizers end a token.
These cut the tokens into groups, and each links its A token with its B token.  Pairs of ids are
counted with ``Table.group_by`` per text; the tables are merged by Spark.

What is sent to every task has a proven bound: linked tokens end together, so the shorter one's
bytes are a suffix of the longer one's, and a token has at most as many suffixes as bytes.  The
distinct pairs thus number at most twice the bytes of both vocabularies (each suffix may be a piece
and a single byte), whatever the corpus; ``pair_bound`` is checked.  Texts are encoded once: a row
per text with its own pairs is stored in the shared folder, and read for the counts and again for
the figures that need them.

Repeated rows count as often as they stand.  No rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, released, small_batches, stored, text_bytes

#: Bytes of text encoded at once (or one text).
BLOCK = 256 * 1024


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


#: Fixed value: how a byte-level pre-tokenizer with its own pattern cuts a text.
BYTE_LEVEL_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _own_bytes(spec: dict) -> dict[int, bytes]:
    letters = byte_letters()
    return {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}


def bytes_of_a(path: str) -> list[bytes]:
    """Bytes of each id of the JSON file; an added token's text stands for itself."""
    spec = _spec(path)
    found = _own_bytes(spec)
    for token in spec.get("added_tokens", []):
        found[token["id"]] = token["content"].encode()
    return [found.get(i, b"") for i in range(max(found) + 1)]


def encoder_a(path: str):
    """Texts to ids by the JSON file, special tokens being plain text.

    A plain byte-level BPE, whose merges have ids in their order, is the ranks that tiktoken
    replays, about four times as fast; any other file goes through the tokenizers library.
    """
    spec = _spec(path)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab", {})
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model.get("merges", [])]
    merged = [vocab.get(a + b, -1) for a, b in pairs] if model.get("type") == "BPE" else [-1]
    added = {t["id"] for t in spec.get("added_tokens", [])}
    plain = (
        spec.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and min(merged, default=-1) >= 256
        and merged == sorted(set(merged))
        and len({*vocab.values()} - added) == len(merged) + 256
    )
    if plain:
        import tiktoken

        ranks = {x: i for i, x in _own_bytes(spec).items() if i not in added}
        encoding = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(x) for x in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def bytes_of_b(model) -> list[bytes]:
    """Bytes of each piece; unknown and control pieces have none, so a text with one is not aligned."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:-1], 16)]))
        elif model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
            out.append(b"")
        else:
            out.append(piece.replace("▁", " ").encode())
    return out


class Tokens:
    """Byte strings of a vocabulary behind each other, to join the bytes of many tokens at once."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries) or b"\0", np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        total = int(size.sum())
        return self.data[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(total)]


@lru_cache(maxsize=2)
def _tokenizers(path_a: str, path_b: str):
    """Both tokenizers of a Python worker, single-threaded, and their tokens' bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    return encoder_a(path_a), b, Tokens(bytes_of_a(path_a)), Tokens(bytes_of_b(b))


def pair_bound(path_a: str, path_b: str) -> int:
    """The most pairs of ids that any corpus can link."""
    _, _, a, b = _tokenizers(path_a, path_b)
    return 2 * int(a.size.sum() + b.size.sum())


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
    flat = np.concatenate([np.array(x, np.int32) for x in ids]) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _whole(lists: pa.ListArray, tokens: Tokens, wanted: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts' tokens join to the wanted bytes."""
    ids = lists.flatten().to_numpy()
    parent = pc.list_parent_indices(lists).to_numpy()
    size = np.bincount(parent, tokens.size[ids], len(lists)).astype(np.int64)
    good = size == np.diff(offsets)
    mine = good[parent]
    data = tokens.joined(ids[mine])
    where = np.repeat(good, np.diff(offsets))
    differs = np.flatnonzero(data != wanted[where])
    end = np.cumsum(np.where(good, size, 0))
    good[np.searchsorted(end, differs, "right")] = False
    return good


def _ends(lists: pa.ListArray, tokens: Tokens, side: str) -> tuple[pa.Table, np.ndarray]:
    """(key, id, place) of each token, its key being the text and the byte where it ends; and parents."""
    ids, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    size = tokens.size[ids.to_numpy()]
    running = pc.cumulative_sum(pa.array(size)).to_numpy() if len(size) else size
    first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else parent
    base = np.zeros(len(lists), np.int64)
    base[parent[first]] = running[first] - size[first]
    key = (parent.astype(np.int64) << 40) + running - base[parent]
    # A token without bytes ends where its neighbour does and takes part in no link.
    some = size > 0
    place = np.arange(len(ids))
    return pa.table({"key": key[some], f"id_{side}": ids.to_numpy()[some], f"at_{side}": place[some]}), parent


def _groups(lists: pa.ListArray, parent: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Ids of each group in decimal, joined by commas; ``cuts`` are the places of the groups' last tokens."""
    offsets = pa.array(np.r_[0, cuts + 1].astype(np.int32))
    text = lists.flatten().cast(pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, text), ",")


def align(texts: pa.Array, path_a: str, path_b: str) -> pa.Table:
    """One row per text: numbers of tokens, groups and links, the groups' digest, pairs and their numbers.

    A pair is ``a_id * len(B) + b_id``.
    """
    a, b, bytes_a, bytes_b = _tokenizers(path_a, path_b)
    texts = texts.fill_null("")
    plain = texts.to_pylist()
    spaced = [" " + x for x in plain]
    lists_a = _lists(a(spaced))
    lists_b = _lists(b.encode(plain, num_threads=1) if plain else [])
    wanted, offsets = text_bytes(pa.array(spaced, pa.string()))
    filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    good = filled & _whole(lists_a, bytes_a, wanted, offsets) & _whole(lists_b, bytes_b, wanted, offsets)
    # Texts that are not aligned go on with empty lists.
    mask = pa.array(good)
    empty = pa.scalar([], lists_a.type)
    lists_a, lists_b = pc.if_else(mask, lists_a, empty), pc.if_else(mask, lists_b, empty)
    n_texts, n_b_ids = len(texts), len(bytes_b.size)
    ends_a, parent_a = _ends(lists_a, bytes_a, "a")
    ends_b, parent_b = _ends(lists_b, bytes_b, "b")
    links = ends_a.join(ends_b, "key", join_type="inner", use_threads=False).sort_by("key")
    key = links["key"].to_numpy()
    text = key >> 40
    pair = links["id_a"].to_numpy().astype(np.int64) * n_b_ids + links["id_b"].to_numpy()
    # One common end is one group, as every token has bytes in an aligned text.
    joined = pc.binary_join_element_wise(
        _groups(lists_a, parent_a, links["at_a"].to_numpy()), _groups(lists_b, parent_b, links["at_b"].to_numpy()), "|"
    )
    n_links = np.bincount(text, minlength=n_texts)
    per_text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_links)].astype(np.int32)), joined), ";")
    digests = [hashlib.sha256(x.as_buffer()).hexdigest() if ok else "" for x, ok in zip(per_text, good.tolist())]
    counted = (
        pa.table({"text": text, "pair": pair, "one": np.ones(len(pair), np.int64)})
        .group_by(["text", "pair"], use_threads=False)
        .aggregate([("one", "sum")])
        .sort_by([("text", "ascending"), ("pair", "ascending")])
    )
    own = np.bincount(counted["text"].to_numpy(), minlength=n_texts)
    reach = pa.array(np.r_[0, np.cumsum(own)].astype(np.int32))
    return pa.table(
        {
            "n_a": pc.list_value_length(lists_a).cast(pa.int64()),
            "n_b": pc.list_value_length(lists_b).cast(pa.int64()),
            "n_groups": n_links,
            "n_links": n_links,
            "groups_sha256": digests,
            "pairs": pa.ListArray.from_arrays(reach, counted["pair"].combine_chunks()),
            "times": pa.ListArray.from_arrays(reach, counted["one_sum"].combine_chunks().cast(pa.int32())),
        }
    )


def _local(path: str) -> str:
    """The file on an executor: where it is on the driver, or as Spark has distributed it."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def aligned(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = _local(path_a), _local(path_b)
        for batch in batches:
            texts = batch.column(1)
            _, offsets = text_bytes(texts)
            for first, last in blocks(offsets, BLOCK):
                rows = align(texts.slice(first, last - first), *paths)
                columns = [batch.column(0).slice(first, last - first), *(x.combine_chunks() for x in rows.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *rows.column_names])

    kind = docs.schema[id].dataType.simpleString()
    schema = (
        f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "pairs array<bigint>, times array<int>"
    )
    return docs.select(F.col(id).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda x: released(run(x)), schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n) over the corpus: partial counts of each batch by ``Table.group_by``, merged by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.table({"pair": batch.column(0).flatten(), "n": batch.column(1).flatten().cast(pa.int64())})
            held = part if held is None else pa.concat_tables([held, part])
            held = held.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])
        if held is not None:
            yield from held.to_batches()

    return rows.select("pairs", "times").mapInArrow(lambda x: released(count(x)), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(rows: DataFrame, counts: DataFrame, n_b_ids: int, bound: int) -> DataFrame:
    """Add ``n_best`` and ``count_sum``: how the corpus-wide counts rate a document's links."""
    spark = rows.sparkSession
    # One row per pair of ids that can end together: bounded by the vocabularies, not by the corpus.
    table = counts.toArrow()
    if len(table) > bound:
        raise ValueError("more pairs than two vocabularies can have")
    table = table.sort_by("pair")
    pair, n = table["pair"].to_numpy(), table["n"].to_numpy()
    most = np.zeros(n_b_ids, np.int64)
    np.maximum.at(most, pair % n_b_ids, n)
    shared = spark.sparkContext.broadcast((pair, n, most[pair % n_b_ids] == n))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            owner = pc.list_parent_indices(lists).to_numpy()
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            sums = np.zeros((2, len(lists)), np.int64)
            np.add.at(sums[0], owner, times * best[at])
            np.add.at(sums[1], owner, times * n[at])
            kept = batch.drop_columns(["pairs", "times"])
            yield kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema if x.name not in ("pairs", "times"))
    return rows.mapInArrow(lambda x: released(rate(x)), f"{schema}, n_best bigint, count_sum bigint")


def alignment_report(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id") -> DataFrame:
    """The alignment of each document, with corpus-wide counts of its links."""
    rows = stored(aligned(docs, path_a, path_b, id))
    counts = pair_counts(rows)
    n_b_ids = len(_tokenizers(path_a, path_b)[3].size)
    return (
        with_best(rows, counts, n_b_ids, pair_bound(path_a, path_b))
        .withColumnRenamed("id", id)
        .select(id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    )
