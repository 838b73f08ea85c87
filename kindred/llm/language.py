"""Language identification by Bayesian fusion of evidence.

* Text: naive Bayes over hashed byte trigrams (letters only, A-Z lower-cased), with one table of
  log likelihoods per language, counted on a sample of the rows that declare the language.  Every
  declared language has a table; texts are weighed by blocks of languages in turn.
* Declared language: of a column, or of the ``lang`` attribute of markup.
* Address suffix: a country suffix that is a language's code.
* Host: shares of languages among all rows of a host by the text evidence, smoothed towards its
  domain, that towards its suffix, and that towards the whole table; one grouped aggregation.

Neighbouring trigrams are not independent, so n of them count as n * M / (n + M) with M =
``TRIGRAMS``.  The posterior is the normalised product; its best language (of equals the first by
name) is the answer, accepted from ``LEAST`` on.

Null and empty texts, and texts without letters, are not accepted and have no language.  Null,
unknown or missing declarations and hosts are no evidence.  If no row declares a language nothing
can be learned: languages are null and every row is accepted.  Repeated rows repeat their result
(they count in their host's shares), no rows give no rows, and further columns pass through (a
column named like an added one is replaced).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, released, small_batches, stored, text_bytes
from .urls import host_and_path

BUCKETS = 1 << 15
#: Rows that declare a language from which its table is counted, as an expected number.
TRAIN_ROWS = 1000
#: Languages whose tables a worker, or the driver, holds at once; every declared language has one.
LANGUAGE_BLOCK = 64
#: Steps of the hash by which training rows are chosen.
SAMPLE_STEPS = 1 << 52
TRIGRAMS = 150.0
LEAST = 0.6
#: How often a declaration, and a country suffix, names the right language.
DECLARED, SUFFIX = 0.85, 0.6
#: Rows that the next coarser level counts as, in the smoothed shares of a host.
COARSER = 10.0

_KEPT = np.array(
    [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32
)


def trigrams(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of the trigram at each byte, and whether it counts: it lies in one text and has a letter."""
    b = _KEPT[data]
    n = len(b)
    bucket = np.zeros(n, np.int64)
    counts = np.zeros(n, bool)
    if n > 2:
        code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        bucket[:-2] = (code * np.uint32(2654435761)) >> np.uint32(32 - 15)
        counts[:-2] = code != 0x202020
    ends = np.cumsum(lengths)
    for back in (1, 2):
        at = ends - back
        counts[at[lengths >= back]] = False
    return bucket, counts


def count_table(sample: DataFrame, text: str, language: str) -> DataFrame:
    """(language, packed buckets that occur, their packed counts) of a sample, one row per language."""
    kind = "l string, b binary, n binary"

    def packed(name: str, counts: np.ndarray) -> tuple[str, bytes, bytes]:
        found = np.flatnonzero(counts)
        return name, found.astype("<i4").tobytes(), counts[found].astype("<i8").tobytes()

    def batch_of(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        columns = zip(*[packed(*x) for x in held.items()], strict=True)
        types = (pa.string(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["l", "b", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from released(counted(batches))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            data, at = text_bytes(batch.column(0))
            for i, name in enumerate(names):
                if name not in held and len(held) == LANGUAGE_BLOCK:
                    yield batch_of(held)
                    held = {}
                part = data[at[i] : at[i + 1]]
                bucket, counts = trigrams(part, np.array([len(part)]))
                mine = held.setdefault(name, np.zeros(BUCKETS, np.int64))
                mine += np.bincount(bucket[counts], minlength=BUCKETS)
        if held:
            yield batch_of(held)

    def add(table: pa.Table) -> pa.Table:
        whole = sum(unpacked(b.as_py(), n.as_py()) for b, n in zip(table["b"], table["n"], strict=True))
        row = packed(table["l"][0].as_py(), whole)
        return pa.table({k: pa.array([v], t) for k, v, t in zip("lbn", row, table.schema.types, strict=True)})

    parts = sample.select(F.col(text).alias("t"), F.col(language).alias("l")).mapInArrow(count, kind)
    return parts.groupBy("l").applyInArrow(add, kind)


def unpacked(buckets: bytes, counts: bytes) -> np.ndarray:
    """Counts of all buckets from a row of ``count_table``."""
    whole = np.zeros(BUCKETS, np.int64)
    whole[np.frombuffer(buckets, "<i4")] = np.frombuffer(counts, "<i8")
    return whole


def declared_code(column: Column) -> Column:
    """Language code of a declaration such as ``en-GB``: lower case, up to the first sign that is no letter."""
    code = F.regexp_extract(F.lower(F.trim(column)), "^([a-z]{2,3})([^a-z]|$)", 1)
    return F.when(code != "", code)


def markup_language(html: Column) -> Column:
    """The ``lang`` attribute of a page's html element."""
    return declared_code(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z][a-z-]*)", 1))


def sampled(count: Column) -> Column:
    """Steps of SAMPLE_STEPS that choose about TRAIN_ROWS of ``count`` rows; one at least."""
    share = F.least(F.lit(1.0), F.lit(float(TRAIN_ROWS)) / count)
    return F.greatest(F.lit(1).cast("bigint"), F.floor(share * float(SAMPLE_STEPS)).cast("bigint"))


def train(docs: DataFrame, text: str, declared: Column) -> dict | None:
    """Languages in order, and their log likelihood tables: broadcasts of (LANGUAGE_BLOCK x buckets) each."""
    spark = docs.sparkSession
    named = docs.select(F.col(text).alias("__t"), declared.alias("__l"), F.xxhash64(*_plain(docs)).alias("__h"))
    named = named.filter("__l IS NOT NULL")
    # Codes have two or three letters, so there are 18,252 at most.
    steps = stored(named.groupBy("__l").agg(sampled(F.count("*")).alias("__n")))
    sample = named.join(F.broadcast(steps), "__l").filter(F.pmod("__h", F.lit(SAMPLE_STEPS)) < F.col("__n"))
    tables = stored(count_table(sample, "__t", "__l"))
    names = sorted(r["l"] for r in tables.select("l").collect())
    if not names:
        return None

    def counted() -> Iterator[np.ndarray]:
        for first in range(0, len(names), LANGUAGE_BLOCK):
            some = names[first : first + LANGUAGE_BLOCK]
            rows = {r["l"]: unpacked(r["b"], r["n"]) for r in tables.filter(F.col("l").isin(some)).collect()}
            yield np.stack([rows[x] for x in some]).astype(float)

    overall = sum(counts.sum(axis=0) for counts in counted())
    overall = (overall + 0.5) / (overall.sum() + 0.5 * BUCKETS)
    held = []
    for counts in counted():
        smooth = counts + 50 * BUCKETS / 100 * overall * 0.5
        table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
        held.append(spark.sparkContext.broadcast(table))
    return {"languages": names, "tables": held}


def _plain(docs: DataFrame) -> list[str]:
    return [c for c, t in docs.dtypes if "map<" not in t]


def text_evidence(docs: DataFrame, model: dict, text: str = "text", out: str = "__text_ll") -> DataFrame:
    """Add the log likelihood of the text per language; null where the text has no letters."""
    small_batches(docs.sparkSession)
    held, k = model["tables"], len(model["languages"])

    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(weighed(batches))

    def weighed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data, at = text_bytes(batch)
            out = np.zeros((len(batch), k))
            n = np.zeros(len(batch))
            first = 0
            for one in held:  # blocks of languages in turn
                table = one.value
                for lo, hi in blocks(at):
                    part, own = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                    bucket, counts = trigrams(part, np.diff(own))
                    some = bucket[counts]
                    upto = np.r_[0, np.cumsum(counts)]
                    edge = upto[own]
                    n[lo:hi] = np.diff(edge)
                    for i, row in enumerate(table, first):
                        sums = np.r_[0.0, np.cumsum(row[some], dtype=np.float64)]
                        out[lo:hi, i] = np.diff(sums[edge])
                first += len(table)
                if len(held) > 1:
                    del table
                    one.__dict__.pop("_value", None)  # read again from its file for the next batch
            out *= np.where(n > 0, TRIGRAMS / (n + TRIGRAMS), 0)[:, None]
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * np.int32(k))
            yield pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(n == 0))

    return docs.withColumn(out, F.arrow_udf(weigh, "array<double>")(text))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalised(logs: Column) -> Column:
    """Probabilities from log weights."""

    def shared(raw: Column) -> Column:
        whole = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
        return bound(whole, lambda w: F.transform(raw, lambda x: x / w))

    def raised(v: Column) -> Column:
        return bound(F.array_max(v), lambda most: bound(F.transform(v, lambda x: F.exp(x - most)), shared))

    return bound(logs, raised)


def vector_sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of the arrays ``__v`` per key, place by place: a group is added up per place before it is gathered."""
    places = rows.select(*keys, F.posexplode("__v").alias("__i", "__x"))
    sums = places.groupBy(*keys, "__i").agg(F.sum("__x").alias("__x"))
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__x"))).alias("__v"))
    return whole.withColumn("__v", F.col("__v")["__x"])


def host_shares(scored: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """Smoothed language shares per host (``__h`` null: none), and those of the whole table."""
    rows = scored.filter("__text_ll IS NOT NULL").select("__h", "__d", "__s", normalised(F.col("__text_ll")).alias("__v"))
    hosts = stored(vector_sums(rows, "__h", "__d", "__s"))
    found = hosts.select(F.posexplode("__v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    sums = {r["i"]: r["x"] for r in found}
    total = sum(sums.values())
    overall = [(sums.get(i, 0.0) + 1.0) / (total + k) for i in range(k)]

    def shares(parent: Column) -> Column:
        n = F.aggregate("__v", F.lit(0.0), lambda s, x: s + x)
        return bound(n, lambda m: F.zip_with("__v", parent, lambda x, p: (x + COARSER * p) / (m + COARSER)))

    known = hosts.filter("__h IS NOT NULL")
    whole = F.lit(overall)
    by_suffix = vector_sums(known.filter("__s IS NOT NULL"), "__s").select("__s", shares(whole).alias("__ps"))
    by_domain = vector_sums(known, "__d", "__s").join(by_suffix, "__s", "left")
    by_domain = by_domain.select("__d", shares(F.coalesce("__ps", whole)).alias("__pd"))
    by_host = known.join(by_domain, "__d", "left")
    return by_host.select("__h", shares(F.coalesce("__pd", whole)).alias("__ph")), overall


def identify(
    docs: DataFrame,
    text: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """Add ``language``, ``language_p`` and ``language_ok``.

    ``declared`` gives a language code (see ``declared_code`` and ``markup_language``), ``host`` a
    host name or any other name of a source.  Texts are scored once; the scores are stored.
    """
    own = [c for c in docs.columns if c not in ("language", "language_p", "language_ok") and (keep_text or c != text)]
    code = declared if declared is not None else F.lit(None).cast("string")
    model = train(docs, text, code)
    if model is None:
        return docs.select(
            *own,
            F.lit(None).cast("string").alias("language"),
            F.lit(None).cast("double").alias("language_p"),
            F.lit(True).alias("language_ok"),
        )
    names = model["languages"]
    k = len(names)
    h = F.lower(host) if host is not None else F.lit(None).cast("string")
    parts = F.split("__h", r"\.")
    scored = text_evidence(docs, model, text).withColumn("__c", code).withColumn("__h", F.when(h != "", h))
    scored = (
        scored.withColumn("__d", F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), F.lit(2)), "."))
        .withColumn("__s", F.when(F.size(parts) > 1, F.element_at(parts, -1)))
        .select(*own, "__text_ll", "__c", "__h", "__d", "__s")
    )
    scored = stored(scored)
    shares, overall = host_shares(scored, k)
    # The shares are stored, so the join is a broadcast where they are small and skew-split where not.
    fused = scored.join(stored(shares), "__h", "left")
    prior = F.coalesce("__ph", F.lit(overall))
    known = F.lit(names)

    def said(at: Column, i: Column, right: float) -> Column:
        """Log of the evidence for language ``i`` from a code that names the one at ``at`` (from 1; null or 0: none)."""
        wrong = (1 - right) / max(1, k - 1)
        named = F.when(i + 1 == at, F.lit(math.log(right))).otherwise(F.lit(math.log(wrong)))
        return F.when(at > 0, named).otherwise(F.lit(0.0))

    placed = fused.withColumns({"__ci": F.array_position(known, F.col("__c")), "__si": F.array_position(known, F.col("__s"))})
    logs = F.transform(
        F.zip_with("__text_ll", prior, lambda t, p: t + F.log(p)),
        lambda x, i: x + said(F.col("__ci"), i, DECLARED) + said(F.col("__si"), i, SUFFIX),
    )
    answered = placed.withColumn("__q", F.when(F.col("__text_ll").isNotNull(), normalised(logs)))
    best = F.array_max("__q")
    place = F.array_position("__q", best)
    return answered.select(
        *own,
        F.when(best.isNotNull(), F.element_at(known, place.cast("int"))).alias("language"),
        best.alias("language_p"),
        F.coalesce(best >= LEAST, F.lit(False)).alias("language_ok"),
    )


def of_documents(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Languages of documents: ``lang`` is the declaration, ``source`` the host."""
    return identify(docs, declared=declared_code(F.col("lang")), host=F.col("source"), keep_text=keep_text)


def language_report(docs: DataFrame) -> DataFrame:
    """Every document's declared language, language, probability and whether it is accepted."""
    found = of_documents(docs.select("doc_id", "text", "lang", "source"), keep_text=False)
    return found.select("doc_id", F.col("lang").alias("declared"), "language", "language_p", "language_ok")


def page_text(html: Column) -> Column:
    """A page's text: markup, comments, scripts and styles become blanks."""
    inner = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
    return F.regexp_replace(html, inner, " ")


def of_pages(pages: DataFrame, keep_text: bool = True) -> DataFrame:
    """Languages of pages by their text: the ``lang`` attribute is the declaration, the URL's host the host."""
    host, _ = host_and_path(F.col("url"))
    code = markup_language(F.col("html"))
    rows = pages.withColumns({"text": page_text(F.col("html")), "declared": code, "host": host})
    return identify(rows, declared=F.col("declared"), host=F.col("host"), keep_text=keep_text)


def corpus_report(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``language_report`` of all documents and the same of all pages, with the name of the table.

    Each table is judged by evidence of its own.  ``doc_id`` is null for pages, ``page_id`` for documents.
    """
    texts = language_report(docs).withColumns({"table": F.lit("documents"), "page_id": F.lit(None).cast("bigint")})
    found = of_pages(pages.select("page_id", "url", "html"), keep_text=False)
    markup = found.withColumns({"table": F.lit("pages"), "doc_id": F.lit(None).cast("bigint")})
    out = ["table", "doc_id", "page_id", "declared", "language", "language_p", "language_ok"]
    return texts.select(*out).unionByName(markup.select(*out))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with their columns."""
    used = ["text", "lang", "source"] + (["doc_id"] if "doc_id" in docs.columns else [])
    others = [c for c in docs.columns if c not in used]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    kept = of_documents(docs.select(*used, rest.alias("__rest"))).filter("language_ok")
    return kept.select(*[F.col(c) if c in used else F.col("__rest").getField(c).alias(c) for c in docs.columns])
