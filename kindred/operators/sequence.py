"""Sequence tiles: context lookup, composition, consensus editing and coding sequences.

A tile row is (chrom, tile, tile_start, seq): ``tile_bp`` bases from the 0-based
``tile_start`` plus one flanking base on each side, N beyond the chromosome ends.  A site
meets its tile by an equi-join on (chrom, tile), and no row holds a whole chromosome.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import bases as fb
from ..plans.lookup import lookup_join

TILE_BP = 32768


# --- packed tiles -----------------------------------------------------------------------

#: A word holds 31 bases in two bits each and repeats the last two of the word before, so any
#: three neighbours lie in one word; a mask word holds 62 bits likewise.
_STEP, _BASES, _MASK_STEP, _MASKED = 29, 31, 60, 62
_CODES = [x + y + z for x in "ACGT" for y in "ACGT" for z in "ACGT"]


def _words(digits: Column, size: Column, base: int, step: int, width: int) -> Column:
    """Overlapping words of a digit string as integers, in one pass over the string."""
    padded = F.rpad(digits, (F.call_function("div", size + step - 1, F.lit(step)) * step + width - step).cast("int"), F.lit("0"))
    chunks = F.regexp_extract_all(padded, F.lit(f"(?=(.{{1,{width}}})).{{1,{step}}}"), F.lit(1))
    return F.transform(chunks, lambda x: F.conv(x, base, 10).cast("bigint"))


def pack_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles as (chrom, tile, size, words, masks): two bits a base, and a bit where a base is none of ACGT.

    Integer arrays are read in place, so a look-up costs the same in a tile of any width; text
    has to be walked to a position, and binary columns are copied when they are read.  A tile
    without masked bases has an empty ``masks``.
    """
    seq = F.upper("seq")
    size = F.length("seq")
    plain = F.regexp_replace(seq, "[^ACGT]", "A")
    marks = F.translate(F.regexp_replace(seq, "[^ACGT]", "1"), "ACGT", "0000")
    return tiles.select(
        "chrom",
        "tile",
        size.alias("size"),
        _words(F.translate(plain, "ACGT", "0123"), size, 4, _STEP, _BASES).alias("words"),
        F.when(seq.rlike("[^ACGT]"), _words(marks, size, 2, _MASK_STEP, _MASKED))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("masks"),
    )


def _at(words: Column, offset: Column, step: int, width: int, bits: int, count: int) -> Column:
    """``count`` neighbours of ``bits`` bits from ``offset``, as one integer."""
    inside = F.pmod(offset, F.lit(step))
    word = F.get(words, F.call_function("div", offset, F.lit(step)).cast("int"))
    shift = (F.lit(width - count) - inside) * bits
    return F.call_function("shiftright", word, shift.cast("int")).bitwiseAND(F.lit((1 << bits * count) - 1))


def packed_context(offset: Column, size: Column, words: Column, masks: Column) -> Column:
    """The three bases from 0-based ``offset`` of a packed tile, N where a base is masked; NNN past its end."""
    code = _at(words, offset, _STEP, _BASES, 2, 3).cast("int")
    mask = F.when(F.size(masks) > 0, _at(masks, offset, _MASK_STEP, _MASKED, 1, 3)).otherwise(F.lit(0).cast("bigint"))
    plain = F.get(F.array(*[F.lit(c) for c in _CODES]), code)
    letters = [
        F.when(mask.bitwiseAND(F.lit(4 >> i)) != 0, "N").otherwise(F.substring(plain, i + 1, 1)) for i in range(3)
    ]
    inside = (offset >= 0) & (offset + 3 <= size)
    return F.when(~F.coalesce(inside, F.lit(False)), "NNN").when(mask == 0, plain).otherwise(F.concat(*letters))


# --- lookup ---------------------------------------------------------------------------


def sequence_lookup(sites: DataFrame, tiles: DataFrame, pos: str = "pos", tile_bp: int = TILE_BP) -> DataFrame:
    """Add the three-base ``context`` around a 1-based position (NNN where there is no tile).

    ``tiles`` are text tiles, or packed ones (store these once: ``pack_tiles``).  A site meets its
    tile by (chrom, tile) and takes its bases in constant time.  Give one row per site, such as
    the site-wide form of the calls, to look every position up once.  The join is told to sort:
    tiles made of short rows would pass for small and gather in the driver.
    """
    packed = tiles if "words" in tiles.columns else pack_tiles(tiles)
    pos0 = F.col(pos).cast("bigint") - 1
    tile = F.floor(pos0 / F.lit(tile_bp)).cast("bigint")
    keyed = sites.withColumn("__tile", tile)
    side = packed.select(
        F.col("chrom"), F.col("tile").alias("__tile"), *[F.col(c).alias(f"__{c}") for c in ("size", "words", "masks")]
    )
    joined = keyed.join(side.hint("merge"), ["chrom", "__tile"], "left")
    offset = pos0 - F.col("__tile") * tile_bp
    context = packed_context(offset, F.col("__size"), F.col("__words"), F.col("__masks"))
    return joined.withColumn("context", context).select(*sites.columns, "context")


def base_composition(sites: DataFrame, tiles: DataFrame, keys: list[str], tile_bp: int = TILE_BP) -> DataFrame:
    """Callable sites by base, in a CG dinucleotide and in a dipyrimidine."""
    return composition_counts(sequence_lookup(sites, tiles, tile_bp=tile_bp), keys)


def composition_counts(sites: DataFrame, keys: list[str]) -> DataFrame:
    """The counts of ``base_composition`` from rows that have their ``context``."""
    centre = F.substring("context", 2, 1)
    return (
        sites.filter(centre.rlike("[ACGT]"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_callable"),
            *[F.count_if(centre == b).alias(f"n_{b}") for b in "ATCG"],
            F.count_if(fb.is_cg_site("context")).alias("n_cg"),
            F.count_if(fb.is_cpd_site("context")).alias("n_cpd"),
        )
    )


def context_counts(
    sites: DataFrame,
    tiles: DataFrame,
    keys: list[str],
    lengths: DataFrame | None = None,
    tile_bp: int = TILE_BP,
) -> DataFrame:
    """Folded context counts; skipped sites appear under their reason instead of a context."""
    labelled = with_context_label(sites, tiles, lengths, tile_bp)
    return labelled.groupBy(*keys, "trinuc").agg(F.count("*").alias("n"))


def with_context_label(
    sites: DataFrame, tiles: DataFrame, lengths: DataFrame | None = None, tile_bp: int = TILE_BP
) -> DataFrame:
    """Add ``trinuc``: the folded context of a site, or why it has none.

    Sites whose REF is not one plain base are dropped.  Reasons, first match: ``edge`` (no
    flanking base; the chromosome end needs ``lengths``), ``non_acgt``, ``ref_mismatch``.
    """
    ctx = sequence_lookup(
        sites.filter(F.upper("ref").rlike("^[ACGT]$")), tiles, tile_bp=tile_bp
    )
    edge = F.col("pos") < 2
    if lengths is not None:
        ctx = lookup_join(ctx, lengths.select("chrom", F.col("length").alias("__length")), ["chrom"], "left")
        edge = edge | F.coalesce(F.col("pos") > F.col("__length") - 1, F.lit(False))
    label = (
        F.when(edge, "edge")
        .when(F.col("context").contains("N"), "non_acgt")
        .when(F.substring("context", 2, 1) != F.upper("ref"), "ref_mismatch")
        .otherwise(fb.fold_trinuc("context"))
    )
    return ctx.withColumn("trinuc", label).drop("context", "__length")


def region_composition(spans: DataFrame, tiles: DataFrame, keys: list[str], start="start", end="end", tile_bp: int = TILE_BP) -> DataFrame:
    """Base counts and CpG pairs over half-open spans.

    A pair counts when the C (``c_followed_by_g``) or the G (``g_preceded_by_c``) is inside
    the span; the partner may be the flanking base.
    """
    lo, hi = F.col(start), F.col(end)
    pieces = (
        spans.filter(hi > lo)
        .withColumn(
            "tile",
            F.explode(
                F.sequence(
                    F.floor(lo / F.lit(tile_bp)).cast("bigint"),
                    F.floor((hi - 1) / F.lit(tile_bp)).cast("bigint"),
                )
            ),
        )
        .withColumn("__lo", F.greatest(lo, F.col("tile") * tile_bp))
        .withColumn("__len", (F.least(hi, (F.col("tile") + 1) * tile_bp) - F.col("__lo")).cast("int"))
        .join(tiles.select("chrom", "tile", F.upper("seq").alias("__seq")), ["chrom", "tile"])
        .withColumn("__at", (F.col("__lo") - F.col("tile") * tile_bp + 2).cast("int"))
    )
    own = F.substring(F.col("__seq"), F.col("__at"), F.col("__len"))
    right = F.substring(F.col("__seq"), F.col("__at"), F.col("__len") + 1)
    left = F.substring(F.col("__seq"), F.col("__at") - 1, F.col("__len") + 1)

    def occurrences(text: Column, word: str) -> Column:
        return (
            (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)
        ).cast("bigint")

    total = F.sum(F.length(own).cast("bigint"))
    counts = pieces.groupBy(*keys).agg(
        total.alias("total_bases"),
        *[F.sum(occurrences(own, b)).alias(f"n_{b}") for b in "ATCG"],
        F.sum(occurrences(right, "CG")).alias("c_followed_by_g"),
        F.sum(occurrences(left, "CG")).alias("g_preceded_by_c"),
    )
    pairs = F.col("c_followed_by_g") + F.col("g_preceded_by_c")
    return counts.select(
        "*",
        pairs.alias("cg_total"),
        *[(F.col(f"n_{b}") / F.col("total_bases")).alias(f"frac_{b}") for b in "ATCG"],
        F.when(F.col("total_bases") > 1, pairs / (F.col("total_bases") - 1)).otherwise(F.lit(0.0)).alias("frac_cg"),
    )


def read_context_counts(reads: DataFrame, keys: list[str], trim: int = 1500, seq: str = "seq") -> DataFrame:
    """Folded contexts of read bases with 0-based centre in [trim, length - trim).

    Exploding reads would make a row per base.  Each task instead counts the 64 raw contexts
    of a batch with NumPy and emits one row per key and context; folding and the final sum
    are Spark aggregations of those partial counts.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.select(*keys).schema)
    edge = max(trim, 1)
    words = np.array([x + y + z for x in "ACGT" for y in "ACGT" for z in "ACGT"])

    def count(batches):
        for batch in batches:
            group = batch.groupby(keys, sort=False, dropna=False)
            ids_ = group.ngroup().to_numpy()
            heads = batch.loc[~pd.Series(ids_).duplicated().to_numpy(), keys].reset_index(drop=True)
            totals = np.zeros(len(heads) * 64, dtype=np.int64)
            for lo, hi in _byte_blocks(batch[seq]):
                totals += _context_counts(batch[seq].iloc[lo:hi], ids_[lo:hi], edge, len(heads))
            row, word = np.nonzero(totals.reshape(-1, 64))
            out = heads.iloc[row].reset_index(drop=True)
            out["__raw"] = words[word]
            out["__n"] = totals.reshape(-1, 64)[row, word]
            yield out

    raw = reads.filter(F.col(seq).isNotNull()).select(*keys, seq).mapInPandas(
        count, f"{schema}, __raw string, __n bigint"
    )
    return (
        raw.groupBy(*keys, "__raw")
        .agg(F.sum("__n").alias("__n"))
        .groupBy(*keys, fb.fold_trinuc("__raw").alias("trinuc"))
        .agg(F.sum("__n").alias("n"))
    )


def _byte_blocks(seqs: pd.Series, limit: int = 4_000_000):
    """Row ranges of about ``limit`` bases, so working arrays stay small for long reads."""
    ends = seqs.str.len().cumsum().to_numpy()
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def _context_counts(seqs: pd.Series, ids_: np.ndarray, edge: int, n_groups: int) -> np.ndarray:
    """Counts of (group, raw context) for a block of reads laid end to end."""
    code = np.full(256, 4, dtype=np.int64)
    for i, letter in enumerate("ACGT"):
        code[ord(letter)] = code[ord(letter.lower())] = i
    size = seqs.str.len().to_numpy()
    base = code[np.frombuffer("".join(seqs).encode("latin-1", "replace"), dtype=np.uint8)]
    at = np.arange(len(base)) - np.repeat(np.cumsum(size) - size, size)
    centre = np.nonzero((at >= edge) & (at < np.repeat(size, size) - edge))[0]
    left, mid, right = base[centre - 1], base[centre], base[centre + 1]
    plain = (left < 4) & (mid < 4) & (right < 4)
    word = np.repeat(ids_, size)[centre] * 64 + left * 16 + mid * 4 + right
    return np.bincount(word[plain], minlength=n_groups * 64)


# --- editing ---------------------------------------------------------------------------

_BATCH_BASES = 1 << 22


def _tiles_near(pos0: Column, tile_bp: int) -> Column:
    """Tiles that show a 0-based position as an own or a flanking base."""
    at = lambda p: F.floor(p / F.lit(tile_bp)).cast("bigint")
    return F.array_distinct(F.array(at(pos0 - 1), at(pos0), at(pos0 + 1)))


def seq_consensus(tiles: DataFrame, selected: DataFrame, mask: DataFrame, start="start", end="end", tile_bp: int = TILE_BP) -> DataFrame:
    """Put ALT at selected sites, then N over half-open mask spans; other tiles pass through.

    Edits are grouped per tile: at most one per base after de-duplication (longer ALTs are left
    out), and mask spans are clipped to the tile first.  A tile is rewritten in one pass.  Tiles are
    long, so the session's Arrow batches are lowered to about ``_BATCH_BASES`` bases.
    """
    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", max(_BATCH_BASES // tile_bp, 1)
    spark = tiles.sparkSession
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    pos0 = F.col("pos") - 1
    edits = (
        selected.select("chrom", "pos", "alt")
        .filter(F.length("alt") == 1)
        .groupBy("chrom", "pos")
        .agg(F.min("alt").alias("alt"))
        .select("chrom", F.explode(_tiles_near(pos0, tile_bp)).alias("tile"), pos0.alias("p"), "alt")
        .groupBy("chrom", "tile")
        .agg(
            F.collect_list(
                F.struct((F.col("p") - F.col("tile") * tile_bp + 2).cast("int").alias("at"), "alt")
            ).alias("edits")
        )
    )
    lo, hi = F.col(start), F.col(end)
    masked = (
        mask.filter(hi > lo)
        .select(
            "chrom",
            start,
            end,
            F.explode(
                F.sequence(
                    F.floor((lo - 1) / F.lit(tile_bp)).cast("bigint"),
                    F.floor(hi / F.lit(tile_bp)).cast("bigint"),
                )
            ).alias("tile"),
        )
        .select(
            "chrom",
            "tile",
            F.greatest(lo - F.col("tile") * tile_bp + 2, F.lit(1)).cast("int").alias("at"),
            F.least(hi - F.col("tile") * tile_bp + 2, F.lit(tile_bp + 3)).cast("int").alias("to"),
        )
        .filter("to > at")
        .groupBy("chrom", "tile", "at")
        .agg(F.max("to").alias("to"))
        .groupBy("chrom", "tile")
        .agg(F.collect_list(F.struct("at", "to")).alias("masks"))
    )
    joined = tiles.join(edits, ["chrom", "tile"], "left").join(masked, ["chrom", "tile"], "left")
    edited = _edited(F.col("seq"), F.col("edits.at"), F.col("edits.alt"), F.col("masks.at"), F.col("masks.to"))
    changed = F.col("edits").isNotNull() | F.col("masks").isNotNull()
    return joined.withColumn("seq", F.when(changed, edited).otherwise(F.col("seq"))).drop("edits", "masks")


@F.pandas_udf(StringType())
def _edited(seq: pd.Series, at: pd.Series, alt: pd.Series, hide_from: pd.Series, hide_to: pd.Series) -> pd.Series:
    """Text with single letters put at 1-based places, then N over [from, to); linear in the text and the edits."""
    out = []
    for text, places, letters, lows, highs in zip(seq, at, alt, hide_from, hide_to):
        if text is None:
            out.append(None)
            continue
        raw = np.frombuffer(text.encode(), np.uint8).copy()
        if places is not None and len(places):
            raw[np.asarray(places, np.int64) - 1] = np.frombuffer("".join(letters).encode(), np.uint8)
        if lows is not None and len(lows):
            depth = np.zeros(len(raw) + 1, np.int64)
            np.add.at(depth, np.minimum(np.asarray(lows, np.int64) - 1, len(raw)), 1)
            np.add.at(depth, np.minimum(np.asarray(highs, np.int64) - 1, len(raw)), -1)
            raw[np.cumsum(depth)[:-1] > 0] = ord("N")
        out.append(raw.tobytes().decode())
    return pd.Series(out, dtype=object)


def tiles_to_pieces(tiles: DataFrame) -> DataFrame:
    """(chrom, pos0, seq) with the flanking bases removed."""
    return tiles.select(
        "chrom", F.col("tile_start").alias("pos0"), F.expr("substr(seq, 2, length(seq) - 2)").alias("seq")
    )


def pieces_to_tiles(pieces: DataFrame, tile_bp: int = TILE_BP) -> DataFrame:
    """Tiles with flanks from disjoint pieces (chrom, pos0, seq)."""
    end = F.col("pos0") + F.length("seq")
    cut = (
        pieces.filter(F.length("seq") > 0)
        .withColumn(
            "tile",
            F.explode(
                F.sequence(
                    F.floor(F.col("pos0") / F.lit(tile_bp)).cast("bigint"),
                    F.floor((end - 1) / F.lit(tile_bp)).cast("bigint"),
                )
            ),
        )
        .withColumn("__lo", F.greatest("pos0", F.col("tile") * tile_bp))
        .withColumn("__hi", F.least(end, (F.col("tile") + 1) * tile_bp))
        .select(
            "chrom",
            "tile",
            "__lo",
            F.substring(
                F.col("seq"),
                (F.col("__lo") - F.col("pos0") + 1).cast("int"),
                (F.col("__hi") - F.col("__lo")).cast("int"),
            ).alias("part"),
        )
    )
    own = cut.groupBy("chrom", "tile").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("__lo", "part"))), lambda p: p["part"]), ""
        ).alias("own")
    )
    shown = own.select(
        "chrom",
        F.explode(
            F.array(
                F.struct((F.col("tile") - 1).alias("tile"), F.lit(2).alias("slot"), F.substring("own", 1, 1).alias("s")),
                F.struct(F.col("tile").alias("tile"), F.lit(1).alias("slot"), F.col("own").alias("s")),
                F.struct((F.col("tile") + 1).alias("tile"), F.lit(0).alias("slot"), F.substring("own", -1, 1).alias("s")),
            )
        ).alias("x"),
    ).select("chrom", "x.*")
    return (
        shown.groupBy("chrom", "tile")
        .agg(
            F.max(F.when(F.col("slot") == 0, F.col("s"))).alias("l"),
            F.max(F.when(F.col("slot") == 1, F.col("s"))).alias("own"),
            F.max(F.when(F.col("slot") == 2, F.col("s"))).alias("r"),
        )
        .filter("own IS NOT NULL")
        .select(
            "chrom",
            "tile",
            (F.col("tile") * tile_bp).alias("tile_start"),
            F.concat(F.coalesce("l", F.lit("N")), F.col("own"), F.coalesce("r", F.lit("N"))).alias("seq"),
        )
    )


def cut_range(tiles: DataFrame, cuts: DataFrame, tile_bp: int = TILE_BP) -> DataFrame:
    """Remove the closed 1-based range start..stop of the listed chromosomes; later bases move up."""
    p = tiles_to_pieces(tiles).join(cuts.select("chrom", "start", "stop"), "chrom", "left")
    end = F.col("pos0") + F.length("seq")
    head = F.greatest(F.least(end, F.col("start") - 1) - F.col("pos0"), F.lit(0)).cast("int")
    tail_from = F.greatest(F.col("pos0"), F.col("stop"))
    tail = F.greatest(end - tail_from, F.lit(0)).cast("int")
    removed = F.col("stop") - F.col("start") + 1
    parts = F.when(
        F.col("start").isNull(), F.array(F.struct(F.col("pos0").alias("p"), F.col("seq").alias("s")))
    ).otherwise(
        F.array(
            F.struct(F.col("pos0").alias("p"), F.substring(F.col("seq"), F.lit(1), head).alias("s")),
            F.struct(
                (tail_from - removed).alias("p"),
                F.when(tail > 0, F.substring(F.col("seq"), F.length("seq") - tail + 1, tail)).otherwise("").alias("s"),
            ),
        )
    )
    pieces = p.select("chrom", F.explode(parts).alias("x")).select(
        "chrom", F.col("x.p").alias("pos0"), F.col("x.s").alias("seq")
    )
    return pieces_to_tiles(pieces, tile_bp)


def rename_and_flip(tiles: DataFrame, lengths: DataFrame, plan: DataFrame, tile_bp: int = TILE_BP) -> DataFrame:
    """Rename chromosomes and reverse-complement those with ``flip``; others are kept."""
    p = (
        tiles_to_pieces(tiles)
        .join(plan.select("chrom", "new_name", "flip"), "chrom", "left")
        .join(lengths.select("chrom", "length"), "chrom", "left")
    )
    flip = F.coalesce("flip", F.lit(False))
    pieces = p.select(
        F.coalesce("new_name", "chrom").alias("chrom"),
        F.when(flip, F.col("length") - F.col("pos0") - F.length("seq")).otherwise(F.col("pos0")).alias("pos0"),
        F.when(flip, fb.revcomp("seq")).otherwise(F.col("seq")).alias("seq"),
    )
    return pieces_to_tiles(pieces, tile_bp)


# --- coding sequence ---------------------------------------------------------------------


def longest_isoform(cds: DataFrame) -> DataFrame:
    """Transcript with the longest total CDS per gene; the first in file order wins a tie.

    ``cds``: gene, mrna, chrom, strand, start, stop (1-based closed), file_order.
    """
    totals = cds.groupBy("gene", "mrna").agg(
        F.sum(F.col("stop") - F.col("start") + 1).alias("cds_length"),
        F.min("file_order").alias("__first"),
    )
    best = totals.groupBy("gene").agg(
        F.max_by(F.struct("mrna", "cds_length"), F.struct("cds_length", -F.col("__first"))).alias("b")
    )
    return best.select("gene", "b.mrna", "b.cds_length")


def cds_sequence(cds: DataFrame, tiles: DataFrame, keys: list[str] = ("gene", "mrna"), tile_bp: int = TILE_BP) -> DataFrame:
    """Ordered CDS parts of a transcript, reverse-complemented on '-', non-ACGT as N.

    Parts are cut at tile edges, so each fetches from one tile; a group is the exons of one
    transcript.  Tiles are long texts, often spelled out of short rows, so the join is told to sort:
    a broadcast would gather the genome.
    """
    pos0 = F.col("start") - 1
    cut = (
        cds.withColumn(
            "tile",
            F.explode(
                F.sequence(
                    F.floor(pos0 / F.lit(tile_bp)).cast("bigint"),
                    F.floor((F.col("stop") - 1) / F.lit(tile_bp)).cast("bigint"),
                )
            ),
        )
        .withColumn("__lo", F.greatest(pos0, F.col("tile") * tile_bp))
        .withColumn("__len", (F.least(F.col("stop"), (F.col("tile") + 1) * tile_bp) - F.col("__lo")).cast("int"))
        .join(tiles.select("chrom", "tile", F.col("seq").alias("__seq")).hint("merge"), ["chrom", "tile"])
        .withColumn(
            "__part",
            F.substring(F.col("__seq"), (F.col("__lo") - F.col("tile") * tile_bp + 2).cast("int"), F.col("__len")),
        )
    )
    joined = cut.groupBy(*keys, "chrom", "strand").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("__lo", "__part"))), lambda p: p["__part"]), ""
        ).alias("__s")
    )
    clean = fb.clean_sequence("__s")
    return joined.withColumn(
        "cds", F.when(F.col("strand") == "-", fb.revcomp(clean)).otherwise(clean)
    ).drop("__s")


def cds_qc(genes: DataFrame, ref: str, others: list[str], min_coverage: float = 0.8) -> DataFrame:
    """First failing check of a gene: length, premature stop in the reference, N fractions."""
    reason = F.when(F.length(ref) % 3 != 0, "length_not_divisible_by_3").when(
        fb.has_premature_stop(ref), f"premature_stop_in_{ref}"
    )
    for name in [ref, *others]:
        reason = reason.when(fb.n_fraction(name) > 1 - min_coverage, f"{name}_low_coverage")
    return genes.withColumn("reason", reason.otherwise("PASS"))


def codon_rows(aln: DataFrame, gene: str = "gene", species: str = "species", seq: str = "seq") -> DataFrame:
    """(gene, species, codon_no, codon); a trailing partial codon is left out."""
    return aln.select(gene, species, F.posexplode(fb.codons(F.upper(seq))).alias("codon_no", "codon"))


def codon_callable_filter(aln: DataFrame, n_species: int, gene: str = "gene", species: str = "species", seq: str = "seq") -> DataFrame:
    """Codons of which every species has three plain bases, as (gene, species, codon_no, codon).

    One shuffle on (gene, codon_no): the group holds one row per species.
    """
    rows = codon_rows(aln, gene, species, seq)
    per = rows.groupBy(gene, "codon_no").agg(
        F.bool_and(F.col("codon").rlike("^[ACGT]{3}$")).alias("__ok"),
        F.count("*").alias("__n"),
        F.collect_list(F.struct(species, "codon")).alias("__c"),
    )
    return (
        per.filter(F.col("__ok") & (F.col("__n") == n_species))
        .select(gene, "codon_no", F.explode("__c").alias("x"))
        .select(gene, f"x.{species}", "codon_no", "x.codon")
    )


def concat_genes(aln: DataFrame, gene_list: DataFrame, gene: str = "gene") -> DataFrame:
    """Alignment rows in list order; a gene listed twice appears twice.

    ``gene_list``: slot, gene.  Rows stay exploded; sort by (species, slot) when writing.
    """
    return gene_list.join(aln, gene)


def gene_chrom_split(genes: DataFrame, locations: DataFrame, autosomes: list[str], x_prefixes: list[str]) -> DataFrame:
    """Route genes to auto, X or other by chromosome; genes without a location are unknown."""
    chrom = F.coalesce("chrom", F.lit("unknown"))
    is_x = F.lit(False)
    for p in x_prefixes:
        is_x = is_x | chrom.startswith(p)
    return genes.join(locations, "gene", "left").select(
        *genes.columns,
        chrom.alias("chrom"),
        F.when(chrom.isin(*autosomes), "auto").when(is_x, "X").otherwise("other").alias("route"),
    )
