"""Secrets in texts: fixed patterns, and a randomness test battery over long tokens.

Patterns find assignments, access keys and long hexadecimal strings.  In addition every run of
20 or more characters of the base64 alphabets outside those spans is a candidate.  Its encoding
is inferred (hex, base32 or base64) and three tests ask how far it is from written text towards
a uniform random string: chi-squared uniformity over the encoding's alphabet, the runs of
character classes, and the serial correlation of neighbouring classes.  The three are summed.
They are not independent, and neither their means nor their spreads stay the same with the
length, so the sum is set against its own distribution under a model of written text: ``TAILS``
has, per encoding and length, the shift and scale with which its upper tail is that of a standard
normal.  The Benjamini-Hochberg rule at rate ``q`` runs over all candidates of a length
band (powers of two), from a histogram of p values: a table of bounded size, whatever the input.

Offsets count code points from 0, ends are exclusive.  Null and empty texts have no spans.  Rows
are independent except through the thresholds; repeated rows repeat their result, no rows give
no rows, and further columns pass through (a column named like an added one is replaced).
Built-in functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import stored

# Fixed values of the base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short fails from any of its positions, so the least length stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the battery.
# A run that is too short fails once, at its start, and not from each of its positions.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Every match of these patterns holds one of the strings (assignments in lower case): most texts have none.
HOLDS = {"assign": ("passw", "secret", "token", "api"), "access": ("AKIA",)}
RATE = 0.001
#: p values are counted in steps of a twentieth of a decade, down to 1e-15.
STEPS, DEEPEST = 20, 15
#: Matches whose lengths are summed at once when offsets are made.
RUN = 128

HEX_SET = "0123456789abcdef"
BASE32_SET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64_SET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


# Fixed values: (length, shift, scale) of the summed tests under the model of written text, such
# that (sum - shift) / scale is above 2.054 in 2 % and above 2.878 in 0.2 % of its tokens.  The
# model: letters by English frequencies, digits evenly, a class is left with probability 0.1 a
# step (a separator at once).  tests/llm draws tokens from it and holds the rates against it.
TAILS = {
    "hex": [
        (20, -0.06, 1.35), (24, 0.05, 1.31), (32, 0.16, 1.32), (48, 0.47, 1.33), (64, 0.94, 1.33),
        (96, 2.09, 1.29), (128, 3.17, 1.33), (160, 4.32, 1.33), (200, 6.05, 1.33), (256, 8.07, 1.36),
        (320, 10.85, 1.36), (400, 13.63, 1.42), (512, 18.61, 1.42), (640, 23.97, 1.48), (800, 30.7, 1.5),
        (1024, 40.08, 1.6),
    ],
    "base32": [
        (20, -0.39, 1.3), (24, -0.4, 1.28), (32, -0.64, 1.32), (48, -0.97, 1.34), (64, -1.24, 1.34),
        (96, -1.42, 1.29), (128, -1.66, 1.27), (256, -2.0, 1.18), (512, -2.95, 1.2), (724, -3.8, 1.25),
        (1024, -4.78, 1.3),
    ],
    "base64": [
        (20, 0.38, 1.36), (24, 0.25, 1.42), (32, 0.12, 1.48), (48, 0.23, 1.43), (64, 0.33, 1.38),
        (96, 0.56, 1.31), (128, 0.74, 1.3), (256, 1.39, 1.25), (512, 2.09, 1.26), (724, 2.74, 1.2),
        (1024, 3.35, 1.18),
    ],
}


def between(n: Column, rows: list[tuple[int, float]], beyond: Column) -> Column:
    """A value of a table between its lengths, linear in the logarithm of the length."""
    out = beyond
    for (x, a), (y, c) in reversed(list(zip(rows, rows[1:]))):
        part = (F.ln(n) - math.log(x)) / (math.log(y) - math.log(x))
        out = F.when(n <= y, a + (c - a) * part).otherwise(out)
    return out


def shift_and_scale(n: Column, rows: list[tuple[int, float, float]], power: float) -> tuple[Column, Column]:
    """Beyond the table the shift goes on with a power of the length, and the scale stays."""
    (x, a, _), (y, c, d) = rows[-2:]
    onwards = c + (c - a) / (y**power - x**power) * (F.pow(n, F.lit(power)) - y**power)
    return between(n, [r[:2] for r in rows], onwards), between(n, [(r[0], r[2]) for r in rows], F.lit(d))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def offsets(gaps: Column, matches: Column) -> Column:
    """Start of every match, given the texts between the matches: running sums in two levels.

    A function's body runs for every element, with all that stands in it: arrays it looks into are bound.
    """
    n = F.size(matches)

    def placed(gaps: Column, each: Column, upto: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.get(upto, F.floor(i / RUN).cast("int"))
            + total(F.slice(each, (F.floor(i / RUN) * RUN + 1).cast("int"), (i % RUN).cast("int")))
            + F.char_length(F.get(gaps, i)),
        )

    def summed(gaps: Column, each: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), n - 1, F.lit(RUN)), lambda i: total(F.slice(each, i + 1, F.lit(RUN))))
        upto = F.aggregate(
            runs,
            F.array(F.lit(0).cast("bigint")),
            lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)),
        )
        return bound(upto, lambda upto: placed(gaps, each, upto))

    def measured(gaps: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: (F.char_length(F.get(gaps, i)) + F.char_length(F.get(matches, i))).cast("bigint"),
        )
        return bound(each, lambda each: summed(gaps, each))

    return bound(gaps, measured)


def with_matches(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Add, per pattern, the matched strings and (in ``__at_<name>``) where they start."""
    def holds(name: str) -> Column:
        def any_of(text: Column) -> Column:
            return reduce(or_, [F.contains(text, F.lit(x)) for x in HOLDS[name]])

        return bound(F.lower("__text"), any_of) if name == "assign" else any_of(F.col("__text"))

    def matched(name: str, pattern: str) -> Column:
        all_of = F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))
        return F.when(holds(name), all_of).otherwise(F.array().cast("array<string>")) if name in HOLDS else all_of

    found = docs.select("*", *[matched(k, p).alias(f"__m_{k}") for k, p in patterns.items()])
    none = F.array().cast("array<bigint>")
    return found.select(
        "*",
        *[
            F.when(
                F.size(f"__m_{k}") > 0, offsets(F.split("__text", p, -1), F.col(f"__m_{k}"))
            ).otherwise(none).alias(f"__at_{k}")
            for k, p in patterns.items()
        ],
    )


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of the standard normal (rational approximation, absolute error under 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


#: Encodings that a token is taken for, in this order.
ENCODINGS = ("hex", "base32", "base64")


def battery(token: Column) -> Column:
    """Combined z value of a token: high where it looks random, about 0 or less for written text."""
    encoding = (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 0).when(token.rlike("^[A-Z2-7]+$"), 1).otherwise(2)
    )
    return bound(encoding, lambda e: _battery(token, e))


def _battery(token: Column, encoding: Column) -> Column:
    n = F.char_length(token).cast("double")
    lower = F.lower(token)
    is_hex, is_base32 = encoding == 0, encoding == 1
    url_safe = F.translate(token, "-_", "+/")

    def squares(text: Column, alphabet: str) -> Column:
        def counts(text: Column) -> Column:
            return F.transform(F.array(*map(F.lit, alphabet)), lambda a: n - F.char_length(F.replace(text, a, F.lit(""))))

        return F.aggregate(bound(text, counts), F.lit(0.0), lambda s, c: s + c * c)

    k = F.when(is_hex, 16.0).when(is_base32, 32.0).otherwise(64.0)
    sum_squares = (
        F.when(is_hex, squares(lower, HEX_SET))
        .when(is_base32, squares(token, BASE32_SET))
        .otherwise(squares(url_safe, BASE64_SET))
    )
    # Written text: letters meet with probability 0.065, decimal digits with 0.1.
    meet = F.when(is_hex, 0.1).otherwise(0.065)
    third = F.when(is_hex, 0.0).otherwise(0.0016)
    chi = k / n * sum_squares - n
    chi_mean = k * (1 - meet) + n * (k * meet - 1)
    chi_spread = k / n * F.sqrt(4 * n * n * n * third + 2 * n * n * meet)
    uniform = (chi_mean - chi) / chi_spread

    # Classes: 0 lower case, 1 digit, 2 upper case, 3 other; of hex only letters and digits.
    marked = F.regexp_replace(F.translate(token, "0123456789", "1" * 10), "[A-Z]", "2")
    classes = F.when(is_hex, F.regexp_replace(F.translate(lower, "0123456789", "1" * 10), "[a-f]", "0")).otherwise(
        F.translate(marked, "abcdefghijklmnopqrstuvwxyz+/_-", "0" * 26 + "3333")
    )

    def along(kind: Column) -> Column:
        changes = n - 1 - F.regexp_count(kind, F.lit(r"(.)(?=\1)"))
        runs = (changes - 0.1 * (n - 1)) / F.sqrt(0.09 * (n - 1))
        # Lower case against the rest; in hex and base32 digits against letters.  Of marks that
        # are 0 or 1 the correlation follows from how many and how many pairs are 1.
        digits = encoding < 2
        one = F.when(digits, "1").otherwise("0")
        pairs = F.when(digits, F.regexp_count(kind, F.lit("1(?=1)"))).otherwise(F.regexp_count(kind, F.lit("0(?=0)")))
        m = n - F.char_length(F.replace(kind, one, F.lit("")))
        ends = (F.substring(kind, 1, 1) == one).cast("double") + (F.substring(kind, -1, 1) == one).cast("double")
        share = m / n
        around = m * (1 - share)
        together = pairs - share * (2 * m - ends) + (n - 1) * share * share
        serial = F.when(around > 0, together / around).otherwise(1.0)
        loose = (0.5 - serial) * F.sqrt(n - 1) / 0.8660254037844386
        return (uniform + runs + loose) / 1.7320508075688772

    summed = bound(classes, along)
    # Hexadecimal text is less even than the model's mean says, which shows in proportion to the length.
    tables = [shift_and_scale(n, TAILS[name], 1.0 if name == "hex" else 0.5) for name in ENCODINGS]
    shift, scale = (
        F.when(is_hex, hex_).when(is_base32, base32).otherwise(base64) for hex_, base32, base64 in zip(*tables)
    )
    return (summed - shift) / scale


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``candidates`` (start, end, length band, step of the p value)."""
    whole = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    found = with_matches(whole, {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN})
    values = F.when(F.size("__m_assign") > 0, F.regexp_extract_all("__text", F.lit(ASSIGN), F.lit(2))).otherwise(
        F.array().cast("array<string>")
    )
    found = found.withColumn("__values", values)

    def spans(name: str, third: Callable[[Column], Column]) -> Column:
        def at(starts: Column) -> Column:
            return F.transform(
                f"__m_{name}",
                lambda m, i: F.struct(
                    F.get(starts, i).alias("start"), (F.get(starts, i) + F.char_length(m)).alias("end"), third(m)
                ),
            )

        return bound(F.col(f"__at_{name}"), at)

    def kind(k: int) -> Callable[[Column], Column]:
        return lambda m: F.lit(k).alias("kind")

    long_enough = bound(
        F.col("__values"),
        lambda values: F.filter(spans("assign", kind(0)), lambda s, i: F.char_length(F.get(values, i)) >= LEAST_VALUE),
    )
    base = found.withColumn("base_spans", in_order(F.concat(long_enough, spans("access", kind(1)), spans("hex", kind(2)))))
    tokens = spans("token", lambda m: m.alias("token"))
    free = bound(in_runs(F.col("base_spans")), lambda runs: F.filter(tokens, lambda t: ~meets(runs, t)))
    outside = base.withColumn("__free", free)
    tested = F.transform(
        "__free",
        lambda t: F.struct(
            t["start"].alias("start"),
            t["end"].alias("end"),
            F.floor(F.log2((t["end"] - t["start"]).cast("double"))).cast("int").alias("band"),
            battery(t["token"]).alias("z"),
        ),
    )
    scored = outside.withColumn("__tested", tested)
    steps = F.transform(
        "__tested",
        lambda t: F.struct(
            t["start"].alias("start"),
            t["end"].alias("end"),
            t["band"].alias("band"),
            F.floor(-F.log10(F.greatest(upper_tail(t["z"]), F.lit(10.0**-DEEPEST))) * STEPS).cast("int").alias("step"),
        ),
    )
    own = [c for c in docs.columns if c not in ("base_spans", "candidates")]
    return scored.withColumn("candidates", steps).select(*own, "base_spans", "candidates")


def in_runs(spans: Column) -> Column:
    """Sorted spans in runs of RUN, each with its first start and last end."""
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.size(spans), F.lit(RUN)), lambda i: i < F.size(spans)),
        lambda i: bound(
            F.slice(spans, i + 1, F.lit(RUN)),
            lambda run: F.struct(
                F.get(run, F.lit(0))["start"].alias("start"),
                F.array_max(F.transform(run, lambda s: s["end"])).alias("end"),
                run.alias("spans"),
            ),
        ),
    )


def meets(runs: Column, t: Column) -> Column:
    """Whether a span of the runs overlaps ``t``; only runs that overlap it are looked into."""

    def overlaps(s: Column) -> Column:
        return (s["start"] < t["end"]) & (t["start"] < s["end"])

    return F.exists(runs, lambda r: overlaps(r) & F.exists(r["spans"], overlaps))


def in_order(spans: Column) -> Column:
    """Spans by start, then kind."""
    turned = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    )
    return F.transform(
        F.array_sort(turned),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )


def thresholds(scanned: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Least p-value step that the Benjamini-Hochberg rule accepts, per length band with any."""
    each = scanned.select(F.explode("candidates").alias("c")).groupBy("c.band", "c.step").agg(F.count("*").alias("n"))
    whole = W.partitionBy("band")
    down = whole.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    ranked = each.select("band", "step", F.sum("n").over(down).alias("r"), F.sum("n").over(whole).alias("m"))
    good = ranked.filter(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("r") / F.col("m"))
    rows = good.groupBy("band").agg(F.min("step").alias("step")).collect()  # 31 bands at most
    return {r["band"]: r["step"] for r in rows}


def accept(scanned: DataFrame, least: dict[int, int]) -> DataFrame:
    """Replace ``candidates`` by ``spans``: the base spans and the accepted candidates, in order."""

    def ok(c: Column) -> Column:
        test = F.lit(False)
        for band, step in sorted(least.items()):
            test = test | ((c["band"] == band) & (c["step"] >= step))
        return test

    more = F.transform(
        F.filter("candidates", ok),
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(KINDS.index("random")).alias("kind")),
    )
    return scanned.withColumn("spans", in_order(F.concat("base_spans", more))).drop("candidates")


def find_secrets(docs: DataFrame, text: str = "text", keep_text: bool = True, rate: float = RATE) -> DataFrame:
    """Add ``base_spans`` and ``spans``; texts are scanned once, and the scan is stored in the shared folder."""
    scanned = scan(docs, text)
    scanned = stored(scanned if keep_text else scanned.drop(text))
    return accept(scanned, thresholds(scanned, rate))


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def redact(docs: DataFrame, text: str = "text", rate: float = RATE, mark: str = "[secret]") -> DataFrame:
    """The documents with every span's text replaced by ``mark``; touching or overlapping spans become one."""
    others = [c for c in docs.columns if c != text]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    found = find_secrets(docs.select(rest.alias("__rest"), F.col(f"`{text}`").alias("__text")), "__text", rate=rate)
    own = F.col("__text")
    joined = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    merged = found.withColumn("__joined", F.when(F.size("spans") > 0, joined))
    last = F.element_at("__joined", -1)["end"]
    pieces = F.transform(
        "__joined",
        lambda s, i: F.concat(
            F.substring(
                own,
                (F.when(i > 0, F.get("__joined", i - 1)["end"]).otherwise(0) + 1).cast("int"),
                (s["start"] - F.when(i > 0, F.get("__joined", i - 1)["end"]).otherwise(0)).cast("int"),
            ),
            F.lit(mark),
        ),
    )
    rest = F.substring(own, (last + 1).cast("int"), F.char_length(own))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(own)
    back = [clean.alias(c) if c == text else F.col("__rest").getField(c).alias(c) for c in docs.columns]
    return merged.select(*back)


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, SHA-256 of the base spans' list, and the list of all spans."""
    found = find_secrets(docs.select("doc_id", "text"), keep_text=False)
    return found.select(
        "doc_id",
        count_of("base_spans", "assign").alias("n_assign"),
        count_of("base_spans", "access").alias("n_access"),
        count_of("base_spans", "hex").alias("n_hex"),
        F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
