"""Secrets: known shapes, and runs of characters that a battery of tests finds random."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

# The shapes of the base kinds, in the order that breaks ties of position.
KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN_TAIL = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 6

#: Runs that the battery judges, and the share of false finds it allows among its finds.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
FALSE_SHARE = 0.01
FALSE_REJECTED = 0.01  # share of random runs among those that the battery rejects
LEAST_RUN = 20
_MOST_NATS = 200
_CELL = 256  # code points; runs and base spans meet by the cells they lie in

# Relative frequency of letters a to z in ordinary text, in percent.
LETTER_PERCENT = (
    8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4,
    6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074,
)
# Shares of the character classes in long runs of ordinary text.
CLASS_SHARE = {"letter": 0.9, "other_case": 0.05, "digit": 0.03, "mark": 0.02}

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_DIGITS = "0123456789"
# Encodings, the narrowest first: the first whose alphabet holds the whole run is inferred.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("hex_upper", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _UPPER),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("base36_upper", _DIGITS + _UPPER),
    ("letters", _UPPER + _LOWER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64_url", _UPPER + _LOWER + _DIGITS + "-_"),
    ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_"),
)


def _either_case(pattern: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern)


ASSIGN = f"({_either_case(KEYWORDS)}){ASSIGN_TAIL}"

_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def _found(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points, end exclusive. The text
    between matches and the matches alternate, so lengths add up to positions."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
    )

    def add(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        span = F.struct(
            start.alias("start"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            part["match"].alias("text"),
        )
        wanted = part["match"].isNotNull()
        if keep is not None:
            wanted = wanted & keep(part["match"])
        spans = F.when(wanted, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(F.coalesce(end, start).alias("at"), spans.alias("spans"))

    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    scanned = F.aggregate(parts, start, add, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), scanned).otherwise(none)


def _assigned(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= LEAST_ASSIGNED


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z, by the logistic form with a cubic term."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _encoding(run: Column) -> Column:
    chosen = F.lit(len(ENCODINGS) - 1)
    for i, (_, alphabet) in reversed(list(enumerate(ENCODINGS))):
        inside = "[" + alphabet.replace("-", r"\-") + "]*"
        chosen = F.when(run.rlike(f"^{inside}$"), i).otherwise(chosen)
    return chosen


def _text_bits(folded: Column, run: Column) -> Column:
    """-log likelihood of a run as ordinary text, symbols taken independently."""
    letters = sum(
        (F.length(folded) - F.length(F.replace(folded, F.lit(c), F.lit(""))))
        * -log(CLASS_SHARE["letter"] * p / sum(LETTER_PERCENT))
        for c, p in zip(_LOWER, LETTER_PERCENT)
    )
    other = F.length(F.regexp_replace(folded, "[^A-Z]", ""))
    digits = F.length(F.regexp_replace(run, "[^0-9]", ""))
    marks = F.length(F.regexp_replace(run, "[A-Za-z0-9]", ""))
    return (
        letters
        + other * -log(CLASS_SHARE["other_case"] / 26)
        + digits * -log(CLASS_SHARE["digit"] / 10)
        + marks * -log(CLASS_SHARE["mark"] / 4)
    )


def battery(runs: DataFrame, run: str = "run") -> DataFrame:
    """Adds to each run: encoding, n, chi2, runs_z, serial_z, p_random and nats.

    ``p_random`` is the Bonferroni-combined p-value of three tests under the hypothesis that the
    symbols are uniform and independent over the inferred alphabet: chi-squared uniformity
    (Wilson-Hilferty), runs above and below the alphabet's middle, lag-1 serial correlation.
    ``nats`` is the log likelihood ratio of that hypothesis to ordinary text; under ordinary
    text P(nats >= x) <= exp(-x), so exp(-nats) is a p-value that can only get small in a run
    long enough to tell. Runs of digits alone are numbers, not secrets: their nats are 0.
    """
    alphabets = F.array(*[F.lit(symbols) for _, symbols in ENCODINGS])
    halves = F.array(
        *[F.lit("0" * (len(x) // 2) + "1" * (len(x) - len(x) // 2)) for _, x in ENCODINGS]
    )
    frame = (
        runs.withColumn("_body", F.regexp_replace(run, "=+$", ""))
        .withColumn("_no", _encoding(F.col("_body")) + 1)
        .withColumn("_alphabet", F.element_at(alphabets, F.col("_no")))
        .withColumn("_halves", F.element_at(halves, F.col("_no")))
    )
    one_case = F.regexp_replace(F.substring("_body", 2, 1 << 30), "[^A-Z]", "") == ""
    no_lower = F.regexp_replace("_body", "[^a-z]", "") == ""
    squares = F.aggregate(
        F.split("_alphabet", ""),
        F.lit(0.0),
        lambda s, c: s
        + F.when(
            c != "",
            F.pow(F.length("_body") - F.length(F.replace(F.col("_body"), c, F.lit(""))), 2),
        ).otherwise(0.0),
    )
    frame = frame.withColumns(
        {
            "n": F.length("_body").cast("double"),
            "k": F.length("_alphabet").cast("double"),
            "_squares": squares,
            "_bits": F.expr("translate(_body, _alphabet, _halves)"),
            "_folded": F.when(one_case | no_lower, F.lower("_body")).otherwise(F.col("_body")),
        }
    )
    symbols = F.transform(
        F.filter(F.split("_body", ""), lambda c: c != ""),
        lambda c: F.instr(F.col("_alphabet"), c).cast("double"),
    )
    frame = frame.withColumn("_x", symbols).withColumn(
        "_mean", F.aggregate("_x", F.lit(0.0), lambda s, x: s + x) / F.col("n")
    )
    sums = F.aggregate(
        "_x",
        F.struct(
            F.lit(0.0).alias("before"), F.lit(0.0).alias("cross"), F.lit(0.0).alias("square")
        ),
        lambda s, x: F.struct(
            (x - F.col("_mean")).alias("before"),
            (s["cross"] + s["before"] * (x - F.col("_mean"))).alias("cross"),
            (s["square"] + (x - F.col("_mean")) * (x - F.col("_mean"))).alias("square"),
        ),
    )
    frame = frame.withColumn("_sums", sums)
    ones = F.length(F.replace("_bits", F.lit("0"), F.lit(""))).cast("double")
    zeros = F.col("n") - ones
    expected = 2 * ones * zeros / F.col("n") + 1
    spread = (expected - 1) * (expected - 2) / (F.col("n") - 1)
    changes = F.regexp_count("_bits", F.lit("0+|1+")).cast("double")
    frame = frame.withColumns(
        {
            "chi2": F.col("k") / F.col("n") * F.col("_squares") - F.col("n"),
            "runs_z": F.when(spread > 0, (changes - expected) / F.sqrt(spread)).otherwise(99.0),
            "serial_z": F.when(
                F.col("_sums.square") > 0,
                F.col("_sums.cross") / F.col("_sums.square") * F.sqrt("n"),
            ).otherwise(99.0),
        }
    )
    ninth = 2 / (9 * (F.col("k") - 1))
    uniform = (F.pow(F.col("chi2") / (F.col("k") - 1), F.lit(1 / 3)) - (1 - ninth)) / F.sqrt(ninth)
    least = F.least(
        _upper_tail(uniform),
        2 * _upper_tail(F.abs("runs_z")),
        2 * _upper_tail(F.abs("serial_z")),
    )
    nats = _text_bits(F.col("_folded"), F.col("_body")) - F.col("n") * F.log("k")
    names = F.array(*[F.lit(name) for name, _ in ENCODINGS])
    return frame.withColumns(
        {
            "p_random": F.least(F.lit(1.0), 3 * least),
            "nats": F.when(F.col("_body").rlike("^[0-9]*$"), 0.0).otherwise(nats),
            "encoding": F.element_at(names, F.col("_no")),
        }
    ).drop(
        *("_body _no _alphabet _halves _squares _bits _folded _x _mean _sums k".split())
    )


def _thresholds(judged: DataFrame, bin_column: str, false_share: float) -> DataFrame:
    """Per band of lengths: the least bin from which Benjamini-Hochberg keeps the expected share
    of false finds below ``false_share`` among the band's runs, where a run in bin b has a
    p-value of exp(-b) at most. No row for a band without finds."""
    counts = judged.groupBy("band", F.col(bin_column).alias("bin")).agg(F.count("*").alias("c"))
    at_least = Window.partitionBy("band").orderBy(F.desc("bin"))
    whole = Window.partitionBy("band")
    ranked = counts.withColumns({"above": F.sum("c").over(at_least), "m": F.sum("c").over(whole)})
    holds = F.exp(-F.col("bin")) <= F.col("above") / F.col("m") * false_share
    return ranked.where(holds).groupBy("band").agg(F.min("bin").alias(f"least_{bin_column}"))


def controlled(judged: DataFrame, false_share: float, false_rejected: float) -> DataFrame:
    """The runs of a battery's result that are taken for secrets, by two false-discovery controls
    within each band of lengths (powers of two):

    - the battery's combined p-value rejects runs as not random, such that of the rejected ones a
      share of ``false_rejected`` at most is expected to be random;
    - of what it does not reject, the likelihood ratio to ordinary text must pass, such that of
      all that pass a share of ``false_share`` at most is expected to be ordinary text. In a
      short run it cannot get large, so short runs need more agreement among their like.
    """

    def binned(value: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(_MOST_NATS), F.floor(value)))

    judged = judged.withColumns(
        {
            "band": F.floor(F.log2("n")),
            "told": binned(F.col("nats")),
            "odd": binned(-F.log(F.greatest("p_random", F.lit(1e-90)))),
        }
    )
    return (
        judged.join(_thresholds(judged, "told", false_share), "band")
        .join(_thresholds(judged, "odd", false_rejected), "band", "left")
        .where("told >= least_told and (least_odd is null or odd < least_odd)")
    )


def _outside(runs: DataFrame, found: DataFrame) -> DataFrame:
    """The parts of the runs (row, span) that lie outside all base spans, if long enough.

    Runs and base spans of a text meet by the cells they lie in, not each with each."""

    def cells(span: str) -> Column:
        return F.explode(F.expr(f"sequence({span}.start div {_CELL}, ({span}.end - 1) div {_CELL})"))

    base = found.where(F.size("base") > 0).select("row", F.explode("base").alias("b"))
    base = base.select("row", "b.start", "b.end", cells("b").alias("cell"))
    met = runs.select("row", "span", cells("span").alias("cell")).join(base, ["row", "cell"])
    cut = F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts")
    cuts = met.where("start < span.end and span.start < end")
    cuts = cuts.groupBy(F.col("row").alias("in_row"), F.col("span.start").alias("at")).agg(cut)

    def piece(start: Column, end: Column) -> Column:
        return F.struct(
            start.alias("start"),
            F.col("span.kind").alias("kind"),
            end.alias("end"),
            F.substring("span.text", start - F.col("span.start") + 1, end - start).alias("text"),
        )

    def take(acc: Column, c: Column) -> Column:
        between = F.array(piece(acc["at"], F.greatest(acc["at"], c["start"])))
        return F.struct(
            F.greatest(acc["at"], c["end"]).alias("at"),
            F.concat(acc["pieces"], between).alias("pieces"),
        )

    end = F.col("span.end")
    first = F.struct(F.col("span.start").alias("at"), F.array().cast(_SPAN).alias("pieces"))
    pieces = F.aggregate(
        "cuts",
        first,
        take,
        lambda acc: F.concat(acc["pieces"], F.array(piece(acc["at"], F.greatest(acc["at"], end)))),
    )
    pieces = F.when(F.col("cuts").isNull(), F.array("span")).otherwise(pieces)
    at = F.expr("row = in_row and span.start = at")
    parts = runs.join(cuts, at, "left").select("row", F.explode(pieces).alias("span"))
    return parts.where(F.length("span.text") >= LEAST_RUN)


def find_secrets(docs: DataFrame, text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """Per row of ``docs``: doc_id and ``spans``, an array of (start, kind, end, text).

    Positions count code points, the end is exclusive. Base kinds are assign, access and hex;
    ``random`` marks runs of 20 or more base64 or base64url characters, what base spans take of
    them cut out and the rest judged piece by piece, that pass both controls of ``controlled``.
    Runs are judged against all runs of all texts.

    Null and empty texts have no spans; repeated rows are judged each; spans are sorted by start,
    then kind in the order named. Texts are scanned once: what the patterns find is staged as a
    narrow table, and only it meets the thresholds, of which there is one per band.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(
        _found(body, ASSIGN, 0, _assigned), _found(body, ACCESS, 1), _found(body, HEX, 2)
    )
    found = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.array_sort(base).alias("base"),
        _found(body, CANDIDATE, 3).alias("runs"),
    )
    found = staged(found, "runs")  # the row numbers hold from here
    runs = found.where(F.size("runs") > 0).select("row", F.explode("runs").alias("span"))
    runs = staged(_outside(runs, found), "pieces")
    judged = staged(battery(runs.select(F.col("span.text").alias("run")).distinct()), "judged")
    secret = controlled(judged, false_share, FALSE_REJECTED).select("run")
    added = (
        runs.join(secret, runs["span.text"] == secret.run)
        .groupBy("row")
        .agg(F.collect_list("span").alias("added"))
    )
    none = F.array().cast(_SPAN)
    spans = F.array_sort(F.concat("base", F.coalesce("added", none)))
    return found.join(added, "row", "left").select("doc_id", spans.alias("spans"))
