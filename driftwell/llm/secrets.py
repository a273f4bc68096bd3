"""Secret scans (operator 1), DataFrame functions only.

Three fixed patterns give the base spans. The method adds strings that look random: of every long run of key
characters the encoding is inferred, and its characters are tested for uniformity (chi-squared over
characters and over kinds of them), runs about the middle of the alphabet and serial correlation. Within strata of
encoding and length the Benjamini-Hochberg step-up over all strings of the corpus holds the battery's p-values, and
what it rejects isn't random. How many equal pairs of characters a string of its length would have were it ordinary
text gives a second p-value, held by a step-up of its own, so that short strings, which cannot tell, are not reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

#: The patterns of the base spans, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"  # whole runs; shorter ones would be dropped
KINDS = ("assign", "access", "hex", "random")

#: Runs of key characters that the method looks at; with a letter and a digit.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Encodings by the first pattern that fits: name, pattern, alphabet in order.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("crockford", r"^[0-9A-HJKMNP-TV-Z]+=*$", "0123456789ABCDEFGHJKMNPQRSTVWXYZ"),
    ("BASE36", r"^[0-9A-Z]+=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
TEXT_COLLISION = 0.065  # share of equal pairs of letters in ordinary text


CHUNK = 512  # spans that one fold gathers: a fold copies what it has gathered at every step
SPANS = "array<struct<start:int,end:int,match:string>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _let(x: Column, f) -> Column:
    """f(x) with ``x`` worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _chunks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(items) / CHUNK).cast("int") - 1)), lambda j: F.slice(items, j * CHUNK + 1, CHUNK))


def _placed(items: Column, at: Column, lead, size, tail, ok, match) -> Column:
    """Spans of the items that pass ``ok``, laid out from ``at``: ``lead`` before each, its ``size``, ``tail`` after it.

    Sums by chunk give where each chunk starts, and each chunk then gathers its own spans.
    """

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + lead(z)
        end = start + size(z)
        hit = F.struct(start.alias("start"), end.alias("end"), match(z).alias("match"))
        return F.struct((end + tail(z)).alias("at"), F.when(ok(z), F.array_append(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    def laid(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, z: n + lead(z) + size(z) + tail(z)))
        return _let(sums, lambda s: F.flatten(F.transform(chunks, lambda c, j: F.aggregate(c, F.struct(F.aggregate(F.slice(s, F.lit(1), j), at, lambda n, x: n + x).alias("at"), _none(SPANS).alias("out")), step, lambda a: a["out"]))))

    return _let(items, lambda i: _let(_chunks(i), laid))


def matches(text: Column, pattern: str, ok) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches that pass ``ok``; code points, end exclusive.

    The pieces between the matches give the places: all lengths are summed along the text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("match"))
    spans = _placed(both, F.lit(0), lambda z: F.length(z["piece"]), lambda z: F.coalesce(F.length(z["match"]), F.lit(0)), lambda z: F.lit(0), lambda z: F.coalesce(ok(z["match"]), F.lit(False)), lambda z: z["match"])
    return F.when(text.rlike(pattern), spans).otherwise(_none(SPANS))


def parts(found: Column) -> Column:
    """The runs of ``found`` (start, end, match), those that fit no encoding by the parts between their separators.

    A run with both of + / and of _ - is parted at each /, and a part that still has + beside _ or - at each +; parts
    of 20 key characters or more with a letter and a digit stay.
    """
    neither = lambda x: x.rlike("[+/]") & x.rlike("[_-]")
    zero, one = lambda x: F.lit(0), lambda x: F.lit(1)
    good = lambda x: x.rlike("^[^=]{20,}") & x.rlike("[A-Za-z]") & x.rlike("[0-9]")

    def of(m: Column) -> Column:
        pieces = F.flatten(F.transform(F.split(m["match"], "/", -1), lambda x: F.when(neither(x), F.split(x, "[+]", -1)).otherwise(F.array(x))))
        return F.when(neither(m["match"]), _placed(pieces, m["start"], zero, F.length, one, good, lambda x: x)).otherwise(F.array(m))

    return F.flatten(F.transform(found, of))


def apart(found: Column, base: Column) -> Column:
    """The spans of ``found``, in order and not overlapping each other, that meet none of ``base``; a chunk of them looks at the base spans near it alone."""
    meets = lambda b, start, end: (b["start"] < end) & (start < b["end"])

    def free(c: Column) -> Column:
        near = F.filter(base, lambda b: meets(b, F.element_at(c, 1)["start"], F.element_at(c, -1)["end"]))
        return _let(near, lambda n: F.filter(c, lambda m: ~F.exists(n, lambda b: meets(b, m["start"], m["end"]))))

    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(F.flatten(F.transform(_chunks(found), free)))


def _tail_below(z: Column) -> Column:
    """Normal distribution function, by its logistic approximation."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return 2 * _tail_below(-F.abs(z))


def _chi_tail(chi: Column, df: Column) -> Column:
    """Upper tail of chi-squared, by the cube-root approximation."""
    z = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return _tail_below(-z)


def battery(x: Column) -> Column:
    """Struct of a string's encoding, length and p-values: p_random (least of the tests, times four) and p_text."""
    name = F.lit(None).cast("string")
    alphabet = F.lit(None).cast("string")
    for n, pattern, letters in reversed(ENCODINGS):
        name = F.when(x.rlike(pattern), n).otherwise(name)
        alphabet = F.when(x.rlike(pattern), letters).otherwise(alphabet)
    core = F.regexp_replace(x, "=+$", "")
    chars = F.split(core, "")
    n = F.length(core).cast("double")
    k = F.length(alphabet).cast("double")
    # chi-squared: the sum of squared counts
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(core, c, F.lit(""))), F.lit(2)))
    chi = k / n * squares - n
    df = k - 1
    p_chi = _chi_tail(chi, df)
    # the same over upper-case letters, lower-case ones and the rest, whose cells are never small
    rest = [(F.length(F.regexp_replace(core, out, "")), F.length(F.regexp_replace(alphabet, out, "")) / k) for out in ("[^A-Z]", "[^a-z]", "[A-Za-z]")]
    kinds = sum((F.when(share > 0, F.pow(count - n * share, F.lit(2)) / (n * share)).otherwise(0.0) for count, share in rest), F.lit(0.0))
    p_kinds = _chi_tail(kinds, sum((F.when(share > 0, 1.0).otherwise(0.0) for _, share in rest), F.lit(-1.0)))
    # places in the alphabet, centred; runs above and below its middle; correlation of neighbours
    places = F.transform(chars, lambda c: F.position(c, alphabet) - (k + 1) / 2)
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("high"), F.lit(0.0).alias("serial"), F.lit(0.0).alias("square"))

    def step(a: Column, v: Column) -> Column:
        change = F.when(a["last"].isNotNull() & ((a["last"] > 0) != (v > 0)), 1.0).otherwise(0.0)
        return F.struct(
            v.alias("last"),
            (a["runs"] + change).alias("runs"),
            (a["high"] + F.when(v > 0, 1.0).otherwise(0.0)).alias("high"),
            (a["serial"] + F.coalesce(a["last"] * v, F.lit(0.0))).alias("serial"),
            (a["square"] + v * v).alias("square"),
        )

    def finish(a: Column) -> Column:
        high, low = a["high"], n - a["high"]
        mean = 2 * high * low / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(spread > 0, (a["runs"] - mean) / F.sqrt(spread)).otherwise(F.lit(8.0))
        z_serial = F.when(a["square"] > 0, a["serial"] / a["square"] * F.sqrt(n)).otherwise(F.lit(8.0))
        return F.least(_two_sided(z_runs), _two_sided(z_serial))

    p_order = F.aggregate(places, start, step, finish)
    pairs = (squares - n) / 2
    expected = F.greatest(1.73 / k, F.lit(TEXT_COLLISION)) * n * (n - 1) / 2
    p_text = _tail_below((pairs + 0.5 - expected) / F.sqrt(1.5 * expected))
    return F.struct(name.alias("encoding"), F.length(core).alias("n"), F.least(F.lit(1.0), 4 * F.least(p_chi, p_kinds, p_order)).alias("p_random"), p_text.alias("p_text"))


GRID = 100.0  # steps of the p-values' scale: hundredths of a natural logarithm, rounded towards 1


def _stratum(b: Column) -> Column:
    return F.concat(b["encoding"], F.lit(":"), F.least(F.lit(7), F.floor(F.log2(b["n"] / 20.0) * 2)).cast("string"))


def _step_of(p: Column) -> Column:
    return F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * GRID)


def step_up(strings: DataFrame, rate: float) -> dict[str, int]:
    """Benjamini-Hochberg by strata: the step from which on p-values are rejected at ``rate``; rows (stratum, step), one for each string.

    Counts by step are what is sorted, so no stratum's strings come together; at most encodings x 8 numbers are sent back.
    """
    by = strings.groupBy("stratum", "step").agg(F.count("*").alias("c"))
    inside = Window.partitionBy("stratum")
    by = by.withColumn("below", F.sum("c").over(inside.orderBy(F.desc("step")))).withColumn("all", F.sum("c").over(inside))
    cut = by.where(F.exp(-F.col("step") / GRID) <= rate * F.col("below") / F.col("all")).groupBy("stratum").agg(F.min("step").alias("cut"))
    return {r.stratum: r.cut for r in cut.collect()}


def _rejected(p: Column, b: Column, cuts: dict[str, int]) -> Column:
    """Whether ``p`` is rejected in the stratum of ``b``; where nothing is, False."""
    limit = F.create_map(*[F.lit(x) for kv in (cuts or {"": 0}).items() for x in kv])
    return F.coalesce(_step_of(p) >= F.element_at(limit, _stratum(b)), F.lit(False))


def scan(docs: DataFrame, rate: float = 0.05, random_rate: float = 0.01) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans), one for each row of ``docs``.

    base_spans: struct (kind, start, end) of every base match, by start and then kind in the order of KINDS.
    spans: these and strings outside the base spans that look random: in its stratum of encoding and length the
    step-up at ``random_rate`` over the battery's p-values doesn't call the string non-random, and the step-up at
    ``rate`` over p_text does call it other than text. Null text is empty. Repeated rows are scanned each and every
    occurrence of a string is reported; the step-ups count a string once, however often it occurs (strings are known
    by 64-bit hashes). An empty table gives none; columns other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    checks = (
        (ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        (ACCESS, lambda m: F.length(m) >= 20),
        (HEX, lambda m: F.length(m) >= 24),
        (CANDIDATE, lambda m: m.rlike("[A-Za-z]") & m.rlike("[0-9]")),
    )
    found = docs.select("doc_id", *(matches(text, p, ok).alias(k) for k, (p, ok) in zip(KINDS, checks, strict=True))).withColumn("random", parts(F.col("random")))

    def kind(name: str) -> Column:
        order = KINDS.index(name)
        return F.transform(name, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end")))

    base = F.array_sort(F.concat(*map(kind, KINDS[:3])))
    free = apart(F.col("random"), F.col("base"))
    tested = found.withColumn("base", base).select(
        "doc_id", "base", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.transform(free, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.xxhash64(m["match"]).alias("h"), battery(m["match"]).alias("b"))).alias("random"),
    )
    tested = materialize(tested)

    b = F.col("r.b")
    strings = tested.select(F.explode("random").alias("r")).select(_stratum(b).alias("stratum"), _step_of(b["p_text"]).alias("text"), _step_of(b["p_random"]).alias("random"), F.col("r.h").alias("h"))
    strings = materialize(strings.where("stratum IS NOT NULL").distinct())
    texts, randoms = step_up(strings.withColumnRenamed("text", "step"), rate), step_up(strings.withColumnRenamed("random", "step"), random_rate)
    passed = F.filter("random", lambda r: r["b"]["encoding"].isNotNull() & _rejected(r["b"]["p_text"], r["b"], texts) & ~_rejected(r["b"]["p_random"], r["b"], randoms))
    out = tested.withColumn("random", F.transform(passed, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("order"), r["end"].alias("end"))))
    named = lambda c: F.transform(c, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["order"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.size("random").cast("long").alias("n_random"), named(F.col("base")).alias("base_spans"), named(F.array_sort(F.concat("base", "random"))).alias("spans"))


def joined(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
