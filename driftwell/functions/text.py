"""Text functions as Column expressions: normal forms, n-grams, tokens, ids, hosts, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(x: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def short(x: Column, limit: int) -> Column:
    """``squeeze``, cut to ``limit`` code points with an ellipsis."""
    s = squeeze(x)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 1), F.lit("…")))


def bare(x: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(x, r"\s+", ""))


def ngrams(x: Column, n: int = 4) -> Column:
    """Distinct character n-grams of the text without white space, lower case; a shorter text is one, an empty none."""
    chars = F.split(bare(x), "")

    def grams(c: Column) -> Column:  # bound once: a lambda would work the text out again for each gram
        last = F.greatest(F.lit(1), F.size(c) - (n - 1))
        return F.array_remove(F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(c, i, n), ""))), "")

    return F.element_at(F.transform(F.array(chars), grams), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; two empty sets have 0."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def tokens(x: Column) -> Column:
    """Distinct lower-case runs of Latin letters, digits and underscores of two or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9_]{2,})"), F.lit(1)))


def hits(needle: Column | str, x: Column) -> Column:
    """Non-overlapping occurrences in lower-case text."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    low = F.lower(x)  # which may be longer than x
    return ((F.length(low) - F.length(F.replace(low, n, F.lit("")))) / F.length(n)).cast("long")


def skeleton(x: Column) -> Column:
    """Identifiers, mail addresses, web addresses and numbers replaced by their kinds."""
    s = F.regexp_replace(x, r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "UUID")
    s = F.regexp_replace(s, r"https?://[^ \n\t]+", "URL")
    s = F.regexp_replace(s, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "MAIL")
    s = F.regexp_replace(s, r"[0-9a-f]{16,}", "HEX")
    return F.regexp_replace(s, r"[0-9]+", "N")


def redact(x: Column) -> Column:
    """Mail addresses, card-like and phone-like numbers sealed."""
    s = F.regexp_replace(x, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    s = F.regexp_replace(s, r"[0-9]{13,19}", "[CARD]")
    return F.regexp_replace(s, r"\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}", "[PHONE]")


def host(url: Column) -> Column:
    """Lower-case authority with port and user, as it stands in the address."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 24 hex digits of the sha256 of the parts joined by a bar; null parts are empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 24))


def first_rule(x: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Name of the first rule one of whose keywords the lower-case text holds."""
    low = F.lower(x)
    out = F.lit(default)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def query_tokens(x: Column) -> Column:
    """``tokens``, and the two-character pieces of runs of Chinese characters; each once, in that order."""
    low = F.lower(x)
    latin = F.regexp_extract_all(low, F.lit(r"([a-z0-9_]{2,})"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(r"([\x{4E00}-\x{9FFF}]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(latin, pairs))


def distinctive(terms: Column, most: int = 4) -> Column:
    """The longest terms, ``most`` of them; equal lengths by the term."""
    ranked = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(F.slice(ranked, 1, most), lambda x: x["t"])


def word_runs(x: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script; a run of Chinese characters is one."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def mentions(x: Column, names: list[str]) -> Column:
    """Names found in the lower-case text, sorted, each once."""
    low = F.lower(x)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(n)), F.lit(n)) for n in names)))))


def like_escape(needle: str) -> str:
    """``needle`` with backslash, percent and underscore escaped by a backslash, for LIKE."""
    return needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_any(x: Column, needle: str) -> Column:
    """Whether ``needle`` is in ``x`` as it stands, by an escaped LIKE."""
    return F.like(x, F.lit(f"%{like_escape(needle)}%"), F.lit("\\"))


def embedding_text(title: Column, rich: Column, content: Column, least: int = 10) -> Column:
    """Title, a space and the rich text, or the plain one where the rich one is shorter than ``least``; null where both are."""
    good = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) >= least
    body = F.when(good(rich), F.trim(rich)).when(good(content), F.trim(content))
    return F.when(body.isNotNull(), F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), body)))


def last_segment(path: Column) -> Column:
    """Last part of a path or web address, lower case, without query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"[/\\]+$", "")
    return F.lower(F.regexp_extract(bare, r"([^/\\]*)$", 1))


#: Names that are no entities: hashes, ids, bare numbers, file names.
NOT_NAMES = r"^([0-9a-f]{7,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f-]*|[0-9]+|.*\.(html?|php|js|css|png|jpg|json|xml|txt|md|py))$"


def valid_name(x: Column, blocked: list[str]) -> Column:
    """Whether a name has 2 to 40 characters, isn't blocked and is no hash, id, number or file name."""
    return F.length(x).between(2, 40) & ~x.isin(*blocked) & ~x.rlike(NOT_NAMES)


def timestamp_loose(x: Column) -> Column:
    """First of three formats that the first 19 characters fit; null else."""
    head = F.substring(x, 1, 19)
    return F.coalesce(*(F.try_to_timestamp(head, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))


def timestamp_zoned(x: Column) -> Column:
    """ISO date and time with a zone, which must be there; null else."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(x))


def after_quiet_hours(at: Column, zone: str, night: int = 22, morning: int = 7) -> Column:
    """``at`` or, in the quiet hours of ``zone``, the next morning's end of them; in and out by the session's zone."""
    local = F.from_utc_timestamp(at, zone)
    day = F.date_trunc("day", local)
    hour = F.hour(local)
    end = F.when(hour >= night, day + F.expr(f"INTERVAL 1 DAY {morning} HOUR")).when(hour < morning, day + F.expr(f"INTERVAL {morning} HOUR"))
    return F.coalesce(F.to_utc_timestamp(end, zone), at)


def first_distinct(values: Column, most: int) -> Column:
    """The first ``most`` different values, in the order of their first places."""
    return F.slice(F.array_distinct(values), 1, most)


def reply_json(x: Column, schema: str) -> Column:
    """The object between the first and the last brace of a model's reply, code fences and prose around it dropped; null if it isn't one."""
    return F.from_json(F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def without_reminders(x: Column, tag: str = "system-reminder") -> Column:
    """Blocks that a tool put between <tag> and </tag> taken out."""
    return F.trim(F.regexp_replace(x, rf"(?s)<{tag}>.*?</{tag}>", ""))


def fact_key(x: Column, size: int = 40) -> Column:
    """Lower-case letters, digits and underscores alone, the first ``size``: facts with one key are versions of one."""
    return F.substring(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", ""), 1, size)


def turn_line(ident: Column, role: Column, at: Column, x: Column) -> Column:
    """A turn as a line of a window: [id] [role] [time] text."""
    part = lambda c: F.concat(F.lit("["), F.coalesce(c.cast("string"), F.lit("")), F.lit("] "))
    return F.concat(part(ident), part(role), part(at), F.coalesce(x, F.lit("")))


def judgment(relation: Column, confidence: Column, known: list[str]) -> tuple[Column, Column]:
    """Relation and confidence of a judgment: an unknown relation is no_relation, the confidence is held to 0..1 and 0 without one."""
    rel = F.when(F.lower(F.trim(relation)).isin(*known), F.lower(F.trim(relation))).otherwise("no_relation")
    return rel, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence.try_cast("double"), F.lit(0.0))))


def reference_list(x: Column) -> Column:
    """References of a JSON container: an array as it is, an object or a bare value as one, blank as none; null for broken JSON."""
    t = F.trim(F.coalesce(x, F.lit("")))
    many = F.from_json(t, "array<string>")
    return F.when(t == "", F.array().cast("array<string>")).when(t.startswith("["), many).when(t.startswith("{") & F.from_json(t, "map<string,string>").isNotNull(), F.array(t))


def contiguous_support(quote: Column, source: Column, width: int = 10) -> Column:
    """Whether the source holds the quote, or any ``width`` characters in a row of it."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(quote) - (width - 1)))
    part = F.exists(starts, lambda i: F.contains(source, F.substring(quote, i, F.lit(width))))
    return F.contains(source, quote) | ((F.length(quote) >= width) & part)


#: Redaction rules in their order: name, pattern. Earlier ones seal first, so a key in an address isn't cut by the address's rule.
REDACTIONS = (
    ("PRIVATE_KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----"),
    ("JWT", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    ("ACCESS_KEY", r"AKIA[A-Z0-9]{16}"),
    ("TOKEN", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("API_KEY", r"sk-[A-Za-z0-9_-]{20,}"),
    ("BEARER", r"[Bb]earer [A-Za-z0-9._~+/=-]{16,}"),
    ("CREDENTIAL", r"(?i)(password|passwd|secret|token|api_?key)[\"']?[ ]*[:=][ ]*[\"']?[A-Za-z0-9+/_.=-]{6,}"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("IP", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("IBAN", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"),
    ("CARD", r"\b[0-9]{13,19}\b"),
    ("PHONE", r"\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}"),
    ("HEX", r"\b[0-9a-f]{32,}\b"),
)


def redact_by(x: Column, mode: str = "label", rules: tuple[tuple[str, str], ...] = REDACTIONS) -> Column:
    """Text with what the rules find sealed, in their order: ``label`` writes [NAME], ``mask`` ***, ``drop`` nothing."""
    marks = {"label": lambda n: f"[{n}]", "mask": lambda n: "***", "drop": lambda n: ""}
    if mode not in marks:
        raise ValueError(f"unknown mode {mode!r}")
    for name, pattern in rules:
        x = F.regexp_replace(x, pattern, marks[mode](name))
    return x


def rules_hit(x: Column, rules: tuple[tuple[str, str], ...] = REDACTIONS) -> Column:
    """Names of the rules that find something, in their order."""
    return F.array_compact(F.array(*(F.when(x.rlike(p), F.lit(n)) for n, p in rules)))


def canonical_json(x: Column) -> Column:
    """JSON with sorted keys and no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(x))
