"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity bands and their least scores; a score below them all has the band None.
BANDS = (("Critical", 9.0), ("High", 7.0), ("Medium", 4.0), ("Low", 0.1))
NO_BAND = "None"
# Severity words and their scores, for reports of tools and for the bundled advisories.
TOOL_SEVERITY = {"critical": 9.1, "high": 7.5, "moderate": 5.3, "medium": 5.3, "low": 3.1, "info": 1.0, "unknown": 5.0}
ADVISORY_SEVERITY = {"critical": 9.8, "high": 7.5, "medium": 5.3, "low": 3.1}
UNKNOWN_SEVERITY = 5.0
FALLBACK_CWE = "CWE-1035"
# Folders that never name a module; marks of test paths.
CONTAINERS = ("src", "app", "lib", "pkg", "internal", "main", "java", "resources", "test", "tests")
TEST_MARKS = ("__tests__", "/tests/", "/test/", ".test.", ".spec.", "_test.")
# What stands in for a secret without being one.
PLACEHOLDER = (
    r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|<[^>]*>|changeme|placeholder|example|your[_\-]?[a-z]*|dummy|redacted|todo|none|null|test|sample|foo|bar|"
    r"\[REDACTED:[^\]]*\]|\[BLOCKED:[^\]]*\])$"
)


def _lookup(pairs: dict | tuple, key: Column, default: Column) -> Column:
    out = default
    for name, value in reversed(list(dict(pairs).items())):
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def band(severity: Column) -> Column:
    """The band of a score from 0 to 10; an error for any other score, null for none."""
    out = F.lit(NO_BAND)
    for name, least in reversed(BANDS):
        out = F.when(severity >= least, name).otherwise(out)
    outside = F.raise_error(F.concat(F.lit("severity out of range: "), severity.cast("string")))
    return F.when(severity.isNull(), F.lit(None)).when((severity < 0) | (severity > 10), outside).otherwise(out)


def band_rank(name: Column) -> Column:
    """0 for None and for what is no band."""
    out = F.lit(0)
    for rank, (known, _) in enumerate(reversed(BANDS), 1):
        out = F.when(name == known, rank).otherwise(out)
    return out


def token_estimate(text: Column) -> Column:
    """0 for an empty text, else one more than a token per 3.5 characters, rounded down."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.floor(n / 3.5) + 1).cast("long")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text."""
    chars = F.split(text, "")
    chars = F.filter(chars, lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))))


def is_placeholder(value: Column) -> Column:
    return F.trim(value).rlike(PLACEHOLDER)


def identifier_shape(value: Column) -> Column:
    """filesystem-path, PascalCase, camelCase, kebab-case, snake_case, module-path, or null: what reads as a name, not a key.

    Key material has runs of four capitals, and segments without a small letter; names have neither.
    """
    segments = F.filter(F.split(value, "/"), lambda s: s != "")
    wordlike = lambda s: s.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~s.rlike("[A-Z]{4,}") & ((F.length(s) < 4) | s.rlike("[a-z]"))
    path = F.contains(value, F.lit("/")) & (F.size(segments) > 0) & F.forall(segments, wordlike)
    delimited = value.rlike("^[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z][A-Za-z0-9]*){2,}$")
    humps = value.rlike("^[A-Za-z][a-z0-9]+(?:[A-Z][a-z0-9]+){2,}$")
    return (
        F.when(path, "filesystem-path")
        .when(value.rlike("[A-Z]{4,}") & ~delimited, F.lit(None))
        .when(humps, F.when(value.rlike("^[A-Z]"), "PascalCase").otherwise("camelCase"))
        .when(delimited, F.when(F.contains(value, F.lit("-")), "kebab-case").otherwise("snake_case"))
        .when(value.rlike(r"^[@A-Za-z][A-Za-z0-9_.-]*(?:[./][A-Za-z0-9_.-]+)+$"), "module-path")
    )


def line_of_offset(text: Column, offset: Column) -> Column:
    """The line, from 1, of a 0-based offset: line feeds before it count."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


# ---- versions


def version_key(version: Column) -> Column:
    """An array whose order is that of versions: pieces between dots, dashes and pluses; numbers by value, before words."""
    piece = lambda x: F.struct(x.try_cast("bigint").isNull().alias("word"), F.coalesce(x.try_cast("bigint"), F.lit(0)).alias("number"), F.when(x.try_cast("bigint").isNull(), x).otherwise("").alias("text"))
    return F.transform(F.split(version, r"[.+\-]"), piece)


def version_digits(version: Column) -> Column:
    """The first four runs of digits as numbers."""
    return F.slice(F.transform(F.regexp_extract_all(version, F.lit("([0-9]+)"), 1), lambda x: x.cast("bigint")), 1, 4)


def in_range(version: Column, introduced: Column, fixed: Column) -> Column:
    """introduced <= version < fixed; a missing or empty end is open."""
    have = version_key(version)
    after = F.coalesce(introduced, F.lit("")) == ""
    before = F.coalesce(fixed, F.lit("")) == ""
    return (after | (have >= version_key(introduced))) & (before | (have < version_key(fixed)))


def is_mutable_spec(spec: Column, ecosystem: Column) -> Column:
    """Whether a dependency's version may change without the manifest: no == and, for npm, no exact version."""
    return ~F.contains(spec, F.lit("==")) & ~((ecosystem == "npm") & spec.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"))


# ---- names and identifiers


def suffix_of(path: Column) -> Column:
    """The part from the last dot of the file's name on, in small letters; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_test_part(path: Column) -> Column:
    """The narrow test: one of TEST_MARKS in the path, as if it began with a slash."""
    slashed = F.concat(F.lit("/"), path)
    out = F.lit(False)
    for mark in TEST_MARKS:
        out = out | F.contains(slashed, F.lit(mark))
    return out


def module_of(path: Column) -> Column:
    """The first folder that is no mere container; the last folder if all are; a dot for a file at the top."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    named = F.filter(folders, lambda x: ~x.isin(*CONTAINERS))
    return F.when(F.size(parts) == 1, ".").otherwise(F.coalesce(F.get(named, F.lit(0)), F.element_at(folders, -1)))


def segment_id(repo: Column, module: Column, suffix: str = "") -> Column:
    base = F.concat(F.lit("seg-"), repo, F.lit("-"), module)
    return F.concat(F.replace(F.replace(base, F.lit("/"), F.lit("-")), F.lit("."), F.lit("root")), F.lit(suffix))


def segment_purpose(module: Column, entry_points: Column, annotations: Column) -> Column:
    label = F.replace(F.replace(module, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))
    bits = F.array(
        F.concat(F.lit("Handles "), label, F.lit(" functionality")),
        F.when(entry_points > 0, F.concat(F.lit("exposes "), entry_points.cast("string"), F.lit(" entry point(s)"))),
        F.when(F.array_contains(annotations, "security_sink"), "performs data-store operations"),
        F.when(F.array_contains(annotations, "sensitive_data"), "touches sensitive data"),
    )
    return F.concat(F.array_join(F.filter(bits, lambda x: x.isNotNull()), "; "), F.lit("."))


def node_id(repo: Column, path: Column, symbol: Column | None = None) -> Column:
    """repo:path, and #symbol where there is one."""
    whole = F.concat(repo, F.lit(":"), path)
    return whole if symbol is None else F.when(F.coalesce(symbol, F.lit("")) == "", whole).otherwise(F.concat(whole, F.lit("#"), symbol))


def normal_cwe(identifier: Column) -> Column:
    """Capital letters, CWE- in front of a bare number, nothing behind a colon or blank."""
    text = F.split(F.split(F.upper(F.trim(identifier)), ":")[0], " ")[0]
    return F.when(text.rlike("^[0-9]+$"), F.concat(F.lit("CWE-"), text)).otherwise(text)


def safe_cwe(identifier: Column, known: Column | None = None) -> Column:
    """The identifier if it is well formed (and known, where a column says so), else the class of vulnerable components."""
    text = normal_cwe(identifier)
    ok = text.rlike("^CWE-[0-9]+$")
    return F.when(ok if known is None else ok & known, text).otherwise(FALLBACK_CWE)


def tool_severity(word: Column) -> Column:
    return _lookup(TOOL_SEVERITY, F.lower(F.coalesce(word, F.lit("unknown"))), F.lit(UNKNOWN_SEVERITY))


def advisory_severity(word: Column) -> Column:
    return _lookup(ADVISORY_SEVERITY, F.lower(F.coalesce(word, F.lit(""))), F.lit(UNKNOWN_SEVERITY))


def methods_of(methods: Column) -> Column:
    """HTTP methods in capitals, sorted, each once, joined by |; GET where there are none."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform(methods, lambda m: F.upper(F.trim(m))), lambda m: m != "")))
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, "GET").otherwise(F.array_join(names, "|"))


def host_of(url: Column) -> Column:
    """The host of a URL in small letters; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def channel_tokens(text: Column) -> Column:
    """Names of custom headers that carry an identity, in small letters, each once."""
    # (?<![A-Za-z0-9_]) rather than \b: only ASCII letters, digits and underscores are word characters here
    pattern = r"(?i)((?<![A-Za-z0-9_])x-[a-z0-9-]*(?:user|email|tenant|account|identity|subject|auth)[a-z0-9-]*(?![A-Za-z0-9_]))"
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), F.lower)))


def short_hash(*parts: Column, size: int = 12) -> Column:
    """The first characters of the SHA-256 of the parts, joined by line feeds."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, size)


def answer_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def custom_id(request: Column) -> Column:
    """The request id where it is a plain name of at most 64 characters, else its SHA-256."""
    return F.when(request.rlike("^[A-Za-z0-9_-]{1,64}$"), request).otherwise(F.sha2(request, 256))


def without_level(request: Column) -> Column:
    """A request id without the level at its end."""
    return F.regexp_replace(request, r"-l[0-9]+$", "")


def percent_encoded(text: Column) -> Column:
    """URL-encoded, blanks as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def html_escaped(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def anchor(text: Column) -> Column:
    """Letters, digits, dashes and underscores; all else is a dash."""
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "-")


# ---- globs

_ANY, _ONE = ".*", "."


def glob_regex(glob: str) -> str:
    """A pattern of shell wildcards as a regular expression: * and ? cross slashes, [..] are classes."""
    out, i = "", 0
    while i < len(glob):
        close = glob.find("]", i + 2) if glob[i] == "[" else -1
        if close > 0:
            inner = glob[i + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = close
        else:
            c = glob[i]
            out += _ANY if c == "*" else _ONE if c == "?" else c if c.isalnum() or c in "_/ " else "\\" + c
        i += 1
    return f"(?s)^{out}$"


def matches_glob(path: Column, *globs: str) -> Column:
    """Whether one of the globs fits, with or without a leading **/ ."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
        if g.startswith("**/"):
            out = out | path.rlike(glob_regex(g[3:]))
    return out


# ---- numbers and times


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def backoff(attempt: Column, chance: Column, base: float = 2.0, cap: float = 60.0) -> Column:
    """Seconds to wait after an attempt, from 1: doubled each time up to the cap, times 0.5 to 1 as chance (0 to 1) says."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt - 1)) * (0.5 + chance / 2)


def poll_delay(n: Column, first: float = 30.0, factor: float = 1.5, cap: float = 300.0) -> Column:
    """Seconds before poll n, from 0."""
    return F.least(F.lit(cap), first * F.pow(F.lit(factor), n))


def is_stale(dataset_date: Column, today: Column, days: int = 90) -> Column:
    return F.datediff(today, dataset_date) > days


def support_ended(eol: Column, today: Column) -> Column:
    """Null where no end is known."""
    return eol < today


def in_window(minute: Column, start: Column, end: Column) -> Column:
    """Whether a minute of the day lies in [start, end), which may run over midnight."""
    return F.when(start <= end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))
