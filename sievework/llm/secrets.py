"""Secret scan with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in their order, the pattern of each, and the least length of a match (assign: of its value).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")
LEAST_VALUE, LEAST_ACCESS = 12, 18

MARK, SPARE = "\x01", "\x02"
# Weak parts of multipart credentials: reported only beside a complementary part in the same scope. None of them overlaps a
# base span: those are blotted out with SPARE before, which no weak part may hold or touch.
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_.\x02-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=_\x02-])"
WEAK_ID = r"(?i)(?<![A-Za-z0-9_\x02])(?:client_id|access_key_id|account_id|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}+(?!\x02)"
ENDPOINT = r"(?i)\b(?:https?|ftp|ssh|amqp|redis|mongodb|postgres(?:ql)?|mysql|jdbc:[a-z]+)://[^\s\"'<>]{4,}"
BLANK = r"\n[\x20\t\r]*\n"
#: A scope: a run of spans in which each starts at most this many characters behind the one before; a blank line ends it.
SCOPE = 400

_SPAN = "array<struct<start:int,kind:int,name:string,end:int,body:string>>"
_NONE = f"cast(array() as {_SPAN})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often a lambda in body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def starts_of(lengths: Column) -> Column:
    """Where each of adjoining parts starts, from their lengths. Sums of runs of sqrt(n) parts keep it at n * sqrt(n) steps."""

    def of_runs(lengths: Column, run: Column) -> Column:
        run_sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / run).cast("int")), lambda j: _sum(F.slice(lengths, j * run + 1, run)))
        heads = lambda sums: F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        inside = lambda i: F.when(i % run > 0, _sum(F.slice(lengths, i - i % run + 1, F.greatest(i % run, F.lit(1))))).otherwise(0)
        return let(let(run_sums, heads), lambda h: F.transform(F.sequence(F.lit(0), F.size(lengths) - 1), lambda i: F.element_at(h, F.floor(i / run).cast("int") + 1) + inside(i)))

    return let(lengths, lambda x: let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda run: of_runs(x, run)))


def parts_of(text: Column, pattern: str) -> Column:
    """The text in parts, of which every second one is a match: leftmost, non-overlapping.

    Matches are framed by a mark that no text holds (the caller replaces it by another control character, which no base
    pattern matches either) and the text is split there.
    """
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)


def spans_of(text: Column, pattern: str, kind: int, name: str, keeps: Callable[[Column], Column] | None = None) -> Column:
    """Matches that `keeps` accepts as structs (start, kind, name, end, body), in code points."""

    def spans(parts: Column) -> Column:
        span = lambda starts, i: let(F.element_at(parts, i), lambda x: F.struct(F.element_at(starts, i).alias("start"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), (F.element_at(starts, i) + F.length(x)).alias("end"), x.alias("body")))
        every = let(starts_of(F.transform(parts, F.length)), lambda starts: F.transform(F.sequence(F.lit(2), F.size(parts), F.lit(2)), lambda i: span(starts, i)))
        return F.filter(every, lambda s: keeps(s["body"])) if keeps else every

    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts_of(text, pattern), spans)).otherwise(F.expr(_NONE))


def blotted(text: Column, pattern: str, keeps: Callable[[Column], Column]) -> Column:
    """The text with SPARE in place of each character of the matches that `keeps` accepts: as long as before."""
    part = lambda x, i: F.when((i % 2 == 1) & keeps(x), F.repeat(F.lit(SPARE), F.length(x))).otherwise(x)
    return F.when(F.regexp_like(text, F.lit(pattern)), F.array_join(F.transform(parts_of(text, pattern), part), "")).otherwise(text)


def _any(spans: Column, *names: str) -> Column:
    return F.exists(spans, lambda s: s["name"].isin(*names))


def scopes_of(spans: Column, scope: int) -> Column:
    """Sorted spans, blank lines among them, cut into the runs that are scopes."""

    def cut(ordered: Column) -> Column:
        before = lambda i: F.element_at(ordered, F.greatest(i, F.lit(1)))
        begins = lambda i: (i == 0) | (F.element_at(ordered, i + 1)["name"] == "blank") | (F.element_at(ordered, i + 1)["start"] - before(i)["end"] > scope)
        first = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), begins)
        upto = lambda first, j: F.coalesce(F.get(first, j + 1), F.size(ordered))
        return let(first, lambda first: F.transform(first, lambda at, j: F.slice(ordered, at + 1, upto(first, j) - at)))

    return F.when(F.size(spans) > 0, let(F.sort_array(spans), cut)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id with `base` and `linked`, arrays of spans (start, kind, name, end, body) in order, and n_assign, n_access, n_hex.

    base: assignments, access identifiers and long hex runs. linked: weak candidates (a mixed word of 32 or more characters,
    an account assignment, an endpoint with a scheme) that share a scope with complementary parts. A scope is an interval
    of the text: spans in the order of their starts, each at most `scope` characters behind the end of the one before,
    and no blank line between. Identifiers (access identifiers, accounts) link with secrets (assignments, hex runs, mixed
    words) of their scope: weak ones of either side are reported where the other side is there, endpoints where both are.
    The join of scopes and spans is one sweep over the sorted spans of a row: nothing is shuffled, and a text with
    thousands of parts takes steps in proportion to them, but for sorting and starts (n * sqrt(n)).

    Accounts and mixed words are sought in every text in which a part of the other side can be; endpoints where both
    sides are, as nothing else links them. A weak part that overlaps a base span is none. Null texts are empty; rows
    without matches have empty arrays; ids may be of any type, null or repeat, and equal rows give equal results. Texts
    may be of any length and are never cut. Ties of start go by kind. Other columns are not read. An empty table gives
    an empty result.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, SPARE)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kept = {
        "assign": (ASSIGN, lambda body: F.length(F.regexp_extract(body, ASSIGN, 2)) >= LEAST_VALUE),
        "access": (ACCESS, lambda body: F.length(body) >= LEAST_ACCESS),
        "hex": (HEX, lambda body: F.length(body) >= 16),
    }
    found = rows
    for kind, name in enumerate(BASE_KINDS):
        found = found.withColumn(name, spans_of(F.col("text"), kept[name][0], kind, name, kept[name][1]))
    some = lambda *kinds: F.greatest(*[F.size(k) for k in kinds], F.lit(0)) > 0
    masked = F.col("text")
    for name in BASE_KINDS:
        masked = F.when(F.size(name) > 0, blotted(masked, *kept[name])).otherwise(masked)
    weak = lambda gate, pattern, kind, name: F.when(gate, spans_of(F.col("masked"), pattern, kind, name, lambda body: ~F.contains(body, F.lit(SPARE)))).otherwise(F.expr(_NONE))
    found = found.withColumn("masked", F.when(some(*BASE_KINDS), masked).otherwise(F.col("text")))
    found = found.withColumn("account", weak(F.lit(True), WEAK_ID, 4, "account"))
    found = found.withColumn("mixed", weak(some("access", "account"), WEAK_SECRET, 3, "secret"))
    both = some("access", "account") & some("assign", "hex", "mixed")
    found = found.withColumn("endpoint", weak(both, ENDPOINT, 5, "endpoint"))
    blank = F.when(both, spans_of(F.col("text"), BLANK, 6, "blank")).otherwise(F.expr(_NONE))
    found = found.withColumn("spans", F.when(both, F.concat(*BASE_KINDS, "account", "mixed", "endpoint", blank)).otherwise(F.expr(_NONE)))

    def reported(spans: Column) -> Column:
        identified, secret = _any(spans, "access", "account"), _any(spans, "assign", "hex", "secret")
        return F.when(identified & secret, F.filter(spans, lambda s: s["name"].isin("secret", "account", "endpoint"))).otherwise(F.expr(_NONE))

    found = found.withColumn("linked", F.flatten(F.transform(scopes_of(F.col("spans"), scope), reported)))
    return found.select("doc_id", F.sort_array(F.concat(*BASE_KINDS)).alias("base"), "linked", *[F.size(k).alias(f"n_{k}") for k in BASE_KINDS])


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
