"""Facts from source files: symbols, imports and calls; endpoints, data access, wiring; marks, hosts and categories."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import methods_of
from sievework.operators.locate import following_symbol

# Patterns of marks on a file or symbol.
USER_INPUT = (
    r"(?i)request\.(?:args|form|json|data|body|params|query|GET|POST|get_json|headers|cookies)|req\.(?:body|query|params|headers|cookies)|@RequestParam|@RequestBody|"
    r"@PathVariable|@RequestHeader|@CookieValue|\.getHeader\(|\bgetCookie\(|c\.Query\(|c\.Param\(|c\.Cookie\(|c\.GetHeader\(|r\.Header\.Get\(|r\.URL\.Query\(|os\.Args"
)
AUTHENTICATION = (
    r"(?i)@login_required|@requires_auth|@authenticated|IsAuthenticated|@PreAuthorize|@Secured|@RolesAllowed|verify\w*(?:token|session)\s*\(|check\w*session|current_user|require_auth|"
    r"authenticate\w*\s*\(|passport\.authenticate|jwt\.verify|bcrypt\.(?:compare|checkpw)"
)
AUTHORIZATION = r"(?i)@PreAuthorize|@Secured|@RolesAllowed|require_role|has_permission|can_access|authorize\(|is_admin|check_permission|@permission_required"
SENSITIVE = (
    r"(?i)(?<![A-Za-z])(?:password|passwd|secret|token|ssn|social_security|credit_card|card_number|cvv|api_key|apikey|private_key|email|phone|address|dob|date_of_birth|salary)(?![A-Za-z])"
)
SINK = (
    r"(?i)\b(?:eval|exec|popen|subprocess\.(?:run|call|Popen)|os\.system|system\s*\(|Runtime\.getRuntime|ProcessBuilder|pickle\.loads|yaml\.load|innerHTML|dangerouslySetInnerHTML|child_process)\b"
)
OUTBOUND = r"(?i)https?://(?!localhost|127\.0\.0\.1)([a-z0-9.-]+)"
# Registrations of routes: pattern, kind, group of the route, group of the methods (0: none).
ROUTES = (
    (r"(?s)@[\w.]*\.?route\(\s*[\"']([^\"']+)[\"'](?:.*?methods\s*=\s*\[([^\]]*)\])?", "http", 1, 2),
    (r"@?[\w.]*\.(get|post|put|patch|delete|head|options)\(\s*[\"'](/[^\"']*)[\"']", "http", 2, 1),
    (r"@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"']", "http", 2, 1),
    (r"http\.HandleFunc\(\s*[\"']([^\"']+)[\"']", "http", 1, 0),
    (r"\bpath\(\s*[\"']([^\"']*)[\"']", "http", 1, 0),
    (r"@KafkaListener|@RabbitListener|@SqsListener|@StreamListener", "consumer", 0, 0),
    (r"\.(?:subscribe|consume)\(\s*[\"']([^\"']+)[\"']", "consumer", 1, 0),
    (r"@GrpcService|grpc\.Server|ServicerToServer", "rpc", 0, 0),
    (r"@click\.command|argparse\.ArgumentParser|cobra\.Command", "cli", 0, 0),
)
# Accesses to a store, in the order in which they are tried at a place; a query put together from text.
EXECUTE = r"(?:db|conn|cursor|stmt)\s*\.\s*(?:get|run|all|prepare|first)\s*\(|(?:cursor|conn|connection|db|session|stmt|statement)\s*\.\s*(?:execute|executemany|query|raw|exec|Query|Exec|prepareStatement|createQuery)\s*\("
READ = r"\.(?:objects\.(?:get|filter|all)|find_one|find_by|findAll|findById|createQuery|from\(|select\()"
WRITE = r"\.(?:save|insert|update|delete|create|commit|persist|merge)\s*\("
UNSAFE = r"(?:execute|query|raw|exec|Query|Exec)\s*\(\s*(?:f[\"']|[\"'][^\"']*[\"']\s*(?:\+|%|\.format\(|\.concat\()|[A-Za-z_][\w.]*\s*\+|`[^`]*\$\{)"
USE = r"(?:router|app|application|server|bp|api)\s*\.\s*use\s*\(([^)]*)\)|\.before_(?:app_)?request\s*\(\s*([A-Za-z_]\w*)|\.middlewares\.(?:append|appendleft)\s*\(\s*([A-Za-z_]\w*)|\b(?:[rReE]|engine|routes?)\.Use\s*\(([^)]*)\)"
ROUTE_USE = r"(?s)@?[\w.]*\.(get|post|put|patch|delete|head|options)\(\s*[\"'](/[^\"']*)[\"']\s*,([^)]*)\)"
# Words that are no bound names of a template.
NOISE = ("true", "false", "null", "undefined", "this", "let", "var", "const", "new", "item", "index", "if", "else", "for", "in", "of", "not", "and", "or", "none")
MARK = "\x01"


def _places(files: DataFrame, pattern: str, *keep: str) -> DataFrame:
    """keep, body and line of every match of a pattern, by marks and a count of line feeds: no row for each line."""
    text = F.translate("text", MARK, " ")
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    hits = files.where(F.col("text").rlike(pattern)).select(*keep, parts.alias("__p"))
    odd = hits.withColumn("__i", F.explode(F.sequence(F.lit(2), F.size("__p"), F.lit(2))))
    line = F.aggregate(F.slice("__p", F.lit(1), F.col("__i") - 1), F.lit(1), lambda n, x: n + feeds(x))
    return odd.select(*keep, F.element_at("__p", F.col("__i")).alias("body"), line.alias("line"))


def endpoints(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """repo, path, kind, route, line, symbol: registered entry points, `METHODS route` for HTTP; the symbol is the one that
    follows. Of one symbol and route the first stays."""
    every = None
    for pattern, kind, route, methods in ROUTES:
        found = _places(files, pattern, "repo", "path")
        path = F.regexp_extract("body", pattern, route) if route else F.lit(kind)
        if kind == "http":
            named = F.regexp_extract_all(F.regexp_extract("body", pattern, methods), F.lit("([A-Za-z]+)"), 1) if methods else F.array().cast("array<string>")
            known = F.filter(named, lambda m: F.lower(m) != "request")
            path = F.concat(methods_of(known), F.lit(" "), path)
        part = found.select("repo", "path", F.lit(kind).alias("kind"), path.alias("route"), "line")
        every = part if every is None else every.unionByName(part)
    every = every.groupBy("repo", "path", "kind", "route", "line").agg(F.count(F.lit(1)).alias("n")).drop("n")
    if symbols is None:
        return every.withColumn("symbol", F.lit(None).cast("string"))
    met = following_symbol(every, symbols, ["repo", "path"])
    first = met.groupBy("repo", "path", "symbol", "route").agg(F.min(F.struct("line", "kind")).alias("f"))
    return first.select("repo", "path", "f.kind", "route", "f.line", "symbol")


def access_facts(files: DataFrame) -> DataFrame:
    """repo, path, operation (execute, read, write), detail, unsafe, line: calls that reach a store; unsafe where the
    statement is put together from text."""
    every = None
    for operation, pattern in (("execute", EXECUTE), ("read", READ), ("write", WRITE)):
        # what follows the call, to the end of its line, belongs to it
        found = _places(files, f"(?:{pattern})[^\\n]{{0,2000}}", "repo", "path")
        call = F.regexp_extract("body", r"^\s*([\w.]*[\w])\s*\(?", 1)
        part = found.select("repo", "path", F.lit(operation).alias("operation"), F.element_at(F.split(call, "[.]"), -1).alias("detail"), (F.col("body").rlike(UNSAFE) if operation == "execute" else F.lit(False)).alias("unsafe"), "line")
        every = part if every is None else every.unionByName(part)
    return every


def wiring_facts(files: DataFrame) -> DataFrame:
    """repo, path, route (null: the whole file), target, line: bare names that are registered as guards or handlers."""
    bare = lambda args: F.filter(F.transform(_top_level(args), lambda a: F.trim(a)), lambda a: a.rlike(r"^[A-Za-z_$][\w$]*$"))
    used = _places(files, USE, "repo", "path")
    args = F.concat_ws(",", *[F.nullif(F.regexp_extract("body", USE, i), F.lit("")) for i in range(1, 5)])
    whole = used.select("repo", "path", F.lit(None).cast("string").alias("route"), F.explode(bare(args)).alias("target"), "line")
    routed = _places(files, ROUTE_USE, "repo", "path")
    route = F.concat(F.upper(F.regexp_extract("body", ROUTE_USE, 1)), F.lit(" "), F.regexp_extract("body", ROUTE_USE, 2))
    named = routed.select("repo", "path", route.alias("route"), F.explode(bare(F.regexp_extract("body", ROUTE_USE, 3))).alias("target"), "line")
    both = whole.unionByName(named)
    return both.groupBy("repo", "path", "route", "target").agg(F.min("line").alias("line"))


def _top_level(args: Column) -> Column:
    """Arguments between commas, of a text whose innermost brackets are blotted out before: what they hold is no name."""
    inner = args
    for _ in range(4):  # brackets nest no deeper in a match, which ends at the first closing parenthesis
        inner = F.regexp_replace(inner, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "?")
    return F.split(F.regexp_replace(inner, r"[(\[{].*$", "?"), ",")


def outbound_hosts(text: Column) -> Column:
    """Hosts of URLs in small letters, sorted, each once, but for the machine itself."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(OUTBOUND), 1), F.lower)))


def marks_of(text: Column, has_endpoints: Column, executes: Column) -> Column:
    """The sorted marks of a file or symbol by its text."""
    tests = (
        ("user_controlled_input", text.rlike(USER_INPUT) | has_endpoints), ("trust_boundary", has_endpoints), ("authentication_required", text.rlike(AUTHENTICATION)), ("authorization_required", text.rlike(AUTHORIZATION)),
        ("sensitive_data", text.rlike(SENSITIVE)), ("security_sink", executes | text.rlike(SINK)), ("external_system", text.rlike(OUTBOUND)),
    )
    return F.array_sort(F.array_compact(F.array(*[F.when(test, name) for name, test in tests])))


def file_annotations(files: DataFrame) -> DataFrame:
    """repo, path, annotations, outbound_hosts: the seven marks of each file."""
    routed = F.lit(False)
    for pattern, *_ in ROUTES:
        routed = routed | F.col("text").rlike(pattern)
    return files.select("repo", "path", marks_of(F.col("text"), routed, F.col("text").rlike(EXECUTE)).alias("annotations"), outbound_hosts(F.col("text")).alias("outbound_hosts"))


def symbol_annotations(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo, path, name, annotations: the marks of each symbol's own lines, decorators included."""
    lines = files.select("repo", "path", F.split("text", "\n").alias("__l"))
    met = symbols.join(lines, ["repo", "path"])
    body = F.array_join(F.slice("__l", F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(1))), "\n")
    text = F.concat_ws("\n", "decorators", body) if "decorators" in symbols.columns else body
    return met.withColumn("__t", text).select("repo", "path", "name", marks_of(F.col("__t"), F.lit(False), F.col("__t").rlike(EXECUTE)).alias("annotations"))


def data_categories(files: DataFrame, signals: DataFrame) -> DataFrame:
    """repo, path, categories: categories of which a signal occurs in a text, whatever its case. signals: category, signal;
    a pack, small and broadcast; each text is tested against it once."""
    packed = signals.groupBy("category").agg(F.collect_set("signal").alias("s"))
    met = files.join(F.broadcast(packed), F.exists("s", lambda x: F.contains(F.lower("text"), x)), "left")
    return met.groupBy("repo", "path").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def template_sinks(files: DataFrame, markers: DataFrame) -> DataFrame:
    """repo, path, line, marker: lines of templates that hold a marker (a text, not a pattern), each once."""
    lines = files.select("repo", "path", F.posexplode(F.split("text", "\n")).alias("p", "code"))
    return lines.join(F.broadcast(markers.select("marker")), F.contains("code", F.col("marker"))).select("repo", "path", (F.col("p") + 1).alias("line"), "marker").distinct()


def bound_identifiers(expression: Column) -> Column:
    """Names that an expression shows: the first and last part of each dotted one, of three letters or more, but for noise."""
    words = F.regexp_extract_all(expression, F.lit(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)"), 1)
    ends = F.flatten(F.transform(words, lambda w: F.array(F.split(w, "[.]")[0], F.element_at(F.split(w, "[.]"), -1))))
    return F.array_sort(F.array_distinct(F.filter(ends, lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(*NOISE))))


# ---- symbols, imports and calls

SYMBOL = "struct<name:string,kind:string,line_start:int,line_end:int,decorators:string>"
FACTS = f"symbols array<{SYMBOL}>, imports array<string>, calls array<struct<caller:string,callee:string,line:int>>, parsed boolean"
# Declarations of languages with braces: kind and pattern, the name in the first group.
DECLARATIONS = (
    ("class", re.compile(r"^[ \t]*(?:export\s+)?(?:(?:public|private|protected|abstract|final|static|default)\s+)*(?:class|interface|enum|type)\s+([A-Za-z_$][\w$]*)", re.M)),
    ("function", re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(", re.M)),
    ("function", re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*=>", re.M)),
    ("function", re.compile(r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(", re.M)),
    ("function", re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|synchronized|abstract|override)\s+)+[\w<>\[\],.? ]+?\s([A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}]*\{", re.M)),
)
IMPORT = re.compile(r"^[ \t]*(?:import\b[^\n;]*|from\s+\S+\s+import\b[^\n]*|[^\n]*\brequire\s*\([^\n]*)", re.M)
CALL = re.compile(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
KEYWORDS = frozenset("if for while switch catch return function new typeof await super constructor class def elif with and or not in is lambda func go defer range select".split())
MOST_IMPORT = 200


def python_facts(text: str) -> tuple[list, list, list, bool]:
    """Symbols, imports and calls of a Python text, from its syntax tree; nothing and False where it has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], [], [], False
    lines, symbols, imports, calls = text.split("\n"), [], [], []

    def walk(node: ast.AST, inside: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            name = inside
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = child.name
                marks = sorted({lines[d.lineno - 1].strip() for d in child.decorator_list})
                symbols.append((name, "class" if isinstance(child, ast.ClassDef) else "function", child.lineno, child.end_lineno, "\n".join(marks)))
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                imports.append(ast.unparse(child)[:MOST_IMPORT])
            elif isinstance(child, ast.Call):
                calls.append((inside, ast.unparse(child.func), child.lineno))
            walk(child, name)

    try:
        walk(tree, None)
    except RecursionError:
        return [], [], [], False
    return symbols, imports, calls, True


def brace_facts(text: str) -> tuple[list, list, list, bool]:
    """As `python_facts` for languages with braces: declarations by pattern, their ends by matching braces outside of
    strings and comments. A declaration without a body is its own line."""
    blank = re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    line_at = lambda at: blank.count("\n", 0, at) + 1
    symbols, spans = [], []
    for kind, pattern in DECLARATIONS:
        for m in pattern.finditer(blank):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            depth, at = 0, blank.find("{", m.end() - 1 if m[0].endswith("{") else m.end())
            stop = blank.find(";", m.end())
            end = m.end()
            if at >= 0 and not 0 <= stop < at:
                for end in range(at, len(blank)):
                    depth += {"{": 1, "}": -1}.get(blank[end], 0)
                    if not depth:
                        break
            if not any(s[:2] == (m[1], line_at(start)) for s in spans):
                spans.append((m[1], line_at(start), line_at(end), kind))
                symbols.append((m[1], kind, line_at(start), line_at(end), ""))
    around = lambda line: min(((z - a, n) for n, a, z, k in spans if k == "function" and a <= line <= z), default=(0, None))[1]
    own = {(n, a) for n, a, _, _ in spans}
    calls = [(around(line), m[1], line) for m in CALL.finditer(blank) for line in [line_at(m.start())] if m[1] not in KEYWORDS and (m[1], line) not in own]
    return sorted(symbols, key=lambda s: s[2]), [m[0].strip()[:MOST_IMPORT] for m in IMPORT.finditer(text)], calls, True


def facts(files: DataFrame) -> DataFrame:
    """files with symbols, imports, calls and parsed. Python goes by its syntax tree, languages with braces by declarations;
    others, and what cannot be read, have nothing and are not parsed. One Arrow batch at a time, a row for each file."""

    @F.pandas_udf(f"struct<{FACTS.replace('symbols ', 'symbols:').replace('imports ', 'imports:').replace('calls ', 'calls:').replace('parsed ', 'parsed:')}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for languages, texts in batches:
            rows = []
            for language, text in zip(languages, texts, strict=True):
                read = python_facts if language == "python" else brace_facts if language in ("javascript", "typescript", "tsx", "go", "java") else None
                symbols, imports, calls, ok = read(text or "") if read else ([], [], [], False)
                named = [dict(zip(("name", "kind", "line_start", "line_end", "decorators"), s, strict=True)) for s in symbols]
                rows.append((named, imports, [dict(zip(("caller", "callee", "line"), c, strict=True)) for c in calls], ok))
            yield pd.DataFrame(rows, columns=["symbols", "imports", "calls", "parsed"])

    return files.withColumn("__f", run("language", "text")).select(*[c for c in files.columns if c != "parsed"], "__f.*")


def symbols_of(parsed: DataFrame) -> DataFrame:
    """repo, path, name, kind, line_start, line_end, decorators, id of what `facts` found."""
    from sievework.functions.scalars import node_id

    rows = parsed.select("repo", "path", F.inline("symbols"))
    return rows.withColumn("id", node_id(F.col("repo"), F.col("path"), F.col("name")))


def calls_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo", "path", F.inline("calls"))


def build_graph(files: DataFrame, guard_names: str = r"guard\w+|authenticat\w+|authoriz\w+") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved registrations) of files (repo, path, language, file_class, text): files, symbols, entry
    points and stores; what contains, calls, handles, reads and writes what; guards that nothing attaches are marked."""
    from sievework.functions.scalars import node_id
    from sievework.operators import code_graph as cg

    parsed = facts(files)
    symbols = symbols_of(parsed)
    points = endpoints(files, symbols).withColumn("id", node_id(F.col("repo"), F.col("path"), F.concat(F.lit("@"), "route")))
    marks = file_annotations(files)
    none = F.lit(None).cast("string")
    shape = lambda df, kind, symbol, route, annotations, seq: df.select("id", "repo", "path", F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), symbol.alias("symbol"), route.alias("route"), annotations.alias("annotations"), F.lit(seq).alias("seq"))
    nodes = shape(marks.withColumn("id", node_id(F.col("repo"), F.col("path"))), "file", none, none, F.col("annotations"), 0)
    own = symbols.join(symbol_annotations(files, symbols).distinct(), ["repo", "path", "name"])
    nodes = nodes.unionByName(shape(own, F.col("kind"), F.col("name"), none, F.col("annotations"), 1))
    nodes = nodes.unionByName(shape(points, "endpoint", F.col("symbol"), F.col("route"), F.array(F.lit("trust_boundary"), F.lit("user_controlled_input")), 2))
    at = access_facts(files).join(symbols.select("repo", "path", F.col("name").alias("symbol"), "line_start", "line_end"), ["repo", "path"]).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    stores, touched = cg.data_access(at.select("repo", "path", "symbol", "operation", "detail"), symbols)
    nodes = cg.upsert_nodes(nodes.unionByName(shape(stores, "datastore", F.col("symbol"), none, F.col("annotations"), 3)))
    contains = symbols.select(node_id(F.col("repo"), F.col("path")).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type"), F.lit(False).alias("cross_repo"), none.alias("resolution"))
    wired, missing = cg.resolve_wiring(wiring_facts(files), symbols, points)
    edges = contains.unionByName(cg.resolve_calls(calls_of(parsed), symbols)).unionByName(cg.handler_edges(points, nodes)).unionByName(wired).unionByName(touched).distinct()
    return cg.with_unattached(nodes, edges, guard_names), edges, missing
