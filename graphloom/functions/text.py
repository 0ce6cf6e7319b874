"""Scalar expressions over paths, urls, source text and questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that a scan leaves out.
IGNORED_DIRS = [
    "node_modules", "dist", "build", "venv", ".venv", "env", ".env", ".next",
    ".git", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", "target", "vendor", ".idea",
    ".vscode", "coverage", ".nyc_output",
]

# Languages by suffix, and further suffixes that count as code.
SUFFIX_LANGUAGE = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript",
    ".tsx": "TypeScript", ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".scala": "Scala", ".groovy": "Groovy",
    ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".hpp": "C++", ".hh": "C++", ".c": "C",
    ".h": "C", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".swift": "Swift",
    ".cs": "C#", ".fs": "F#", ".vb": "Visual Basic", ".vue": "Vue", ".svelte": "Svelte", ".lua": "Lua",
    ".r": "R", ".sql": "SQL", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".ps1": "PowerShell",
    ".dart": "Dart", ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".hrl": "Erlang", ".clj": "Clojure",
    ".cljs": "Clojure", ".hs": "Haskell", ".ml": "OCaml", ".mli": "OCaml",
}
PLAIN_SUFFIXES = [
    ".toml", ".yaml", ".yml", ".json", ".md", ".rst",
]
CODE_SUFFIXES = sorted({*SUFFIX_LANGUAGE, *PLAIN_SUFFIXES})

# Grammars by suffix, then by language; python when nothing fits.
SUFFIX_GRAMMAR = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript",
    ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".hpp": "cpp", ".c": "c", ".h": "c", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".cs": "c_sharp",
}
GRAMMAR_NAMES = {
    "c++": "cpp", "c#": "c_sharp", "python": "python", "javascript": "javascript", "typescript": "typescript", "java": "java",
    "go": "go", "rust": "rust", "c": "c", "ruby": "ruby", "php": "php", "kotlin": "kotlin",
    "scala": "scala",
}

# Words of questions about structure and about content.
GRAPH_WORDS = ["call chain", "calls", "dependency", "dependencies", "imports", "extends", "implements", "architecture", "layer", "relationship", "who calls", "what calls"]
CONTENT_WORDS = ["where is", "how does", "explain", "what is", "show me", "find", "configured", "implementation"]

# Patterns of suspect code, the first that matches counts.
BUG_PATTERNS = {
    "bare_except": r"except\s*:\s*\n",
    "swallowed_exception": r"except[^:\n]+:\s*pass\b",
    "todo_fixme": r"(?i)\b(TODO|FIXME|HACK|XXX)\b",
    "hardcoded_secret": r"""(?i)(api[_-]?key|password|secret)\s*=\s*['"][^'"]+['"]""",
    "empty_catch": r"catch\s*\([^)]*\)\s*\{\s*\}",
}

REPOSITORY_URL = r"^(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"

# Starts of module names that are the project's own.
OWN_PREFIXES = ["app.", "src.", "lib.", "backend.", "frontend.", "services."]


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def count_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words))


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def directory(path: Column) -> Column:
    """The parent directory, `.` at the top."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", F.lit(".")).otherwise(parent)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    return F.coalesce(lookup(SUFFIX_LANGUAGE, suffix(path)), F.lit("Other"))


def is_code(path: Column) -> Column:
    return suffix(path).isin(CODE_SUFFIXES)


def in_ignored_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*(F.lit(d) for d in IGNORED_DIRS)))


def grammar(path: Column, label: Column) -> Column:
    return F.coalesce(lookup(SUFFIX_GRAMMAR, suffix(path)), lookup(GRAMMAR_NAMES, F.lower(label)), F.lit("python"))


def is_external(module: Column, marker: Column) -> Column:
    """Whether an imported module is from outside of the project that `marker` names (null: unknown)."""
    marked = F.coalesce(marker, F.lit("")) != ""
    return (
        F.when(F.coalesce(module, F.lit("")) == "", True)
        .when(module.startswith("."), False)
        .when(marked & F.contains(F.replace(module, F.lit("/"), F.lit(".")), marker), False)
        .when(reduce(lambda a, b: a | b, (module.startswith(p) for p in OWN_PREFIXES)), False)
        .when(~F.contains(module, F.lit(".")) & marked, ~F.contains(marker, module))
        .otherwise(True)
    )


def line_count(text: Column) -> Column:
    """Lines of a text; a last line needs no line end, an empty text has none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1))


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included, clamped); empty for start <= 0."""
    lines = F.split(text, "\n")
    first = F.greatest(start, F.lit(1))
    return F.when(start <= 0, "").otherwise(F.array_join(F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0))), "\n"))


def complexity_label(score: Column) -> Column:
    return F.when(score <= 5, "low").when(score <= 12, "medium").otherwise("high")


def complexity_weight(label: Column) -> Column:
    return F.when(label == "high", 15).when(label == "medium", 8).otherwise(3)


def layer(path: Column) -> Column:
    """Architecture layer of a path, by its first fitting word."""
    p = F.lower(path)
    return (
        F.when(any_of(p, ["route", "controller", "handler", "api/"]), "presentation")
        .when(any_of(p, ["service", "usecase", "domain"]), "business")
        .when(any_of(p, ["model", "repository", "db", "schema", "migration"]), "data")
        .when(any_of(p, ["util", "helper", "config"]), "infrastructure")
        .otherwise("other")
    )


def call_layer(path: Column) -> Column:
    """The coarser layers that calls are looked at by."""
    p = F.lower(path)
    return F.when(any_of(p, ["route", "controller"]), "presentation").when(any_of(p, ["service"]), "business").when(any_of(p, ["model", "db"]), "data").otherwise("other")


def path_group(path: Column, label: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(label == "ExternalLibrary", "external")
        .when(any_of(p, ["route", "controller", "api/", "handler"]), "api")
        .when(any_of(p, ["service"]), "service")
        .when(any_of(p, ["util", "helper", "config"]), "util")
        .otherwise("core")
    )


def snake_case(name: Column) -> Column:
    """An underscore before each capital but the first character."""
    return F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))


def slugify(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def diagram_id(value: Column) -> Column:
    clean = F.regexp_replace(F.trim(value), "[^a-zA-Z0-9_]", "_")
    clean = F.when(clean == "", "node").otherwise(clean)
    return F.substring(F.when(clean.rlike("^[0-9]"), F.concat(F.lit("n_"), clean)).otherwise(clean), 1, 48)


def _one_line(value: Column, most: int) -> Column:
    return F.substring(F.trim(F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))), 1, most)


def diagram_quote(value: Column) -> Column:
    return F.concat(F.lit('"'), _one_line(value, 120), F.lit('"'))


def diagram_label(value: Column) -> Column:
    text = _one_line(value, 80)
    return F.when(text.rlike(r"[/\[\]():|]"), F.concat(F.lit('["'), text, F.lit('"]'))).otherwise(F.concat(F.lit("["), F.when(text == "", "node").otherwise(text), F.lit("]")))


def diagram_method(name: Column) -> Column:
    clean = F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), "[^a-zA-Z0-9_]", "_"), 1, 40)
    return F.when(clean == "", "method").otherwise(clean)


def cache_key(*parts: Column) -> Column:
    clean = F.transform(F.array(*parts), lambda p: F.replace(F.coalesce(p, F.lit("")), F.lit(":"), F.lit("_")))
    return F.array_join(F.filter(clean, lambda p: p != ""), ":")


def fingerprint(name: Column, kind: Column, lines: Column) -> Column:
    shape = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return F.substring(F.sha1(F.concat(shape, F.lit("|"), kind, F.lit(":"), lines.cast("string"))), 1, 12)


def first_bug_pattern(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(BUG_PATTERNS.items()):
        out = F.when(code.rlike(pattern), name).otherwise(out)
    return out


def strategy(question: Column) -> Column:
    """graph, vector or hybrid: the side that clearly has more of its words."""
    graph, content = count_of(F.lower(question), GRAPH_WORDS), count_of(F.lower(question), CONTENT_WORDS)
    return F.when((graph > content) & (graph >= 2), "graph").when((content > graph) & (content >= 2), "vector").otherwise("hybrid")


def symbol_candidates(question: Column) -> Column:
    """At most eight distinct names: capitalised words, back-ticked names, snake case."""
    edge = r"(?<![A-Za-z0-9_])"
    found = F.concat(
        F.regexp_extract_all(question, F.lit(edge + r"([A-Z][A-Za-z0-9_]*)"), F.lit(1)),
        F.regexp_extract_all(question, F.lit(r"`([A-Za-z_][A-Za-z0-9_.]*)`"), F.lit(1)),
        F.regexp_extract_all(question, F.lit(edge + r"([a-z_][a-z0-9_]*_[a-z0-9_]+)(?![A-Za-z0-9_])"), F.lit(1)),
    )
    return F.slice(F.array_distinct(found), 1, 8)


def plan_tools(question: Column) -> Column:
    """Tools that answer a question, in order, at most six."""
    # Words of questions, and the tools that answer them, in this order.
    q = F.lower(question)
    symbol = F.coalesce(F.get(symbol_candidates(question), F.lit(0)), F.lit("")) != ""
    overview = any_of(q, [
        "how does this project", "how does the project", "how this project", "how it work", "what is this project", "what does this project", "project work",
        "overview", "how does this repo", "how does this app",
    ])

    def when(condition, *tools):
        return F.when(condition, F.array(*(F.lit(t) for t in tools))).otherwise(F.array().cast("array<string>"))

    steps = F.concat(
        when(overview, "generate_architecture", "trace_request_flow", "search_code"),
        when(any_of(q, ["architecture", "layer", "structure"]), "generate_architecture"),
        when(any_of(q, ["call chain", "request flow", "endpoint", "route", "api"]), "trace_request_flow"),
        when(any_of(q, ["depend", "import", "uses"]) & symbol, "analyze_dependency"),
        when(any_of(q, ["bug", "issue", "smell", "vulnerability", "anti-pattern"]), "find_bug_patterns"),
        when(symbol & any_of(q, ["explain", "how does", "what does"]), "explain_function"),
    )
    steps = F.when(F.size(steps) == 0, F.array(F.lit("search_code"))).otherwise(steps)
    steps = F.when(F.size(steps) < 2, F.concat(F.array(F.lit("search_graph")), steps)).when(~F.array_contains(steps, "search_code"), F.concat(steps, F.array(F.lit("search_code")))).otherwise(steps)
    return F.slice(steps, 1, 6)


def event_frame(event: Column, data: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def text_slices(text: Column, size: int) -> Column:
    """The text in slices of `size` characters."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, (i - 1) * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _balanced_end(text: Column) -> Column:
    """How many characters of a text that starts with a brace belong to it, null if it never closes.

    One fold over the characters knows strings and escapes."""
    none = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        plain = ~a["quoted"]
        depth = a["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        closed = F.when((a["end"] == 0) & plain & (c == "}") & (depth == 0), a["at"] + 1).otherwise(a["end"])
        quoted = F.when((c == '"') & ~a["escaped"], ~a["quoted"]).otherwise(a["quoted"])
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), (a["quoted"] & (c == "\\") & ~a["escaped"]).alias("escaped"), (a["at"] + 1).alias("at"), closed.alias("end"))

    end = F.aggregate(F.split(text, "(?!^)"), none, step, lambda a: a["end"])
    return F.when(end > 0, end)


def repaired_json(answer: Column, tries: int = 3) -> Column:
    """The JSON in an answer: all of it without a fence around, or the first of a few objects in it that is complete and valid; else null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull() & (t != ""), t)
    starts = F.slice(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare), F.lit(1))), lambda i: F.when(F.substring(bare, i, F.lit(1)) == "{", i)), lambda i: i.isNotNull()), 1, tries)
    objects = F.transform(starts, lambda i: F.substring(bare, i, F.length(bare)))
    objects = F.transform(objects, lambda t: F.substring(t, F.lit(1), _balanced_end(t)))
    return F.coalesce(valid(bare), F.get(F.filter(F.transform(objects, valid), lambda t: t.isNotNull()), F.lit(0)))


def imports_text(imports: Column) -> Column:
    """A line for each import (module, names): from a module its names, or the module or the names alone."""

    def line(i: Column) -> Column:
        names = F.array_join(F.coalesce(i["names"], F.array().cast("array<string>")), ", ")
        return F.when(F.coalesce(i["module"], F.lit("")) == "", F.concat(F.lit("import "), names)).when(names == "*", F.concat(F.lit("import "), i["module"])).otherwise(F.concat(F.lit("from "), i["module"], F.lit(" import "), names))

    return F.coalesce(F.array_join(F.transform(imports, line), "\n"), F.lit(""))


def or_null(value: Column) -> Column:
    """A trimmed text, null where nothing is left."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def with_references(answer: Column, files: Column, names: Column) -> Column:
    """An answer, with six files and six functions behind it where it mentions none of the first three; an empty one stays empty."""
    body = F.trim(answer)
    quoted = lambda a: F.array_join(F.transform(F.slice(a, 1, 6), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    silent = lambda a: (F.size(a) > 0) & ~F.exists(F.slice(a, 1, 3), lambda x: F.contains(body, x))
    part = lambda a, title: F.when(silent(a), F.concat(F.lit(f"\n\n**{title} referenced:** "), quoted(a))).otherwise("")
    return F.when(body == "", "").otherwise(F.concat(body, part(files, "Files"), part(names, "Functions")))


def compact(number: Column) -> Column:
    """A number with at most one decimal place and K, M, B or T behind it."""
    size = F.abs(number)
    power = F.when(size >= 999_950_000_000, 4).when(size >= 999_950_000, 3).when(size >= 999_950, 2).when(size >= 999.95, 1).otherwise(0)
    short = F.round(number / F.pow(F.lit(1000.0), power), 1)
    digits = F.when(short == F.round(short), F.format_string("%.0f", short)).otherwise(F.format_string("%.1f", short))
    return F.concat(digits, F.element_at(F.array(*map(F.lit, ["", "K", "M", "B", "T"])), power + 1))


def initials(name: Column) -> Column:
    """The first letters of the first two parts of a name, in capitals."""
    parts = F.filter(F.split(name, r"[\s/_-]+"), lambda p: p != "")
    return F.upper(F.array_join(F.transform(F.slice(parts, 1, 2), lambda p: F.substring(p, 1, 1)), ""))
