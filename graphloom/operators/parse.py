"""Source text to nested symbol records.

Each file is parsed by itself inside of a task: Python with the standard `ast`, scripts
(JavaScript, TypeScript) and other languages with a scanner that blanks strings and
comments and matches brackets.  A file that cannot be parsed gives a row with the reason
in parse_error and empty lists; it stops nothing.

What the records mean: functions are top-level ones, methods stand in their class (also
decorated ones); a call has the attribute's name and the text before it as its receiver;
`from m import a` has the names that it imports; complexity counts 1 and every decision.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.sources.cache import PARSED

# Verbs that make a decorator or a call a route.
VERBS = ("get", "post", "put", "patch", "delete", "options", "head")

# How functions and classes begin in other languages.
OTHER_FUNCTIONS = {
    "go": r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "ruby": r"^\s*def\s+(?:self\.)?(\w+[?!]?)",
    "php": r"^\s*(?:(?:public|private|protected|static)\s+)*function\s+(\w+)\s*\(", "kotlin": r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(",
    "swift": r"^\s*(?:\w+\s+)*func\s+(\w+)", "scala": r"^\s*(?:\w+\s+)*def\s+(\w+)",
}
BRACE_FUNCTION = r"^\s*(?!(?:if|for|while|switch|return|else|catch|new|throw)\b)(?:[\w<>\[\],*&:~]+\s+)+[*&]?(\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:throws\s+[\w.,\s]+)?\{"
CLASS_LINE = r"^\s*(?:(?:public|private|protected|internal|abstract|final|sealed|static|export|pub|open|data|partial)\s+)*(?:class|struct|interface|trait|impl|enum|object|type)\s+(\w+)"


def empty_record(path: str, language: str, error: str | None = None) -> dict:
    return {"file": path, "language": language, "functions": [], "classes": [], "imports": [], "api_endpoints": [], "calls": [], "metadata": {"complexity": "low", "lines": 0, "symbol_count": 0}, "parse_error": error}


def label_of(score: int) -> str:
    return "low" if score <= 5 else "medium" if score <= 12 else "high"


def count_lines(text: str) -> int:
    return text.count("\n") + (0 if text.endswith("\n") or not text else 1)


def external(module: str, marker: str | None) -> bool:
    if not module:
        return True
    if module.startswith(".") or module.startswith(tuple(T.OWN_PREFIXES)) or marker and marker in module.replace("/", "."):
        return False
    return not (marker and "." not in module and module in marker)


# Python

_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.match_case, ast.IfExp)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def decisions(tree: ast.AST) -> int:
    return sum(isinstance(n, _DECISIONS) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(tree))


def _python_function(node, owner: str | None = None) -> dict:
    every = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
    return {
        "name": node.name, "parameters": [{"name": a.arg, "type": ast.unparse(a.annotation) if a.annotation else None} for a in every],
        "return_type": ast.unparse(node.returns) if node.returns else None, "start_line": node.lineno, "end_line": node.end_lineno, "docstring": ast.get_docstring(node, clean=False),
        "is_method": owner is not None, "class_name": owner, "body_score": 1 + decisions(node),
    }


def _target(func: ast.expr) -> tuple[str, str | None]:
    if isinstance(func, ast.Attribute):
        return func.attr, ast.unparse(func.value)
    return (func.id, None) if isinstance(func, ast.Name) else ("", None)


def _python_endpoints(node) -> Iterator[dict]:
    for d in node.decorator_list:
        if not isinstance(d, ast.Call):
            continue
        verb, _ = _target(d.func)
        route = next((a.value for a in d.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)
        if route is None:
            continue
        if verb in VERBS:
            yield {"route": route, "method": verb.upper(), "handler": node.name, "start_line": node.lineno}
        elif verb == "route":
            listed = [e.value for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple, ast.Set)) for e in k.value.elts if isinstance(e, ast.Constant)]
            yield {"route": route, "method": str(listed[0]).upper() if listed else "GET", "handler": node.name, "start_line": node.lineno}


def parse_python(path: str, text: str, marker: str | None) -> dict:
    out = empty_record(path, "Python")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        out = scan_other(path, text, "Python", "python")
        out["parse_error"] = f"{type(e).__name__}: {e}"
        return out
    for node in tree.body:
        if isinstance(node, _DEFS):
            out["functions"].append(_python_function(node))
            out["api_endpoints"] += _python_endpoints(node)
        elif isinstance(node, ast.ClassDef):
            methods = [n for n in node.body if isinstance(n, _DEFS)]
            names = [t.id for n in node.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)] + [n.target.id for n in node.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)]
            out["classes"].append({
                "name": node.name, "methods": [_python_function(m, node.name) for m in methods], "bases": [ast.unparse(b) for b in node.bases], "implements": [], "attributes": names,
                "start_line": node.lineno, "end_line": node.end_lineno, "docstring": ast.get_docstring(node, clean=False),
            })
            for m in methods:
                out["api_endpoints"] += _python_endpoints(m)
        elif isinstance(node, ast.Import):
            out["imports"] += [{"module": a.name, "names": [a.name.split(".")[-1]], "is_external": external(a.name, marker), "start_line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            out["imports"].append({"module": module, "names": [a.name for a in node.names], "is_external": external(module, marker), "start_line": node.lineno})
    seen = set()

    def calls(node, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _DEFS):
                name = f"{owner}.{child.name}" if owner else child.name
                for c in ast.walk(child):
                    if isinstance(c, ast.Call):
                        callee, receiver = _target(c.func)
                        if callee and (name, callee, c.lineno) not in seen:
                            seen.add((name, callee, c.lineno))
                            out["calls"].append({"caller": child.name, "callee": callee, "receiver": receiver, "start_line": c.lineno, "is_method_call": receiver is not None})
                calls(child, owner)
            else:
                calls(child, child.name if isinstance(child, ast.ClassDef) else owner)

    calls(tree, None)
    return _finish(out, text, 1 + decisions(tree))


def _finish(out: dict, text: str, score: int) -> dict:
    symbols = len(out["functions"]) + len(out["classes"]) + sum(len(c["methods"]) for c in out["classes"])
    out["metadata"] = {"complexity": label_of(score), "lines": count_lines(text), "symbol_count": symbols}
    return out


# scripts

_BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def blanked(text: str) -> str:
    """The text with strings and comments as blanks, every line and column in its place."""
    return _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int) -> int:
    """Place of the bracket that closes the one at `at` (the end, if none does)."""
    opens, closes = text[at], {"(": ")", "{": "}", "[": "]"}[text[at]]
    depth = 0
    for m in re.compile("[" + re.escape(opens + closes) + "]").finditer(text, at):
        depth += 1 if m[0] == opens else -1
        if not depth:
            return m.start()
    return len(text) - 1


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _parameters(inside: str) -> list[dict]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(inside + ","):
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        elif c == "," and depth <= 0:
            m = re.match(r"\s*(?:public |private |readonly |\.\.\.)*(\w+)\??\s*(?::\s*([^=]+))?", inside[start:i])
            if m:
                out.append({"name": m[1], "type": m[2].strip() if m[2] else None})
            start = i + 1
    return out


_SCRIPT_DEFS = re.compile(r"\bfunction\s*\*?\s*([\w$]+)\s*(?:<[^>]*>)?\s*(\()|\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:(\()|([\w$]+)\s*=>)")
_SCRIPT_CLASS = re.compile(r"\bclass\s+([\w$]+)([^{]*)\{")
_SCRIPT_METHOD = re.compile(r"(?:^|[;}\n])\s*(?:(?:public|private|protected|static|async|override|get|set|readonly)\s+)*\*?\s*(#?[\w$]+)\s*(?:<[^>]*>)?\s*(\()")
_SCRIPT_CALL = re.compile(r"(?:([\w$.]+)\s*\??\.\s*)?(?<![\w$])([\w$]+)\s*\(")
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "super", "await", "constructor", "import", "new"}
_SCRIPT_DECISION = re.compile(r"\bif\b|\bfor\b|\bwhile\b|\bcatch\b|\bcase\b|\?(?![.?:])|&&|\|\|")


def parse_script(path: str, text: str, language: str, marker: str | None) -> dict:
    out = empty_record(path, language)
    plain = blanked(text)
    spans = []

    def function(name: str, start: int, open_at: int | None, owner: str | None = None) -> dict:
        end_head = closing(plain, open_at) if open_at is not None else start
        rest = re.compile(r"\s*(?::\s*([^={;]+))?\s*(?:=>\s*)?(\{)?").match(plain, end_head + 1 if open_at is not None else plain.index("=>", start))
        body = rest.start(2) if rest and rest[2] else None
        end = closing(plain, body) if body is not None else (plain.find("\n", start) if plain.find("\n", start) >= 0 else len(plain) - 1)
        return {
            "name": name, "parameters": _parameters(plain[open_at + 1 : end_head]) if open_at is not None else [], "return_type": rest[1].strip() if rest and rest[1] and rest[1].strip() else None,
            "start_line": _line(plain, start), "end_line": _line(plain, end), "docstring": None, "is_method": owner is not None, "class_name": owner,
            "body_score": 1 + len(_SCRIPT_DECISION.findall(plain[start:end])), "_span": (start, end),
        }

    for m in _SCRIPT_CLASS.finditer(plain):
        open_at, name = m.end() - 1, m[1]
        end = closing(plain, open_at)
        ext, imp = re.search(r"\bextends\s+([\w$.]+)", m[2]), re.search(r"\bimplements\s+([\w$.,\s]+)", m[2])
        methods, at = [], open_at + 1
        while hit := _SCRIPT_METHOD.search(plain, at, end):
            after = re.compile(r"\s*(?::[^{;]+)?\{").match(plain, closing(plain, hit.start(2)) + 1)
            if after and hit[1] not in _NOT_CALLED - {"constructor"}:
                made = function(hit[1], hit.start(1), hit.start(2), name)
                methods.append(made)
                at = max(made["_span"][1], hit.end())
            else:
                at = hit.end()
        fields = re.findall(r"(?m)^\s*(?:(?:public|private|protected|static|readonly)\s+)*([\w$]+)\s*(?:[?!]?:\s*[^=;({]+)?(?:=[^=>][^;]*)?;", plain[open_at + 1 : end])
        spans.append((m.start(), end))
        out["classes"].append({"name": name, "methods": methods, "bases": [ext[1]] if ext else [], "implements": [x.strip() for x in imp[1].split(",") if x.strip()] if imp else [], "attributes": fields, "start_line": _line(plain, m.start()), "end_line": _line(plain, end), "docstring": None})
    for m in _SCRIPT_DEFS.finditer(plain):
        if any(a < m.start() < b for a, b in spans):
            continue
        open_at = m.start(2) if m[1] else m.start(4) if m[4] else None
        if m[3] and m[4] and not re.compile(r"\s*(?::[^=]+)?=>").match(plain, closing(plain, m.start(4)) + 1):
            continue
        out["functions"].append(function(m[1] or m[3], m.start(), open_at))
    for m in re.finditer(r"""(?m)^\s*import\s+(?:type\s+)?(?:([^'";]+?)\s+from\s+)?['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]\s*\)""", text):
        if m[3] and not plain[m.start() : m.start() + 7] == "require":
            continue
        module = m[2] or m[3]
        names = [x for x in re.findall(r"[\w$]+", m[1] or "") if x not in ("as", "type")] or ["default"]
        out["imports"].append({"module": module, "names": names, "is_external": external(module, marker), "start_line": _line(text, m.start())})
    for m in re.finditer(r"""\b[\w$]+\.(get|post|put|patch|delete|options|head)\(\s*['"`](/?[^'"`]*)['"`]\s*(?:,\s*([\w$.]+|(?:async\s*)?\(|(?:async\s+)?function))?""", text):
        if plain[m.start()] == " ":
            continue
        handler = m[3] or ""
        out["api_endpoints"].append({"route": m[2], "method": m[1].upper(), "handler": "<anonymous>" if "(" in handler or "function" in handler or "async" in handler else handler, "start_line": _line(text, m.start())})
    seen = set()
    for f in [*out["functions"], *(x for c in out["classes"] for x in c["methods"])]:
        a, b = f.pop("_span")
        head = plain.find("{", a, b)
        for m in _SCRIPT_CALL.finditer(plain, head if head >= 0 else a, b):
            key = (f["name"], m[2], _line(plain, m.start(2)))
            if m[2] not in _NOT_CALLED and key not in seen:
                seen.add(key)
                out["calls"].append({"caller": f["name"], "callee": m[2], "receiver": m[1], "start_line": key[2], "is_method_call": m[1] is not None})
    return _finish(out, text, 1 + len(_SCRIPT_DECISION.findall(plain)))


# other languages

def scan_other(path: str, text: str, language: str, grammar: str) -> dict:
    """Functions and classes by their first lines; methods are among the functions."""
    out = empty_record(path, language)
    indented = grammar in ("python", "ruby")
    plain = text if indented else blanked(text)
    lines = plain.split("\n")
    if grammar == "python":
        function, class_ = r"^\s*(?:async\s+)?def\s+(\w+)", r"^\s*class\s+(\w+)"
    else:
        function, class_ = OTHER_FUNCTIONS.get(grammar, BRACE_FUNCTION), CLASS_LINE
    offset, seen = 0, set()
    for number, line in enumerate(lines, 1):
        for pattern, kind in ((class_, "classes"), (function, "functions")):
            m = re.match(pattern, line)
            if not m or (m[1], number) in seen:
                continue
            seen.add((m[1], number))
            if indented:
                depth = len(line) - len(line.lstrip())
                later = (n for n in range(number, len(lines)) if lines[n].strip() and len(lines[n]) - len(lines[n].lstrip()) <= depth)
                end = next(later, len(lines)) + (1 if grammar == "ruby" else 0)
            else:
                brace = plain.find("{", offset)
                stop = plain.find(";", offset)
                end = _line(plain, closing(plain, brace)) if brace >= 0 and not 0 <= stop < brace else number
            record = {"name": m[1], "start_line": number, "end_line": min(end, len(lines)), "docstring": None}
            if kind == "functions":
                record |= {"parameters": [], "return_type": None, "is_method": False, "class_name": None, "body_score": 1}
            else:
                record |= {"methods": [], "bases": [], "implements": [], "attributes": []}
            out[kind].append(record)
            break
        offset += len(line) + 1
    return _finish(out, text, 1 + len(_SCRIPT_DECISION.findall(plain)))


def parse_text(path: str, text: str, language: str, grammar: str, marker: str | None = None) -> dict:
    try:
        if grammar == "python" and path.lower().endswith(".py"):
            return parse_python(path, text, marker) | {"language": language}
        if grammar in ("javascript", "typescript", "tsx"):
            return parse_script(path, text, language, marker)
        if grammar == "python":
            return empty_record(path, language) | {"metadata": {"complexity": "low", "lines": count_lines(text), "symbol_count": 0}}
        return scan_other(path, text, language, grammar)
    except Exception as e:  # a file that breaks the parser is a row with an error
        return empty_record(path, language, f"{type(e).__name__}: {e}")


def parse(files: DataFrame, marker: str | None = None) -> DataFrame:
    """Nested records (`cache.PARSED`) of files (path, language, content); null content is empty."""

    def give(frames):
        for frame in frames:
            rows = [parse_text(p, c or "", lang, g, marker) for p, c, lang, g in zip(frame["path"], frame["content"], frame["language"], frame["grammar"])]
            yield pd.DataFrame(rows, columns=["file", "language", "functions", "classes", "imports", "api_endpoints", "calls", "metadata", "parse_error"])

    rows = files.select("path", "language", F.coalesce("content", F.lit("")).alias("content"), T.grammar(F.col("path"), F.col("language")).alias("grammar"))
    return rows.mapInPandas(give, PARSED)


def summary(parsed: DataFrame) -> DataFrame:
    """files, symbols, endpoints, errors of parsed files, as one row."""
    return parsed.agg(F.count("*").alias("files"), F.sum("metadata.symbol_count").alias("symbols"), F.sum(F.size("api_endpoints")).alias("endpoints"), F.count("parse_error").alias("errors"))
