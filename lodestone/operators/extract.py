"""Facts from source texts: languages, lines, imports, symbols, links, chunks.

Line and pattern counts are column expressions.  Only Python's syntax tree needs Python: a small
``mapInPandas`` that parses and never runs the text."""

from __future__ import annotations

import ast
import bisect
import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.exprs import basename, effective
from lodestone.operators.scripts import parse_scripts

# Languages by suffix and by whole name.
LANGUAGES = {
    "py": "python",
    "pyi": "python",
    "js": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "jsx": "javascriptreact",
    "ts": "typescript",
    "mts": "typescript",
    "cts": "typescript",
    "tsx": "typescriptreact",
    "css": "css",
    "scss": "scss",
    "sass": "sass",
    "less": "less",
    "html": "html",
    "htm": "html",
    "vue": "vue",
    "svelte": "svelte",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "kt": "kotlin",
    "kts": "kotlin",
    "rb": "ruby",
    "php": "php",
    "cs": "csharp",
    "c": "c",
    "h": "c",
    "cc": "cpp",
    "cpp": "cpp",
    "cxx": "cpp",
    "hpp": "cpp",
    "swift": "swift",
    "sh": "shell",
    "bash": "shell",
    "zsh": "shell",
    "fish": "shell",
    "sql": "sql",
    "graphql": "graphql",
    "gql": "graphql",
    "proto": "protobuf",
    "json": "json",
    "jsonc": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "toml": "toml",
    "ini": "ini",
    "cfg": "ini",
    "xml": "xml",
    "md": "markdown",
    "mdx": "markdown",
    "rst": "rst",
    "txt": "text",
    "tf": "terraform",
    "hcl": "hcl",
}
SPECIAL_NAMES = {
    "Dockerfile": "dockerfile",
    "Containerfile": "dockerfile",
    "Makefile": "makefile",
    "Procfile": "text",
    "Gemfile": "ruby",
    "Rakefile": "ruby",
}
# Kinds of artifacts by language; the rest is source.
DOCUMENTATION = ("markdown", "rst", "text")
CONFIGURATION = ("yaml", "json", "toml", "ini", "dockerfile", "terraform", "hcl")
ASSETS = ("css", "scss", "sass", "less", "html")
SCRIPTS = ("javascript", "javascriptreact", "typescript", "typescriptreact")
# How comment lines begin, by language; the rest has the last ones.
COMMENTS = (
    (("python", "shell", "yaml", "toml", "ini", "makefile", "dockerfile"), ("#",)),
    (("sql",), ("--",)),
    (("markdown", "rst", "text", "json", "xml", "html"), ("<!--",)),
)
OTHER_COMMENTS = ("//", "/*", "*")
# Words that count as branches, by language.
BRANCH_WORDS = (
    (("sql",), r"\bJOIN\b|\bUNION\b|\bCASE\b"),
    (("terraform", "hcl"), r"\bfor_each\b|\bcount\b|\bdynamic\b"),
    (("shell", "makefile", "dockerfile"), r"\bif\b|\bfor\b|\bwhile\b|&&|\|\|"),
)
# Folders that name a group wherever they stand.
GROUP_FOLDERS = ("frontend", "backend", "agent-runner", "runner-launcher", "native-worker", "git-worker", "infra", "docs", "scripts")
COMMENT_PREFIX = r"^\s*(#|//|--|;|\*|/\*|<!--)"


def language(path: str | Column) -> Column:
    """By whole name, else by the suffix behind a name; ``unknown`` where neither tells."""
    name = basename(path)
    by = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    suffix = F.regexp_extract(F.lower(name), r"^.+\.([^.]+)$", 1)
    return F.coalesce(F.try_element_at(by(SPECIAL_NAMES), name), F.when(F.lower(name).startswith("dockerfile"), "dockerfile"), F.try_element_at(by(LANGUAGES), suffix), F.lit("unknown"))


def artifact_type(path: str | Column, lang: Column) -> Column:
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    test = p.rlike(r"(^|/)tests?/|\.(test|spec)\.")
    return F.when(test, "test").when(lang.isin(*DOCUMENTATION), "documentation").when(lang.isin(*CONFIGURATION), "configuration").when(lang.isin(*ASSETS), "asset").otherwise("source")


def runtime(path: str | Column, lang: Column) -> Column:
    """Where a file runs, by its path, then its language."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    return (
        F.when(p.startswith("frontend/") | lang.isin("javascriptreact", "typescriptreact"), "browser").when(F.contains(p, F.lit("worker")), "worker").when(lang == "python", "python")
        .when(lang.isin("javascript", "typescript"), "node").when(lang.isin("dockerfile", "terraform", "hcl", "yaml"), "deployment").otherwise("static")
    )


def inferred_group(path: str | Column, lang: Column) -> Column:
    """The group that a path suggests where none is configured: ``testing``, a folder of GROUP_FOLDERS (the first of them in
    that order), what stands below ``src``, else the first step."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    named = [F.when(F.array_contains(parts, name), F.lit(name)) for name in GROUP_FOLDERS]
    first = F.when((F.get(parts, F.lit(0)) == "src") & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    return F.coalesce(F.when(artifact_type(path, lang) == "test", "testing"), *named, first, F.lit("root"))


def group_source(declared: str | Column) -> Column:
    """Whether a module's group was configured or inferred."""
    d = F.col(declared) if isinstance(declared, str) else declared
    return F.when(F.coalesce(d, F.lit("")) != "", "configured").otherwise("inferred")


def group_sources(modules: DataFrame, declared: str, inferred: str) -> DataFrame:
    """``name, files, source`` of each effective group: ``declared`` where all its modules say so, ``inferred`` where none does,
    else ``mixed``."""
    own = modules.select(effective(declared, inferred, default="ungrouped").alias("name"), (group_source(declared) == "configured").alias("_own"))
    n, k = F.count("*"), F.count_if("_own")
    return own.groupBy("name").agg(n.alias("files"), F.when(k == n, "declared").when(k == 0, "inferred").otherwise("mixed").alias("source"))


def top_folders(paths: DataFrame, path: str = "path", limit: int = 16) -> DataFrame:
    """Default groups: top folders that hold files, largest first; ``name`` is the title, with a number where taken."""
    folder = F.split_part(F.col(path), F.lit("/"), F.lit(1))
    found = paths.where(F.instr(path, "/") > 0).groupBy(folder.alias("folder")).agg(F.count("*").alias("files"))
    from pyspark.sql import Window

    title = F.initcap(F.regexp_replace("folder", "[-_]+", " "))
    named = found.orderBy(F.col("files").desc(), "folder").limit(limit).withColumn("title", title)
    n = F.row_number().over(Window.partitionBy("title").orderBy("folder"))
    return named.withColumn("_n", n).select("folder", "files", F.when(F.col("_n") > 1, F.concat_ws(" ", "title", F.col("_n").cast("string"))).otherwise(F.col("title")).alias("name"))


def line_facts(df: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """Adds ``lines, lines_of_code, comment_lines, branches`` of a text; comments and branches by the language in
    column ``lang``, or those of any language."""
    body = F.coalesce(text, F.lit(""))
    lines = F.split(body, "\n")
    if lang is None:
        begins = lambda x: F.rlike(x, F.lit(COMMENT_PREFIX))
        branches = F.size(F.regexp_extract_all(body, F.lit(r"\b(if|for|while|case|catch|except|and|or)\b|&&|\|\|"), F.lit(0)))
    else:

        def begins(x: Column) -> Column:
            bare = F.ltrim(F.regexp_replace(x, r"^\s+", ""))
            any_of = lambda marks: F.coalesce(*[F.when(bare.startswith(m), F.lit(True)) for m in marks], F.lit(False))
            out = F.when(F.col(lang).isNull(), any_of(OTHER_COMMENTS))
            for langs, marks in COMMENTS:
                out = out.when(F.col(lang).isin(*langs), any_of(marks))
            return out.otherwise(any_of(OTHER_COMMENTS))

        branches = F.coalesce(*[F.when(F.col(lang).isin(*langs), F.size(F.regexp_extract_all(body, F.lit(f"(?i){words}"), F.lit(0)))) for langs, words in BRANCH_WORDS], F.lit(0))
    comment = F.filter(lines, begins)
    code = F.filter(lines, lambda x: x.rlike(r"\S") & ~begins(x))
    return df.withColumns({"lines": F.size(lines), "lines_of_code": F.size(code), "comment_lines": F.size(comment), "branches": branches})


def links(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key, place, target`` of all links."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('href="([^"]+)"'), F.lit(1))).alias("place", "target"))


def markdown_links(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, place, target`` of links within the repository, without anchors and queries."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[[^\]]+\]\((?!https?://|mailto:|#)([^)#?]+)"), F.lit(1))).alias("place", "target"))


def style_imports(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, place, target`` of the imports of style sheets."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"""@(?:import|use|forward)\s+(?:url\()?['"]([^'"]+)['"]"""), F.lit(1))).alias("place", "target"))


def script_imports(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, target`` of JavaScript and TypeScript imports and requires, comments left out."""
    return parse_scripts(df, key, text).select(key, F.explode("imports").alias("target"))


def script_symbols(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and kind, name, signature, lines, complexity and visibility of classes, functions, components and routes."""
    return parse_scripts(df, key, text).select(key, F.explode("symbols").alias("s")).select(key, "s.*")


# Nodes that count as branches.
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.comprehension, ast.Match)
PYTHON_FACTS = (
    "structural_hash string, summary string, complexity int, parse_error string, imports array<struct<module: string, name: string, line: int>>, "
    "symbols array<struct<kind: string, name: string, start_line: int, end_line: int, complexity: int, visibility: string>>, calls array<string>, bases array<string>"
)


def _complexity(node: ast.AST) -> int:
    return 1 + sum(isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(node))


def _dotted(node: ast.AST) -> str:
    """The name that a chain of attributes and subscripts spells, from its last call or operator on; else empty."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute | ast.Subscript):
        parts += [node.attr] if isinstance(node, ast.Attribute) else []
        node = node.value
    return ".".join(reversed([*parts, node.id] if isinstance(node, ast.Name) else parts))


def python_facts(text: str | None) -> dict:
    """What the syntax tree of a text says; the structural hash leaves out docstrings, comments and layout.  A text that
    doesn't parse, or whose tree is too deep to walk, has its error and nothing else."""
    empty = {"structural_hash": hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest(), "summary": None, "complexity": 0, "parse_error": None, "imports": [], "symbols": [], "calls": [], "bases": []}
    try:
        return empty | _tree_facts(ast.parse(text or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return empty | {"parse_error": type(e).__name__}


def _tree_facts(tree: ast.Module) -> dict:
    doc = ast.get_docstring(tree)
    imports, symbols, calls, bases = [], [], set(), set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports += [{"module": a.name, "name": None, "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports += [{"module": "." * n.level + (n.module or ""), "name": a.name, "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(n, ast.ClassDef) else "function"
            shown = "special" if n.name.startswith("__") and n.name.endswith("__") else "private" if n.name.startswith("_") else "public"
            symbols.append({"kind": kind, "name": n.name, "start_line": n.lineno, "end_line": n.end_lineno, "complexity": _complexity(n), "visibility": shown})
            bases |= {_dotted(b) for b in getattr(n, "bases", [])} - {""}
        elif isinstance(n, ast.Call):
            calls |= {_dotted(n.func)} - {""}
    complexity = _complexity(tree)
    for n in ast.walk(tree):
        body = getattr(n, "body", None)
        if isinstance(body, list) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
            del body[0]
    return {
        "structural_hash": hashlib.sha256(ast.dump(tree).encode("utf-8", "surrogatepass")).hexdigest(), "summary": doc.split("\n")[0] if doc else None, "complexity": complexity,
        "imports": imports, "symbols": symbols, "calls": sorted(calls), "bases": sorted(bases),
    }


def parse_python(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and PYTHON_FACTS of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[[key]].reset_index(drop=True), pd.DataFrame([python_facts(t) for t in b[text]])], axis=1)

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {PYTHON_FACTS}")


#: Extractors by language, each ``(df, key, text) -> facts``; callers may add their own.
REGISTRY = {"python": parse_python, "markdown": markdown_links} | dict.fromkeys(SCRIPTS, parse_scripts) | dict.fromkeys(("css", "scss", "sass", "less"), style_imports)


def conforming(facts: DataFrame) -> DataFrame:
    """Facts that keep the contract: a hash, no negative figure, symbols that end after they start."""
    ok = F.col("structural_hash").rlike("^[0-9a-f]{64}$") & (F.col("complexity") >= 0) & F.forall("symbols", lambda s: s["end_line"] >= s["start_line"])
    return facts.where(ok)


def chunks(df: DataFrame, key: str, text: str = "text", lines: int = 80) -> DataFrame:
    """``key, chunk, start_line, body``: texts cut every ``lines`` lines."""
    all_ = F.split(F.coalesce(text, F.lit("")), "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / lines).cast("int"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("chunk"), (i * lines + 1).alias("start_line"), F.array_join(F.slice(all_, i * lines + 1, F.lit(lines)), "\n").alias("body")))
    return df.select(key, F.explode(cut).alias("c")).select(key, "c.chunk", "c.start_line", "c.body")


def symbol_chunks(df: DataFrame, key: str, ends: str, text: str = "text", max_chars: int = 12_000) -> DataFrame:
    """``key, chunk, start_line, end_line, body``: whole lines up to ``max_chars`` (one line at least), where that doesn't reach the end
    cut back to the last line of ``ends`` (an array of lines that symbols end on) behind the chunk's first."""

    def cut(text: str, ends: list[int]) -> Iterator[tuple[int, int, str]]:
        lines = text.split("\n")
        lines = [line + "\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        upto = [0, *itertools.accumulate(map(len, lines))]
        start = 0
        while start < len(lines):
            end = max(start + 1, bisect.bisect_right(upto, upto[start] + max_chars) - 1)
            k = bisect.bisect_right(ends, end) - 1
            if end < len(lines) and k >= 0 and ends[k] > start + 1:
                end = ends[k]
            yield start + 1, end, text[upto[start] : upto[end]]
            start = end
        if not lines:
            yield 1, 1, ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t, e in zip(b[key], b[text], b[ends], strict=True):
                e = sorted({int(x) for x in e if x is not None and x > 0}) if e is not None else []
                rows = [(k, n, *c) for n, c in enumerate(cut(t or "", e))]
                yield pd.DataFrame(rows, columns=[key, "chunk", "start_line", "end_line", "body"])

    return df.select(key, text, ends).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, chunk int, start_line int, end_line int, body string")
