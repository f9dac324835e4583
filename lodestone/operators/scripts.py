"""Facts from JavaScript and TypeScript texts: imports, symbols, routes, sizes.

A text is cut into tokens once (comments, strings, words, marks), brackets are paired with a stack, and what follows a keyword in
the language's grammar is read off the tokens.  Literals of regular expressions aren't told from divisions."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""(?s)(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)|(?P<word>[\w$]+)|(?P<mark>=>|&&|\|\||\?\?|\S)"""
)
# What counts as a branch, and the methods that register a route.
_BRANCHES = {"if", "for", "while", "case", "catch", "&&", "||", "??"}
_METHODS = {"get", "post", "put", "patch", "delete"}
_PAIRS = {")": "(", "]": "[", "}": "{"}
_END = (None, "", 0)
FACTS = (
    "lines_of_code int, comment_lines int, complexity int, structural_hash string, imports array<string>, "
    "symbols array<struct<kind: string, name: string, signature: string, start_line: int, end_line: int, complexity: int, visibility: string>>"
)


class Script:
    """The tokens of a text without its comments: ``(kind, text, line)``."""

    def __init__(self, text: str):
        self.tokens, self.code_lines, self.note_lines, line, at = [], set(), set(), 1, 0
        for m in _TOKEN.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            kind, spans = m.lastgroup, range(line, line + m[0].count("\n") + 1)
            if kind == "note":
                self.note_lines.update(spans)
            else:
                self.tokens.append((kind, m[0], line))
                self.code_lines.update(spans)
        self.closes = self._paired()
        self.branches = [0, *itertools.accumulate(t in _BRANCHES and k != "string" for k, t, _ in self.tokens)]

    def _paired(self) -> dict[int, int]:
        """The token that closes each opening bracket; the last one where none does."""
        open_, closes = [], {}
        for i, (kind, text, _) in enumerate(self.tokens):
            if kind == "mark" and text in "([{":
                open_.append(i)
            elif kind == "mark" and text in _PAIRS and open_ and self.tokens[open_[-1]][1] == _PAIRS[text]:
                closes[open_.pop()] = i
        return closes | dict.fromkeys(open_, len(self.tokens) - 1)

    def at(self, i: int) -> tuple:
        return self.tokens[i] if 0 <= i < len(self.tokens) else _END

    def is_(self, i: int, *texts: str) -> bool:
        kind, text, _ = self.at(i)
        return kind in ("word", "mark") and text in texts

    def named(self, i: int) -> bool:
        kind, text, _ = self.at(i)
        return kind == "word" and not text[0].isdigit()

    def written(self, a: int, b: int) -> str:
        """Tokens a to b as text, words apart."""
        out = ""
        for _, text, _ in self.tokens[a:b]:
            out += " " if out and (out[-1] == "," or (out[-1].isalnum() and text[0].isalnum())) else ""
            out += text
        return out

    def body(self, i: int) -> int:
        """The end of the block that starts at token i, or i - 1 where none does."""
        return self.closes[i] if self.is_(i, "{") else i - 1

    def symbols(self) -> Iterator[tuple[int, int, str, str, str]]:
        """First and last token, kind, name and signature, in order."""
        for i, (kind, text, _) in enumerate(self.tokens):
            if kind != "word" or self.is_(i - 1, "."):
                if kind == "word" and text in _METHODS and self.is_(i + 1, "(") and self.at(i + 2)[0] == "string" and self.at(i + 2)[1][1:2] == "/":
                    name = f"{text.upper()} {self.at(i + 2)[1][1:-1]}"
                    yield i, self.closes[i + 1], "api_endpoint", name, name
            elif text == "class" and self.named(i + 1):
                head = next((k for k in range(i + 2, min(i + 200, len(self.tokens))) if self.is_(k, "{", ";")), i + 2)
                yield i, self.body(head), "class", self.at(i + 1)[1], f"class {self.at(i + 1)[1]}"
            elif text == "function":
                n = i + 1 + self.is_(i + 1, "*")
                if self.named(n) and self.is_(n + 1, "("):
                    close = self.closes[n + 1]
                    head = next((k for k in range(close + 1, min(close + 60, len(self.tokens))) if self.is_(k, "{", ";")), close + 1)
                    yield i, max(close, self.body(head)), "function", self.at(n)[1], f"function {self.at(n)[1]}({self.written(n + 2, close)})"
            elif text in ("const", "let", "var") and self.named(i + 1):
                arrow = self._arrow(i + 2)
                if arrow:
                    name, (arguments, at) = self.at(i + 1)[1], arrow
                    end = self.body(at + 1) if self.is_(at + 1, "{") else at
                    yield i, end, "react_component" if name[0].isupper() else "function", name, f"const {name} = ({arguments}) =>"

    def _arrow(self, i: int) -> tuple[str, int] | None:
        """The arguments and the arrow of a function that is bound by what starts at token i: a type, "=", then the function."""
        while i < len(self.tokens) and not self.is_(i, "=", ";", ",", "const", "let", "var"):
            i = self.closes.get(i, i) + 1
        if not self.is_(i, "="):
            return None
        i += 1 + self.is_(i + 1, "async")
        if self.named(i) and self.is_(i + 1, "=>"):
            return self.at(i)[1], i + 1
        if not self.is_(i, "("):
            return None
        close = self.closes[i]
        arrow = next((k for k in range(close + 1, min(close + 60, len(self.tokens))) if self.is_(k, "=>", ";", "=", "const", "let", "var")), close)
        return (self.written(i + 1, close), arrow) if self.is_(arrow, "=>") else None

    def imports(self) -> Iterator[str]:
        for i, (kind, text, _) in enumerate(self.tokens):
            if kind == "string" and len(text) > 2 and (self.is_(i - 1, "from", "import") or (self.is_(i - 1, "(") and self.is_(i - 2, "import", "require"))):
                yield text[1:-1]


def script_facts(text: str | None) -> dict:
    """What a text says by its form; nothing is run."""
    s = Script(text or "")
    symbols = []
    for a, b, kind, name, signature in s.symbols():
        first, last = s.at(a), s.at(max(a, b))
        symbols.append({
            "kind": kind, "name": name, "signature": signature[:1000], "start_line": first[2], "end_line": last[2], "complexity": 1 + s.branches[max(a, b) + 1] - s.branches[a], "visibility": "private" if name.startswith("_") else "public",
        })
    return {
        "lines_of_code": len(s.code_lines), "comment_lines": len(s.note_lines), "complexity": 1 + s.branches[-1],
        "structural_hash": hashlib.sha256(" ".join(t for _, t, _ in s.tokens).encode("utf-8", "surrogatepass")).hexdigest(), "imports": list(dict.fromkeys(s.imports())), "symbols": symbols,
    }


def parse_scripts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and FACTS of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[[key]].reset_index(drop=True), pd.DataFrame([script_facts(t) for t in b[text]])], axis=1)

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {FACTS}")
