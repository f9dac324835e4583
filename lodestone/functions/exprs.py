"""Column expressions shared by operators and queries.  All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is a word of a goal, and words that say nothing about a goal.
WORD = "[A-Za-z][A-Za-z0-9_-]+"
STOP_WORDS = ("add", "and", "change", "create", "for", "from", "implement", "in", "of", "on", "the", "to", "update", "with")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- numbers


def half_even(c: str | Column) -> Column:
    """Rounds halves to even, as scores do (``round`` rounds them up)."""
    return F.rint(col(c))


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(col(c), F.lit(high)))


def saturated(c: str | Column, full: float) -> Column:
    """The share of ``full`` that a non-negative value reaches, at most 1; null counts as 0."""
    return F.least(F.coalesce(col(c), F.lit(0)) / F.lit(float(full)), F.lit(1.0))


def ratio(part: Column, whole: Column) -> Column:
    """Null where the whole is null or 0."""
    return part / F.nullif(whole, F.lit(0))


def label_by(score: str | Column, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first cut that the score reaches; null scores have none."""
    score = col(score)
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, label in cuts:
        out = out.when(score >= least, F.lit(label))
    return out.otherwise(F.lit(rest))


def lookup(c: str | Column, table: Mapping[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(col(c) == k, F.lit(v)).otherwise(out)
    return out


def backoff_seconds(attempts: str | Column, cap: int = 300) -> Column:
    return F.least(F.lit(float(cap)), F.pow(F.lit(2.0), col(attempts)))


def inverse_document_frequency(n: Column, df: Column) -> Column:
    return 1 + F.ln((n + 1) / (df + 1))


def token_estimate(payload: str | Column) -> Column:
    """Four bytes a token, rounded up."""
    return F.floor((F.octet_length(col(payload)) + 3) / 4)


# ---- strings


def effective(*names: str | Column, default: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(n), F.lit("")) for n in names], F.lit(default))


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path: str | Column) -> Column:
    """The base name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def parent(path: str | Column) -> Column:
    """The folder; "." at the top."""
    return F.when(F.instr(col(path), "/") > 0, F.regexp_replace(col(path), "/[^/]*$", "")).otherwise(F.lit("."))


def normalised_path(path: str | Column) -> Column:
    """Forward slashes, no leading ``./``, no empty or ``.`` steps."""
    return F.regexp_replace(F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"(^|/)(\./)+", "$1"), "/{2,}", "/")


def safe_path(path: str | Column) -> Column:
    """Whether a path stays inside: not absolute, no ``..`` step."""
    return ~F.rlike(normalised_path(path), F.lit(r"(^/)|(^|/)\.\.(/|$)"))


def joined_path(folder: str | Column, relative: str | Column) -> Column:
    """A path relative to a folder, with ``.`` and ``..`` steps taken; steps above the root stay there."""
    steps = F.split(F.concat_ws("/", F.when(col(folder) != ".", col(folder)), col(relative)), "/")
    empty = F.array().cast("array<string>")
    walked = F.aggregate(steps, empty, lambda seen, s: F.when(s.isin(".", ""), seen).when(s == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(s))))
    return F.array_join(walked, "/")


def literal_count(text: str | Column, term: str | Column) -> Column:
    """Non-overlapping occurrences of a literal; 0 for the empty one."""
    term = F.lit(term) if isinstance(term, str) else term
    size = F.char_length(term)
    return F.when(size == 0, F.lit(0)).otherwise(((F.char_length(col(text)) - F.char_length(F.replace(col(text), term, F.lit("")))) / size).cast("int"))


def split_camel(text: str | Column) -> Column:
    return F.regexp_replace(col(text), "(?<=[a-z0-9])(?=[A-Z])", " ")


def goal_terms(text: str | Column) -> Column:
    """Distinct lower-case words of a goal without stop words, plurals also in singular."""
    words = F.regexp_extract_all(split_camel(text), F.lit(WORD), F.lit(0))
    words = F.transform(words, lambda w: F.replace(F.lower(w), F.lit("-"), F.lit("_")))
    words = F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.char_length(w) > 1))
    singular = F.transform(F.filter(words, lambda w: w.endswith("s") & (F.char_length(w) > 4)), lambda w: F.substring(w, F.lit(1), F.char_length(w) - 1))
    return F.array_distinct(F.concat(words, singular))


def ellipsis(text: str | Column, size: int = 120) -> Column:
    return F.when(F.char_length(col(text)) > size, F.concat(F.substring(col(text), 1, size - 3), F.lit("..."))).otherwise(col(text))


def slug(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def visibility(name: str | Column) -> Column:
    """Two underscores in front (and none behind) make a name private, one makes it protected."""
    n = col(name)
    return F.when(n.startswith("__") & ~n.endswith("__"), "private").when(n.startswith("_"), "protected").otherwise("public")


def module_aliases(module: str | Column) -> Column:
    """Names under which a dotted module may be imported: itself, without its first part,
    after ``src``, and from ``app``, ``lib`` or ``server`` on."""
    parts = F.split(col(module), r"\.")
    after = lambda p, skip: F.when(F.array_position(parts, p) > 0, F.array_join(F.slice(parts, (F.array_position(parts, p) + skip).cast("int"), F.size(parts)), "."))
    rest = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), "."))
    names = F.array(col(module), rest, after("src", 1), after("app", 0), after("lib", 0), after("server", 0))
    return F.array_distinct(F.filter(F.array_compact(names), lambda n: n != ""))


def relative_import(package: str | Column, target: str | Column) -> Column:
    """A module named with leading dots, seen from a package; others stay as they are."""
    dots = F.char_length(F.regexp_extract(col(target), r"^(\.*)", 1))
    own = F.split(col(package), r"\.")
    base = F.slice(own, 1, F.greatest(F.size(own) - dots + 1, F.lit(0)))
    tail = F.regexp_replace(col(target), r"^\.+", "")
    return F.when(dots == 0, col(target)).otherwise(F.array_join(F.filter(F.concat(base, F.array(tail)), lambda p: p != ""), "."))


# ---- globs


def _wild(pattern: str, star: str) -> str:
    out = ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            out += star
        elif c == "?":
            out += star[:-1]
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(pattern: str) -> str:
    """One expression for the ways a path can match: as a whole (``*`` crosses folders), by its last
    steps (``*`` stays within one), and without a leading ``**/``."""
    ways = [_wild(pattern, ".*"), f"(?:.*/)?{_wild(pattern, '[^/]*')}" if not pattern.startswith("/") else _wild(pattern, "[^/]*")]
    if pattern.startswith("**/"):
        ways.append(_wild(pattern[3:], ".*"))
    return f"^(?:{'|'.join(ways)})$"


def glob_any(path: str | Column, patterns: Sequence[str]) -> Column:
    """Whether a path matches any pattern: one alternation, compiled once."""
    return F.rlike(col(path), F.lit("|".join(f"(?:{glob_regex(p)})" for p in patterns))) if patterns else F.lit(False)


def included(path: str | Column, include: Sequence[str], ignore: Sequence[str]) -> Column:
    """The include list, where there is one, lets in; any ignore pattern keeps out."""
    return (glob_any(path, include) if include else F.lit(True)) & ~glob_any(path, ignore)


def first_group(path: str | Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first group of which a pattern matches, else null."""
    return F.coalesce(*[F.when(glob_any(path, patterns), F.lit(name)) for name, patterns in groups], F.lit(None).cast("string"))


# ---- hashes and dates


def content_digest(*names: str | Column) -> Column:
    """SHA-256 of values as one JSON row; null and absent differ from empty."""
    return F.sha2(F.to_json(F.struct(*[col(n) for n in names]), {"ignoreNullFields": "false"}), 256)


def stable_key(*names: str | Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[col(n) for n in names]), 256), 1, 20)


def intent_fingerprint(terms: str | Column) -> Column:
    """Equal for equal sets of terms, whatever their order, case and blanks."""
    clean = F.transform(col(terms), lambda t: F.regexp_replace(F.lower(F.trim(t)), r"\s+", " "))
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(clean)), "\n"), 256)


def moment(text: str | Column) -> Column:
    """An ISO time stamp, null where it isn't one."""
    return F.try_to_timestamp(col(text))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
