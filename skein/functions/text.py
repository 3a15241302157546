"""Row-wise text functions as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from skein import rules

WORD = r"([\p{L}\p{N}_]+)"


def strip(col: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def lstrip_newlines(col: Column) -> Column:
    """Without newlines at the start."""
    return F.regexp_replace(col, r"^\n+", "")


def mask(col: Column, patterns: list[str] | None = None) -> Column:
    """Every match of the patterns replaced by [REDACTED], one pattern after the other; invalid patterns are skipped."""
    for pattern in rules.MASKS if patterns is None else patterns:
        try:
            re.compile(pattern)
        except re.error:
            continue
        col = F.regexp_replace(col, pattern, "[REDACTED]")
    return col


def all_matches(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), group)


def code_blocks(col: Column) -> Column:
    """Fenced blocks as an array of (language, content): aliases resolved, no language is text."""
    fence = rules.FENCE
    language = F.transform(
        all_matches(col, fence, 1),
        lambda x: rules.lookup(rules.LANGUAGES, F.lower(x), None),
    )
    raw = F.transform(all_matches(col, fence, 1), lambda x: F.when(x == "", "text").otherwise(F.lower(x)))
    named = F.zip_with(language, raw, lambda a, b: F.coalesce(a, b))
    return F.zip_with(named, all_matches(col, fence, 2), lambda a, b: F.struct(a.alias("language"), b.alias("content")))


#: Definitions by language: the whole match, and what to cut off before and after the name.
SYMBOLS = {
    "python": (r"(?md)(^(?:async )?def\s+\w+|^class\s+\w+)", r"^(?:async )?(?:def|class)\s+"),
    "go": (r"(?md)(^func\s+(?:\(\w+ \*?\w+\)\s+)?\w+)", r"^func\s+(?:\(\w+ \*?\w+\)\s+)?"),
    "rust": (r"(?md)(^(?:pub )?fn\s+\w+|^(?:pub )?struct\s+\w+)", r"^(?:pub )?(?:fn|struct)\s+"),
    "javascript": (r"(?d)(function\s+\w+|const\s+\w+\s*=.*?(?:=>|\()|class\s+\w+)", r"^(?:function|const|class)\s+|\s*=.*$"),
    "typescript": (
        r"(?d)(function\s+\w+|const\s+\w+\s*=.*?(?:=>|\()|class\s+\w+|interface\s+\w+)",
        r"^(?:function|const|class|interface)\s+|\s*=.*$",
    ),
    "java": (r"((?:public|private|protected)?\s*(?:static\s+)?[\w<>\[\]]+\s+\w+\s*\()", r"(?s)^.*\s(?=\w+\s*\($)|\s*\($"),
}


def symbols(col: Column, language: str, most: int = 20) -> Column:
    """Names defined in code, in order of first appearance."""
    found, cut = SYMBOLS[language]
    names = F.transform(all_matches(col, found), lambda x: F.regexp_replace(x, cut, ""))
    return F.slice(F.array_distinct(names), 1, most)


def urls(col: Column, most: int = 10) -> Column:
    """Distinct addresses in order, without marks at their end."""
    found = F.transform(all_matches(col, rules.URL, 0), lambda x: F.regexp_replace(x, r"[.,;)]+$", ""))
    return F.slice(F.array_distinct(found), 1, most)


#: Line breaks are newlines only.
FILE_REF = rules.FILE_REF.replace("(?m)", "(?md)")


def file_refs(col: Column, most: int = 10) -> Column:
    """Distinct paths in order."""
    return F.transform(file_mentions(col, most), lambda x: x["path"])


def file_mentions(col: Column, most: int = 10) -> Column:
    """(path, line, language) of the distinct paths of at least four characters, in order, each as first mentioned; line is null
    where none is given, language where the ending is unknown."""
    paths, lines = all_matches(col, FILE_REF, 1), all_matches(col, FILE_REF, 2)
    pairs = F.filter(F.zip_with(paths, lines, lambda p, n: F.struct(p.alias("p"), n.alias("n"))), lambda x: F.length(x["p"]) >= 4)
    names = F.array_distinct(F.transform(pairs, lambda x: x["p"]))
    first = F.transform(F.slice(names, 1, most), lambda p: F.struct(p.alias("p"), F.filter(pairs, lambda x: x["p"] == p)[0]["n"].alias("n")))
    return F.transform(
        first,
        lambda x: F.struct(x["p"].alias("path"), F.nullif(x["n"], F.lit("")).try_cast("int").alias("line"), path_language(x["p"]).alias("language")),
    )


def path_language(path: Column) -> Column:
    """The language of a path's ending."""
    return rules.lookup(rules.LANGUAGES, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)), None)


def stack_traces(col: Column) -> Column:
    """(exception, message, file, line, http_status) of a text's traces: its traceback, whose message is the rest of the text,
    or, where there is none, every script error; empty where there is neither. The place is the last one a traceback names, and
    the first frame for script errors."""
    python, script = rules.PYTHON_TRACE, rules.SCRIPT_ERROR.replace("(T", "(?d)(T", 1)
    message = F.left(strip(F.regexp_extract(col, python, 2)), F.lit(200))
    files, lines = all_matches(col, rules.PYTHON_PLACE, 1), all_matches(col, rules.PYTHON_PLACE, 2)
    file, line = F.nullif(F.regexp_extract(col, rules.SCRIPT_FRAME, 1), F.lit("")), F.nullif(F.regexp_extract(col, rules.SCRIPT_FRAME, 2), F.lit(""))
    own = F.struct(
        F.regexp_extract(col, python, 1).alias("exception"),
        message.alias("message"),
        F.try_element_at(files, F.lit(-1)).alias("file"),
        F.try_element_at(lines, F.lit(-1)).try_cast("int").alias("line"),
        F.nullif(F.regexp_extract(message, rules.HTTP_STATUS, 1), F.lit("")).try_cast("int").alias("http_status"),
    )
    others = F.zip_with(
        all_matches(col, script, 1),
        all_matches(col, script, 2),
        lambda e, m: F.struct(
            e.alias("exception"), F.left(strip(m), F.lit(200)).alias("message"), file.alias("file"), line.try_cast("int").alias("line"), F.lit(None).cast("int").alias("http_status")
        ),
    )
    return F.when(col.rlike(python), F.array(own)).otherwise(others)


def stack_trace(col: Column) -> Column:
    """The first of :func:`stack_traces`; null where there is none."""
    return F.try_element_at(stack_traces(col), F.lit(1))


def cli_outputs(col: Column) -> Column:
    """(tool, exit_code, passed, failed, signal) of the tools whose output a text shows: every pytest summary with the text's exit
    code, every jest summary, npm's errors where there is neither, and what cloud resources are named."""
    number = lambda x, pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).try_cast("int")

    def out(tool: str, signal: Column, passed: Column | None = None, failed: Column | None = None, code: Column | None = None) -> Column:
        none = F.lit(None).cast("int")
        return F.struct(
            F.lit(tool).alias("tool"), (none if code is None else code).alias("exit_code"), (none if passed is None else passed).alias("passed"),
            (none if failed is None else failed).alias("failed"), signal.alias("signal"),
        )

    pytest = F.transform(all_matches(col, rules.PYTEST, 0), lambda x: out("pytest", strip(x), number(x, r"(\d+) passed"), number(x, r"(\d+) failed"), exit_code(col)))
    jest = F.transform(
        all_matches(col, rules.JEST, 0),
        lambda x: out("jest", F.concat(F.regexp_extract(x, rules.JEST, 1), F.lit(" passed, "), F.regexp_extract(x, rules.JEST, 2), F.lit(" failed")), number(x, rules.JEST), F.nullif(F.regexp_extract(x, rules.JEST, 2), F.lit("")).try_cast("int")),
    )
    runs = F.concat(pytest, jest)
    kind = "array<struct<tool:string,exit_code:int,passed:int,failed:int,signal:string>>"
    npm = F.when(col.rlike(rules.NPM) & (F.size(runs) == 0), F.array(out("npm", F.lit("npm error detected")))).otherwise(F.array().cast(kind))
    arns = all_matches(col, f"({rules.ARN})")
    found = F.concat(F.lit("AWS ARNs found: "), F.try_element_at(arns, F.lit(1)), F.when(F.size(arns) > 1, "...").otherwise(""))
    return F.concat(runs, npm, F.when(F.size(arns) > 0, F.array(out("aws", found))).otherwise(F.array().cast(kind)))


def cli_tools(col: Column) -> Column:
    """The distinct names of the tools of :func:`cli_outputs`, in order."""
    return F.array_distinct(F.transform(cli_outputs(col), lambda x: x["tool"]))


def exit_code(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, rules.EXIT_CODE, 1), F.lit("")).try_cast("int")


def nested_keys(value, prefix: str = "", depth: int = 0) -> Iterator[str]:
    """The keys of JSON objects inside each other, by path, down to the fourth level; of a list the first entry counts."""
    if depth > 3:
        return
    if isinstance(value, dict):
        for key, inner in value.items():
            path = f"{prefix}.{key}" if prefix else key
            yield path
            yield from nested_keys(inner, path, depth + 1)
    elif isinstance(value, list) and value:
        yield from nested_keys(value[0], prefix, depth + 1)


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _schema_blobs(texts: pd.Series) -> pd.Series:
    fence, inline = re.compile(rules.JSON_FENCE), re.compile(rules.JSON_INLINE)

    def found(text: str | None) -> list[list[str]]:
        out: list[list[str]] = []
        for m in (m for pattern in (fence, inline) for m in pattern.finditer(text or "")):
            try:
                keys = list(islice(nested_keys(json.loads(m.group(1))), 30))
            except (ValueError, RecursionError):
                continue
            if len(keys) >= 3:
                out.append(keys)
            if len(out) == 3:
                break
        return out

    return texts.map(found)


def schema_blobs(col: Column) -> Column:
    """The keys (at most 30, nested ones by path) of the first three JSON values of three keys or more in a text, fenced ones
    first; what isn't JSON is no value. Only texts with a brace leave the JVM's side as more than null."""
    return _schema_blobs(F.when(F.contains(col, F.lit("{")), col))


def block_symbols(content: Column, language: Column) -> Column:
    """Names defined in a code block, by its language; empty for languages without patterns."""
    out = F.array().cast("array<string>")
    for name in SYMBOLS:
        out = F.when(language == name, symbols(content, name)).otherwise(out)
    return out


def search_tokens(col: Column) -> Column:
    """Distinct runs of a-z and 0-9 in lower case."""
    return F.array_distinct(all_matches(F.lower(col), "([a-z0-9]+)"))


def label_tokens(col: Column, stop: list[str] | None = None) -> Column:
    """Distinct words of more than two letters that aren't in the stop list."""
    words = F.filter(all_matches(F.lower(col), WORD), lambda w: F.length(w) > 2)
    return F.array_except(words, F.array(*[F.lit(w) for w in (rules.STOP if stop is None else stop)]))


def escape_xml(col: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(sign), F.lit(name))
    return col


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, "<[^>]+>", "")


def document_format(path: Column) -> Column:
    """markdown, json, yaml or text by a path's ending."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return (
        F.when(ending.isin(".md", ".mdx", ".markdown"), "markdown")
        .when(ending == ".json", "json")
        .when(ending.isin(".yaml", ".yml"), "yaml")
        .otherwise("text")
    )


def _pack(parts: Column, most: int, keep: Column, finish) -> Column:
    """Greedy packing in order: a part opens a new chunk where it would make the current one longer than ``most``."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def take(state: Column, part: Column) -> Column:
        now = state["now"]
        full = (F.length(now) + F.length(part) > most) & (now != "")
        return F.struct(
            F.when(full, F.array_append(state["done"], strip(now))).otherwise(state["done"]).alias("done"),
            F.when(full, part).otherwise(keep(F.concat(now, F.lit("\n\n"), part))).alias("now"),
        )

    return F.aggregate(parts, zero, take, finish)


def paragraph_chunks(col: Column, most: int = 4000) -> Column:
    """Paragraphs packed in order into chunks of about ``most`` characters, stripped; an empty rest is dropped."""

    def finish(s: Column) -> Column:
        rest = strip(s["now"])
        return F.when(rest != "", F.array_append(s["done"], rest)).otherwise(s["done"])

    return _pack(F.split(col, r"\n{2,}"), most, lstrip_newlines, finish)


def turn_chunks(user: Column, assistant: Column, most: int = 6000) -> Column:
    """The assistant's text whole, or packed where both together are longer than ``most``."""
    user, assistant = F.coalesce(user, F.lit("")), F.coalesce(assistant, F.lit(""))

    def finish(s: Column) -> Column:
        return F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"])

    packed = _pack(F.split(assistant, r"\n{2,}"), most, strip, finish)
    return F.when(F.length(user) + F.length(assistant) > most, packed).otherwise(F.array(assistant))


def markdown_sections(col: Column, most: int = 4000) -> Column:
    """(heading, body) of the parts before and under headings of the first three levels; longer bodies as numbered chunks."""
    parts = F.split(col, r"(?md)(?=^#{1,3}[ \t]+\S)")
    head = r"^#{1,3}\s+([^\n]+)"

    def section(p: Column) -> Column:
        titled = p.rlike(r"^#{1,3}[ \t]+\S")
        heading = F.when(titled, strip(F.regexp_extract(p, head, 1))).otherwise("")
        body = F.when(titled, strip(F.regexp_replace(p, head, ""))).otherwise(strip(p))
        chunks = F.when(titled & (F.length(body) > most), paragraph_chunks(body, most)).otherwise(F.array(body))
        count = F.size(chunks)
        return F.transform(
            chunks,
            lambda c, i: F.struct(
                F.when(count > 1, F.concat(heading, F.lit(" ("), i + 1, F.lit("/"), count, F.lit(")"))).otherwise(heading).alias("heading"),
                c.alias("body"),
            ),
        )

    found = F.flatten(F.transform(parts, section))
    return F.filter(found, lambda s: (s["heading"] != "") | (s["body"] != ""))


def commit_hint(subject: Column) -> Column:
    """What a conventional commit prefix says about its node; empty where it says nothing."""
    return rules.lookup(rules.COMMIT_HINTS, F.lower(F.regexp_extract(subject, r"^([\p{L}\p{N}_]+)[(:]", 1)), "")


def iso_time(col: Column) -> Column:
    """A timestamp from ISO text, with Z or an offset or (then UTC) none; null for anything else."""
    zoned = col.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
    return F.concat(col, F.when(zoned, "").otherwise("Z")).try_cast("timestamp")
