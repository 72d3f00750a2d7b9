"""Analyzers of source texts as table functions, callable from SQL by LATERAL.

``SELECT * FROM files, LATERAL symbols(content, 'rust')`` gives the rows of :func:`skein.operators.symbols.symbols` without
path and source: one row per declared symbol. ``analyze`` checks the language before a query runs. The patterns are
those of the DataFrame form; here Python applies them to one text at a time, so the DataFrame form is the faster one."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.constants import LANGUAGE_ALIASES, RESERVED_WORDS
from .symbols import LOOSE, PATTERNS, PHP_BODY, PHP_NAMESPACE, alternatives, parsed_python

SPACES = " \t\n\x0b\x0c\r"
ROW = StructType().add("kind", StringType()).add("name", StringType()).add("signature", StringType()).add("doc_available", BooleanType()).add("rule", IntegerType()).add("ordinal", IntegerType())
LANGUAGES = (*PATTERNS, "python")


def _result(before: str, arrow: str, most: int | None = None):
    return lambda m: ("function", m[1], (f"{before}{m[1]}({m[2].strip(' ')})" + (arrow + m[3].strip(SPACES) if m[3] else ""))[:most])


def _named(kind: str, before: str, after: str = ""):
    return lambda m: (kind, m[1], before + m[1] + after)


def _head(m: re.Match) -> str:
    return m[0].split("{")[0].strip(SPACES)


#: For each pattern of a language: kind, name and signature of a match.
SHAPES = {
    "javascript": [lambda m: ("function", m[1], m.string[m.start() :].split("\n", 1)[0][:80].strip(SPACES)), lambda m: ("arrow_function", m[1], f"const {m[1]} = (...) =>"), _named("class", "class "), _named("interface", "interface "), _named("type", "type ", " =")],
    "rust": [_result("pub fn ", " -> "), lambda m: ("struct" if "struct" in m[0] else "enum", m[1], _head(m) + ";"), _named("trait", "pub trait ")],
    "java": [
        lambda m: ("interface" if "interface" in m[0] else "enum" if "enum" in m[0] else "class", m[1], m[0].strip(SPACES)), lambda m: ("method", m[1], m[0].strip(SPACES)[:80]),
        lambda m: ("field", m[2], f"{m[1]} {m[2]}") if len(m[2]) > 1 and m[2][0].isupper() else None,
    ],
    "kotlin": [_result("fun ", ": ", 100), lambda m: ("class", m[1], re.sub(r"[ \t\n\x0b\x0c\r]+", " ", m[0]).strip(" ")), _named("interface", "interface "), lambda m: ("property", m[1], f"val {m[1]}" + (f": {m[2].strip(SPACES)}" if m[2] else ""))],
    "c_cpp": [lambda m: ("function", m[1], _head(m)[:80]), _named("typedef", "typedef ... "), _named("struct", "struct ")],
    "php": [_named("class", "class "), _named("interface", "interface "), _named("trait", "trait "), _named("function", "function ", "(...)"), lambda m: ("constant", m[1], f"define('{m[1]}', ...)"), _named("class_constant", "const ", " ="), _named("enum", "enum ")],
}
#: Rules of PHP whose names stand in the file's namespace, and those that may be documented.
SPACED, DOCUMENTED = {0, 1, 2, 6}, {0, 1}


def spread(pattern: str) -> str:
    """The same pattern with its optional words as alternatives that begin with a character each: by these Python passes over a text quickly."""
    flags, pattern = re.match(r"((?:\(\?\w\))?)(.*)", pattern, re.DOTALL).groups()
    starts, rest = alternatives(pattern)
    return f"{flags}(?:{'|'.join(starts)}){rest}" if starts else flags + pattern


#: The patterns as they are applied here.
FAST = {language: [spread(p) for p in patterns] for language, patterns in PATTERNS.items()}
FAST_BODY = spread(PHP_BODY)


def by_patterns(language: str, text: str) -> Iterator[tuple]:
    """(kind, name, signature, documented, rule, ordinal) of a text, rule by rule."""
    space = re.search(PHP_NAMESPACE, text) if language == "php" else None
    after = text.partition("/**")
    for n, (pattern, shape) in enumerate(zip(FAST[language], SHAPES[language], strict=True)):
        own = re.sub(FAST_BODY, "", text) if language == "php" and n == 3 else text
        for i, m in enumerate(re.finditer(pattern, own)):
            if (row := shape(m)) is not None:
                kind, name, signature = row
                known = language == "php" and n in DOCUMENTED and bool(after[1]) and name in after[2]
                yield kind, f"{space[1]}\\{name}" if space and n in SPACED else name, signature, known, n, i


def go_lines(text: str) -> Iterator[tuple]:
    """The same for Go, line by line; of several rules the first counts."""
    before = ""
    for n, line in enumerate(text.split("\n")):
        line = line.strip(SPACES)
        if not line.startswith(("//", "/*")):
            for k, pattern in enumerate(PATTERNS["go"]):
                if m := re.match(pattern, line):
                    kind = ("function", "method", "interface" if "interface" in line else "struct" if "struct" in line else "type", "constant", "variable")[k]
                    yield kind, m[1], line, before.startswith(("//", "/*")), 0, n
                    break
        before = line


def declared(language: str, text: str | None) -> Iterator[tuple]:
    if text is None:
        yield "error", "PARSE_ERROR", "no content", False, -1, 0
    elif language == "python":
        yield from (x[:4] + x[5:] for x in parsed_python(text))
    else:
        yield from go_lines(text) if language == "go" else by_patterns(language, text)


@udtf(useArrow=True)
class Symbols:
    """symbols(content, language): the declared symbols of a text; a null text gives one error row."""

    @staticmethod
    def analyze(content: AnalyzeArgument, language: AnalyzeArgument) -> AnalyzeResult:
        if not language.isConstantExpression or LANGUAGE_ALIASES.get(language.value, language.value) not in LANGUAGES:
            raise ValueError(f"the language must be a constant, one of {', '.join(LANGUAGES)}")
        return AnalyzeResult(ROW)

    def eval(self, content: str, language: str) -> Iterator[tuple]:
        yield from declared(LANGUAGE_ALIASES.get(language, language), content)


@udtf(useArrow=True)
class LooseSymbols:
    """loose_symbols(content): the distinct names at the beginning of lines that look like declarations, in any language."""

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType().add("symbol", StringType()))

    def eval(self, content: str) -> Iterator[tuple]:
        names = dict.fromkeys(m[1] or m[2] for m in re.finditer(LOOSE, content or ""))
        yield from ((n,) for n in names if n and n not in RESERVED_WORDS)


def register(spark: SparkSession) -> None:
    """Makes ``symbols``, ``loose_symbols`` and one function for each language, such as ``symbols_rust(content)``, known to a session."""
    spark.udtf.register("symbols", Symbols)
    spark.udtf.register("loose_symbols", LooseSymbols)
    for language in LANGUAGES:
        spark.udtf.register(f"symbols_{language}", _for(language))


def _for(language: str):
    class OneLanguage:
        @staticmethod
        def analyze(content: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(ROW)

        def eval(self, content: str) -> Iterator[tuple]:
            yield from declared(language, content)

    return udtf(OneLanguage, useArrow=True)
