"""Declared symbols of source files: one row per symbol, in the order of the rules and then of the text.

Rows have path, kind, name, signature, source, doc_available and probed (always false here), and
rule and ordinal, by which a file's rows are ordered. A file without content gives one error row.
All languages but Python are read by patterns inside the JVM."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import RESERVED_WORDS

# The patterns of each language's declarations, in order.
PATTERNS = {
    "javascript": [
        r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(?:\*\s+)?(\w+)\s*\(",
        r"(?:export\s+)?(?:async\s+)?const\s+(\w+)\s*[=:]\s*(?:async\s+)?\(",
        r"(?:export\s+)?class\s+(\w+)\s*(?:extends\s+(\w+))?\s*(?:implements\s+(\w+))?",
        r"(?:export\s+)?interface\s+(\w+)\s*(?:extends\s+[\w,\s]+)?",
        r"(?:export\s+)?type\s+(\w+)\s*=",
    ],
    "rust": [
        r"pub\s+(?:unsafe\s+)?fn\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^{]+))?",
        r"pub\s+(?:struct|enum)\s+(\w+)\s*(\{|[;])",
        r"pub\s+trait\s+(\w+)\s*(?::\{)?",
    ],
    "java": [
        r"(?:public\s+)?(?:abstract\s+)?(?:final\s+)?(?:class|interface|enum|@interface)\s+(\w+)",
        r"(?:public|protected|private|static|final|abstract|synchronized|native)\s+(?:static\s+)?(?:final\s+)?(?:abstract\s+)?(?:[\w<>\[\],\s]+)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w,\s]+)?\s*(?:\{|;)",
        r"(?:public|protected|private|static|final)\s+(?:static\s+)?(?:final\s+)?([\w<>\[\]]+)\s+(\w+)\s*(?:=|\s*;)",
    ],
    "kotlin": [
        r"(?:suspend\s+)?fun\s+(\w+)\s*\(([^)]*)\)\s*(?::\s*([^{]+))?",
        r"(?:data\s+|sealed\s+|open\s+)?(?:class|object|enum class)\s+(\w+)",
        r"interface\s+(\w+)",
        r"(?:val|var)\s+(\w+)\s*(?::\s*([^=]+))?\s*=",
    ],
    "c_cpp": [
        r"(?:static\s+)?(?:inline\s+)?(?:void|int|char|size_t|bool|float|double|uint\d+_t|int\d+_t|char\*|const\s+[\w\s]+\*?)\s+(\w+)\s*\(([^)]*)\)\s*\{",
        r"typedef\s+(?:struct|union|enum)\s+\w+\s*\{[^}]*\}\s*(\w+);",
        r"struct\s+(\w+)\s*\{",
    ],
    "php": [
        r"(?:abstract\s+|final\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?",
        r"interface\s+(\w+)(?:\s+extends\s+([\w,\s]+))?",
        r"trait\s+(\w+)",
        r"(?m)^\s*function\s+(\w+)\s*\(",
        r"define\s*\(\s*['\"]([\w_]+)['\"]\s*,",
        r"const\s+(\w+)\s*=",
        r"enum\s+(\w+)(?:\s*:\s*(\w+))?(?:\s+implements\s+([\w,\s]+))?",
    ],
    "go": [r"^func\s+([A-Z]\w*)\s*\(", r"^func\s+\([^)]+\)\s+([A-Z]\w*)\s*\(", r"^type\s+([A-Z]\w*)\s+", r"^const\s+([A-Z]\w*)\s*=", r"^var\s+([A-Z]\w*)\s*="],
}
# Fixed values too: where a PHP file's namespace and bodies stand, and what looks like a declaration in any language.
PHP_NAMESPACE = r"namespace\s+([\w\\]+)\s*;"
PHP_BODY = r"(?s)(?:abstract\s+|final\s+)?(?:class|trait|interface)\s+\w+.*?\{.*?\}(?=\s*$|\s*\n)"
LOOSE = r"(?m)^(?:def\s+|function\s+|fn\s+|func\s+|public\s+\w+\s+function\s+)?(\w+)\s*\(|^(?:class\s+|struct\s+|interface\s+|trait\s+)?(\w+)"
UNICODE = "(?U)"  # word characters and white space of all scripts

#: Takes the groups of a match (0: all of it) and the file's text; gives kind, name and signature, and perhaps whether it is documented and whether it counts.
Rule = Callable[[list[Column], Column], tuple]


def alternatives(pattern: str) -> tuple[list[str], str]:
    """What a pattern may begin with, and what follows: optional words before a word (or one of several) written out as alternatives,
    in the order in which the pattern tries them. Without optional words there are no alternatives."""
    options, rest = [], pattern
    while m := re.match(r"\(\?:([^()]*)\)\?", rest):
        options.append(m[1].split("|"))
        rest = rest[m.end() :]
    if not options:
        return [], pattern
    m = re.match(r"\(\?:([^()]*)\)(?![?*+])|[a-z]+(?=\\s\+)", rest)
    head = m[0].removeprefix("(?:").removesuffix(")").split("|")
    later = [f"(?:{'|'.join(x)})" for x in (*options[1:], head)]
    out = [x + "".join(f"{y}?" for y in later[i:-1]) + later[-1] for i, o in enumerate(options) for x in o]
    return out + head, rest[m.end() :]


def guarded(pattern: str) -> str:
    """The same pattern, which looks first at one character where it would try several words."""
    starts = alternatives(pattern)[0]
    return f"(?=[{''.join(sorted({x[0] for x in starts}))}]){pattern}" if starts else pattern


def _all(text: Column, pattern: str, groups: int) -> Column:
    """All matches and their groups. A text is read once: a pattern that looks at nothing beyond its match finds the same groups in that alone."""
    return F.transform(F.regexp_extract_all(text, F.lit(UNICODE + guarded(pattern)), F.lit(0)), lambda m: F.struct(m.alias("g0"), *(F.regexp_extract(m, UNICODE + pattern, g).alias(f"g{g}") for g in range(1, groups + 1))))


def _with_line(text: Column, pattern: str) -> Column:
    """All matches: as group 1 what stands on the line from the match on, up to 80 characters, as group 2 the pattern's own group."""
    plain = pattern.replace(r"(\w+)", r"\w+")
    both = F.regexp_extract_all(text, F.lit(rf"{UNICODE}(?=({guarded(plain)}))(?=([^\n]{{0,80}})){plain}"), F.lit(1))
    line = F.regexp_extract_all(text, F.lit(rf"{UNICODE}(?={guarded(plain)})(?=([^\n]{{0,80}})){plain}"), F.lit(1))
    return F.zip_with(both, line, lambda m, x: F.struct(m.alias("g0"), x.alias("g1"), F.regexp_extract(m, UNICODE + pattern, 1).alias("g2")))


def _named(kind: str, before: str, after: str = "") -> Rule:
    return lambda g, _: (F.lit(kind), g[1], F.concat(F.lit(before), g[1], F.lit(after)))


def _with_result(before: str, arrow: str, most: int | None = None) -> Rule:
    def rule(g: list[Column], _: Column) -> tuple:
        out = F.concat(F.lit(before), g[1], F.lit("("), F.trim(g[2]), F.lit(")"), F.when(g[3] != "", F.concat(F.lit(arrow), F.regexp_replace(g[3], r"^\s+|\s+$", ""))).otherwise(""))
        return F.lit("function"), g[1], F.substring(out, 1, most) if most else out

    return rule


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _cut(c: Column, mark: str) -> Column:
    return _strip(F.split_part(c, F.lit(mark), F.lit(1)))


def _kind_of(g0: Column) -> Column:
    return F.when(F.contains(g0, F.lit("interface")), "interface").when(F.contains(g0, F.lit("enum")), "enum").otherwise("class")


def _php(kind: str, documented: bool = False) -> Rule:
    def rule(g: list[Column], text: Column) -> tuple:
        space = F.regexp_extract(text, UNICODE + PHP_NAMESPACE, 1)
        after = F.substring(text, F.locate("/**", text) + 3, F.length(text))
        return F.lit(kind), F.when(space != "", F.concat(space, F.lit("\\"), g[1])).otherwise(g[1]), F.concat(F.lit(kind + " "), g[1]), F.contains(text, F.lit("/**")) & F.contains(after, g[1]) if documented else F.lit(False)

    return rule


RULES: dict[str, list[tuple[int, Rule]]] = {
    "javascript": [
        (2, lambda g, _: (F.lit("function"), g[2], _strip(g[1]))), (1, lambda g, _: (F.lit("arrow_function"), g[1], F.concat(F.lit("const "), g[1], F.lit(" = (...) =>")))),
        (1, _named("class", "class ")), (1, _named("interface", "interface ")), (1, _named("type", "type ", " =")),
    ],
    "rust": [(3, _with_result("pub fn ", " -> ")), (1, lambda g, _: (F.when(F.contains(g[0], F.lit("struct")), "struct").otherwise("enum"), g[1], F.concat(_cut(g[0], "{"), F.lit(";")))), (1, _named("trait", "pub trait "))],
    "java": [
        (1, lambda g, _: (_kind_of(g[0]), g[1], _strip(g[0]))), (1, lambda g, _: (F.lit("method"), g[1], F.substring(_strip(g[0]), 1, 80))),
        (2, lambda g, _: (F.lit("field"), g[2], F.concat_ws(" ", g[1], g[2]), F.lit(False), g[2].rlike(r"^\p{Lu}.+"))),
    ],
    "kotlin": [
        (3, _with_result("fun ", ": ", 100)), (1, lambda g, _: (F.lit("class"), g[1], F.trim(F.regexp_replace(g[0], r"\s+", " ")))), (1, _named("interface", "interface ")),
        (2, lambda g, _: (F.lit("property"), g[1], F.concat(F.lit("val "), g[1], F.when(g[2] != "", F.concat(F.lit(": "), _strip(g[2]))).otherwise("")))),
    ],
    "c_cpp": [(1, lambda g, _: (F.lit("function"), g[1], F.substring(_cut(g[0], "{"), 1, 80))), (1, _named("typedef", "typedef ... ")), (1, _named("struct", "struct "))],
    "php": [
        (1, _php("class", True)), (1, _php("interface", True)), (1, _php("trait")), (1, _named("function", "function ", "(...)")),
        (1, lambda g, _: (F.lit("constant"), g[1], F.concat(F.lit("define('"), g[1], F.lit("', ...)")))), (1, _named("class_constant", "const ", " =")), (1, _php("enum")),
    ],
}
COLUMNS = ["path", "kind", "name", "signature", "source", "doc_available", "probed", "rule", "ordinal"]


def _error(files: DataFrame) -> DataFrame:
    e = files.filter("content is null")
    return e.select("path", F.lit("error").alias("kind"), F.lit("PARSE_ERROR").alias("name"), F.lit("no content").alias("signature"), F.col("path").alias("source"), F.lit(False).alias("doc_available"), F.lit(False).alias("probed"), F.lit(-1).alias("rule"), F.lit(0).alias("ordinal"))


def symbols(files: DataFrame, language: str, path: str = "path", text: str = "content") -> DataFrame:
    """The symbols of files of one language."""
    files = files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("content"))
    if language == "python":
        return python_symbols(files)
    if language == "go":
        return go_symbols(files)
    found = []
    for n, (pattern, (groups, rule)) in enumerate(zip(PATTERNS[language], RULES[language], strict=True)):
        # What follows a function's start on its line is its signature; functions of PHP are looked for outside of bodies.
        own = F.regexp_replace("content", UNICODE + guarded(PHP_BODY), "") if language == "php" and n == 3 else F.col("content")
        matches = _with_line(own, pattern) if language == "javascript" and n == 0 else _all(own, pattern, groups)
        found.append(F.transform(matches, _applied(rule, groups, n)))
    rows = files.select("path", F.explode(F.flatten(F.array(*found))).alias("s")).filter("s.counts")
    rows = rows.select("path", "s.kind", "s.name", "s.signature", F.col("path").alias("source"), "s.doc_available", F.lit(False).alias("probed"), "s.rule", "s.ordinal")
    return rows.unionByName(_error(files))


def _applied(rule: Rule, groups: int, n: int) -> Callable[[Column, Column], Column]:
    def row(m: Column, i: Column) -> Column:
        kind, name, signature, documented, counts = (*(made := rule([m[f"g{g}"] for g in range(groups + 1)], F.col("content"))), *(F.lit(False), F.lit(True))[len(made) - 3 :])
        return F.struct(kind.alias("kind"), name.alias("name"), signature.alias("signature"), documented.alias("doc_available"), counts.alias("counts"), F.lit(n).alias("rule"), i.alias("ordinal"))

    return row


def go_symbols(files: DataFrame) -> DataFrame:
    """Exported symbols of Go files, line by line; documented if the line before is a comment. Of several rules the first counts."""
    lines = F.split("content", "\n")
    pairs = F.transform(lines, lambda x, i: F.struct(_strip(x).alias("l"), F.when(i > 0, _strip(F.get(lines, i - 1))).alias("before")))
    rows = files.select("path", F.posexplode(pairs).alias("n", "x")).select("path", "n", "x.*").filter(~(F.col("l").startswith("//") | F.col("l").startswith("/*")))
    names = [F.regexp_extract("l", UNICODE + p, 1) for p in PATTERNS["go"]]
    of_type = F.when(F.contains("l", F.lit("interface")), "interface").when(F.contains("l", F.lit("struct")), "struct").otherwise("type")
    kinds = [F.lit("function"), F.lit("method"), of_type, F.lit("constant"), F.lit("variable")]
    first = F.coalesce(*[F.when(n != "", F.struct(k.alias("kind"), n.alias("name"))) for n, k in zip(names, kinds, strict=True)])
    base = F.element_at(F.split("path", "/"), -1)
    rows = rows.withColumn("s", first).filter("s is not null")
    documented = F.coalesce(F.col("before").startswith("//") | F.col("before").startswith("/*"), F.lit(False))
    return rows.select("path", "s.kind", "s.name", F.col("l").alias("signature"), F.concat_ws(":", base, (F.col("n") + 1).cast("string")).alias("source"), documented.alias("doc_available"), F.lit(False).alias("probed"), F.lit(0).alias("rule"), F.col("n").alias("ordinal")).unionByName(_error(files))


def _signature(node: ast.AST) -> str:
    if isinstance(node, ast.ClassDef):
        bases = ", ".join(ast.unparse(b) for b in node.bases)
        return f"class {node.name}({bases})" if bases else f"class {node.name}"
    if isinstance(node, ast.AsyncFunctionDef):
        return f"async def {node.name}({', '.join(a.arg for a in node.args.args)})"
    args = ", ".join(f"{a.arg}: {ast.unparse(a.annotation)}" if a.annotation else a.arg for a in node.args.args)
    return f"def {node.name}({args})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


PYTHON_KINDS = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function", ast.ClassDef: "class"}


def parsed_python(text: str) -> list[tuple]:
    """(kind, name, signature, documented, line, rule, ordinal) of a Python text, breadth first; one error row if it doesn't parse."""
    try:
        nodes = [n for n in ast.walk(ast.parse(text)) if type(n) in PYTHON_KINDS]
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("error", "PARSE_ERROR", str(e), False, 0, -1, 0)]
    return [(PYTHON_KINDS[type(n)], n.name, _signature(n), bool(ast.get_docstring(n)), n.lineno, 0, i) for i, n in enumerate(nodes)]


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions, async functions and classes by Python's own parser, breadth first; a file that doesn't parse gives one error row."""

    def one(path: str, text: str | None) -> list[tuple]:
        if text is None:
            return [(path, "error", "PARSE_ERROR", "no content", path, False, False, -1, 0)]
        return [(path, kind, name, signature, f"{path}:{line}" if rule == 0 else path, known, False, rule, i) for kind, name, signature, known, line, rule, i in parsed_python(text)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for p, t in zip(f["path"], f["content"], strict=True) for r in one(p, t)], columns=COLUMNS)

    return files.select("path", "content").mapInPandas(run, "path string, kind string, name string, signature string, source string, doc_available boolean, probed boolean, rule int, ordinal int")


def loose_symbols(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, symbol): the distinct names at the beginning of lines that look like declarations, whatever the language, without reserved words."""
    names = F.transform(_all(F.col(text), LOOSE, 2), lambda m: F.when(m["g1"] != "", m["g1"]).otherwise(m["g2"]))
    return files.select(path, F.explode(F.array_distinct(names)).alias("symbol")).filter((F.col("symbol") != "") & ~F.col("symbol").isin(RESERVED_WORDS))


def audit(rows: DataFrame, package: str, order: list[str], exports: int = 30, keywords: int = 15) -> DataFrame:
    """One row per package: how many symbols were found, the first ``exports`` of them in order, the first ``keywords`` distinct function
    names in the alphabet's order, and a complexity. The lists' limits are part of an audit; ranks are taken before they are collected."""
    from ..operators.ranking import checkpointed, top_per_group

    # Texts are read once, not for each of the three results.
    rows = checkpointed(rows.select(*dict.fromkeys([package, "kind", "name", *order])))
    n = rows.groupBy(package).agg(F.count(F.lit(1)).alias("n_symbols"))
    first = top_per_group(rows, [package], [F.asc(c) for c in order], exports).groupBy(package).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("exports"))
    words = top_per_group(rows.filter("kind = 'function'").select(package, "name").distinct(), [package], [F.asc("name")], keywords).groupBy(package).agg(F.array_sort(F.collect_list("name")).alias("keywords"))
    return n.join(first, package, "left").join(words, package, "left").select(package, "n_symbols", "exports", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.when(F.col("n_symbols") > 10, "medium").otherwise("low").alias("complexity"))
