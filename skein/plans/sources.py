"""Queries on source texts and documents: declared symbols by language, audits, integrity checks, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import analyzers, integrity, symbols
from ..sources import answers, readers, sinks
from .queries import ORACLES, Tables, query

# Each document's own text with code behind it: what the patterns must find, and what they find by chance.
CODE = {
    "javascript": ["export class Alpha extends Beta {}\nconst go = (x) => x\nfunction add(a, b) { return a }\n", "export default async function run(x) {\n}\ninterface Shape {}\ntype Id = string\n", "const n = 3\n"],
    "rust": ["pub fn run(x: i32) -> u8 { }\npub struct Job;\n", "pub unsafe fn go( a: A ) {\n}\npub enum Kind { A }\npub trait Show {}\n", "fn hidden() {}\n"],
    "java": ["public final class Alpha {\n  private static final int LIMIT = 3;\n  public int run(int a) {\n  }\n}\n", "public interface Shape {\n}\nenum Kind { A }\n", "int x;\n"],
    "kotlin": ["suspend fun load(a: Int): String {\n}\ndata class Point(val x: Int)\nval y = 3\n", "interface Shape\nvar name: String = 1\nfun go() {\n}\n", "x\n"],
    "c_cpp": ["static int add(int a, int b) {\n}\nstruct node {\n};\n", "typedef struct pair { int a; } pair_t;\nvoid run() {\n}\n", "int x;\n"],
    "php": ["<?php\nnamespace App\\Core;\n/** About Alpha. */\nfinal class Alpha extends Beta {\n  const LIMIT = 3;\n  function inner() {}\n}\nfunction outer($x) {\n}\ndefine('MODE', 1);\n", "<?php\ninterface Shape {\n}\ntrait Loud {\n}\nenum Kind: string {\n}\n", "<?php\n"],
    "go": ["// Run runs.\nfunc Run(a int) {\n}\ntype Job struct {\n", "func (j *Job) Stop() {\n}\nconst Limit = 3\nvar Name = 1\ntype Show interface {\n", "func hidden() {\n"],
    "python": ['def add(a: int, b) -> int:\n    """Adds."""\n    return a\n', "class Alpha(Beta):\n    async def go(self, x):\n        pass\n", "def broken(:\n"],
}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _files(t: Tables, language: str) -> DataFrame:
    """Each document's whole text with code behind it; in Python files the text is a comment, as prose doesn't parse."""
    code = F.element_at(F.array(*map(F.lit, CODE[language])), (F.col("doc_id") % 3 + 1).cast("int"))
    comment = F.concat(F.lit("# "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x1F]", " "), F.lit("\n"), code)
    text = comment if language == "python" else F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), code)
    return t.documents.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 11 != 5, text).alias("content"))


def _files_sql(language: str) -> str:
    code = "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN {_sql(x)}" for i, x in enumerate(CODE[language])) + " END"
    return f"f AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 11 <> 5 THEN coalesce(text, '') || chr(10) || {code} END AS c FROM documents)"


_ERROR = "SELECT path, 'error' AS kind, 'PARSE_ERROR' AS name, 'no content' AS signature, path AS source, false AS doc_available, false AS probed, -1 AS rule, 0 AS ordinal FROM f WHERE c IS NULL"


def _found(n: int, pattern: str, groups: int, kind: str, name: str, signature: str, doc: str = "false", keep: str = "true", own: str = "c") -> str:
    """One rule's matches: m[1] is all of a match, m[2] its first group."""
    p = pattern.replace("'", "''")
    zipped = f"list_zip({', '.join(f'regexp_extract_all({own}, {chr(39)}{p}{chr(39)}, {g})' for g in range(groups + 1))})"
    return f"SELECT path, {kind} AS kind, {name} AS name, {signature} AS signature, path AS source, {doc} AS doc_available, false AS probed, {n} AS rule, (i - 1)::INTEGER AS ordinal FROM (SELECT path, c, unnest({zipped}) AS m, unnest(range(1, len({zipped}) + 1)) AS i FROM f WHERE c IS NOT NULL) WHERE {keep}"


def _union(language: str, *rules: str) -> str:
    return f"WITH {_files_sql(language)} " + " UNION ALL ".join([*rules, _ERROR])


_P, _S = symbols.PATTERNS, "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_JS, _RS, _JV, _KT, _CC, _PH = (_P[x] for x in ("javascript", "rust", "java", "kotlin", "c_cpp", "php"))
_NS = "coalesce(nullif(regexp_extract(c, 'namespace\\s+([\\w\\\\]+)\\s*;', 1), '') || '\\', '') || m[2]"
_DOC = "contains(c, '/**') AND contains(substr(c, strpos(c, '/**') + 3), m[2])"
_OUTSIDE = "regexp_replace(c || chr(10), '(?s)(?:abstract\\s+|final\\s+)?(?:class|trait|interface)\\s+\\w+.*?\\{.*?\\}(\\s*\\n)', '\\1', 'g')"


@query(_union(
    "javascript", _found(0, f"({_JS[0]})[^\\n]{{0,80}}", 2, "'function'", "m[3]", "trim(substr(split_part(m[1], chr(10), 1), 1, 80))"), _found(1, _JS[1], 1, "'arrow_function'", "m[2]", "'const ' || m[2] || ' = (...) =>'"),
    _found(2, _JS[2], 1, "'class'", "m[2]", "'class ' || m[2]"), _found(3, _JS[3], 1, "'interface'", "m[2]", "'interface ' || m[2]"), _found(4, _JS[4], 1, "'type'", "m[2]", "'type ' || m[2] || ' ='"),
))
def javascript_symbols(t: Tables) -> DataFrame:
    return symbols.symbols(_files(t, "javascript"), "javascript")


@query(_union(
    "rust", _found(0, _RS[0], 3, "'function'", "m[2]", f"'pub fn ' || m[2] || '(' || trim(m[3]) || ')' || CASE WHEN m[4] <> '' THEN ' -> ' || {_S.format('m[4]')} ELSE '' END"),
    _found(1, _RS[1], 1, "CASE WHEN contains(m[1], 'struct') THEN 'struct' ELSE 'enum' END", "m[2]", f"{_S.format('split_part(m[1], chr(123), 1)')} || ';'"), _found(2, _RS[2], 1, "'trait'", "m[2]", "'pub trait ' || m[2]"),
))
def rust_symbols(t: Tables) -> DataFrame:
    return symbols.symbols(_files(t, "rust"), "rust")


@query(_union(
    "java", _found(0, _JV[0], 1, "CASE WHEN contains(m[1], 'interface') THEN 'interface' WHEN contains(m[1], 'enum') THEN 'enum' ELSE 'class' END", "m[2]", _S.format("m[1]")),
    _found(1, _JV[1], 1, "'method'", "m[2]", f"substr({_S.format('m[1]')}, 1, 80)"), _found(2, _JV[2], 2, "'field'", "m[3]", "m[2] || ' ' || m[3]", keep="regexp_matches(m[3], '^\\p{Lu}.+')"),
))
def java_symbols(t: Tables) -> DataFrame:
    return symbols.symbols(_files(t, "java"), "java")


@query(_union(
    "kotlin", _found(0, _KT[0], 3, "'function'", "m[2]", f"substr('fun ' || m[2] || '(' || trim(m[3]) || ')' || CASE WHEN m[4] <> '' THEN ': ' || {_S.format('m[4]')} ELSE '' END, 1, 100)"),
    _found(1, _KT[1], 1, "'class'", "m[2]", "trim(regexp_replace(m[1], '\\s+', ' ', 'g'))"), _found(2, _KT[2], 1, "'interface'", "m[2]", "'interface ' || m[2]"),
    _found(3, _KT[3], 2, "'property'", "m[2]", f"'val ' || m[2] || CASE WHEN m[3] <> '' THEN ': ' || {_S.format('m[3]')} ELSE '' END"),
))
def kotlin_symbols(t: Tables) -> DataFrame:
    return symbols.symbols(_files(t, "kotlin"), "kotlin")


@query(_union("c_cpp", _found(0, _CC[0], 1, "'function'", "m[2]", f"substr({_S.format('split_part(m[1], chr(123), 1)')}, 1, 80)"), _found(1, _CC[1], 1, "'typedef'", "m[2]", "'typedef ... ' || m[2]"), _found(2, _CC[2], 1, "'struct'", "m[2]", "'struct ' || m[2]")))
def c_symbols(t: Tables) -> DataFrame:
    return symbols.symbols(_files(t, "c_cpp"), "c_cpp")


@query(_union(
    "php", _found(0, _PH[0], 1, "'class'", _NS, "'class ' || m[2]", _DOC), _found(1, _PH[1], 1, "'interface'", _NS, "'interface ' || m[2]", _DOC), _found(2, _PH[2], 1, "'trait'", _NS, "'trait ' || m[2]"),
    _found(3, _PH[3], 1, "'function'", "m[2]", "'function ' || m[2] || '(...)'", own=_OUTSIDE), _found(4, _PH[4], 1, "'constant'", "m[2]", "'define(''' || m[2] || ''', ...)'"), _found(5, _PH[5], 1, "'class_constant'", "m[2]", "'const ' || m[2] || ' ='"),
    _found(6, _PH[6], 1, "'enum'", _NS, "'enum ' || m[2]"),
))
def php_symbols(t: Tables) -> DataFrame:
    return symbols.symbols(_files(t, "php"), "php")


_GO = _P["go"]


@query(f"""WITH {_files_sql("go")}, l AS (SELECT path, n, {_S.format("x")} AS l, {_S.format("lag(x, 1, '') OVER (PARTITION BY path ORDER BY n)")} AS before FROM (SELECT path, unnest(string_split(c, chr(10))) AS x, unnest(range(len(string_split(c, chr(10))))) AS n FROM f WHERE c IS NOT NULL)),
s AS (SELECT *, {", ".join(f"regexp_extract(l, '{p}', 1) AS g{i}" for i, p in enumerate(_GO))} FROM l WHERE NOT starts_with(l, '//') AND NOT starts_with(l, '/*'))
SELECT path, CASE WHEN g0 <> '' THEN 'function' WHEN g1 <> '' THEN 'method' WHEN g2 <> '' THEN CASE WHEN contains(l, 'interface') THEN 'interface' WHEN contains(l, 'struct') THEN 'struct' ELSE 'type' END WHEN g3 <> '' THEN 'constant' ELSE 'variable' END AS kind, coalesce(nullif(g0, ''), nullif(g1, ''), nullif(g2, ''), nullif(g3, ''), g4) AS name, l AS signature,
 path || ':' || (n + 1)::VARCHAR AS source, starts_with(before, '//') OR starts_with(before, '/*') AS doc_available, false AS probed, 0 AS rule, n::INTEGER AS ordinal FROM s WHERE g0 || g1 || g2 || g3 || g4 <> '' UNION ALL {_ERROR}""")
def go_symbols(t: Tables) -> DataFrame:
    return symbols.symbols(_files(t, "go"), "go")


_PY = [("0", "function", "add", "def add(a: int, b) -> int", "1", "true", 0), ("1", "class", "Alpha", "class Alpha(Beta)", "1", "false", 0), ("1", "async_function", "go", "async def go(self, x)", "2", "false", 1)]


@query(f"""WITH f AS (SELECT doc_id, doc_id::VARCHAR AS path, doc_id % 11 <> 5 AS has FROM documents), v(k, kind, name, signature, line, doc, ordinal) AS (VALUES {", ".join(map(str, _PY))})
SELECT path, kind, name, signature, path || ':' || (line::INTEGER + 1)::VARCHAR AS source, doc = 'true' AS doc_available, false AS probed, 0 AS rule, ordinal FROM f JOIN v ON (doc_id % 3)::VARCHAR = k WHERE has
UNION ALL SELECT path, 'error', 'PARSE_ERROR', CASE WHEN has THEN 'broken' ELSE 'no content' END, path, false, false, -1, 0 FROM f WHERE NOT has OR doc_id % 3 = 2""")
def python_symbols(t: Tables) -> DataFrame:
    out = symbols.symbols(_files(t, "python"), "python")  # the parser's message differs between versions
    return out.withColumn("signature", F.when((F.col("kind") == "error") & (F.col("signature") != "no content"), "broken").otherwise(F.col("signature")))


# The SQL engine's word characters are ASCII: there the pattern names those of all scripts.
_LOOSE = symbols.LOOSE.replace(r"\w", r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]")


@query(f"""WITH {_files_sql("rust")}, m AS (SELECT path, unnest(list_zip(regexp_extract_all(c, '{_LOOSE}', 1), regexp_extract_all(c, '{_LOOSE}', 2))) AS m FROM f WHERE c IS NOT NULL)
SELECT DISTINCT path, symbol FROM (SELECT path, coalesce(nullif(m[1], ''), m[2]) AS symbol FROM m) WHERE symbol <> '' AND symbol NOT IN ('if', 'for', 'while', 'return', 'import')""")
def loose_symbols(t: Tables) -> DataFrame:
    return symbols.loose_symbols(_files(t, "rust"))


_TABLES = """
sections AS (SELECT p_partkey::VARCHAR AS section_id, 'docs/' || p_brand || '.md' AS doc_path FROM part), annotations AS (SELECT 'src/' || l_orderkey::VARCHAR AS path, l_linenumber AS line, (l_partkey + l_suppkey % 3 * 1000)::VARCHAR AS section_id FROM lineitem WHERE l_quantity > 40),
links AS (SELECT 'docs/' || p_brand || '.md' AS doc_path, CASE p_size % 5 WHEN 0 THEN 'http://x' WHEN 1 THEN 'src/a' WHEN 2 THEN 'modules/' || (p_size % 7)::VARCHAR WHEN 3 THEN 'schema/x' ELSE p_brand END AS target FROM part),
docs AS (SELECT DISTINCT 'docs/' || p_brand || '.md' AS doc_path FROM part WHERE p_size > 45 UNION SELECT 'docs/modules/' || n_nationkey::VARCHAR || '.md' FROM nation WHERE n_nationkey % 3 = 0), modules AS (SELECT n_name AS module, 'docs/modules/' || n_nationkey::VARCHAR || '.md' AS doc_path FROM nation WHERE n_nationkey % 2 = 0),
issues AS (SELECT 'warning' AS severity, 'orphan_section' AS type, section_id AS subject, doc_path AS location FROM sections ANTI JOIN annotations USING (section_id) UNION ALL SELECT 'error', 'broken_ref', section_id, path || ':' || line::VARCHAR FROM annotations ANTI JOIN sections USING (section_id)
 UNION ALL SELECT 'warning', 'broken_wiki_link', target, doc_path FROM links WHERE NOT starts_with(target, 'http') AND NOT starts_with(target, 'src/') AND NOT starts_with(target, 'schema/') AND 'docs/' || target || '.md' NOT IN (SELECT doc_path FROM docs)
 UNION ALL SELECT 'error', 'missing_doc', module, doc_path FROM modules ANTI JOIN docs USING (doc_path) UNION ALL SELECT 'warning', 'orphan_doc', doc_path, doc_path FROM docs ANTI JOIN modules USING (doc_path))"""


def _issues(t: Tables) -> DataFrame:
    page = lambda c: F.concat(F.lit("docs/"), c, F.lit(".md"))
    module = page(F.concat(F.lit("modules/"), "n_nationkey"))
    s = F.col("p_size") % 5
    target = F.when(s == 0, "http://x").when(s == 1, "src/a").when(s == 2, F.concat(F.lit("modules/"), F.col("p_size") % 7)).when(s == 3, "schema/x").otherwise(F.col("p_brand"))
    return integrity.issues(
        t.part.select(F.col("p_partkey").cast("string").alias("section_id"), page(F.col("p_brand")).alias("doc_path")),
        t.lineitem.filter("l_quantity > 40").select(F.concat(F.lit("src/"), "l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") + F.col("l_suppkey") % 3 * 1000).cast("string").alias("section_id")),
        t.part.select(page(F.col("p_brand")).alias("doc_path"), target.alias("target")),
        t.part.filter("p_size > 45").select(page(F.col("p_brand")).alias("doc_path")).distinct().unionByName(t.nation.filter("n_nationkey % 3 = 0").select(module.alias("doc_path"))),
        t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("module"), module.alias("doc_path")),
    )


@query(f"WITH {_TABLES} SELECT * FROM issues")
def integrity_issues(t: Tables) -> DataFrame:
    return _issues(t)


@query(f"WITH {_TABLES}, c AS (SELECT type, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues GROUP BY 1) SELECT *, CASE WHEN errors + warnings > 0 THEN 2 ELSE 0 END AS exit_code FROM c")
def strict_severity(t: Tables) -> DataFrame:
    return integrity.severity(_issues(t), ["type"], strict=True)


def _path(c: str) -> Column:
    return F.regexp_extract(c, "://([^?#]*)", 1)


@query("""
WITH f AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), s AS (SELECT page_id AS seq, 'm' || page_id::VARCHAR AS module, string_split(path, '/')[2] AS source FROM f WHERE page_id % 2 = 0 AND len(string_split(path, '/')) > 2),
d AS (SELECT left(source, 3) AS source, arg_min(module, seq) AS module, min(seq) AS seq FROM s WHERE source <> '' GROUP BY 1)
SELECT page_id, path, (SELECT arg_min(module, seq) FROM d WHERE contains(path, source)) AS module FROM f""")
def module_of_file(t: Tables) -> DataFrame:
    files = t.pages.select("page_id", _path("url").alias("path"))
    sources = files.filter((F.col("page_id") % 2 == 0) & (F.size(F.split("path", "/")) > 2)).select(F.col("page_id").alias("seq"), F.concat(F.lit("m"), "page_id").alias("module"), F.left(F.split("path", "/")[1], F.lit(3)).alias("source")).filter("source <> ''")
    return integrity.module_of_file(files, sources)


@query("""
WITH w AS (SELECT DISTINCT ['docs/modules/', 'docs/', 'lat.md/', ''][(p_partkey % 4)::INTEGER + 1] || split_part(p_name, ' ', 2) || '#Part' AS section_id, split_part(p_name, ' ', 2) AS bare FROM part), s AS (SELECT p_name || '#' || p_brand AS sid, p_partkey AS seq, p_type AS doc_path FROM part WHERE p_size < 10)
SELECT section_id, arg_min(doc_path, seq) AS doc_path FROM w LEFT JOIN s ON contains(sid, bare) GROUP BY 1""")
def infer_document(t: Tables) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, ["docs/modules/", "docs/", "lat.md/", ""])), (F.col("p_partkey") % 4 + 1).cast("int"))
    wanted = t.part.select(F.concat(prefix, F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("#Part")).alias("section_id")).distinct()
    return integrity.infer_document(wanted, t.part.filter("p_size < 10").select(F.concat_ws("#", "p_name", "p_brand").alias("section_id"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("doc_path")))


@query("""
WITH c AS (SELECT user_id, event_id, CASE WHEN user_id % 3 <> 0 THEN b END AS base FROM events LEFT JOIN (SELECT user_id, min(event_id) + 5000 AS b FROM events GROUP BY 1) USING (user_id)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM c)
SELECT user_id, event_id FROM r WHERE event_id > base OR base IS NULL AND n <= 30""")
def bounded_log(t: Tables) -> DataFrame:
    base = t.events.groupBy("user_id").agg((F.min("event_id") + 5000).alias("b"))
    e = t.events.join(base, "user_id").select("user_id", "event_id", F.when(F.col("user_id") % 3 != 0, F.col("b")).alias("base"))
    return integrity.bounded_log(e, "user_id", "event_id", "base").select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' OR l_linenumber = 3")
def filter_by_line(t: Tables) -> DataFrame:
    """Only rows of the line asked for; where none is asked for, all."""
    asked = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", 3).alias("line"))
    return t.lineitem.join(asked, "l_orderkey").filter(F.col("line").isNull() | (F.col("l_linenumber") == F.col("line"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _lateral(t: Tables, language: str) -> DataFrame:
    """The language's rows by its table function, in SQL."""
    analyzers.register(t.spark)
    return t.spark.sql(f"SELECT path, s.* FROM {{files}}, LATERAL symbols_{language}(content) AS s", files=_files(t, language))


@query(" UNION ALL ".join(f"SELECT '{x}' AS language, path, kind, name, signature, doc_available, rule, ordinal FROM ({ORACLES[q]})" for x, q in {"javascript": "javascript_symbols", "rust": "rust_symbols", "java": "java_symbols", "kotlin": "kotlin_symbols", "c_cpp": "c_symbols", "php": "php_symbols", "go": "go_symbols", "python": "python_symbols"}.items()))
def lateral_symbols(t: Tables) -> DataFrame:
    """The symbols of every language by table functions over whole texts."""
    every = [_lateral(t, x).withColumn("language", F.lit(x)) for x in analyzers.LANGUAGES]
    rows = reduce(DataFrame.unionByName, every)
    broken = (F.col("language") == "python") & (F.col("kind") == "error") & (F.col("signature") != "no content")
    return rows.withColumn("signature", F.when(broken, "broken").otherwise(F.col("signature")))


@query(f"""WITH s AS (SELECT l.language || ':' || coalesce(source, '') AS package, l.* EXCLUDE (language), doc_id FROM (SELECT * FROM ({ORACLES["lateral_symbols"]})) l JOIN documents ON doc_id::VARCHAR = path WHERE kind <> 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY doc_id, rule, ordinal, name) AS n FROM s), k AS (SELECT DISTINCT package, name, dense_rank() OVER (PARTITION BY package ORDER BY name) AS n FROM s WHERE kind = 'function'),
w AS (SELECT package, string_agg(name, ',' ORDER BY n) AS keywords FROM k WHERE n <= 15 GROUP BY package), g AS (SELECT package, count(*) AS n_symbols, string_agg(name, ',' ORDER BY n) FILTER (n <= 30) AS exports, CASE WHEN count(*) > 10 THEN 'medium' ELSE 'low' END AS complexity FROM r GROUP BY package)
SELECT package, n_symbols, exports, coalesce(keywords, '') AS keywords, complexity FROM g LEFT JOIN w USING (package)""")
def package_audit(t: Tables) -> DataFrame:
    """An audit of each source's files in every language, over whole texts."""
    source = t.documents.select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("source", F.lit("")).alias("of"))
    every = [symbols.symbols(_files(t, x), x).filter("kind <> 'error'").select("path", "kind", "name", "rule", "ordinal", F.lit(x).alias("language")) for x in analyzers.LANGUAGES]
    rows = reduce(DataFrame.unionByName, every).join(source, "path").withColumn("package", F.concat_ws(":", "language", "of"))
    return symbols.audit(rows, "package", ["doc_id", "rule", "ordinal", "name"]).withColumns({"exports": F.array_join("exports", ","), "keywords": F.array_join("keywords", ",")})


def _tree(t: Tables) -> str:
    """A folder of source files and documents, one for each supplier and kind, written file by file."""
    folder, k = answers.folder_for(t.spark, "tree"), F.col("s_suppkey")
    place = F.concat(F.when(k % 5 == 0, "node_modules/").when(k % 5 == 1, "docs/").otherwise("src/"), F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/f"), k.cast("string"))
    files = t.supplier.select(F.explode(F.array(*(F.struct(F.concat(place, F.lit(end)).alias("name"), F.concat(F.lit(head), "s_name").alias("content")) for end, head in ((".py", "x = "), (".md", "# "), (".txt", ""))))).alias("f")).select("f.*")
    sinks.write_skeleton(files, folder)
    return folder


_TREE = "SELECT CASE s_suppkey % 5 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'docs/' ELSE 'src/' END || 'n' || s_nationkey::VARCHAR || '/f' || s_suppkey::VARCHAR || {end} AS path, {head} || s_name AS content, length({head} || s_name)::BIGINT AS length FROM supplier WHERE {keep}"


def _below(files: DataFrame, folder: str) -> DataFrame:
    return files.select(F.element_at(F.split("path", folder.rsplit("/", 1)[1] + "/"), -1).alias("path"), "content", "length")


@query(_TREE.format(end="'.py'", head="'x = '", keep="s_suppkey % 5 <> 0"))
def source_walk(t: Tables) -> DataFrame:
    """Source files by their suffix, without those below skipped folders."""
    folder = _tree(t)
    return _below(readers.source_files(t.spark, folder, [".py"], ["node_modules"]), folder)


@query(_TREE.format(end="'.md'", head="'# '", keep="s_suppkey % 5 = 1"))
def markdown_walk(t: Tables) -> DataFrame:
    folder = _tree(t)
    return _below(readers.source_files(t.spark, folder, [".md"], ["node_modules", "src"]), folder)
