"""The library's queries against their SQL, and operators without SQL against plain Python."""

import collections
import hashlib
import math
import os
import random
import re
import time
from decimal import ROUND_HALF_UP, Decimal
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.functions import capabilities
from skein.functions import constants as C
from skein.functions import scalars as S
from skein.operators import analyzers, dedup, extract, folds, integrity, joins, matching, ranking, state, symbols
from skein.operators.dedup_index import DedupIndex
from skein.plans import queries as library
from skein.sources import answers, readers, sinks
from skein.streaming import stateful, streams

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float | Decimal):
        return None if math.isnan(v) else repr(round(float(v), 9))
    if isinstance(v, list | tuple):
        return [norm(x) for x in v]
    return v if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([norm(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", list(library.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    want = duck.execute(library.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def ratio(a, b):
    if not a or not b:
        return 0.0
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return 1 - d[-1] / max(len(a), len(b))


def greedy(rows, t, same=lambda a, b: True):
    kept = []
    for k, s, g in rows:
        if not s or not any(o and same(g, h) and (o == s or ratio(o, s) >= t - 1e-12) for _, o, h in kept):
            kept.append((k, s, g))
    return {k for k, _, _ in kept}


@pytest.mark.parametrize("t", [0.85, 0.75])
def test_fuzzy_dedup_equals_the_sequential_rule(spark, t):
    import random

    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(4, 24))).strip() or "x" for _ in range(25)]
    rows = []
    for i in range(160):
        s = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(s) + 1)
            s[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "q"])
        rows.append((i, "".join(s).strip() if i % 40 else "", rnd.choice("uv")))
    df = spark.createDataFrame(rows, "k long, s string, g string")
    assert {r.k for r in dedup.fuzzy_dedup(df, "s", "k", t).collect()} == greedy(rows, t)
    assert {r.k for r in dedup.fuzzy_dedup(df, "s", "k", t, ["g"]).collect()} == greedy(rows, t, lambda a, b: a == b)


def test_dropped_rows_drop_nobody(spark):
    df = spark.createDataFrame([(1, "aaaaaaaaaa"), (2, "aaaaaaaaab"), (3, "aaaaaaaabb")], "k long, s string")
    assert [r.k for r in dedup.fuzzy_dedup(df, "s", "k", 0.85).orderBy("k").collect()] == [1, 3]


def test_first_per_key_keeps_blank_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, " ")], "k long, h string")
    assert [r.k for r in dedup.first_per_key(df, F.col("h"), "k").orderBy("k").collect()] == [1, 3, 4, 5]


def test_greedy_match_takes_sources_in_order(spark):
    rows = [("g", 1, 1, 0.9), ("g", 1, 2, 0.8), ("g", 2, 1, 0.95), ("g", 2, 2, 0.2), ("g", 3, 2, 0.3), ("h", 1, 1, 0.1)]
    got = matching.greedy_match(spark.createDataFrame(rows, "g string, s long, d long, x double"), ["g"], "s", "d", "x")
    assert sorted((r.g, r.s, r.d) for r in got.collect()) == [("g", 1, 1), ("g", 3, 2)]


def test_deferred_acceptance_equals_turns_and_spreads_one_group(spark):
    rnd = random.Random(3)
    pairs = {(g, s, d): rnd.choice([0.1, 0.3, 0.5, 0.5, 0.8, 1.0]) for g in ("a", None) for s in range(25) for d in range(20) if rnd.random() < 0.7}
    df = spark.createDataFrame([(*k, x, "n") for k, x in pairs.items()], "g string, s long, d long, x double, note string").repartition(4)
    rounds = []
    got = {(r.g, r.s): r.d for r in matching.greedy_match(df, ["g"], "s", "d", "x", rounds=rounds).collect()}
    want = {}
    for g in ("a", None):
        taken = set()
        for s in range(25):
            able = [(-x, d) for (h, t, d), x in pairs.items() if h == g and t == s and x >= 0.3 and d not in taken]
            if able:
                want[g, s] = min(able)[1]
                taken.add(min(able)[1])
    assert got == want and rounds[-1] == 0 and len(rounds) > 2 and sum(rounds) >= 50 - len(want)
    one = spark.createDataFrame([(i, f"name{i % 97}") for i in range(600)], "p_partkey long, p_name string").withColumn("p_brand", F.lit("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = matching.similarity_pairs(one.filter("p_partkey % 2 = 0"), one.filter("p_partkey % 2 = 1").hint("merge"), ["p_brand"], "p_name", "p_partkey").withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) == 4 and sum(r["count"] for r in spread) == 300 * 300 and max(r["count"] for r in spread) < 60_000


def test_folds_over_whole_groups(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot"] * 8 + ["x", "", None]), rnd.choice([None, *range(4000)]), rnd.choice([None, "", "a", "é", "long" * 9])) for _ in range(6000)] + [("x", 5, "same")] * 3
    df = spark.createDataFrame([(*r, "n") for r in rows], "g string, k long, v string, _run string").repartition(5)
    want = collections.defaultdict(list)
    for g, k, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        want[g].append(v or "")
    digests = {r.g: r.digest for r in folds.ordered_digest(df, ["g"], ["k"], "v").collect()}
    assert digests == {g: hashlib.sha256("".join(v).encode()).hexdigest() for g, v in want.items()}
    assert {r.g: r.members for r in folds.ordered_join(df, ["g"], ["k"], "v").collect()} == {g: ",".join(v) for g, v in want.items()}
    assert folds.ordered_digest(df.limit(0), ["g"], ["k"], "v").count() == 0


def test_saved_answers_are_pruned_by_backend_and_key(spark, tmp_path):
    rows = [(b, f"k{i}", f'{{"n":"{b}{i}\\n"}}') for b in ("rust", "go", "php") for i in range(200)] + [("go", "é", "x" * 3_000_000), (None, "k", "b"), ("go", None, "b"), ("go", "k1", "again")]
    df = spark.createDataFrame(rows, "backend string, key string, body string").withColumn("part", F.lit("n"))
    answers.save(df.limit(0), f"{tmp_path}/none")
    answers.save(df, f"{tmp_path}/all")
    load = lambda: answers.read(spark, f"{tmp_path}/all")
    kept = sorted(r for r in rows if r[0] and r[1])
    assert sorted(map(tuple, load().collect())) == kept and load().rdd.getNumPartitions() >= 48
    for condition, want in {
        "backend = 'go'": lambda r: r[0] == "go", "key = 'k7'": lambda r: r[1] == "k7", "backend IN ('go', 'php') AND key IN ('k1', 'é') AND length(body) > 5": lambda r: r[0] in ("go", "php") and r[1] in ("k1", "é") and len(r[2]) > 5,
        "backend = 'c'": lambda r: False, "key > 'k5' AND backend = 'rust'": lambda r: r[1] > "k5" and r[0] == "rust", "key IS NULL": lambda r: False, "backend = 'go' OR key = 'k2'": lambda r: r[0] == "go" or r[1] == "k2",
    }.items():
        found = load().filter(condition)
        assert sorted(map(tuple, found.collect())) == sorted(filter(want, kept)), condition
    opened = lambda c: load().filter(c).rdd.getNumPartitions()
    assert opened("backend = 'go'") * 3 <= load().rdd.getNumPartitions() + 9 and opened("key = 'k7'") <= 3 + 3 and opened("backend = 'go' AND key = 'k7'") <= 2
    assert answers.read(spark, f"{tmp_path}/none").count() == 0 if os.path.isdir(f"{tmp_path}/none") else True


def test_more_backends_can_be_registered(spark, tmp_path):
    answers.save(spark.createDataFrame([("mine", "q", "a,b"), ("rust", "q", '{"crates":[{"name":"x"}],"meta":{"total":1}}')], "backend string, key string, body string"), str(tmp_path))
    answers.register_backend("mine", lambda a: a.select("key", F.posexplode(F.split("body", ",")).alias("position", "name")))
    try:
        backends = {"rust": answers.default_backends("2024-01-01", 0, spark.createDataFrame([], "port string, version string"))["rust"]}
        rows = answers.search_rows(spark, str(tmp_path), backends)
        assert sorted((r.backend, r.position, r.name, r.score) for r in rows.select("backend", "position", "name", "score").collect()) == [("mine", 0, "a", 0.0), ("mine", 1, "b", 0.0), ("rust", 0, "x", 0.0)]
        plan = rows.filter("backend = 'mine'")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BatchScan") == 1
    finally:
        del answers.BACKENDS["mine"]


def test_contains_join_keys_needles_by_their_rarest_sequence(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(0, 12))) for _ in range(120)] + [None, "", "İx", "AbC", "abc"]
    needles = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(80)] + [None, "", "ABC", "i", "zzz", "abc"]
    hay = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "id long, t string, key string")
    for case in (False, True):
        low = (lambda x: x) if case else str.lower
        want = sorted((n, i) for n in needles for i, t in enumerate(texts) if n and t and low(n) in low(t) and "İ" not in t)
        got = joins.contains_join(spark.createDataFrame([(n, 1) for n in needles], "n string, part int"), hay.filter("t is null or t <> 'İx'"), "n", "t", case=case)
        assert sorted((r.n, r.id) for r in got.collect()) == want and got.columns == ["n", "part", "id", "t", "key"]
    # Needles that share a beginning, and a sequence that every text holds.
    rows = spark.range(20_000).select(F.col("id"), F.concat(F.lit("get_"), F.conv(F.xxhash64("id").cast("string"), 10, 36)).alias("t"))
    asked = rows.filter("id % 50 = 0").select(F.substring("t", 1, 8).alias("n")).distinct()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = joins.contains_join(asked.hint("merge"), rows, "n", "t").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = sorted(r["count"] for r in found)
    assert sum(sizes) >= 400 and sizes[-1] <= 4 * sizes[len(sizes) // 2]


def test_contains_join_never_broadcasts_the_sequences_of_texts(spark, tmp_path):
    spark.range(3000).select("id", F.concat(F.lit("name "), F.col("id").cast("string")).alias("t")).write.parquet(f"{tmp_path}/texts")
    rows = spark.read.parquet(f"{tmp_path}/texts")
    asked = rows.filter("id < 40").select(F.substring("t", 6, 9).alias("n")).distinct()

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    few, many = joins.contains_join(asked, rows, "n", "t"), joins.contains_join(asked, rows, "n", "t", few=0)
    assert "Inner, BuildLeft" in plan(few) and "Inner, BuildRight" not in plan(few).split("BuildLeft")[0]  # the needles are sent
    assert "Broadcast" not in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == sum(str(n) in str(i) for n in range(40) for i in range(3000))


def test_symbols_read_a_text_once_for_each_pattern(spark):
    df = spark.createDataFrame([("a", "export default async function go(x) { return 1 }\n  async function\n* b(")], "path string, content string")
    rows = symbols.symbols(df, "javascript")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= len(symbols.PATTERNS["javascript"]) + 1
    assert [(r.name, r.signature) for r in rows.collect()] == [("go", "export default async function go(x) { return 1 }"), ("b", "async function")]


def test_audit_reads_its_rows_once(spark):
    rows = spark.createDataFrame([("p", "function", f"f{i:02}", i) for i in range(12)], "package string, kind string, name string, n long")
    read = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            read.add(len(f))
            yield f

    got = symbols.audit(rows.mapInPandas(run, rows.schema), "package", ["n"]).collect()
    assert read.value == 12 and [(r.n_symbols, len(r.exports), len(r.keywords), r.complexity) for r in got] == [(12, 12, 12, "medium")]


def test_analyzers_patterns_equal_those_stated():
    rnd = random.Random(8)
    words = sorted({w for ps in symbols.PATTERNS.values() for p in ps for w in re.findall(r"[a-z@]{2,}", p)}) + ["x", "Y1", "(", ")", "{", "}", "=", ":", ";", ",", "\n", "<T>", "/**"]
    for _ in range(60):
        text = "".join(rnd.choice(words) + rnd.choice(["", " ", " ", "\n", "  "]) for _ in range(80))
        for language, patterns in symbols.PATTERNS.items():
            for p, fast in zip(patterns, analyzers.FAST[language], strict=True):
                assert [(m.span(), m.groups()) for m in re.finditer(p, text)] == [(m.span(), m.groups()) for m in re.finditer(fast, text)]
        assert re.sub(symbols.PHP_BODY, "", text) == re.sub(analyzers.FAST_BODY, "", text)
    assert all(not p.startswith("(?:") or fast.count("|") for p, fast in zip(symbols.PATTERNS["javascript"], analyzers.FAST["javascript"], strict=True))


def test_kotlin_and_param_queries_take_every_part(spark, tmp_path):
    parts = [(i, "b", f"n{i % 2} x", "KT" if i > 30 else "t", 3, 1.0) for i in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    rows = library.QUERIES["kotlin_rows"](spark, str(tmp_path)).collect()
    assert len(rows) == 40 and sorted(r.position for r in rows) == list(range(40)) and not any(r.has_more for r in rows)
    params = library.QUERIES["param_matches"](spark, str(tmp_path))
    assert "Aggregate" in params._jdf.queryExecution().optimizedPlan().toString()  # equal pairs are matched once
    assert params.count() == 40


def test_coverage_takes_first_gaps_of_either_direction(spark):
    rnd = random.Random(7)
    words = ["cache", "Cache layer", "a cache layer for all", "", None, "queue", "QUEUE", "zz", "é"]
    gaps = [(rnd.choice(["r1", "r2", "r3"]), i, rnd.choice(words), rnd.choice(["yes", "partial", "no", None])) for i in range(12)] + [("r4", 99, "none", "yes")]
    asked = ["cache", "layer", "the QUEUE here", "", "xyz", "Cache Layer", "É"]
    for drop in (False, True):
        own, wanted = ([g for g in gaps if g[2]], [a for a in asked if a]) if drop else (gaps, asked)
        got = joins.coverage(spark.createDataFrame(own, "repo string, n long, text string, status string"), "repo", "text", "n", "status", spark.createDataFrame([(a,) for a in wanted], "req string"), "req", S.normalize_status)
        want = {}
        for repo in {g[0] for g in own}:
            for a in wanted:
                fits = [g for g in sorted(own, key=lambda g: g[1]) if g[0] == repo and ((g[2] or "").lower() in a.lower() or a.lower() in (g[2] or "").lower())]
                want[repo, a] = {"yes": "supported", "partial": "partial"}.get((fits[0][3] if fits else None) or "", "missing")
        assert {(r.repo, r.requirement): r.status for r in got.collect()} == want


def test_greedy_by_name_equals_all_pairs(spark):
    rnd = random.Random(9)
    names = ["ring", "rings", "big ring", "bolt", "bold", "b_olt", "zzz", "", None]
    rows = spark.createDataFrame([(i, rnd.choice(["a", "b", None]), rnd.choice(names)) for i in range(240)], "k long, g string, n string")
    src, dst = rows.filter("k % 2 = 0"), rows.filter("k % 2 = 1")
    pairs = matching.greedy_match(matching.similarity_pairs(src, dst, ["g"], "n", "k"), ["g"], "src", "dst", "similarity")
    got = matching.greedy_by_name(src, dst, "g", "n", "k")
    assert got.columns == pairs.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and pairs.count() > 40


def test_train_queries_deal_lines_by_order_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [library.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for name in ("train_rows", "train_stop_rows")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any(re.search(r"hashpartitioning\((key|ok|l_orderkey#\d+L, ok)", plan) for plan in plans)


def test_greedy_match_query_takes_all_parts(spark, tmp_path):
    names = ["small ring", "red_bolt", "red bolts", "ring", "widget", "zzz"]
    parts = [(1990 + i, f"b{i % 3}", names[i * i % 5 if i % 4 else i % 6], "t") for i in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    pairs = [(a[1], a[0], b[0], a[2], b[2]) for a in parts for b in parts if a[1] == b[1] and a[0] % 2 == 0 and b[0] % 2 == 1]
    scored = spark.createDataFrame(pairs, "g string, s long, d long, x string, y string").withColumn("score", S.name_similarity(F.col("x"), F.col("y"))).collect()
    want, done, taken = [], set(), set()
    for r in sorted(scored, key=lambda r: (r.s, -r.score, r.d)):
        if r.score >= 0.3 and r.s not in done and r.d not in taken:
            done.add(r.s)
            taken.add(r.d)
            want.append((r.s, r.d))
    got = sorted((r.src, r.dst) for r in library.QUERIES["greedy_match"](spark, str(tmp_path)).collect())
    assert got == sorted(want) and max(s for s, _ in got) >= 2000


def test_heading_chain_is_a_stack(spark):
    df = spark.createDataFrame([("f", "# A\n### B\n## C\n### D\n# <!-- t -->\n# E\n## F")], "path string, content string")
    assert [r.chain for r in extract.headings(df).orderBy("pos").collect()] == [["A"], ["A", "B"], ["A", "C"], ["A", "C", "D"], ["E"], ["E", "F"]]


def test_headings_equal_a_stack_in_python(spark):
    rnd = random.Random(11)
    bits = ["# A", "## A", "#  B b ", "### C", "####### x", "say # A", "# <!-- p -->", "#", "", "\u2028# D", "text", "# A # A", "#\tT\r", "🙂 é", "###### <!-- a --> b"]
    texts = ["\n".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(150)] + [None, "", "# end\n"]
    want = []
    for i, text in enumerate(texts):
        stack = []
        for m in re.finditer(r"^(#{1,6})\s+(.+)$", text or "", re.MULTILINE):
            title = re.sub(r"^<!--.*?-->$", "", m[2].strip()).strip()
            if title:
                while stack and stack[-1][0] >= len(m[1]):
                    stack.pop()
                stack.append((len(m[1]), title))
                chain = [x for _, x in stack]
                want.append((f"d/f{i}.md", m.start(), len(m[1]), chain, f"d/f{i}#" + "#".join(chain), f"f{i}#" + "#".join(chain)))
    df = spark.createDataFrame([(f"d/f{i}.md", x, 1) for i, x in enumerate(texts)], "path string, content string, pos int")
    assert sorted(tuple(r) for r in extract.headings(df).select("path", "offset", "level", "chain", "section_id", "short_id").collect()) == sorted(want)


def test_manifest_is_carried_on(spark, tmp_path):
    def files(**prints):
        return spark.createDataFrame([(p.replace("__", "/") + ".py", h, t) for p, (h, t) in prints.items()], "path string, fingerprint string, mtime long")

    step = lambda f: sorted((r.module, r.type) for r in readers.step_manifest(spark, f"{tmp_path}/m", f).collect())
    known = lambda: {r.module: (r.doc_status, r.mtime) for r in spark.read.parquet(f"{tmp_path}/m/modules").filter(f"version = {n}").collect()}
    one = files(src__a__x=("1", 5), src__a__y=("2", 6), src__b__z=("3", 7), c__w=("4", 8))
    n = 0
    assert step(one) == [("a", "needs_create"), ("b", "needs_create"), ("c", "needs_create")] and known() == {"a": ("needs_create", 6), "b": ("needs_create", 7), "c": ("needs_create", 8)}
    n = 1
    assert step(one) == [] and {v[0] for v in known().values()} == {"needs_create"}  # statuses are kept
    n = 2
    two = files(src__a__x=("1", 5), src__b__z=("9", 70), src__b__v=("5", 1), src__d__q=("6", 2))
    assert step(two) == [("a", "file_changed"), ("a", "file_missing"), ("b", "file_changed"), ("b", "needs_create"), ("c", "file_missing"), ("c", "needs_delete"), ("d", "needs_create")]
    assert known() == {"a": ("needs_update", 5), "b": ("needs_update", 70), "c": ("needs_delete", 8), "d": ("needs_create", 2)}
    sources = spark.read.parquet(f"{tmp_path}/m/sources").filter("version = 2")
    assert sorted((r.module, r.pos, r.path) for r in sources.collect()) == [("a", 0, "src/a/x.py"), ("b", 0, "src/b/z.py"), ("c", 0, "c/w.py"), ("d", 0, "src/d/q.py")]
    n = 3
    assert step(files()) == sorted([(m, "file_missing") for m in "abcd"] + [(m, "needs_delete") for m in "abcd"])


def test_module_of_file_is_plain_containment(spark):
    files = spark.createDataFrame([(p,) for p in ("src/core/a.py", "lib/xcore.py", "README", "b/ab/c")], "path string")
    sources = [("m2", 2, "core"), ("m1", 1, "src/core"), ("m3", 3, "README"), ("m4", 4, "Core"), ("m5", 5, "b/c")]
    for more, rest in (([], None), ([("m0", 9, "")], "m0")):
        got = {r.path: r.module for r in integrity.module_of_file(files, spark.createDataFrame(sources + more, "module string, seq int, source string")).collect()}
        assert got == {"src/core/a.py": "m1", "lib/xcore.py": "m2", "README": "m3", "b/ab/c": "m5"} | {k: rest for k in got if rest and k == "none"}


@pytest.mark.parametrize("language, text, want", [
    ("rust", "pub fn run(x: i32) -> u8 {}\npub struct Job;\npub enum E {", [("function", "run"), ("struct", "Job"), ("enum", "E")]),
    ("javascript", "export class A extends B {}\nconst go = (x) => x\nfunction add(a) {}\ntype T = 1", [("function", "add"), ("arrow_function", "go"), ("class", "A"), ("type", "T")]),
    ("java", "public class A {\n public int run(int x) {}\n static final int MAX = 3;\n}", [("class", "A"), ("method", "run"), ("field", "MAX")]),
    ("kotlin", "fun main() {}\ndata class P(val x: Int)\nval y = 3", [("function", "main"), ("class", "P"), ("property", "x")]),
    ("c_cpp", "static int f(int a) {\n}\nstruct S {\n};", [("function", "f"), ("struct", "S")]),
    ("go", "func Run(a int) {\n}\nfunc (s *S) Do() {\n}\ntype Job struct {", [("function", "Run"), ("method", "Do"), ("struct", "Job")]),
    ("php", "final class A {}\ninterface I {}\nfunction f() {}", [("class", "A"), ("interface", "I"), ("function", "f")]),
])
def test_declarations(spark, language, text, want):
    df = spark.createDataFrame([("f", text), ("null", None)], "path string, content string")
    got = symbols.symbols(df, language).orderBy("rule", "ordinal").collect()
    assert [(r.kind, r.name) for r in got] == [("error", "PARSE_ERROR"), *want]
    assert not any(r.probed for r in got) and all(r.signature and r.path in r.source for r in got)


def test_python_declarations(spark):
    df = spark.createDataFrame([("a", 'class A(B, C):\n  def f(self, x: int = 3) -> str:\n    """Says."""\nasync def g(y: int): pass'), ("b", "def ("), ("c", None), ("d", "")], "path string, content string")
    got = sorted((r.path, r.kind, r.name, r.signature, r.source, r.doc_available) for r in symbols.symbols(df, "python").collect() if r.path == "a" or r.kind != "error")
    assert got == [("a", "async_function", "g", "async def g(y)", "a:4", False), ("a", "class", "A", "class A(B, C)", "a:1", False), ("a", "function", "f", "def f(self, x: int) -> str", "a:2", True)]
    assert sorted(r.path for r in symbols.symbols(df, "python").filter("kind = 'error'").collect()) == ["b", "c"]


def test_table_functions_from_sql(spark):
    analyzers.register(spark)
    spark.createDataFrame([(1, "pub fn go(a: A) -> B {\n}"), (2, None), (3, "")], "id long, content string").createOrReplaceTempView("sources")
    rows = spark.sql("SELECT id, s.* FROM sources, LATERAL symbols(content, 'rs') s ORDER BY id").collect()
    assert [(r.id, r.kind, r.name, r.signature) for r in rows] == [(1, "function", "go", "pub fn go(a: A) -> B"), (2, "error", "PARSE_ERROR", "no content")]
    with pytest.raises(Exception, match="must be a constant, one of"):
        spark.sql("SELECT * FROM sources, LATERAL symbols(content, 'cobol')").collect()
    assert [r.symbol for r in spark.sql("SELECT l.symbol FROM LATERAL loose_symbols('def run(x)\nclass Job\nreturn 1\ndef run(y)') l").collect()] == ["run", "Job"]


def test_symbol_rows_in_full(spark):
    """Signatures, namespaces, documentation and rules that look beyond a match."""
    texts = {
        "javascript": "export async function  load(a,\n b) { return 1 } // tail\n",
        "kotlin": "fun go( a: Int ) : List<\n String> {\n", "rust": "pub struct\n  Job {", "java": "@interface Note\nstatic final List<String> names = x;\nstatic final List<String> Names = x;\nprivate int A;",
        "php": "namespace A\\B;\n/** Says Alpha. */\nclass Alpha { function inner() {} }\nclass Beta {\n}\n  function outer() {}\nconst X = 1;\ndefine( 'größe', 2);\nenum Kind: int {}",
        "go": "/* Doc */\nfunc Run(x int) error {\nvar Größe = 1\n// x\n\ntype T struct {\nfunc run() {",
    }
    rows = {k: [(r.kind, r.name, r.signature, r.doc_available) for r in symbols.symbols(spark.createDataFrame([("d/f", v)], "path string, content string"), k).orderBy("rule", "ordinal").collect()] for k, v in texts.items()}
    assert rows["javascript"] == [("function", "load", "export async function  load(a,", False)]
    assert rows["kotlin"] == [("function", "go", "fun go(a: Int): List<\n String>", False)] and rows["rust"] == [("struct", "Job", "pub struct\n  Job;", False)]
    assert rows["java"] == [("interface", "Note", "@interface Note", False), ("field", "Names", "List<String> Names", False)]
    assert rows["php"] == [("class", "A\\B\\Alpha", "class Alpha", True), ("class", "A\\B\\Beta", "class Beta", True), ("function", "outer", "function outer(...)", False), ("constant", "größe", "define('größe', ...)", False), ("class_constant", "X", "const X =", False), ("enum", "A\\B\\Kind", "enum Kind", False)]
    assert rows["go"] == [("function", "Run", "func Run(x int) error {", True), ("variable", "Größe", "var Größe = 1", False), ("struct", "T", "type T struct {", False)]
    loose = symbols.loose_symbols(spark.createDataFrame([("f", "def alpha(x)\n  if y\nclass Beta\nreturn 1\nzeta(\n")], "path string, content string"))
    assert {r.symbol for r in loose.collect()} == {"alpha", "Beta", "zeta"}


def params_by_loops(src, dst, similarity):
    src, free = list(dict.fromkeys(src)), [d for d in dict.fromkeys(dst) if d not in src]
    out = [(s, s, "identity") for s in src if s in dst]
    missing = []
    for s in [s for s in src if s not in dst]:
        best = max(((similarity[s, d], -i, d) for i, d in enumerate(free) if similarity[s, d] > 0.6), default=None)
        if best:
            free.remove(best[2])
            out.append((s, best[2], "identity" if best[0] >= 1 else "rename"))
        else:
            missing.append((s, "#MISSING", "unwrap"))
    return out + missing


def test_param_matches_equal_loops(spark):
    names = ["path", "file_path", "filePath", "mode", "open_mode", "url", "URL", "time_out", "timeout", "x", "pathname"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").withColumn("s", S.name_similarity(F.col("a"), F.col("b")))
    similarity = {(r.a, r.b): r.s for r in pairs.collect()}
    rnd = random.Random(5)
    rows = [([rnd.choice(names) for _ in range(rnd.randint(0, 5))], [rnd.choice(names) for _ in range(rnd.randint(0, 5))]) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").coalesce(1).select(matching.match_params(F.col("a"), F.col("b")).alias("m")).collect()
    assert [[tuple(x) for x in r.m] for r in got] == [params_by_loops(a, b, similarity) for a, b in rows]


def test_fingerprint_query_reads_bytes_of_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.fingerprint for r in library.QUERIES["fingerprint"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        raw = None if r.text is None else r.text.encode()
        assert got[r.doc_id] == (None if raw is None or r.source is None else hashlib.sha256(raw[:4096] + str(len(raw)).encode() + r.source.encode()).hexdigest())


def test_positions_number_all_rows(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)] + [(None, 500)], "a long, b long").repartition(5)
    assert [(r.a, r.pos) for r in ranking.positions(df, [F.asc("a"), F.asc("b")]).orderBy("pos").collect()] == [(None, 1), *((i, i + 2) for i in range(101))]
    assert ranking.positions(df.limit(0), [F.asc("a")]).count() == 0


def test_comparison_report(spark):
    """Missing cells and unknown states count as missing; a project without cells says so; empty tables give no report."""
    cells = spark.createDataFrame([("p", "fast", 1, "b/x", 1, "supported"), ("p", "fast", 1, "a/y", 2, "odd"), ("p", "small", 0, "a/y", 2, "partial"), ("q", "one", 0, "c", 0, None)], "project string, requirement string, r_seq int, slug string, s_seq int, status string")
    repo = lambda project, rank, slug: (project, rank, slug, 0.5, 0.9, 3, "go", "short", 1, 2, 0, "none")
    repos = spark.createDataFrame([repo("p", 2, "a/y"), repo("p", 1, "b/x"), repo("r", 1, "d")], "project string, rank int, slug string, score double, confidence double, evidence_count int, language string, summary string, core_modules int, key_types int, platform_apis int, known_gaps string")
    got = {r.project: r.report for r in sinks.comparison_report(cells, repos, "project").collect()}
    assert set(got) == {"p", "q", "r"} and got["r"] == "# Comparison Matrix: r\n\n*No comparison data available.*\n"
    assert "| Requirement | **b/x** | **a/y** |\n|---|---|---|\n| small | ❌ | ⚠️ |\n| fast | ✅ | ❌ |\n\n## Ranking" in got["p"]
    assert "| 1 | b/x | 0.5 | 0.9 | 3 |\n| 2 | a/y | 0.5 | 0.9 | 3 |\n\n## Repo Details\n\n### b/x\n- **Language**: go\n- **Summary**: short\n" in got["p"]
    assert got["p"].endswith("- small: 0 supported, 1 partial\n- fast: 1 supported, 0 partial") and "| one | ❌ |" in got["q"]
    assert sinks.comparison_report(cells.limit(0), repos.limit(0), "project").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    sinks.write_json(rows, f"{tmp_path}/j", ["k"])
    assert sorted(tuple(r) for r in spark.read.json(f"{tmp_path}/j").select("k", "v").collect()) == [("a", 1), ("b", 2)]
    cache = spark.createDataFrame([("a", "x", 50.0, 10.0), ("b", "y", 500.0, 10.0), ("c", "z", 9e9, 0.0)], "key string, data string, expires double, created_at double")
    new = sinks.cache_set(cache, spark.createDataFrame([("b", "n"), ("b", "m"), ("d", "q")], "key string, data string"), 100.0, 60)
    assert sorted((r.key, r.data, r.expires) for r in new.collect()) == [("a", "x", 50.0), ("b", "n", 160.0), ("c", "z", 9e9), ("d", "q", 160.0)]
    assert sorted(r.key for r in sinks.cache_purge(new, 100.0, 95).collect()) == ["b", "d"]
    readers.write_kv(spark, new.withColumn("version", F.lit(1)), f"{tmp_path}/kv")
    readers.write_kv(spark, new.limit(1).withColumn("version", F.lit(2)), f"{tmp_path}/kv")
    assert readers.read_kv(spark, f"{tmp_path}/kv").count() == 1


def test_files_are_written_one_by_one(spark, tmp_path):
    folder = tmp_path / "docs"
    found = lambda: {str(f.relative_to(folder)): f.read_text() for f in folder.rglob("*") if f.is_file()}
    files = lambda *rows: spark.createDataFrame(list(rows), "name string, content string").repartition(3)
    sinks.write_skeleton(files(("index.md", "# A"), ("modules/b.md", None), ("modules/c d.md", "é"), ("modules/b.md", "z")), str(folder))
    assert found() == {"index.md": "# A", "modules/b.md": "", "modules/c d.md": "é"}
    sinks.write_skeleton(files(("index.md", "other"), ("new.md", "n")), f"file://{folder}")
    assert found() == {"index.md": "# A", "modules/b.md": "", "modules/c d.md": "é", "new.md": "n"}
    sinks.write_skeleton(files(("index.md", "other")), str(folder), force=True)
    sinks.write_skeleton(files(("index.md", "other")).limit(0), str(folder))
    before = found()
    assert before["index.md"] == "other" and not (folder / "_temporary").exists()
    for bad in ("../out.md", "/etc/x", "a//b", "", None, "_temporary/x"):
        with pytest.raises(Exception, match="no name of a file"):
            sinks.write_skeleton(files(*[(f"f{i}.md", "x") for i in range(20)], (bad, "x")), str(folder), force=True)
    assert found() == before and not (folder / "_temporary").exists()


def test_markdown_walk(spark, tmp_path):
    for name in ("docs/a.md", "docs/archive/b.md", "docs/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# Top\n[[modules/x]] and [[ http://y ]]")
    files = readers.source_files(spark, str(tmp_path), [".md"], ["archive"])
    assert [(r.target, r.pos) for r in extract.wiki_links(files).orderBy("pos").collect()] == [("modules/x", 0), ("http://y", 1)]
    assert [r.title for r in extract.headings(files).collect()] == ["Top"]


def test_dedup_layers_and_what_earlier_calls_kept(spark, tmp_path):
    rows = [(1, "h1", "d1", "alpha beta gamma", "ann"), (2, "h1", "d2", "other text here", "bob"), (3, "h3", "d1", "third thing said", "cat"), (4, "", "", "alpha beta gamm", "dan"), (5, None, None, "quite a different one", "eve"), (6, "h6", "d6", "quite a diffrnt 1", "eve")]
    df = spark.createDataFrame(rows, "k long, h string, d string, t string, a string")
    later = spark.createDataFrame([(7, "h7", "d1", "x y z", "x"), (8, "h8", "", "alpha beta gammas", "y"), (9, "h9", "", "new words only", "z")], df.schema)
    index = DedupIndex(spark, f"{tmp_path}/index", "k", "h", "t", "a", "d")
    index.reset()
    assert sorted(r.k for r in dedup.dedup_pipeline(df, "k", "h", "t", "a", "d").collect()) == [1, 5]
    for _ in range(2):  # a batch that is run again replaces its own part
        assert [sorted(r.k for r in index.add(x, n).collect()) for n, x in enumerate((df, later))] == [[1, 5], [9]]
    index.reset()
    assert sorted(r.k for r in index.add(later, 0).collect()) == [7, 8, 9] and index.add(later.limit(0), 1).count() == 0


def sequential_layers(batches):
    """Survivors of each batch by loops: every layer keeps all it has let through."""
    seen = {"h": set(), "d": set(), "t": [], "a": []}
    clean = lambda x: (x or "").strip().lower()
    same = lambda x, y, t: 1 - levenshtein(x, y) / max(len(x), len(y)) >= t - 1e-12
    out = []
    for rows in batches:
        for layer, at in (("h", 1), ("d", 2)):
            left = []
            for r in sorted(rows, key=lambda r: r[0]):
                if not (r[at] or "").strip() or r[at] not in seen[layer]:
                    seen[layer].add(r[at])
                    left.append(r)
            rows = left
        rows = [r for r in rows if not clean(r[3]) or not any(same(clean(r[3]), x, 0.85) for x in seen["t"]) and not seen["t"].append(clean(r[3]))]
        rows = [r for r in rows if not clean(r[3]) or not clean(r[4]) or not any(clean(r[4]) == b and same(clean(r[3]), x, 0.75) for x, b in seen["a"]) and not seen["a"].append((clean(r[3]), clean(r[4])))]
        out.append(sorted(r[0] for r in rows))
    return out


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_batches_equal_sequential_layers(spark, tmp_path):
    rnd = random.Random(9)

    def title():
        base = list(rnd.choice(["streaming joins at scale", "a survey of tables", "on the nature of caches", "x", "ab", "abc", "graphs", "numbers and their friends in the wild"]))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
            at = rnd.randrange(len(base) + 1)
            base[at : at + rnd.choice([0, 1])] = rnd.choice(["", "q", "z ", "é"])
        return rnd.choice([str.title, str.upper, str])("".join(base)) + rnd.choice(["", " "])

    rows = [(i, rnd.choice([f"h{rnd.randrange(60)}", "", None]), rnd.choice([f"d{rnd.randrange(60)}", " ", None]), rnd.choice([title(), title(), title(), None]), rnd.choice(["Ann", "ann ", "Bob", None, ""])) for i in range(160)]
    rnd.shuffle(rows)
    batches = [rows[:50], rows[50:51], rows[51:120], [], rows[120:]]
    index = DedupIndex(spark, f"{tmp_path}/index", "k", "h", "t", "a", "d")
    index.reset()
    schema = "k long, h string, d string, t string, a string, text string, g string, value string"
    got = [sorted(r.k for r in index.add(spark.createDataFrame([(*r, "x", "y", "z") for r in b], schema), n).collect()) for n, b in enumerate(batches)]
    assert got == sequential_layers(batches)


def test_strict_severity(spark):
    df = spark.createDataFrame([("a", "warning"), ("b", "error"), ("b", "warning"), ("c", "info")], "g string, severity string")
    code = lambda strict: {r.g: r.exit_code for r in integrity.severity(df, ["g"], strict).collect()}
    assert code(False) == {"a": 1, "b": 2, "c": 0} and code(True) == {"a": 2, "b": 2, "c": 0}


def test_transitions_follow_the_table(spark):
    rows = [(1, 1, "queued"), (1, 2, "in_progress"), (1, 3, "retrying"), (1, 4, "in_progress"), (1, 5, "succeeded"), (1, 6, "cancelled"), (2, 1, "succeeded"), (2, 2, "succeeded")]
    got = state.check_transitions(spark.createDataFrame(rows, "k long, n long, s string"), "k", ["n"], "s").orderBy("k", "n").collect()
    assert [r.legal for r in got] == [True, True, True, True, True, False, False, True]
    assert [r.attempts for r in got] == [0, 0, 1, 1, 1, 1, 0, 0]


def test_fallbacks_on_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, s string")
    assert dedup.fuzzy_dedup(empty, "s", "k").count() == 0
    assert ranking.filter_or_all(empty, F.col("k") == 1).count() == 0
    assert joins.contains_join(empty, empty.withColumnRenamed("s", "t"), "s", "t").count() == 0


def test_json_default_and_source_files(spark, tmp_path):
    df = spark.createDataFrame([('{"k": 1}',), ("{",), (None,)], "j string")
    assert [r.parsed.k for r in readers.json_or_default(df, "j", "k INT", F.struct(F.lit(-1).alias("k"))).collect()] == [1, -1, -1]
    (tmp_path / "dist").mkdir()
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "dist" / "b.py").write_text("y = 1")
    (tmp_path / "c.md").write_text("# c")
    got = readers.source_files(spark, str(tmp_path), [".py"], ["dist"])
    assert [r.content for r in got.collect()] == ["x = 1"]
    assert len(got.select(readers.fingerprint(F.col("content"), F.col("length"), F.col("mtime")).alias("f")).first().f) == 64


def test_capabilities_align(spark):
    table = capabilities.starter(spark)
    pairs = table.select(F.struct("*").alias("a")).crossJoin(table.select(F.struct("*").alias("b")))
    rows = capabilities.alignment(pairs, "a", "b").collect()
    assert table.count() == 15 and len(rows) == 225

    def shape(x, y):
        keys = x.keys() | y.keys()
        return 1.0 if not keys else 0.3 if not x or not y else sum(1 if x.get(k) == y.get(k) else 0.3 if k not in x or k not in y else 0 for k in keys) / len(keys)

    for r in rows:
        a, b = r.a, r.b
        io = len(set(a.io_patterns) & set(b.io_patterns)) / max(len(set(a.io_patterns) | set(b.io_patterns)), 1)
        fmt = len(set(a.formats_out) & set(b.formats_in)) / len(set(a.formats_out))
        err = len(set(a.errors) & set(b.errors)) / max(len(a.errors), len(b.errors), 1)
        run = 1.0 - 0.5 * (a.runtime["async"] and not b.runtime["async"]) - 0.2 * (a.runtime["threadsafe"] != b.runtime["threadsafe"])
        row = C.LICENSE_SCORES.get(a.license)
        lic = row[C.LICENSES.index(b.license)] if row and b.license in C.LICENSES else 0.3
        assert r.overall == pytest.approx(0.25 * io + 0.25 * fmt + 0.15 * err + 0.15 * shape(a.shape, b.shape) + 0.1 * run + 0.1 * lic)
        assert ("error" in r.misfits) == (err < 0.3 and bool(a.errors or b.errors)) and ("io" in r.misfits) == (io < 0.5) and ("license" in r.misfits) == (lic < 0.5)


def test_license_rules(spark):
    df = spark.createDataFrame([("MIT", "GPL-3.0"), ("GPL-3.0", "MIT"), ("", "MIT"), ("Odd", "MIT"), ("MIT", "")], "a string, b string")
    assert [r.m for r in df.select(matching.reuse_mode(F.col("a"), F.col("b")).alias("m")).collect()] == ["copy", "reference_only", "reference_only", "avoid", "reference_only"]


def test_name_similarity_of_empty_names(spark):
    df = spark.createDataFrame([("a", ""), ("a_b", "AB"), ("get", "get_all")], "a string, b string")
    assert [r.s for r in df.select(S.name_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [0.85, 1.0, 0.85]


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", 1, "queued"), ("a", 2, "retrying"), ("b", 1, "queued"), ("b", 1, "queued")]
    spark.createDataFrame(rows, "k string, seq long, s string").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("k string, seq long, s string").parquet(source)

    def finish(df, name):
        with stateful.with_state_store(spark):
            q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{out}/{name}").trigger(availableNow=True).start()
            q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(finish(streams.dedup_stream(stream(), ["k", "seq"]), "distinct_rows")) == 3
    got = finish(stateful.step_stream(streams.dedup_stream(stream(), ["k", "seq"]), "k", "s", strict=False), "moves")
    assert sorted((r.key, r.status, r.legal, r.attempts) for r in got) == [("a", "queued", True, 0), ("a", "retrying", False, 1), ("b", "queued", True, 0)]


def run_stream(spark, df, path, until=None):
    """One restart: what has come since the last one goes to a folder. A query over processing time runs on until it is
    stopped: ``until`` says how many rows to wait for."""
    count = lambda: spark.read.schema(df.schema).parquet(f"{path}/out").count() if os.path.isdir(f"{path}/out/_spark_metadata") else 0
    with stateful.with_state_store(spark):
        writer = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").outputMode("append")
        if until is None:
            writer.trigger(availableNow=True).start().awaitTermination(120)
        else:
            query, began = writer.trigger(processingTime="1 second").start(), time.time()
            while count() < until and time.time() < began + 60:
                time.sleep(0.5)
            query.stop()
    return spark.read.parquet(f"{path}/out").collect()


def test_steps_as_state_with_restarts(spark, tmp_path):
    schema = "k string, seq long, s string"
    initial = spark.createDataFrame([("old", "failed", 2)], "key string, status string, attempts long")
    batches = [[("a", 1, "queued"), ("a", 2, "succeeded"), ("a", 3, "in_progress"), ("old", 1, "retrying")], [("a", 4, "failed"), ("a", 5, "retrying"), ("a", 6, "failed"), ("b", 1, "pending"), ("b", 2, None), ("old", 2, "failed")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        got = run_stream(spark, stateful.step_stream(stream, "k", "s", initial=initial.groupBy("key")), tmp_path)
    rows = {(r.key, r.seq): (r.was, r.status, r.legal, r.attempts, r.entered, r.terminal, r.can_retry) for r in got}
    assert rows == {
        ("a", 1): ("pending", "queued", True, 0, 1, False, False), ("a", 2): ("queued", "queued", False, 0, 1, False, False), ("a", 3): ("queued", "in_progress", True, 0, 1, False, False),
        ("a", 4): ("in_progress", "failed", True, 0, 1, True, True), ("a", 5): ("failed", "retrying", True, 1, 1, False, False), ("a", 6): ("retrying", "failed", True, 1, 2, True, True),
        ("b", 1): ("pending", "pending", True, 0, 0, False, False), ("b", 2): ("pending", "pending", False, 0, 0, False, False),
        ("old", 1): ("failed", "retrying", True, 3, 1, False, False), ("old", 2): ("retrying", "failed", True, 3, 1, True, False),
    }


def test_gpx_orders_points_without_a_lambda(spark):
    """Points by sequence, nulls first, equal ones by their text; a comparison is never an expression of its own."""
    rows = [(1, (n % 7 if n % 5 else None, n % 3), n / 8, -n / 16, None if n % 4 == 0 else n / 2) for n in range(200)] + [(2, (1, 1), None, 0.5, 1.0), (2, (1, 0), float("nan"), None, None)]
    points = spark.createDataFrame(rows, "k long, s struct<a long, b long>, lat double, lon double, ele double").repartition(7)
    tracks = extract.gpx(points, "k", "s", "lat", "lon", "ele")
    number = lambda x, n: "null" if x is None else "NaN" if math.isnan(x) else f"{Decimal(x).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP):f}"
    want = collections.defaultdict(list)
    for k, s, lat, lon, ele in rows:
        text = f'<trkpt lat="{number(lat, 8)}" lon="{number(lon, 8)}">' + ("" if ele is None else f"<ele>{number(ele, 1)}</ele>") + "</trkpt>"
        want[k].append(([(x is not None, x or 0) for x in s], text))
    assert {r.k: r.gpx for r in tracks.collect()} == {k: '<gpx version="1.1"><trk><trkseg>' + "".join(t for _, t in sorted(v)) + "</trkseg></trk></gpx>" for k, v in want.items()}
    assert "lambda" not in tracks._jdf.queryExecution().optimizedPlan().toString()


class StateCalls:
    """A key's state by name, as a processor's handle gives it, with the number of calls that would be messages to Spark."""

    def __init__(self):
        self.values, self.maps, self.calls = {}, {}, 0

    def _variable(self, store, name):
        def call(f):
            def counted(*args):
                self.calls += 1
                return f(*args)

            return counted

        entries = lambda: store.setdefault(name, {})
        return SimpleNamespace(
            exists=call(lambda: name in store), get=call(lambda: store[name]), update=call(lambda value: store.update({name: value})),
            containsKey=call(lambda k: k in entries()), getValue=call(lambda k: entries()[k]), updateValue=call(lambda k, v: entries().update({k: v})), iterator=call(lambda: iter(list(entries().items()))),
        )

    def getValueState(self, name, schema, ttl_ms):
        return self._variable(self.values, name)

    def getMapState(self, name, keys, schema, ttl_ms):
        return self._variable(self.maps, name)


def test_steps_reach_for_state_by_key_not_by_row():
    """The messages to Spark that a key costs don't grow with its rows, and two batches end as one does."""
    asked = [*C.TRANSITIONS, None]
    rows = [Row(key="a", seq=n, asked=asked[n * n % 7 % len(asked)]) for n in range(500)]
    for strict in (True, False):
        ends = []
        for cut in (0, 200):
            handle, processor, got = StateCalls(), stateful.Steps(C.TRANSITIONS, "pending", 3, strict, None), []
            processor.init(handle)
            for batch in (rows[:cut], rows[cut:]):
                if batch:
                    handle.calls = 0
                    got += processor.handleInputRows(("a",), reversed(batch), None)
                    assert handle.calls <= 4 + 2 * len(asked)
            assert [r.seq for r in got] == list(range(500))
            assert {r.status: r.entered for r in got} == {k: v for (k,), (v,) in handle.maps["entered"].items()}
            ends.append((got, handle.values, handle.maps))
        assert ends[0] == ends[1]


def test_cache_as_state_goes_stale(spark, tmp_path):
    schema, total = "k string, seq long, f string", 0

    def step(*rows, ttl_ms=3_600_000, notices=0):
        nonlocal total
        total += len(rows) + notices
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        initial = spark.createDataFrame([("kept", "before")], "key string, data string").groupBy("key")
        got = run_stream(spark, stateful.cache_stream(stream, "k", "f", ttl_ms=ttl_ms, notices=True, initial=initial), tmp_path, total)
        return {(r.key, r.seq): (r.data, r.origin) for r in got}

    step(("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), ("kept", 1, None))
    got = step(("a", 3, None), ("b", 2, "z"), ("kept", 2, "new"), ("c", 1, "q"))
    assert got == {("a", 1): ("x", "fetched"), ("a", 2): ("x", "fresh"), ("a", 3): ("x", "fresh"), ("b", 1): (None, "error"), ("b", 2): ("z", "fetched"), ("kept", 1): ("before", "stale"), ("kept", 2): ("new", "fetched"), ("c", 1): ("q", "fetched")}
    # An answer that lives for a moment: its timer says so, and a later request gets it stale.
    got = step(("d", 1, "v"), ttl_ms=1500, notices=1)
    assert got["d", 1] == ("v", "fetched") and got["d", -1] == ("v", "expired")
    assert step(("d", 2, None), ("a", 4, None), ttl_ms=1500)["d", 2] == ("v", "stale")


def test_dedup_layers_across_batches(spark, tmp_path):
    """Batch by batch against what was kept, fuzzy layers too; after a reset all begins anew."""
    schema = "k long, h string, t string, a string"
    batches = [[(1, "h1", "alpha beta gamma", "ann"), (2, "h1", "more", "bob")], [(3, "h3", "alpha beta gamm", "x"), (4, "h4", "something else", "y"), (5, "h1", "z", "z")]]

    kept, index = f"{tmp_path}/kept", DedupIndex(spark, f"{tmp_path}/index", "k", "h", "t", "a")
    index.reset()
    for rows in batches:  # each a restart from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        streams.dedup_batches(stream, index, kept).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(240)
    assert sorted(r.k for r in spark.read.parquet(kept).collect()) == [1, 4]


def test_windows_watermarks_and_forgetting(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00", 1), ("a", "2024-01-01 00:10:00", 1), ("a", "2024-01-01 00:50:00", 2), ("b", "2024-01-01 05:00:00", 3)]
    spark.createDataFrame(rows, "k string, t string, seq long").selectExpr("k", "cast(t as timestamp) t", "seq", "'queued' s").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("k string, t timestamp, seq long, s string").parquet(f"{tmp_path}/in")

    def finish(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    counts = finish(streams.windowed_counts(stream(), "t", "k"), "window_counts", "complete")
    assert sorted((r.k, str(r.window.start)[11:], r.n) for r in counts) == [("a", "00:00:00", 3), ("b", "05:00:00", 1)]
    assert len(finish(streams.dedup_stream(stream(), ["k", "t"], "t"), "dedup_marked")) == 3
