"""The starter registry of library capabilities and how well two of them go together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packages import license_score
from .scalars import containment, jaccard, map_similarity

SCHEMA = "language string, library string, version string, io_patterns array<string>, formats_in array<string>, formats_out array<string>, shape map<string,string>, runtime map<string,boolean>, errors array<string>, license string"
SYNC, ASYNC, UNSAFE, ASYNC_ONLY = ({"async": a, "sync": s, "threadsafe": t} for a, s, t in ((False, True, True), (True, True, True), (False, True, False), (True, False, True)))
# The registry's rows, as in SCHEMA.
STARTER = [
    ("python", "requests", "2.32.0", ["fetch", "send"], ["url", "params", "headers"], ["http_response", "bytes", "text"], {"timeout_support": "true", "streaming": "true"}, SYNC, ["ConnectionError", "Timeout", "HTTPError"], "Apache-2.0"),
    ("python", "httpx", "0.27.0", ["fetch", "send"], ["url", "params", "headers"], ["http_response", "bytes", "text", "json"], {"timeout_support": "true", "streaming": "true"}, ASYNC, ["RequestError", "TimeoutException", "HTTPStatusError"], "BSD-3-Clause"),
    ("python", "orjson", "3.10.15", ["serialize", "deserialize"], ["python_object"], ["json_bytes"], {"nan_support": "none", "infinity_support": "none", "none_handling": "null", "max_depth": "512"}, SYNC, ["JSONEncodeError", "JSONDecodeError"], "Apache-2.0"),
    ("python", "json", "stdlib", ["serialize", "deserialize"], ["python_object"], ["json_str"], {"nan_support": "converts_to_null", "infinity_support": "converts_to_null", "none_handling": "null", "max_depth": "default_recursive"}, SYNC, ["ValueError"], "PSF"),
    ("rust", "serde", "1.0.0", ["serialize", "deserialize"], ["rust_struct"], ["serialized_bytes"], {"derive_macro": "true", "custom_deserialize": "true"}, SYNC, ["Error"], "Apache-2.0"),
    ("rust", "serde_json", "1.0.0", ["serialize", "deserialize"], ["rust_struct", "json_bytes"], ["json_bytes", "json_str"], {"nan_support": "none", "infinity_support": "none"}, SYNC, ["Error"], "Apache-2.0"),
    ("rust", "reqwest", "0.12.0", ["fetch", "send"], ["url", "headers"], ["http_response", "bytes", "text"], {}, ASYNC, ["Error"], "Apache-2.0"),
    ("javascript", "axios", "1.7.0", ["fetch", "send"], ["url", "params", "headers"], ["http_response", "json", "text"], {}, ASYNC_ONLY, ["AxiosError"], "MIT"),
    ("javascript", "lodash", "4.17.21", ["transform", "query"], ["array", "object", "collection"], ["array", "object", "value"], {}, SYNC, [], "MIT"),
    ("java", "jackson", "2.17.0", ["serialize", "deserialize"], ["java_object", "json_bytes", "json_str"], ["json_bytes", "json_str", "java_object"], {"annotations": "true", "custom_serializer": "true"}, SYNC, ["JsonProcessingException"], "Apache-2.0"),
    ("java", "gson", "2.11.0", ["serialize", "deserialize"], ["java_object", "json_str"], ["json_str", "java_object"], {}, SYNC, ["JsonSyntaxException", "JsonIOException"], "Apache-2.0"),
    ("kotlin", "kotlinx-serialization", "1.7.0", ["serialize", "deserialize"], ["kotlin_object", "json_str"], ["json_str", "kotlin_object"], {"compile_time_plugin": "true", "annotation_driven": "true"}, SYNC, ["SerializationException"], "Apache-2.0"),
    ("c_cpp", "nlohmann-json", "3.11.0", ["serialize", "deserialize"], ["cpp_object", "json_str"], ["json_str", "cpp_object"], {"header_only": "true", "cxx11_required": "true"}, UNSAFE, ["parse_error", "type_error"], ""),
    ("python", "pandas", "2.2.0", ["read", "write", "transform", "aggregate"], ["csv", "json", "parquet", "excel", "sql", "dataframe"], ["csv", "json", "parquet", "excel", "sql", "dataframe"], {}, UNSAFE, ["ValueError"], ""),
    ("python", "polars", "1.0.0", ["read", "write", "transform", "aggregate"], ["csv", "json", "parquet", "dataframe"], ["csv", "json", "parquet", "dataframe"], {}, SYNC, ["ComputeError", "SchemaError"], ""),
]
# What each part of an alignment counts, and from where on it is compatible.
WEIGHTS = {"io": 0.25, "format": 0.25, "error": 0.15, "shape": 0.15, "runtime": 0.10, "license": 0.10}
LEAST = {"io": 0.5, "format": 0.3, "error": 0.3, "shape": 0.5, "runtime": 0.5, "license": 0.5}


def starter(spark: SparkSession) -> DataFrame:
    """The registry as a table, to which others' rows can be united (``readers.upsert`` by language and library)."""
    return spark.createDataFrame(STARTER, SCHEMA)


def error_overlap(a: Column, b: Column) -> Column:
    """Shared names over the longer list's."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), F.lit(1))


def runtime_fit(a: Column, b: Column) -> Column:
    """1, less a half where the source alone is asynchronous and a fifth where only one is safe for threads; empty maps: 1 for both, else 0.5."""
    says = lambda m, k, default: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(default))
    wait = F.when(says(a, "async", False) & ~says(b, "async", False), 0.5).otherwise(0.0)
    safe = F.when(says(a, "threadsafe", True) != says(b, "threadsafe", True), 0.2).otherwise(0.0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.5).otherwise(1.0 - wait - safe)


def alignment(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """The pairs (two struct columns of registry rows) with the score of each part, ``overall`` and the parts that don't fit, in order."""
    s, d = (lambda c: F.col(f"{src}.{c}")), (lambda c: F.col(f"{dst}.{c}"))
    scores = {
        "io": jaccard(s("io_patterns"), d("io_patterns")), "format": containment(s("formats_out"), d("formats_in")), "error": error_overlap(s("errors"), d("errors")),
        "shape": map_similarity(s("shape"), d("shape")), "runtime": runtime_fit(s("runtime"), d("runtime")), "license": license_score(s("license"), d("license")),
    }
    out = pairs.withColumns(scores)
    overall = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    silent = (F.size(s("errors")) == 0) & (F.size(d("errors")) == 0)
    bad = [F.when((F.col(k) < least) & ~(silent if k == "error" else F.lit(False)), F.lit(k)) for k, least in LEAST.items()]
    return out.withColumns({"overall": overall, "misfits": F.array_compact(F.array(*bad))})
