"""Lookup values of the scoring and matching functions."""

# Names known under several ecosystems, as (name, canonical name, ecosystems).
ALIASES = [
    ("polars", "polars", ["python", "rust"]),
    ("tiktoken", "tiktoken", ["python", "rust"]),
    ("pyo3", "pyo3", ["python", "rust"]),
    ("tokenizers", "tokenizers", ["python", "rust"]),
    ("safetensors", "safetensors", ["python", "rust"]),
    ("nodejs-polars", "polars", ["python", "rust", "javascript"]),
    ("serde", "serde", ["rust"]),
    ("serde_json", "serde_json", ["rust"]),
    ("requests", "requests", ["python"]),
    ("httpx", "httpx", ["python"]),
    ("orjson", "orjson", ["python", "rust"]),
    ("typescript", "typescript", ["javascript"]),
    ("ts-node", "ts-node", ["javascript"]),
    ("ts_node", "ts-node", ["javascript"]),
    ("kotlin-stdlib", "kotlin-stdlib", ["java"]),
    ("kotlin_stdlib", "kotlin-stdlib", ["java"]),
    ("kotlinx-serialization", "kotlinx-serialization", ["java", "kotlin"]),
    ("kotlinx_serialization", "kotlinx-serialization", ["java", "kotlin"]),
    ("jackson", "jackson", ["java", "kotlin"]),
    ("gson", "gson", ["java", "kotlin"]),
]

# Bridge mode, bridge language, framework and tools by (source, target) language.
STRATEGIES = [
    ("python", "python", "import", "python", "", ""),
    ("python", "javascript", "subprocess_json", "python", "", "node"),
    ("python", "rust", "subprocess_json", "python", "", ""),
    ("python", "java", "subprocess_json", "python", "", "java"),
    ("python", "kotlin", "subprocess_json", "python", "", "kotlin"),
    ("python", "c_cpp", "ffi_cffi", "python", "cffi", "gcc"),
    ("javascript", "javascript", "import", "javascript", "", ""),
    ("javascript", "python", "subprocess_json", "javascript", "", ""),
    ("javascript", "rust", "subprocess_json", "javascript", "", ""),
    ("javascript", "java", "subprocess_json", "javascript", "", "java"),
    ("javascript", "kotlin", "subprocess_json", "javascript", "", "kotlin"),
    ("javascript", "c_cpp", "subprocess_json", "javascript", "", "gcc"),
    ("rust", "rust", "import", "rust", "", "cargo"),
    ("rust", "python", "pyo3", "python", "pyo3", "cargo"),
    ("rust", "javascript", "subprocess_json", "rust", "", "node"),
    ("rust", "java", "subprocess_json", "rust", "", "java"),
    ("rust", "kotlin", "subprocess_json", "rust", "", "kotlin"),
    ("rust", "c_cpp", "subprocess_json", "rust", "", "gcc"),
    ("java", "java", "import", "java", "", "java"),
    ("java", "kotlin", "import", "java", "", ""),
    ("java", "python", "subprocess_json", "java", "", ""),
    ("java", "javascript", "subprocess_json", "java", "", "node"),
    ("java", "rust", "subprocess_json", "java", "", "cargo"),
    ("java", "c_cpp", "subprocess_json", "java", "", "gcc"),
    ("kotlin", "kotlin", "import", "kotlin", "", ""),
    ("kotlin", "java", "import", "kotlin", "", ""),
    ("kotlin", "python", "subprocess_json", "kotlin", "", ""),
    ("kotlin", "javascript", "subprocess_json", "kotlin", "", "node"),
    ("kotlin", "rust", "subprocess_json", "kotlin", "", "cargo"),
    ("kotlin", "c_cpp", "subprocess_json", "kotlin", "", "gcc"),
    ("c_cpp", "c_cpp", "import", "c_cpp", "", "gcc"),
    ("c_cpp", "python", "ffi_cffi", "python", "cffi", "gcc"),
    ("c_cpp", "javascript", "subprocess_json", "c_cpp", "", "emcc"),
    ("c_cpp", "rust", "subprocess_json", "c_cpp", "", "cargo"),
    ("c_cpp", "java", "subprocess_json", "c_cpp", "", "java"),
    ("c_cpp", "kotlin", "subprocess_json", "c_cpp", "", "kotlin"),
]

# Keywords of function roles, in the order in which ties are decided.
ROLE_KEYWORDS = {
    "serialize": ["dumps", "dump", "encode", "serialize", "to_json", "to_string", "to_bytes", "marshal", "pack", "write_json", "jsonify"],
    "deserialize": ["loads", "load", "decode", "deserialize", "from_json", "from_string", "parse", "unmarshal", "unpack", "read_json"],
    "fetch": ["get", "request", "fetch", "download", "read", "query", "select", "find", "search", "list", "all", "get_by", "find_by", "first"],
    "send": ["post", "put", "patch", "delete", "send", "upload", "write", "update", "create", "insert", "save", "store", "submit"],
    "transform": ["map", "filter", "reduce", "transform", "convert", "apply", "flat_map", "flatten", "sort", "group", "aggregate"],
    "open": ["open", "connect", "init", "create", "new", "builder", "build", "from_path", "from_file", "from_reader"],
    "close": ["close", "disconnect", "shutdown", "stop", "release", "free"],
}

# License categories.
LICENSE_CATEGORIES = {
    "permissive": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense", "ISC", "MIT-0", "BSL-1.0"],
    "weak_copyleft": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0"],
    "strong_copyleft": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
}

# What reuse a source category allows in a target category.
REUSE_RULES = [
    ("permissive", "permissive", "copy"),
    ("permissive", "weak_copyleft", "copy"),
    ("permissive", "strong_copyleft", "copy"),
    ("permissive", "proprietary", "copy"),
    ("weak_copyleft", "permissive", "port"),
    ("weak_copyleft", "weak_copyleft", "port"),
    ("weak_copyleft", "strong_copyleft", "copy"),
    ("weak_copyleft", "proprietary", "reference_only"),
    ("strong_copyleft", "strong_copyleft", "copy"),
    ("strong_copyleft", "permissive", "reference_only"),
    ("strong_copyleft", "weak_copyleft", "reference_only"),
    ("strong_copyleft", "proprietary", "avoid"),
    ("proprietary", "permissive", "avoid"),
    ("proprietary", "weak_copyleft", "avoid"),
    ("proprietary", "strong_copyleft", "avoid"),
    ("proprietary", "proprietary", "avoid"),
    ("unknown", "permissive", "reference_only"),
    ("unknown", "weak_copyleft", "reference_only"),
    ("unknown", "strong_copyleft", "reference_only"),
    ("unknown", "proprietary", "avoid"),
    ("unknown", "unknown", "reference_only"),
]

# Scope tiers by category and by keyword, in order.
P0_CATEGORIES = ["import", "export", "core", "pipeline", "search", "view"]
P1_CATEGORIES = ["annotation", "filter", "batch", "analysis", "custom"]
P0_KEYWORDS = ["import", "parse", "convert", "load", "read", "open", "view", "export", "save", "write", "search", "query", "browse", "core", "pipeline", "flow", "auth", "login", "input"]
P1_KEYWORDS = ["filter", "sort", "tag", "label", "categorize", "preview", "highlight", "annotate", "note", "batch", "bulk", "sync", "schedule", "share", "embed", "link", "reference", "template", "macro", "plugin", "extension"]

# Allowed moves of a step's state.
TRANSITIONS = {
    "pending": ["queued", "skipped", "cancelled"],
    "queued": ["in_progress", "cancelled"],
    "in_progress": ["succeeded", "failed", "failed_partial", "retrying", "cancelled"],
    "retrying": ["in_progress", "failed", "cancelled"],
    "succeeded": ["needs_review"],
    "failed": ["retrying"],
    "failed_partial": ["retrying", "needs_review"],
    "cancelled": [],
    "needs_review": ["succeeded", "failed"],
    "skipped": [],
}

# Names under which languages are asked for.
LANGUAGE_ALIASES = {
    "python": "python", "py": "python", "pypi": "python",
    "javascript": "javascript", "js": "javascript", "node": "javascript", "npm": "javascript",
    "rust": "rust", "rs": "rust", "crates": "rust",
    "java": "java", "kotlin": "kotlin", "kt": "kotlin",
    "c": "c_cpp", "cpp": "c_cpp", "c_cpp": "c_cpp", "vcpkg": "c_cpp",
    "php": "php", "composer": "php", "packagist": "php",
    "go": "go", "golang": "go", "golang.org": "go", "pkg.go.dev": "go",
}

# How well a source's license (the row) goes with a target's (the column); the empty name is a missing license.
LICENSES = ["MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "CC0-1.0", "Unlicense", ""]
LICENSE_SCORES = {
    "MIT": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    "Apache-2.0": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    "GPL-3.0": [0.5, 0.5, 1.0, 1.0, 1.0, 0.5, 0.5, 1.0, 1.0, 0.5],
    "GPL-2.0": [0.5, 0.5, 1.0, 1.0, 1.0, 0.5, 0.5, 1.0, 1.0, 0.5],
    "LGPL-3.0": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    "BSD-3-Clause": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    "BSD-2-Clause": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    "CC0-1.0": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    "Unlicense": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    "": [0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 1.0],
}

# Names of airports in lower case and their codes.
AIRPORTS = {
    "深圳": "SZX", "sz": "SZX", "shenzhen": "SZX",
    "上海": "SHA", "上海虹桥": "SHA", "虹桥": "SHA", "shanghai": "SHA", "shanghai hongqiao": "SHA", "上海浦东": "PVG", "浦东": "PVG", "pudong": "PVG", "pvg": "PVG",
    "北京": "PEK", "北京首都": "PEK", "首都": "PEK", "beijing": "PEK", "北京大兴": "PKX", "大兴": "PKX", "daxing": "PKX",
    "广州": "CAN", "guangzhou": "CAN", "gz": "CAN",
    "成都": "CTU", "成都双流": "CTU", "成都天府": "TFU", "天府": "TFU", "chengdu": "CTU",
    "杭州": "HGH", "hangzhou": "HGH", "武汉": "WUH", "wuhan": "WUH", "重庆": "CKG", "chongqing": "CKG", "南京": "NKG", "nanjing": "NKG", "厦门": "XMN", "xiamen": "XMN",
    "三亚": "SYX", "sanya": "SYX", "昆明": "KMG", "kunming": "KMG", "西安": "XIY", "xian": "XIY", "香港": "HKG", "hongkong": "HKG", "hong kong": "HKG",
}

# Codes of airlines and their names.
AIRLINES = {
    "ZH": "深圳航空", "CA": "中国国航", "MU": "东方航空", "CZ": "南方航空", "HU": "海南航空", "3U": "四川航空", "MF": "厦门航空", "SC": "山东航空", "FM": "上海航空", "GS": "天津航空",
    "8L": "祥鹏航空", "KY": "昆明航空", "JD": "首都航空", "GJ": "长龙航空", "BK": "奥凯航空", "EU": "成都航空", "NS": "河北航空", "QW": "青岛航空", "9C": "春秋航空", "AQ": "九元航空",
    "DZ": "东海航空", "JR": "幸福航空", "Y8": "金鹏航空", "GT": "桂林航空", "HO": "吉祥航空", "TV": "西藏航空", "UQ": "乌鲁木齐航空", "PN": "西部航空", "LT": "龙江航空",
    "CX": "国泰航空", "KA": "国泰港龙", "SQ": "新加坡航空", "NH": "全日空", "JL": "日本航空", "KE": "大韩航空", "OZ": "韩亚航空", "EK": "阿联酋航空", "EY": "阿提哈德航空",
    "QR": "卡塔尔航空", "TK": "土耳其航空", "AF": "法国航空", "LH": "汉莎航空", "BA": "英国航空", "AA": "美国航空", "DL": "达美航空", "UA": "美联航", "AC": "加拿大航空", "QF": "澳洲航空",
}

# Fixed values: (ecosystem, confidence, marker files, the file named if present, the file named otherwise).
ECOSYSTEM_MARKERS = [
    ("python", 0.9, ["pyproject.toml", "requirements.txt", "setup.py"], "pyproject.toml", "requirements.txt"),
    ("javascript", 0.95, ["package.json"], "package.json", "package.json"),
    ("rust", 0.95, ["Cargo.toml"], "Cargo.toml", "Cargo.toml"),
    ("java/kotlin", 0.9, ["pom.xml", "build.gradle", "build.gradle.kts"], "pom.xml", "build.gradle"),
    ("c_cpp", 0.7, ["CMakeLists.txt", "Makefile", "vcpkg.json"], "CMakeLists.txt", "Makefile"),
]

# Words that are no symbols.
RESERVED_WORDS = ["if", "for", "while", "return", "import"]

# Folders that section ids may begin with.
SECTION_PREFIXES = ["lat.md/", "docs/modules/", "docs/project/", "docs/"]

# Languages by file extension.
EXTENSIONS = {".py": "python", ".js": "javascript", ".ts": "javascript", ".tsx": "javascript", ".jsx": "javascript", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".c": "c_cpp", ".cpp": "c_cpp", ".h": "c_cpp", ".hpp": "c_cpp"}
