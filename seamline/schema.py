"""Fixed schemas and the twelve-row dimension of construct kinds ("vectors")."""

from __future__ import annotations

from pyspark.sql import types as T

# Vector, display code, command-line label, report label, report order, group.
VECTORS = [
    ("generate", "P1", "Static Code Generation", "Static Code Generation", 1, "pre-build"),
    ("test", "P2", "Testing Functions", "Testing Functions", 2, "pre-build"),
    ("global", "I1", "Global Variable Initialization", "Global Variable Initialization", 3, "init"),
    ("init", "I2", "init() Functions", "Initialization Hooks", 4, "init"),
    ("constructor", "E1", "Constructor Methods", "Constructor Methods", 5, "runtime"),
    ("reflect", "E2", "Reflection", "Reflection", 6, "runtime"),
    ("interface", "E3", "Interfaces", "Interfaces", 7, "runtime"),
    ("unsafe", "E4", "Unsafe Pointers", "Unsafe Pointers", 8, "runtime"),
    ("cgo", "E5", "CGO Functions", "CGO Functions", 9, "runtime"),
    ("assembly", "E6", "Assembly Functions", "Assembly Functions", 10, "runtime"),
    ("plugin", "E7", "Dynamic Plugins", "Dynamic Plugins", 11, "runtime"),
    ("exec", "E8", "External Execution", "External Execution", 12, "runtime"),
]
VECTOR_NAMES = [row[0] for row in VECTORS]

# Order in which the twelve lists are concatenated.
UNION_ORDER = [
    "init", "global", "exec", "plugin", "generate", "test",
    "unsafe", "cgo", "interface", "reflect", "constructor", "assembly",
]

# The occurrence columns that tell two occurrences of a vector apart, in key order.
DISTINCT_KEYS = {
    "init": ["file_path", "line_number"],
    "global": ["variable_name", "file_path", "line_number"],
    "exec": ["method_invoked", "file_path", "line_number"],
    "plugin": ["file_path", "method_invoked", "line_number"],
    "generate": ["command", "file_path", "line_number"],
    "test": ["command", "file_path", "method_invoked", "line_number"],
    "unsafe": ["method_invoked", "file_path", "line_number"],
    "cgo": ["method_invoked", "file_path", "line_number"],
    "interface": ["method_invoked", "type_passed", "file_path", "line_number"],
    "reflect": ["method_invoked", "file_path", "line_number"],
    "constructor": ["file_path", "pattern", "line_number"],
    "assembly": ["method_invoked", "file_path", "line_number"],
}

# Process-starting functions, as (package, function).
EXEC_RULES = [
    ("syscall", "Exec"),
    ("syscall", "ForkExec"),
    ("syscall", "StartProcess"),
    ("exec", "Command"),
    ("exec", "CommandContext"),
    ("os", "StartProcess"),
]

# Assembly file extensions (case-sensitive), and how many modules a catalogue run takes.
ASM_EXTENSIONS = [".s", ".S", ".sx"]
CATALOG_RUN_SIZE = 600

FILES_SCHEMA = T.StructType([
    T.StructField("module", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("dir", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("content", T.StringType()),
])

OCCURRENCE_COLUMNS = [
    "module", "version", "package_name", "vector", "file_path", "line_number",
    "variable_name", "command", "method_invoked", "type_passed", "pattern",
]

# The catalogue row, three whole numbers and eight texts.
CATALOG_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in
     ("contributions_count", "dependent_repos_count", "dependents_count")]
    + [T.StructField(c, T.StringType()) for c in
       ("description", "language", "latest_release_number", "latest_stable_release_number",
        "name", "package_manager_url", "platform", "repository_url")]
)
