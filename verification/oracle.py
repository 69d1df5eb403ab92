"""Expected results as DuckDB SQL: arithmetic on ``doc_id`` over the whole ``documents`` table.

The planted corpus fixes the line of every construct, so no second analyser is needed.
"""

from __future__ import annotations

# Fixed values, stated here on their own: what tells two occurrences apart, and the report's lines.
_KEYS = {
    "init": "file_path line_number", "global": "variable_name file_path line_number",
    "exec": "method_invoked file_path line_number", "plugin": "file_path method_invoked line_number",
    "generate": "command file_path line_number", "test": "command file_path method_invoked line_number",
    "unsafe": "method_invoked file_path line_number", "cgo": "method_invoked file_path line_number",
    "interface": "method_invoked type_passed file_path line_number", "reflect": "method_invoked file_path line_number",
    "constructor": "file_path pattern line_number", "assembly": "method_invoked file_path line_number",
}
_VECTORS = [
    ("generate", "P1", "Static Code Generation", "Static Code Generation"), ("test", "P2", "Testing Functions", "Testing Functions"),
    ("global", "I1", "Global Variable Initialization", "Global Variable Initialization"),
    ("init", "I2", "init() Functions", "Initialization Hooks"), ("constructor", "E1", "Constructor Methods", "Constructor Methods"),
    ("reflect", "E2", "Reflection", "Reflection"), ("interface", "E3", "Interfaces", "Interfaces"),
    ("unsafe", "E4", "Unsafe Pointers", "Unsafe Pointers"), ("cgo", "E5", "CGO Functions", "CGO Functions"),
    ("assembly", "E6", "Assembly Functions", "Assembly Functions"), ("plugin", "E7", "Dynamic Plugins", "Dynamic Plugins"),
    ("exec", "E8", "External Execution", "External Execution"),
]
_NAMES = [v[0] for v in _VECTORS]

_FILE = """
  SELECT doc_id AS id, doc_id % 3 AS vn, lang, source AS module, 'v' || (doc_id % 3) AS version,
         source || '@v' || (doc_id % 3) || '/' || lang AS dir, text,
         'f' || doc_id || CASE WHEN doc_id % 5 = 1 THEN '_test.go' ELSE '.go' END AS name
  FROM documents"""
_FILES = f"""
  SELECT *, dir || '/' || name AS path, 'p_' || lang AS pkg FROM ({_FILE})"""

# Per vector: condition, line, and the fields that are not blank.
_PLANTED = [
    ("generate", "id % 13 = 0", 9, {"command": "'go run gen' || id || '.go'"}),
    ("test", "id % 5 = 1", 21, {"method_invoked": "'TestX' || id", "file_path": "path || '/' || pkg"}),
    ("global", "id % 3 = 0", 6, {"variable_name": "'g' || id", "method_invoked": "'build()'"}),
    ("global", "id % 3 = 1", 6, {"variable_name": "'g' || id", "method_invoked": "'Done()'"}),
    ("global", "id % 11 = 0", 7, {"variable_name": "'h' || id", "method_invoked": "'anonym func'",
                                  "package_name": "''"}),
    ("init", "id % 2 = 0", 8, {}),
    ("constructor", "id % 7 = 0", 18, {"method_invoked": "'NewThing'", "pattern": "'factory function'"}),
    ("constructor", "id % 7 = 0", 18, {"method_invoked": "'NewOther'", "pattern": "'factory function'"}),
    ("constructor", "id % 7 = 1", 18, {"method_invoked": "'New'", "pattern": "'New() function'"}),
    ("reflect", "id % 5 = 0", 4, {}),
    ("interface", "id % 6 = 0", 14, {"method_invoked": "'Run'", "type_passed": "'t'"}),
    ("unsafe", "id % 8 = 0", 16, {"method_invoked": "'unsafe.Pointer'"}),
    ("unsafe", "id % 8 = 0", 16, {"method_invoked": "'unsafe.Pointer'"}),
    ("cgo", "id % 9 = 0", 17, {"method_invoked": "'C.call'"}),
    ("assembly", "id % 12 = 0 AND lang IN ('en', 'de')", 19, {"method_invoked": "'asmFn'"}),
    ("plugin", "id % 10 = 0", 15, {"method_invoked": "'Open'"}),
    ("exec", "id % 4 = 0", 13, {"method_invoked": "'exec.Command'"}),
]


def _rows(planted: list[tuple]) -> str:
    selects = []
    for vector, condition, line, fields in planted:
        value = lambda c, default="''": fields.get(c, default)
        selects.append(f"""
  SELECT module, version, {value('package_name', 'pkg')} AS package_name, '{vector}' AS vector,
         {value('file_path', 'path')} AS file_path, CAST({line} AS INTEGER) AS line_number,
         {value('variable_name')} AS variable_name, {value('command')} AS command,
         {value('method_invoked')} AS method_invoked, {value('type_passed')} AS type_passed,
         {value('pattern')} AS pattern
  FROM f WHERE {condition}""")
    return f"WITH f AS ({_FILES}), occ AS ({' UNION ALL '.join(selects)})"


_OCC = _rows(_PLANTED)


def _key_sql() -> str:
    cases = []
    for vector, columns in _KEYS.items():
        key = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in columns.split())
        cases.append(f"WHEN '{vector}' THEN {key}")
    return f"CASE vector {' '.join(cases)} END"


_COUNTS = f"""{_OCC}, counts AS (
  SELECT module, version, vector, COUNT(DISTINCT {_key_sql()}) AS n FROM occ GROUP BY ALL)"""

_LOC = """
  SELECT module, version,
         CAST(SUM(19 + CASE WHEN id % 5 = 0 THEN 0 ELSE -1 END + 1
                  + CASE WHEN id % 6 = 0 THEN 0 ELSE -1 END) AS BIGINT) AS loc
  FROM f GROUP BY module, version"""
_MODULES = """
  SELECT m.module, m.version, CAST(p.p_partkey AS BIGINT) AS dependants
  FROM (SELECT DISTINCT module, version FROM f) m JOIN part p ON m.module = 'src' || p.p_partkey"""

_VECTOR_VALUES = ", ".join(
    f"('{v}', '{code}', '{label}', '{report}', {i + 1})" for i, (v, code, label, report) in enumerate(_VECTORS))
_DIM = f"dim(vector, code, label, report_label, ord) AS (VALUES {_VECTOR_VALUES})"

_OVERVIEW = f"""{_COUNTS}, loc AS ({_LOC}), modules AS ({_MODULES}), overview AS (
  SELECT m.module, m.version, m.dependants, l.loc, {', '.join(
      f"CAST(COALESCE(SUM(CASE WHEN c.vector = '{v}' THEN c.n END), 0) AS BIGINT) AS n_{v}"
      for v in _NAMES)}
  FROM modules m JOIN loc l USING (module, version) LEFT JOIN counts c USING (module, version)
  GROUP BY m.module, m.version, m.dependants, l.loc)"""

_LINE = """file_path || ':' || line_number
  || CASE WHEN variable_name <> '' THEN ' - Variable Name: ' || variable_name ELSE '' END
  || CASE WHEN command <> '' THEN ' - Command: ' || command ELSE '' END
  || CASE WHEN method_invoked <> '' THEN ' - Method Invoked: ' || method_invoked ELSE '' END
  || CASE WHEN type_passed <> '' THEN ' - Type Passed: ' || type_passed ELSE '' END
  || CASE WHEN pattern <> '' THEN ' - Pattern: ' || pattern ELSE '' END"""


def _json_field(key: str, column: str) -> str:
    return f"""CASE WHEN {column} <> '' THEN '"{key}":"' || {column} || '"' END"""


_JSON = "'{' || concat_ws(',', " + ", ".join([
    _json_field("PackageName", "package_name"), _json_field("Type", "vector"),
    _json_field("FilePath", "file_path"), """'"LineNumber":' || line_number""",
    _json_field("MethodInvoked", "method_invoked"), _json_field("TypePassed", "type_passed"),
    _json_field("VariableName", "variable_name"), _json_field("Command", "command"),
    _json_field("Pattern", "pattern")]) + ") || '}'"

# The planted file, line by line; a literal line stands as it is, a pair is (condition, then, else).
_TEXT = r"""
  'package p_' || lang || chr(10) || 'import (' || chr(10) || '"os/exec"' || chr(10)
  || CASE WHEN id % 5 = 0 THEN '"reflect"' ELSE '// "reflect"' END || chr(10) || ')' || chr(10)
  || 'var g' || id || CASE id % 3 WHEN 0 THEN ' = build()' WHEN 1 THEN ' = pkg.Build().Done()'
     ELSE ' = build() + 1' END || chr(10)
  || 'var h' || id || ' = func() int { return 1 }' || CASE WHEN id % 11 = 0 THEN '()' ELSE '' END || chr(10)
  || CASE WHEN id % 2 = 0 THEN 'func init() {}' ELSE 'func initX() {}' END || chr(10)
  || CASE WHEN id % 13 = 0 THEN '//go:generate go run gen' || id || '.go' ELSE '// go:generate none' END
  || chr(10) || 'type T struct{}' || chr(10) || 'func (t T) Run() {}' || chr(10)
  || 'func helper(t T) {' || chr(10)
  || chr(9) || CASE WHEN id % 4 = 0 THEN 'exec.Command("a", "exec.Command(")'
     ELSE '_ = "exec.Command(x)" // exec.Command(' END || chr(10)
  || chr(9) || CASE WHEN id % 6 = 0 THEN 't.Run()' ELSE '// t.Run()' END || chr(10)
  || chr(9) || CASE WHEN id % 10 = 0 THEN 'plugin.Open("p.so")' ELSE 'x.plugin.Open("p.so")' END || chr(10)
  || chr(9) || CASE WHEN id % 8 = 0 THEN '_ = unsafe.Pointer(uintptr(unsafe.Pointer(&t)))'
     ELSE '_ = unsafe.Sizeof(t)' END || chr(10)
  || chr(9) || CASE WHEN id % 9 = 0 THEN 'C.call(1)' ELSE '(*C.char)(nil)' END || chr(10)
  || chr(9) || CASE id % 7 WHEN 0 THEN 'lib.NewThing().NewOther()' WHEN 1 THEN 'New()'
     ELSE 'NewLocal()' END || chr(10)
  || chr(9) || CASE WHEN id % 12 = 0 THEN 'asmFn(1)' ELSE 'other(1)' END || chr(10)
  || '}' || chr(10) || 'func TestX' || id || '() {}' || chr(10)
  || '/*' || replace(text, '*/', ' ') || '*/'"""
_ASM_TEXT = """'// planted' || chr(10) || 'TEXT ·asmFn(SB), $0' || chr(10) || chr(9) || 'RET' || chr(10)
  || 'TEXT ·second(SB), $0' || chr(10) || chr(9) || 'RET' || chr(10)"""

# Tokens per file: the lines that never change, then each line that does.
_TOKENS = """2 + 2 + 1 + 1 + 6 + 5 + 10 + 7 + 4 + 1 + 6
  + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END
  + CASE id % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 ELSE 8 END
  + CASE WHEN id % 11 = 0 THEN 13 ELSE 11 END
  + CASE WHEN id % 4 = 0 THEN 8 ELSE 3 END
  + CASE WHEN id % 6 = 0 THEN 5 ELSE 0 END
  + CASE WHEN id % 10 = 0 THEN 6 ELSE 8 END
  + CASE WHEN id % 8 = 0 THEN 17 ELSE 8 END
  + CASE WHEN id % 9 = 0 THEN 6 ELSE 9 END
  + CASE id % 7 WHEN 0 THEN 9 ELSE 3 END"""

# Files that follow from the text: lines behind the raw string move with its line breaks.
_TEXT_CORPUS = f"""WITH f AS (
  SELECT *, 'w' || id || '.go' AS file, replace(coalesce(text, ''), '`', '') AS raw FROM ({_FILE})),
w AS (
  SELECT module, version, 'w_' || lang AS pkg, dir || '/' || file AS path, length(raw) AS chars,
         CAST(length(raw) - length(replace(raw, chr(10), '')) AS INTEGER) AS k,
         lower(regexp_extract(raw, '[A-Za-z]+')) || 's' AS word FROM f),
found AS (
  SELECT *, 'global' AS vector, 3 + k AS line, 'found' AS variable, 'From()' AS method, '' AS pattern FROM w
  UNION ALL SELECT *, 'constructor', 7 + k, '', 'New' || upper(substr(word, 1, 1)) || substr(word, 2), 'factory function' FROM w
  UNION ALL SELECT *, 'exec', 11 + k, '', 'exec.Command', '' FROM w
  UNION ALL SELECT *, 'exec', 1000 + k, '', 'exec.Command', '' FROM w
  UNION ALL SELECT *, 'unsafe', chars + 1, '', 'unsafe.Pointer', '' FROM w
  UNION ALL SELECT *, 'init', chars + 3, '', '', '' FROM w)
SELECT module, version, pkg AS package_name, vector, path AS file_path, CAST(line AS INTEGER) AS line_number, variable AS variable_name,
       '' AS command, method AS method_invoked, '' AS type_passed, pattern FROM found"""

# Pairs of brackets of a planted file: kind, number, depth, lines.
_BRACKETS = """
  SELECT module, version, path, 'round' AS kind,
         1 + CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END + CASE WHEN id % 11 = 0 THEN 2 ELSE 1 END + 1 + 2 + 1
         + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END + 1
         + CASE WHEN id % 8 = 0 THEN 3 ELSE 1 END + CASE WHEN id % 9 = 0 THEN 1 ELSE 2 END
         + CASE id % 7 WHEN 0 THEN 2 ELSE 1 END + 1 + 1 AS n,
         CASE WHEN id % 8 = 0 THEN 4 ELSE 2 END AS deepest, 3 AS lines FROM f
  UNION ALL SELECT module, version, path, 'curly', 6, 1, 8 FROM f"""

_LIST = """lines AS (
  SELECT page_id, url || ' v' || (page_id % 5) AS line FROM pages
  UNION ALL SELECT page_id, url FROM pages
  UNION ALL SELECT page_id, url || ' v1 extra' FROM pages),
modules AS (
  SELECT page_id, split_part(line, ' ', 1) AS repo_url, split_part(line, ' ', 2) AS version,
         regexp_replace(regexp_replace(regexp_replace(split_part(line, ' ', 1), '[?#].*$', ''),
                        '^https?://[^/]*', ''), '/+$', '') AS trimmed
  FROM lines WHERE len(string_split(line, ' ')) = 2),
named AS (
  SELECT page_id, repo_url, version,
         CASE WHEN trimmed = '' THEN
                CASE WHEN regexp_matches(repo_url, '^https?://[^/?#]+/') THEN '/' ELSE '.' END
              ELSE regexp_extract(trimmed, '([^/]*)$', 1) END AS name
  FROM modules)"""

_CATALOG = """
  SELECT CAST(p_size AS INTEGER) AS contributions_count, CAST(p_partkey % 97 AS INTEGER) AS dependent_repos_count,
         CAST(p_partkey AS INTEGER) AS dependents_count, p_type AS description, 'Go' AS language,
         'v1.' || p_partkey || '.0' AS latest_release_number,
         'v1.' || p_partkey || '.0' AS latest_stable_release_number,
         p_name || ' ' || p_partkey AS name,
         'https://pkg.go.dev/github.com/planted/src' || p_partkey AS package_manager_url, 'Go' AS platform,
         'https://github.com/planted/src' || p_partkey AS repository_url,
         'github.com/planted/src' || p_partkey AS import_path,
         '/go/pkg/mod/github.com/planted/src' || p_partkey || '@v1.' || p_partkey || '.0' AS module_path
  FROM part"""


# The corpus in a tree: directories d, d/b and d-b by turns, walked in this order.
_TREE_FILES = f"""
  SELECT id, lang, module, version, text, pkg, 'top/' || lang || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '/b' ELSE '-b' END || '/' || name AS path,
         name, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS turn FROM ({_FILES})"""
_WALK = _rows([(v, c.replace(" AND lang IN ('en', 'de')", " AND false"), line, fields) for v, c, line, fields in _PLANTED]).replace(
    f"WITH f AS ({_FILES})", f"WITH f AS ({_TREE_FILES})") + """, walked AS (
  SELECT o.*, row_number() OVER (
    PARTITION BY o.module, o.version, o.vector
    ORDER BY f.lang, f.turn, f.name, o.line_number, CASE WHEN o.method_invoked = 'NewOther' THEN 1 ELSE 0 END) AS ordinal
  FROM occ o JOIN f ON o.module = f.module AND o.version = f.version
   AND f.path = CASE WHEN o.vector = 'test' THEN left(o.file_path, length(o.file_path) - length(f.pkg) - 1) ELSE o.file_path END)"""


def _of(vector: str) -> list[tuple]:
    return [p for p in _PLANTED if p[0] == vector]


def oracle_sql() -> dict[str, str]:
    f = f"WITH f AS ({_FILES})"
    out = {
        "source_files": f"""{f}
            SELECT module, version, dir, path, name, '.go' AS ext, md5({_TEXT}) AS content_md5 FROM f
            UNION ALL
            SELECT DISTINCT module, version, dir, dir || '/asm.s', 'asm.s', '.s', md5({_ASM_TEXT})
            FROM f WHERE lang IN ('en', 'de')""",
        "packages": f"{f} SELECT DISTINCT module, version, dir, pkg AS package_name FROM f",
        "asm_functions": f"""{f} SELECT DISTINCT module, version, dir, 'asmFn' AS name
            FROM f WHERE lang IN ('en', 'de')""",
        "loc_per_module": f"{f} {_LOC}",
        "tokens": f"""{f} SELECT path, CAST({_TOKENS} AS BIGINT) AS n_tokens, CAST(21 AS INTEGER) AS last_line
            FROM f""",
        "occurrences": f"{_OCC} SELECT * FROM occ",
        "large_files": f"{_OCC} SELECT * FROM occ",
        "unique_counts": f"{_COUNTS} SELECT * FROM counts",
        "overview": f"{_OVERVIEW} SELECT * FROM overview",
        "density": f"""{_OVERVIEW} SELECT module, version, dependants, loc, {', '.join(
            f'CASE WHEN loc > 0 THEN CAST(n_{v} AS DOUBLE) / loc END AS d_{v}' for v in _NAMES)}
            FROM overview""",
        "summary": f"""{_COUNTS}, {_DIM}, grid AS (
              SELECT *, module || '@' || version AS module_label FROM (SELECT DISTINCT module, version FROM f) CROSS JOIN dim
              UNION ALL
              SELECT module || '/none' AS module, version, dim.*, module AS module_label
              FROM (SELECT DISTINCT module, version FROM f) CROSS JOIN dim)
            SELECT g.module, g.version, g.module_label, g.ord, g.vector, '[' || g.code || '] ' || g.label || ':' AS label,
                   COALESCE(c.n, 0) AS n, lpad(CAST(COALESCE(c.n, 0) AS VARCHAR), 10, ' ') AS shown
            FROM grid g LEFT JOIN counts c USING (module, version, vector)""",
        "detail_lines": f"""{_OCC}, {_DIM}
            SELECT module, version, ord, vector, file_path, line_number,
                   file_path || '#L' || line_number AS link, {_LINE} AS line
            FROM occ JOIN dim USING (vector)""",
        "module_details": f"""{_COUNTS}, {_DIM}, loc AS ({_LOC}), modules AS ({_MODULES}), heads AS (
              SELECT m.module, m.version, d.vector, d.ord, '[' || d.code || '] ' || d.report_label AS heading,
                     COALESCE(c.n, 0) AS n, CAST(COALESCE(c.n, 0) AS DOUBLE) / l.loc AS density
              FROM modules m JOIN loc l USING (module, version) CROSS JOIN dim d
              LEFT JOIN counts c ON c.module = m.module AND c.version = m.version AND c.vector = d.vector)
            SELECT h.module, h.version, h.ord, h.heading, h.n, h.density,
                   COALESCE(o.file_path, '') AS file_path, COALESCE(o.line_number, 0) AS line_number,
                   CASE WHEN o.file_path IS NULL THEN 'No occurrences found.' ELSE {_LINE} END AS line
            FROM heads h LEFT JOIN occ o USING (module, version, vector)""",
        "occurrence_json": f"{_OCC} SELECT module, version, {_JSON} AS json FROM occ",
        "version_delta": f"""{_OVERVIEW}, long AS (
              SELECT module, version, CAST(substr(version, 2) AS INTEGER) AS version_ord, vector, n
              FROM (UNPIVOT (SELECT module, version, {', '.join(
                  f'n_{v} AS "{v}"' for v in _NAMES)} FROM overview)
                    ON {', '.join(f'"{v}"' for v in _NAMES)} INTO NAME vector VALUE n))
            SELECT *, CAST(n - lag(n) OVER (PARTITION BY module, vector ORDER BY version_ord) AS DOUBLE) AS delta
            FROM long""",
        "custom_detector": f"""{_rows([("helper_call", "id % 12 <> 0", 19, {"method_invoked": "'other'"})])}
            SELECT * FROM occ""",
        "custom_detectors_and_rules": f"""{_rows([
            *_of("assembly"), ("helper_call", "id % 12 <> 0", 19, {"method_invoked": "'other'"}),
            ("local_new", "id % 7 > 1", 18, {"method_invoked": "'NewLocal'"}),
            ("methods", "true", 11, {"method_invoked": "'Run'"}),
            ("exec", "id % 8 <> 0", 16, {"method_invoked": "'unsafe.Sizeof'"}),
            ("exec", "id % 7 = 0", 18, {"method_invoked": "'lib.NewThing'"})])} SELECT * FROM occ""",
        "equal_paths": f"""{_rows([*_of("exec"), *_of("global")])} SELECT * FROM occ
            UNION ALL SELECT module || '-copy', * EXCLUDE (module) FROM occ""",
        "failures": f"{f} SELECT module, version, path, 'ill-formed' AS reason FROM f WHERE id % 17 < 9",
        "text_corpus": _TEXT_CORPUS,
        "shared_texts": f"""{_OCC} SELECT * FROM occ
            UNION ALL SELECT module, version || '-next' AS version, * EXCLUDE (module, version) FROM occ""",
        "walk_order": f"{_WALK} SELECT module, version, vector, ordinal, file_path, line_number, method_invoked FROM walked",
        "detail_pages": f"""{_WALK} SELECT module, version, vector, CAST((ordinal - 1) // 7 AS BIGINT) AS page,
              CAST(min(ordinal) AS BIGINT) AS first_ordinal, CAST(count(*) AS BIGINT) AS n,
              md5(string_agg({_LINE}, chr(10) ORDER BY ordinal)) AS lines_md5
            FROM walked GROUP BY module, version, vector, (ordinal - 1) // 7""",
        "bracket_pairs": f"""{f} SELECT module, version, path, kind, CAST(n AS BIGINT) AS n, CAST(deepest AS INTEGER) AS deepest,
            CAST(lines AS BIGINT) AS lines FROM ({_BRACKETS})""",
        "exec_rules_custom": f"""{_rows([
            ("exec", "id % 8 <> 0", 16, {"method_invoked": "'unsafe.Sizeof'"}),
            ("exec", "id % 7 = 0", 18, {"method_invoked": "'lib.NewThing'"})])} SELECT * FROM occ""",
        "line_column": """WITH d AS (
              SELECT doc_id, substr(text, 1, CAST(length(text) // 2 AS BIGINT)) AS head FROM documents)
            SELECT doc_id, CAST(1 + length(head) - length(replace(head, chr(10), '')) AS INTEGER) AS line,
                   CAST(1 + strlen(regexp_extract(head, '([^\n]*)$', 1)) AS INTEGER) AS col
            FROM d""",
        "module_list": f"WITH {_LIST} SELECT page_id, repo_url, version, name FROM named",
        "module_catalog": _CATALOG,
        "top_modules": f"""SELECT name, import_path, dependents_count FROM ({_CATALOG})
            ORDER BY dependents_count DESC, name LIMIT 600""",
        "dependents_lookup": f"""{f}, m AS (SELECT DISTINCT module, version FROM f)
            SELECT m.module, m.version, 'https://github.com/planted/' || m.module AS repo_url,
                   'github.com%2Fplanted%2F' || m.module AS dependents_key,
                   CAST(p.p_partkey AS BIGINT) AS dependants
            FROM m JOIN part p ON m.module = 'src' || p.p_partkey""",
        "pending_modules": f"""WITH {_LIST}
            SELECT page_id, repo_url, version, name FROM named n
            WHERE NOT EXISTS (SELECT 1 FROM named d WHERE d.repo_url LIKE 'http://%'
                              AND d.name = n.name AND d.version = n.version)""",
    }
    # What is written and read back is what was there.
    out |= {"version_delta_shared": out["version_delta"], "overview_sink": out["overview"], "details_sink": out["module_details"],
            "json_sink": out["occurrence_json"], "source_tree": out["source_files"],
            "catalog_sink": f"SELECT * EXCLUDE (module_path) FROM ({_CATALOG})"}
    for vector in _NAMES:
        out[f"vec_{vector}"] = f"{_rows([p for p in _PLANTED if p[0] == vector])} SELECT * FROM occ"
    return out
