"""The engine's tables. Positions are flat columns, because they are sort keys."""

from __future__ import annotations

FILES = "file string, language string, source string, content_hash string"
NODES = (
    "file string, node_id int, parent_id int, child_idx int, depth int, pre int, post int, kind string, field string, "
    "named boolean, start_byte long, end_byte long, line int, column int, text string"
)
SCOPES = "file string, scope_id int, pre int, post int, depth int"
DECLS = "file string, scope_id int, name string, kind string, module string, imported string"
FACTS = "rule_ns string, rule_name string, file string, kind string, data string, sequence int"
FIX = "struct<start:bigint,end:bigint,replacement:string,safe:boolean>"
VIOLATIONS = f"rule_ns string, rule_name string, file string, line int, column int, message string, remediation string, severity string, fix {FIX}"
DIRECTIVES = "file string, idx int, scope string, rules array<string>, reason string, expires string, line int, column int"
MALFORMED = "file string, line int, column int, problem string"
READS = "file string, path string, hash string"
SEVERITIES = ("warn", "error", "off")
#: ASCII-lower-cased extension -> language id.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust",
}
