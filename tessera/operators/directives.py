"""Suppression directives in source text: scan, apply, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.identifiers import DATE, RULE_ID

#: White space that trim() of the directive grammar removes.
_BLANK = " \t\n\r\x0b\x0c\x85\xa0"


def lines(source: Column) -> Column:
    """Lines of a text: split at \\n, a \\r before it goes, and a final line end starts no further line."""
    parts = F.split(F.regexp_replace(source, "\\n\\z", ""), "\n", -1)
    return F.when(F.length(source) == 0, F.array().cast("array<string>")).otherwise(F.transform(parts, lambda x: F.regexp_replace(x, "\\r\\z", "")))


def byte_column(text: Column, characters_before: Column) -> Column:
    """1-based column in bytes of the place after so many characters."""
    return (F.octet_length(F.substring(text, F.lit(1), characters_before)) + 1).cast("int")


def tokens(prefix: str) -> tuple[str, str]:
    """The directives for the next line and for the whole file."""
    return f"{prefix}-disable-next-line", f"{prefix}-disable-file"


#: A directive as it stands in a file; problem is null for a valid one.
FOUND = "struct<scope:string,rules:array<string>,reason:string,expires:string,line:int,column:int,problem:string>"


def found(files: DataFrame, prefix: str = "tessera") -> DataFrame:
    """files (file, source) -> all directives, valid and malformed: file and the fields of FOUND.

    One directive per line, the earlier of the two tokens; a token stands alone: no word character beside
    it and no hyphen after it.
    """
    nxt, whole = tokens(prefix)
    alone = f"(?<![A-Za-z0-9_])({nxt}|{whole})(?![A-Za-z0-9_-])"
    rows = files.filter(F.contains("source", F.lit(f"{prefix}-disable-"))).select("file", F.posexplode(lines(F.col("source"))).alias("at", "text"))
    rows = rows.withColumns({"token": F.regexp_extract("text", alone, 1), "place": F.regexp_instr("text", F.lit(alone))}).filter("token <> ''")
    rest = F.substring(F.col("text"), F.col("place") + F.length("token"), F.length("text"))
    rows = rows.withColumns({"rest": rest, "line": (F.col("at") + 1).cast("int"), "column": byte_column(F.col("text"), F.col("place") - 1)})
    split_at = F.instr("rest", "reason:")
    rows = rows.withColumns({
        "ids": F.filter(F.split(F.when(split_at > 0, F.substring(F.col("rest"), F.lit(1), split_at - 1)).otherwise(""), "[, \\t]"), lambda x: x != ""),
        "tail": F.when(split_at > 0, F.substring(F.col("rest"), split_at + 7, F.length("rest"))),
    })
    dated = F.contains("tail", F.lit("expires:"))
    rows = rows.withColumns({
        "bad_id": F.get(F.filter("ids", lambda x: ~x.rlike(RULE_ID)), F.lit(0)),
        "until": F.when(dated, F.btrim(F.substring_index("tail", "expires:", -1), F.lit(_BLANK))),
        "reason": F.btrim(F.when(dated, F.expr("substring(tail, 1, length(tail) - length(substring_index(tail, 'expires:', -1)) - 8)")).otherwise(F.col("tail")), F.lit(_BLANK)),
    })
    problem = (
        F.when(F.col("tail").isNull(), F.concat(F.lit("suppression has no `reason:`; write: "), "token", F.lit(" <rule-id> reason: why this is acceptable")))
        .when(F.col("bad_id").isNotNull(), F.concat(F.lit("`"), "bad_id", F.lit("` is not a rule id; ids are namespaced")))
        .when(F.size("ids") == 0, F.lit("suppression names no rules; name the rules it is for"))
        .when(F.col("until").isNotNull() & ~F.col("until").rlike(DATE), F.concat(F.lit("suppression has an unreadable `expires: "), "until", F.lit("`; expected YYYY-MM-DD")))
        .when(F.col("reason") == "", F.concat(F.lit("suppression has an empty `reason:`; write: "), "token", F.lit(" <rule-id> reason: why this is acceptable")))
    )
    rows = rows.withColumn("problem", problem)
    return rows.select("file", F.when(F.col("token") == nxt, "next_line").otherwise("file").alias("scope"), F.col("ids").alias("rules"), "reason", F.col("until").alias("expires"), "line", "column", "problem")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directives, malformed) of what found() gives."""
    valid = rows.filter("problem IS NULL").select("file", F.col("line").alias("idx"), "scope", "rules", "reason", "expires", "line", "column")
    return valid, rows.filter("problem IS NOT NULL").select("file", "line", "column", "problem")


def scan(files: DataFrame, prefix: str = "tessera") -> tuple[DataFrame, DataFrame]:
    """files (file, source) -> (directives, malformed)."""
    return split(found(files, prefix))


def covered(violations: DataFrame, directives: DataFrame) -> DataFrame:
    """violations with covered_by: the line of the first directive that covers them, null for none.

    A directive covers the line after it, or its whole file, for the rules that it lists. The join keys are
    file and rule, so both sides hash to the same place; only the line is left as a residual.
    """
    each = directives.select(F.col("file").alias("d_file"), F.explode(F.array_distinct("rules")).alias("d_rule"), "scope", F.col("line").alias("d_line"))
    # whole-file directives: one row per file and rule; others: one per line
    whole = each.filter("scope = 'file'").groupBy("d_file", "d_rule").agg(F.min("d_line").alias("whole_line"))
    near = each.filter("scope = 'next_line'").groupBy(F.col("d_file").alias("n_file"), F.col("d_rule").alias("n_rule"), (F.col("d_line") + 1).alias("n_at")).agg(F.min("d_line").alias("near_line"))
    rule = F.concat_ws("/", "rule_ns", "rule_name")
    out = violations.withColumn("rule_id_", rule)
    out = out.join(whole, (F.col("file") == F.col("d_file")) & (F.col("rule_id_") == F.col("d_rule")), "left")
    out = out.join(near, (F.col("file") == F.col("n_file")) & (F.col("rule_id_") == F.col("n_rule")) & (F.col("line") == F.col("n_at")), "left")
    return out.withColumn("covered_by", F.least("whole_line", "near_line")).drop("rule_id_", "d_file", "d_rule", "whole_line", "n_file", "n_rule", "n_at", "near_line")


def apply(violations: DataFrame, directives: DataFrame, malformed: DataFrame, today: str, prefix: str = "tessera", unused: bool = False) -> DataFrame:
    """Violations that no directive covers, plus those about directives: malformed and expired are errors, unused ones warnings.

    An expired directive still silences; the day it names is its last valid one.
    """
    judged = covered(violations, directives)
    kept = judged.filter("covered_by IS NULL").drop("covered_by")
    none = F.lit(None)

    def about(rows: DataFrame, message: Column, remediation: str, severity: str) -> DataFrame:
        have = {"rule_ns": F.lit(prefix), "rule_name": F.lit("suppression"), "message": message, "remediation": F.lit(remediation), "severity": F.lit(severity)}
        return rows.select(*[(have[f.name] if f.name in have else F.col(f.name) if f.name in ("file", "line", "column") else none.cast(f.dataType)).alias(f.name) for f in violations.schema.fields])

    out = kept.unionByName(about(malformed, F.col("problem"), "write the directive with rule ids and a reason", "error"))
    late = directives.filter(F.col("expires") < F.lit(today))
    out = out.unionByName(about(late, F.concat(F.lit("suppression expired on "), F.col("expires")), "fix the violation, or accept it again with a later date", "error"))
    if unused:
        used = judged.filter("covered_by IS NOT NULL").select("file", F.col("covered_by").alias("line")).distinct()
        out = out.unionByName(about(directives.join(used, ["file", "line"], "left_anti"), F.lit("suppression is not used"), "remove it", "warn"))
    return out
