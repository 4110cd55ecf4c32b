"""Static-analysis reports in JSON -> rows. texts: repo_id, value (a whole report); any number of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUBY_LINT = "files array<struct<path:string,offenses:array<struct<cop_name:string,message:string,fatal:boolean,severity:string>>>>"
JS_LINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,message:string,fatal:boolean>>>>"
MODULES = "modules array<struct<source:string,dependencies:array<struct<resolved:string>>>>"


def _under(path, root: str):
    plain = F.regexp_replace(path, r"^(\./)+", "")
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(plain) if root else plain


def ruby_lint(texts: DataFrame, root: str = "") -> DataFrame:
    """repo_id, path, message, skipped (the file could not be parsed)."""
    body = texts.select("repo_id", F.from_json("value", f"struct<{RUBY_LINT.replace(' ', ':', 1)}>").alias("j"))
    files = body.select("repo_id", F.explode("j.files").alias("f")).select("repo_id", _under(F.col("f.path"), root).alias("path"), F.explode_outer("f.offenses").alias("o"))
    syntax = F.coalesce(F.col("o.fatal"), F.lit(False)) | F.coalesce(F.col("o.severity") == "fatal", F.lit(False)) | F.coalesce(F.col("o.cop_name") == "Lint/Syntax", F.lit(False))
    return files.select("repo_id", "path", F.col("o.message").alias("message"), syntax.alias("skipped"))


def js_lint(texts: DataFrame, root: str = "") -> DataFrame:
    body = texts.select("repo_id", F.explode(F.from_json("value", JS_LINT)).alias("f"))
    each = body.select("repo_id", _under(F.col("f.filePath"), root).alias("path"), F.explode_outer("f.messages").alias("m"))
    return each.select("repo_id", "path", F.col("m.message").alias("message"), F.coalesce(F.col("m.fatal"), F.lit(False)).alias("skipped"))


def modules(texts: DataFrame, root: str = "") -> DataFrame:
    """repo_id, src, dst of every dependency; external ones go later, against the scored files."""
    body = texts.select("repo_id", F.from_json("value", f"struct<{MODULES.replace(' ', ':', 1)}>").alias("j"))
    each = body.select("repo_id", F.explode("j.modules").alias("m")).select("repo_id", _under(F.col("m.source"), root).alias("src"), F.explode("m.dependencies").alias("d"))
    return each.select("repo_id", "src", _under(F.col("d.resolved"), root).alias("dst")).filter("dst IS NOT NULL")
