"""Symbols of source files by line rules.

The rules are a table per language family. A file is split into lines once; each rule
is one regular expression in the same projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Family -> extensions.
FAMILIES = {
    "script": ("cjs", "js", "jsx", "mjs", "ts", "tsx"),
    "python": ("py",),
    "java": ("java",),
    "go": ("go",),
    "rust": ("rs",),
    "ruby": ("rb",),
    "php": ("php",),
    "c": ("c", "cc", "cpp", "h", "hpp"),
}
CONTROL = ("for", "if", "switch", "while")
GAP, NAME, OPEN, UPPER = r"\s+", r"(\w+)", r"\s*\(", r"([A-Z_][\dA-Z_]*)"
VALUE = r"\s*="
ARGUMENTS = r"\([^)]*\)"


def named(words: str, after: str = "", before: str = "") -> str:
    """A keyword (or several, parted by bars), a gap and a name."""
    return f"{before}(?:{words}){GAP}{NAME}{after}"


#: Family -> (kind, regex, group of the name or 0 for the whole line, attribute, names that do not count).
RULES: dict[str, tuple[tuple[str, str, int, str, tuple[str, ...]], ...]] = {
    "script": (
        ("import", rf"import{GAP}(?:\w+|\*{GAP}as{GAP}\w+|\{{[^}}]+}})", 0, "", ()),
        ("export", named("class|const|function|interface|let|type|var", before=rf"\Aexport{GAP}(?:default{GAP})?"), 1, "", ()),
        ("function", named("function", OPEN), 1, "declared", ()),
        ("function", named("const|let|var", rf"{VALUE}\s*(?:async{GAP})?{ARGUMENTS}\s*=>"), 1, "arrow", ()),
        ("class", named("class"), 1, "", ()),
        ("interface", named("interface"), 1, "", ()),
        ("type", named("type", VALUE), 1, "", ()),
        ("constant", f"const{GAP}{UPPER}{VALUE}", 1, "", ()),
    ),
    "python": (
        ("import", r"\A(?:from|import) ", 0, "", ()),
        ("function", named("def", OPEN), 1, "", ()),
        ("class", named("class"), 1, "", ()),
        ("constant", rf"\A{UPPER}{VALUE}", 1, "", ()),
    ),
    "java": (
        ("import", r"\Aimport ", 0, "", ()),
        ("class", named("class|enum|interface"), 1, "", ()),
        ("function", named(rf"(?:private|protected|public){GAP}(?:static{GAP})?\w+", OPEN), 1, "", CONTROL),
    ),
    "go": (
        ("import", r"\Aimport ", 0, "", ()),
        ("function", rf"func{GAP}(?:{ARGUMENTS}{GAP})?{NAME}{OPEN}", 1, "", ()),
        ("type", named("type", f"{GAP}(?:interface|struct)"), 1, "", ()),
        ("constant", named("const", VALUE), 1, "", ()),
    ),
    "rust": (
        ("import", r"\Ause ", 0, "", ()),
        ("function", named("fn", OPEN), 1, "", ()),
        ("type", named("enum|struct|trait"), 1, "", ()),
        ("constant", named("const", r"\s*:"), 1, "", ()),
    ),
    "ruby": (("import", r"\Arequire ", 0, "", ()), ("function", named("def"), 1, "", ()), ("class", named("class|module"), 1, "", ())),
    "php": (("import", r"\A(?:include|require|use) ", 0, "", ()), ("function", named("function", OPEN), 1, "", ()), ("class", named("class"), 1, "", ())),
    "c": (
        ("import", r"\A#include ", 0, "", ()),
        ("function", rf"(?:\w+{GAP})+{NAME}\s*{ARGUMENTS}\s*\{{", 1, "", CONTROL),
        ("class", named("class|struct"), 1, "", ()),
    ),
}
KIND = "array<struct<kind:string,name:string,attrs:map<string,string>>>"


def _found(family: str, line: Column) -> Column:
    each = []
    for kind, rule, group, attribute, refused in RULES[family]:
        name = F.regexp_extract(line, rule, group) if group else line
        attrs = {"style": F.lit(attribute)} if attribute else {}
        if family == "script" and kind == "import":
            attrs["module"] = F.nullif(F.regexp_extract(line, rule + r"\s+from\s+['\"]([^'\"]+)['\"]", 1), F.lit(""))
        if family == "script" and kind == "export":
            attrs["declares"] = F.regexp_extract(line, r"\Aexport\s+(?:default\s+)?(\w+)", 1)
            attrs["default"] = line.rlike(r"\Aexport\s+default\s").cast("string")
        if family == "python" and kind == "function":
            attrs["private"] = name.startswith("_").cast("string")
        pairs = F.map_from_arrays(F.array(*map(F.lit, attrs)), F.array(*attrs.values())) if attrs else F.expr("map()")
        test = line.rlike(rule)
        if family == "script" and kind == "import":
            test = test & (line.startswith("import ") | line.contains(" from "))
        if refused:
            test = test & ~name.isin(*refused)
        each.append(F.when(test, F.struct(F.lit(kind).alias("kind"), name.alias("name"), pairs.cast("map<string,string>").alias("attrs"))))
    return F.array_compact(F.array(*each)).cast(KIND)


def symbols(code: DataFrame) -> DataFrame:
    """(file, extension, line, kind, name, attrs) of files (file, extension, content)."""
    line = F.trim(F.col("l"), F.lit(" \t\r\f\x0b"))
    rows = code.select("file", "extension", F.posexplode(F.split("content", "\n", -1)).alias("i", "l")).select("file", "extension", (F.col("i") + 1).alias("line"), line.alias("l"))
    found = F.array().cast(KIND)
    for family, extensions in FAMILIES.items():
        found = F.when(F.col("extension").isin(*extensions), _found(family, F.col("l"))).otherwise(found)
    return rows.select("file", "extension", "line", F.explode(found).alias("x")).select("file", "extension", "line", "x.*")


def file_summary(code: DataFrame, found: DataFrame) -> DataFrame:
    """T12.9, M15: (file, extension, lines, symbols), also for files of no known family."""
    n = found.groupBy("file").agg(F.count("*").alias("n"))
    return code.join(n, "file", "left").select("file", "extension", F.size(F.split("content", "\n", -1)).alias("lines"), F.coalesce("n", F.lit(0)).alias("symbols"))


def totals(code: DataFrame, found: DataFrame) -> DataFrame:
    """A10: (extension, files, lines, symbols) by extension, and over all where extension is null."""
    own = file_summary(code, found)
    return own.rollup("extension").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("symbols").alias("symbols"))
