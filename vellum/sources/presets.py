"""Layout parameters, presets and settings as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameters with their types and defaults.
PARAMETERS = (
    ("pageWidth", "double", 258.0), ("pageHeight", "double", 346.0), ("marginTop", "double", 18.0), ("marginBottom", "double", 18.0),
    ("marginLeft", "double", 18.0), ("marginRight", "double", 18.0), ("fontSize", "double", 12.0), ("lineHeight", "double", 1.5),
    ("paragraphSpacing", "double", 3.6), ("firstLineIndent", "double", 16.0), ("disableFirstLineIndent", "boolean", False),
    ("secondaryIndentRatio", "double", 0.5), ("textAlignment", "string", "LEFT"), ("forceAlign", "boolean", True),
    ("verticalAlignment", "string", "TOP"), ("imageWrapMode", "string", "TOP_AND_BOTTOM"), ("stripHeadersFooters", "boolean", True),
    ("hideFrontToc", "boolean", False), ("boldHeadings", "boolean", True), ("headingScale", "double", 1.4),
    ("enableOrphanControl", "boolean", True), ("enableWidowControl", "boolean", True), ("volumeSplitMode", "string", "NONE"),
    ("tableDisplayMode", "string", "SMART_CARD"),
)
#: What the parameters with named values may be.
NAMED = {
    "textAlignment": ("LEFT", "RIGHT", "CENTER", "JUSTIFY"), "verticalAlignment": ("TOP", "CENTER", "JUSTIFY"),
    "imageWrapMode": ("HIDE", "BEHIND_TEXT", "TOP_AND_BOTTOM"),
    "volumeSplitMode": ("NONE", "AUTO", "TWO", "THREE", "FOUR", "FIVE"), "tableDisplayMode": ("SMART_CARD", "GRID"),
}
SCHEMA = ", ".join(f"{n} {t}" for n, t, _ in PARAMETERS)


def params_from_json(text: Column) -> Column:
    """Struct of all parameters; missing, unreadable and unknown values take their defaults."""
    read = F.from_json(text, SCHEMA)
    out = []
    for name, _, default in PARAMETERS:
        value = read[name]
        if name in NAMED:
            value = F.when(value.isin(*NAMED[name]), value)
        out.append(F.coalesce(value, F.lit(default)).alias(name))
    return F.struct(*out)


def params_to_json(params: Column) -> Column:
    return F.to_json(params)


def saved(presets: DataFrame, new: DataFrame) -> DataFrame:
    """``name, params`` with the new presets in place of those of equal name."""
    return presets.join(new.select("name").distinct(), "name", "left_anti").unionByName(new)


def backup(presets: DataFrame, settings: DataFrame, version: int = 1) -> DataFrame:
    """One JSON document of all presets (a user's own, a handful) and settings."""
    p = presets.agg(F.sort_array(F.collect_list(F.struct("name", "params"))).alias("presets"))
    s = settings.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("settings"))
    return p.join(F.broadcast(s)).select(F.to_json(F.struct(F.lit(version).alias("version"), "presets", "settings")).alias("json"))


def restored(backups: DataFrame) -> DataFrame:
    """``name, params`` of the presets in backups of version 1; others restore nothing."""
    read = F.from_json("json", "version int, presets array<struct<name:string,params:string>>, settings map<string,string>")
    return backups.select(read.alias("b")).where("b.version = 1").select(F.explode("b.presets").alias("p")).select("p.name", "p.params")


def script_meta(script: Column) -> Column:
    """Struct ``name, version, author, matches, run_at`` of a userscript, null without its header."""
    block = F.regexp_extract(script, r"(?s)//\s*==UserScript==(.*?)//\s*==/UserScript==", 1)

    def field(key: str, default: str) -> Column:
        found = F.regexp_extract_all(block, F.lit(rf"(?im)^\s*//\s*@{key}\s+(.*)$"), F.lit(1))
        return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1))).otherwise(F.lit(default))

    matches = F.transform(F.regexp_extract_all(block, F.lit(r"(?im)^\s*//\s*@match\s+(.*)$"), F.lit(1)), F.trim)
    meta = F.struct(
        field("name", "未命名脚本").alias("name"), field("version", "unknown").alias("version"), field("author", "").alias("author"),
        matches.alias("matches"), field("run-at", "document-idle").alias("run_at"),
    )
    return F.when(script.rlike(r"(?s)//\s*==UserScript==.*?//\s*==/UserScript=="), meta)
