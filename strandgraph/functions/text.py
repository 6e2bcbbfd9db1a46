"""Tokens of identifiers, ids by hash, escapes, and what kind of question an input is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_tokens(text: Column) -> Column:
    """Lower-case parts of a camel or snake case name, of two letters or more; the whole name where none is left."""
    spaced = F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    parts = F.filter(F.split(F.lower(spaced), r"[_\-. ]+"), lambda x: F.length(x) > 1)
    return F.when(F.size(parts) > 0, F.array_distinct(parts)).otherwise(F.array(F.lower(text)))


def short_id(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def mermaid(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit("#quot;"))


def dot(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


#: Endings of files that are no sources, and the first parts of configuration keys.
OTHER_FILES = (
    ".json", ".yml", ".yaml", ".xml", ".config", ".razor", ".cshtml", ".html", ".css",
    ".js", ".ts", ".sql", ".md", ".txt", ".props", ".targets", ".sh", ".ps1", ".env",
    ".csproj", ".sln", ".slnx",
)
CONFIG_ROOTS = (
    "connectionstrings", "logging", "loglevel", "serilog", "kestrel", "allowedhosts", "applicationinsights", "authentication", "jwt", "cors", "healthchecks", "featureflags", "opentelemetry", "hangfire", "redis", "rabbitmq", "masstransit",
)


def question_kind(text: Column, assemblies: Column | None = None) -> Column:
    """(kind, decisive) of an input that names no symbol, by the first rule that holds; kind `symbol` if none does.

    assemblies: an array of the names of assemblies that the graph's external types come from."""
    q = F.trim(text)
    low = F.lower(q)
    is_file = low.startswith("dockerfile")
    for e in OTHER_FILES:
        is_file = is_file | low.endswith(e)
    has = lambda c: F.contains(q, F.lit(c))
    route = ~low.endswith(".cs") & (low.startswith("/") | low.startswith("api/") | (has("/") & ~has("\\") & ~is_file))
    package = F.lit(False) if assemblies is None else F.exists(assemblies, lambda a: (F.lower(a) == low) | F.startswith(F.lower(a), F.concat(low, F.lit("."))))
    rules = [
        ("comment", low.startswith("todo") | low.startswith("fixme") | low.startswith("hack"), F.lit(True)),
        ("route", route, F.lit(True)),
        ("environment-variable", (F.length(q) > 2) & has("_") & q.rlike(r"^[\p{Lu}\p{Nd}_]+$"), F.lit(True)),
        ("file", is_file, F.lit(True)),
        ("configuration-key", has(":") | F.substring_index(low, ".", 1).isin(*CONFIG_ROOTS), has(":")),
        ("package", package, F.lit(False)),
        ("prose", has(" "), F.lit(True)),
    ]
    out = F.struct(F.lit("symbol").alias("kind"), F.lit(False).alias("decisive"))
    for name, rule, decisive in reversed(rules):
        out = F.when(rule, F.struct(F.lit(name).alias("kind"), decisive.alias("decisive"))).otherwise(out)
    return out
