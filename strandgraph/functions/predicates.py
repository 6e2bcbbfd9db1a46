"""Predicates and scalar expressions over nodes and edges; all are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..graph import SUBSCRIBE, TRUST, WRITE

FLOW = ("Call", "Mediatr", "Interface", "Override", "Construct", "Route")
TYPES = ("type", "interface", "enum")
OWNERS = ("member", "ctor")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def score(confidence: Column | str = "confidence") -> Column:
    return F.coalesce(_col(confidence), F.lit(1.0))


def is_flow(kind: Column | str = "kind", note: Column | str = "note") -> Column:
    """Control flow: no bindings, no type use, no property access; a null note passes."""
    return _col(kind).isin(*FLOW) & ~_col(note).eqNullSafe("prop")


def is_entrypoint(tags: Column | str = "tags") -> Column:
    return F.exists(_col(tags), lambda t: t.startswith("http:") | t.startswith("endpoint:") | t.isin("handler", "consumer", "hosted", "action"))


def is_test(tags: Column | str = "tags") -> Column:
    return F.array_contains(_col(tags), "test")


def is_synthetic(name: Column | str = "name") -> Column:
    return F.contains(_col(name), F.lit("<anonymous")) | _col(name).startswith("(")


def has_write(role: Column | str = "role") -> Column:
    return F.coalesce(_col(role), F.lit(0)).bitwiseAND(WRITE) != 0


def has_subscribe(role: Column | str = "role") -> Column:
    return F.coalesce(_col(role), F.lit(0)).bitwiseAND(SUBSCRIBE) != 0


def is_inferred(confidence: Column | str = "confidence") -> Column:
    return score(confidence) < TRUST


def under(file: Column | str, prefix: str) -> Column:
    """Path prefix, without regard to case and kind of slash."""
    return F.lower(F.replace(_col(file), F.lit("\\"), F.lit("/"))).startswith(prefix.replace("\\", "/").lower())


def covers(line: Column, first: Column | str = "line", last: Column | str = "end_line") -> Column:
    return line.between(_col(first), F.greatest(_col(last), _col(first)))


def project_matches(project: Column | str, wanted: str) -> Column:
    p = F.lower(_col(project))
    return (p == wanted.lower()) | p.endswith("/" + wanted.lower())


def leaf(name: Column | str) -> Column:
    return F.substring_index(_col(name), ".", -1)


def owner(name: Column | str) -> Column:
    """What stands before the last dot, empty without one."""
    return F.regexp_extract(_col(name), r"^(.*)\.[^.]*$", 1)


namespace = owner


def role_names(role: Column | str = "role") -> Column:
    """The bits of a role as text, empty for null: `Read, Write`."""
    r = F.coalesce(_col(role), F.lit(0))
    bit = lambda b, text: F.when(r.bitwiseAND(b) != 0, F.lit(text))
    return F.concat_ws(", ", bit(1, "Read"), bit(2, "Write"), bit(4, "Subscribe"))


def token_cost(text: Column | str) -> Column:
    """An estimate of the tokens of a line: a quarter of its length with its line end, rounded up."""
    return F.ceil((F.length(_col(text)) + 1) / 4).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Floored, 0 of nothing."""
    return F.when(whole > 0, F.floor(100 * part / F.greatest(whole, F.lit(1)))).otherwise(0)


def location(file: Column | str = "file", line: Column | str = "line") -> Column:
    return F.when(F.coalesce(_col(file), F.lit("")) == "", "").otherwise(F.concat(_col(file), F.lit(":"), _col(line).cast("string")))


def marker(confidence: Column | str = "confidence") -> Column:
    """`?0.70` on an edge below the trusted score, else empty."""
    return F.when(is_inferred(confidence), F.concat(F.lit("?"), F.format_string("%.2f", score(confidence)))).otherwise("")


#: What becomes of an exit status.
EXITS = {0: "ok", 1: "error", 2: "not-found", 3: "no-index", 4: "ambiguous", 64: "usage", 70: "over-budget"}


def exit_name(code: Column | str) -> Column:
    out = F.lit("unknown")
    for k, name in EXITS.items():
        out = F.when(_col(code) == k, name).otherwise(out)
    return out
