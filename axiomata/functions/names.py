"""IRIs, CURIEs and names as column functions; prefix tables are small Python dictionaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from axiomata.functions.terms import STANDARD

SCHEMES = ("data", "doi", "file", "mailto", "tag", "urn")
_RESERVED = r"[\s()<>\"@^#/?,;]"


def prefixes(**own: str) -> dict[str, str]:
    """A prefix table with the four standard ones; a trailing colon in a name is dropped."""
    return STANDARD | {k.rstrip(":"): v for k, v in own.items()}


def is_absolute(c: Column) -> Column:
    """Does a name start with ``scheme://`` or with a known scheme and a colon?"""
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://") | F.lower(F.substring_index(c, ":", 1)).isin(*SCHEMES) & c.contains(":")


def expand(c: Column, table: dict[str, str]) -> Column:
    """The IRI of a bracketed, absolute or prefixed name; null where the prefix is not in the table.

    A bare name takes the default prefix (the empty one).
    """
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.lit(None).cast("map<string,string>")
    prefix = F.when(c.contains(":"), F.substring_index(c, ":", 1)).otherwise(F.lit(""))
    local = F.when(c.contains(":"), F.substr(c, F.instr(c, F.lit(":")) + 1)).otherwise(c)
    return (
        F.when(c.startswith("<") & c.endswith(">"), F.substr(c, F.lit(2), F.length(c) - 2))
        .when(is_absolute(c), c)
        .when(F.trim(c) == "", F.lit(None))
        .otherwise(F.concat(F.element_at(known, prefix), local))
    )


def why_not_expanded(c: Column, table: dict[str, str]) -> Column:
    """The reason :func:`expand` gives null: empty, no default prefix, or an unknown prefix; null where it does not."""
    missing = expand(c, table).isNull()
    return (
        F.when(F.trim(c) == "", F.lit("empty name"))
        .when(missing & ~c.contains(":"), F.concat(F.lit("no default prefix for "), c))
        .when(missing, F.concat(F.lit("unknown prefix "), F.substring_index(c, ":", 1)))
    )


def is_local(c: Column) -> Column:
    """May the text follow a prefix? Non-empty and free of reserved characters."""
    return (c != "") & ~c.rlike(_RESERVED)


def compact(c: Column, table: dict[str, str]) -> Column:
    """``prefix:local`` by the longest namespace that leaves a usable local part, ties by prefix; else null."""
    out = F.lit(None).cast("string")
    for prefix, ns in sorted(table.items(), key=lambda kv: (-len(kv[1]), kv[0].encode())):
        local = F.substr(c, F.lit(len(ns) + 1))
        # first hit in this order wins: the chain is built from its last entry on
        out = F.coalesce(out, F.when(c.startswith(ns) & is_local(local), F.concat(F.lit(f"{prefix}:"), local)))
    return out


def written(c: Column, table: dict[str, str]) -> Column:
    """The compact name where there is one, else the IRI in brackets."""
    return F.coalesce(compact(c, table), F.concat(F.lit("<"), c, F.lit(">")))


def is_builtin(c: Column) -> Column:
    """In one of the four standard namespaces, with something after it."""
    out = F.lit(False)
    for ns in STANDARD.values():
        out = out | (c.startswith(ns) & (F.length(c) > len(ns)))
    return out


def owner(c: Column, table: dict[str, str]) -> Column:
    """The prefix whose namespace is the longest that starts the IRI; null for none."""
    out = F.lit(None).cast("string")
    for prefix, ns in sorted(table.items(), key=lambda kv: (-len(kv[1]), kv[0].encode())):
        out = F.coalesce(out, F.when(c.startswith(ns), F.lit(prefix)))
    return out


def local_name(c: Column) -> Column:
    """What follows the last ``#``, ``/`` or ``:``."""
    return F.regexp_extract(c, r"([^#/:]*)$", 1)


def fold(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def fold_label(c: Column) -> Column:
    return F.lower(F.trim(c))


def simplify(c: Column) -> Column:
    """For near misses: the local part, folded."""
    return fold(F.regexp_replace(c, r"^[^:]*:", ""))


def head(c: Column) -> Column:
    """The keyword before the first parenthesis."""
    return F.substring_index(c, "(", 1)
