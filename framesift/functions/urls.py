"""URLs as slotmaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_to_slotmap(u) -> Column:
    """struct (scheme, host, port, dir, name, suffix, query, fragment); the port is 80 unless given."""
    x = _c(u)
    part = lambda pattern, group=1: F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))
    head = r"^([A-Za-z]+)://([^:/?#]*)(?::([0-9]+))?"
    path = rf"{head}(/(?:[^/?#]*/)*)?([^/?#]*)"
    file = F.regexp_extract(x, path, 5)
    dotted = file.rlike(r"\.[^.]*$")
    return F.when(x.rlike(r"^[A-Za-z]+://"), F.struct(
        part(head, 1).alias("scheme"), part(head, 2).alias("host"), F.coalesce(part(head, 3).cast("int"), F.lit(80)).alias("port"),
        F.coalesce(part(path, 4), F.lit("/")).alias("dir"),
        F.nullif(F.when(dotted, F.regexp_replace(file, r"\.[^.]*$", "")).otherwise(file), F.lit("")).alias("name"),
        F.when(dotted, F.regexp_extract(file, r"\.([^.]*)$", 1)).alias("suffix"),
        part(r"^[^?#]*\?([^#]*)").alias("query"), part(r"#(.*)$").alias("fragment"),
    ))


def slotmap_to_url(m: Column) -> Column:
    tail = lambda sep, f: F.coalesce(F.concat(F.lit(sep), m[f]), F.lit(""))
    return F.concat(m["scheme"], F.lit("://"), m["host"], F.lit(":"), m["port"].cast("string"), m["dir"], F.coalesce(m["name"], F.lit("")), tail(".", "suffix"), tail("?", "query"), tail("#", "fragment"))


def fragment_base(m: Column) -> Column:
    """Without the fragment."""
    return m.dropFields("fragment")


def query_base(m: Column) -> Column:
    return m.dropFields("query", "fragment")


def get_domains(host) -> Column:
    """A host name and its suffixes after every dot."""
    parts = F.split(_c(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def path_prefixes(path) -> Column:
    """Every directory above a path, from the root down."""
    parts = F.filter(F.split(_c(path), "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def normalize_url(ref, base) -> Column:
    """A reference read within a base URL: absolute as it stands, rooted, or relative with ./ and ../ steps."""
    r, b = _c(ref), _c(base)
    m = url_to_slotmap(b)
    site = F.concat(m["scheme"], F.lit("://"), m["host"], F.lit(":"), m["port"].cast("string"))
    ups = F.size(F.regexp_extract_all(F.regexp_extract(r, r"^(?:\.{1,2}/)*", 0), F.lit(r"\.\./"), F.lit(0)))
    rest = F.regexp_replace(r, r"^(?:\.{1,2}/)+", "")
    dirs = F.filter(F.split(m["dir"], "/"), lambda x: x != "")
    kept = F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - ups, F.lit(0)))
    folder = F.when(F.size(kept) > 0, F.concat(F.lit("/"), F.array_join(kept, "/"), F.lit("/"))).otherwise(F.lit("/"))
    return F.when(r.rlike(r"^(?:ftp:|nntp:|mailto:|gopher:|https?:)"), r).when(r.startswith("/"), F.concat(site, r)).otherwise(F.concat(site, folder, rest))
