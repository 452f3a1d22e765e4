"""More lockfile readers: files(path, text) -> path, ecosystem, name, version, integrity.

Each is a projection over whole files, without a shuffle. Text that doesn't parse
gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(files: DataFrame, found: Column, ecosystem: str, name: Column, version: Column, integrity: Column | None = None) -> DataFrame:
    each = files.select("path", F.explode(found).alias("x"))
    digest = F.lit(None).cast("string") if integrity is None else F.when(integrity != "", integrity)
    return each.select("path", F.lit(ecosystem).alias("ecosystem"), name.alias("name"), version.alias("version"), digest.alias("integrity")).where("name <> '' AND version <> ''")


def _section(header: str) -> Column:
    """The text below an unindented header line, up to the next one."""
    parts = F.split("text", r"\n(?=\S)")
    return F.array_join(F.filter(parts, lambda s: s.startswith(header)), "\n")


def _field(block: Column, key: str) -> Column:
    return F.regexp_extract(block, rf'(?m)^{key} = "([^"]*)"', 1)


def uv_lock(files: DataFrame) -> DataFrame:
    """[[package]] blocks; the integrity is the first hash named."""
    x = F.col("x")
    blocks = F.split("text", r"(?m)^\[\[package\]\]$")
    return _rows(files, F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), "pypi", _field(x, "name"), _field(x, "version"), F.regexp_extract(x, r'hash = "([^"]*)"', 1))


def gemfile_lock(files: DataFrame) -> DataFrame:
    """Entries of the GEM section at four spaces; deeper ones are constraints."""
    x = F.col("x")
    line = r"(?m)^ {4}(\S+) \(([^)]*)\)$"
    return _rows(files, F.regexp_extract_all(_section("GEM"), F.lit(line), F.lit(0)), "rubygems", F.regexp_extract(x, line, 1), F.regexp_extract(x, line, 2))


def pnpm_lock(files: DataFrame) -> DataFrame:
    """Keys of the packages section: /name/1.0.0, /name@1.0.0 or name@1.0.0, with or without quotes and peer suffix."""
    x = F.col("x")
    line = r"(?m)^ {2}['\"]?/?((?:@[^/@'\"\s]+/)?[^/@'\":\s]+)[@/]([^:'\"(_\s]+)[^:\n]*:\s*$"
    return _rows(files, F.regexp_extract_all(_section("packages:"), F.lit(line), F.lit(0)), "npm", F.regexp_extract(x, line, 1), F.regexp_extract(x, line, 2))


def composer_lock(files: DataFrame) -> DataFrame:
    entry = "array<struct<name:string,version:string,dist:struct<shasum:string>>>"
    parsed = F.from_json("text", f"packages {entry}, `packages-dev` {entry}")
    none = F.array().cast(entry)
    found = F.concat(F.coalesce(parsed["packages"], none), F.coalesce(parsed["packages-dev"], none))
    return _rows(files, found, "composer", F.col("x.name"), F.col("x.version"), F.col("x.dist.shasum"))


def nuget_lock(files: DataFrame) -> DataFrame:
    """Packages of every target framework; the same package under two frameworks is one row."""
    parsed = F.from_json("text", "dependencies map<string,map<string,struct<resolved:string,contentHash:string>>>")
    found = F.flatten(F.transform(F.map_values(parsed["dependencies"]), F.map_entries))
    return _rows(files, F.array_distinct(found), "nuget", F.col("x.key"), F.col("x.value.resolved"), F.col("x.value.contentHash"))


def pipfile_lock(files: DataFrame) -> DataFrame:
    entry = "map<string,struct<version:string,hashes:array<string>>>"
    parsed = F.from_json("text", f"default {entry}, develop {entry}")
    none = F.array().cast("array<struct<key:string,value:struct<version:string,hashes:array<string>>>>")
    found = F.concat(F.coalesce(F.map_entries(parsed["default"]), none), F.coalesce(F.map_entries(parsed["develop"]), none))
    return _rows(files, found, "pypi", F.col("x.key"), F.regexp_replace("x.value.version", "^==", ""), F.get(F.col("x.value.hashes"), 0))


def go_mod(files: DataFrame) -> DataFrame:
    """Required modules; exclude, replace and retract blocks are left out."""
    x = F.col("x")
    line = r"(?m)^(?:require[ \t]+|[ \t]+)(\S+)[ \t]+(v\S+)"
    text = F.regexp_replace("text", r"(?ms)^(?:exclude|replace|retract)\s*\(.*?^\)", "")
    return _rows(files, F.regexp_extract_all(text, F.lit(line), F.lit(0)), "go", F.regexp_extract(x, line, 1), F.regexp_extract(x, line, 2))


def integrity_ok(content: Column, integrity: Column) -> Column:
    """Whether content has the strongest digest that an integrity string names; null if it names none that is known."""
    parts = F.split(F.trim(integrity), r"\s+")
    out = F.lit(None).cast("boolean")

    def of(kind: str) -> Column:
        return F.filter(parts, lambda p: p.startswith(f"{kind}-"))

    for name, bits in (("sha256", 256), ("sha384", 384), ("sha512", 512)):
        digest = F.concat(F.lit(f"{name}-"), F.translate(F.base64(F.unhex(F.sha2(content, bits))), "\r\n", ""))
        named = of(name)
        out = F.when(F.size(named) > 0, F.array_contains(F.transform(named, lambda p: F.substring_index(p, "?", 1)), digest)).otherwise(out)
    return out


def selectors_overlap(a: Column, b: Column) -> Column:
    """Whether two artifact names with * can mean the same one; what stands between several stars is not compared."""
    wild_a, wild_b = a.contains("*"), b.contains("*")
    head, tail = (lambda c: F.substring_index(c, "*", 1)), (lambda c: F.substring_index(c, "*", -1))
    fits = lambda plain, star: plain.startswith(head(star)) & plain.endswith(tail(star)) & (F.length(plain) >= F.length(head(star)) + F.length(tail(star)))
    both = (head(a).startswith(head(b)) | head(b).startswith(head(a))) & (tail(a).endswith(tail(b)) | tail(b).endswith(tail(a)))
    return F.when(wild_a & wild_b, both).when(wild_a, fits(b, a)).when(wild_b, fits(a, b)).otherwise(a == b)
