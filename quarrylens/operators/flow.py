"""Data flow within files, as rows: statements, blocks, names bound in them, and what a value reaches.

Files are cut into pieces (statements and braces) by expressions on their own rows.
Blocks come from the running depth of braces; a place's blocks are, for each level
up to its depth, the last one opened there. A name means the declaration in the
innermost of these blocks that has one; a use takes the last value that the name
got before, and the last one that a deeper block may have given it since. Values
flow from definition to definition over such uses, until nothing new is reached.
Only files that hold both a source and a sink are cut at all. An object that is
written over several lines counts as a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.operators import contexts, fixpoint

NAME = r"[\p{Alpha}_$][\w$]*"
#: A declaration or assignment of one name: the keyword, the name, the value.
SETS = rf"^\s*(?:export\s+)?(?:(const|let|var)\s+)?({NAME})(?:\s*:[^=]+)?\s*=(?![=>])(.*)$"
#: What opens a function's block, and what opens another one though it ends with a parenthesis.
FUNCTION, NO_FUNCTION = r"\bfunction\b|=>\s*$|\)\s*$", r"\b(?:if|for|while|switch|catch|with)\b\s*\("

#: An object written in one line, whose braces open no block; so many may lie within one another.
OBJECT, OBJECTS = r"((?:[=(,:\[?&|]|\breturn)\s*)\{([^{};]*)\}", 3

NPM_TOKEN = r"\bprocess\.env\.(?:NPM_TOKEN|NODE_AUTH_TOKEN)\b|_authToken\b|\.npmrc\b"
SENDS = r"\b(?:fetch|axios(?:\.\w+)?|got|https?\.request|urlopen|sendBeacon|\w+\.(?:post|put|send))\s*\("
LOCALE = r"\bnavigator\.languages?\b|\bDateTimeFormat\(\)|\bgetTimezoneOffset\(|\bprocess\.env\.(?:LANG|LC_ALL|TZ)\b|\bgeoip\b"
DESTROYS = r"\b(?:rmSync|rmdirSync|unlinkSync|rimraf|truncateSync)\s*\(|\brm\s+-rf\b"
#: A comparison of a value: an operator with a literal, or a search for one.
TELLS_APART = r"[=!]==?\s*(?:[\"'`/]|-?\d)|(?:[\"'`]|\d)\s*[=!]==?|\.(?:includes|startsWith|endsWith|indexOf|test|match)\s*\(|[<>]=?\s*-?\d"


def pieces(files: DataFrame) -> DataFrame:
    """path, line, i, at (characters of the file before), code (without comments), bare (and without what stands in strings), depth, place."""
    each = contexts.lines(files).where("kind = 'c'")
    code, bare = (contexts.code_only(F.col("content"), F.col("entry"), "c", strings) for strings in (True, False))
    for _ in range(OBJECTS):
        bare = F.regexp_replace(bare, OBJECT, "$1($2)")
    lines = each.select("path", "line", F.length("content").alias("n"), code.alias("code"), bare.alias("bare"))
    by_line = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("begin", F.coalesce(F.sum(F.col("n") + 1).over(by_line), F.lit(0)))
    cut = lines.select("path", "line", "begin", "code", F.posexplode(F.regexp_extract_all("bare", F.lit(r"([{}]|[^;{}]+;?|;)"), F.lit(1))).alias("i", "bare"))
    within = Window.partitionBy("path", "line").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("col", F.coalesce(F.sum(F.length("bare")).over(within), F.lit(0)))
    own = F.substring(F.col("code"), F.col("col") + 1, F.length("bare"))
    cut = cut.select("path", "line", "i", (F.col("begin") + F.col("col")).alias("at"), own.alias("code"), "bare")
    step = F.when(F.col("bare") == "{", 1).when(F.col("bare") == "}", -1).otherwise(0)
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)))


def blocks_of(places: DataFrame, opened: DataFrame) -> DataFrame:
    """places with a row for each block around them: level, block (where it opens); level 0 is the file itself, block -1.

    opened: path, level, block. For each level up to the place's depth, the block is
    the last one opened before the place.
    """
    levels = places.withColumn("level", F.explode(F.sequence(F.lit(0), F.greatest(F.col("depth"), F.lit(0)).cast("int"))))
    cols = levels.columns
    both = levels.withColumn("block", F.lit(None).cast("long")).unionByName(opened.select("path", F.col("level").cast("int").alias("level"), "block", F.col("block").alias("at")), allowMissingColumns=True)
    last = F.last("block", ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("at", F.col("block").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("around", F.when(F.col("level") == 0, -1).otherwise(last)).where("block IS NULL").select(*cols, F.col("around").alias("block"))


@dataclass
class Flow:
    """Pieces of the files, the blocks that they open, and which places a source's value reaches."""

    pieces: DataFrame
    opened: DataFrame
    #: path, at, name, origin: uses of a name whose value comes from a source (origin: its place).
    reached: DataFrame


def _used(code: Column) -> Column:
    """Names that are read: not those after a dot, nor keys of objects."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(rf"(?<![\w$.])({NAME})(?!\s*:[^:])"), F.lit(1)))


def flow(files: DataFrame, source: str, sink: str) -> Flow:
    """Where values of ``source`` (a pattern) go in files that also hold ``sink``."""
    able = files.where(F.col("text").rlike(source) & F.col("text").rlike(sink))
    cut = fixpoint.staged(pieces(able), "pieces")
    order = Window.partitionBy("path").orderBy("at")
    before = F.lag("bare").over(order)
    opens = cut.select("*", before.alias("head")).where("bare = '{'")
    opened = fixpoint.staged(opens.select("path", (F.col("depth") + 1).alias("level"), F.col("at").alias("block"), "head"), "blocks")

    value = F.regexp_extract("code", SETS, 3)
    sets = cut.where(F.col("bare").rlike(SETS)).select(
        "path", "at", "depth", (F.regexp_extract("bare", SETS, 1) != "").alias("declares"), F.regexp_extract("bare", SETS, 2).alias("name"),
        _used(F.regexp_extract("bare", SETS, 3)).alias("reads"), value.rlike(source).alias("source"),
    )
    # parameters are declared in their function's block, with a value from outside
    takes = opened.where(F.col("head").rlike(FUNCTION) & ~F.col("head").rlike(NO_FUNCTION))
    listed = F.regexp_extract(F.regexp_replace("head", r"=>\s*$", ""), r"\(([^()]*)\)\s*$", 1)
    params = takes.select("path", F.col("block").alias("at"), F.col("level").alias("depth"), F.lit(True).alias("declares"), F.explode(F.regexp_extract_all(listed, F.lit(rf"(?:^|,)\s*({NAME})"), F.lit(1))).alias("name"), F.array().cast("array<string>").alias("reads"), F.lit(False).alias("source"))
    own = blocks_of(sets.union(params), opened).where("level = greatest(depth, 0)")
    definitions = fixpoint.staged(own.withColumn("id", F.monotonically_increasing_id()), "definitions")
    # a name without any declaration belongs to the file
    declared = definitions.where("declares").groupBy("path", "name", "block").agg(F.min("at").alias("since"))
    bare_names = definitions.where("NOT declares").select("path", "name").distinct().join(declared.select("path", "name").distinct(), ["path", "name"], "left_anti")
    declared = declared.union(bare_names.select("path", "name", F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("since")))

    def bound(uses: DataFrame, key: str) -> DataFrame:
        """uses(path, at, depth, name, key) with home: the block of the declaration that the name means."""
        around = blocks_of(uses, opened).join(declared, ["path", "name", "block"]).where("since <= at")
        return around.groupBy("path", "at", "name", key).agg(F.max_by("block", "level").alias("home"))

    homes = bound(definitions.select("path", "at", "depth", "name", "id"), "id").select("id", "home")
    given = definitions.join(homes, "id").select("path", "name", "home", "at", "id", (F.col("block") == F.col("home")).alias("always"))
    reads = definitions.select("path", "at", "depth", F.explode("reads").alias("name"), F.col("id").alias("reader"))
    uses = cut.where("bare NOT IN ('{', '}')").select("path", "at", "depth", F.explode(_used(F.col("bare"))).alias("name"), F.lit(None).cast("long").alias("reader"))
    met = bound(reads.union(uses), "reader")
    # for each use the last value given for certain, and the last one given in a deeper block since
    both = met.withColumn("id", F.lit(None).cast("long")).withColumn("always", F.lit(None).cast("boolean")).unionByName(given.withColumn("reader", F.lit(None).cast("long")))
    so_far = Window.partitionBy("path", "name", "home").orderBy("at", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    sure = F.last(F.when(F.col("always"), F.struct("at", "id")), ignorenulls=True).over(so_far)
    perhaps = F.last(F.when(~F.col("always"), F.struct("at", "id")), ignorenulls=True).over(so_far)
    seen = both.select("*", sure.alias("sure"), perhaps.alias("perhaps")).where("id IS NULL")
    later = F.when(F.col("sure").isNull() | (F.col("perhaps.at") > F.col("sure.at")), F.col("perhaps.id"))
    values = seen.select("path", "at", "name", "reader", F.explode(F.array_compact(F.array("sure.id", later))).alias("id"))
    values = fixpoint.staged(values, "values")
    edges = values.where("reader IS NOT NULL").select(F.col("id").alias("source"), F.col("reader").alias("target")).distinct()
    seeds = definitions.where("source").select(F.col("id").alias("key"))
    tainted = fixpoint.reached(seeds, fixpoint.staged(edges, "edges"))
    places = definitions.select(F.col("id").alias("origin"), F.col("at").alias("origin_at"))
    reached = values.where("reader IS NULL").join(tainted.withColumnRenamed("key", "id"), "id").join(places, "origin").groupBy("path", "at", "name").agg(F.min("origin_at").alias("origin"))
    return Flow(cut, opened, reached)


def _lines(cut: DataFrame, name: str) -> DataFrame:
    return cut.select("path", F.col("at").alias(name), F.col("line").alias(f"{name}_line"))


def credential_flow(files: DataFrame, source: str = NPM_TOKEN, sink: str = SENDS) -> DataFrame:
    """path, line of the source, sink_line: a credential that reaches the arguments of a call that sends, by names or at once."""
    f = flow(files, source, sink)
    argument = F.regexp_extract("bare", rf"(?:{sink})(.*)$", 1)
    calls = f.pieces.where(F.col("bare").rlike(sink)).select("path", "at", "line", "code", F.explode_outer(_used(argument)).alias("name"))
    by_name = calls.join(f.reached, ["path", "at", "name"]).join(_lines(f.pieces, "origin"), ["path", "origin"]).select("path", F.col("origin_line").alias("line"), F.col("line").alias("sink_line"))
    at_once = calls.where(F.regexp_extract("code", rf"(?:{sink})(.*)$", 1).rlike(source)).select("path", "line", F.col("line").alias("sink_line"))
    return by_name.union(at_once).groupBy("path", "sink_line").agg(F.min("line").alias("line")).select("path", "line", "sink_line")


def gated_destruction(files: DataFrame, source: str = LOCALE, destroys: str = DESTROYS, reach_lines: int = 15, reach: int = 512) -> DataFrame:
    """path, line of the evidence, destroy_line: a block that only some locales enter, with a destructive call in it; the first of a file.

    The condition must compare the value, which stands there itself or came by names;
    the call lies within ``reach_lines`` lines and ``reach`` characters of the evidence.
    """
    f = flow(files, source, destroys)
    order = Window.partitionBy("path").orderBy("at")
    gates = f.pieces.withColumn("body", F.when(F.lead("bare").over(order) == "{", F.lead("at").over(order))).where("body IS NOT NULL")
    gates = gates.where(F.col("bare").rlike(r"\bif\s*\(") & F.col("code").rlike(TELLS_APART))
    named = gates.join(f.reached.select("path", "at", "origin"), ["path", "at"]).select("path", "body", "origin")
    gated = named.union(gates.where(F.col("code").rlike(source)).select("path", "body", F.col("at").alias("origin"))).groupBy("path", "body").agg(F.max("origin").alias("origin"))
    calls = f.pieces.where(F.col("code").rlike(destroys)).select("path", "at", "line", "depth")
    inside = blocks_of(calls, f.opened).join(gated.withColumnRenamed("body", "block"), ["path", "block"])
    near = inside.join(_lines(f.pieces, "origin"), ["path", "origin"]).where((F.col("at") - F.col("origin") <= reach) & (F.col("line") - F.col("origin_line") <= reach_lines))
    return near.groupBy("path").agg(F.min(F.struct("at", "origin_line", "line")).alias("x")).select("path", F.col("x.origin_line").alias("line"), F.col("x.line").alias("destroy_line"))


# Calls that decode base64 in Python.
DECODES = r"\b(?:b64decode|urlsafe_b64decode|standard_b64decode|decodebytes)\s*\("


def decode_then_exec(files: DataFrame) -> DataFrame:
    """path, line of the decoding, exec_line of Python files that run what they decoded.

    A statement goes on over lines while a bracket is open. A name counts as decoded
    from its decoding assignment on; another value ends that, but only at the left
    margin: an indented assignment may never run.
    """
    able = files.where(F.col("path").rlike(r"(?i)\.pyi?$") & F.col("text").rlike(DECODES) & F.col("text").rlike(r"\bexec\s*\("))
    each = contexts.lines(able)
    bare = contexts.code_only(F.col("content"), F.col("entry"), "hash", False)
    lines = each.select("path", "line", (bare.rlike(r"^\s") | (F.col("entry") != "0")).alias("indented"), bare.alias("bare"))
    cut = lines.select("path", "line", "indented", F.posexplode(F.regexp_extract_all(F.concat("bare", F.lit("\n")), F.lit(r"([()\[\]{}]|[;\n]|[^()\[\]{};\n]+)"), F.lit(1))).alias("i", "piece"))
    step = F.when(F.col("piece").isin("(", "[", "{"), 1).when(F.col("piece").isin(")", "]", "}"), -1).otherwise(0)
    order = Window.partitionBy("path").orderBy("line", "i")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    deep = cut.withColumn("depth", F.coalesce(F.sum(step).over(earlier), F.lit(0)))
    ends = F.when(F.col("piece").isin(";", "\n") & (F.col("depth") <= 0), 1).otherwise(0)
    numbered = deep.withColumn("statement", F.coalesce(F.sum(ends).over(earlier), F.lit(0)))
    # a statement is one row; its pieces are those of a few lines
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "i", "piece"))), lambda p: p["piece"]), "")
    whole = numbered.groupBy("path", "statement").agg(F.min(F.struct("line", "i", "indented")).alias("first"), text.alias("text"))
    target, value = F.regexp_extract("text", rf"(?s)^\s*({NAME})(?:\s*:[^=]+)?\s*=(?!=)(.*)$", 1), F.regexp_extract("text", rf"(?s)^\s*({NAME})(?:\s*:[^=]+)?\s*=(?!=)(.*)$", 2)
    kind = F.when(value.rlike(DECODES), "decode").when(~F.col("first.indented"), "other")
    sets = whole.where((target != "") & kind.isNotNull()).select("path", "statement", F.lit(0).alias("use"), target.alias("name"), kind.alias("kind"), F.col("first.line").alias("line"))
    runs = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?<![\w.])exec\s*\(\s*({NAME})\s*[,)]"), F.lit(1)))).alias("name")
    uses = whole.select("path", "statement", F.lit(1).alias("use"), runs, F.lit(None).cast("string").alias("kind"), F.col("first.line").alias("line"))
    w = Window.partitionBy("path", "name").orderBy("statement", "use").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind").isNotNull(), F.struct("kind", "line")), ignorenulls=True).over(w)
    by_name = sets.union(uses).withColumn("last", last).where("use = 1 AND last.kind = 'decode'").select("path", F.col("last.line").alias("line"), F.col("line").alias("exec_line"))
    at_once = whole.where(F.col("text").rlike(rf"(?<![\w.])exec\s*\(\s*(?:\w+\s*\.\s*)*?{DECODES}")).select("path", F.col("first.line").alias("line"), F.col("first.line").alias("exec_line"))
    return by_name.union(at_once).distinct()
