"""Matches of several places of a file that speak of the same thing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.operators.rules import lines

# Names of calls that write a file and of calls that run one.
WRITES = "writeFile|writeFileSync|write_bytes|saveFile"
RUNS = "exec|execSync|execFile|execFileSync|spawn|spawnSync|ShellExecute|CreateProcess|system"

CALL = rf"\b({WRITES}|{RUNS})\s*\((.*)"
NAME = r"[\p{Alpha}_$][\w$]*"
#: A name that gets a value, by = or := and with or without a type; comparisons, arrows and compound operators are none.
ASSIGNED = rf"(?<![\w$.])({NAME})(?: *: *[\w.\[\]|]+)? *:?= *([^=>\s].*)"
PROGRAM = r"([^\s\\/+(\"'`]+\.(?:exe|bat|cmd|ps1))\b"
#: A value in a folder for passing files, or the name of something that can be started.
TEMPORARY = r"(?i)/(?:var/)?tmp/|%(?:local)?appdata%|%te?mp%|env\.te?mp|mkd?s?temp|gettempdir|tempfile\.|tmpdir\(|\.(?:exe|com|scr|bat|cmd|vbs|ps1|dll)['\"` ]"
QUOTED = r"\"[^\"]*\"|'[^']*'"


def write_then_run(files: DataFrame) -> DataFrame:
    """path, line of the write, run_line: a file of a temporary or program path that is written and later run.

    Both calls must name one variable, with no assignment between them and a
    temporary or program path as its value, or one program by its base name. A
    statement ends at its line's end or a semicolon, and its first call counts.
    Lines that are comments are left out. A run meets the last write before it.
    """
    each = lines(files).where(~F.col("content").rlike(r"^\s*(?://|#|\*)")).select("path", "line", F.posexplode(F.split("content", ";")).alias("part", "code"))
    call, inside = F.regexp_extract("code", CALL, 1), F.regexp_extract("code", CALL, 2)
    variable, value = F.regexp_extract("code", ASSIGNED, 1), F.regexp_extract("code", ASSIGNED, 2)
    names = F.regexp_extract_all(F.regexp_replace(inside, QUOTED, " "), F.lit(f"({NAME})"), F.lit(1))
    programs = F.regexp_extract_all(F.lower(inside), F.lit(PROGRAM), F.lit(1))
    keys = F.array_distinct(F.concat(F.transform(names, lambda n: F.concat(F.lit("name:"), n)), F.transform(programs, lambda p: F.concat(F.lit("program:"), p))))
    wrote = call.rlike(rf"^(?:{WRITES})$")

    def event(key, kind, temporary):
        return F.struct(key.alias("key"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), temporary.alias("temporary"))

    uses = F.transform(F.when(call != "", keys).otherwise(F.array().cast("array<string>")), lambda k: event(k, F.when(wrote, "write").otherwise("run"), F.lit(False)))
    sets = F.filter(F.array(event(F.concat(F.lit("name:"), variable), "assign", value.rlike(TEMPORARY))), lambda e: e["key"] != "name:")
    events = each.select("path", "line", "part", F.explode(F.concat(sets, uses)).alias("e")).select("path", "line", "part", "e.*")
    seen = Window.partitionBy("path", "key").orderBy("line", "part", F.col("kind") != "assign")
    origin = F.last(F.when(F.col("kind") == "assign", F.struct("line", "part", "temporary")), ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, 0))
    calls = events.withColumn("origin", origin).where("kind <> 'assign' AND (key LIKE 'program:%' OR origin.temporary)")
    before = Window.partitionBy("path", "key", "origin").orderBy("line", "part").rowsBetween(Window.unboundedPreceding, -1)
    paired = calls.withColumn("written", F.last(F.when(F.col("kind") == "write", F.col("line")), ignorenulls=True).over(before))
    return paired.where("kind = 'run' AND written IS NOT NULL").select("path", F.col("written").alias("line"), F.col("line").alias("run_line")).distinct()
