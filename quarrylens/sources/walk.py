"""Files below a folder as a data source of its own: walked in parallel, within budgets, with a row for whatever was not entered.

The folders next to the root are partitions, so large trees are many tasks' work;
listing goes through Arrow's file systems (local and mounted folders, HDFS, object
stores). A budget counts the entries of one partition: when it is used up, the rest
of that partition is reported once and the others go on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrylens.sources.tables import EXCLUDED

SCHEMA = "path string, size long, depth int, content binary, problem string"
# Folders within one another, entries of a partition, and bytes of a file that are read.
MAX_DEPTH, MAX_ENTRIES, MAX_BYTES = 20, 100_000, 5 << 20


class _Folder(InputPartition):
    def __init__(self, rel: str):
        self.rel = rel


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"].rstrip("/")
        self.depth, self.entries, self.bytes = (int(options.get(k, d)) for k, d in (("maxdepth", MAX_DEPTH), ("maxentries", MAX_ENTRIES), ("maxbytes", MAX_BYTES)))
        self.excluded = set(options.get("excluded", ",".join(EXCLUDED)).split(","))

    def _list(self, rel: str) -> list:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        found = system.get_file_info(fs.FileSelector(f"{base}/{rel}" if rel else base))
        return sorted(((i.base_name, i.type == fs.FileType.Directory, i.size, i.path, system) for i in found), key=lambda x: x[0])

    def partitions(self) -> list[InputPartition]:
        """The root's own files, and each of its folders."""
        try:
            top = [name for name, folder, *_ in self._list("") if folder and name not in self.excluded]
        except Exception:  # noqa: BLE001  the walk of the root says so in a row
            top = []
        return [_Folder(""), *map(_Folder, top)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        left, used = [(partition.rel, 1 if partition.rel else 0)], 0
        while left:
            rel, depth = left.pop()
            try:
                entries = self._list(rel)
            except Exception as e:  # noqa: BLE001  one folder less, not one job less
                yield rel or ".", None, depth, None, f"unreadable: {type(e).__name__}"
                continue
            for name, folder, size, path, system in entries:
                own = f"{rel}/{name}" if rel else name
                if used >= self.entries:
                    yield rel or ".", None, depth, None, "entry budget used up"
                    return
                used += 1
                if folder:
                    if name in self.excluded:
                        yield own, None, depth, None, "excluded"
                    elif depth >= self.depth:
                        yield own, None, depth, None, "too deep"
                    elif partition.rel:
                        left.append((own, depth + 1))
                elif size > self.bytes:
                    yield own, size, depth, None, "oversized"
                else:
                    try:
                        with system.open_input_stream(path) as f:
                            yield own, size, depth, f.read(), None
                    except Exception as e:  # noqa: BLE001
                        yield own, size, depth, None, f"unreadable: {type(e).__name__}"


class TreeSource(DataSource):
    """format("quarry_tree"): options root, maxDepth, maxEntries, maxBytes, excluded (names by commas)."""

    @classmethod
    def name(cls) -> str:
        return "quarry_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _TreeReader({k.lower(): v for k, v in self.options.items()})


def tree(spark: SparkSession, root: str, **options: str | int) -> DataFrame:
    """SCHEMA rows of all below ``root``: files with their content, and what was not read with a problem. Paths are relative."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("quarry_tree").options(root=root, **options).load()


def coverage(rows: DataFrame) -> DataFrame:
    """Coverage rows (path, state, detail) of a walk; excluded folders are left out on purpose and count for nothing."""
    from pyspark.sql import functions as F

    lost = rows.where("problem IS NOT NULL AND problem <> 'excluded'")
    state = F.when(F.col("problem") == "oversized", "oversized").when(F.col("problem").startswith("unreadable"), "unreadable").otherwise("partial")
    return lost.select("path", state.alias("state"), F.col("problem").alias("detail"))
