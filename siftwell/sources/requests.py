"""A stream of fetched pages: a folder of request files, read as ``spark.readStream.format("requested_pages")``.

Options: ``path``, a folder that driver and executors see, whose files have one request a line, ``{"page_id": 1, "url": "..."}``; ``fetch``
as for ``web_pages``; ``slices``, how many partitions share the files of a micro-batch (8). A micro-batch has all files that are there.

Offsets are numbers of entries in a ledger below the folder. An entry names the files that were new when it was made, and is
made once, so a batch that is planned again, by the same query or by one that was started again, has the same files,
whatever their names and whenever they came (``ask`` writes such files). Spark tells of batches that are done for good; their files go to
``_done`` then, so no page is fetched again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .web import FIELDS, SCHEMA, fetched, function

LEDGER, DONE = "_ledger", "_done"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def files(system: fs.FileSystem, folder: str) -> list[str]:
    """Names of the files of a folder that are complete, in order; none where there is no folder."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(tuple(names))
        self.names = names


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.fetch = options["path"], options["fetch"]
        self.slices = int(options.get("slices", "8"))

    def entries(self) -> list[int]:
        system, top = place(self.path)
        return [int(n) for n in files(system, f"{top}/{LEDGER}")]

    def entry(self, number: int) -> list[str]:
        system, top = place(self.path)
        with system.open_input_stream(f"{top}/{LEDGER}/{number:012d}") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        """The last entry; a new one is made if there are files that no entry names."""
        system, top = place(self.path)
        numbers = self.entries()
        known = {n for e in numbers for n in self.entry(e)}
        new = [n for n in files(system, top) if n not in known]
        last = max(numbers, default=0)
        if not new:
            return {"entry": last}
        system.create_dir(f"{top}/{LEDGER}")
        draft = f"{top}/{LEDGER}/.{last + 1:012d}"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps(new).encode())
        system.move(draft, f"{top}/{LEDGER}/{last + 1:012d}")
        return {"entry": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = [n for e in self.entries() if start["entry"] < e <= end["entry"] for n in self.entry(e)]
        return [Files(names[i :: self.slices]) for i in range(min(self.slices, len(names)))] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        fetch, (system, top) = function(self.fetch), place(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{top}/{name}") as f:
                lines = f.read().decode("utf-8", "replace").splitlines()
            for line in lines:
                if line.strip():
                    yield row(fetch, line)

    def commit(self, end: dict) -> None:
        """Files of finished entries go; the last finished entry stays, so that numbers go on."""
        system, top = place(self.path)
        system.create_dir(f"{top}/{DONE}")
        there = set(files(system, top))
        for e in self.entries():
            if e <= end["entry"]:
                for name in self.entry(e):
                    if name in there:
                        system.move(f"{top}/{name}", f"{top}/{DONE}/{name}")
                if e < end["entry"]:
                    system.delete_file(f"{top}/{LEDGER}/{e:012d}")


def row(fetch, line: str) -> tuple:
    """A page, or what is wrong with the request."""
    try:
        asked = json.loads(line)
        page_id, url = int(asked["page_id"]), str(asked["url"])
    except (ValueError, KeyError, TypeError) as error:
        return None, line, *(f"malformed request: {error}" if f == "error" else None for f in FIELDS)
    return page_id, url, *fetched(fetch, url)


class RequestedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "requested_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Reader(self.options)


def ask(rows: DataFrame, folder: str) -> None:
    """Puts the requests ``rows(page_id, url)`` into the folder of a stream; a batch of them appears there when all its tasks are done."""
    rows.select("page_id", "url").write.mode("append").json(folder)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RequestedPages)
