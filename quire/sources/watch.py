"""Changes of a folder of notes as a stream: a Python data source that compares listings.

An offset names a snapshot, the listing of all files at one time, kept as a file in the ``state`` folder; a batch is the
difference between two snapshots: files that came, changed or went. So a file that is removed is an event like any other,
which file streams of Spark don't have, and a restart from the checkpoint goes on where the last batch ended, whatever
happened in between. A path that changes several times between two triggers is one event, with what it holds then.

The driver lists the folder and keeps path, size and time of each file, as file streams do; the files are read by tasks.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quire.plans.workers import reach

SCHEMA = "path string, op string, seq long, content string"
#: Files that one task reads, unless the option ``files`` says otherwise.
FILES = 500


@dataclass
class _Files(InputPartition):
    seq: int
    events: list[tuple[str, str]]


def _listing(store: fs.FileSystem, base: str, suffix: str, ignore: Sequence[str]) -> dict[str, list]:
    """path below base -> [size, time]."""
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    own = {f.path[len(base) :].lstrip("/"): [f.size, f.mtime_ns] for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)}
    return {p: v for p, v in own.items() if not any(re.search(x, p) for x in ignore)}


def differences(before: dict[str, list], after: dict[str, list]) -> list[tuple[str, str]]:
    """(path, op), in order of paths."""
    op = lambda p: "add" if p not in before else "delete" if p not in after else "change"
    return [(p, op(p)) for p in sorted(before.keys() | after.keys()) if before.get(p) != after.get(p)]


class _Snapshots:
    """Numbered listings in a folder; number 0 is the empty one."""

    def __init__(self, folder: str):
        self.store, self.base = fs.FileSystem.from_uri(folder)

    def numbers(self) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(r"(\d+)\.json\.gz", f.base_name)))

    def read(self, number: int) -> dict[str, list]:
        if not number:
            return {}
        with self.store.open_input_stream(f"{self.base}/{number}.json.gz", compression=None) as f:
            return json.loads(gzip.decompress(f.read()))

    def write(self, number: int, listing: dict[str, list]) -> None:
        """Under another name first, so that a number names a whole listing or nothing."""
        self.store.create_dir(self.base, recursive=True)
        temporary = f"{self.base}/{uuid.uuid4().hex}.tmp"
        with self.store.open_output_stream(temporary, compression=None) as f:
            f.write(gzip.compress(json.dumps(listing).encode()))
        self.store.move(temporary, f"{self.base}/{number}.json.gz")

    def drop_before(self, number: int) -> None:
        for n in self.numbers():
            if n < number:
                self.store.delete_file(f"{self.base}/{n}.json.gz")


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.files = options["path"], int(options.get("files", FILES))
        self.suffix, self.ignore = options.get("suffix", ".md"), json.loads(options.get("ignore", "[]"))
        self.state, self.existing = options["state"], options.get("existing", "true") == "true"

    def _now(self) -> dict[str, list]:
        return _listing(*fs.FileSystem.from_uri(self.folder), self.suffix, self.ignore)

    def initialOffset(self) -> dict:
        if self.existing:
            return {"snapshot": 0}
        own = _Snapshots(self.state)
        number = max(own.numbers(), default=0) + 1
        own.write(number, self._now())
        return {"snapshot": number}

    def latestOffset(self) -> dict:
        own = _Snapshots(self.state)
        last, now = max(own.numbers(), default=0), self._now()
        if own.read(last) != now:
            last += 1
            own.write(last, now)
        return {"snapshot": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        own = _Snapshots(self.state)
        events = differences(own.read(start["snapshot"]), own.read(end["snapshot"]))
        return [_Files(end["snapshot"], events[i : i + self.files]) for i in range(0, len(events), self.files)]

    def commit(self, end: dict) -> None:
        _Snapshots(self.state).drop_before(end["snapshot"])

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, base = fs.FileSystem.from_uri(self.folder)
        for path, op in partition.events:
            content = None
            if op != "delete":
                try:
                    with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                        content = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    continue  # gone meanwhile, as the next listing will say
            yield path, op, partition.seq, content


class NoteChanges(DataSource):
    """Options: path and state (URIs of folders), suffix, ignore (a JSON list of patterns), files (a task), existing (whether files that are there at first are events)."""

    @classmethod
    def name(cls) -> str:
        return "note_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def watch(spark: SparkSession, folder: str, state: str, suffix: str = ".md", ignore: Sequence[str] = (), existing: bool = True, files: int = FILES) -> DataFrame:
    """A stream of (path, op, seq, content) of the files below folder; op: add, change or delete; seq: the number of the listing.

    state: a folder of its own for each stream, kept as long as its checkpoint; ignore: regular expressions of paths.
    """
    reach(spark)
    spark.dataSource.register(NoteChanges)
    options = {"path": folder, "state": state, "suffix": suffix, "ignore": json.dumps(list(ignore)), "files": str(files), "existing": str(existing).lower()}
    return spark.readStream.format("note_changes").options(**options).load()
