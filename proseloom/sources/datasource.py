"""Spark data sources of whole documents and of JSON reports.

``spark.dataSource.register(ProseSource)``, then ``spark.read.format("prose").load(path)`` gives a row a file: doc_id (its
path below the folder), text (without a byte-order mark), size. Files are dealt to reader partitions by size
(option ``bytes``), so thousands of small files are few tasks and a large one is a task of its own. With the option
``manifest``, exactly the labelled cases are read and their labels come as columns; a case without a file raises before
anything is read. Paths may be local or URIs that pyarrow's file systems know; the driver lists, tasks read.

``df.write.format("prose-reports").mode("append").save(path)`` writes the column ``json`` as files of lines. A task
writes under ``_attempt-...``; the driver moves what committed tasks reported and nothing else, so a task that is lost
and run again leaves no line twice. ``_reports.json`` lists the files of each job; overwriting removes files listed there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

BYTES_A_PARTITION = 32 << 20
FILES_A_PARTITION = 5_000
DOCUMENT = "doc_id string, text string, size long"
CASE = "position int, band string, rules array<string>, known_gap string, note string, known_false_positives array<string>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def cases_of(text: str) -> list[dict]:
    """The labelled cases of a manifest; one without cases, or a case without a file, raises. A missing band is Clean."""
    cases = json.loads(text).get("cases") or []
    if not cases or not all(c.get("file") for c in cases):
        raise ValueError("a manifest needs cases, and each a file")
    return [
        {"file": c["file"], "position": i, "band": c.get("band") or "Clean", "rules": c.get("rules") or [], "known_gap": c.get("knownGap"), "note": c.get("note"), "known_false_positives": c.get("knownFalsePositives")}
        for i, c in enumerate(cases)
    ]


@dataclass
class Files(InputPartition):
    """Files of one task: path below the folder, size, and the case if there is a manifest."""

    files: list[tuple[str, int, dict | None]]


def dealt(files: list[tuple[str, int, dict | None]], most: int) -> list[Files]:
    """Files in order of size, largest first, cut where a partition is full."""
    out, held, some = [], 0, []
    for f in sorted(files, key=lambda f: (-f[1], f[0], f[2] and f[2]["position"])):
        if some and (held + f[1] > most or len(some) >= FILES_A_PARTITION):
            out.append(Files(some))
            held, some = 0, []
        some.append(f)
        held += f[1]
    return [*out, Files(some)] if some else out


class ProseReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.manifest, self.most = options["path"].rstrip("/"), options.get("manifest"), int(options.get("bytes", BYTES_A_PARTITION))
        self.schema = schema

    def partitions(self) -> list[Files]:
        system, root = opened(self.path)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            name = info.path[len(root) :].lstrip("/")
            if info.is_file and not any(part.startswith(("_", ".")) for part in name.split("/")):
                found[name] = info.size
        if self.manifest is None:
            return dealt([(n, s, None) for n, s in found.items()], self.most)
        listing, at = opened(self.manifest)
        with listing.open_input_stream(at) as stream:
            cases = cases_of(stream.read().decode("utf-8-sig"))
        missing = sorted({c["file"] for c in cases} - found.keys())
        if missing:
            raise ValueError(f"no document for the case {missing[0]}")
        return dealt([(c["file"], found[c["file"]], c) for c in cases], self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        names, held, rows = self.schema.fieldNames(), 0, []
        kinds = pa.schema([(n, {"size": pa.int64(), "position": pa.int32(), "rules": pa.list_(pa.string()), "known_false_positives": pa.list_(pa.string())}.get(n, pa.string())) for n in names])
        for name, size, case in partition.files:
            with system.open_input_stream(f"{root}/{name}") as stream:
                text = stream.read().decode("utf-8-sig", "replace")
            row = {"doc_id": name, "text": text, "size": size} | (case or {})
            rows.append({n: row.get(n) for n in names})
            held += size
            if held > 4 << 20 or len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                held, rows = 0, []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


class ProseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prose"

    def schema(self) -> str:
        return f"{DOCUMENT}, {CASE}" if "manifest" in self.options else DOCUMENT

    def reader(self, schema: StructType) -> ProseReader:
        return ProseReader(dict(self.options), schema)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    lines: int


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _attempts(self, root: str) -> str:
        return f"{root}/_attempt-{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = opened(self.path)
        first = next(rows, None)
        if first is None:
            return Written(None, 0)
        name, lines = f"reports-{self.job[:8]}-{uuid.uuid4().hex}.json", 1
        system.create_dir(self._attempts(root), recursive=True)
        with system.open_output_stream(f"{self._attempts(root)}/{name}") as out:
            out.write((first["json"] + "\n").encode())
            for row in rows:
                out.write((row["json"] + "\n").encode())
                lines += 1
        return Written(name, lines)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        files = [{"file": m.file, "lines": m.lines} for m in messages if m is not None and m.file]
        before, listing = [], f"{root}/_reports.json"
        if system.get_file_info(listing).is_file:
            with system.open_input_stream(listing) as stream:
                before = json.loads(stream.read())
        for f in files:
            system.move(f"{self._attempts(root)}/{f['file']}", f"{root}/{f['file']}")
        with system.open_output_stream(listing) as out:
            out.write(json.dumps(files if self.overwrite else before + files).encode())
        if self.overwrite:
            for f in before:
                system.delete_file(f"{root}/{f['file']}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What is left of attempts goes."""
        system, root = opened(self.path)
        if system.get_file_info(self._attempts(root)).type == fs.FileType.Directory:
            system.delete_dir(self._attempts(root))


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prose-reports"

    def schema(self) -> str:
        return "json string"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        if "json" not in schema.fieldNames():
            raise ValueError("reports need the column json")
        return ReportWriter(self.options["path"], overwrite)
