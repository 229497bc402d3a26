"""A sink of whole files with a commit: attempts write below a folder of their job, and only a finished job gives final names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Moves at once while a job commits.
MOVES = 16


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    names: list[str]


def checked(name: str | None) -> str:
    """A relative name without steps upwards."""
    parts = (name or "").split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..") for p in parts) or parts[0].startswith("_attempt-"):
        raise ValueError(f"no file name: {name!r}")
    return name


class FileWriter(DataSourceWriter):
    """Rows (name, content): content is text or bytes; of rows with one name in a job the last moved one stays."""

    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite, self.job = target.rstrip("/"), overwrite, f"_attempt-{uuid.uuid4().hex}"

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.target)

    def write(self, rows: Iterator) -> Written:
        store, root = self._at()
        attempt = f"{self.job}/{uuid.uuid4().hex}"
        names = []
        try:
            for row in rows:
                name = checked(row[0])
                folder = f"{root}/{attempt}/{name}".rpartition("/")[0]
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{root}/{attempt}/{name}") as out:
                    out.write(row[1].encode() if isinstance(row[1], str) else bytes(row[1] or b""))
                names.append(name)
        except BaseException:
            self._drop(attempt)
            raise
        return Written(attempt, names)

    def _drop(self, attempt: str) -> None:
        from pyarrow import fs

        store, root = self._at()
        if store.get_file_info(f"{root}/{attempt}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{attempt}")

    def commit(self, messages: list) -> None:
        """Gives the files their final names; a file of a name that exists is replaced if the job overwrites, else an error before any move."""
        from pyarrow import fs

        store, root = self._at()
        done = [m for m in messages if m]
        moves = list({name: f"{m.attempt}/{name}" for m in done for name in m.names}.items())
        with ThreadPoolExecutor(MOVES) as pool:
            if not self.overwrite:
                taken = [name for (name, _), info in zip(moves, pool.map(store.get_file_info, [f"{root}/{n}" for n, _ in moves])) if info.type != fs.FileType.NotFound]
                if taken:
                    self.abort(messages)
                    raise FileExistsError(f"{len(taken)} files exist, such as {taken[0]}")

            def move(pair: tuple[str, str]) -> None:
                if "/" in pair[0]:
                    store.create_dir(f"{root}/{pair[0]}".rpartition("/")[0], recursive=True)
                store.move(f"{root}/{pair[1]}", f"{root}/{pair[0]}")

            list(pool.map(move, moves))
        self._drop(self.job)

    def abort(self, messages: list) -> None:
        """Nothing of the job stays. What a task writes that is still running then goes with drop_attempts()."""
        self._drop(self.job)


class FileSink(DataSource):
    """df.write.format("description_files").save(uri): columns name and content."""

    @classmethod
    def name(cls) -> str:
        return "description_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if len(schema.fields) != 2:
            raise ValueError("columns: name, content")
        return FileWriter(self.options["path"], overwrite)


def drop_attempts(target: str) -> int:
    """Deletes what attempts of dead jobs have left; only for a target to which no job writes. Gives their number."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(target.rstrip("/"))
    left = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("_attempt-")]
    for f in left:
        store.delete_dir(f.path)
    return len(left)
