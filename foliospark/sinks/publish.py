"""Publishing in two phases.

Tasks write every file under a staging folder with a name of the attempt's own; the
commit on the driver moves what the successful attempts report into place, keeps what it
replaces until all is moved, and puts it back if a move fails. Paths go through the
local or mounted file system that driver and executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "publications"


class PublishError(OSError):
    """An output that is in the way, or a folder that leads elsewhere."""


def reject_links(path: str) -> None:
    """No folder on the way to an output may be a symbolic link."""
    at = os.path.abspath(path)
    while at != os.path.dirname(at):
        if os.path.islink(at):
            raise PublishError(f"{at} is a symbolic link")
        at = os.path.dirname(at)


def publish(moves: list[tuple[str, str]], backup: str) -> None:
    """Moves (staged, final) pairs into place, or none of them."""
    done: list[tuple[str, str | None]] = []
    try:
        for i, (staged, final) in enumerate(moves):
            os.makedirs(os.path.dirname(final), exist_ok=True)
            kept = None
            if os.path.lexists(final):
                os.makedirs(backup, exist_ok=True)
                os.replace(final, kept := os.path.join(backup, str(i)))
            done.append((final, kept))
            os.replace(staged, final)
    except BaseException:
        for final, kept in reversed(done):
            if os.path.lexists(final):
                os.remove(final)
            if kept:
                os.replace(kept, final)
        raise
    shutil.rmtree(backup, ignore_errors=True)


@dataclass
class _Written(WriterCommitMessage):
    moves: list


class _Writer(DataSourceWriter):
    def __init__(self, root: str, force: bool):
        self.root, self.force = os.path.abspath(root), force
        self.stage = os.path.join(os.path.dirname(self.root), f".{os.path.basename(self.root)}-{uuid.uuid4().hex}")

    def write(self, iterator):
        moves, own = [], os.path.join(self.stage, uuid.uuid4().hex)
        for i, row in enumerate(iterator):
            final = os.path.normpath(os.path.join(self.root, row["path"]))
            if not final.startswith(self.root + os.sep):
                raise PublishError(f"{row['path']} leads out of the output folder")
            reject_links(os.path.dirname(final))
            if os.path.lexists(final) and not self.force:
                raise PublishError(f"{final} exists")
            os.makedirs(own, exist_ok=True)
            staged = os.path.join(own, str(i))
            with open(staged, "xb") as f:
                f.write(row["content"])
            os.chmod(staged, 0o644)
            moves.append((staged, final))
        return _Written(moves)

    def commit(self, messages):
        moves = [m for x in messages if x for m in x.moves]
        finals = [f for _, f in moves]
        try:
            if len(set(finals)) < len(finals):
                raise PublishError("two outputs have one name")
            publish(moves, os.path.join(self.stage, "backup"))
        finally:
            shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.stage, ignore_errors=True)


class PublicationSource(DataSource):
    """Writes rows (path, content) as files below a folder: df.write.format("publications").option("root", ...).mode("append").save()."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "path string, content binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options["root"], overwrite or self.options.get("force", "false") == "true")


def write_files(files: DataFrame, root: str, force: bool = False) -> None:
    """files (path, content) below root, all or none."""
    files.sparkSession.dataSource.register(PublicationSource)
    files.select("path", "content").write.format(FORMAT).option("root", root).option("force", str(force).lower()).mode("append").save()
