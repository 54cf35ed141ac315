"""Source archives as files rows: a Python table function that SQL calls laterally, one archive at a time.

``expand_archive(archive, max_bytes, max_files, max_archive)`` gives one status row for each archive (``path`` is
null) and one row for each admitted file. An archive is read as a stream, twice: the first pass unpacks it to its
end without keeping anything but the names of admitted files, so that an archive that turns out broken or over-long
gives no file at all; the second gives the files. Contents of other members are passed over and never decoded.

Statuses: ``ok``, ``missing`` (null), ``not_gzip``, ``broken`` (the packed stream ends early or is damaged) and
``too_large`` (it unpacks to more than ``max_archive`` bytes). A tar that ends within a member is ``ok`` with the
members before it. Where a path occurs twice, the later contents stand in the earlier place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from plumbline import fixed_values as fv
from plumbline.functions.paths import classify_file
from plumbline.session import stage

BLOCK = 512
CHUNK = 1 << 20
OK = "ok"


class _Unpacked:
    """The unpacked bytes of a gzip stream, some at a time; raises ValueError with a status."""

    def __init__(self, data: bytes, limit: int):
        self.rest, self.left, self.ready = data, limit, b""
        if data[:2] != b"\x1f\x8b":
            raise ValueError("not_gzip")
        self.unpack = zlib.decompressobj(31)

    def _more(self) -> bool:
        while not self.ready:
            if self.unpack.eof:
                self.rest = self.unpack.unused_data
                if self.rest[:2] != b"\x1f\x8b":
                    return False
                self.unpack = zlib.decompressobj(31)
            try:
                self.ready = self.unpack.decompress(self.rest, CHUNK)
            except zlib.error:
                raise ValueError("broken") from None
            self.rest = self.unpack.unconsumed_tail
            if not self.ready and not self.rest and not self.unpack.eof:
                raise ValueError("broken")
            self.left -= len(self.ready)
            if self.left < 0:
                raise ValueError("too_large")
        return True

    def take(self, size: int, keep: bool) -> tuple[int, bytes]:
        """How many of the next bytes there are, and the bytes themselves if they are to be kept."""
        parts, got = [], 0
        while got < size and self._more():
            part, self.ready = self.ready[:size - got], self.ready[size - got:]
            got += len(part)
            if keep:
                parts.append(part)
        return got, b"".join(parts)

    def to_end(self) -> None:
        while self._more():
            self.ready = b""


def _text(field: bytes) -> str:
    return field.split(b"\0", 1)[0].decode("utf-8", "replace")


def _number(field: bytes) -> int:
    if field[0] & 0x80:
        return int.from_bytes(field[1:], "big")
    digits = _text(field).strip()
    try:
        return int(digits or "0", 8)
    except ValueError:
        return 0


def _long_path(records: bytes) -> str | None:
    """The path of an extended header: records of ``<length> <key>=<value>\\n``, lengths in bytes."""
    while records:
        length, space, _ = records.partition(b" ")
        if not space or not length.isdigit() or not 0 < int(length) <= len(records):
            return None
        key, equals, value = records[len(length) + 1:int(length)].removesuffix(b"\n").partition(b"=")
        if equals and key == b"path":
            return value.decode("utf-8", "replace")
        records = records[int(length):]
    return None


def members(source: _Unpacked, wanted) -> Iterator[tuple[str, bytes]]:
    """Regular files in archive order; contents only where ``wanted(name, size)``, and nothing of the others."""
    path = long_name = None
    while True:
        got, header = source.take(BLOCK, True)
        if got < BLOCK or header[0] == 0:
            return
        size, kind = _number(header[124:136]), header[156:157]
        padding = -size % BLOCK
        if kind in (b"L", b"x"):
            got, data = source.take(size, True)
            if got < size:
                return
            # An extended header goes before a long name.
            if kind == b"L":
                long_name = _text(data)
            else:
                path = _long_path(data)
        else:
            prefix, name = _text(header[345:500]), _text(header[:100])
            name = path if path is not None else long_name if long_name is not None else f"{prefix}/{name}" if prefix else name
            path = long_name = None
            keep = kind in (b"0", b"\0") and wanted(name, size)
            got, data = source.take(size, keep)
            if got < size:
                return
            if keep:
                yield name, data
        source.take(padding, False)


def repo_path(name: str) -> str | None:
    """The path below the wrapper folder if the scanner reads such files, else None."""
    _, slash, path = name.partition("/")
    path = path.replace("\\", "/").removeprefix("./")
    base = path.rpartition("/")[2]
    dot = base.rfind(".")
    known = dot > 0 and (base[dot:] in fv.CODE_EXTENSIONS or base[dot:] == fv.SQL_EXTENSION)
    return path if slash and known and not set(path.split("/")) & set(fv.IGNORED_NAMES) else None


class ExpandArchive:
    """One archive: its status row, then the files that are admitted."""

    def eval(self, archive: bytes, max_bytes: int, max_files: int, max_archive: int):
        places: dict[str, tuple[int, int]] = {}  # path to (first place, last place)
        admitted, more = 0, False

        def first(name: str, size: int) -> bool:
            nonlocal admitted, more
            path = repo_path(name) if size <= max_bytes else None
            if path is not None and admitted == max_files:
                more = True
            elif path is not None:
                return True
            return False

        try:
            if archive is None:
                raise ValueError("missing")
            source = _Unpacked(archive, max_archive)
            for name, _ in members(source, first):
                path = repo_path(name)
                places[path] = (places.get(path, (admitted,))[0], admitted)
                admitted += 1
            source.to_end()
        except ValueError as error:
            yield None, None, None, str(error), False
            return
        yield None, None, None, OK, more
        place, last = 0, {at: (seq, path) for path, (seq, at) in places.items()}

        def second(name: str, size: int) -> bool:
            return place < admitted and size <= max_bytes and repo_path(name) is not None

        for _, data in members(_Unpacked(archive, max_archive), second):
            if place in last:
                seq, path = last[place]
                yield seq, path, data.decode("utf-8", "replace"), OK, more
            place += 1


ROW = "file_seq bigint, path string, content string, status string, truncated boolean"


def register(spark: SparkSession) -> None:
    """Make ``expand_archive`` known to SQL. Rows are pickled a hundred at a time: an Arrow batch holds ten thousand."""
    spark.udtf.register("expand_archive", udtf(ExpandArchive, returnType=ROW, useArrow=False))


def unpack_archives(
    archives: DataFrame, max_bytes: int = fv.MAX_FILE_BYTES, max_files: int = fv.MAX_PROJECT_FILES,
    max_archive: int = fv.MAX_ARCHIVE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``archives(project_id, archive)`` → admitted files with ``kind`` and ``truncated``, and a status for each archive.

    The rows are staged, so an archive is unpacked by one call however often the results are used. What Python
    holds is a hundred archives and the files of one.
    """
    spark = archives.sparkSession
    register(spark)
    rows = stage(spark.sql(
        "SELECT a.project_id, f.* FROM {archives} a, LATERAL expand_archive(a.archive, {max_bytes}, {max_files}, {max_archive}) f",
        archives=archives, max_bytes=max_bytes, max_files=max_files, max_archive=max_archive))
    files = rows.filter("path IS NOT NULL").withColumn("kind", classify_file(F.col("path"))).drop("status")
    return files, rows.filter("path IS NULL").select("project_id", "status", "truncated")


def expand_archives(archives: DataFrame, **limits: int) -> DataFrame:
    """Scannable files of the archives with ``truncated``; bad archives yield no rows."""
    return unpack_archives(archives, **limits)[0]


def failed_archives(statuses: DataFrame) -> DataFrame:
    """(project_id, reason) of archives that could not be read: their check ends neutral."""
    return statuses.filter(F.col("status") != OK).select("project_id", F.col("status").alias("reason"))
