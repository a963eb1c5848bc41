"""Numbered versions of a stored table or index, by a pointer that any session
reads.

A version is a file `<base>/<name>.versions/v<number>` with the folder it points
to. `commit` creates the file of the next number exclusively: of two publishers
at once one gets it, the other takes the number after, and the pointer always
names a whole version. Folders are not dropped when they are replaced but when
they are `keep` versions old, so that a reader of the version before finishes.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Versions that stay readable, the current one included.
KEEP = 2
_WIDTH = 12


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _folder(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.versions"


def versions(spark: SparkSession, base: str, name: str) -> list[tuple[int, str]]:
    """(number, folder) of all committed versions, oldest first."""
    at, fs = _fs(spark, _folder(base, name))
    if not fs.exists(at):
        return []
    found = []
    for status in fs.listStatus(at):
        name_of = status.getPath().getName()
        if name_of.startswith("v") and name_of[1:].isdigit():
            path = _read(spark, fs, status.getPath())
            if path:
                found.append((int(name_of[1:]), path))
    return sorted(found)


def _read(spark: SparkSession, fs, at) -> str | None:
    """The folder a version names; None while its publisher still writes it."""
    stream = fs.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return text[:-1] if text.endswith("\n") else None


def current(spark: SparkSession, base: str, name: str) -> tuple[int, str] | None:
    """(number, folder) of the version that readers use."""
    found = versions(spark, base, name)
    return found[-1] if found else None


def commit(
    spark: SparkSession, base: str, name: str, path: str, keep: int = KEEP, after: int | None = None, folders: bool = True
) -> int:
    """Make `path` the next version and return its number. With `after`, only if
    that number is still the current one (0: none); else RuntimeError.

    Old versions are dropped once `keep` newer ones exist: their folder first, if
    versions are `folders` and not other texts of one line."""
    number = (current(spark, base, name) or (0, ""))[0] + 1
    if after is not None and number != after + 1:
        raise RuntimeError(f"version {after} of {name} is no longer the current one")
    while not _create(spark, f"{_folder(base, name)}/v{number:0{_WIDTH}d}", path):
        if after is not None:
            raise RuntimeError(f"version {number} of {name} was published meanwhile")
        number += 1
    for old, folder in versions(spark, base, name):
        if old <= number - keep:
            if folders:
                drop(spark, folder)
            drop(spark, f"{_folder(base, name)}/v{old:0{_WIDTH}d}")
    return number


def _create(spark: SparkSession, file: str, text: str) -> bool:
    """Write a new file; False if there is one."""
    at, fs = _fs(spark, file)
    fs.mkdirs(at.getParent())
    try:
        local = fs.getScheme() == "file"
        if local:
            # Hadoop looks and then creates on local disks: take the name first
            java = spark._jvm.java.nio.file
            none = spark._sc._gateway.new_array(java.attribute.FileAttribute, 0)
            java.Files.createFile(java.Paths.get(at.toUri().getPath(), spark._sc._gateway.new_array(spark._jvm.String, 0)), none)
        stream = fs.create(at, local)
    except Exception:
        if fs.exists(at):
            return False
        raise
    try:
        stream.write(bytearray(f"{text}\n", "utf-8"))
    finally:
        stream.close()
    return True


def drop(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)
