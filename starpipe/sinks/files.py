"""Folder metadata calls through Hadoop's FileSystem, which knows every cluster path."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def part_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Names of the written part files in order."""
    fs, target = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return sorted(n for n in names if n.startswith("part-") and n.endswith(suffix))


def rename(spark: SparkSession, folder: str, names: dict[str, str]) -> None:
    jvm = spark.sparkContext._jvm
    fs, _ = _fs(spark, folder)
    for old, new in names.items():
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(folder, old),
                         jvm.org.apache.hadoop.fs.Path(folder, new)):
            raise OSError(f"could not rename {folder}/{old} to {new}")


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder or file; the folders above its new name are made."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs, target = _fs(spark, new)
    fs.mkdirs(target.getParent())
    if not fs.rename(at(old), target):
        raise OSError(f"could not rename {old} to {new}")


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder this library wrote, such as a staging table after its load."""
    fs, target = _fs(spark, folder)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, such as a header."""
    fs, target = _appendable(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def can_join_files(spark: SparkSession, folder: str) -> bool:
    fs, target = _appendable(spark, folder)
    return fs.hasPathCapability(target, "fs.capability.paths.concat")


def join_files(spark: SparkSession, first: str, others: list[str]) -> None:
    """Append the other files to the first, which the file system does by itself.

    A cluster's file system moves their blocks behind it. A local disk copies all of them to a
    new file, which then takes the name of the first.
    """
    fs, to = _appendable(spark, first)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    local = fs.getUri().getScheme() == "file"
    sources = [first, *others] if local else others
    paths = spark.sparkContext._gateway.new_array(at, len(sources))
    for i, source in enumerate(sources):
        paths[i] = at(source)
    fs.concat(at(f"{first}.joined") if local else to, paths)
    if local:
        fs.delete(to, False)
        fs.rename(at(f"{first}.joined"), to)


def _appendable(spark: SparkSession, path: str):
    """The file system below the checksums of a local one, which files cannot be appended to."""
    fs, target = _fs(spark, path)
    local = fs.getUri().getScheme() == "file" and not fs.hasPathCapability(target, "fs.capability.paths.concat")
    return (fs.getRawFileSystem() if local else fs), target


def folder_mib(spark: SparkSession, folder: str) -> float:
    """MiB of all files below a folder; 0 if there is none."""
    fs, target = _fs(spark, folder)
    return round(fs.getContentSummary(target).getLength() / 2**20, 6) if fs.exists(target) else 0.0


def files_mib(spark: SparkSession, folder: str, names: Iterable[str]) -> float:
    """MiB of the named files of a folder."""
    fs, _ = _fs(spark, folder)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return round(sum(fs.getFileStatus(at(folder, n)).getLen() for n in names) / 2**20, 6)


def file_sizes(spark: SparkSession, paths: Iterable[str]) -> dict[str, int]:
    """Bytes of each of the files, from one listing of each of their folders."""
    paths, found = list(paths), {}
    for folder in dict.fromkeys(path.rsplit("/", 1)[0] for path in paths):
        fs, target = _fs(spark, folder)
        found |= {f"{folder}/{s.getPath().getName()}": s.getLen() for s in fs.listStatus(target)}
    return {path: found[path] for path in paths}


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is a file or missing."""
    fs, target = _fs(spark, folder)
    if not fs.exists(target) or not fs.getFileStatus(target).isDirectory():
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target))
