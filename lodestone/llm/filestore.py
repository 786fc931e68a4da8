"""Byte files in the shared folder, written and range-read by executors."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a URI; s3a is s3 under another name."""
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Rolling:
    """Writes byte runs to numbered files of about ``most`` bytes each. Names carry the
    task attempt: the rows a task returns name the files of the attempt that counted,
    and files of lost attempts are never read."""

    def __init__(self, folder: str, suffix: str, most: int, footer: bytes = b""):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.fs, self.folder = opened(folder)
        self.uri, self.suffix, self.most, self.footer = folder, suffix, most, footer
        self.stem = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        self.out, self.n, self.at, self.name = None, 0, 0, ""

    def put(self, *runs: bytes) -> tuple[str, int]:
        """Append the runs to one file; (its URI, where they begin)."""
        if self.out is not None and self.at >= self.most:
            self.close()
        if self.out is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.name = f"{self.stem}-{self.n:05d}{self.suffix}"
            self.out, self.at = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0
            self.n += 1
        begin = self.at
        for run in runs:
            self.out.write(run)
            self.at += len(run)
        return f"{self.uri}/{self.name}", begin

    def close(self) -> None:
        if self.out is not None:
            self.out.write(self.footer)
            self.out.close()
            self.out = None
