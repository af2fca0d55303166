"""Files of a store from within tasks, through Arrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle

#: What a folder holds: the place of each file and folder in the whole tree; a folder has no size.
ENTRIES = "name string, folder boolean, size long, updated timestamp"
_BATCH = 10_000
#: Bytes of contents in a batch, but for its last file's.
_HELD = 1 << 22
#: What java.net.URI escapes in a path.
_ESCAPED = re.compile(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]')


def open_store(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a folder is in, and the folder's place there."""
    if "://" not in root or root.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", root)
    return pafs.FileSystem.from_uri(root)


def has_folder(root: str) -> bool:
    """Whether Arrow can open this store and finds the folder there."""
    try:
        store, at = open_store(root)
        return store.get_file_info(at.rstrip("/") or "/").type == pafs.FileType.Directory
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):  # a store that Arrow doesn't know
        return False


def hidden(name: str) -> bool:
    """Whether Spark's own readers leave a file or folder of this name out."""
    return name[0] == "." or (name[0] == "_" and "=" not in name) or name.endswith("._COPYING_")


def reader(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over batches of files' places in a tree and their paths: each file's path, escaped as Spark's _metadata.file_path is, and content.
    Few contents are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(root.rstrip("/"))
        paths, contents, held = [], [], 0

        def full() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
            paths.clear()
            contents.clear()
            return batch

        for batch in batches:
            for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{at}/{name}") as stream:
                    paths.append(_ESCAPED.sub(lambda c: quote(c[0], safe=""), path))
                    contents.append(stream.read())
                held += len(contents[-1])
                if held >= _HELD or len(paths) == _BATCH:
                    yield full()
                    held = 0
        yield full()

    return run


def lister(root: str, prefix: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over batches of folders' places in a tree ("" for its root, others ending in a slash): what each holds, without hidden names and
    without what can't be or hold a file whose place begins with prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(root.rstrip("/"))
        for folder in (x for batch in batches for x in batch.column(0).to_pylist()):
            names, folders, sizes, times = [], [], [], []

            def full() -> pa.RecordBatch:
                columns = [pa.array(names, pa.string()), pa.array(folders, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", "UTC"))]
                for x in (names, folders, sizes, times):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names=["name", "folder", "size", "updated"])

            for f in store.get_file_info(pafs.FileSelector(f"{at}/{folder}", allow_not_found=True)):
                name, inner = folder + f.base_name, f.type == pafs.FileType.Directory
                wanted = name.startswith(prefix) or (inner and (f"{name}/".startswith(prefix) or prefix.startswith(f"{name}/")))
                if hidden(f.base_name) or not wanted:
                    continue
                names.append(name)
                folders.append(inner)
                sizes.append(None if inner else f.size)
                times.append(None if inner or f.mtime_ns is None else f.mtime_ns // 1_000_000 * 1000)  # whole milliseconds, as Spark has
                if len(names) == _BATCH:
                    yield full()
            yield full()

    return run


# The functions of this module go to the workers by value, so that a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
