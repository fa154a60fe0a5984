"""Files that tasks and the driver reach by path or URI."""

import os
import pickle
import posixpath

import pyarrow as pa
from pyarrow import fs


def filesystem_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def file_size(path: str) -> int | None:
    """Bytes of a file; None where there is none."""
    filesystem, p = filesystem_of(path)
    info = filesystem.get_file_info(p)
    return info.size if info.is_file else None


def read_range(path: str, start: int, length: int) -> bytes:
    filesystem, p = filesystem_of(path)
    with filesystem.open_input_file(p) as f:
        return f.read_at(length, start)


def write_file(path: str, content: bytes) -> None:
    filesystem, p = filesystem_of(path)
    filesystem.create_dir(posixpath.dirname(p), recursive=True)
    # a name that ends in .gz would have it compressed
    with filesystem.open_output_stream(p, compression=None) as f:
        f.write(content)


def make_folder(path: str) -> None:
    filesystem, p = filesystem_of(path)
    filesystem.create_dir(p, recursive=True)


def remove_folder(path: str, tries: int = 5) -> None:
    """Remove a folder, if it is there. A file that a stopping task writes meanwhile goes as well."""
    filesystem, p = filesystem_of(path)
    for left in range(tries - 1, -1, -1):
        if filesystem.get_file_info(p).type.name != "Directory":
            return
        try:
            filesystem.delete_dir(p)
        except OSError:
            if not left:
                raise


def files_in(path: str) -> list[str]:
    """The file a path names, or the files of a folder by name; those that begin with ``_`` or ``.`` are not data."""
    filesystem, p = filesystem_of(path)
    info = filesystem.get_file_info(p)
    if info.is_file:
        return [path]
    found = sorted(f.base_name for f in filesystem.get_file_info(fs.FileSelector(p, allow_not_found=True)) if f.is_file)
    return [f"{path.rstrip('/')}/{name}" for name in found if name[0] not in "_."]


def write_arrow(path: str, table: pa.Table) -> None:
    """A table as one Arrow file of one batch, so that a reader's arrays are the file's own bytes."""
    filesystem, p = filesystem_of(path)
    filesystem.create_dir(posixpath.dirname(p), recursive=True)
    with filesystem.open_output_stream(p, compression=None) as f, pa.ipc.new_file(f, table.schema) as out:
        out.write_table(table.combine_chunks(), max_chunksize=max(1, len(table)))


def read_arrow(path: str) -> tuple[pa.Table, bool]:
    """The table of an Arrow file, and whether it is mapped: its pages are then the system's to keep or drop."""
    filesystem, p = filesystem_of(path)
    mapped = isinstance(filesystem, fs.LocalFileSystem)
    source = pa.memory_map(p) if mapped else filesystem.open_input_file(p)
    return pa.ipc.open_file(source).read_all(), mapped


def write_pickled(path: str, value) -> None:
    """A value as a file whose arrays lie apart, so that a reader's arrays are the file's own bytes."""
    filesystem, p = filesystem_of(path)
    filesystem.create_dir(posixpath.dirname(p), recursive=True)
    arrays, places, at = [], [], 0
    head = pickle.dumps(value, protocol=5, buffer_callback=arrays.append)
    with filesystem.open_output_stream(p, compression=None) as f:
        for a in arrays:
            raw = a.raw()
            places.append((at, raw.nbytes))
            f.write(raw)
            padding = -raw.nbytes % 64
            f.write(bytes(padding))
            at += raw.nbytes + padding
        end = pickle.dumps((head, places), protocol=5)
        f.write(end)
        f.write(len(end).to_bytes(8, "little"))


def read_pickled(path: str):
    """What ``write_pickled`` wrote. On a local file system its arrays are mapped: they take no memory of the process, and tasks share them."""
    filesystem, p = filesystem_of(path)
    source = pa.memory_map(p) if isinstance(filesystem, fs.LocalFileSystem) else filesystem.open_input_file(p)
    whole = source.read_buffer()
    size = int.from_bytes(whole.slice(whole.size - 8).to_pybytes(), "little")
    head, places = pickle.loads(whole.slice(whole.size - 8 - size, size))
    return pickle.loads(head, buffers=[whole.slice(at, n) for at, n in places])
