"""Files of any store that pyarrow can open: local paths, file://, hdfs://, s3:// and the like."""

from __future__ import annotations

import fnmatch
import posixpath

from pyarrow import fs as pafs


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if uri.startswith("file:"):  # Hadoop writes it with one slash, too
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def rebuilt(uri: str, path: str) -> str:
    """A path of uri's store as a URI of the same kind."""
    inside = store(uri)[1]
    return uri[: len(uri) - len(inside)] + path if "://" in uri and uri.endswith(inside) else path


def size(uri: str) -> int:
    """Bytes of a file; -1 if there is none."""
    system, path = store(uri)
    info = system.get_file_info(path)
    return info.size if info.type == pafs.FileType.File else -1


def listed(spec: str, suffix: str) -> list[str]:
    """The files of a comma-separated list of files, patterns in their last part, and directories (their files with that suffix)."""
    out = []
    for uri in spec.split(","):
        system, path = store(uri)
        folder, name = posixpath.split(path)
        if any(c in name for c in "*?["):
            found = [i.path for i in system.get_file_info(pafs.FileSelector(folder or ".")) if i.type == pafs.FileType.File and fnmatch.fnmatch(posixpath.basename(i.path), name)]
            out += [rebuilt(uri, p) for p in found]
        elif system.get_file_info(path).type == pafs.FileType.Directory:
            found = [i.path for i in system.get_file_info(pafs.FileSelector(path)) if i.path.endswith(suffix) and i.type == pafs.FileType.File]
            out += [rebuilt(uri, p) for p in found]
        else:
            out.append(uri)
    return sorted(out)


def read_all(uri: str) -> bytes:
    system, path = store(uri)
    with system.open_input_file(path) as f:
        return f.read()


def write_all(uri: str, data: bytes) -> None:
    system, path = store(uri)
    with system.open_output_stream(path) as f:
        f.write(data)
