"""Files in the shared folder, written and read whole by workers: any place that pyarrow.fs reaches (file, hdfs, s3, gs, abfs)."""

from __future__ import annotations

from pyarrow import fs


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def check(folder: str) -> None:
    """An error before any job if workers could not write to the folder."""
    try:
        _open(folder)
    except Exception as e:
        raise ValueError(f"files can't be written to {folder}: {e}") from e


def put(path: str, data: bytes) -> None:
    """Writes a file under its final name only when it is whole."""
    at, own = _open(path)
    at.create_dir(own.rsplit("/", 1)[0], recursive=True)
    with at.open_output_stream(own + ".part") as f:
        f.write(data)
    at.move(own + ".part", own)


def get(path: str) -> bytes:
    at, own = _open(path)
    with at.open_input_stream(own) as f:
        return f.read()
