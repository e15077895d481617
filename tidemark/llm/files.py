"""Files in the shared folder, by whatever file system its address names."""

from __future__ import annotations

import os
from collections import OrderedDict

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from tidemark.session import scratch_path

#: Bytes of files outside local mounts that one worker keeps; mapped local files are not counted.
KEPT_BYTES = 256 << 20
_kept: OrderedDict[str, pa.Buffer] = OrderedDict()


def _at(address: str) -> tuple[pafs.FileSystem, str]:
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    if "://" not in address:
        return pafs.LocalFileSystem(), os.path.abspath(address)
    return pafs.FileSystem.from_uri(address)


def new_folder(spark: SparkSession, label: str) -> str:
    folder = scratch_path(spark, label)
    store, path = _at(folder)
    store.create_dir(path, recursive=True)
    return folder


def create(address: str) -> pa.NativeFile:
    store, path = _at(address)
    return store.open_output_stream(path)


def opened(address: str) -> pa.NativeFile:
    """For reading at any position."""
    store, path = _at(address)
    return pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path)


def content(address: str) -> pa.Buffer:
    """A whole file, kept by the worker: mapped where it is local, else in bounded memory."""
    if address in _kept:
        _kept.move_to_end(address)
        return _kept[address]
    store, path = _at(address)
    if isinstance(store, pafs.LocalFileSystem):
        data = pa.memory_map(path).read_buffer()
    else:
        with store.open_input_file(path) as f:
            data = f.read_buffer()
    _kept[address] = data
    while len(_kept) > 1 and sum(b.size for b in _kept.values()) > KEPT_BYTES and not isinstance(store, pafs.LocalFileSystem):
        _kept.popitem(last=False)
    while len(_kept) > 4096:
        _kept.popitem(last=False)
    return data
