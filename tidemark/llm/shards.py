"""Token-id shards: raw id payloads behind minimal perfect hash indexes.

Format.  `<name>.ids` holds nothing but ids, little-endian unsigned, 2 or 4 bytes each, of
documents in ascending order of their keys.  `<name>.idx` holds arrays (see mphf.pack): id
width; the perfect hash of the shard's distinct keys (sizes, words); a 32-bit fingerprint per
hash number; the first document and the number of documents of that key; and the offset of each
document in the payload, in ids, with the end behind the last.  A key is found by one probe of
the hash, one comparison of the fingerprint and two reads of offsets.  The manifest, a table,
names the valid files with their key ranges; files of failed attempts are named nowhere.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.llm.mphf import PerfectHash, pack, unpack
from tidemark.llm.pretokens import encoder, tokenizer_path
from tidemark.llm.ship import ship
from tidemark.llm.text import mix, slices
from tidemark.session import materialized

#: Stands for a null key, which sorts before all others.
NULL_KEY = -(1 << 63)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    """`keys` in ascending order, repeats allowed; `lengths` in ids."""
    distinct, first, n = np.unique(keys, return_index=True, return_counts=True)
    hashed = PerfectHash.build(distinct.view(np.uint64))
    at = np.argsort(hashed.index(distinct.view(np.uint64)))
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.uint64)
    return pack(
        [
            np.array([width], np.uint8),
            hashed.sizes,
            hashed.words,
            _fingerprints(distinct[at]),
            first[at].astype(np.uint64),
            n[at].astype(np.uint64),
            offsets,
        ]
    )


class Shard:
    """Keyed access to one shard."""

    def __init__(self, folder: str, name: str):
        arrays = unpack(files.content(f"{folder}/{name}.idx"))
        self.width = int(arrays[0][0])
        self.hash = PerfectHash(arrays[1], arrays[2])
        self.prints, self.first, self.docs, self.offsets = arrays[3:]
        self.payload = files.opened(f"{folder}/{name}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; number 0: not in this shard."""
        number = self.hash.index(keys.view(np.uint64))
        first, docs = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if len(self.prints):
            true = (number >= 0) & (self.prints[number] == _fingerprints(keys))
            first[true], docs[true] = self.first[number[true]], self.docs[number[true]]
        return first, docs

    def ids(self, document: int) -> np.ndarray:
        a, b = int(self.offsets[document]), int(self.offsets[document + 1])
        raw = self.payload.read_at((b - a) * self.width, a * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def _writer(folder: str, tokenizer: str, end_id: int, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name, out = encoder(tokenizer, "ids"), f"shard-{uuid.uuid4().hex}", None
        end = np.array([end_id], "<u4").tobytes()
        keys, lengths = [], []
        for batch in slices(batches):
            out = out or files.create(f"{folder}/{name}.ids")
            keys.append(batch.column("key").to_numpy())
            for raw in own.encode(batch.column("text").to_pylist()):
                ids = np.frombuffer(raw + end, "<u4")
                lengths.append(len(ids))
                out.write(ids.astype(f"<u{width}").tobytes())
        if out is None:
            return
        out.close()
        keys, lengths = np.concatenate(keys), np.array(lengths, np.int64)
        with files.create(f"{folder}/{name}.idx") as index:
            index.write(index_bytes(keys, lengths, width))
        yield pa.RecordBatch.from_pylist(
            [{"name": name, "low": int(keys[0]), "high": int(keys[-1]), "docs": len(keys), "ids": int(lengths.sum())}]
        )

    return write


@dataclass(frozen=True)
class Manifest:
    """Shards in ascending order of keys: one short entry each, some 100 MB of text apart."""

    folder: str
    names: tuple[str, ...]
    high: np.ndarray
    start: np.ndarray

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.high, keys, "left"), len(self.names) - 1)


def write_shards(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> Manifest:
    """Encodes all rows of `docs` in ascending order of ids into shard files.

    Null text is empty and has the end id alone; null ids come first; rows with the same id stay
    together, in one shard.  Ids must be integers or read as such; texts of any length are encoded
    whole; an empty table gives a manifest without files; other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship(spark)
    vocabulary = Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab_size()
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    folder = files.new_folder(spark, "token-shards")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY))
    written = materialized(
        docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange("key")
        .sortWithinPartitions("key")
        .mapInArrow(_writer(folder, tokenizer, end_id, width), "name string, low long, high long, docs long, ids long"),
        "manifest",
    )
    shards = sorted(written.collect(), key=lambda r: r["low"])
    ids = np.array([r["ids"] for r in shards], np.int64)
    return Manifest(
        folder,
        tuple(r["name"] for r in shards),
        np.array([r["high"] for r in shards], np.int64),
        np.cumsum(ids) - ids,
    )


def _reader(manifest: Manifest):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard, done = -1, None, None
        for batch in batches:
            which = batch.column("shard").to_numpy()
            keys = batch.column("key").to_numpy()
            rows: dict[str, list] = {"doc_id": [], "start": [], "ids": []}
            fresh = np.r_[True, (which[1:] != which[:-1]) | (keys[1:] != keys[:-1])] if len(keys) else np.zeros(0, bool)
            if len(keys) and done == (int(which[0]), int(keys[0])):
                fresh[0] = False  # a key that the last batch has answered
            for k in np.unique(which).tolist():
                if k != last:
                    shard, last = Shard(manifest.folder, manifest.names[k]), k
                asked = keys[fresh & (which == k)]
                first, docs = shard.find(asked)
                if (docs == 0).any():
                    raise LookupError("a document is missing from its shard")
                for key, a, n in zip(asked.tolist(), first.tolist(), docs.tolist(), strict=True):
                    for document in range(a, a + n):
                        rows["doc_id"].append(None if key == NULL_KEY else key)
                        rows["start"].append(int(manifest.start[k]) + int(shard.offsets[document]))
                        rows["ids"].append(shard.ids(document))
            if len(keys):
                done = (int(which[-1]), int(keys[-1]))
            sizes = [len(x) for x in rows["ids"]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["doc_id"], pa.int64()),
                    pa.array(rows["start"], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in rows["ids"]], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return read


def read_documents(keys: DataFrame, manifest: Manifest, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files, by keyed access.

    One row per stored document of every distinct id in `keys`, null ids included; asking for an
    id that was never written is an error.  Empty `keys` or an empty manifest give no rows; other
    columns of `keys` are ignored.
    """
    if not manifest.names:
        return keys.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = manifest.shard_of(batch.column("key").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), batch.column("key")], ["shard", "key"])

    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY))
    return (
        keys.select(key.alias("key"))
        .mapInArrow(place, "shard int, key long")
        .repartition("shard")
        .sortWithinPartitions("shard", "key")
        .mapInArrow(_reader(manifest), "doc_id long, start long, n_tokens long, ids_crc32 long")
    )
