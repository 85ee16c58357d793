"""Flat token files with 64-bit offsets, and their reading.

Format, for a folder:

* ``<part>.bin``  the ids of the part's documents, one after another, as
  little-endian unsigned integers (2 bytes if the vocabulary allows, else 4);
* ``<part>.off``  for n documents n + 1 little-endian unsigned 64-bit offsets,
  counted in ids from the beginning of the part;
* ``<part>.doc``  the n document ids (signed 64-bit; ``NO_ID`` for null).

The writer returns the list of parts in order, each with its base: the ids of
all parts before it, a prefix sum over one row a part.  A retried task writes
files of a new name, and only listed files are read, so lost executors leave
at most stray files.

Documents are in ascending order of (doc_id, hash of the text), nulls first.
Defined results: null text is empty; an empty document is its end id; repeated
rows are written each; an empty table is an empty list of parts; columns
beside id and text are not read.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import id_text, saved
from vitrine.llm.tokens import ROWS, WordEncoder, slices, worker_encoder

NO_ID = -(1 << 63)
READ_DOCS = 10_000  # documents of a batch that the reader returns

PARTS = "name string, first_id bigint, first_hash bigint, first_row bigint, n_docs bigint, n_ids bigint, width int"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> list[dict]:
    """Encodes and writes all documents below ``folder`` (a URI that all executors reach).

    Returns the parts in order: name, base, n_docs, n_ids, width.
    """
    def run(batches):
        encoder = worker_encoder(WordEncoder, tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        store, path = fs.FileSystem.from_uri(folder)
        name, out, offsets, ids, first = uuid.uuid4().hex, None, [0], [], None
        for b in (part for batch in batches for part in slices(batch, ROWS)):
            texts = encoder.encode_all(b.column(1).to_pylist())
            for doc_id, ids_, h, row in zip(b.column(0).to_pylist(), texts, *(c.to_pylist() for c in b.columns[2:])):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out, first = store.open_output_stream(f"{path}/{name}.bin"), (doc_id, h, row)
                data = ids_.tobytes() + end
                out.write(data)
                offsets.append(offsets[-1] + len(data) // encoder.width)
                ids.append(NO_ID if doc_id is None else doc_id)
        if out is None:
            return
        out.close()
        for end_of_name, values in ((".off", np.array(offsets, "<u8")), (".doc", np.array(ids, "<i8"))):
            with store.open_output_stream(f"{path}/{name}{end_of_name}") as f:
                f.write(values.tobytes())
        row = (name, *first, len(ids), offsets[-1], encoder.width)
        yield pa.RecordBatch.from_pylist([dict(zip(fields, row))], schema=pa.schema(
            [("name", pa.string())] + [(f, pa.int64()) for f in fields[1:-1]] + [("width", pa.int32())]))

    fields = [x.split()[0] for x in PARTS.split(", ")]
    order = ["doc_id", "h", "row"]  # row splits the copies of one document over partitions
    rows = id_text(docs).withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, PARTS)
    listed = saved(parts, "token-parts").orderBy("first_id", "first_hash", "first_row").collect()
    bases = accumulate((p.n_ids for p in listed), initial=0)
    return [{"name": p.name, "base": base, "n_docs": p.n_docs, "n_ids": p.n_ids, "width": p.width}
            for p, base in zip(listed, bases)]


def _flat(store, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is a local path, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read(spark: SparkSession, folder: str, parts: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document, from the files; ids as unsigned 32-bit, little-endian."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            for part in b.to_pylist():
                at = f"{path}/{part['name']}"
                ids, off, doc = (_flat(store, at + e, d) for e, d in
                                 ((".bin", f"<u{part['width']}"), (".off", "<u8"), (".doc", "<i8")))
                for lo in range(0, len(doc), READ_DOCS):
                    hi = min(lo + READ_DOCS, len(doc))
                    start = off[lo:hi + 1].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if d == NO_ID else int(d) for d in doc[lo:hi]], pa.int64()),
                        pa.array(start[:-1] + part["base"]), pa.array(np.diff(start)),
                        pa.array([ids[s:e].astype("<u4").tobytes() for s, e in zip(start[:-1], start[1:])], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    listed = spark.createDataFrame([(p["name"], p["base"], p["width"]) for p in parts],
                                   "name string, base bigint, width int")
    return listed.repartition(len(parts), "name").mapInArrow(run, schema)
