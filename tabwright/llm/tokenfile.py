"""Writing texts as compressed token ids in ascending document order, and reading the files back.

Documents are dealt out by range of doc_id and sorted; each task encodes its texts, ends every document
with id 0 and packs whole documents into records of about ``RECORD_IDS`` ids (a longer document is a record
of its own). Records are rows of Parquet files, so any store that Spark reaches can hold them; the columns
beside the record say where it stands.

Defined cases: a null or empty text is the end id alone; equal ids are ordered by the hash of their text,
null ids come first; an empty table gives empty files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import chunks, coder
from tabwright.llm.arrays import slices
from tabwright.llm.rows import arrow_schema, ddl, lean, text_key
from tabwright.plans import storage

RECORD_IDS = 1 << 23
REMEMBERED = 3 << 19
RECORD_DOCS = 1 << 17
END = 0
RECORD = {"part": "int", "first": "bigint", "n_ids": "bigint", "n_docs": "bigint", "record": "binary"}
_NULL = -(1 << 63)


def byte_level(path: str) -> chunks.Encoder:
    """An encoder of texts; special tokens in a text count as plain text."""
    chunks.limit_threads()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    token_bytes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, number in tokenizer.get_vocab().items():
        token_bytes[number] = len(token)  # every letter of a token stands for a byte
    return chunks.Encoder(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)],
                          token_bytes, remembered=REMEMBERED)


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the texts of ``docs`` (doc_id, text) to ``path``."""
    schema = arrow_schema(RECORD)

    def encode(batches):
        encoder = chunks.kept_encoder(tokenizer, lambda: byte_level(tokenizer))
        part, first = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flushed():
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(
                (part, first, len(ids), len(doc_ids), coder.pack(doc_ids, lengths, ids)), schema)], schema=schema)

        size = docs_held = 0
        for batch in batches:
            for texts in slices(batch.column("text"), chunks.SLICE_BYTES):
                starts = chunks.white_space_starts(texts.data, texts.offsets)
                ids, begins, _ = encoder.encode(texts.data, texts.offsets, starts)
                ids = np.insert(ids, begins[1:], END)
                lengths = np.diff(begins) + 1
                doc_ids = batch.column("doc_id").slice(texts.first, texts.rows).fill_null(_NULL).to_numpy()
                ends, row = np.cumsum(lengths), 0
                while row < texts.rows:
                    done = int(ends[row - 1]) if row else 0
                    room = max(RECORD_IDS - size, 0)
                    stop = int(np.searchsorted(ends, done + room, "right"))
                    stop = min(max(stop, row + (not held)), row + RECORD_DOCS - docs_held, texts.rows)
                    if stop > row:
                        held.append((doc_ids[row:stop], lengths[row:stop], ids[done:ends[stop - 1]]))
                        size += int(ends[stop - 1]) - done
                        docs_held += stop - row
                        row = stop
                    if row < texts.rows:
                        yield flushed()
                        first, size, docs_held = first + size, 0, 0
        if held:
            yield flushed()

    named = docs.select("doc_id", "text")
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", text_key())
    ordered.mapInArrow(lean(encode), ddl(RECORD)).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document in the files."""
    files = spark.read.schema(ddl(RECORD)).parquet(path)
    # one row for each part, as many as the write had tasks
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    ends = np.cumsum([0] + [n for _, n in totals])
    if not totals:
        totals, ends = [(-1, 0)], np.zeros(2, np.int64)
    begins = spark.createDataFrame([(p, int(e)) for (p, _), e in zip(totals, ends)], "part int, offset bigint")
    result = {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    schema = arrow_schema(result)

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, ids = coder.unpack(batch.column("record")[i].as_py())
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
                start = batch.column("offset")[i].as_py() + ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=doc_ids == _NULL), pa.array(start), pa.array(lengths), pa.array(sums, pa.int64())],
                    schema=schema)

    placed = files.join(F.broadcast(begins), "part").select((F.col("offset") + F.col("first")).alias("offset"), "record")
    return placed.mapInArrow(lean(decode), ddl(result))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = storage.new_path(docs.sparkSession, "token-ids")
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path)
