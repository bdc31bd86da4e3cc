"""Operator 5: byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Every map task explodes its texts into pre-tokens and keeps, for each chunk of documents, the
   distinct pre-tokens and the sequence of their numbers: the positions.
2. The distinct pre-tokens of all chunks meet in buckets by hash. There each distinct word is
   encoded once, however many documents hold it, and the ids go back to the chunks.
3. A cogroup by chunk joins the ids to the positions and reassembles each document in order.
   Decoding looks every id up in the table of token bytes.

Defined results: a null text is an empty text (no ids). Rows with a null or repeated doc_id are kept,
one result a row. An empty table gives an empty result. Other columns are not read. Special tokens
are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R
from .pretokens import as_array, pretokens

PAYLOAD = "chunk long, payload binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, token_ids array<int>, decoded binary"


@lru_cache(4)
def vocabulary(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder of a file of ranks, and the table of token bytes by id."""
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tiktoken.Encoding("folium", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), table


def distinct_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the words, the commonest being 0, and the distinct words in that order."""
    d = words.dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-np.bincount(codes, minlength=len(d.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[codes], d.dictionary.take(pa.array(order))


def pack_words(words: pa.Array) -> bytes:
    data, off = R.flat_utf8(words)
    return R.squeeze((R.byte_planes(np.diff(off), 4), data.tobytes()))


def unpack_words(blob: bytes) -> pa.Array:
    planes, data = R.unsqueeze(blob)
    off = np.r_[0, np.cumsum(R.from_planes(planes))]
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])


def buckets_of(words: pa.Array, n: int) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) % n for w in words.to_pylist()), np.int64, len(words))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = R.chunk_ids()
    for b in R.slices(batches, "text"):
        data, off = R.flat_utf8(b.column("text"))
        places, ptr = pretokens(data, off)
        codes, words = distinct_words(as_array(data, places))
        width = max(1, (int(codes.max(initial=0)).bit_length() + 7) // 8)
        payload = R.squeeze((R.id_values(b.column("doc_id")), np.diff(ptr), R.byte_planes(codes, width))), pack_words(words)
        yield pa.record_batch([[next(names)], [R.pickle.dumps(payload, protocol=5)]], schema=pa.schema([("chunk", pa.int64()), ("payload", pa.binary())]))


def _send_words(n: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload"), strict=True):
                words = unpack_words(R.pickle.loads(payload.as_buffer())[1])
                to = buckets_of(words, n)
                words = words.take(pa.array(np.argsort(to, kind="stable")))
                count = np.bincount(to, minlength=n)
                at = np.cumsum(count) - count
                own = np.flatnonzero(count)
                blobs = [pack_words(words.slice(at[i], count[i])) for i in own]
                yield pa.record_batch([pa.array(own, pa.int64()), pa.array([chunk] * len(own), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    return send


def _encode_bucket(path: str) -> Callable:
    def encode(table: pa.Table) -> pa.Table:
        piece = vocabulary(path)[0]._encode_single_piece
        parts = [unpack_words(x) for x in table.column("blob").to_pylist()]
        d = pa.concat_arrays(parts).dictionary_encode()
        ids = [piece(w) for w in d.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.int64, int(size.sum()))
        start = np.cumsum(size) - size
        codes, blobs, at = d.indices.to_numpy(zero_copy_only=False), [], 0
        for p in parts:
            own = codes[at : at + len(p)]
            at += len(p)
            blobs.append(R.squeeze((R.byte_planes(size[own], 4), R.byte_planes(flat[R.spread(size[own], start[own])], 4))))
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "blob": pa.array(blobs, pa.binary())})

    return encode


def digest_rows(ids: np.ndarray, per_doc: list, table: list[bytes]) -> dict:
    """What the query reports of each document: per_doc has (token ids, their decimal form, token bytes) makers."""
    return {
        "n_tokens": pa.array([len(x[0]) for x in per_doc], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(x[1]()).hexdigest() for x in per_doc], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(b"".join(map(table.__getitem__, x[0].tolist()))).hexdigest() for x in per_doc], pa.string()),
    }


def token_rows(ids: np.ndarray, per_doc: list, table: list[bytes]) -> dict:
    """Token ids and the bytes that they decode to."""
    return {
        "token_ids": pa.array([x[0].astype(np.int32) for x in per_doc], pa.list_(pa.int32())),
        "decoded": pa.array([b"".join(map(table.__getitem__, x[0].tolist())) for x in per_doc], pa.binary()),
    }


def _reassemble(path: str, n: int, rows: Callable) -> Callable:
    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        table, out = vocabulary(path)[1], []
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True))
        for payload in left.column("payload"):
            body, words = R.pickle.loads(payload.as_buffer())
            ids, counts, planes = R.unsqueeze(body)
            words, codes = unpack_words(words), R.from_planes(planes)
            order = np.argsort(buckets_of(words, n), kind="stable")
            size, flat = np.zeros(len(words), np.int64), []
            if len(words):
                got = [R.unsqueeze(answers[k]) for k in sorted(answers)]
                size[order] = np.concatenate([R.from_planes(x[0]) for x in got])
                flat = np.concatenate([R.from_planes(x[1]) for x in got])
            start = np.empty(len(words), np.int64)
            start[order] = np.cumsum(size[order]) - size[order]
            texts = [b" ".join(b"%d" % x for x in flat[s : s + k].tolist()) for s, k in zip(start.tolist(), size.tolist(), strict=True)]
            end, per_doc = np.cumsum(counts), []
            for e, c in zip(end.tolist(), counts.tolist(), strict=True):
                own = codes[e - c : e]
                tokens = flat[R.spread(size[own], start[own])] if c else np.zeros(0, np.int64)
                per_doc.append((tokens, lambda own=own: b" ".join([texts[x] for x in own.tolist()])))
            out.append(pa.table({"doc_id": R.id_column(ids)} | rows(ids, per_doc, table)))
        return pa.concat_tables(out) if out else None

    return reassemble


def encode_documents(docs: DataFrame, path: str, *, rows: Callable = token_rows, schema: str = TOKENS) -> DataFrame:
    """Token ids of every text and the bytes they decode to.

    docs: doc_id, text. path: a file of ranks on every machine. rows and schema: what to make of each
    document; token_rows gives the ids and decoded bytes themselves.
    """
    spark = R.attach(docs.sparkSession)
    n = R.partitions(spark)
    chunks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_explode, PAYLOAD).repartition(n, "chunk")
    words = chunks.mapInArrow(_send_words(n), "bucket long, chunk long, blob binary")
    ids = words.groupBy("bucket").applyInArrow(_encode_bucket(path), "chunk long, bucket long, blob binary")
    return chunks.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_reassemble(path, n, rows), schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of doc_id, token_ids; null ids decode to nothing."""
    R.attach(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path)[1]
        for b in batches:
            out = [b"".join(map(table.__getitem__, x or [])) for x in b.column("token_ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "token_ids").mapInArrow(decode, "doc_id long, decoded binary")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """The digests of encode_documents()'s rows, made in the task that has them."""
    return encode_documents(docs, path, rows=digest_rows, schema=DIGESTS)
