"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model crosses from a word to the white-space mark of the next word, so the marked words
of a text are segmented independently of one another.  Texts are cut into chunks (the marks before a word and
the word), every distinct chunk is segmented once, and the ids are joined back by position.

Texts move as positions in the chunk list of their block, a run of at most ``BLOCK_BYTES`` of text read together, and
chunk lists move in parts by the hash of the chunk: what is shuffled is far smaller than one row per word.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.llm.common import release_memory, released, table

MARK = "▁"
BLOCK_BYTES = 8 << 20
TOKENS_AT_ONCE = 1 << 18
MODEL_FILE = "piece_bpe_32k.model"


@cache
def _processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def load_model(path: str) -> bytes:
    """The model file, refused unless its chunks can be segmented apart and texts reach it unchanged."""
    with open(path, "rb") as file:
        model = file.read()
    sp = _processor(model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a piece of this model crosses a white-space mark")
    probe = " ﬁ  b "
    if "".join(sp.encode(probe, out_type=str)).replace(MARK, " ") != " " + probe:
        raise ValueError("this model changes texts or does not mark their beginning")
    return model


def segment(sp: sentencepiece.SentencePieceProcessor, chunks: list[str]) -> list[list[int]]:
    """Ids of chunks that are given without their first mark, which encoding adds; "" is the mark alone."""
    return [ids or [sp.piece_to_id(MARK)] for ids in sp.encode(chunks, num_threads=1)]


def cut_texts(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(order, lengths, codes, chunks): texts in a new order, chunks per text, their positions, distinct chunks."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    odd = pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  "))
    empty = pc.equal(texts, "")
    odd, empty = (x.to_numpy(zero_copy_only=False).astype(bool) for x in (odd, empty))
    plain = np.flatnonzero(~odd & ~empty)
    rest = np.flatnonzero(odd)
    order = np.concatenate([np.flatnonzero(empty), plain, rest])
    split = pc.split_pattern(texts.take(pa.array(plain)), " ")
    runs = [[c[1:] for c in re.findall(" +[^ ]*", " " + t)] for t in texts.take(pa.array(rest)).to_pylist()]
    lengths = np.concatenate([np.zeros(empty.sum(), np.int64),
                              pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64),
                              np.array([len(r) for r in runs], np.int64)])
    flat = pa.chunked_array([split.flatten(), pa.array([c for r in runs for c in r], pa.string())])
    coded = flat.combine_chunks().dictionary_encode()
    return order, lengths, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(planes.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _pack_words(words: pa.StringArray) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("w", pa.string())]),
                           options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([words], ["w"]))
    return sink.getvalue().to_pybytes()


def _unpack_words(data: bytes) -> list[str]:
    return pa.ipc.open_stream(data).read_all().column(0).to_pylist()


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most BLOCK_BYTES of text, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > BLOCK_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _coded(batch: pa.RecordBatch, parts: int):
    """Everything a block is made of; its name is a digest of its content, so recomputing gives the same."""
    order, lengths, codes, chunks = cut_texts(batch.column(1))
    by_count = np.argsort(-np.bincount(codes, minlength=len(chunks)), kind="stable")  # frequent chunks get small numbers
    rank = np.empty(len(chunks), np.int64)
    rank[by_count] = np.arange(len(chunks))
    codes, chunks = rank[codes], chunks.take(pa.array(by_count))
    part = (pd.util.hash_array(chunks.to_numpy(zero_copy_only=False).astype(object), categorize=False)
            % np.uint64(parts)).astype(np.int64)
    keys = batch.column(0).take(pa.array(order))
    words = _pack_words(chunks)
    name = hashlib.sha256(b"|".join([repr(keys.to_pylist()).encode(), lengths.tobytes(), words])).hexdigest()[:32]
    return name, keys, lengths, codes, chunks, part


def _chunk_lists(rows: DataFrame, parts: int) -> DataFrame:
    """(block, part, words): the distinct chunks of each block, divided by the hash of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                name, _, _, _, chunks, part = _coded(block, parts)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                some = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
                words = [_pack_words(chunks.take(pa.array(order[bounds[p]:bounds[p + 1]]))) for p in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(words, pa.binary())],
                    ["block", "part", "words"])

    return rows.mapInArrow(released(run), "block string, part int, words binary")


def _segmented(lists: DataFrame, model: bytes) -> DataFrame:
    """(block, part, lengths, ids): a chunk is in one part only, and its part segments it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, known = _processor(model), {}
        for batch in batches:
            for block, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                words = _unpack_words(data)
                new = list(dict.fromkeys(w for w in words if w not in known))
                known.update(zip(new, (np.array(ids, np.uint32) for ids in segment(sp, new))))
                ids = [known[w] for w in words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([part], pa.int32()),
                     pa.array([_pack(np.array([len(i) for i in ids]))], pa.binary()),
                     pa.array([_pack(np.concatenate(ids))], pa.binary())], ["block", "part", "lengths", "ids"])

    return lists.mapInArrow(released(run), "block string, part int, lengths binary, ids binary")


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", decoded: bool = False,
           digests: bool = False) -> DataFrame:
    """(key, ids): the ids of every whole text, as ``SentencePieceProcessor.encode`` gives them.

    With ``decoded`` also ``decoded``, the text that the library's ``decode`` makes of these ids.  With ``digests``
    the number of ids and the digests of ids and decoded text stand for both, so that only these leave the worker.

    Neither begin nor end ids, no sampling.  Null and empty texts have no ids.  Repeated rows and null keys
    give a row each; an empty table gives none.  A literal white-space mark in a text counts as a space, as
    in the library.  ``docs`` is read twice and must give the same rows both times; otherwise the
    blocks of the two readings do not match and the job fails.  A task keeps the distinct chunks of its part, so
    ``spark.sql.shuffle.partitions`` has to follow the size of the data, as for any shuffle.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType
    lists = _chunk_lists(rows, parts).repartition(parts, "part")
    found = _segmented(lists, model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                name, keys, lengths, codes, _, part = _coded(block, parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([keys.to_pylist()], pa.list_(keys.type)), pa.array([_pack(lengths)], pa.binary()),
                     pa.array([_pack(codes)], pa.binary()), pa.array([_pack(part)], pa.binary())],
                    ["block", "keys", "lengths", "codes", "part"])

    coded = rows.mapInArrow(released(code), f"block string, keys array<{kind.simpleString()}>, lengths binary, codes binary, part binary")

    if digests:
        columns = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    else:
        columns = [("ids", pa.list_(pa.int32()), "array<int>")] + [("decoded", pa.string(), "string")] * decoded

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        by_part = {p: (n, i) for p, n, i in zip(*(right.column(c).to_pylist() for c in ("part", "lengths", "ids")))}
        key_type = left.schema.field("keys").type.value_type
        schema = pa.schema([("key", key_type)] + [(name, kind) for name, kind, _ in columns])
        sp, batches = _processor(model), []
        for row in left.to_pylist():
            for keys, ids in _ids_of_block(row, by_part):
                if digests:
                    values = _digests(sp, ids)
                else:
                    values = [ids] + [_decoded(sp, ids)] * decoded
                batches.append(pa.RecordBatch.from_arrays([pa.array(keys, key_type), *values], schema=schema))
        out = pa.Table.from_batches(batches, schema)
        release_memory()
        return out

    schema = f"key {kind.simpleString()}, " + ", ".join(f"{name} {sql}" for name, _, sql in columns)
    return coded.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(joined, schema).withColumnRenamed("key", key)


def _ids_of_block(row: dict, by_part: dict) -> Iterator[tuple[list, pa.ListArray]]:
    """Keys and ids of a block's texts, some at a time; ``by_part`` has the ids of its chunks in order within each part."""
    lengths, codes, part = (_unpack(row[c]) for c in ("lengths", "codes", "part"))
    sizes, ids, at = np.zeros(len(part), np.int32), [np.zeros(0, np.uint32)], np.zeros(len(part), np.int32)
    base = 0
    for p in np.unique(part):
        if int(p) not in by_part:
            raise RuntimeError("the two readings of the documents differ")
        packed_sizes, packed_ids = by_part[int(p)]
        own, some = np.flatnonzero(part == p), _unpack(packed_sizes)
        sizes[own], at[own] = some, base + np.cumsum(some) - some
        ids.append(_unpack(packed_ids))
        base += len(ids[-1])
    ids = np.concatenate(ids).astype(np.int32)
    chunk_ends = np.cumsum(lengths.astype(np.int64))
    tokens = np.concatenate([[0], np.cumsum(sizes[codes], dtype=np.int64)])  # before each chunk
    text_ends = tokens[chunk_ends]
    start = 0
    while start < len(lengths):
        before = text_ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(text_ends, before + TOKENS_AT_ONCE, "right")))
        some = codes[chunk_ends[start - 1] if start else 0:chunk_ends[stop - 1]]
        n = sizes[some]
        ends = np.cumsum(n, dtype=np.int64)
        where = np.repeat(at[some] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        offsets = np.concatenate([[0], text_ends[start:stop] - before]).astype(np.int32)
        yield row["keys"][start:stop], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[where]))
        start = stop


def _decoded(sp: sentencepiece.SentencePieceProcessor, lists: pa.ListArray) -> pa.StringArray:
    return pa.array([None if not x.is_valid else sp.decode(x.values.to_numpy().tolist()) if len(x) else "" for x in lists],
                    pa.string())


@cache
def _decimals(pieces: int) -> list[str]:
    return [str(i) for i in range(pieces)]


def _digests(sp: sentencepiece.SentencePieceProcessor, lists: pa.ListArray) -> list[pa.Array]:
    """Numbers of ids, digests of the decimal ids joined by commas, digests of the decoded texts."""
    names, counts, listed, texts = _decimals(sp.get_piece_size()), [], [], []
    for x in lists:
        ids = x.values.to_numpy().tolist()
        counts.append(len(ids))
        listed.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
        texts.append(hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(texts, pa.string())]


def decode(ids: Column, model: bytes) -> Column:
    """The text of each list of ids, as ``SentencePieceProcessor.decode`` gives it; null stays null."""
    return F.arrow_udf(lambda lists: _decoded(_processor(model), lists), "string")(ids)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    model = load_model(path or public_tokenizers.path(MODEL_FILE))
    return encode(docs, model, digests=True)
