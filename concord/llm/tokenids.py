"""Token ids in a compact binary format: static range asymmetric numeral system in independent interleaved blocks.

Documents are laid in ascending doc_id order by a range partitioning, tokenised with the tokenizers library, and kept
as chunks of 16- or 32-bit ids.  One table of frequencies over all ids is shared by all blocks.  A chunk becomes one
block: its ids are dealt over ``LANES`` interleaved coder states, checkpoints every ``STRIDE`` steps hold all states and
the place in the stream, and a CRC-32 guards the ids.  Any block, and any checkpoint in it, decodes without the others.

File format.  A data set is two Parquet tables: ``blocks`` (part, block, first, doc_ids, lengths, payload) and ``freqs``
(token, freq); parts and blocks count in document order, ``first`` is the number of ids before the block in its part.
A payload is a header of six little-endian 32-bit numbers (magic, ids, lanes, stride, checkpoints, CRC-32), for each
checkpoint the 64-bit number of stream words before it and the states of all lanes, then the stream of 32-bit words.

Words are tokenised once each where that changes nothing (``by_word``): rules that drop white space and never look
across it, with ids of their own for ends of words, so the ids of a text are those of its words.  Other tokenizers are run over whole texts (``by_word=False``).

Edge cases: a null or empty text has the end id alone; null ids come first; equal ids stand next to each other in any
order; a document is never cut, so one longer than a chunk is a block by itself; an empty table gives empty tables.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import islice
from unicodedata import normalize
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import discard, shared_dir, text_or_empty, written

#: Frequencies sum to 2**BITS; states stay in [2**31, 2**63) and move 32 bits at a time.
BITS, LOW = 20, 1 << 31
LANES, STRIDE, CHUNK = 2048, 128, 1 << 19
MAGIC = 0x534E4152
CHUNK_COLUMNS = ["part", "block", "first", "doc_ids", "lengths", "ids", "counts"]

# -- coder ---------------------------------------------------------------------------------------------------------


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, at least 1 for every id that occurs."""
    counts = counts.astype(np.float64)
    if not counts.any():
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * (1 << BITS))), 0).astype(np.int64)
    over = int(freq.sum() - (1 << BITS))
    if over < 0:
        freq[np.argmax(freq)] -= over
    for i in np.argsort(-freq, kind="stable"):  # the ones that were lifted to 1 are paid for by the most frequent
        if over <= 0:
            break
        cut = min(over, int(freq[i]) // 2)
        freq[i] -= cut
        over -= cut
    return freq


class Table:
    """What both directions need of the shared frequencies."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, stride: int = STRIDE) -> bytes:
    """One block.  Id i goes through lane i % lanes at step i // lanes; coding runs from the last step to the first."""
    n = len(ids)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    behind = 0
    shift, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    for step in range(steps - 1, -1, -1):
        sym = ids[step * lanes : min(n, (step + 1) * lanes)]
        x, f = state[: len(sym)], table.freq[sym]
        big = x >= (f << np.uint64(63 - BITS))
        out = (x[big] & low).astype("<u4")
        words.append(out)
        behind += len(out)
        x = np.where(big, x >> shift, x)
        q = x // f
        state[: len(sym)] = (q << np.uint64(BITS)) + (x - q * f) + table.start[sym]
        if step % stride == 0:
            marks.append((behind, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    head = struct.pack("<6I", MAGIC, n, lanes, stride, len(marks), crc32(ids.astype("<u4").tobytes()))
    at = b"".join(struct.pack("<Q", len(stream) - b) + s.astype("<u8").tobytes() for b, s in marks[::-1])
    return head + at + stream.tobytes()


def decode(payload: bytes, table: Table, checkpoint: int = 0) -> np.ndarray:
    """The ids of a block, from a checkpoint on; raises ValueError if a whole block fails its checksum."""
    magic, n, lanes, stride, marks, check = struct.unpack_from("<6I", payload)
    if magic != MAGIC:
        raise ValueError("not a block")
    size = 8 + 8 * lanes
    stream = np.frombuffer(payload, "<u4", offset=24 + marks * size).astype(np.uint64)
    ids = np.zeros(n, dtype=np.uint32)
    if marks:
        at = struct.unpack_from("<Q", payload, 24 + checkpoint * size)[0]
        state = np.frombuffer(payload, "<u8", lanes, 24 + checkpoint * size + 8).copy()
        mask, shift, low = np.uint64((1 << BITS) - 1), np.uint64(32), np.uint64(LOW)
        for begin in range(checkpoint * stride * lanes, n, lanes):
            end = min(n, begin + lanes)
            x = state[: end - begin]
            slot = x & mask
            sym = table.symbol[slot]
            ids[begin:end] = sym
            x = table.freq[sym] * (x >> np.uint64(BITS)) + slot - table.start[sym]
            short = np.flatnonzero(x < low)
            x[short] = (x[short] << shift) | stream[at : at + len(short)]
            at += len(short)
            state[: end - begin] = x
    ids = ids[checkpoint * stride * lanes :]
    if checkpoint == 0 and crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("checksum differs")
    return ids


# -- tokenising ----------------------------------------------------------------------------------------------------

_loaded: dict[str, object] = {}
_known: dict[str, Known] = {}
_over: dict[str, list[bytes]] = {}
#: Words whose ids a Python worker remembers, about 210 bytes each.
KNOWN = 1_000_000
#: Marks that end a word and are a token run of their own after a letter.
MARKS = b".,;:!?"


def tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


@cache
def _last(coder) -> np.ndarray:
    """Of each id, whether it ends a word."""
    vocabulary = coder.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.endswith(coder.model.end_of_word_suffix)]] = True
    return out


@cache
def _lean(coder):
    """The tokenizer less what leaves words of small ASCII letters as they are."""
    from tokenizers import Tokenizer, pre_tokenizers

    out = Tokenizer(coder.model)
    out.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return out


def _letters(word: bytes) -> bool:
    """Whether a word is of letters alone, and still is once normalised and lower-cased."""
    text = word.decode("utf-8", "surrogatepass")
    return text.isalpha() and normalize("NFC", text).lower().isalpha()


def _learn(fresh: list[bytes], known: dict[bytes, bytes], coder) -> None:
    """Put the ids of new words into ``known``.

    Words of letters alone go to the tokenizer as one text, in which each is a word of the tokenizer's too and ends with
    an id that ends words; marks after such a word are coded apart.  All others are coded one by one."""
    run = lambda some: coder.encode_batch_fast(some, add_special_tokens=False)
    plain: dict[bytes, None] = {}
    stems: dict[bytes, None] = {}
    marked, single = [], []
    for w in fresh:
        stem = w.rstrip(MARKS)
        if stem.isalpha() and stem.islower():  # the lean tokenizer does not lower-case what a text that kept its case holds
            kind = plain
        elif _letters(stem):
            kind = stems
        else:
            single.append(w)
            continue
        if len(stem) == len(w):
            kind[w] = None
        else:
            marked.append((w, stem))
            if stem not in known:
                kind[stem] = None
    for words, by in ((plain, _lean(coder)), (stems, coder)):
        if not words:
            continue
        ids = np.array(by.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(_last(coder)[ids]) + 1)).tolist()
        ids = ids.tobytes()
        if len(ends) == len(words):
            known.update(zip(words, (ids[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        else:
            single += words
    single += [x for x in {w[len(stem) :] for w, stem in marked} if x not in known]
    known.update(zip(single, (np.array(e.ids, "<u4").tobytes() for e in run([w.decode("utf-8", "surrogatepass") for w in single])), strict=True))
    for w, stem in marked:
        known[w] = known[stem] + known[w[len(stem) :]]


class Known(dict):
    """Ids of words; an unknown word gets an empty place in ``fresh``, to be filled once it is learned."""

    def __init__(self):
        self.fresh: dict[bytes, bytearray] = {}

    def __missing__(self, word: bytes) -> bytearray:
        place = self.fresh.get(word)
        if place is None:
            place = self.fresh[word] = bytearray()
        return place


def ids_of(texts: list[str], path: str, by_word: bool) -> list[np.ndarray]:
    """Ids of each text as 32-bit numbers."""
    coder = tokenizer(path)
    if not by_word:
        return [np.array(e.ids, "<u4") for e in coder.encode_batch_fast(texts, add_special_tokens=False)]
    known = _known.setdefault(path, Known())
    split = []
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        # a special token's string counts only as it is written, so such texts keep their case
        split.append(raw.split() if b"<|" in raw else raw.lower().split())
    if len(known) > KNOWN:  # full: what came first, mostly the frequent words, stays
        for w in _over.pop(path, ()):
            del known[w]
    before, fresh = len(known), known.fresh
    fresh.clear()  # of a call that failed
    found = [list(map(known.__getitem__, words)) for words in split]  # each word is looked up once
    _learn(list(fresh), known, coder)
    for w, place in fresh.items():
        place += known[w]
    fresh.clear()
    if len(known) > KNOWN:
        _over[path] = list(islice(reversed(known), len(known) - before))
    return [np.frombuffer(b"".join(x), "<u4") for x in found]


def _chunks(path: str, end_id: int, by_word: bool, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        docs: list = []
        held: list[np.ndarray] = []
        number = first = size = 0
        total = np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            nonlocal total
            lengths, ids = [len(x) for x in held], np.concatenate(held).astype("<u4")
            more = np.bincount(ids)
            total, more = (total, more) if len(total) >= len(more) else (more, total)
            total[: len(more)] += more
            cols = [pa.array([part]), pa.array([number]), pa.array([first]), pa.array([docs], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary()), pa.nulls(1, pa.binary())]
            return pa.record_batch(cols, names=CHUNK_COLUMNS)

        for batch in batches:
            id_type = batch.column("doc_id").type
            names, texts = batch.column("doc_id").to_pylist(), batch.column("t")
            for at in range(0, len(names), 256):
                for name, ids in zip(names[at : at + 256], ids_of(texts.slice(at, 256).to_pylist(), path, by_word), strict=True):
                    docs.append(name)
                    held.append(np.append(ids, np.uint32(end_id)))
                    size += len(ids) + 1
                    if size >= chunk:
                        yield out()
                        number, first = number + 1, first + size
                        docs, held, size = [], [], 0
        if held:
            yield out()
        if len(total):  # how often each id occurs in this task, as a row of its own
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary())
            yield pa.record_batch([*(pa.nulls(1, k) for k in kinds), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=CHUNK_COLUMNS)
        pa.default_memory_pool().release_unused()

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, n of every count row."""
    for batch in batches:
        for x in batch.column("counts"):
            total = np.frombuffer(x.as_buffer(), "<i8")
            seen = np.flatnonzero(total)
            yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["token", "n"])


def _blocks(freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq.value)
        for batch in batches:
            coded = [encode(np.frombuffer(x.as_buffer(), "<u4"), table) for x in batch.column("ids")]
            yield pa.record_batch([*(batch.column(c) for c in ("part", "block", "first", "doc_ids", "lengths")), pa.array(coded, pa.binary())], names=["part", "block", "first", "doc_ids", "lengths", "payload"])

    return run


def write_ids(df: DataFrame, path: str, tokenizer_path: str, end_id: int, by_word: bool, vocabulary: int, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK) -> None:
    """Write the data set of ``df`` under ``path``.

    The chunks are kept once in the shared folder between tokenising and coding; the table of frequencies has at most
    ``vocabulary`` rows and is the only thing that goes to the driver and to all tasks."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    shape = f"part bigint, block bigint, first bigint, doc_ids array<{kind}>, lengths array<bigint>"
    chunks = written(ordered.mapInArrow(_chunks(tokenizer_path, end_id, by_word, chunk), f"{shape}, ids binary, counts binary"), "chunks", compression="zstd")
    counted = chunks.where("counts is not null").select("counts").mapInArrow(_counts, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in counted:
        counts[r["token"]] = r["n"]
    freq = quantised(counts)
    shared = spark.sparkContext.broadcast(freq)
    chunks.where("counts is null").drop("counts").mapInArrow(_blocks(shared), f"{shape}, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    discard(chunks)
    seen = np.flatnonzero(freq)
    rows = [(int(t), int(freq[t])) for t in seen]
    spark.createDataFrame(rows, "token bigint, freq bigint").coalesce(1).write.parquet(f"{path}/freqs")


def _documents(freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode(batch.column("payload")[i].as_py(), table)
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                begins = np.cumsum(lengths) - lengths
                data = ids.astype("<u4").tobytes()
                sums = [crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(begins.tolist(), lengths.tolist(), strict=True)]
                same = lambda c, n=len(lengths), i=i: pa.array(np.full(n, batch.column(c)[i].as_py(), np.int64))
                doc_ids = batch.column("doc_ids")[i].values
                cols = [same("part"), pa.array(begins + batch.column("first")[i].as_py()), doc_ids, pa.array(lengths), pa.array(sums, pa.int64())]
                yield pa.record_batch(cols, names=["part", "begin", "doc_id", "n_tokens", "ids_crc32"])

    return run


def read_documents(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    freq = np.zeros(vocabulary, np.int64)
    for r in spark.read.parquet(f"{path}/freqs").collect():  # at most ``vocabulary`` rows
        freq[r["token"]] = r["freq"]
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    docs = blocks.mapInArrow(_documents(spark.sparkContext.broadcast(freq)), f"part bigint, begin bigint, doc_id {kind}, n_tokens bigint, ids_crc32 bigint")
    size = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per part
    offsets = size.select(F.col("part").alias("__part"), before.alias("before"))
    joined = docs.join(F.broadcast(offsets), F.col("part") == F.col("__part"))  # as many rows as there are parts
    return joined.select("doc_id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int, by_word: bool, vocabulary: int, **names: str) -> DataFrame:
    """Write the ids of ``df`` to a data set in the shared folder and return its documents as read back."""
    path = f"{shared_dir(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_ids(df, path, tokenizer_path, end_id, by_word, vocabulary, **names)
    return read_documents(df.sparkSession, path, vocabulary)
