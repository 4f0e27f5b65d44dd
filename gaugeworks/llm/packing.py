"""Best-fit packing of token sequences, improved by swaps.

Documents are tokenized where they are read; only (document, piece, start,
length, checksum) moves from there. A piece as long as a sequence fills one
alone. All others are dealt evenly over blocks of bounded size; within a block
they are placed best-fit in order of falling length, and then pieces are
exchanged between bins that have room: a move, or a swap of one for one or of
two for one, is taken when it raises the sum of the squared fills, until the
emptier bins run empty or nothing helps.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.base import blocks, stored, table, texts

LENGTH = 2048
TOKENIZER = "word_bpe_49k.json"
BLOCK = 20_000
CACHED_CHUNKS = 200_000
_ROWS = 64
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"


class Encoder:
    """Token ids of whole texts, as little-endian bytes, by way of the ids of their chunks between spaces.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its chunks in a row; chunks are kept, up to a bound and those of
    one batch: when half of it is full, it takes the other half's place, from which
    chunks that are met again come back, so frequent ones are learned once. New
    chunks of Latin characters are lower-cased and cut as the tokenizer's pattern cuts
    them, all of a batch as one string, and the pieces are merged by the same
    vocabulary and ranks in one call, with a zero byte for the end of a word. Every
    other chunk goes to the tokenizer itself.
    """

    def __init__(self, path: str, most: int = CACHED_CHUNKS):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        special = {token.content for token in self.tokenizer.get_added_tokens_decoder().values()}
        as_byte = {name: value for value, name in _byte_names().items()}
        ranks, self.ends = {}, np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            if token not in special:
                stem = token.removesuffix("</w>")
                self.ends[number] = stem != token
                ranks[bytes(as_byte[c] for c in stem) + bytes(stem != token)] = number
        self.merges = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
        letters, digits = (_latin(kind) for kind in "LN")
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{_SPACE}{letters}{digits}]+")
        # Without the white space that stands in chunks; line feeds part the chunks.
        self.plain = re.compile("[\x01-\x08\n\x0e-\x1f!-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]+")
        self.most = most
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        own, rest = list(chunks), []
        joined = "\n".join(own)
        if "<|" in joined or not self.plain.fullmatch(joined):
            known = [self.plain.fullmatch(chunk) is not None and "<|" not in chunk for chunk in own]
            rest = [chunk for chunk, plain in zip(own, known) if not plain]
            own = [chunk for chunk, plain in zip(own, known) if plain]
            joined = "\n".join(own)
        if own:
            cut = self.pieces.sub("\\g<0>\0", joined.lower() + "\n")
            marks = np.frombuffer(cut.encode(), np.uint8)
            counts = np.cumsum(marks == 0)[marks == 10]
            ids = np.array(self.merges.encode_ordinary(cut.replace("\n", "")), "<u4")
            ends = 4 * np.nonzero(self.ends[ids])[0] + 4
            if len(ends) != counts[-1]:
                raise ValueError("a piece without one token that ends it")
            raw, low = ids.tobytes(), 0
            for chunk, stop in zip(own, ends[counts - 1].tolist()):
                self.chunks[chunk] = raw[low:stop]
                low = stop
        if rest:
            for chunk, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                self.chunks[chunk] = np.array(found.ids, "<u4").tobytes()

    def encode(self, batch: list[str | None]) -> Iterator[bytes]:
        cut = [(text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for text in batch]
        new = set().union(*cut).difference(self.chunks)
        if len(self.chunks) + len(new) > self.most // 2:
            self.older, self.chunks = self.chunks, {}
            new = set().union(*cut)
        met = [chunk for chunk in new if chunk in self.older]
        self.chunks.update((chunk, self.older[chunk]) for chunk in met)
        new.difference_update(met)
        if "" in new:
            self.chunks[""] = b""
            new.remove("")
        if new:
            self.learn(new)
        get = self.chunks.__getitem__
        for chunks in cut:
            yield b"".join(map(get, chunks))


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def _latin(kind: str) -> str:
    """The characters below U+0250 of a general category, for a character class."""
    return "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


def tokenized(docs: DataFrame, path: str, length: int = LENGTH, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """The pieces of each row: key, piece, start, length, ids_crc32, and with `ids` the ids themselves.

    A document is its ids, then id 0, cut every `length` ids; a null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                keys, pieces, starts, lengths, sums, kept = [], array("i"), array("q"), array("q"), array("q"), []
                for row, raw in enumerate(encoder.encode([t for (t,) in texts([part], "text")])):
                    raw += bytes(4)
                    for piece, at in enumerate(range(0, len(raw), 4 * length)):
                        own = raw[at : at + 4 * length]
                        keys.append(row)
                        pieces.append(piece)
                        starts.append(at // 4)
                        lengths.append(len(own) // 4)
                        sums.append(zlib.crc32(own))
                        if ids:
                            kept.append(np.frombuffer(own, "<u4").astype(np.int32))
                columns = [part.column(0).take(pa.array(keys, pa.int64()))]
                columns += [pa.array(np.asarray(c)) for c in (pieces, starts, lengths, sums)]
                if ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions: each piece, longest first, into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        size = lengths[k]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            which = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[which].append(k)
        else:
            room, which = capacity, len(bins)
            bins.append([k])
        left = room - size
        by_room[left].append(which)
        rooms |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int, width: int = 100, patience: int = 200) -> list[list[int]]:
    """Local search among the bins with room: fill other bins from the emptiest, which run empty.

    Each step puts more into a bin than it takes out, out of a bin that is no
    fuller, so the sum of squared fills rises with each step and the search ends.
    A bin gives to the `width` bins with most room; the search stops after
    `patience` bins in a row that don't run empty.
    """
    fill = [sum(lengths[k] for k in b) for b in bins]
    order = sorted((n for n in range(len(bins)) if fill[n] < capacity), key=lambda n: (fill[n], n))
    idle = 0
    for low, giver in enumerate(order):
        for taker in order[low + 1 : low + 1 + width]:
            while bins[giver] and fill[giver] <= fill[taker] < capacity:
                step = _step(bins[giver], bins[taker], lengths, capacity - fill[taker])
                if step is None:
                    break
                given, taken = step
                bins[giver] = [k for k in bins[giver] if k not in given] + taken
                bins[taker] = [k for k in bins[taker] if k not in taken] + given
                gain = sum(lengths[k] for k in given) - sum(lengths[k] for k in taken)
                fill[giver] -= gain
                fill[taker] += gain
            if not bins[giver]:
                break
        idle = idle + 1 if bins[giver] else 0
        if idle >= patience:
            break
    return [b for b in bins if b]


def _step(giver: list[int], taker: list[int], lengths: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """The pieces to give and to take back that fill most of `room`: a move, one for one, or two for one."""
    own = sorted((lengths[k], k) for k in giver)
    sizes = [s for s, _ in own]
    best, found = 0, None
    at = bisect_right(sizes, room) - 1
    if at >= 0:
        best, found = sizes[at], ([own[at][1]], [])
    for k in taker:
        limit = room + lengths[k]
        at = bisect_right(sizes, limit) - 1
        if at >= 0 and sizes[at] - lengths[k] > best:
            best, found = sizes[at] - lengths[k], ([own[at][1]], [k])
        for first in range(len(own)):
            at = min(bisect_right(sizes, limit - sizes[first]) - 1, len(own) - 1)
            if at > first and sizes[first] + sizes[at] - lengths[k] > best:
                best, found = sizes[first] + sizes[at] - lengths[k], ([own[first][1], own[at][1]], [k])
    return found


def pack(docs: DataFrame, path: str, length: int = LENGTH, key: str = "doc_id", text: str = "text", block: int = BLOCK, ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id and offset in the sequence.

    Null and empty texts are the single id 0. Only documents longer than a
    sequence are cut. Repeated rows are packed as often as they occur; columns
    other than key and text are not read; an empty table gives an empty result.
    """
    pieces = stored(tokenized(docs, path, length, key, text, ids), "pieces")
    count = blocks(pieces.count(), block)
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 4 * block:
                yield from placed(held, first)
                first += rows
                held, rows = [], 0
        yield from placed(held, first)

    def placed(held: list[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths = rows.column("length").to_pylist()
        short = [k for k, n in enumerate(lengths) if n < length]
        own = [lengths[k] for k in short]
        bins = [[k] for k, n in enumerate(lengths) if n >= length]
        bins += [[short[k] for k in b] for b in improve(best_fit(own, length), own, length)]
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, members in enumerate(bins):
            at = 0
            for k in members:
                sequence[k], offset[k] = first + number, at
                at += lengths[k]
        rows = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from rows.to_batches()

    dealt = pieces.repartition(count)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    packed = dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")
    return packed.select(F.col("key").alias(key), *names[1:])


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
