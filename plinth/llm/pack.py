"""Token-ID output: tokenize, split, and pack by best-fit decreasing.

Each document is tokenized whole and ends with the end token; the pieces of a document longer than a sequence are
split losslessly. Within a task, pieces gather to blocks of BLOCK_TOKENS; a block is packed by best-fit decreasing, the
longest piece first, each into the sequence with the least room that still takes it. A segment tree over the
room left finds that sequence. Nothing is shuffled, and memory holds one block.

A row of the result is a packed sequence: pack_id, input_ids (seq_len ids of 2 or 4 bytes each, little-endian, padded with
the end token), n_tokens, cu_seqlens (segment s is cu_seqlens[s] to cu_seqlens[s + 1]), position_resets (where positions start
again at 0), doc_ids and doc_offsets (of which document a segment is, and from which of its tokens on).

Cases: null and empty texts are one end token. Repeated rows are packed each time. Null ids stay null in doc_ids. An
empty table gives no rows. Whole numbers are ids; what does not cast to long is null. A text over CUT characters is tokenized in parts that end before
a single space between other characters, where the pattern always starts a new piece, so token ids are those of the whole text; a text without
such a space is tokenized whole.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this vocabulary splits text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_TOKEN, SEQ_LEN, BLOCK_TOKENS, CUT = 50256, 2048, 4 << 20, 200_000


class RoomTree:
    """Which amounts of room some open sequence has: add, remove and smallest at least, each in log(seq_len) steps."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int = 1) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def at_least(self, room: int) -> int:
        """The smallest room of that much or more; -1 if there is none."""
        i = room + self.leaves
        if self.count[i]:
            return room
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # the first full subtree to the right
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(lengths: np.ndarray, seq_len: int) -> list[list[int]]:
    """The pieces of each sequence, by best-fit decreasing; ties keep their order."""
    bins: list[list[int]] = []
    tree, open_bins = RoomTree(seq_len), [[] for _ in range(seq_len + 1)]
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        room = tree.at_least(need)
        if room < 0:
            room, b = seq_len, len(bins)
            bins.append([])
        else:
            b = open_bins[room].pop()
            tree.add(room, -1)
        bins[b].append(piece)
        if room > need:
            open_bins[room - need].append(b)
            tree.add(room - need)
    return bins


def _parts(text: str, cut: int) -> list[str]:
    """Parts of about cut characters, which give the token ids of the whole."""
    out, at = [], 0

    def between(i: int) -> bool:
        return 0 < i < len(text) - 1 and not text[i - 1].isspace() and not text[i + 1].isspace()

    while len(text) - at > cut:
        to = text.rfind(" ", at + 1, at + cut)
        while to > at and not between(to):
            to = text.rfind(" ", at + 1, to)
        if to <= at:
            to = text.find(" ", at + cut)
            while to >= 0 and not between(to):
                to = text.find(" ", to + 1)
            if to < 0:
                break
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def pack_tokens(documents: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str = TOKENIZER, pattern: str = PATTERN, end_token: int = END_TOKEN, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()  # a vocabulary file of a fixed size, under 1 MB
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)
    dtype = "<u2" if end_token < 1 << 16 and vocabulary.count(b"\n") < 1 << 16 else "<u4"

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines()) if a}
        encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        serial = TaskContext.get().partitionId() << 33
        pieces, held = [], 0

        def encode(text: str) -> np.ndarray:
            ids = [np.array(encoding.encode_ordinary(x), dtype) for x in _parts(text, CUT)]
            return np.concatenate([*ids, np.array([end_token], dtype)])

        def packed(pieces):
            nonlocal serial
            bins = best_fit(np.array([len(ids) for _, _, ids in pieces]), seq_len)
            for at in range(0, len(bins), 1024):
                rows = [[], [], [], [], [], [], []]
                for members in bins[at : at + 1024]:
                    ids = np.full(seq_len, end_token, dtype)
                    joined = np.concatenate([pieces[p][2] for p in members])
                    ids[: len(joined)] = joined
                    ends = np.cumsum([0, *(len(pieces[p][2]) for p in members)]).tolist()
                    for column, x in zip(rows, (serial, ids.tobytes(), len(joined), ends, ends[:-1], [pieces[p][0] for p in members], [pieces[p][1] for p in members]), strict=True):
                        column.append(x)
                    serial += 1
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)], ["pack_id", "input_ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"])

        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for i in range(batch.num_rows):
                tokens = encode(texts[i].as_py() or "")
                doc_id = ids[i].as_py()
                pieces += [(doc_id, at, tokens[at : at + seq_len]) for at in range(0, len(tokens), seq_len)]
                held += len(tokens)
                if held >= block_tokens:
                    yield from packed(pieces)
                    pieces, held = [], 0
        if pieces:
            yield from packed(pieces)

    return documents.select(F.expr(f"try_cast(`{id_col}` AS bigint)").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pack_id long, input_ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>")


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
