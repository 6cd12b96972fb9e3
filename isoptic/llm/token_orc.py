"""Token ids as ORC files.

Documents are dealt by id range, encoded, and written in ascending order by
Spark's ORC writer: ids are run-length encoded integers, stripes can be read in
parallel, and each has a row index and a Bloom filter on the document id, so a
look-up reads the metadata and the row groups that may hold it.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .store import small_batches

FIELDS = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
#: Words whose ids a worker remembers, at about 40 bytes each.
REMEMBER = 3_000_000


#: The normaliser's and the splitter's steps under which a text's ids are those
#: of its words, as tokenizer files write them.
WORDWISE = [
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
]
#: A word that stands between others when many are encoded at once.
BETWEEN = "\x01"
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,:;!?"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[i for i in range(128) if chr(i).isalnum()]] = True


def splits_at_words(tokenizer: dict) -> bool:
    """Whether a tokenizer file says that a text's ids are those of its words in
    turn, whatever their case: its normaliser and splitter are ``WORDWISE``, no
    added token has or takes in white space, and pieces are merged one by one."""
    added = tokenizer.get("added_tokens") or []
    plain = all(not (x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]) and "<" in x["content"] and not x["content"].split()[1:] for x in added)
    model = tokenizer["model"]
    steps = [(tokenizer.get("normalizer") or {}).get("normalizers"), (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers")]
    return plain and steps == WORDWISE and model["type"] == "BPE" and not model.get("dropout") and not any(tokenizer.get(k) for k in ("truncation", "padding", "post_processor"))


class Encoder:
    """A tokenizer that encodes each distinct word once, if its file allows it
    (``splits_at_words``), and else whole texts.

    Where it does, white space separates the tokenizer's pieces and is dropped,
    case is dropped too, and punctuation after an ASCII letter or digit is a
    piece of its own; so the ids of a text are those of its lower-cased words and
    of the punctuation behind them, one after the other.
    """

    def __init__(self, vocabulary: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(vocabulary), end_id
        with open(vocabulary, encoding="utf-8") as f:
            self.wordwise = splits_at_words(json.load(f))
        self.between = self._ids([BETWEEN])[0] if self.wordwise else []
        self.forget()

    def forget(self) -> None:
        """Only the end id is known, at the start of the ids."""
        self.hash, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.array([self.end_id], np.int32)

    def _ids(self, strings: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The strings' ids and their counts."""
        ids, sizes = [], []
        for at in range(0, len(strings), 200):
            part = strings[at : at + 200]
            if len(self.between) == 1 and not any(BETWEEN in x for x in part):
                got = np.array(self._ids([f" {BETWEEN} ".join(part)])[0], np.int32)
                cut = np.flatnonzero(got == self.between[0])
                sizes.append(np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1)
                ids.append(np.delete(got, cut))
            else:
                every = self._ids(part)
                sizes.append(np.array([len(x) for x in every]))
                ids.append(np.array([i for x in every for i in x], np.int32))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each ended by the end id, and where each begins."""
        if not self.wordwise:
            every = [[*x, self.end_id] for x in self._ids(texts.fill_null("").to_pylist())]
            return np.array([i for x in every for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in every], dtype=np.int64)])
        w = tokens.words(texts)
        data = tokens.LOWER[w.data]
        marked = np.flatnonzero(w.data == ord("<"))  # special tokens keep their case
        for k in np.unique(np.searchsorted(w.start, marked, "right") - 1) if len(marked) else ():
            data[w.start[k] : w.end[k]] = w.data[w.start[k] : w.end[k]]
        cut, more = w.end.copy(), np.arange(len(w.end))
        while len(more):
            more = more[(cut[more] - w.start[more] > 1) & _TAIL[data[cut[more] - 1]]]
            cut[more] -= 1
        tail = np.flatnonzero((cut < w.end) & _ALNUM[data[np.maximum(cut - 1, 0)]] if len(data) else cut < 0)
        end = w.end.copy()
        end[tail] = cut[tail]
        start, end = np.insert(w.start, tail + 1, cut[tail]), np.insert(end, tail + 1, w.end[tail])
        first = w.first + np.searchsorted(tail, w.first)

        kinds, at, which = np.unique(tokens.hash_spans(data, start, end), return_index=True, return_inverse=True)
        if len(self.hash) + len(kinds) > REMEMBER:
            self.forget()
        place = np.searchsorted(self.hash, kinds)
        new = np.flatnonzero(self.hash[np.minimum(place, len(self.hash) - 1)] != kinds) if len(self.hash) else np.arange(len(kinds))
        if len(new):
            raw = data.tobytes()
            ids, sizes = self._encoded([raw[a:b].decode() for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
            self.begin = np.insert(self.begin, place[new], len(self.flat) + np.cumsum(sizes) - sizes)
            self.size, self.hash = np.insert(self.size, place[new], sizes), np.insert(self.hash, place[new], kinds[new])
            self.flat = np.concatenate([self.flat, ids])
        known = np.searchsorted(self.hash, kinds)
        # The end id stands after each text's words.
        begin, n = np.insert(self.begin[known][which], first[1:], 0), np.insert(self.size[known][which], first[1:], 1)
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends[first[1:] + np.arange(len(first) - 1)]])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(vocabulary: str, end_id: int) -> Encoder:
    """One for each worker process."""
    if (vocabulary, end_id) not in _ENCODERS:
        _ENCODERS[vocabulary, end_id] = Encoder(vocabulary, end_id)
    return _ENCODERS[vocabulary, end_id]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = STRIPE_BYTES) -> None:
    """Write one row for each of ``docs``: ``doc_id``, ``part``,
    ``start_in_part``, ``n_tokens`` and ``ids``.

    Parts ascend with the id, rows within a part too; rows that repeat an id
    are in the order of their texts. A null text is empty, and an empty text
    has the end id alone. A null id comes first. ``vocabulary`` is a file that
    every executor has; where its rules don't cut texts at words, whole texts go
    through the tokenizer. An empty table gives a folder without rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(vocabulary, end_id), TaskContext.get().partitionId(), 0
        for batch in tokens.pieces(batches, "text"):
            ids, off = encoder.encode(batch.column("text"))
            n = np.diff(off)
            yield pa.record_batch(
                [batch.column("id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + off[:-1]), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )
            at += int(off[-1])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(encode, FIELDS)
    (
        dealt.write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The rows of ``write_tokens``; with ``ids``, only theirs, by way of the
    files' statistics, row indexes and Bloom filters."""
    found = spark.read.schema(FIELDS).orc(path)
    return found if ids is None else found.where(F.col("doc_id").isin(ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids before it in all files), ``n_tokens`` and
    ``ids_crc32``, from the files."""
    files = read_tokens(spark, path)
    # One row a part; the window runs over these alone.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            off = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"), pa.array(np.diff(off).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = files.select("doc_id", "part", "start_in_part", "ids").mapInArrow(crc, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(parts, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
