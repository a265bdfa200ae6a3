"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters.

Documents are dealt into ranges of doc_id and sorted, encoded range by range,
and written as one ORC file a range: the ids as an integer list (ORC's own
run-length encoding), a row index every ``stride`` rows and a Bloom filter on
doc_id, so that stripes are read in parallel and a look-up by id skips the rest.

Tokenizers whose own definition is the one this module knows (NFC, white space to
blanks, lower case; letters, digits one by one, and runs of the rest; pieces end
with </w>) are encoded by piece: texts are cut together here, as the definition
says, and the tokenizer's own model encodes each different piece once.  Texts with
characters beyond Latin Extended-B, or with marks of special tokens, are encoded
whole, and so are all texts by any other tokenizer.

Defined cases: a null text is encoded as an empty one (only the end id); rows
with a null doc_id come first; rows that share a doc_id stay together in an
order by text; an empty table gives an empty file set.  Extra columns are not
written.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import new_path, stored

#: Pieces that each of a worker's two tables remembers (about 50 MB each).
REMEMBERED = 250_000
#: The definition of a tokenizer that encodes by piece.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: The same split for texts up to Latin Extended-B: letters, numbers, white space.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: Characters whose texts are encoded whole: other scripts, and one that grows in lower case.
_WHOLE = "[^\x00-\u012f\u0131-\u024f]"
#: Characters of texts that are cut together, unless one text has more.
TOGETHER = 1_000_000
_END = "</w>"
_SPACE, _LETTER, _NUMBER, _OTHER, _FOREIGN = range(5)
_ENCODERS: dict[str, Encoder] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code unit of UTF-16."""
    kinds, lower = np.full(1 << 16, _FOREIGN, "u1"), np.arange(1 << 16, dtype="<u2")
    for c in map(chr, range(0x250)):
        if not re.match(_WHOLE, c):
            kinds[ord(c)] = next((k for k, of in ((_LETTER, _L), (_NUMBER, _N), (_SPACE, _S)) if re.match(f"[{of}]", c)), _OTHER)
            lower[ord(c)] = ord(c.lower())
    return kinds, lower


_KIND, _LOWER = _tables()


def cut(units: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code units that are no white space, and where in them and in
    units each piece starts: where the class changes, at each number, and around
    'S 'T 'M 'D 'RE 'VE 'LL behind anything but a run of other characters."""
    low, solid = _LOWER[units], kinds != _SPACE
    first = solid.copy()
    first[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
    at = np.flatnonzero((low == ord("'")) & first)
    if len(at):
        padded = np.concatenate([low, np.zeros(2, low.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        first[at[short | long] + 1] = False
        behind = np.concatenate([at[short] + 2, at[long] + 3])
        behind = behind[behind < len(first)]
        first[behind] = solid[behind]
    return low[solid], np.flatnonzero(first[solid]), np.flatnonzero(first)


def different(low: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The pieces that occur in low, which start at at, each once, and which of them
    stands at each place."""
    offsets = np.append(at, len(low)) * 2
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
    n, once = len(found.dictionary), found.dictionary.buffers()
    if not n:
        return [], np.zeros(0, np.int32)
    ends = np.frombuffer(once[1], np.int64, n + 1)[1:] // 2
    spaced = np.insert(np.frombuffer(once[2], "<u2", ends[-1]), ends[:-1], ord("\n"))
    return spaced.tobytes().decode("utf-16-le").split("\n"), found.indices.to_numpy()


def splits_by_piece(definition: dict) -> bool:
    """Whether a tokenizer's own definition is the one that allows pieces to be
    encoded each for itself."""
    model = definition.get("model") or {}
    return all(definition.get(k) == v for k, v in KNOWN.items()) and not definition.get("post_processor") and not definition.get("truncation") and not definition.get("padding") and model.get("type") == "BPE" and model.get("end_of_word_suffix") == _END and not model.get("dropout") and all(t["content"].startswith("<|") for t in definition.get("added_tokens") or ())


class Encoder:
    """Texts to ids as little-endian 32-bit integers.

    By piece: texts are cut together into the tokenizer's own pieces, each that
    occurs is looked up once, new ones are encoded by the tokenizer's model and
    remembered, and the ids are dealt out to where the pieces stand."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = splits_by_piece(json.loads(self.tokenizer.to_str()))
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        # Lower-cased characters as the pre-tokenizer hands them to the model.
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        self.bytewise = {c: plain.pre_tokenize_str(chr(c))[0][0] for c in {*range(0x250), *_LOWER[:0x250].tolist()}}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def learn(self, pieces: list[str]) -> list[bytes]:
        ids = [[t.id for t in self.model.tokenize(p.translate(self.bytewise))] for p in pieces]
        flat, ends = np.fromiter(chain.from_iterable(ids), dtype="<i4").tobytes(), list(accumulate(map(len, ids), initial=0))
        return [flat[4 * i : 4 * j] for i, j in pairwise(ends)]

    def recall(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces.  What is remembered has two ages: when the young
        table is full it becomes the old one, and of the old one only what is wanted
        again comes over; so pieces that return stay."""
        out = list(map(self.known.get, pieces))
        missing = [i for i, ids in enumerate(out) if ids is None]
        wanted = [pieces[i] for i in missing]
        again = list(map(self.old.get, wanted))
        new = iter(self.learn([p for p, ids in zip(wanted, again, strict=True) if ids is None]))
        found = [next(new) if ids is None else ids for ids in again]
        for i, ids in zip(missing, found, strict=True):
            out[i] = ids
        if len(self.known) + len(found) > REMEMBERED:
            self.old, self.known = self.known, {}
        self.known.update(islice(zip(wanted, found, strict=True), REMEMBERED))
        return out

    def together(self, texts: list[str]) -> list[bytes]:
        units = np.frombuffer(b"\n\0".join([*(coded := [t.encode("utf-16-le") for t in texts]), b""]), dtype="<u2")
        starts = np.cumsum([0] + [len(x) // 2 + 1 for x in coded])
        kinds = _KIND[units]
        foreign = np.searchsorted(starts, np.flatnonzero(kinds == _FOREIGN), "right") - 1
        whole = {*np.unique(foreign).tolist(), *(i for i, t in enumerate(texts) if "<|" in t)}
        for i in whole:
            kinds[starts[i] : starts[i + 1]] = _SPACE
        low, at, stands = cut(units, kinds)
        pieces, which = different(low, at)
        ids = self.recall(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = sizes[which]
        ends = np.cumsum(n)
        source = np.repeat((np.cumsum(sizes) - sizes)[which] - ends + n, n) + np.arange(n.sum())
        out = np.frombuffer(b"".join(ids), dtype="<i4")[source].tobytes()
        limits = (np.append(0, ends)[np.searchsorted(stands, starts)] * 4).tolist()
        return [self.whole(t) if i in whole else out[limits[i] : limits[i + 1]] for i, t in enumerate(texts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [self.whole(t) for t in texts]
        out, at = [], 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and (size := size + len(texts[to])) <= TOGETHER:
                to += 1
            out += self.together(texts[at:to])
            at = to
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, partitions: int | None = None, stride: int = 10_000, stripe_mb: int = 64) -> None:
    """Write doc_id, seq (row in its file), ids of every row of docs to path."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seq, end = encoder(tokenizer), 0, np.int32(end_id).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                parts = [x + end for x in own.encode([x or "" for x in b.column("text").to_pylist()])]
                ends = np.cumsum([0] + [len(x) // 4 for x in parts]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.arange(seq, seq + b.num_rows)), ids], ["doc_id", "seq", "ids"])
                seq += b.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(*([partitions] if partitions else []), F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    out = rows.mapInArrow(encoded, "doc_id long, seq long, ids array<int>")
    out.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", str(stride)).option("orc.stripe.size", str(stripe_mb << 20)).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids, and where a row stands: file (part number) and seq."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return spark.read.schema("doc_id long, seq long, ids array<int>").orc(path).select("doc_id", "ids", part.alias("file"), "seq")


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """read_tokens() of some documents: the filter goes to the ORC reader, which by
    file and stripe statistics, row index and Bloom filters reads only where they
    may be."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(*doc_ids))


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from rows of read_tokens()."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False), np.diff(ids.offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(ends)])
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("file"), b.column("seq"), pa.array(ends.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "seq", "n_tokens", "ids_crc32"])

    rows = stored(tokens.mapInArrow(summed, "doc_id long, file int, seq long, n_tokens long, ids_crc32 long"), "token-digests")
    # The files' totals are one row a file; the running total inside a file
    # stays inside its range of ids.
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("words"))
    files = files.select("file", (F.sum("words").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).alias("file_start"))
    inside = F.sum("n_tokens").over(W.partitionBy("file").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(files, "file").select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, **how) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, **how)
    return token_digest(read_tokens(spark, path))
