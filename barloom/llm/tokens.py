"""Public tokenizers inside tasks, and token ids in ORC files.

Texts are cut where white space follows a word. No pre-token of the tokenizers used here spans such
a cut, so the ids of a text are the ids of its words joined. A slice of texts is cut and its words
are numbered by Arrow; only its distinct words are looked up, in a memory of bounded size, and those
not found go to the tokenizer. Numpy puts the ids of all words back in order.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import NO_ID, shared_folder

#: Parts whose ids a worker keeps; later ones are encoded each time.
MEMO_PARTS = 400_000
#: Longer parts are encoded each time.
MEMO_CHARS = 48
#: Bytes of text handled at once in a worker.
STEP_BYTES = 1 << 20
# How the tokenizers cut printable ASCII words, and white space by Unicode without blank and line end.
LOWER_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 ]+")
SPACES = r"\t\x{0b}-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that are encoded whole: what is white space to Arrow but not to the tokenizers.
_ODD = r"[\x{00}\x{1c}-\x{1f}]"
#: The same where blanks belong to words: white space other than single blanks and line ends between words.
_UNEVEN = rf"[{SPACES}\x{{00}}\x{{1c}}-\x{{1f}}]|[ \n][ \n]|^[ \n]|[ \n]\z"


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return dict(zip(plain + sorted(set(range(256)) - set(plain)), map(chr, [*plain, *range(256, 512)]), strict=False))


_BYTE_LETTERS = byte_letters()
_BLANK = _BYTE_LETTERS[32]
#: Marks a text's first word where blanks belong to words.
_FIRST = "\0"


class PartEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit integers; holds the ids (bytes) of words and their pieces.

    To tokenizers that keep white space a key stands for the word after a blank, and marks a word
    after a line end by that and a text's first word by _FIRST.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _model(self, piece: str) -> bytes:
        """One pre-token, straight to the tokenizer's model."""
        letters = piece.replace(" ", _BLANK) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _pieces(self, cut: list[str]) -> bytes:
        """Pre-tokens that make up a part; each but a part's only one has a key of its own."""
        if len(cut) == 1:
            return self._model(cut[0])
        if self.lowers:
            return b"".join([self[c] for c in cut])
        return b"".join([self[c[1:] if c[0] == " " else _FIRST + c] for c in cut])

    def _normal(self, word: str) -> str | None:
        """The normalised word where it is one run of common letters before and after, else None."""
        if not word.isalpha() or max(word) > "\u052f":
            return None
        if self.lowers:
            if "\u03a3" in word or not unicodedata.is_normalized("NFC", word):
                return None
            word = word.lower()
        return word if word.isalpha() else None

    def _fresh(self, part: str) -> bytes:
        if self.lowers:
            lead, word = "", part
        elif part[0] == "\n":
            return self[_FIRST + "\n"] + self[_FIRST + part[1:]] if len(part) > 1 else self._whole(part)
        else:
            lead, word = ("", part[1:]) if part[0] == _FIRST else (" ", part)
        if word.isascii() and word.isprintable():
            if "<|" not in word:
                return self._pieces(LOWER_PIECES.findall(word.lower()) if self.lowers else BYTE_PIECES.findall(lead + word))
        elif (normal := self._normal(word)) is not None:
            return self._model(lead + normal)
        elif word[-1] in ".," and (normal := self._normal(word[:-1])) is not None:
            return self._pieces([lead + normal, word[-1]])
        return self._whole(lead + word)

    def __missing__(self, part: str) -> bytes:
        ids = self._fresh(part) if part.strip(_FIRST) else b""
        if len(part) <= MEMO_CHARS and len(self) < MEMO_PARTS:
            self[part] = ids
        return ids

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, pa.ListArray]:
        """(which texts must be encoded whole, words of the others)."""
        whole = pc.match_substring_regex(texts, _ODD if self.lowers else _UNEVEN)
        texts = pc.if_else(whole, "", texts)
        if self.lowers:
            # as the tokenizer does; texts that may hold special tokens are spared
            plain = pc.and_not(pc.string_is_ascii(texts), pc.match_substring(texts, "<|"))
            return whole, pc.utf8_split_whitespace(pc.if_else(plain, pc.ascii_lower(texts), texts))
        marked = pc.binary_join_element_wise(_FIRST, pc.replace_substring(texts, "\n", " \n"), "")
        return whole, pc.split_pattern(marked, " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids of each); a null text counts as empty."""
        texts = texts.fill_null("")
        whole, parts = self._parts(texts)
        words = parts.flatten().dictionary_encode()
        codes = np.asarray(words.indices)
        found = [self[w] for w in words.dictionary.to_numpy(zero_copy_only=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table, begins = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = table[np.repeat(begins[codes] - ends[:-1], each) + np.arange(ends[-1])]
        ends = ends[np.concatenate([[0], np.cumsum(np.asarray(parts.value_lengths()))])]
        rows = np.flatnonzero(np.asarray(whole))
        if not len(rows):
            return ids, np.diff(ends)
        counts, out, at = np.diff(ends), [], 0
        for r in rows:
            own = np.frombuffer(self._whole(texts[int(r)].as_py()), "<u4")
            out += [ids[at : ends[r]], own]
            counts[r], at = len(own), ends[r]
        return np.concatenate([*out, ids[at:]]), counts


@lru_cache(maxsize=4)
def encoder(path: str) -> PartEncoder:
    """One for each tokenizer file in a worker process."""
    return PartEncoder(path)


def forget() -> None:
    """Free the tokenizers and words that this worker process keeps: Spark gives it tasks of other operators, too."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        pa.default_memory_pool().release_unused()


def steps(batch: pa.RecordBatch, column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `size` bytes of text, or one row."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)))
    i, base = 0, 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, base + size, side="right")))
        yield batch.slice(i, j - i)
        i, base = j, int(sizes[j - 1])


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices with the ids of all rows, each text's followed by the end id, and the number of each row's; a null text counts as empty."""
    tokenizer = encoder(path)
    for batch in batches:
        for part in steps(batch, column):
            ids, sizes = tokenizer.encode(part.column(column))
            yield part, np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


STORED = "doc_id long, shard int, place long, n_tokens long, tokens array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs and write (doc_id, shard, place, n_tokens, tokens) as ORC in ascending id order.

    Files are ranges of ids, so they sort one after another and each is one shard; place counts the
    shard's ids before a row. Token arrays are integer runs, every stripe has a row index, and ids
    have a Bloom filter: a reader that asks for a few ids skips files, stripes and row groups.

    A null id is the greatest one; rows of one id stay next to each other in the order of their
    texts' hashes; other columns are ignored; an empty table writes an empty folder with a schema.
    """
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("d"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # the last key only spreads whole copies of a row
    rows = rows.repartitionByRange("d", "h", F.monotonically_increasing_id()).sortWithinPartitions("d", "h").select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def encode(batches):
        at = 0
        for part, ids, sizes in encoded(batches, tokenizer_path, end_id):
            ends = np.cumsum(sizes)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("shard"), pa.array(at + ends - sizes), pa.array(sizes), tokens], ["doc_id", "shard", "place", "n_tokens", "tokens"])
            at += int(ends[-1])

    out = rows.mapInArrow(encode, STORED)
    (
        out.write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", 16 << 20)
        .option("orc.row.index.stride", 2_000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; filters on doc_id reach the files' statistics and Bloom filters."""
    return spark.read.schema(STORED).orc(path)


def token_index(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the stored rows; start counts all ids before a document."""

    def sums(batches):
        for b in batches:
            tokens = b.column("tokens")
            values, sizes = np.ascontiguousarray(tokens.flatten()).view("<u4"), np.asarray(tokens.value_lengths()).astype(np.int64)
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(values[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("shard"), b.column("place"), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "shard", "place", "n_tokens", "ids_crc32"])

    rows = stored.select("doc_id", "shard", "place", "tokens").mapInArrow(sums, "doc_id long, shard int, place long, n_tokens long, ids_crc32 long")
    # a row for each file in the one window over everything
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def store_tokens(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write docs to the shared folder and index what the files hold."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_token_orc(docs, path, tokenizer_path, end_id)
    return token_index(read_token_orc(docs.sparkSession, path))
