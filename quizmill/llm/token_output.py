"""Token ids of documents in ORC files: encode, write in id order, read back whole, by range or by id.

ORC stores the ids with integer run-length encoding (bit-packed), keeps row indexes per stride and Bloom filters on the
document id, and can be read by stripes in parallel; a predicate on the id prunes files, stripes and strides by metadata.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizmill.llm.common import release, shared_dir, table
from quizmill.llm.jaccard_join import chunks

#: A file holds about this many bytes of text; the longest document is the only thing that may exceed it.
FILE_BYTES = 64_000_000
#: Texts are encoded in chunks of about this many bytes, each distinct word of a chunk once.
CHUNK_BYTES = 2 << 20
#: A Python worker remembers the ids of so many words of letters, about 7 MB; beyond that, of those of the last chunk.
KNOWN_WORDS = 200_000

SCHEMA = "doc_id long, local_start long, n_tokens long, ids array<int>"


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: ASCII marks other than the apostrophe: after letters, the vocabulary's pattern parts them as a token of their own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE = str.maketrans({chr(b): c for b, c in byte_letters().items() if chr(b) != " "})
#: White space outside ASCII, which parts words too.
_SPACES = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces ``values[start : start + size]``, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return values[at]


def after(words: pa.Array, begins: pa.Array) -> pa.Array:
    """What follows in each of ``words`` after its beginning."""
    sizes = np.asarray(pc.binary_length(words), np.int64)
    skipped = np.asarray(pc.binary_length(begins), np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)].astype(np.int64)
    tails = gathered(data, starts + skipped, sizes - skipped)
    offsets = np.concatenate(([0], np.cumsum(sizes - skipped))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(tails)])


class Pieces:
    """Token ids of many strings in one array."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, found) -> Pieces:
        """From encodings of the library."""
        return cls(np.concatenate([np.asarray(e.ids, "<u4") for e in found] or [np.empty(0, "<u4")]), np.array([len(e.ids) for e in found], np.int64))

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces(gathered(self.ids, self.starts[at], self.sizes[at]), self.sizes[at])

    def summed(self, counts: np.ndarray) -> np.ndarray:
        """Ids of groups of so many consecutive strings."""
        run = np.concatenate(([0], np.cumsum(self.sizes)))
        ends = np.cumsum(counts)
        return run[ends] - run[ends - counts]

    def __add__(self, other: Pieces) -> Pieces:
        return Pieces(np.concatenate((self.ids, other.ids)), np.concatenate((self.sizes, other.sizes)))


class Encoder:
    """Encodes texts word by word (a word is what white space separates, which this vocabulary never joins), so that each
    distinct word of a chunk is encoded once. Words of Latin letters go straight to the tokenizer's model, many at a time;
    others pass all its steps. Built on first use in the worker, per path."""

    loaded: dict = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = self.tokenizer.to_str()
        self.by_word = '"\\\\s+"' in spec and '"end_of_word_suffix":"</w>"' in spec and '"Lowercase"' in spec and '"NFC"' in spec
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known, self.held = pa.array([], pa.string()), Pieces(np.empty(0, "<u4"), np.empty(0, np.int64))

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.loaded:
            release()
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    @classmethod
    def forget(cls) -> None:
        """Drop what this worker holds, in a stage that encodes nothing more; it would be built anew if it did."""
        if cls.loaded:
            cls.loaded.clear()
            release()

    def whole(self, words: list[str]) -> Pieces:
        """By all steps of the tokenizer."""
        return Pieces.of([e for i in range(0, len(words), 1000) for e in self.tokenizer.encode_batch_fast(words[i : i + 1000], add_special_tokens=False)])

    def bulk(self, words: list[str], write) -> Pieces:
        """Words that ``write`` turns into the model's letters, 1,000 at a time; the tokens that end a word part them again."""
        found = self.plain.encode_batch_fast([write(" ".join(words[i : i + 1000])) for i in range(0, len(words), 1000)], add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, "<u4") for e in found] or [np.empty(0, "<u4")])
        stops = np.flatnonzero(self.ends[ids]) + 1
        return Pieces(ids, np.diff(stops, prepend=0)) if len(stops) == len(words) else self.whole(words)

    def letters(self, words: pa.Array) -> Pieces:
        """Words of letters. Latin ones are lower-cased here, character by character, as the tokenizer does it, and have one
        form under NFC; others pass all steps of the tokenizer."""
        ascii_only = np.asarray(pc.string_is_ascii(words))
        rest = words.filter(pa.array(~ascii_only)).to_pylist()
        latin = np.array([max(w) < "\u0250" and "\u0130" not in w for w in rest], bool)
        kind = np.zeros(len(words), np.int8)
        kind[~ascii_only] = np.where(latin, 1, 2)
        pieces = self.bulk(words.filter(pa.array(ascii_only)).to_pylist(), str.lower)
        pieces += self.bulk([w for w, x in zip(rest, latin) if x], lambda text: text.lower().encode().decode("latin-1").translate(_TABLE))
        pieces += self.whole([w for w, x in zip(rest, latin) if not x])
        place = np.empty(len(words), np.int64)
        place[np.argsort(kind, kind="stable")] = np.arange(len(words))
        return pieces.take(place)

    def remembered(self, words: pa.Array) -> Pieces:
        """Distinct words of letters, of which those not known yet are encoded."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        pieces = self.held + self.letters(new)
        place = np.asarray(at.fill_null(0), np.int64)
        place[np.asarray(at.is_null())] = len(self.known) + np.arange(len(new))
        if len(self.known) + len(new) <= KNOWN_WORDS:
            self.known, self.held = pa.concat_arrays([self.known, new]), pieces
            return pieces.take(place)
        found = pieces.take(place)
        self.known, self.held = words, found
        return found

    def words(self, words: pa.Array) -> Pieces:
        """Distinct words. Marks after letters, but for the apostrophe, are tokens apart, so that letters are encoded once."""
        core = pc.utf8_rtrim(words, characters=_MARKS)
        plain = np.asarray(pc.utf8_is_alpha(core))
        strange = words.filter(pa.array(~plain))
        held, kept = words.filter(pa.array(plain)), core.filter(pa.array(plain))
        cores = kept.dictionary_encode()
        marked = np.asarray(pc.not_equal(pc.binary_length(held), pc.binary_length(kept)))
        tails = after(held.filter(pa.array(marked)), kept.filter(pa.array(marked))).dictionary_encode()
        pieces = self.remembered(cores.dictionary) + self.whole(tails.dictionary.to_pylist()) + self.whole(strange.to_pylist())
        # a word is its letters and, where it has them, its marks
        count = np.ones(len(words), np.int64)
        count[np.flatnonzero(plain)[marked]] = 2
        first = np.cumsum(count) - count
        parts = np.empty(int(count.sum()), np.int64)
        parts[first[plain]] = np.asarray(cores.indices)
        parts[first[count == 2] + 1] = len(cores.dictionary) + np.asarray(tails.indices)
        parts[first[~plain]] = len(cores.dictionary) + len(tails.dictionary) + np.arange(len(strange))
        found = pieces.take(parts)
        return Pieces(found.ids, found.summed(count))

    def encode(self, texts: pa.Array) -> Pieces:
        """The ids of each text; none for null."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_word:
            return self.whole(texts.to_pylist())
        wide = pc.match_substring_regex(texts, _SPACES)
        if pc.any(wide).as_py():
            texts = pc.if_else(wide, pc.replace_substring_regex(texts, _SPACES, " "), texts)
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        filled = pc.not_equal(pc.binary_length(flat), 0)  # blanks at the ends of a text leave empty words
        count = np.diff(np.concatenate(([0], np.cumsum(np.asarray(filled), dtype=np.int64)))[np.asarray(lists.offsets, np.int64)])
        coded = flat.filter(filled).dictionary_encode()
        found = self.words(coded.dictionary.cast(pa.string())).take(np.asarray(coded.indices))
        return Pieces(found.ids, found.summed(count))


def encode_batches(batches, path: str, end_id: int):
    """Arrow batches (doc_id, text) of one sorted partition -> (doc_id, local_start, n_tokens, ids)."""
    encoder, at = Encoder.of(path), 0
    for ids, texts in chunks(_merged(batches), CHUNK_BYTES):
        found = encoder.encode(texts)
        sizes = found.sizes + 1
        ends = np.cumsum(sizes)
        values = np.full(int(ends[-1]), end_id, np.int32)
        inside = np.ones(len(values), bool)
        inside[ends - 1] = False
        values[inside] = found.ids.view(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values))
        # a batch of rows of bounded size for the JVM
        step = max(1, len(sizes) * 1_000_000 // max(len(values), 1))
        for i in range(0, len(sizes), step):
            columns = [ids.slice(i, step).cast(pa.int64()), pa.array(at + (ends - sizes)[i : i + step]), pa.array(sizes[i : i + step]), lists.slice(i, step)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "local_start", "n_tokens", "ids"])
        at += int(ends[-1])
    release()


def _count_batches(batches, path: str):
    encoder = Encoder.of(path)
    for ids, texts in chunks(_merged(batches), CHUNK_BYTES):
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(encoder.encode(texts).sizes + 1)], names=["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens`` of every row, the end id included, in one pass without a shuffle."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _count_batches(it, tokenizer), "doc_id long, n_tokens long")


def _merged(batches):
    """Batches joined up to about CHUNK_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > CHUNK_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write ORC files in ascending id order.

    Each file holds one range of ids, sorted; rows that repeat an id are ordered by text; a null id comes first.
    ``local_start`` counts the ids before a document in its file. An empty table gives a folder without rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = rows.repartitionByRange(int(total // file_bytes) + 1, "doc_id").sortWithinPartitions("doc_id", "text")
    tokens = ranged.mapInArrow(lambda it: encode_batches(it, tokenizer, end_id), SCHEMA)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}
    tokens.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``doc_id, local_start, n_tokens, ids`` and the file's name; bounds on the id are pushed into the files' metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return rows.select("doc_id", "local_start", "n_tokens", "ids", F.col("_metadata.file_path").alias("file"))


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``file, before``: how many ids the files before it hold. Reads two narrow columns; one row per file."""
    rows = read_tokens(spark, path).groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("n"))
    order = Window.orderBy(F.asc_nulls_first("first")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def checksums(batches):
    """Unsigned crc32 of each document's ids as little-endian unsigned 32-bit integers, from the ids as read."""
    for batch in batches:
        ids = batch.column(3)
        data, offsets = np.asarray(ids.values, "<u4").tobytes(), np.asarray(ids.offsets, np.int64) * 4
        crc = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets) // 4), pa.array(crc, pa.int64()), batch.column(4)], names=["doc_id", "local_start", "n_tokens", "ids_crc32", "file"])


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files."""
    read = read_tokens(spark, path).mapInArrow(checksums, "doc_id long, local_start long, n_tokens long, ids_crc32 long, file string")
    found = read.join(file_offsets(spark, path), "file")
    return found.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}-tokens"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return document_index(spark, path)


ORACLE_SQL = None  # SQL has no tokenizer; tests compare with the tokenizers library, document by document
