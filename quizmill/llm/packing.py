"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces. Pieces are dealt by hash into shards of bounded size, so that
no document, source or group decides how much one task holds; each shard is packed alone, by best-fit decreasing. Which
length a new sequence gets is decided jointly for all lengths: a policy names, for the pieces that need at least a given length, the
length to open; every policy is packed, and the one of least cost stays. Short pieces may so be gathered in long sequences,
where less room is lost, or kept in short ones, where attention costs less.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import materialise, table
from quizmill.llm.token_output import Encoder, encode_batches

#: Pieces, or ids, that one shard holds on average. Packing loses at most a few open bins per shard.
SHARD_PIECES, SHARD_TOKENS = 20_000, 2_000_000
CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence of n tokens: n for its slots and n * n / QUADRATIC for attention, plus FIXED.
FIXED, QUADRATIC = 16.0, 16384.0

SCHEMA = "doc_id long, piece int, start long, length int, shard int, bin int, offset int, capacity int, used int"


def cost(capacity) -> float:
    return FIXED + capacity + capacity * capacity / QUADRATIC


def pack(lengths: np.ndarray, capacities: tuple[int, ...], opens: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, capacity of each bin) for items in decreasing order of length.

    An item goes into the open bin with the least room that still holds it (ties: the oldest bin). Without one, a bin of
    capacity ``opens[i]`` is opened, i being the place of the smallest capacity that holds the item. In the end every bin is
    downsized to the smallest size that holds its contents.
    """
    bins, used, room = np.empty(len(lengths), np.int64), [], []  # room: sorted (room left, bin)
    sizes = np.asarray(capacities)
    needs = np.searchsorted(sizes, lengths).tolist()
    for i, n in enumerate(lengths.tolist()):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b, free = len(used), opens[needs[i]]
            used.append(0)
        bins[i] = b
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, sizes[np.searchsorted(sizes, np.asarray(used, np.int64))]


def policies(capacities: tuple[int, ...]):
    """What to open for each smallest capacity that holds an item: itself or any larger one."""
    return product(*(capacities[i:] for i in range(len(capacities))))


def pack_jointly(lengths: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The packing of least cost over all policies; of equal ones the first, which opens smaller bins.

    Policies that differ only for sizes that no item needs are packed once.
    """
    needed = set(np.searchsorted(np.asarray(capacities), lengths).tolist())
    best, seen = None, set()
    for opens in policies(capacities):
        key = tuple(c for i, c in enumerate(opens) if i in needed)
        if key in seen:
            continue
        seen.add(key)
        tried = pack(lengths, capacities, opens)
        total = float(cost(tried[1].astype(float)).sum())
        if best is None or total < best[0]:
            best = total, tried
    return best[1]


def _shard(pdf: pd.DataFrame, capacities: tuple[int, ...]) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    length = pdf["length"].to_numpy()
    bins, sizes = pack_jointly(length, capacities)
    order = np.argsort(bins, kind="stable")
    run = np.cumsum(length[order]) - length[order]
    head = np.searchsorted(bins[order], np.arange(len(sizes)))
    offset = np.empty(len(length), np.int64)
    offset[order] = run - run[head][bins[order]]
    used = np.bincount(bins, weights=length, minlength=len(sizes)).astype(np.int64)
    return pdf.assign(bin=bins.astype(np.int32), offset=offset.astype(np.int32), capacity=sizes[bins].astype(np.int32), used=used[bins].astype(np.int32))


def best_fit(docs: DataFrame, length: Column, capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, shard, bin, offset, capacity, used``.

    A bin is (shard, bin); ``offset`` is the piece's place in it, ``used`` its contents, ``capacity`` its size after
    downsizing. ``start`` and ``length`` are in the units of ``length``, tokens or words. The result does not depend on
    partitions, as shards are dealt by a hash of id and piece and packed in a fixed order.

    Edge cases: documents of length 0 or null have one piece of length 0, put into some bin; rows that repeat an id are
    packed like any other; a null id is packed too; a very long document is many pieces; equal lengths go by id; an empty table gives an empty table; other columns are ignored.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n"))
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top).cast("int") - 1, F.lit(0)))).alias("piece"))
    start = F.col("piece").cast("long") * top
    pieces = materialise(pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(top)).cast("int").alias("length")), "pieces")
    shards = int(pieces.count() // shard_pieces) + 1
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(lambda pdf: _shard(pdf, capacities)[["doc_id", "piece", "start", "length", "shard", "bin", "offset", "capacity", "used"]], SCHEMA)


def n_words(text: Column) -> Column:
    """Words between blanks (space, tab to carriage return)."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")).cast("long")


SEQUENCES = "shard int, bin int, capacity int, used int, ids array<int>, bounds array<struct<doc_id:bigint,piece:int,start:bigint,offset:int,length:int>>"
PIECES = "doc_id long, piece int, start long, ids array<int>"


def cut(batches, top: int):
    """Arrow batches with doc_id and ids -> pieces of at most ``top`` ids; a document without ids is one empty piece."""
    for b in batches:
        ids = b.column("ids")
        at = np.asarray(ids.offsets, np.int64)
        sizes = np.diff(at)
        count = np.maximum(-(-sizes // top), 1)
        row = np.repeat(np.arange(len(sizes)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = at[:-1][row] + piece * top
        values = ids.values.slice(int(at[0]), int(at[-1] - at[0]))
        bounds = np.append(begin, at[-1]) - at[0]
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
        columns = [b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece.astype(np.int64) * top), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "ids"])


def _crcs(lists: pa.ListArray) -> np.ndarray:
    at = np.asarray(lists.offsets, np.int64) * 4
    data = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4")).cast("B")
    return np.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:])], np.int64)


def _sequences_of_shard(t: pa.Table, capacities: tuple[int, ...]) -> pa.Table:
    Encoder.forget()
    t = t.combine_chunks()
    lists = pa.concat_arrays(t["ids"].chunks) if t["ids"].num_chunks != 1 else t["ids"].chunk(0)
    length = np.diff(np.asarray(lists.offsets, np.int64))
    doc, known = t["doc_id"].fill_null(0).to_numpy(), t["doc_id"].is_valid().to_numpy()
    order = np.lexsort((_crcs(lists), t["piece"].to_numpy(), doc, known, -length))
    bins, sizes = pack_jointly(length[order], capacities)
    by = np.argsort(bins, kind="stable")
    order, bins, length = order[by], bins[by], length[order][by]
    run = np.concatenate(([0], np.cumsum(length)))
    heads = np.searchsorted(bins, np.arange(len(sizes) + 1))
    rows = pa.array(order)
    parts = [t["doc_id"].take(rows), t["piece"].take(rows), t["start"].take(rows), pa.array((run[:-1] - run[heads[:-1]][bins]).astype(np.int32)), pa.array(length.astype(np.int32))]
    bounds = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in parts], names=["doc_id", "piece", "start", "offset", "length"])
    used = np.diff(run[heads])
    columns = [
        pa.array(np.full(len(sizes), t["shard"][0].as_py(), np.int32)), pa.array(np.arange(len(sizes), dtype=np.int32)), pa.array(sizes.astype(np.int32)), pa.array(used.astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(run[heads].astype(np.int32)), lists.take(rows).flatten()), pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), bounds),
    ]
    return pa.table(columns, names=["shard", "bin", "capacity", "used", "ids", "bounds"])


def packed(pieces: DataFrame, shards: int, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """The sequences of ``pieces(doc_id, piece, start, ids)``: ``shard, bin, capacity, used, ids, bounds``.

    Pieces are dealt with their ids, once, to shards by a hash of id and piece, and packed there as in ``best_fit``. ``bounds``
    tells each piece's place: ``doc_id, piece, start, offset, length``. No sequence is longer than the largest capacity.
    """
    capacities = tuple(sorted(capacities))
    # rows that repeat an id are spread by what they hold
    spread = F.xxhash64("doc_id", "piece", F.slice("ids", 1, 16))
    dealt = pieces.withColumn("shard", F.pmod(spread, F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(lambda t: _sequences_of_shard(t, capacities), SEQUENCES)


def sequences(tokens: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The packed sequences, see ``packed``, of ``tokens(doc_id, ids)``.

    Edge cases: every row gives its own pieces, so a null id and rows that repeat an id keep their ids apart; no ids (or
    null) give one piece of length 0; a very long document is many pieces, in any shards; equal pieces are interchangeable; an
    empty table gives an empty table; other columns are ignored.
    """
    top = max(capacities)
    total = tokens.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).cast("array<int>").alias("ids"))
    return packed(rows.mapInArrow(lambda it: cut(it, top), PIECES), int(total // shard_tokens) + 1, capacities)


def document_sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, capacities: tuple[int, ...] = CAPACITIES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The packed sequences of the token ids of ``docs(doc_id, text)``, those of operator 1, each document with its end id.

    Texts are encoded and cut where they are read; only pieces of ids move, once. The number of shards follows from the bytes of
    text, four a token. Edge cases as in ``sequences``; a null text is an empty one.
    """
    top = max(capacities)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    pieces = rows.mapInArrow(lambda it: cut(encode_batches(it, tokenizer, end_id), top), PIECES)
    return packed(pieces, int(total // (4 * shard_tokens)) + 1, capacities)


def _checked(batches):
    """Rows of pieces whose last column is their ids -> the same with the unsigned crc32 of the ids in its place."""
    Encoder.forget()
    for b in batches:
        crc = pa.array(_crcs(b.column(b.num_columns - 1)))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], crc], names=[*b.schema.names[:-1], "ids_crc32"])


def pieces_read(sequences: DataFrame) -> DataFrame:
    """One row per piece of sequences as read: ``doc_id, piece, start, length, shard, bin, offset, capacity, used, ids_crc32``.

    A sequence is cut into its pieces before rows go to Python, so a batch there holds pieces and not long sequences.
    """
    fields = ("doc_id", "piece", "start", "length", "offset")
    part = F.transform("bounds", lambda b: F.struct(*(b[c].alias(c) for c in fields), F.slice("ids", b["offset"] + 1, b["length"]).alias("ids")))
    rows = sequences.select("shard", "bin", "capacity", "used", F.explode(part).alias("p"))
    rows = rows.select("p.doc_id", "p.piece", "p.start", "p.length", "shard", "bin", "p.offset", "capacity", "used", "p.ids")
    return rows.mapInArrow(_checked, SCHEMA + ", ids_crc32 long")


def placed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece of ``document_sequences``, which are written and read back, see ``pieces_read``."""
    return pieces_read(materialise(document_sequences(docs, tokenizer), "sequences"))


def query(spark, sf_dir: str) -> DataFrame:
    """Sequences of token ids, each document with its end id: the same ids as those of operator 1."""
    import public_tokenizers

    return placed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


ORACLE_SQL = None  # packing is a sequence of choices; tests check bounds, completeness, plain loops and exhaustive search
