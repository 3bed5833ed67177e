import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quizmill.llm import packing, token_output

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = ["Hello, world. It's x.. y,, ok!", None, "", "  ", "İstanbul ΣΑΣ ß Ünder", "a\x1cb c\x1fd", "<|endoftext|> a<|startoftext|>", "日本 語　テ", "x́ é é", "don't we'll I'M.", "word " * 20_000, "A_b c-d ### %%% 12,5 a1b2", "Ǆabc ǅ ŉ ﬁ"]


def encoded(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def ids_of(texts):
    found = token_output.Encoder.of(PATH).encode(pa.array(texts, pa.string()))
    assert len(found.sizes) == len(texts) and found.sizes.sum() == len(found.ids)
    return [x.tolist() for x in np.split(found.ids, np.cumsum(found.sizes)[:-1])] if texts else []


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    letters = "abcXYZéÜñßøĳſǅ .,!?'-_#0159\t\n ́\u0085\u2003\x1c\u200b"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    # every assigned or unassigned block of the plane, characters alone, in words, before and after letters and marks
    for low in [*range(0x40, 0xD800, 0x40), *range(0xE000, 0x11000, 0x40), *range(0x1F000, 0x1FC00, 0x40)]:
        chars = [chr(low + rng.randrange(0x40)) for _ in range(6)]
        texts.append(" ".join(["a" + chars[0], chars[1] + "B", chars[2], "x" + chars[3] + "y,", chars[4] + "." + chars[5]]))
    got = ids_of(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids == plain.encode(text, add_special_tokens=False).ids, ascii(text[:80])
    assert ids_of([]) == [] and ids_of([None, " "]) == [[], []]


def test_chunks_of_any_size_give_the_same_rows(monkeypatch):
    monkeypatch.setattr(token_output, "KNOWN_WORDS", 8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["doc_id", "text"])
    rows = []
    for size in (10, 1 << 20):
        monkeypatch.setattr(token_output, "CHUNK_BYTES", size)
        rows.append(pa.Table.from_batches(token_output.encode_batches([batch, batch.slice(0, 0), batch.slice(3)], PATH, 1)).to_pylist())
    assert rows[0] == rows[1] and [r["ids"] for r in rows[0]] == [encoded(t) for t in TEXTS + TEXTS[3:]]
    at = np.cumsum([0] + [r["n_tokens"] for r in rows[0]])
    assert [r["local_start"] for r in rows[0]] == at[:-1].tolist()


def test_round_trip(spark, tmp_path):
    rows = [(i * 7 % 31, t, "clash") for i, t in enumerate(TEXTS)] + [(5, "again", ""), (5, "again", ""), (None, "no id", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    path = str(tmp_path / "tokens")
    token_output.write_tokens(docs, path, PATH, file_bytes=20_000)
    want = [(i, encoded(t)) for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    back = token_output.read_tokens(spark, path).collect()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in back) == sorted((i or -1, ids) for i, ids in want)
    index = sorted(token_output.document_index(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, ids) in zip(index, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id for r in token_output.read_tokens(spark, path, 7, 14).collect()} == {i for i, _, _ in rows if i is not None and 7 <= i <= 14}


def test_files_have_indexes_bloom_filters_and_pruning(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_output.write_tokens(spark.range(6000).selectExpr("id * 3 AS doc_id", "concat('text ', id) AS text"), path, PATH)
    plan = token_output.read_tokens(spark, path, 3, 4)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,3), LessThanOrEqual(doc_id,4)]" in plan
    jvm, names = spark._jvm, sorted(x for x in os.listdir(path) if x.endswith(".orc"))
    conf, kinds = jvm.org.apache.hadoop.conf.Configuration(), set()
    for name in names:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{path}/{name}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        rows = reader.rows()
        for stripe in range(reader.getStripes().size()):
            footer = rows.readStripeFooter(reader.getStripes().get(stripe))
            for i in range(footer.getStreamsCount()):
                stream = footer.getStreams(i)
                kinds.add((stream.getKind().toString(), stream.getColumn()))
            assert footer.getColumns(1).getKind().toString().startswith("DIRECT")  # run-length encoded integers
        rows.close()
    assert ("ROW_INDEX", 1) in kinds and any(k.startswith("BLOOM_FILTER") and c == 1 for k, c in kinds)
    found = spark.read.orc(path).filter("doc_id = 4500")
    assert [r.n_tokens for r in found.collect()] == [len(encoded("text 1500"))]
    assert spark.read.orc(path).filter("doc_id = 4501").count() == 0


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_output.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert token_output.document_index(spark, path).count() == 0


def naive(lengths, capacities, opens):
    """Best fit by looking through all bins."""
    bins = []
    for n in lengths:
        fits = [b for b in bins if b[1] - b[0] >= n and b[1] > b[0]]
        if fits:
            b = min(fits, key=lambda b: (b[1] - b[0], b[2]))
        else:
            b = [0, next(o for c, o in zip(capacities, opens) if c >= n), len(bins)]
            bins.append(b)
        b[0] += n
    return [min(c for c in capacities if c >= b[0]) for b in bins]


def total(sizes):
    return sum(packing.cost(float(c)) for c in sizes)


def test_pack_equals_a_plain_loop_and_the_best_policy_stays():
    rng = random.Random(2)
    capacities = (16, 32, 64)
    every = list(packing.policies(capacities))
    assert len(every) == 6 and all(o >= c for opens in every for c, o in zip(capacities, opens))
    for _ in range(20):
        lengths = np.array(sorted((rng.randrange(0, 60) for _ in range(rng.randrange(1, 80))), reverse=True))
        for opens in every:
            bins, sizes = packing.pack(lengths, capacities, opens)
            used = np.bincount(bins, weights=lengths, minlength=len(sizes))
            assert (used <= sizes).all() and sorted(sizes) == sorted(naive(lengths.tolist(), capacities, opens))
        assert total(packing.pack_jointly(lengths, capacities)[1]) == min(total(naive(lengths.tolist(), capacities, o)) for o in every)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def test_joint_choice_against_exhaustive_search():
    """Lengths that fill no small sequence well go into long ones; on small sets the cost is near the least there is."""
    capacities = (512, 1024, 2048, 4096)
    thirds = np.array([340] * 12)
    assert total(packing.pack_jointly(thirds, capacities)[1]) < 0.8 * total(packing.pack(thirds, capacities, capacities)[1])
    halves = np.array([500] * 12)
    assert set(packing.pack_jointly(halves, capacities)[1].tolist()) == {512}
    rng, ratios = random.Random(5), []
    for _ in range(30):
        lengths = sorted((rng.choice([60, 200, 340, 400, 520, 700, 900, 1300]) for _ in range(7)), reverse=True)
        least = min(total(min(c for c in capacities if c >= sum(b)) for b in p) for p in partitions(lengths) if all(sum(b) <= 4096 for b in p))
        ratios.append(total(packing.pack_jointly(np.array(lengths), capacities)[1]) / least)
    assert min(ratios) >= 1 - 1e-9 and np.mean(ratios) < 1.06 and max(ratios) < 1.25


def test_sequences_of_token_ids_read_back(spark, tmp_path):
    long = "several words of a long text " * 3000
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(100 + i, f"some words number {i} " * (i % 9), "") for i in range(60)] + [(200, long, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = str(tmp_path / "tokens")
    token_output.write_tokens(docs, path, PATH)
    tokens = token_output.read_tokens(spark, path)
    made = [packing.sequences(tokens, (64, 128, 1024), shard_tokens=9000), packing.document_sequences(docs.repartition(3), PATH, 1, (64, 128, 1024), shard_tokens=9000)]
    for k, sequences in enumerate(made):
        sequences.write.parquet(str(tmp_path / f"sequences{k}"))
        found = spark.read.parquet(str(tmp_path / f"sequences{k}"))
        parts = {}
        for s in found.collect():
            assert len(s.ids) == s.used <= s.capacity and s.capacity in (64, 128, 1024)
            assert [b.offset for b in s.bounds] == np.cumsum([0] + [b.length for b in s.bounds])[:-1].tolist()
            for b in s.bounds:
                assert (b.doc_id, b.piece) not in parts and b.start == b.piece * 1024
                parts[b.doc_id, b.piece] = s.ids[b.offset : b.offset + b.length]
        for i, text, _ in rows:
            assert sum((parts[i, k] for k in range(len([1 for j, _ in parts if j == i]))), []) == encoded(text)
        pieces = packing.pieces_read(found).collect()
        assert {(r.doc_id, r.piece): r.ids_crc32 for r in pieces} == {k: zlib.crc32(np.array(ids, "<u4").tobytes()) for k, ids in parts.items()}
        whole = {r.doc_id: r.ids_crc32 for r in pieces if sum(q.doc_id == r.doc_id for q in pieces) == 1}
        index = {r.doc_id: r.ids_crc32 for r in token_output.document_index(spark, path).collect()}
        assert len(whole) > 60 and all(index[i] == c for i, c in whole.items())  # operator 1's checksums


def test_sequences_keep_null_and_repeated_ids_apart(spark):
    tokens = spark.createDataFrame([(None, [7, 8, 9]), (None, [6]), (1, [1]), (1, [2]), (1, [2]), (2, []), (3, None)], "doc_id long, ids array<int>")
    found = packing.sequences(tokens, (4, 8)).collect()
    parts = sorted(((b.doc_id, b.piece, s.ids[b.offset : b.offset + b.length]) for s in found for b in s.bounds), key=repr)
    assert parts == sorted([(None, 0, [7, 8, 9]), (None, 0, [6]), (1, 0, [1]), (1, 0, [2]), (1, 0, [2]), (2, 0, []), (3, 0, [])], key=repr)
    assert sum(s.used for s in found) == 7 == sum(len(s.ids) for s in found)
    assert packing.sequences(tokens.limit(0)).collect() == []


def test_best_fit_is_whole_and_tight(spark):
    rng = random.Random(3)
    n = {i: rng.choice([0, 3, 10, 50, 99, 100, 101, 250, 7000]) for i in range(400)}
    rows = [(i, "w " * k, 0, 0) for i, k in n.items()] + [(1000, None, 0, 0), (None, "a b", 0, 0), (1001, "a", 0, 0), (1001, "a", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin int, start int")
    from pyspark.sql import functions as F

    got = [packing.best_fit(docs.repartition(k), packing.n_words(F.col("text")), (25, 50, 100), shard_pieces=300).toPandas() for k in (1, 5)]
    key = ["shard", "bin", "offset", "doc_id", "piece"]
    assert got[0].sort_values(key).reset_index(drop=True).equals(got[1].sort_values(key).reset_index(drop=True))
    out = got[0]
    per = out[out.doc_id < 1000].groupby("doc_id")["length"].sum()
    assert {int(i): int(k) for i, k in per.items()} == n
    for _, b in out.groupby(["shard", "bin"]):
        b = b.sort_values(["offset", "length"])
        assert (b.offset.values == np.concatenate([[0], np.cumsum(b.length.values)[:-1]])).all()
        assert b.length.sum() == b.used.iloc[0] <= b.capacity.iloc[0]
        assert b.capacity.iloc[0] == min(c for c in (25, 50, 100) if c >= b.length.sum())
    assert out.length.sum() / out.drop_duplicates(["shard", "bin"]).capacity.sum() > 0.95
    assert packing.best_fit(docs.limit(0), packing.n_words(F.col("text"))).count() == 0
