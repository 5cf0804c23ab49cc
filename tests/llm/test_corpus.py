"""Mixing, tokens, files, chat and the pipeline."""

import random
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
SMALL = "/root/testdata/sf0.001"

from pulseframe.llm import chat, mixing, queries, textops
from pulseframe.llm.binary import pack, place, read_token_files, unpack, write_token_files
from pulseframe.llm.mixing import mix_sources
from pulseframe.llm.rangecoder import SEGMENT, Model, decode_blocks, encode_blocks
from pulseframe.llm.shared import shared_dir, written
from pulseframe.llm.textops import Texts
from pulseframe.llm.tokens import Encoder, count_tokens, vocabulary_file

from .conftest import words

VOCABULARY = "byte_bpe_50k.json"


def same_as_sql(spark, name, sql):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    plain = lambda v: f"{v:.8g}" if isinstance(v, float) else str(v)
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(tuple(plain(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())


def test_mix_equals_sql(spark):
    same_as_sql(spark, "op4_fair_mix", mixing.ORACLE)


def test_chat_equals_sql(spark):
    same_as_sql(spark, "op9_preference_pairs", chat.ORACLE)


def test_mix_of_odd_rows(spark, odd):
    rows = mix_sources(odd, keep=("source",), rows_a_bucket=5).collect()
    assert len(rows) == odd.count()
    total = sum(r["size"] for r in rows)
    by: dict = {}
    for r in rows:
        s = by.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
        s[0] += r["taken"]
        s[3] = max(s[3], r["size"])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert sum(t for _, _, t, _ in by.values()) == pytest.approx(total)
    for taken, size, target, largest in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= largest
    again = mix_sources(odd, keep=("source",), rows_a_bucket=5000).collect()
    key = lambda x: sorted((str(r["doc_id"]), r["size"], str(r["source"]), r["taken"]) for r in x)
    assert key(rows) == key(again)
    assert mix_sources(odd.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 7, "c": 2, "d": 40, None: 3}, {"a": 162, "b": 24, "c": 509, "d": 1106, "e": 6441, None: 1}, {f"s{i:02}": 90 + i for i in range(20)}])
def test_mix_targets_are_reshared_until_none_is_above(spark, sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped: set = set()
    while True:
        left, share = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        above = {s for s in names if s not in capped and left * weight[s] > 3 * sizes[s] * share}
        if not above:
            break
        capped |= above
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    for r in mix_sources(docs, keep=("source",)).collect():
        assert r["size"] == r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(3 * r["size"] if r["source"] in capped else left * weight[r["source"]] / share)


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    r = random.Random(5)
    alphabet = [*"abAZ  \n\n\t.,!'\"%&-é×÷ñßÀ 　 €😀字09", "<|endoftext|>", " the", " Word", "'s", "\r\n", "\u0085"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    whole = Tokenizer.from_file(vocabulary_file(VOCABULARY)).encode_batch(texts, add_special_tokens=False)
    ids, off = Encoder(vocabulary_file(VOCABULARY)).ids(Texts(pa.array(texts)))
    assert all(ids[off[i] : off[i + 1]].tolist() == e.ids for i, e in enumerate(whole))


def doubling(n: int, letters: str) -> str:
    """The Thue-Morse word, whose shape makes polynomial hashes of it and of its complement equal."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_hashes_of_alike_words():
    w = Texts(pa.array([doubling(n, x) for n in (8, 64, 1024, 2048, 8192) for x in ("ab", "ba")])).words().hash
    assert len(set(w.tolist())) == 10
    r = np.random.default_rng(3)
    buf = r.integers(97, 100, 20_000).astype(np.uint8)
    lo = r.integers(0, 19_900, 5000)
    hi = lo + r.integers(0, 60, 5000)
    seen: dict = {}
    for a, b, h in zip(lo, hi, textops.range_hash(buf, lo, hi).tolist()):
        assert seen.setdefault(buf[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("weak", [False, True])
def test_ids_do_not_rest_on_the_hash(monkeypatch, weak):
    from tokenizers import Tokenizer

    if weak:
        monkeypatch.setattr(textops.Ranges, "hash", lambda self: textops.mix(self.head))
    t = Tokenizer.from_file(vocabulary_file(VOCABULARY))
    e = Encoder(vocabulary_file(VOCABULARY))
    r = random.Random(1)
    for _ in range(4):
        texts = [doubling(2048, "ab"), doubling(2048, "ba"), "", doubling(3000, "ab") + " " + doubling(3000, "ba")]
        texts += [" ".join("".join(r.choice("ab") for _ in range(r.randint(1, 20))) for _ in range(30)) for _ in range(30)]
        ids, off = e.ids(Texts(pa.array(texts)))
        assert all(ids[off[i] : off[i + 1]].tolist() == x.ids for i, x in enumerate(t.encode_batch(texts, add_special_tokens=False)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, odd, name):
    path = vocabulary_file(name)
    if name.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(m.encode(t))
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    docs = odd if name.endswith(".json") else odd.where("doc_id <> 5 OR doc_id IS NULL")  # the other library takes minutes over the long text
    rows = count_tokens(docs, path).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_bytes"], r["n_tokens"]) == (len((r["text"] or "").encode()), count(r["text"] or ""))
        assert r["over_limit"] == (r["n_tokens"] > 1024)
    assert count_tokens(docs.limit(0), path).count() == 0


def test_round_trips():
    r = np.random.default_rng(0)
    kinds = [r.integers(0, 50_257, 5000), np.zeros(3000, int), r.zipf(1.3, 4000) % 50_257, np.tile([7, 8, 9], 900), np.array([65_535]), np.arange(300)]
    for x in kinds:
        for size in (1, 16, 2048):
            if len(x) / size > 3000:
                continue
            w, count, most = encode_blocks(x, size)
            assert (decode_blocks(w, count, size, most, len(x)) == x).all()
    x = kinds[2]
    w, count, most = encode_blocks(x, 512)
    ends = np.cumsum(count)
    assert (decode_blocks(w[ends[2] : ends[4]], count[3:5], 512, most, 1024) == x[3 * 512 : 5 * 512]).all()  # blocks stand alone
    assert encode_blocks(np.tile([7, 8, 9], 2000), 2048)[0].nbytes < 600


def test_weights_of_orders_are_learnt():
    """Where one order alone is right, blocks shrink as its weight grows."""
    r = np.random.default_rng(0)
    pairs = [(1, 2, 3), (4, 2, 5)]
    ids = np.concatenate([pairs[k] for k in r.integers(0, 2, 3000)])  # what follows 2 depends on what came before it
    words, count, most = encode_blocks(ids, 2048)
    assert (decode_blocks(words, count, 2048, most, len(ids)) == ids).all()
    m = Model(1, 10)
    start = m.error.copy()
    for k, x in enumerate(ids[: 4 * SEGMENT].tolist()):
        m.predict()
        one = np.array([x], np.int32)
        hit2, hit1 = m.p2 == one, m.p1 == one
        m.update(one, hit2, np.where(hit2, 0, np.where(hit1, 1, 2)), np.zeros(0, np.int64), np.zeros(0, np.int32))
    grown = m.error - start
    assert (grown > 0).all() and grown[0] != grown[1]


@pytest.mark.parametrize("largest", [2000, 50_000, 200_000])
def test_coder_memory_an_id(largest):
    ids = np.random.default_rng(1).integers(0, largest, 300 * 2048 + 77).astype(np.int32)  # the largest take more words than a lane has room for at first
    tracemalloc.start()
    words, count, most = encode_blocks(ids, 2048)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 36 * len(ids)
    assert (decode_blocks(words, count, 2048, most, len(ids)) == ids).all()


def test_damage_is_seen():
    data = pack(np.array([5]), np.array([False]), np.array([900]), np.arange(900) % 77)
    assert (unpack(data)[3] == np.arange(900) % 77).all()
    broken = bytearray(data)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        unpack(bytes(broken))
    with pytest.raises(ValueError):
        unpack(b"nothing")


def test_every_damaged_bit_is_seen():
    ids = np.random.default_rng(3).integers(0, 50_000, 150)
    data = pack(np.array([5]), np.array([False]), np.array([150]), ids, block_ids=64)
    assert (unpack(data)[3] == ids).all()
    words = encode_blocks(ids, 64)[0].nbytes
    for bit in range(8 * (len(data) - words), 8 * len(data)):
        broken = bytearray(data)
        broken[bit // 8] ^= 1 << bit % 8
        with pytest.raises(ValueError):
            unpack(bytes(broken))


def test_even_places_go_past_the_coder():
    """They lie behind a block's coded words, first from its end, and cost their bits and no more."""
    from pulseframe.llm import rangecoder

    values, bits = np.array([[0xABC, 0x12, 0, 0x345], [1, 0, 0, 0]]), np.array([[12, 8, 0, 12], [4, 0, 0, 0]], np.int32)
    words, count = rangecoder._raw_words(values, bits)
    assert count.tolist() == [2, 1] and words[0, :2].tolist() == [0xABC1, 0x2345] and words[1, 0] == 0x1000
    ids = 4096 * 5 + np.random.default_rng(0).permutation(4096)[:2048]  # new ids of one class, which soon costs nothing
    coded, count, _ = encode_blocks(ids, 2048)
    assert count[0] * 16 < 2048 * 12 + 2500 and coded[-1] == (ids[0] - 4096 * 5) << 4 & 0xFFFF | (ids[1] - 4096 * 5) >> 8


def test_files(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_file(VOCABULARY))
    out = shared_dir(spark, "files")
    write_token_files(odd, vocabulary_file(VOCABULARY), out, part_ids=2000)
    plain = [f.read_bytes() for f in Path(out).glob("part-*")]
    got = sorted(((place(data), unpack(data)) for data in plain if data), key=lambda x: x[0])  # the files themselves, without Spark
    assert got and sum(len(x[0]) for _, x in got) == odd.count()
    rows = sorted(read_token_files(spark, out, with_ids=True).collect(), key=lambda r: r["start"])
    assert len(rows) == odd.count()
    assert np.array_equal(np.concatenate([x[3] for _, x in got]), np.concatenate([r["ids"] for r in rows]))
    ids = [r["doc_id"] for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    start = 0
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 0
        start += r["n_tokens"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        if r["doc_id"] is not None:
            assert r["ids"][:-1] == t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
    out = shared_dir(spark, "none")
    write_token_files(odd.limit(0), vocabulary_file(VOCABULARY), out)
    assert read_token_files(spark, out).count() == 0


def test_chat_by_hand(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yo"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", None),
        (2, "chosen", 0, "user", "a"), (2, "chosen", 1, "assistant", "b"), (2, "rejected", 0, "user", "a"), (3, "chosen", 0, None, "x"),
    ]
    rows = {r["pair_id"]: r for r in chat.format_preferences(spark.createDataFrame(turns, "pair_id long, side string, turn int, role string, text string")).collect()}
    r = rows[1]
    assert r["prompt"] == "<|user|>\nhi<|end|>\n" and r["chosen"] == "<|assistant|>\nyo<|end|>\n" and r["n_prefix"] == 1
    a, b = map(int, r["chosen_learned"].split(":"))
    assert r["chosen"][a:b] == "yo<|end|>\n" and r["rejected"].endswith("<|user|>\n<|end|>\n")
    assert rows[2]["rejected"] == "" and rows[2]["n_prefix"] == 1
    assert rows[3]["prompt"] == "" and rows[3]["rejected"] == "" and rows[3]["chosen"].startswith("<|unknown|>")


def test_chat_of_odd_turns(spark):
    schema = "pair_id long, side string, turn int, role string, text string, prompt string, n_prefix int"
    turns = [
        (None, "chosen", 0, "user", "a"), (None, "rejected", 0, "user", "a"), (4, "chosen", 1, "user", "x"), (4, "chosen", 1, "user", "x"), (4, "rejected", 1, "user", "x"),
        (5, "chosen", None, "user", None), (5, "rejected", None, "user", ""), (6, "rejected", 0, "assistant", ""), (7, "other", 0, "user", "z"),
    ]
    d = spark.createDataFrame([(*t, "own", 9) for t in turns], schema)
    rows = {r["pair_id"]: r for r in chat.format_preferences(d).collect()}
    assert rows[None]["n_prefix"] == 1 and rows[None]["chosen"] == rows[None]["rejected"] == ""
    assert (rows[4]["n_chosen"], rows[4]["n_prefix"]) == (2, 1) and rows[4]["chosen"] == "<|user|>\nx<|end|>\n"
    assert rows[5]["prompt"] == "<|user|>\n<|end|>\n"  # a missing text is an empty one
    assert rows[6]["n_prefix"] == 0 and rows[6]["rejected_learned"] == "14:22" and rows[7]["n_chosen"] == rows[7]["n_rejected"] == 0
    assert chat.format_preferences(d.limit(0)).count() == 0
    many = [(1, s, k, "assistant" if k % 2 else "user", f"{k}") for s in ("chosen", "rejected") for k in range(20_000)] + [(1, "chosen", 20_000, "assistant", "end")]
    r = chat.format_preferences(spark.createDataFrame(many, "pair_id long, side string, turn int, role string, text string")).first()
    assert r["n_prefix"] == 20_000 and r["rejected"] == "" and r["chosen_learned"] == "14:25" and r["chosen"][14:25] == "end<|end|>\n"


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    columns, stages = odd.columns, dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(map(str, df.collect()))
    for name, stage in stages.items():
        got = written(stage(spark, odd, SMALL), f"odd-{name}")
        if name == "token_files":
            assert got.count() == odd.count() and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        else:
            assert got.columns == columns and got.dtypes == odd.dtypes
        if name in ("quality", "near_duplicates", "decontamination"):
            assert set(rows(got)) <= set(rows(odd)) and 0 < got.count() <= odd.count()  # rows as they were, names that clash included
        if name == "near_duplicates":
            from .test_similarity import brute

            classes = brute([(i, r["text"]) for i, r in enumerate(odd.collect())])
            assert got.count() == len({c for _, c in classes.values()})
        if name == "decontamination":
            assert got.count() == odd.count()
        if name == "mixing":
            assert set(rows(got)) <= set(rows(odd))
        assert stage(spark, odd.limit(0), SMALL).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SMALL), f"test-{name}")
        sizes.append(docs.count())
        if name != "token_files":
            assert docs.columns == columns
        if name == "quality":
            assert all(len(words(r["text"])) >= 10 for r in docs.collect())
        if name == "near_duplicates":
            from .test_similarity import brute

            classes = brute([(i, r["text"]) for i, r in enumerate(before.collect())])
            assert docs.count() == len({c for _, c in classes.values()})
        if name == "mixing":
            kept = {r["doc_id"] for r in docs.collect()}
            assert kept <= {r["doc_id"] for r in before.collect()}
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[5] == sizes[4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]
