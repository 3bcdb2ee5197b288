"""Packing along the curve, structure repair and token alignment against plain Python."""

import random
import zlib

import brute_new
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm import bytelevel, curvepack, queries, repair, tokenalign, wordcut

BYTE_LEVEL, PIECES = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, id long, n long, key long, batch long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda: rng.choice(["the", "Zebra", "naïve", "Straße", "东京", "x1y22", "don't", "…", "🙂", "a▁b", "end.", "q" * 9])
    plain = lambda: rng.choice(["the", "Zebra", "naïve", "Straße", "x1y22", "don't", "end.", "It's"])
    out = [" ".join(plain() for _ in range(rng.randrange(1, 90))) for _ in range(30)]
    out += [rng.choice([" ", "  ", "\n", " \n ", "\t"]).join(word() for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    out += [None, "", " ", "   ", "\n", "\n\n x", " lead", "trail ", "trail  ", "a  b", "a \n b", "x<|endoftext|> y", "<s> </s> <unk>", "<0x41>", "▁", "\x00", "　 a", "\x85 b\x1c c"]
    out += [out[0]] * 5 + ["pad " * 3000, "z" * 5000, "".join(chr(0x4E00 + i % 800) for i in range(3000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None, 1, 2, 3, 4) for i, t in enumerate(texts)] + [(None, "null id", None, None, 1, 2, 3, 4), (3, texts[3], None, None, 1, 2, 3, 4), (3, texts[3], None, None, 1, 2, 3, 4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_words_join_to_the_text(texts):
    for t in texts:
        keys = wordcut.words(t or "")
        assert "".join(map(wordcut.piece_text, keys)) == (t or "")


def test_pieces_are_encoded_as_in_the_whole_text(texts):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    both = tokenalign.Pair(BYTE_LEVEL, PIECES)
    for t in filter(None, texts):
        ids, _ = both.memory.spread(both.memory.slots_of(wordcut.words(" " + t)), 0)
        assert ids.tolist() == whole.encode(t), t


def test_the_rank_form_gives_the_tokenizers_ids(texts):
    import pyarrow.parquet as pq

    odd = [*texts, "x<|endoftext|>y", "  \u3000\u2028 a\x1c\x1d b\x85\xa0c", "I'll we've don't 'S x's1 ½²三 a\u0301b _a__ \t\r\n  ", "p <|endoftext|> q"]
    odd += pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    for special in (True, False):
        coder = bytelevel.ByteLevel(BYTE_LEVEL, special)
        assert coder.ranked
        for t in odd:
            assert coder.ids(t or "") == coder.tokenizer.encode(t or "", add_special_tokens=False).ids, t
    assert bytelevel.ByteLevel(BYTE_LEVEL).ids("x<|endoftext|>")[-1] == 50256 != bytelevel.ByteLevel(BYTE_LEVEL, False).ids("x<|endoftext|>")[-1]


def test_a_file_of_another_kind_goes_through_its_tokenizer():
    coder = bytelevel.ByteLevel(queries.tokenizer_path())
    assert coder.ranked is None and coder.ids("one Two!") == coder.tokenizer.encode("one Two!", add_special_tokens=False).ids


def test_remembered_pieces_are_forgotten_at_the_bound():
    def learn(keys):
        n = np.array([len(k) for k in keys])
        return [(np.repeat(n, n), n)]

    memory = wordcut.Remembered(learn, most=3)
    for keys in (["a", "bb"], ["ccc", "dd", "a"], ["a", "bb", "eeee", "fffff"]):
        values, n = memory.spread(memory.slots_of(keys), 0)
        assert n.tolist() == [len(k) for k in keys]
        assert values.tolist() == [len(k) for k in keys for _ in k]


def test_hilbert_neighbours_differ_by_one_step():
    for bits, dims in ((2, 2), (2, 3), (2, 4), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
        key = curvepack.hilbert_index(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def _packed(docs, length=1024):
    return curvepack.pack(docs, BYTE_LEVEL, 0, length).collect()


@pytest.mark.parametrize("length", [1024, 64])
def test_packing(docs, texts, length):
    whole = Tokenizer.from_file(BYTE_LEVEL)
    rows = _packed(docs, length)
    # sequences: gapless from 0, full or a power of two, nothing padded
    by_sequence = {}
    for r in rows:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length and at & (at - 1) == 0
    assert sum(sum(n for _, n in p) < length for p in by_sequence.values()) <= 10
    # documents: every id in exactly one piece
    wanted = sorted(
        [(i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in enumerate(texts)] + [(3, tuple(whole.encode(texts[3], add_special_tokens=False).ids + [0]))] * 2
        + [(-1, tuple(whole.encode("null id", add_special_tokens=False).ids + [0]))]
    )
    found, open_docs = [], []
    order = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    for r in order:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        if r.start == 0:
            open_docs.append([r.id, r.doc_tokens, []])
        assert open_docs[-1][0] == r.id and len(open_docs[-1][2]) == r.start
        open_docs[-1][2].extend(ids)
    for i, n, ids in open_docs:
        assert len(ids) == n
        found.append((-1 if i is None else i, tuple(ids)))
    assert sorted(found) == wanted


def test_whole_sequences(docs):
    pieces = curvepack.pack(docs, BYTE_LEVEL, 0, 256)
    rows = curvepack.sequences(pieces).collect()
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert sum(r.length for r in rows) == pieces.agg(F.sum("length")).first()[0]


def test_packing_puts_like_documents_together(spark):
    rng = random.Random(1)
    topics = ["river lake ocean water boat fish sail harbour", "bread flour oven butter cake sugar salt bakery", "goal match team player coach league season cup", "code loop array branch compiler syntax memory thread"]
    topics = [t.split() for t in topics]
    rows = [(t * 1000 + i, " ".join(rng.choice(topics[t]) for _ in range(80)), None, None, 0, 0, 0, 0) for t in range(4) for i in range(25)]
    rng.shuffle(rows)
    order = sorted(curvepack.pack(spark.createDataFrame(rows, SCHEMA), BYTE_LEVEL, 0).collect(), key=lambda r: (r.sequence_id, r.offset))
    topic = [r.id // 1000 for r in order if r.start == 0]
    changes = sum(a != b for a, b in zip(topic, topic[1:]))
    assert changes < 25  # 75 by chance


def test_packing_of_nothing(spark, docs):
    assert _packed(docs.limit(0)) == []
    (one,) = _packed(spark.createDataFrame([(1, None, None, None, 0, 0, 0, 0)], SCHEMA))
    assert (one.length, one.sequence_id, one.offset, zlib.crc32(one.ids)) == (1, 0, 0, zlib.crc32(b"\0\0\0\0"))
    with pytest.raises(ValueError):
        curvepack.pack(docs, BYTE_LEVEL, 0, 1000)


# --- structure repair


def _conversations(rng, n):
    rows = []
    for conv in range(n):
        size = rng.randrange(1, 30) if conv % 7 else rng.randrange(100, 180)
        kind = conv % 5
        for turn in range(size):
            role = {0: "ua"[turn % 2], 1: "u", 2: rng.choice("sua"), 3: "sua"[min(turn, 1) + (turn > 0 and turn % 2 == 0)]}.get(kind, rng.choice("suax"))
            role = {"u": "user", "a": "assistant", "s": "system", "x": rng.choice(["tool", "", None, "User"])}[role]
            text = rng.choice([f"Say {turn}.", f"Cut off {turn}", "Again!", "  ", None, "Odd .\n", f"Why {turn}? \n"])
            if kind == 1 and conv % 2:
                text = f"No end {turn}"
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]) if kind == 4 else turn, role, text))
    return rows


def _repaired(turns, block):
    rows = repair.classed_rows(turns)
    edited = repair.edits(rows, block)
    found = repair.report(rows, edited)
    out = found.join(repair.digests(repair.repaired(turns, rows, edited)), "k", "left").withColumn("digest", F.coalesce("digest", F.sha2(F.lit(""), 256)))
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.digest) for r in out.collect()}


@pytest.mark.parametrize("block", [4096, 7, 3])
def test_structure_repair(spark, block):
    rows = _conversations(random.Random(11), 36)
    rows += [(None, 1, "user", "Hm."), (None, 1, "user", "Hm."), (None, None, None, None), (-5, 0, "assistant", "Alone.")] + [(-6, 1, "user", "Same row.")] * 300
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"k": F.lit(1), "n": F.lit(2), "digest": F.lit("x")}).repartition(5)
    wanted = brute_new.structure_repair(rows, damaging=lambda rs: [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rs])
    assert _repaired(turns, block) == wanted


def test_long_chains_that_never_converge(spark):
    """Runs of one role and of cut-off turns carry the guess through many pieces, beyond the plain passes."""
    rows = [(1, i, "user", f"Ask {i}?") for i in range(90)] + [(2, i, "user", f"Cut {i}") for i in range(91)] + [(3, i, "assistant", f"Cut {i}") for i in range(50)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert _repaired(turns, 4) == brute_new.structure_repair(rows, damaging=lambda rs: rs)


def test_responses_compose_to_the_plain_run():
    rng = random.Random(5)
    for _ in range(60):
        codes = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randrange(1, 25)))
        end = repair._level(repair._closed([rng.randrange(9) for _ in range(4)]))
        assert tuple(repair._apply_costs(repair.responses(codes).reshape(-1).tolist(), list(end))) == repair.backward(codes, end)[0]


def test_fix_up_stops_where_vectors_run_parallel():
    assert repair.fixed_up("uauaua", (0, 0, 0, 0), (0, 10, 5, 0)) is None
    assert repair.fixed_up("u", (0, 0, 0, 0), (0, 10, 5, 0)) == repair.backward("u", (0, 10, 5, 0))[0]


def test_structure_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r[0]: tuple(r)[1:] for r in queries.op12_structure_repair(spark, "/root/testdata/sf0.01").collect()}
    assert found == brute_new.structure_repair(rows)


def test_structure_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert _repaired(none, 4) == {}


# --- token alignment


def _token_bytes():
    import sentencepiece

    chars = {c: b for b, c in bytelevel.byte_chars().items()}
    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def of_a(text):
        e = a.encode(text, add_special_tokens=False)
        return [(i, bytes(chars[c] for c in t)) for i, t in zip(e.ids, e.tokens)]

    def of_b(text):
        out = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            out.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        return out

    return of_a, of_b


def test_token_alignment(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(tokenalign, "BATCH_BYTES", 2000)
    out, totals = tokenalign.align_tokenizers(docs.filter("doc_id is not null"), BYTE_LEVEL, PIECES)
    rows = [(r.doc_id, r.text) for r in docs.filter("doc_id is not null").collect()]
    wanted = brute_new.alignment([t for _, t in rows], *_token_bytes())
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((r.id, *[r[c] for c in columns]) for r in out.collect()) == sorted((i, *w) for (i, _), w in zip(rows, wanted))
    assert totals.groupBy("a", "b").count().filter("count > 1").count() == 0


def test_alignment_of_nothing(docs):
    out, totals = tokenalign.align_tokenizers(docs.limit(0), BYTE_LEVEL, PIECES)
    assert out.count() == 0 and totals.count() == 0
    out, _ = tokenalign.align_tokenizers(docs.filter("text is null or text = ''"), BYTE_LEVEL, PIECES)
    assert {tuple(r)[1:] for r in out.collect()} == {(0, 0, 0, 0, 0, 0, "")}
