"""Each operator against its plain Python version, on rows with nulls, empty and long texts, ties and repeated rows."""

import io
import random
import zipfile

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import chat, decontam, kernels, licenses, linededup, mixing, quality, queries, simhash, suffixdedup, tokenbin, warc
from marketlens.llm.common import land
from marketlens.llm.components import connected_components

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __fp string, words long"


def _key(row):
    return tuple((x is not None, str(x)) for x in row)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=_key)


def _words(rng, n):
    return " ".join(rng.choice(["the", "of", "red", "Ümlaut", "éclair", "x1", "a*b", "cat,", "DOG", "sun"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents: exact and near copies, shared passages, repeated lines, blank and null texts, null and repeated ids."""
    rng = random.Random(3)
    shared, line = _words(rng, 160), "  Shared Boilerplate Line \t"
    texts = [_words(rng, rng.randrange(1, 150)) for _ in range(40)]
    texts += [texts[0]] * 3 + [texts[1] + " tail"] * 2 + [texts[2].replace("the", "teh", 1), texts[2].upper()]
    texts += [f"{_words(rng, 30)}\n{shared}\n{_words(rng, 20)}" for _ in range(6)]
    texts += [f"{line}\n{_words(rng, 8)}\n{line.strip().upper()}\n\n\n{_words(rng, 3)}\n" for _ in range(12)]
    texts += [None, "", "   ", "\n", "one", "one two three", "\x1f\x00 odd\x0bblank\x0c", "###$$$ " * 60, _words(rng, 6000), "ab" * 900, "ab " * 700]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), None if t is None else len(t), "clash", 7) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, texts[7], None, None, None, None, None), (None, None, "en", "s1", 1, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="module")
def pairs(rows):
    return [(r[0], r[1]) for r in rows]


# --- WARC ------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, small = "<html>" + "é" * 200 + "</html>", "<p>tiny</p>"
    rows = [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "http://ü/", big), (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", ""), (7, "u", "z" * 300_000)]
    rows += [(None, "n", big), (8, "r", "r" * 100), (8, "r", "r" * 100)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    packages = warc.write_packages(pages)
    records = warc.read_packages(packages)
    got = warc.resolved_records(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert _sorted(got.collect()) == _sorted(brute.warc([(i, h) for i, _, h in rows]))
    payloads = {r.page_id: bytes(r.payload).decode() for r in records.filter("record_type = 'response'").collect()}
    assert payloads[3] == big and payloads[7] == "z" * 300_000 and payloads[4] == ""


def test_warc_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    packages = warc.write_packages(pages)
    assert packages.count() == 0 and warc.resolved_records(warc.read_packages(packages)).count() == 0


def _ranges(data: bytes):
    return warc.ZipRanges(lambda at, n: data[at : at + n], len(data))


def test_zip_directories():
    members = [("a.txt", b"first"), ("dir/ü.bin", b"\x00" * 1000), ("empty", b"")]
    packed = warc.zip_stored(members)
    assert {m.filename: zipfile.ZipFile(io.BytesIO(packed)).read(m) for m in zipfile.ZipFile(io.BytesIO(packed)).infolist()} == dict(members)
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        for name, data in members:
            z.writestr(name, data)
        z.writestr(zipfile.ZipInfo("deflated"), b"x" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 in it"
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:  # more entries than a plain end record can count
        for i in range(70_000):
            z.writestr(f"m{i}", str(i))
    for data in (packed, plain.getvalue()):
        found = _ranges(data)
        for name, content in members:
            at = found.data_offset(found.members[name])
            assert data[at : at + found.members[name].size] == content
    found = _ranges(many.getvalue())
    assert len(found.members) == 70_000
    at = found.data_offset(found.members["m69999"])
    assert many.getvalue()[at : at + 5] == b"69999"
    with pytest.raises(ValueError, match="compressed"):
        _ranges(plain.getvalue()).data_offset(_ranges(plain.getvalue()).members["deflated"])
    with pytest.raises(ValueError, match="no end record"):
        _ranges(b"not a zip file at all, but long enough to hold an end record")


# --- SimHash ---------------------------------------------------------------------------------


def test_near_duplicates(docs, pairs):
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert _sorted(got) == _sorted(brute.near_duplicates(pairs))


def test_one_of_each(docs, pairs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute.near_duplicates(pairs)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_one_of_each_with_names_of_its_own(spark, tmp_path):
    """Columns called as the working ones are, a MAP column, repeated rows, null ids; files and plain frames alike."""
    same = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(4, same, 1, "x", {"a": 1}, 7), (4, same, 1, "x", {"a": 1}, 7), (9, same, 2, "y", None, 8), (None, same, 3, "z", None, 9), (5, None, 4, None, None, 1), (6, "", 5, None, None, 2), (7, "other words here", 6, "f", {}, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, file string, at map<string, int>, __fp long")
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    for some in (docs, spark.read.parquet(str(tmp_path / "d"))):
        kept = simhash.one_of_each(some)
        assert kept.columns == docs.columns
        assert sorted(tuple(r)[:3] for r in kept.collect()) == [(4, same, 1), (5, None, 4), (7, "other words here", 6)]
        assert simhash.one_of_each(some.filter("false")).count() == 0


def test_chosen_rows_stay_where_they_are(spark, tmp_path):
    from marketlens.llm import places

    spark.range(1000).withColumn("text", F.repeat(F.lit("x"), F.col("id").cast("int"))).repartition(7).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    file, at = places.place(docs)
    chosen = docs.select("id", file.alias("file"), at.alias("at")).filter("id % 3 = 1").drop("id")
    out = places.rows_at(docs, chosen)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in out.collect()) == list(range(1, 1000, 3))


def test_intermediates_go_once_their_outcome_is_landed(spark):
    import os

    from marketlens.llm import common

    with common.recorded():
        one = land(spark.range(3).toDF("a"), "gone")
        two = land(one.filter("a > 0"), "stays")
    paths = [p for held in common._recorded.values() for p in held][-2:]
    common.release(two)
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, True] and two.count() == 2
    common.release(land(two, "outcome"))
    assert not os.path.exists(paths[1].removeprefix("file:"))


@pytest.mark.parametrize("block", [3, 2000])
def test_near_links_lose_no_connection(spark, block):
    """Clusters of fingerprints at 1 to 6 bits from a centre: blocks as small as three rows connect what all pairs connect."""
    rng = random.Random(11)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(40)}
    prints = sorted(prints)
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 4:
                up[max(find(p), find(q))] = min(find(p), find(q))
    want = {}
    for p in prints:
        want.setdefault(find(p), set()).add(p)
    signed = [p - (p >> 63 << 64) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
    found = connected_components(simhash.near_links(frame, 4, block)).collect()
    got = {}
    for r in found:
        got.setdefault(r.component, set()).add(r.node % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_chain_filter_keeps_every_near_pair():
    rng = np.random.default_rng(5)
    for bits in range(5):
        diff = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(2000)], np.uint64)
        assert simhash.chain_within(diff, 4).all()
    far = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    assert simhash.chain_within(far, 4).mean() < 0.01


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 3), (10, 11), (None, 4), (11, 10)] + [(i, i + 1) for i in range(100, 160)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {i: 100 for i in range(100, 161)}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


# --- Token output ----------------------------------------------------------------------------


def test_tokens_round_trip(spark, docs, rows):
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    manifest = tokenbin.write_tokens(docs, path, 2)
    found = tokenbin.read_tokens(manifest).collect()
    ordered = sorted(found, key=lambda r: r.start)
    ids = [r.id for r in ordered]
    assert ids == sorted([i for i in ids if i is not None]) + [None] * ids.count(None)
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r[1])
    at = 0
    for r in ordered:
        want = [x for t in by_id[r.id] for x in brute.tokens([(r.id, t)], path)]
        assert (r.n_tokens, brute.zlib.crc32(bytes(r.ids))) in {(n, c) for _, _, n, c in want}
        assert r.start == at
        at += r.n_tokens
    assert len(ordered) == len(rows)


def test_short_document_access(spark, docs):
    import public_tokenizers

    manifest = tokenbin.write_tokens(docs, str(public_tokenizers.path("word_bpe_49k.json")), 2, shards=2).orderBy("shard").collect()
    first = tokenbin.Shard(manifest[0].path, manifest[0].dictionary)
    assert first.keys(0, 1) == [0]
    assert np.frombuffer(first.document(0), "<u4")[-1] == 2
    with pytest.raises(ValueError, match="another dictionary"):
        tokenbin.Shard(manifest[0].path, manifest[0].path)


def test_dictionary_does_not_depend_on_arrival(spark, docs, monkeypatch):
    """The byte limit of the sample cuts by hash, so partitions and row order decide nothing."""
    from marketlens.llm.queries import tokenizer_path

    monkeypatch.setattr(tokenbin, "SAMPLE_BYTES", 6_000)
    monkeypatch.setattr(tokenbin, "text_chunks", lambda batches, c: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    many = docs.select("text").union(spark.range(300).select(F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.lit("one two three four five six")).alias("text")))
    before, made = spark.conf.get("spark.sql.shuffle.partitions"), set()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for n in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        made.add(tokenbin.train_dictionary(many.repartition(n), tokenizer_path(), 2, "text", True))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made) == 1 and len(made.pop()) > 0


def test_tokens_empty_table(empty):
    import public_tokenizers

    manifest = tokenbin.write_tokens(empty, str(public_tokenizers.path("word_bpe_49k.json")), 2)
    assert manifest.count() == 0 and tokenbin.read_tokens(manifest).count() == 0


def test_pieces_encode_like_whole_texts():
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " ", "Hello  World's\tit's 12345 a b   été ΣΑΣ σας <|endoftext|> <|startoftext|>x \x1c\x1d y\x85z ﬁn İ 中文 字\n\n", "don't-stop… 'll 've", "Ça ÉTÉ, naïve×÷ß12x3.é-à ñandú¿¡", "e\u0301 a\u0338 =\u0338 <\u0338 A\u030a", "abc12,,def!!GHI$$$ x*y <b>t</b>", "ÿÀ\xadÖ"]
    texts += ["".join(random.Random(i).choices("aZé'1,.<|> \n#ßÖ…\u0301中-", k=200)) for i in range(40)]
    col = pa.array([*texts, None])
    assert tokenbin.Encoder(path, True).encode(col) == tokenbin.Encoder(path, False).encode(col)
    assert tokenbin.Encoder(path, True).encode(pa.array(["", None])) == [b"", b""]


# --- Decontamination -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def items(rows):
    long = rows[0][1].split()
    passage = " ".join(rows[60][1].split()[40:60])
    return [(1, passage), (2, "one TWO three"), (10, " ".join(long[3:9])), (3, None), (4, "***"), (5, " ".join(long[:30])), (5, "zzz"), (None, "one"), (7, "never seen words here at all in any text of these")]


def test_decontamination(spark, docs, items, pairs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.phrase_matches(decontam.build_index(docs), bench)
    got = found.select("id", "n_words", decontam.hit_words("spans"), F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256), decontam.hit_words("spans") > 0)
    want = brute.contamination(pairs, items)
    assert _sorted(got.collect()) == _sorted(want)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert _sorted(r[0:1] for r in clean.select("doc_id").collect()) == _sorted((r[0],) for r in want if not r[5])


def test_benchmark_in_blocks(spark, docs, items, monkeypatch):
    """Several files and small blocks give what one block gives."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = _sorted(decontam.phrase_matches(decontam.build_index(docs), bench.coalesce(1)).collect())
    assert _sorted(decontam.phrase_matches(decontam.build_index(docs), bench.repartition(4)).collect()) == whole


def test_proximity(spark):
    texts = [(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 9 + "beta gamma"), (3, "gamma beta alpha"), (4, None)]
    index = decontam.build_index(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    # the rarest word of the segment is the anchor; all three stand once in each document
    got = {r.id for r in decontam.proximity_matches(index, "Alpha BETA gamma", 5).collect()}
    assert got == {1, 3}
    assert decontam.proximity_matches(index, "alpha delta", 50).count() == 0
    assert decontam.proximity_matches(index, "", 5).count() == 0


def test_proximity_does_not_depend_on_other_documents(spark):
    """The rarest word of a segment decides nothing: a span must hold all words, whatever stands beside it."""
    text = "a x x x x b x x x x c"
    for others in (["a c " * 9], ["b a " * 9], ["b c " * 9], []):
        rows = [(1, text), (2, "c a x x x b"), *((9, o.replace(" ", " | ")) for o in others)]
        index = decontam.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
        assert {(r.id, r.position) for r in decontam.proximity_matches(index, "a b c", 5).collect()} == {(2, 0)}
        assert {(r.id, r.position) for r in decontam.proximity_matches(index, "a b c", 10).collect() if r.id == 1} == {(1, 0)}


def test_benchmark_proximity(spark, docs, items, pairs, monkeypatch):
    """Benchmark windows by proximity against plain Python, however rows are packed; shuffled and padded words are found."""
    long = pairs[0][1].replace("*", " ").split()[:10]
    mixed = long[5:] + ["pad", "pad"] + long[:5]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(900, " ".join(mixed)), (901, " ".join(long[::-1]))], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.proximity([*pairs, (900, " ".join(mixed)), (901, " ".join(long[::-1]))], items)
    for parts in (1, 5):
        got = decontam.near_matches(decontam.build_index(more.repartition(parts)), bench.repartition(parts))
        assert _sorted(got.collect()) == _sorted(want)
    by = {r[0]: r for r in want}
    assert by[900][3] and by[901][3]
    exact = {r[0] for r in brute.contamination(pairs, items) if r[5]}
    assert exact <= {r[0] for r in want if r[3]}
    monkeypatch.setattr(decontam, "CANDIDATES", 3)
    segment = decontam.Segment.of_text(pa.array([" ".join(mixed)] * 9))
    block = decontam._Block(["5"], pa.array([pairs[0][1]]), 10)
    row, start = segment.near(segment.lookup(block.digests), block.windows[10][0], 15)
    assert set(segment.doc_of[start].tolist()) == set(range(9)) and len(row) == len(start)


def test_decontamination_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.phrase_matches(decontam.build_index(empty), none).count() == 0
    assert decontam.phrase_matches(decontam.build_index(docs), none).filter("size(spans) > 0").count() == 0


def test_word_digests_follow_the_words():
    texts = ["Ab-c é9!x", "", None, "x", "-"]
    digests, word, row = kernels.word_digests(*decontam.packed_text(pa.array(texts)))
    assert row.tolist() == [0, 0, 0, 0, 3]
    assert word[3] == word[4] and len(set(word.tolist())) == 4 == len(set(digests.tolist()))


def _complements(n=1024, letters="ab"):
    """Two words that any polynomial hash modulo 2^64 with an odd base takes for one: a Thue-Morse word and its complement."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_words_of_one_hash_are_two_words():
    one, other = _complements()
    data, offsets = decontam.packed_text(pa.array([one, other, one, f"{other} {one}"]))
    starts, ends = np.array([0, 1024, 2048, 3072, 4097]), np.array([1024, 2048, 3072, 4096, 5121])
    assert len(set(kernels.range_hashes(data, starts, ends).tolist())) == 1
    at, which = kernels.distinct_ranges(data, starts, ends)
    assert which.tolist() == [which[0], which[1], which[0], which[1], which[0]] and which[0] != which[1] and len(at) == 2


def test_no_match_of_words_of_one_hash(spark):
    one, other = _complements()
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    items = spark.createDataFrame([("i", other)], "item_id string, text string")
    found = {r.id: r["items"] for r in decontam.phrase_matches(decontam.build_index(docs), items).collect()}
    assert found == {1: [], 2: ["i"]}


def test_tokens_of_words_of_one_hash(spark):
    from tokenizers import Tokenizer

    one, other = _complements()
    texts = [f"{one} {other}", other, one]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenbin.read_tokens(tokenbin.write_tokens(docs, queries.tokenizer_path(), 2, shards=1)).collect()}
    assert got == {i: [*whole.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_different_texts_of_one_hash_stay(spark):
    """Surroundings of one rolling hash, and windows of one, are told apart by their digests."""
    one, other = _complements(2048, "xy")
    for texts in ([one, other], [one[:1024] + "Q" * 500, other[:1024] + "Q" * 500], [one + "1" * 400 + other, one]):
        rows = list(enumerate(texts))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        for hot in (50_000, 0):
            out = suffixdedup.remove_repeats(docs, hot=hot).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256))
            assert _sorted(out.collect()) == _sorted(brute.repeats(rows))


def test_a_text_of_very_many_lines(spark):
    import time

    lines = "\n".join(f"line {i}" for i in range(200_000))
    docs = spark.createDataFrame([(i, lines if i == 0 else "line 7\nx") for i in range(12)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped").collect()}
    assert got == {0: (200_000, 1)} | {i: (2, 2) for i in range(1, 12)}
    assert time.time() - began < 60


# --- Quality ---------------------------------------------------------------------------------


def test_base_statistics(docs, pairs):
    got = quality.base_statistics(docs.drop("words")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert _sorted(got.collect()) == _sorted((k, *brute.base_statistics(t)) for k, t in pairs)


def test_good_documents_keep_columns(docs, empty):
    out = quality.good_documents(docs)
    assert out.schema.names == docs.columns
    assert quality.good_documents(empty).count() == 0


def test_mcd_rejects_planted_outliers(spark):
    """400 ordinary documents in two groups, and in each some that are full of symbols or of very long words."""
    rng = random.Random(8)
    plain = [(i, " ".join("".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(rng.randrange(60, 400))), ["en", "de"][i % 2], "s") for i in range(400)]
    odd = [(1000 + i, " ".join(w + "###" for w in plain[i][1].split()), "en", "s") for i in range(30)]
    odd += [(2000 + i, plain[i][1].replace(" ", "")[:900] + (" " + "q" * 70) * 25 + f" {i} a b c d e f g", "de", "s") for i in range(15)]
    frame = spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.good_documents(frame).select("doc_id").collect()}
    assert len([p for p in plain if p[0] in kept]) >= 396
    assert not any(o[0] in kept for o in odd)


def test_mcd_steps_go_on_until_the_determinant_settles(spark):
    """No further step lowers the determinant of a skewed, contaminated group."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, quality.P)) @ rng.normal(size=(quality.P, quality.P)) + rng.exponential(2, size=(3000, quality.P))
    x[:700] += 5 * rng.random((700, 1)) + 2
    x = np.round(x * quality.SCALE).astype(int)
    cells = land(spark.createDataFrame([("g", 1.0, *map(int, r)) for r in x], "gid string, w double, " + ", ".join(f"{d} long" for d in quality.DIMS)), "test")
    got = quality.mcd_estimates(cells).first()
    mean = np.array([got[f"m_{i}"] for i in range(quality.P)])
    low = np.array([[got[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(quality.P)] for i in range(quality.P)])
    bins = np.floor(np.log2((np.linalg.solve(low, (x / quality.SCALE - mean).T) ** 2).sum(axis=0) + 1e-3) * 16)
    inside = x[bins <= np.sort(bins)[int(np.ceil(0.75 * len(x))) - 1]] / quality.SCALE
    after = np.cov(inside.T, bias=True) * quality.CONSISTENCY + np.diag([f**2 for f in quality.FLOORS.values()])
    assert np.linalg.slogdet(after)[1] / 2 >= np.log(np.diag(low)).sum() - 1e-6


def test_labels_hold_on_the_small_table(spark):
    """Held-out accuracy: documents labelled good that pass the base rules stay, those labelled bad go."""
    sf = "/root/testdata/sf0.01"
    frame = quality.judge(land(quality.base_statistics(spark.read.parquet(f"{sf}/documents.parquet")).drop("text"), "test"))
    labelled = frame.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    good, good_kept, bad, bad_kept = labelled.agg(
        F.count_if(F.col("quality") == 1), F.count_if((F.col("quality") == 1) & F.col("kept")), F.count_if(F.col("quality") == 0), F.count_if((F.col("quality") == 0) & F.col("kept"))
    ).first()
    assert good_kept >= 0.995 * good and bad_kept <= 0.1 * bad


# --- Mixing ----------------------------------------------------------------------------------


def test_targets_by_weight():
    got = mixing.targets_by_weight({"b": 100, "a": 1000, None: 10, "c": 1000})
    # weights 5, 2, 1 for a, b, c and 5 for null; null stops at 30
    assert got[None] == 30 and sum(got.values()) == 2110
    assert got["a"] / got["c"] == 5 and got["b"] <= 300


def test_flow_prefers_fresh_words_and_fills_quotas():
    patterns = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    flow = mixing.route(patterns, {"a": 150, "b": 60})
    into = {s: sum(f.get(s, 0) for f in flow.values()) for s in "ab"}
    assert into == {"a": 150, "b": 60}
    assert all(sum(f.values()) <= mixing.MAX_COPIES * patterns[p] for p, f in flow.items())
    # 210 words for 210 quota: everything once, nothing repeated
    assert [sum(flow[p].values()) for p in patterns] == [100, 100, 10]
    short = mixing.route({("a",): 10}, {"a": 100})
    assert short[("a",)]["a"] == 30


def test_disjoint_sources_go_through_the_network(monkeypatch):
    """Sources of their own are networks like others, of the amounts that fill the quota or three copies."""
    sizes, real = [], mixing._min_cost_flow
    monkeypatch.setattr(mixing, "_min_cost_flow", lambda n, *a: (sizes.append(n), real(n, *a))[1])
    patterns = {("a",): 100, (None,): 7, ("b",): 10, ("c", "d"): 40, ("d", "e"): 40, ("f",): 0}
    flow = mixing.route(patterns, {"a": 150, None: 30, "b": 4, "c": 40, "d": 20, "e": 20, "f": 9})
    assert sorted(sizes) == [4, 4, 4, 4, 7]
    assert (flow[("a",)], flow[(None,)], flow[("b",)], flow[("f",)]) == ({"a": 150}, {None: 21}, {"b": 4}, {})
    assert sum(flow[("c", "d")].values()) == sum(flow[("d", "e")].values()) == 40


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), _words(rng, rng.randrange(0, 60))) for i in range(600)] + [(9999, "b", None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out, report = mixing.mix(frame.repartition(3), F.array("source"), mixing.word_count("text"), ["doc_id", "source", "text"])
    again, _ = mixing.mix(frame.repartition(7), F.array("source"), mixing.word_count("text"), ["doc_id", "source", "text"])
    got = {r.doc_id: (r["__copies"], r["__words"]) for r in out.collect()}
    assert got == {r.doc_id: (r["__copies"], r["__words"]) for r in again.collect()}
    assert max(c for c, _ in got.values()) <= 3
    assert all(w == len(brute.words(t)) for (i, _, t) in rows for _, w in [got[i]])
    for r in report.collect():
        taken = sum(got[i][0] * got[i][1] for i, s, _ in rows if s == r.source)
        assert abs(taken - r.target) <= 5, (r, taken)
    copies = mixing.mixed_documents(frame)
    assert copies.columns == frame.columns and copies.count() == sum(c for c, _ in got.values())


def test_mix_of_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 3 == 0 else ["a"], "w " * 10) for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, members array<string>, text string")
    out, report = mixing.mix(frame, F.col("members"), mixing.word_count("text"), ["doc_id"], weights=(1, 1))
    total = out.agg(F.sum(F.col("__copies") * F.col("__words"))).first()[0]
    assert abs(total - sum(r.target for r in report.collect())) <= 10


def test_mix_empty_table(empty):
    out, report = mixing.mix(empty, F.array("source"), mixing.word_count("text"), ["doc_id"])
    assert out.count() == 0 and report.count() == 0


# --- Lines -----------------------------------------------------------------------------------


def test_line_dedup(docs, pairs, empty):
    out = linededup.dedup_lines(docs)
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    want = brute.line_dedup(pairs)
    assert _sorted(got.collect()) == _sorted(want) and any(r[2] for r in want)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert linededup.dedup_lines(empty).count() == 0


# --- Chat ------------------------------------------------------------------------------------


CHATS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi " * 50), (1, 2, "assistant", "a <|im_end|> b \\<| <\\| \\\\"), (1, 3, "user", None), (1, 4, "assistant", "x " * 200),
    (1, 5, "user", "u"), (1, 6, "assistant", "<<SYS>> [INST] <s></s> <</SYS>> [/INST]\n<|im_start|>user\n"), (2, None, "assistant", "late"), (2, 3, "assistant", "tie"), (2, 3, "assistant", "tie"),
    (None, 1, "user", "no id"), (None, 2, "assistant", "still"), (3, 0, None, ""), (3, 1, "=odd role\n|", "t"), (4, 0, "assistant", "é" * 10),
]


@pytest.mark.parametrize("budget,history", [(20, 0), (20, 2), (64, 3), (10_000, 2)])
def test_chat_round_trip(spark, budget, history):
    many = [(7, i, ["user", "assistant"][i % 2], f"turn {i} " * (i % 7)) for i in range(200)]
    frame = spark.createDataFrame(CHATS + many, "conv_id long, turn long, role string, text string").repartition(4)
    windows = chat.parse_windows(chat.format_windows(frame, budget, history))
    got = {}
    for r in sorted(windows.collect(), key=lambda r: r.window):
        c = got.setdefault(r.conv_id, ([], []))
        c[0].extend((t.role, t.text) for t in r.turns)
        c[1].extend(r.targets)
        assert r.n_context <= history + 1
    result = {c: (len(t), brute.sha("".join(f"{a}\n{b}\n" for a, b in t)), len("".join(x)), brute.sha("".join(x))) for c, (t, x) in got.items()}
    assert result == brute.chats(CHATS + many)


def test_chat_windows_repeat_the_system_turn(spark):
    frame = spark.createDataFrame(CHATS[:7], "conv_id long, turn long, role string, text string")
    later = chat.format_windows(frame, 20, 1).filter("window > 0").collect()
    assert later and all(r.formatted.startswith("<|im_start|>system\nbe brief<|im_end|>\n") for r in later)
    assert chat.format_windows(frame.filter("false"), 20, 1).count() == 0


# --- Licences --------------------------------------------------------------------------------


def test_license_scan(spark):
    files = [
        ("LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/d.py", "deep"), ("a/b/h.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("a/b/c/LICENSE", "no match here licence"), ("z", None), (None, "Released under the MIT License."),
        (None, "nothing"), ("a/x.py", "code"), ("q/e.txt", ""),
    ]
    got = licenses.scan_licenses(spark.createDataFrame([(*f, "x") for f in files], "path string, text string, license_note string")).collect()
    by = {(r.path, r.license_from): (r.license, r.license_path) for r in got}
    assert by[("LICENSE", "file")] == ("MIT", None)
    assert by[("a/x.py", "directory")] == ("MIT", "")
    assert by[("a/b/c/d.py", "directory")] == ("GPL-3.0", "a/b")
    assert by[("a/b/h.py", "header")] == ("Apache-2.0", None)
    assert by[("a/b/c/LICENSE", "directory")] == ("GPL-3.0", "a/b")
    assert by[(None, "header")] == ("MIT", None) and by[(None, None)] == (None, None)
    assert len(got) == len(files)
    assert licenses.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


MIT_TEXT = """Copyright 2021 Jo Doe <jo@example.org>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def _gnu(mark, name, version, what="program"):
    text = f"""Copyright (C) 2019  Jo Doe

This {what} is free software: you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} for more details.

You should have received a copy of the GNU {name}
along with this {what}.  If not, see <https://www.gnu.org/licenses/>."""
    return "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n")) + "\nint x;\n"


def test_license_headers_and_texts(spark):
    """Standard headers, tags and licence texts that are in no test table; likenesses to another licence are no match."""
    bsd2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE AUTHOR ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.\n"
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n"
    want = {
        "spdx/a.c": ("// SPDX-License-Identifier: MIT\nint x;", "MIT", "header"),
        "spdx/b.py": ("#!/bin/sh\n# SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0", "header"),
        "spdx/c.h": ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0", "header"),
        "spdx/d.h": ("/* SPDX-License-Identifier: LGPL-2.1-or-later */", "LGPL-2.1", "header"),
        "spdx/e.h": ("/* SPDX-License-Identifier: Zlib */", None, None),
        "spdx/f.h": ("/* SPDX-License-Identifier: BSD-4-Clause */", None, None),
        "h/gpl3.py": (_gnu("#", "General Public License", 3), "GPL-3.0", "header"),
        "h/gpl2.c": (_gnu(" *", "General Public License", 2), "GPL-2.0", "header"),
        "h/agpl.js": (_gnu("//", "Affero General Public License", 3), "AGPL-3.0", "header"),
        "h/lgpl.cc": ("/*\n" + _gnu("", "Lesser General Public License", 2.1, "library").replace("int x", "*/ int x"), "LGPL-2.1", "header"),
        "h/go.go": ("// Copyright 2014 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style license that can be\n// found in the LICENSE file.\npackage x", "BSD-3-Clause", "header"),
        "h/apache.java": ("/*\n * Copyright 2020 Jo Doe\n *\n" + "".join(f" * {x}\n" for x in apache.split("\n")) + " */\nclass X {}", "Apache-2.0", "header"),
        "h/mit.css": ("/*\n" + MIT_TEXT + "*/\nbody {}", "MIT", "header"),
        "h/prose.txt": ("She had lost her driving licence, and the man at the desk of the office told her to come back\nwith a copy of it in the morning, or to ask for the form of the other office.", None, None),
        "mit/LICENSE": (MIT_TEXT, "MIT", "file"),
        "mit/src/x.c": ("int x;", "MIT", "directory"),
        "bsd/LICENSE.txt": ("Copyright (c) 2020, Jo Doe\n\n" + bsd2, "BSD-2-Clause", "file"),
        "bsd/y.c": ("int y;", "BSD-2-Clause", "directory"),
        "agpl/COPYING": ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n", "AGPL-3.0", "file"),
    }
    got = licenses.scan_licenses(spark.createDataFrame([(k, v[0]) for k, v in want.items()], "path string, text string").repartition(3)).collect()
    assert {r.path: (r.license, r.license_from) for r in got} == {k: v[1:] for k, v in want.items()}


def test_license_units_of_long_texts(spark):
    """Long runs of blank or comment lines and open comment marks neither overflow a pattern's stack nor hide a tag."""
    text = "\n" * 60_000 + "# x\n" * 60_000 + "/* " * 20_000 + "\nSPDX-License-Identifier: MIT"
    r = licenses.scan_licenses(spark.createDataFrame([("a", text)], "path string, text string")).first()
    assert (r.license, r.cosine) == ("MIT", 1.0)


def test_license_paths(spark):
    r = spark.range(1).select(licenses.ancestors(licenses.directory(F.lit("a/b/c.txt"))).alias("x"), licenses.ancestors(licenses.directory(F.lit("c.txt"))).alias("y"), licenses.ancestors(licenses.directory(F.lit("/r/c"))).alias("z")).first()
    assert (r.x, r.y, r.z) == (["", "a", "a/b"], [""], ["", "/r"])


# --- Suffixes --------------------------------------------------------------------------------


@pytest.mark.parametrize("length,hot", [(64, 50_000), (65, 50_000), (64, 1), (400, 50_000)])
def test_remove_repeats(docs, pairs, length, hot):
    out = suffixdedup.remove_repeats(docs, length=length, hot=hot)
    got = out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256))
    assert _sorted(got.collect()) == _sorted(brute.repeats(pairs, length))


def test_remove_repeats_empty_table(empty):
    assert suffixdedup.remove_repeats(empty, length=64).count() == 0


def test_loser_tree_merges_like_sorting():
    rng = random.Random(2)
    for _ in range(60):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randrange(0, 9))) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 9))]
        coded = [suffixdedup.front_code([(k, k[::-1], 1, i) for i, k in enumerate(r)]) for r in runs]
        merged = list(suffixdedup.merge_runs([suffixdedup.front_decode(c) for c in coded]))
        keys = [m[0] for m in merged]
        assert keys == sorted(k for r in runs for k in r)
        assert all(m[1] == m[0][::-1] for m in merged)
        assert [m[4] for m in merged[1:]] == [suffixdedup.common_prefix(a, b) for a, b in zip(keys, keys[1:], strict=False)]


def test_large_groups_agree_with_pairs():
    """The classes used for groups of more than 24 contexts give what comparing all pairs gives."""
    rng = random.Random(9)
    base = bytes(rng.choices(b"xyz", k=200))
    group = set()
    for _ in range(60):
        right, left = bytearray(base[100:164]), bytearray(base[68:100])
        right[rng.randrange(32, 64)] ^= rng.choice([0, 1])
        left[rng.randrange(32)] ^= rng.choice([0, 1])
        group.add((bytes(8) + bytes(right[: rng.choice([40, 64])]), bytes(left[rng.choice([0, 10]) :])[::-1]))
    entries, before = [], b""
    for i, (k, l) in enumerate(sorted(group)):
        entries.append((k, l, 1, i, suffixdedup.common_prefix(before, k)))
        before = k
    assert len(entries) > 24

    def places(found):
        return {c: {d for a, b in spans for d in range(a, b + 1)} for c, spans in found.items()}

    whole = places(suffixdedup.equal_offsets(entries, 64))
    want = {}
    for i in range(len(entries)):
        for j in range(i):
            for c, ds in places(suffixdedup.equal_offsets([entries[j], entries[i]], 64)).items():
                want.setdefault(c, set()).update(ds)
    assert {c: d for c, d in whole.items() if d} == want
