"""The registered queries of the numbered operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import chat, curvepack, decontam, licenses, linededup, mixing, quality, repair, simhash, suffixdedup, tokenalign, tokenbin, warc
from marketlens.llm.common import land, small_side, table

END_ID = 2
#: Token-budget and repeated turns of chat windows.
CHAT_BUDGET, CHAT_HISTORY = 128, 2
WORDS = r"[^\x20\x09-\x0D]+"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` to ZIP-packaged archives and read them back."""
    packages = warc.write_packages(table(spark, sf_dir, "pages"))
    return warc.resolved_records(warc.read_packages(packages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, links at four or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token ids of ``documents`` to shards and read them back."""
    manifest = tokenbin.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return tokenbin.read_tokens(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of ``benchmark`` looked up in the stored positional index of ``documents``."""
    found = decontam.phrase_matches(decontam.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    hits = decontam.hit_words("spans")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def op4_benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows by proximity: all words of one, in any order, in a span of at most five words more."""
    found = decontam.near_matches(decontam.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_near",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules, then the MCD verdict of each document's language and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = quality.base_statistics(docs).drop("text")
    return quality.judge(land(stats, "quality-stats")).drop("lang", "source")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 of their sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out, report = mixing.mix(docs, F.array("source"), mixing.word_count("text"), ["doc_id", "source", "text"])
    report = report.withColumnRenamed("source", "__source")
    return out.join(small_side(report), F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", F.col("__words").alias("size"), F.col("source_words").alias("source_size"), "target", (F.col("__copies") * F.col("__words")).alias("taken")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go everywhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all ``conversations`` and of conversation -1, read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    windows = land(chat.format_windows(turns.union(extra), CHAT_BUDGET, CHAT_HISTORY), "chat-windows")
    read = chat.parse_windows(windows).select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("targets", "").alias("loss"),
        ).alias("w"),
        F.size("turns").alias("n"),
        F.char_length("formatted").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda x: x["turns"]), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def document_files(docs: DataFrame) -> DataFrame:
    """``documents`` as a tree: source/language/thousand/id.txt; a document of at most two lines one of which has a licence
    cue is a LICENSE file of its source, language or leaf directory, by its id."""
    top, sub = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    leaf = F.floor(F.col("doc_id") / 1000)
    notice = F.col("text").rlike(licenses.CUE) & (F.size(F.split("text", "\n", -1)) <= 2)
    level = F.pmod("doc_id", F.lit(3))
    above = F.when(level == 0, top).when(level == 1, F.concat_ws("/", top, sub)).otherwise(F.concat_ws("/", top, sub, leaf))
    path = F.when(F.coalesce(notice, F.lit(False)), F.concat_ws("/", above, F.lit("LICENSE"))).otherwise(F.concat_ws("/", top, sub, leaf, F.concat(F.col("doc_id"), F.lit(".txt"))))
    return docs.select("doc_id", path.alias("path"), "text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, own or inherited."""
    files = document_files(table(spark, sf_dir, "documents"))
    return licenses.scan_licenses(files).select("doc_id", "path", "license", "cosine", "license_from", "license_path")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 400-byte strings that start elsewhere too go."""
    out = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    kept = F.octet_length("kept").cast("long").alias("kept_bytes")
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), kept)


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT p.page_id, strlen(p.html) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""

OP4_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
),
b AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
),
windows AS (
    SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
widths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, widths WHERE len(w) >= n)),
hits AS (SELECT p.r, p.n, p.i, x.item FROM places p JOIN windows x ON p.n = x.n AND p.phrase = x.phrase),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.list, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (r) LEFT JOIN items i USING (r)
"""

OP7_SQL = """
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT row_id, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM texts),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10),
marked AS (SELECT keyed.*, key IN (SELECT key FROM common) AS dropped FROM keyed)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY row_id
"""

OP8_SQL = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS pos,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens
    FROM turns
),
sized AS (
    SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {CHAT_BUDGET} AS win,
           24 + length(role) + length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '[<\[][|/sS<I]')) AS size
    FROM placed
),
starts AS (SELECT conv_id, win, min(pos) AS start FROM sized GROUP BY conv_id, win HAVING min(pos) > 0),
repeated AS (
    SELECT DISTINCT t.conv_id, t.win, s.pos, s.size
    FROM starts t JOIN sized s ON s.conv_id = t.conv_id AND (s.pos BETWEEN t.start - {CHAT_HISTORY} AND t.start - 1 OR (s.pos = 0 AND s.role = 'system'))
),
extra AS (SELECT conv_id, sum(size) AS n FROM repeated GROUP BY conv_id)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) + coalesce(any_value(e.n), 0) AS BIGINT) AS formatted_chars
FROM sized s LEFT JOIN extra e ON e.conv_id = s.conv_id GROUP BY s.conv_id
"""

_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*')"
OP9_SQL = rf"""
WITH templates AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES.items())}) AS t(license, text)),
tf AS (SELECT license, term, count(*) AS tf FROM (SELECT license, unnest({_TERMS}) AS term FROM templates) GROUP BY license, term),
size AS (SELECT count(*) AS n FROM templates),
idf AS (SELECT term, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, size GROUP BY term),
raw AS (SELECT license, term, tf * idf AS w FROM tf JOIN idf USING (term)),
weights AS (SELECT license, term, w / sqrt(sum(w * w) OVER (PARTITION BY license)) AS weight FROM raw),
named AS (
    SELECT doc_id, text, coalesce(source, 'none') AS top, coalesce(lang, 'none') AS sub, doc_id // 1000 AS leaf,
           coalesce(regexp_matches(text, '{licenses.CUE}') AND len(string_split(text, chr(10))) <= 2, FALSE) AS notice
    FROM documents
),
files AS (
    SELECT doc_id, coalesce(text, '') AS text, notice,
           CASE WHEN notice AND doc_id % 3 = 0 THEN top WHEN notice AND doc_id % 3 = 1 THEN top || '/' || sub ELSE top || '/' || sub || '/' || leaf END AS dir,
           CASE WHEN notice THEN 'LICENSE' ELSE doc_id || '.txt' END AS name
    FROM named
),
units AS (
    SELECT DISTINCT doc_id, unnest(list_append(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{licenses.CUE}')), CASE WHEN notice THEN text END)) AS text
    FROM files WHERE regexp_matches(text, '{licenses.CUE}')
),
texts AS (SELECT DISTINCT text FROM units WHERE text IS NOT NULL),
vectors AS (SELECT text, term, count(*) * coalesce(any_value(idf), ln(1.0 + any_value(n)) + 1) AS w FROM (SELECT text, unnest({_TERMS}) AS term FROM texts) LEFT JOIN idf USING (term), size GROUP BY text, term),
norms AS (SELECT text, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY text),
scored AS (SELECT text, license, round(sum(w * weight) / any_value(norm), 6) AS cosine FROM vectors JOIN weights USING (term) JOIN norms USING (text) GROUP BY text, license),
best AS (SELECT doc_id, license, cosine FROM units JOIN scored USING (text) WHERE cosine >= 0.6
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
given AS (SELECT dir AS above, license, cosine FROM best JOIN files USING (doc_id) WHERE notice
          QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1),
nearest AS (SELECT f.doc_id, g.* FROM files f JOIN given g ON f.dir = g.above OR starts_with(f.dir, g.above || '/')
            QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.above) DESC) = 1)
SELECT f.doc_id, f.dir || '/' || f.name AS path, coalesce(b.license, n.license) AS license, coalesce(b.cosine, n.cosine) AS cosine,
       CASE WHEN b.license IS NOT NULL AND f.notice THEN 'file' WHEN b.license IS NOT NULL THEN 'header' WHEN n.license IS NOT NULL THEN 'directory' END AS license_from,
       CASE WHEN b.license IS NULL THEN n.above END AS license_path
FROM files f LEFT JOIN best b USING (doc_id) LEFT JOIN nearest n USING (doc_id)
"""

OP10_SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, base, substr(h, 2 * base + 1, 1798) AS part FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399, 500)) AS base FROM texts)),
places AS (SELECT r, base, part, unnest(range(0, least(500, length(part) // 2 - 399))) AS i FROM pieces),
keys AS (SELECT r, base + i AS i, md5(substr(part, 2 * i + 1, 800)) AS k FROM places),
twice AS (SELECT k FROM keys GROUP BY k HAVING count(*) > 1),
starts AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400, TRUE) AS opens FROM keys SEMI JOIN twice USING (k)),
runs AS (SELECT r, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS run FROM starts),
spans AS (SELECT r, run, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, run),
cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
kept AS (
    SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
    FROM cuts JOIN texts USING (r) GROUP BY r
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256, CAST(length(h) // 2 - coalesce(n_removed, 0) AS BIGINT) AS kept_bytes
FROM texts LEFT JOIN kept USING (r)
"""

#: Sequence length and end id of packed documents.
PACK_LENGTH, PACK_END_ID = 1024, 0


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed along the curve, a row a piece."""
    pieces = curvepack.pack(table(spark, sf_dir, "documents"), _tokenizer_file("byte_bpe_50k.json"), PACK_END_ID, PACK_LENGTH)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged by rule, then repaired at least cost."""
    source = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = repair.damaged(source)
    rows = repair.classed_rows(turns)
    edited = repair.edits(rows)
    found = repair.report(rows, edited).drop("conv_id")
    hashed = repair.digests(repair.repaired(turns, rows, edited))
    every = source.groupBy(repair.key("conv_id").alias("k")).agg(F.min("conv_id").alias("conv_id"))
    out = every.join(found, "k", "left").join(hashed, "k", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and piece tokens of all documents, aligned."""
    docs = table(spark, sf_dir, "documents")
    out, _ = tokenalign.align_tokenizers(docs, _tokenizer_file("byte_bpe_50k.json"), _tokenizer_file("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


#: CRC-32 bit by bit; the cheapest edits forwards, a turn of all conversations at a time, least audit per state; at most two
#: inserts can help before a turn or at the end.
OP12_SQL = """
WITH RECURSIVE
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
fated AS (
    SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 20 AS fate
    FROM src
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy,
           CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM fated WHERE fate <> 0
),
placed AS (
    SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
),
rows AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
    FROM placed
),
emit(s, r, t) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
ins AS (
    SELECT s, s AS t, 0 AS n, '' AS lines FROM emit
    UNION ALL SELECT s, t, 1, chr(10) || r || ':' FROM emit
    UNION ALL SELECT a.s, b.t, 2, chr(10) || a.r || ':' || chr(10) || b.r || ':' FROM emit a JOIN emit b ON a.t = b.s
),
edit AS (
    SELECT s, 'D' AS letter, s AS t, 2 AS cost, CAST(NULL AS VARCHAR) AS initial, CAST(NULL AS VARCHAR) AS r FROM emit
    UNION ALL SELECT s, 'R', t, 1, CAST(NULL AS VARCHAR), r FROM emit
    UNION ALL SELECT * FROM (VALUES (0, 'K', 1, 0, 's', CAST(NULL AS VARCHAR)), (0, 'K', 2, 0, 'u', NULL), (1, 'K', 2, 0, 'u', NULL), (2, 'K', 3, 0, 'a', NULL), (3, 'K', 2, 0, 'u', NULL))
),
moves AS (SELECT ins.s, e.t, 5 * n + e.cost AS cost, repeat('I', n) || letter AS letters, letter, initial, r, lines FROM ins JOIN edit e ON ins.t = e.s),
walk AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM damaged
    UNION ALL
    SELECT conv_id, i, s, best.cost, best.audit, best.lines FROM (
        SELECT w.conv_id, f.i, m.t AS s, min({'cost': w.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.letter <> 'D' THEN 5 ELSE 0 END, 'audit': w.audit || m.letters,
            'lines': w.lines || m.lines || CASE WHEN m.letter = 'D' THEN '' ELSE chr(10) || coalesce(m.r, f.role) || ':' || f.text END}) AS best
        FROM walk w JOIN rows f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
        JOIN moves m ON m.s = w.s AND (m.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (m.letter = 'R' OR m.initial = left(f.role, 1)))
        GROUP BY w.conv_id, f.i, m.t
    )
),
counts AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
           count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows GROUP BY conv_id
),
ended AS (
    SELECT w.conv_id, min({'cost': w.cost + 5 * ins.n, 'audit': w.audit || repeat('I', ins.n), 'lines': w.lines || ins.lines}) AS best
    FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN ins ON ins.s = w.s AND ins.t IN (0, 3) GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_token_output": op3_token_output,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op4_benchmark_proximity": op4_benchmark_proximity,
    "op5_quality_rules": op5_quality_rules,
    "op6_source_mix": op6_source_mix,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_license_scan": op9_license_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_packing": op11_packing,
    "op12_structure_repair": op12_structure_repair,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_chat_formatting": OP8_SQL,
    "op9_license_scan": OP9_SQL,
    "op10_suffix_dedup": OP10_SQL,
    "op12_structure_repair": OP12_SQL,
}
