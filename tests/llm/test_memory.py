"""What bounds the memory of a task, whatever the input's size (F1)."""

import pyarrow as pa
import pyarrow.parquet as pq

from marketlens.llm import decontam


def test_index_row_groups_hold_few_segments(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 16)
    docs = spark.createDataFrame([(i, f"alpha beta gamma {i}") for i in range(150)], "doc_id long, text string").coalesce(1)
    index = decontam.build_index(docs)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == 150 and max(groups) <= 4
    bench = spark.createDataFrame([("a", "beta gamma 7"), ("b", "gamma 149"), ("c", "delta")], "item_id string, text string")
    found = decontam.phrase_matches(index, bench).collect()
    assert len(found) == 150
    assert {r.id: (r["items"], [(s.start, s.end) for s in r.spans]) for r in found if r["items"]} == {7: (["a"], [(1, 4)]), 149: (["b"], [(2, 4)])}


def test_benchmark_blocks_hold_few_bytes(tmp_path, monkeypatch):
    path = str(tmp_path / "bench.parquet")
    texts = [f"one two three {i}" for i in range(20)] + [None]
    pq.write_table(pa.table({"item": [str(i) for i in range(21)], "text": texts}), path)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    blocks = list(decontam._read_blocks([path], 4))
    assert [i for b in blocks for i in b.ids] == [str(i) for i in range(21)]
    assert max(len(b.ids) for b in blocks) <= 3
