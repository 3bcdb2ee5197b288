"""The pipeline stage by stage: each stage's decisions on its own input, against plain Python versions."""

from collections import Counter

import brute
import corpus_pipeline
from marketlens.llm import mixing
from marketlens.llm.common import land, table
from marketlens.llm.queries import END_ID, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = [[tuple(r) for r in docs.collect()]]
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = land(stage(spark, out, SF), f"test-{name}")
        if name != "token_output":
            assert out.columns == columns
        seen.append([tuple(r) for r in out.collect()])
    start, good, single, clean, mixed, tokens = seen

    # quality: what fails the base rules is gone, and nothing labelled good that passes them
    failed = {r[0] for r in start if brute.base_statistics(r[1])[5]}
    kept = {r[0] for r in good}
    assert not failed & kept and set(good) <= set(start)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert all(r[0] in kept for r in start if labels.get(r[0]) == 1 and r[0] not in failed)

    # near-duplicates: the smallest id of each component
    assert sorted(r[0] for r in single) == sorted({c for _, _, c in brute.near_duplicates([(r[0], r[1]) for r in good])})
    assert set(single) <= set(good)

    # decontamination
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = {k for k, *_, hit in brute.contamination([(r[0], r[1]) for r in single], items) if hit}
    assert sorted(clean) == sorted(r for r in single if r[0] not in dirty)

    # mixing: whole documents up to three times, words near the targets
    copies = Counter(mixed)
    assert set(copies) <= set(clean) and max(copies.values()) <= 3
    words = Counter()
    for r in clean:
        words[r[3]] += len(brute.words(r[1]))
    targets = mixing.targets_by_weight(dict(words))
    largest = {s: max(len(brute.words(r[1])) for r in clean if r[3] == s) for s in words}
    for s, target in targets.items():
        taken = sum(n * len(brute.words(r[1])) for r, n in copies.items() if r[3] == s)
        assert abs(taken - target) <= largest[s]

    # token output, in id order
    want = brute.tokens(sorted((r[0], r[1]) for r in mixed), tokenizer_path(), END_ID)
    assert sorted(tokens, key=lambda r: r[1]) == want


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_stages_on_an_empty_table(spark):
    out = table(spark, SF, "documents").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        out = land(stage(spark, out, SF), f"test-{name}")
        assert out.count() == 0
