"""Each operator as the first of an application whose workers can't import the package by themselves."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's path only: workers inherit the environment, not this
from marketlens.session import local_session
spark = local_session(cores=2, shuffle_partitions=2)
docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five"), (3, None)], "doc_id long, text string")
items = spark.createDataFrame([("a", "two three four")], "item_id string, text string")
from marketlens.llm import curvepack, decontam, queries, repair, simhash, tokenalign
{call}
spark.stop()
"""

CALLS = {
    "near_duplicates": "assert simhash.near_duplicates(docs).count() == 3",
    "one_of_each": "assert simhash.one_of_each(docs).count() == 2",
    "build_index": "assert decontam.phrase_matches(decontam.build_index(docs), items).filter('size(items) > 0').count() == 2",
    "clean_documents": "assert decontam.clean_documents(docs, items).count() == 1",
    "pack": "assert curvepack.pack(docs, queries._tokenizer_file('byte_bpe_50k.json'), 0, 64).count() >= 3",
    "align_tokenizers": "assert tokenalign.align_tokenizers(docs, queries._tokenizer_file('byte_bpe_50k.json'), queries._tokenizer_file('piece_bpe_32k.model'))[0].count() == 3",
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_first_call(name, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, call=CALLS[name])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
