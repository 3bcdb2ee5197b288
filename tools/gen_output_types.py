"""Regenerate marketlens/plans/output_types.py from the Spark results' schemas.

Records the final (finished) type of every column of each query, so the oracle
can cast its output to exactly the same types.
"""

import pprint
import sys

sys.path.insert(0, ".")
from marketlens.plans.registry import ALL_QUERIES  # noqa: E402
from marketlens.session import local_session  # noqa: E402

spark = local_session()
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
types = {name: [(f.name, f.dataType.simpleString()) for f in q(spark, sf).schema.fields] for name, q in ALL_QUERIES.items()}
with open("marketlens/plans/output_types.py", "w") as fh:
    fh.write('"""Generated by tools/gen_output_types.py: the result type of every column of each query."""\n\n')
    fh.write("OUTPUT_TYPES: dict[str, list[tuple[str, str]]] = " + pprint.pformat(types, width=120, sort_dicts=True) + "\n")
print(len(types), "queries")
