"""Print the formatted physical plan of registered queries.

Usage: python tools/explain.py [sf_dir] name [name ...]
"""

import sys

sys.path.insert(0, ".")
from marketlens.plans.registry import ALL_QUERIES  # noqa: E402
from marketlens.session import local_session  # noqa: E402

args = sys.argv[1:]
sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
spark = local_session()
for name in args:
    print(f"===== {name}")
    ALL_QUERIES[name](spark, sf).explain("formatted")
