"""``python -m quernstone list`` or ``python -m quernstone run NAME FOLDER [ROWS]``."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from quernstone.plans import registry

    if args[:1] == ["list"]:
        print("\n".join(f"{name}\t{(f.__doc__ or '').strip()}" for name, f in sorted(registry.QUERIES.items())))
        return 0
    if args[:1] == ["run"] and len(args) >= 3 and args[1] in registry.QUERIES:
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        registry.QUERIES[args[1]](spark, args[2]).show(int(args[3]) if len(args) > 3 else 20, truncate=80)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
