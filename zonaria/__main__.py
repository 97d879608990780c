"""Runs a query of the library: python -m zonaria FOLDER QUERY [--out PATH] [--format parquet|csv|json] [--list]."""

from __future__ import annotations

import argparse

from zonaria.functions.formatting import now_iso
from zonaria.plans import problems, reference
from zonaria.session import build_session, scratch


def main(argv: list[str] | None = None) -> int:
    known = problems.QUERIES | reference.QUERIES
    p = argparse.ArgumentParser(prog="zonaria", description=__doc__)
    p.add_argument("folder", nargs="?")
    p.add_argument("query", nargs="?", choices=sorted(known))
    p.add_argument("--out", help="where to write; without it the first rows are shown")
    p.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    p.add_argument("--list", action="store_true", help="name the queries")
    a = p.parse_args(argv)
    if a.list or not a.query:
        print("\n".join(sorted(known)))
        return 0
    spark = build_session()
    with scratch(spark):
        d = known[a.query](spark, a.folder)
        if a.out:
            d.write.mode("overwrite").option("header", True).format(a.format).save(a.out)
            print(f"{now_iso()} {a.query} -> {a.out}")
        else:
            d.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
