"""Record the result types of all DuckDB texts: ``python -m workloads.column_types DATA_FOLDER``."""

from __future__ import annotations

import json
import sys
from pathlib import Path

import duckdb

import workloads  # noqa: F401  registers the texts
from contactspark.fixtures import TABLES
from workloads.base import TEXTS, duckdb_text


def main(folder: str) -> None:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    found = {}
    for name, text in TEXTS.items():
        try:
            found[name] = {row[0]: row[1] for row in con.execute(f"describe {duckdb_text(text)}").fetchall()}
        except duckdb.Error as error:
            print(f"{name}: {error}", file=sys.stderr)
    target = Path(__file__).with_name("column_types.json")
    target.write_text(json.dumps(found, indent=0, sort_keys=True) + "\n")


if __name__ == "__main__":
    main(sys.argv[1])
