"""Writing result tables and documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.operators.spatial import BOX_CELL_DEGREES
from cairn.session import cut


def overwrite(rows: DataFrame, path: str) -> None:
    """Replace a whole table; readers see the old or the new files."""
    rows.write.mode("overwrite").parquet(path)


def write_catalogue(places: DataFrame, path: str, files: int | None = None) -> None:
    """Places clustered by search cell, so that box queries skip most row groups."""
    cell = geo.join_cell("lat", "lng", BOX_CELL_DEGREES)
    keyed = places.withColumn("_cell", cell)
    ranged = keyed.repartitionByRange(files, "_cell") if files else keyed.repartitionByRange(
        "_cell")
    overwrite(ranged.sortWithinPartitions("_cell").drop("_cell"), path)


def write_documents(documents: DataFrame, path: str, name: str, content: str) -> None:
    """One text folder per document name; parts of a document stay in order of ``part``."""
    columns = [c for c in ("part",) if c in documents.columns]
    rows = documents.select(F.col(name).cast("string").alias("name"), *columns,
                            F.col(content).alias("value"))
    rows.repartition("name", *columns).sortWithinPartitions("name", *columns).select(
        "name", *columns, "value").write.mode("overwrite").partitionBy("name", *columns).text(path)


#: Files whose names differ only in so many last characters share a folder.
FOLDER_DIGITS = 4


def write_files(rows: DataFrame, path: str, name: str, content: str) -> DataFrame:
    """One text file per name under ``path``, a line per row, written inside the tasks; the number
    of files per task comes back as a table.

    Files lie in folders of up to ten thousand names, which keep the order of names of equal length. A
    file appears under its name when it is whole, so a repeated or ended task leaves no part of one.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        made: set[str] = set()
        current, lines, files = None, [], 0

        def finish() -> int:
            if current is None:
                return 0
            folder = f"{root}/names={current[:-FOLDER_DIGITS] or 'short'}"
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                out.write("".join(lines).encode())
            store.move(hidden, f"{folder}/{current}")
            return 1

        for batch in batches:
            for key, line in zip(batch["name"], batch["value"]):
                if key != current:
                    files += finish()
                    current, lines = key, []
                lines.append(f"{'' if line is None else line}\n")
        files += finish()
        yield pd.DataFrame({"files": [files]})

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    named = rows.select(F.col(name).alias("name"), F.col(content).alias("value"))
    # a number, as the rows are few bytes and would be folded into one task otherwise
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(named.repartition(tasks, "name").sortWithinPartitions("name").mapInPandas(write, "files long"))
