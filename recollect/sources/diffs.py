"""Hunks of unified diffs. Counts from a hunk's header say which lines are its body, so that a body may look like a header."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

HUNKS = "file_path string, hunk_header string, from_line int, from_count int, to_line int, to_count int, added array<string>, removed array<string>, context array<string>, raw_hunk string"
MOST = 2000
HEADER = re.compile(r"@@\s*-(\d+),?(\d*)\s*\+(\d+),?(\d*)\s*@@")


def _path(line: str) -> str:
    name = line[4:].split("\t")[0].strip()
    return re.sub(r"^[ab]/", "", name)


def hunks(text: str | None) -> Iterator[tuple]:
    """HUNKS in order; a file's new name counts, or the old one where it was deleted."""
    old = new = None
    lines = iter((text or "").split("\n"))
    line = next(lines, None)
    while line is not None:
        if line.startswith("diff --git "):
            old = new = None
        elif line.startswith("--- "):
            old = _path(line)
        elif line.startswith("+++ "):
            new = _path(line)
        elif (m := HEADER.match(line)) and (name := new if new and new != "/dev/null" else old):
            a, n_a, b, n_b = (int(x) if x else 1 for x in m.groups())
            left, right, parts, body = n_a, n_b, {"+": [], "-": [], " ": []}, [line]
            line = next(lines, None)
            while line is not None and (left > 0 or right > 0) and not line.startswith(("@@", "diff --git ")):
                sign = line[:1] if line[:1] in ("+", "-", "\\") else " "
                body.append(line)
                if sign != "\\":
                    parts[sign].append(line[1:])
                    left -= sign != "+"
                    right -= sign != "-"
                line = next(lines, None)
            raw = "\n".join(body) + "\n"
            yield name, m[0], a, n_a, b, n_b, parts["+"], parts["-"], parts[" "], raw if len(raw) <= MOST else raw[:MOST] + "…"
            continue
        line = next(lines, None)


def hunks_of(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key and HUNKS of each diff of a table."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    names = [x.split()[0] for x in HUNKS.split(", ")]
    kinds = [pa.string(), pa.string(), *[pa.int32()] * 4, *[pa.list_(pa.string())] * 3, pa.string()]

    def run(batches):
        for batch in batches:
            out = [(k, *h) for k, t in zip(*(c.to_pylist() for c in batch.columns)) for h in hunks(t)]
            columns = list(zip(*out)) if out else [[]] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *kinds])], ["key", *names])

    return diffs.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, f"key string, {HUNKS}")
