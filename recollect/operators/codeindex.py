"""A queryable index of source code: file, symbol and dependency rows, module facts, updates by checksum, diffs, exploring."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import staging
from ..functions import text
from ..sources import code
from . import search

NAMES_SHOWN, SYMBOLS_EACH_HUNK = 15, 10
#: Importance of rows by kind; symbols by whether they are exported.
FILE, EXPORTED, INTERNAL, DEPENDENCY, DIFF = 0.3, 1.5, 0.8, 0.2, 1.2


def parsed(files: DataFrame) -> DataFrame:
    """path, kind (symbol or import), module (of an import) and the symbol's columns, for files of (path, text)."""
    names = [x.split()[0] for x in code.SYMBOL_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, source in zip(*(c.to_pylist() for c in batch.columns)):
                found = code.parse(source or "", path)
                out += [(path, "symbol", None, *[s[k] for k in names]) for s in found.symbols]
                out += [(path, "import", m, None, None, None, None, None, line, None, None, None) for m, line in found.imports]
            columns = list(zip(*out)) if out else [[]] * (3 + len(names))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + kinds)], ["path", "row_kind", "imported", *names])

    return files.select("path", "text").mapInArrow(run, f"path string, row_kind string, imported string, {code.SYMBOL_SCHEMA}")


def symbol_body(qualified: Column) -> Column:
    hint = F.when(F.col("arity") > 0, F.concat(F.lit("("), F.col("arity").cast("string"), F.when(F.col("vararg"), "+").otherwise(""), F.lit(" args)"))).when(F.col("vararg"), "(...)").otherwise("")
    doc = F.when(F.coalesce("docstring", F.lit("")) != "", F.concat("docstring", F.lit(" — "))).otherwise("")
    return F.concat(doc, F.col("symbol_type"), F.lit(" "), qualified, hint)


def rows_of(files: DataFrame, project: str = "default") -> dict[str, DataFrame]:
    """Memory rows (symbols, dependencies, files) and module facts of a project's files (path, text)."""
    found = parsed(files)
    scope, module = F.lit(f"codeindex:{project}"), text.path_module(F.col("path"))
    symbols = found.where("row_kind = 'symbol'")
    qualified = F.concat(module, F.lit("."), F.regexp_replace("full_name", "^[^.:]+[.:]", ""))
    meta = lambda **x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k), v.cast("string"))])
    symbol_rows = symbols.select(scope.alias("scope"), F.lit("symbol").alias("kind"), qualified.alias("title"), symbol_body(qualified).alias("body"), F.when(F.col("exported"), EXPORTED).otherwise(INTERNAL).alias("importance"), meta(path=F.col("path"), line=F.col("line"), name=F.col("name"), full_name=F.col("full_name"), symbol_type=F.col("symbol_type"), module=module).alias("metadata"))
    imports = found.where("row_kind = 'import'").select("path", "imported", "line").distinct()
    dependency_rows = imports.select(scope.alias("scope"), F.lit("dependency").alias("kind"), F.concat(module, F.lit(" -> "), F.col("imported")).alias("title"), F.concat(F.col("path"), F.lit(" requires "), F.col("imported")).alias("body"), F.lit(DEPENDENCY).alias("importance"), meta(from_path=F.col("path"), module=F.col("imported"), line=F.col("line")).alias("metadata"))
    shown = F.array_sort(F.collect_list(F.struct((~F.col("exported")).alias("hidden"), "line", "name")))
    names = symbols.groupBy("path").agg(F.slice(F.array_distinct(F.transform(shown, lambda s: s["name"])), 1, NAMES_SHOWN).alias("names"))
    body = F.concat_ws(" — ", "path", F.nullif(text.path_words(F.col("path")), F.lit("")), F.when(F.size("names") > 0, F.concat(F.lit("defines: "), F.array_join("names", ", "))))
    # a row for each file, on either side: Spark would take what is parsed for as small as the files' keys, and send it through the driver
    file_rows = files.join(names.hint("merge"), "path", "left").select(scope.alias("scope"), F.lit("file").alias("kind"), F.col("path").alias("title"), body.alias("body"), F.lit(FILE).alias("importance"), meta(path=F.col("path"), checksum=text.source_checksum(F.col("text"))).alias("metadata"))
    facts = imports.select(scope.alias("scope"), module.alias("subject"), F.lit("requires").alias("predicate"), F.col("imported").alias("object")).distinct()
    return {"symbols": symbol_rows, "dependencies": dependency_rows, "files": file_rows, "facts": facts}


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, imported) with target: a/b.lua, or a/b/init.lua, if such a file exists."""
    base = F.regexp_replace("imported", r"\.", "/")
    known = files.select(F.col("path").alias("target"))
    one = imports.join(known, F.concat(base, F.lit(".lua")) == F.col("target"), "left")
    two = one.join(known.withColumnRenamed("target", "other"), F.concat(base, F.lit("/init.lua")) == F.col("other"), "left")
    return two.withColumn("target", F.coalesce("target", "other")).drop("other")


def sync(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, status (new, modified, unchanged, deleted) of stored and current checksums (path, checksum)."""
    both = stored.withColumnRenamed("checksum", "old").join(current.withColumnRenamed("checksum", "new"), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """full_name, change (added, removed, changed, unchanged) by signature (line, arity, vararg, docstring)."""
    sign = lambda d, name: d.select("full_name", F.struct("line", "arity", "vararg", "docstring").alias(name))
    both = sign(old, "a").join(sign(new, "b"), "full_name", "full_outer")
    return both.select("full_name", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed").alias("change"))


#: Lines of a bin of the join of hunks with symbols.
BIN_LINES = 64


def within(spans: DataFrame, points: DataFrame, on: Column, first: Column, last: Column, at: Column, width: int = BIN_LINES) -> DataFrame:
    """spans join points where on holds and at is from first to last, both included.

    A span goes to all bins that it touches and a point to its own, so that each pair meets once, by an equi-join: a path
    with very many points is dealt by their bins. Spans that end before they begin, or have a null end, meet nothing.
    """
    bins = F.sequence(F.floor(first / width), F.floor(last / width))
    left = spans.where(first <= last).withColumn(BIN, F.explode(bins))
    right = points.withColumn(OTHER_BIN, F.floor(at / width))
    return left.join(right, on & (F.col(BIN) == F.col(OTHER_BIN)) & at.between(first, last)).drop(BIN, OTHER_BIN)


#: Columns of a join, for a while.
BIN, OTHER_BIN = "recollect bin of span", "recollect bin of point"


def attributed(hunks: DataFrame, symbols: DataFrame, most: int = SYMBOLS_EACH_HUNK) -> DataFrame:
    """hunk_id, name: symbols (path, line, name) that begin within a hunk's old lines and what it adds, the first ones by line."""
    until = F.col("from_line") + F.col("from_count") + F.size("added")
    found = within(hunks, symbols, F.col("file_path") == F.col("path"), F.col("from_line"), until, F.col("line"))
    w = Window.partitionBy("hunk_id").orderBy("line", "name")
    return found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).select("hunk_id", "name", "line")


def explore(matched: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """module, name, leg: symbols (module, name) of matched modules (module), of their callers and callees (edges: source, target); the first leg wins."""
    hit = matched.select("module").distinct().withColumn("leg", F.lit("matched"))
    back = edges.join(hit.select(F.col("module").alias("target")), "target", "left_semi").select(F.col("source").alias("module")).distinct().withColumn("leg", F.lit("caller"))
    out = edges.join(hit.select(F.col("module").alias("source")), "source", "left_semi").select(F.col("target").alias("module")).distinct().withColumn("leg", F.lit("callee"))
    order = F.when(F.col("leg") == "matched", 0).when(F.col("leg") == "caller", 1).otherwise(2)
    legs = hit.union(back).union(out).groupBy("module").agg(F.min_by("leg", order).alias("leg"))
    return symbols.join(legs, "module").select("module", "name", "leg").distinct()


def outline(rows: DataFrame, scope: str, path: str) -> DataFrame:
    """A file's symbols by line."""
    own = rows.where((F.col("scope") == scope) & (F.col("kind") == "symbol") & (F.col("metadata")["path"] == path))
    return own.orderBy(F.col("metadata")["line"].cast("int"), "title")


def invalidated(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of other files: a file's rows have it as path, from_path or file_path."""
    owner = F.coalesce(F.col("metadata")["path"], F.col("metadata")["from_path"], F.col("metadata")["file_path"])
    return rows.withColumn("_owner", owner).join(paths.select(F.col("path").alias("_owner")), "_owner", "left_anti").drop("_owner")


def outline_text(rows: DataFrame) -> DataFrame:
    """path, outline: one compact text a file."""
    lines = F.array_sort(F.collect_list(F.struct(F.col("metadata")["line"].cast("int").alias("line"), "title")))
    return rows.where("kind = 'symbol'").groupBy(F.col("metadata")["path"].alias("path")).agg(F.array_join(F.transform(lines, lambda x: F.format_string("%5d  %s", x["line"], x["title"])), "\n").alias("outline"))


def search_code(rows: DataFrame, query: list[float], terms: list[str], as_of: Column, project: str = "default", kind: str | None = None, limit: int = 10, **options) -> DataFrame:
    """Hybrid search of a project's index, in which words weigh more than vectors."""
    own = search.filtered(rows, scope=f"codeindex:{project}", kind=kind)
    return search.hybrid(own, query, terms, as_of, limit, blend=search.CODE_BLEND, **options)


def updated(stored: DataFrame, facts: DataFrame, files: DataFrame, project: str = "default") -> dict[str, DataFrame]:
    """status of each file, and the rows and facts of a project after its files (path, text) were read again.

    Rows and facts of new, changed and deleted files go, and new and changed files are parsed; others aren't looked into.
    """
    own = stored.where((F.col("scope") == f"codeindex:{project}"))
    known = own.where("kind = 'file'").select(F.col("metadata")["path"].alias("path"), F.col("metadata")["checksum"].alias("checksum"))
    status = staging.staged(sync(known, files.select("path", text.source_checksum(F.col("text")).alias("checksum"))), "status")
    touched = status.where("status != 'unchanged'").select("path")
    again = rows_of(files.join(status.where("status in ('new', 'modified')").select("path"), "path", "left_semi"), project)
    new = again["symbols"].union(again["dependencies"]).union(again["files"])
    left = invalidated(own, touched).select(*new.columns)
    return {"status": status, "rows": left.union(new), "facts": without_edges(facts, touched).select("scope", "subject", "predicate", "object").union(again["facts"])}


def without_edges(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """Facts without what modules of these files require."""
    gone = paths.select(text.path_module(F.col("path")).alias("subject")).withColumn("predicate", F.lit("requires")).distinct()
    return facts.join(gone, ["subject", "predicate"], "left_anti")


MOST_DIFF = 3000


def diff_rows(hunks: DataFrame, names: DataFrame, commit: str, message: str, project: str = "default") -> DataFrame:
    """Memory rows of hunks (hunk_id, file_path, from_line, to_line, raw) with the symbols (hunk_id, name) that they touch."""
    touched = names.groupBy("hunk_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    body = F.concat(F.lit(f"{message}\n---\n" if message else ""), "raw")
    meta = F.create_map(F.lit("commit"), F.lit(commit), F.lit("file_path"), F.col("file_path"), F.lit("from_line"), F.col("from_line").cast("string"), F.lit("to_line"), F.col("to_line").cast("string"), F.lit("symbols"), F.coalesce(F.array_join("names", ","), F.lit("")))
    own = hunks.join(touched, "hunk_id", "left")
    return own.select(F.lit(f"codeindex:{project}").alias("scope"), F.lit("diff").alias("kind"), F.concat(F.lit(f"{commit[:8]}: "), "file_path").alias("title"), text.clip(body, MOST_DIFF).alias("body"), F.lit(DIFF).alias("importance"), meta.alias("metadata"))


def hits_text(found: DataFrame) -> DataFrame:
    """text: search results (title, score, metadata) as one line each, the best first; results are bounded."""
    place = F.concat_ws(":", F.coalesce(F.col("metadata")["path"], F.col("metadata")["from_path"], F.col("metadata")["file_path"]), F.col("metadata")["line"])
    line = F.concat(F.format_string("%.3f  ", F.col("score")), "title", F.when(place != "", F.concat(F.lit("  ("), place, F.lit(")"))).otherwise(""))
    own = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "title", line.alias("line"))))
    return found.agg(F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("text"))


def explore_text(found: DataFrame) -> DataFrame:
    """module, text: what explore() found of a module, its leg first, then its symbols."""
    names = F.array_join(F.array_sort(F.collect_set("name")), ", ")
    return found.groupBy("module", "leg").agg(names.alias("names")).select("module", F.concat(F.lit("["), "leg", F.lit("] "), "module", F.lit(": "), "names").alias("text"))
