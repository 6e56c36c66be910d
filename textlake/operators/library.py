"""The library hierarchy from a table of file paths: nodes, order, two-format books, companions.

A folder exists through the files below it; empty ones never appear, so nothing has to be pruned after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.functions import text as T
from textlake.operators.catalog import IMAGES, TEXTS

COMPANION = "@מפרשים"
SKIPPED = ("node_modules", "$recycle.bin", "system volume information")
PDFS, DOCX = (".pdf",), (".docx",)
SUPPORTED = (*TEXTS, *DOCX, *PDFS, *IMAGES)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(T.col(path), r"[^/]*(\.[^./]*)$", 1))


def entry_type(ext) -> Column:
    e = T.col(ext)
    return F.when(e.isin(*PDFS), "pdf").when(e.isin(*IMAGES), "image").otherwise("text")


def handler(ext) -> Column:
    e = T.col(ext)
    return F.when(e.isin(*PDFS), "pdf").when(e.isin(*IMAGES), "image").when(e.isin(*TEXTS), "text").when(e.isin(*DOCX), "docx").otherwise("unsupported")


def _files(paths: DataFrame, root: str) -> DataFrame:
    """Files below root outside skipped folders: path, dirs (names below root), name, stem, ext."""
    rest = F.substr("path", F.lit(len(root) + 2))
    rows = paths.select("path").distinct().where(F.col("path").startswith(root + "/")).withColumn("parts", F.split(rest, "/"))
    rows = rows.withColumn("dirs", F.slice("parts", 1, F.size("parts") - 1)).withColumn("name", F.element_at("parts", -1)).withColumn("ext", extension("path"))
    bad = F.exists("dirs", lambda d: d.startswith(".") | F.lower(d).isin(*SKIPPED))
    stem = F.when(F.col("ext") == "", F.col("name")).otherwise(F.left("name", F.length("name") - F.length("ext")))
    rows = rows.where(~bad).withColumn("stem", stem)
    marked = F.filter(F.transform("dirs", lambda d, i: F.when(F.contains(d, F.lit("@")), i)), lambda x: x.isNotNull())
    return rows.withColumn("mark", F.get(marked, F.lit(0)))


def _below(root: str, dirs: Column) -> Column:
    return F.concat_ws("/", F.lit(root), dirs)


def companions(paths: DataFrame, root: str) -> DataFrame:
    """(parent, key, priority, companion): folders of commentaries by raw (0) and display name (1)."""
    rows = _files(paths, root).where("mark is not null").withColumn("folder", F.get("dirs", F.col("mark")))
    rows = rows.where(F.col("folder").endswith(COMPANION)).withColumn("parent", _below(root, F.slice("dirs", F.lit(1), F.col("mark"))))
    rows = rows.select("parent", "folder").distinct()
    base = F.btrim(F.left("folder", F.length("folder") - len(COMPANION)))
    path = F.concat_ws("/", "parent", "folder")
    keys = F.array(F.struct(base.alias("key"), F.lit(0).alias("priority")), F.struct(T.order_display(base).alias("key"), F.lit(1).alias("priority")))
    return rows.select("parent", path.alias("companion"), F.inline(keys))


def dual_books(paths: DataFrame, root: str) -> DataFrame:
    """(parent, folder, base, text_path, pdf_path): folders marked by @, the first text and the first
    pdf by number and name."""
    rows = _files(paths, root).where("mark = size(dirs) - 1").withColumn("folder", F.get("dirs", F.col("mark"))).where(~F.col("folder").endswith(COMPANION))
    rows = rows.withColumn("parent", _below(root, F.slice("dirs", F.lit(1), F.col("mark"))))
    order = F.struct(T.order_number("name").alias("a"), T.order_display("name").alias("b"), F.col("name").alias("c"))
    best = lambda on: F.min_by(F.when(on, F.col("path")), F.when(on, order))
    out = rows.groupBy("parent", "folder").agg(best(F.col("ext").isin(*TEXTS, *DOCX)).alias("text_path"), best(F.col("ext").isin(*PDFS)).alias("pdf_path"))
    out = out.where("text_path is not null or pdf_path is not null")
    return out.withColumn("base", F.btrim(F.substring_index("folder", "@", 1)))


def book_nodes(paths: DataFrame, root: str) -> DataFrame:
    """Books and images: parent, path, kind, name, order_no, sort_name, base, dual, type, text_path,
    pdf_path, image_path."""
    plain = _files(paths, root).where("mark is null").where(F.col("ext").isin(*SUPPORTED))
    kind = entry_type("ext")
    null = F.lit(None).cast("string")
    one = plain.select(
        _below(root, F.col("dirs")).alias("parent"), "path", F.when(kind == "image", "image").otherwise("book").alias("kind"), T.order_display("stem").alias("name"), T.order_number("stem").alias("order_no"), F.lit(1).alias("is_file"), F.col("stem").alias("base"), F.lit(False).alias("dual"),
        F.when(kind == "text", F.col("path")).alias("text_path"), F.when(kind == "pdf", F.col("path")).alias("pdf_path"), F.when(kind == "image", F.col("path")).alias("image_path"),
    )
    two = dual_books(paths, root).select(
        "parent", F.concat_ws("/", "parent", "folder").alias("path"), F.lit("book").alias("kind"), T.order_display("base").alias("name"), T.order_number("folder").alias("order_no"), F.lit(0).alias("is_file"), "base",
        (F.col("text_path").isNotNull() & F.col("pdf_path").isNotNull()).alias("dual"), "text_path", "pdf_path", null.alias("image_path"),
    )
    return one.union(two)


def companion_join(books: DataFrame, found: DataFrame) -> DataFrame:
    """Books with companion: the folder that has the book's raw name, else its display name."""
    best = found.groupBy("parent", "key").agg(F.min_by("companion", F.struct("priority", "companion")).alias("companion"))
    raw, shown = best.toDF("parent", "base", "by_base"), best.toDF("parent", "name", "by_name")
    rows = books.join(raw, ["parent", "base"], "left").join(shown, ["parent", "name"], "left")
    return rows.withColumn("companion", F.coalesce("by_base", "by_name")).drop("by_base", "by_name")


def folders_of(books: DataFrame, root: str) -> DataFrame:
    """The folders on the way to books: (path, parent, folder)."""
    parts = F.split("parent", "/")
    depth = len(root.split("/"))
    up = books.select("parent").distinct().withColumn("p", parts).select("p", F.explode(F.sequence(F.lit(depth), F.size("p"))).alias("k"))
    rows = up.select(F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("path"), F.get("p", F.col("k") - 1).alias("folder"), F.when(F.col("k") > depth, F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), "/")).alias("parent"))
    return rows.distinct()


def library_tree(paths: DataFrame, root: str) -> DataFrame:
    """Nodes (path, parent, kind, name, order_no, place, dual, text_path, pdf_path, image_path, companion);
    place counts siblings from 1: folders first, then by number and name."""
    books = companion_join(book_nodes(paths, root), companions(paths, root))
    null = F.lit(None).cast("string")
    dirs = folders_of(books, root).select("parent", "path", F.lit("folder").alias("kind"), T.order_display("folder").alias("name"), T.order_number("folder").alias("order_no"), F.lit(0).alias("is_file"), F.lit(False).alias("dual"), null.alias("text_path"), null.alias("pdf_path"), null.alias("image_path"), null.alias("companion"))
    rows = dirs.unionByName(books.drop("base"))
    place = F.row_number().over(Window.partitionBy("parent").orderBy("is_file", "order_no", "name", "path"))
    return rows.withColumn("place", place).drop("is_file")


def companion_list(paths: DataFrame, root: str) -> DataFrame:
    """(companion, path, name, type, place) of the books in every companion folder, nested two-format
    folders included (their text rather than their pdf)."""
    rows = _files(paths, root).where("mark is not null").withColumn("folder", F.get("dirs", F.col("mark"))).where(F.col("folder").endswith(COMPANION))
    rows = rows.withColumn("companion", _below(root, F.slice("dirs", F.lit(1), F.col("mark") + 1)))
    direct = rows.where("mark = size(dirs) - 1").where(F.col("ext").isin(*SUPPORTED)).select("companion", "path", T.order_display("stem").alias("name"), T.order_number("stem").alias("order_no"), F.col("stem").alias("raw"))
    nested = rows.where("mark = size(dirs) - 2").withColumn("inner", F.element_at("dirs", -1)).where(F.contains("inner", F.lit("@")) & ~F.col("inner").endswith(COMPANION))
    order = F.struct(T.order_number("name").alias("a"), T.order_display("name").alias("b"), F.col("name").alias("c"))
    best = lambda on: F.min_by(F.when(on, F.col("path")), F.when(on, order))
    nested = nested.groupBy("companion", "inner").agg(F.coalesce(best(F.col("ext").isin(*TEXTS, *DOCX)), best(F.col("ext").isin(*PDFS))).alias("path")).where("path is not null")
    base = F.btrim(F.substring_index("inner", "@", 1))
    nested = nested.select("companion", "path", T.order_display(base).alias("name"), T.order_number("inner").alias("order_no"), F.col("inner").alias("raw"))
    out = direct.union(nested)
    place = F.row_number().over(Window.partitionBy("companion").orderBy("order_no", T.order_display("raw"), "path"))
    return out.select("companion", "path", "name", entry_type(extension("path")).alias("type"), place.alias("place"))


def tree_filter(tree: DataFrame, term: str = "", kind: str = "all", keep_named_folders: bool = False) -> DataFrame:
    """Books whose name contains the term and that have the type (two-format books pass every type), and
    the folders above them; with ``keep_named_folders`` also folders that are named so, with those above."""
    books = tree.where("kind <> 'folder'")
    if term:
        books = books.where(F.contains("name", F.lit(term)))
    if kind == "image":
        books = books.where("kind = 'image' or dual")
    elif kind != "all":
        books = books.where(F.col("dual") | F.col(f"{kind}_path").isNotNull())
    held = books.select("parent")
    dirs = tree.where("kind = 'folder'")
    if keep_named_folders and term:
        held = held.union(dirs.where(F.contains("name", F.lit(term))).select("path"))
    up = held.distinct().withColumn("p", F.split("parent", "/")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))).alias("path")).distinct()
    return books.unionByName(dirs.join(up, "path", "left_semi").select(*tree.columns))


def scope_paths(tree: DataFrame, folder: str) -> DataFrame:
    """Every text, pdf and image path below a folder."""
    rows = tree.where(F.col("path").startswith(folder + "/") & (F.col("kind") != "folder"))
    return rows.select(F.explode(F.array_compact(F.array("text_path", "pdf_path", "image_path"))).alias("path"))
