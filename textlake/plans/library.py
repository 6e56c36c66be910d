"""Queries of the library hierarchy, over paths made of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import library as L
from textlake.operators.catalog import IMAGES, TEXTS
from textlake.plans.fixtures import HEB, heb
from textlake.plans.text import ORDER_RE
from textlake.registry import query

ROOT = "/root/lib"
PATH = """'/root/lib/' || CASE WHEN length(source) = 4 THEN '3_ ' ELSE '' END || source || '/' || CASE doc_id % 9
  WHEN 0 THEN CAST(doc_id % 4 AS {0}) || '- book' || CAST(doc_id % 11 AS {0}) || '@/' || CAST(doc_id % 5 AS {0}) || '_ f' || CAST(doc_id AS {0}) || ext
  WHEN 1 THEN 'book' || CAST(doc_id % 11 AS {0}) || '@מפרשים/' || CAST(doc_id % 5 AS {0}) || '. c' || CAST(doc_id AS {0}) || ext
  WHEN 2 THEN '.hidden/x' || CAST(doc_id AS {0}) || '.txt'
  WHEN 3 THEN CAST(doc_id % 13 AS {0}) || '_book' || CAST(doc_id % 11 AS {0}) || ext
  WHEN 4 THEN 'Node_Modules/y' || CAST(doc_id AS {0}) || '.txt'
  WHEN 5 THEN 'pics/p' || CAST(doc_id AS {0}) || '.PNG'
  WHEN 6 THEN 'only unsupported/z' || CAST(doc_id AS {0}) || '.xyz'
  WHEN 7 THEN 'book' || CAST(doc_id % 11 AS {0}) || '@מפרשים/inner' || CAST(doc_id % 3 AS {0}) || '@/n' || CAST(doc_id AS {0}) || ext
  ELSE 'sub/' || lang || '/' || CAST(doc_id AS {0}) || '.' || ext END"""


def paths(spark, sf):
    return heb(spark, sf).select(F.expr(PATH.format("STRING")).alias("path"))


def names(xs):
    return ", ".join(f"'{x}'" for x in xs)


def shown(x: str) -> str:
    return f"(CASE WHEN trim(regexp_replace({x}, {ORDER_RE}, '')) = '' THEN trim({x}) ELSE trim(regexp_replace({x}, {ORDER_RE}, '')) END)"


def number(x: str) -> str:
    return f"(CASE WHEN regexp_extract({x}, {ORDER_RE}, 1) = '' OR trim(regexp_replace({x}, {ORDER_RE}, '')) = '' THEN 1000000000 ELSE TRY_CAST(regexp_extract({x}, {ORDER_RE}, 1) AS BIGINT) END)"


SKIP = names(L.SKIPPED)
TEXT_SQL, PDF_SQL, IMAGE_SQL = names((*TEXTS, *L.DOCX)), names(L.PDFS), names(IMAGES)
FILES = f"""{HEB}, paths AS (SELECT DISTINCT {PATH.format('VARCHAR')} AS path FROM heb),
f0 AS (SELECT path, string_split(substr(path, {len(ROOT) + 2}), '/') AS parts, lower(regexp_extract(path, '[^/]*(\\.[^./]*)$', 1)) AS ext FROM paths),
f1 AS (SELECT path, ext, parts[:-2] AS dirs, parts[-1] AS name, left(parts[-1], length(parts[-1]) - length(ext)) AS stem FROM f0),
f AS (SELECT *, list_position(list_transform(dirs, lambda d: contains(d, '@')), true) AS mark FROM f1 WHERE len(list_filter(dirs, lambda d: starts_with(d, '.') OR lower(d) IN ({SKIP}))) = 0),
comp AS (SELECT DISTINCT '{ROOT}' || array_to_string(list_transform(dirs[:mark - 1], lambda d: '/' || d), '') AS parent, dirs[mark] AS folder FROM f WHERE mark IS NOT NULL AND suffix(dirs[mark], '{L.COMPANION}')),
comp_keys AS (SELECT parent, parent || '/' || folder AS companion, trim(left(folder, length(folder) - {len(L.COMPANION)})) AS base FROM comp),
keys AS (SELECT parent, companion, base AS key, 0 AS priority FROM comp_keys UNION ALL SELECT parent, companion, {shown('base')}, 1 FROM comp_keys),
best_key AS (SELECT parent, key, arg_min(companion, (priority, companion)) AS companion FROM keys GROUP BY parent, key),
in_dual AS (SELECT *, '{ROOT}' || array_to_string(list_transform(dirs[:-2], lambda d: '/' || d), '') AS parent, dirs[-1] AS folder, ({number('name')}, {shown('name')}, name) AS o FROM f WHERE mark = len(dirs) AND NOT suffix(dirs[-1], '{L.COMPANION}')),
dual0 AS (SELECT parent, folder, arg_min(path, o) FILTER (ext IN ({TEXT_SQL})) AS text_path, arg_min(path, o) FILTER (ext IN ({PDF_SQL})) AS pdf_path, trim(split_part(folder, '@', 1)) AS base FROM in_dual GROUP BY parent, folder),
dual AS (SELECT * FROM dual0 WHERE text_path IS NOT NULL OR pdf_path IS NOT NULL),
books0 AS (SELECT '{ROOT}' || array_to_string(list_transform(dirs, lambda d: '/' || d), '') AS parent, path, CASE WHEN ext IN ({IMAGE_SQL}) THEN 'image' ELSE 'book' END AS kind, {shown('stem')} AS name, {number('stem')} AS order_no, 1 AS is_file, stem AS base, false AS dual,
    CASE WHEN ext IN ({TEXT_SQL}) THEN path END AS text_path, CASE WHEN ext IN ({PDF_SQL}) THEN path END AS pdf_path, CASE WHEN ext IN ({IMAGE_SQL}) THEN path END AS image_path
  FROM f WHERE mark IS NULL AND ext IN ({TEXT_SQL}, {PDF_SQL}, {IMAGE_SQL})
  UNION ALL SELECT parent, parent || '/' || folder, 'book', {shown('base')}, {number('folder')}, 0, base, text_path IS NOT NULL AND pdf_path IS NOT NULL, text_path, pdf_path, NULL FROM dual),
books1 AS (SELECT b.*, coalesce(x.companion, y.companion) AS companion FROM books0 b LEFT JOIN best_key x ON x.parent = b.parent AND x.key = b.base LEFT JOIN best_key y ON y.parent = b.parent AND y.key = b.name),
ups AS (SELECT DISTINCT array_to_string(string_split(parent, '/')[:k], '/') AS path, string_split(parent, '/')[k] AS folder, CASE WHEN k > 3 THEN array_to_string(string_split(parent, '/')[:k - 1], '/') END AS parent FROM (SELECT parent, unnest(range(3, len(string_split(parent, '/')) + 1)) AS k FROM (SELECT DISTINCT parent FROM books1))),
tree0 AS (SELECT parent, path, 'folder' AS kind, {shown('folder')} AS name, {number('folder')} AS order_no, 0 AS is_file, false AS dual, NULL AS text_path, NULL AS pdf_path, NULL AS image_path, NULL AS companion FROM ups
  UNION ALL SELECT parent, path, kind, name, order_no, is_file, dual, text_path, pdf_path, image_path, companion FROM books1),
tree AS (SELECT * EXCLUDE (is_file), CAST(row_number() OVER (PARTITION BY parent ORDER BY is_file, order_no, name, path) AS INTEGER) AS place FROM tree0)"""


@query("library_tree", f"WITH {FILES} SELECT * FROM tree")
def library_tree(spark, sf):
    return L.library_tree(paths(spark, sf), ROOT)


@query("prune_empty_folders", f"WITH {FILES} SELECT path FROM tree WHERE kind = 'folder'")
def prune_empty_folders(spark, sf):
    return L.folders_of(L.book_nodes(paths(spark, sf), ROOT), ROOT).select("path")


@query("dual_format_books", f"WITH {FILES} SELECT * FROM dual")
def dual_format_books(spark, sf):
    return L.dual_books(paths(spark, sf), ROOT)


@query("companion_join", f"WITH {FILES} SELECT path, companion FROM books1 WHERE companion IS NOT NULL")
def companion_join(spark, sf):
    p = paths(spark, sf)
    return L.companion_join(L.book_nodes(p, ROOT), L.companions(p, ROOT)).where("companion is not null").select("path", "companion")


@query("companion_list", f"""WITH {FILES}, inside AS (SELECT *, '{ROOT}' || array_to_string(list_transform(dirs[:mark], lambda d: '/' || d), '') AS companion FROM f WHERE mark IS NOT NULL AND suffix(dirs[mark], '{L.COMPANION}')),
direct AS (SELECT companion, path, {shown('stem')} AS name, {number('stem')} AS order_no, {shown('stem')} AS raw FROM inside WHERE mark = len(dirs) AND ext IN ({TEXT_SQL}, {PDF_SQL}, {IMAGE_SQL})),
nest0 AS (SELECT companion, dirs[-1] AS i, arg_min(path, ({number('name')}, {shown('name')}, name)) FILTER (ext IN ({TEXT_SQL})) AS t, arg_min(path, ({number('name')}, {shown('name')}, name)) FILTER (ext IN ({PDF_SQL})) AS p FROM inside WHERE mark = len(dirs) - 1 AND contains(dirs[-1], '@') AND NOT suffix(dirs[-1], '{L.COMPANION}') GROUP BY companion, dirs[-1]),
nest AS (SELECT companion, coalesce(t, p) AS path, {shown("trim(split_part(i, '@', 1))")} AS name, {number('i')} AS order_no, {shown('i')} AS raw FROM nest0 WHERE coalesce(t, p) IS NOT NULL),
every AS (SELECT * FROM direct UNION ALL SELECT * FROM nest)
SELECT companion, path, name, CASE WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ({PDF_SQL}) THEN 'pdf' WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ({IMAGE_SQL}) THEN 'image' ELSE 'text' END AS type,
  CAST(row_number() OVER (PARTITION BY companion ORDER BY order_no, raw, path) AS INTEGER) AS place FROM every""")
def companion_list(spark, sf):
    return L.companion_list(paths(spark, sf), ROOT)


@query("tree_filter", f"""WITH {FILES}, hit AS (SELECT * FROM tree WHERE kind <> 'folder' AND contains(name, 'book1') AND (dual OR pdf_path IS NOT NULL))
SELECT path, kind, name FROM hit UNION ALL SELECT path, kind, name FROM tree t WHERE kind = 'folder' AND EXISTS (SELECT 1 FROM hit WHERE starts_with(hit.parent || '/', t.path || '/'))""")
def tree_filter(spark, sf):
    return L.tree_filter(L.library_tree(paths(spark, sf), ROOT), "book1", "pdf").select("path", "kind", "name")


@query("tree_filter_scope", f"""WITH {FILES}, hit AS (SELECT * FROM tree WHERE kind <> 'folder' AND contains(name, 'src1')), named AS (SELECT path FROM tree WHERE kind = 'folder' AND contains(name, 'src1') UNION SELECT parent FROM hit)
SELECT path, kind, name FROM hit UNION ALL SELECT path, kind, name FROM tree t WHERE kind = 'folder' AND EXISTS (SELECT 1 FROM named n WHERE starts_with(n.path || '/', t.path || '/'))""")
def tree_filter_scope(spark, sf):
    return L.tree_filter(L.library_tree(paths(spark, sf), ROOT), "src1", keep_named_folders=True).select("path", "kind", "name")


@query("scope_paths", f"WITH {FILES}, b AS (SELECT * FROM tree WHERE kind <> 'folder' AND starts_with(path, '{ROOT}/src11/')) SELECT text_path AS path FROM b WHERE text_path IS NOT NULL UNION ALL SELECT pdf_path FROM b WHERE pdf_path IS NOT NULL UNION ALL SELECT image_path FROM b WHERE image_path IS NOT NULL")
def scope_paths(spark, sf):
    return L.scope_paths(L.library_tree(paths(spark, sf), ROOT), f"{ROOT}/src11")


@query("route_by_extension", f"WITH {HEB}, e AS (SELECT DISTINCT CASE doc_id % 9 WHEN 0 THEN '.png' WHEN 1 THEN '.xyz' ELSE ext END AS ext FROM heb) SELECT ext, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ({IMAGE_SQL}) THEN 'image' WHEN ext = '.docx' THEN 'docx' WHEN ext IN ({names(TEXTS)}) THEN 'text' ELSE 'unsupported' END AS handler, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ({IMAGE_SQL}) THEN 'image' ELSE 'text' END AS viewer FROM e")
def route_by_extension(spark, sf):
    ext = F.expr("CASE doc_id % 9 WHEN 0 THEN '.png' WHEN 1 THEN '.xyz' ELSE ext END")
    return heb(spark, sf).select(ext.alias("ext")).distinct().select("ext", L.handler("ext").alias("handler"), L.entry_type("ext").alias("viewer"))
