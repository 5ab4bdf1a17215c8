"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows.

The ``ext_`` query is an extension over the event table, not an operator of
the surveyed material.
"""

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions import scalars as S
from sparkweft.operators import clones, jsontree, merge, normalform, report, rubric, sequence, sync, textops, tree
from sparkweft.sources import jsondocs
from sparkweft.sources import manifest as manifests
from sparkweft.sources.jsondocs import object_text
from sparkweft.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# --- comparison and synchronisation -------------------------------------------------

def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and an installed side: every third is missing, every fifth edited, some are unknown to the source."""
    src = table(spark, d, "documents").select("doc_id", "text")
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    known = src.where("doc_id % 3 <> 0").select("doc_id", edited.alias("text"))
    extra = src.where("doc_id % 7 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    return src, known.unionByName(extra)


_DST = """dst AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT -doc_id - 1, text FROM documents WHERE doc_id % 7 = 0)"""
_STATUS = f"""WITH {_DST}, st AS (SELECT s.doc_id, CASE WHEN d.doc_id IS NULL THEN 'NEW' WHEN s.text = d.text THEN 'identical' ELSE 'CHANGED' END AS status
  FROM documents s LEFT JOIN dst d ON s.doc_id = d.doc_id) """


@query(_STATUS + "SELECT doc_id, status FROM st")
def sync_status(spark, d):
    return sync.status(*_sides(spark, d), "doc_id", "text")


@query(_STATUS + "SELECT doc_id, status FROM st WHERE status <> 'identical'")
def sync_diff(spark, d):
    return sync.diff(*_sides(spark, d), "doc_id", "text")


@query(_STATUS + "SELECT bool_or(status <> 'identical') AS has_diff, count(*) FILTER (status = 'NEW') AS n_new, count(*) FILTER (status = 'CHANGED') AS n_changed, count(*) FILTER (status = 'identical') AS n_identical FROM st")
def sync_has_diff(spark, d):
    return sync.has_diff(*_sides(spark, d), "doc_id", "text")


@query(f"WITH {_DST} SELECT coalesce(d.doc_id, s.doc_id) AS doc_id, sha256(CASE WHEN d.doc_id IS NOT NULL THEN d.text ELSE s.text END) AS content FROM documents s FULL JOIN dst d ON s.doc_id = d.doc_id")
def sync_pull(spark, d):
    return sync.pull(*_sides(spark, d), "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("content"))


@query(f"WITH {_DST} SELECT doc_id, sha256(d.text) AS content FROM documents s JOIN dst d USING (doc_id)")
def sync_pull_known(spark, d):
    return sync.pull(*_sides(spark, d), "doc_id", "text", known_only=True).select("doc_id", F.sha2("text", 256).alias("content"))


@query(f"WITH {_DST} SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN 'kept' ELSE 'removed' END AS action FROM dst d LEFT JOIN documents s ON s.doc_id = d.doc_id")
def sync_uninstall(spark, d):
    return sync.uninstall(*_sides(spark, d), "doc_id")


@query("""WITH f AS (SELECT source, sha256(concat_ws(chr(10), CAST(doc_id AS VARCHAR), sha256(text))) AS h FROM documents),
 s AS (SELECT source, count(*) AS n_files, """ + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT) AS w{i}" for i in range(4)) + """ FROM f GROUP BY source)
 SELECT source, n_files, sha256(concat_ws('-', w0, w1, w2, w3)) AS fingerprint FROM s""")
def folder_fingerprint(spark, d):
    return sync.folder_fingerprint(table(spark, d, "documents"), "source", "doc_id", "text")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 b AS (SELECT line, """ + ", ".join(f"lead(line, {i}) OVER w AS l{i}" for i in range(1, 5)) + """ FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
 SELECT sha256(concat_ws(chr(10), line, l1, l2, l3, l4)) AS block, count(*) AS places FROM b WHERE l4 IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def clone_blocks(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return sync.clones(lines, "doc_id", "pos", "line")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 n AS (SELECT doc_id, pos, regexp_replace(regexp_replace(lower(trim(line)), '\\s+', ' ', 'g'), '[0-9]+', '0', 'g') AS line FROM l),
 b AS (SELECT line, """ + ", ".join(f"lead(line, {i}) OVER w AS l{i}" for i in range(1, 5)) + """ FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
 SELECT sha256(concat_ws(chr(10), line, l1, l2, l3, l4)) AS block, count(*) AS places FROM b WHERE l4 IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def near_clone_blocks(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return sync.clones(lines, "doc_id", "pos", "line", near=True)


@query(f"WITH {_DST} SELECT s.doc_id, CASE WHEN d.text IS NULL THEN 'write' WHEN d.text = s.text THEN 'keep' ELSE 'back up' END AS action FROM documents s LEFT JOIN dst d ON s.doc_id = d.doc_id")
def byte_probe(spark, d):
    src, dst = _sides(spark, d)
    both = src.join(dst.withColumnRenamed("text", "there"), "doc_id", "left")
    return both.select("doc_id", sync.replacement(F.col("there"), F.col("text")).alias("action"))


@query("""WITH f AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'agents/' || source || '.md' WHEN 1 THEN 'commands/' || lang || '.md' WHEN 2 THEN 'skills/' || source || '/' || doc_id || '.txt' WHEN 3 THEN 'agents/' || source || '/x.md' ELSE 'README.md' END AS p FROM documents),
 k AS (SELECT CASE WHEN regexp_matches(p, '^agents/[^/]+\\.md$') THEN 'agent' WHEN regexp_matches(p, '^commands/[^/]+\\.md$') THEN 'command' WHEN regexp_matches(p, '^skills/[^/]+/') THEN 'skill' END AS kind, replace(string_split(p, '/')[2], '.md', '') AS name FROM f)
 SELECT kind, name, count(*) AS n_files FROM k WHERE kind IS NOT NULL GROUP BY 1, 2""")
def manifest(spark, d):
    doc = table(spark, d, "documents")
    number = F.col("doc_id") % 5
    path = F.when(number == 0, F.concat(F.lit("agents/"), "source", F.lit(".md"))).when(number == 1, F.concat(F.lit("commands/"), "lang", F.lit(".md")))
    path = path.when(number == 2, F.concat(F.lit("skills/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))).when(number == 3, F.concat(F.lit("agents/"), "source", F.lit("/x.md"))).otherwise("README.md")
    return manifests.manifest(doc.select(path.alias("path")), "path")


_TREE = """s AS (SELECT source || '/' || lang || '/' || doc_id AS path, source, source || '/' || lang AS folder, text FROM documents),
 t AS (SELECT source || '/' || lang || '/' || doc_id AS path, source, source || '/' || lang AS folder, CASE WHEN doc_id % 97 = 0 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 89 <> 0 AND source <> 'src7'
  UNION ALL SELECT source || '/' || lang || '/' || doc_id || '.bak', source, source || '/' || lang, text FROM documents WHERE doc_id % 101 = 0),
 f AS (SELECT coalesce(s.path, t.path) AS path, coalesce(s.source, t.source) AS source, coalesce(s.folder, t.folder) AS folder, CASE WHEN t.path IS NULL THEN 'NEW' WHEN s.path IS NULL THEN 'EXTRA' WHEN s.text = t.text THEN 'identical' ELSE 'CHANGED' END AS status FROM s FULL JOIN t ON s.path = t.path)"""
_TREE_UP = "CASE WHEN bool_and(status = 'NEW') THEN 'NEW' WHEN bool_and(status = 'EXTRA') THEN 'EXTRA' WHEN bool_and(status = 'identical') THEN 'identical' ELSE 'CHANGED' END AS status"


@query(f"""WITH {_TREE}, d2 AS (SELECT source, folder, {_TREE_UP} FROM f GROUP BY 1, 2), d1 AS (SELECT source, {_TREE_UP} FROM f GROUP BY 1), d0 AS (SELECT {_TREE_UP} FROM f)
 SELECT '' AS path, 0 AS depth, 'folder' AS kind, status FROM d0 UNION ALL SELECT source, 1, 'folder', status FROM d1
 UNION ALL SELECT d2.folder, 2, 'folder', d2.status FROM d2 JOIN d1 ON d1.source = d2.source WHERE d1.status = 'CHANGED'
 UNION ALL SELECT f.path, 3, 'file', f.status FROM f JOIN d1 ON d1.source = f.source JOIN d2 ON d2.folder = f.folder WHERE d1.status = 'CHANGED' AND d2.status = 'CHANGED'""")
def tree_status(spark, d):
    """A few files are missing, edited or unknown, and a folder is not installed: only folders that differ are looked into."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    there = docs.where("doc_id % 89 <> 0 AND source <> 'src7'").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    more = docs.where("doc_id % 101 = 0").withColumn("path", F.concat("path", F.lit(".bak")))
    return tree.tree_status(tree.merkle(docs, "path", "text"), tree.merkle(there.unionByName(more), "path", "text"))


@query("""WITH d AS (SELECT doc_id, source, source || '/' || lang AS folder FROM documents), f AS (SELECT DISTINCT folder FROM d UNION SELECT source FROM d UNION SELECT '' FROM d),
 k AS (SELECT * FROM d WHERE doc_id % 50 = 3), h AS (SELECT folder FROM k UNION SELECT source FROM k UNION SELECT '' FROM k)
 SELECT f.folder, CASE WHEN h.folder IS NULL THEN 'removed' ELSE 'left in place' END AS action FROM f LEFT JOIN h ON f.folder = h.folder""")
def emptied_folders(spark, d):
    """What is left of the folders if all but every fiftieth file is uninstalled."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.concat_ws("/", "source", "lang").alias("folder"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    known = sync.uninstall(docs.where("doc_id % 50 <> 3"), docs, "path").where("action = 'kept'")
    folders = docs.select("folder").union(docs.select("source")).union(docs.select(F.lit("")))
    return tree.emptied_folders(folders, "folder", known, "path")


def near_clones(spark, d):
    """SQL has no alignment, so this one is held against all pairs in a test."""
    return clones.near_clones(table(spark, d, "documents"), "doc_id", "text")


QUERIES["near_clones"] = near_clones


@query("""SELECT p_partkey, round(w, 6) AS natural_cm, round(CASE WHEN p_partkey % 3 = 0 THEN least(CAST(p_size AS DOUBLE), 16.5) WHEN w > 16.5 THEN 16.5 END, 6) AS width_cm FROM (SELECT *, p_size * 40 / 96.0 * 2.54 AS w FROM part)""")
def image_widths(spark, d):
    """Images of 40 pixels a unit of size at 96 dpi, every third with a width that is asked for."""
    natural = S.natural_width_cm(F.col("p_size") * 40, F.lit(96.0))
    asked = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double"))
    return table(spark, d, "part").select("p_partkey", F.round(natural, 6).alias("natural_cm"), F.round(S.clamp_width(asked, natural, F.lit(30.0), F.lit(15.0)), 6).alias("width_cm"))


# --- sequences ----------------------------------------------------------------------

@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS number,
 role || ' ' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) || ' — ' || replace(text, ',', '-') AS caption FROM conversations""")
def numbering(spark, d):
    dashed = table(spark, d, "conversations").withColumn("text", F.translate("text", ",", "–"))
    rows = sequence.number_kinds(dashed, "conv_id", "turn", "role")
    return rows.select("conv_id", "turn", F.col("number").cast("bigint"), S.caption(F.col("role"), F.col("number"), F.col("text")).alias("caption"))


@query("""SELECT conv_id, turn, role, CASE WHEN length(text) % 3 <> 0 THEN count(*) FILTER (length(text) % 3 <> 0) OVER (PARTITION BY conv_id, role ORDER BY turn) END AS number FROM conversations""")
def figure_numbering(spark, d):
    """Figures whose file is missing (here: texts of certain lengths) take no number."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", (F.char_length("text") % 3 != 0).alias("there"))
    out = sequence.number_kinds(rows, "conv_id", "turn", "role", counted=F.col("there"))
    return out.select("conv_id", "turn", "role", F.col("number").cast("bigint").alias("number"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations WHERE role <> 'system'""")
def table_numbering(spark, d):
    rows = table(spark, d, "conversations").withColumn("n_rows", F.when(F.col("role") == "system", 0).otherwise(1))
    return sequence.number_tables(rows, "conv_id", "turn", "n_rows").select("conv_id", "turn", F.col("number").cast("bigint"))


@query("""WITH k AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'h1' WHEN 'system' THEN 'page_break' ELSE 'text' END AS kind FROM conversations),
 f AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM k WHERE kind <> 'text')
 SELECT k.conv_id, k.turn, k.kind, (k.kind = 'h1' AND coalesce(f.prev = 'h1', false)) AS breaks FROM k LEFT JOIN f USING (conv_id, turn)""")
def break_flags(spark, d):
    kind = F.when(F.col("role") == "user", "h1").when(F.col("role") == "system", "page_break").otherwise("text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"))
    return sequence.break_flags(rows, "conv_id", "turn", "kind")


@query("""WITH k AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'h1' WHEN 'system' THEN 'page_break' ELSE 'text' END AS kind FROM conversations),
 f AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM k WHERE kind <> 'text')
 SELECT k.conv_id, k.turn, (k.conv_id % 3 <> 0 AND k.kind = 'h1' AND coalesce(f.prev = 'h1', false)) AS breaks FROM k LEFT JOIN f USING (conv_id, turn)""")
def profile_breaks(spark, d):
    """Every third document's profile has no page breaks."""
    kind = F.when(F.col("role") == "user", "h1").when(F.col("role") == "system", "page_break").otherwise("text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"))
    return sequence.break_flags(rows, "conv_id", "turn", "kind", F.col("conv_id") % 3 != 0).drop("kind")


_SIGNS = {0: "∑", 3: "∫", 5: "=", 8: "≤"}


@query("""WITH t AS (SELECT user_id, event_id, CASE event_id * 7 % 11 WHEN 0 THEN '∑' WHEN 3 THEN '∫' WHEN 5 THEN '=' WHEN 8 THEN '≤' ELSE 'x' END AS sign FROM events),
 p AS (SELECT *, lag(event_id) OVER w AS before, lead(event_id) OVER w AS next, max(event_id) OVER (PARTITION BY user_id) AS last FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 q AS (SELECT *, min(CASE WHEN sign IN ('=', '≤') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM p)
 SELECT a.user_id, a.event_id, a.sign, CASE a.sign WHEN '∑' THEN 'undOvr' ELSE 'subSup' END AS limits, CASE WHEN a.next IS NULL OR a.stop = a.next THEN NULL WHEN a.stop IS NULL THEN a.last ELSE b.before END AS body_end
 FROM q a LEFT JOIN p b ON b.user_id = a.user_id AND b.event_id = a.stop WHERE a.sign IN ('∑', '∫')""")
def operator_bodies(spark, d):
    number, sign = F.col("event_id") * 7 % 11, F.lit("x")
    for k, v in _SIGNS.items():
        sign = F.when(number == k, v).otherwise(sign)
    return sequence.operator_bodies(table(spark, d, "events").select("user_id", "event_id", sign.alias("sign")), "user_id", "event_id", "sign")


@query("""WITH a AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 b AS (SELECT *, CAST(99 + sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS list_id FROM a)
 SELECT event_id, user_id, list_id, row_number() OVER (PARTITION BY user_id, list_id ORDER BY ts) AS item FROM b""")
def list_restart(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = sequence.restart_lists(rows, "user_id", "ts", "event_type")
    return out.select("event_id", "user_id", "list_id", F.col("item").cast("bigint"))


@query("""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split('---' || chr(10) || 'name: ' || lang || chr(10) || '---' || chr(10) || text, chr(10)) AS x FROM documents)),
 m AS (SELECT *, sum(CASE WHEN line = '---' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS marks FROM l)
 SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, line FROM m WHERE marks = 2 AND line <> '---'""")
def front_matter(spark, d):
    text = F.concat(F.lit("---\nname: "), "lang", F.lit("\n---\n"), "text")
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return sequence.body_lines(lines, "doc_id", "pos", "line").withColumn("pos", F.col("pos").cast("bigint"))


@query("""WITH p AS (SELECT page_id, '/' || string_split(url, '/')[3] AS host, string_split(url, '/')[4] AS part FROM pages WHERE url IS NOT NULL),
 s AS (SELECT DISTINCT host, part, host || '/' || part || '/src' AS start FROM p),
 m AS (SELECT DISTINCT host AS folder FROM p WHERE page_id % 3 = 0 UNION SELECT DISTINCT host || '/' || part FROM p WHERE page_id % 7 = 0)
 SELECT start, CASE WHEN host || '/' || part IN (SELECT folder FROM m) THEN host || '/' || part WHEN host IN (SELECT folder FROM m) THEN host END AS root FROM s""")
def project_root(spark, d):
    """Folders made of hosts and first parts of addresses; some hold a marker file, others a file of another name."""
    cut = F.split("url", "/")
    p = table(spark, d, "pages").where("url IS NOT NULL").select("page_id", F.concat(F.lit("/"), cut[2]).alias("host"), cut[3].alias("part"))
    starts = p.select(F.concat_ws("/", "host", "part", F.lit("src")).alias("start"))
    files = p.where("page_id % 3 = 0").select(F.concat("host", F.lit("/Makefile")).alias("file"))
    files = files.unionByName(p.where("page_id % 7 = 0").select(F.concat_ws("/", "host", "part", F.lit(".git")).alias("file")))
    files = files.unionByName(p.where("page_id % 2 = 0").select(F.concat_ws("/", "host", "part", F.lit("src/readme")).alias("file")))
    return sequence.nearest_root(starts, "start", files, F.col("file"), [".git", "Makefile", "pyproject.toml"])


# --- text ---------------------------------------------------------------------------

@query("SELECT doc_id, replace(replace(text, '.', '-'), ' , ', ', ') AS text FROM (SELECT doc_id, replace(text, ', ', ' , ') AS text FROM documents)")
def sanitize(spark, d):
    dashed = F.replace(F.replace("text", F.lit(", "), F.lit(" — ")), F.lit("."), F.lit("–"))
    guarded = table(spark, d, "documents").select("doc_id", F.regexp_replace(dashed, r"(?U)(\s)–(?=\s)", "$1-").alias("text"))
    return guarded.select("doc_id", S.sanitize_prose(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(text || chr(10) || chr(10), chr(10)), lambda x: NOT regexp_matches(x, '^Released under|^Copyright')), chr(10)), '\n+$', '') AS text FROM documents""")
def line_filter(spark, d):
    kept = textops.drop_lines(F.concat("text", F.lit("\n\n")), ["^Released under", "^Copyright"])
    return table(spark, d, "documents").select("doc_id", textops.trim_blank_tail(kept).alias("text"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS chosen FROM customer")
def fallback(spark, d):
    first = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    second = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", S.first_filled(first, second).alias("chosen"))


@query("""WITH r AS (SELECT item_id, list_transform(string_split(text, '. '), lambda s: string_split(s, ' ')) AS rows FROM benchmark),
 w AS (SELECT item_id, rows, list_max(list_transform(rows, lambda r: len(r))) AS width FROM r)
 SELECT item_id, CAST(width AS BIGINT) AS width, CAST(len(rows) AS BIGINT) AS n_rows, array_to_string(list_transform(rows, lambda r: array_to_string(r, '|') || repeat('|', CAST(width - len(r) AS BIGINT))), chr(10)) AS padded FROM w""")
def ragged_pad(spark, d):
    rows = F.transform(F.split("text", r"\. "), lambda s: F.split(s, " "))
    padded = table(spark, d, "benchmark").select("item_id", S.pad_rows(rows).alias("p"))
    return padded.select("item_id", F.size(F.col("p")[0]).cast("bigint").alias("width"), F.size("p").cast("bigint").alias("n_rows"), F.array_join(F.transform("p", lambda r: F.array_join(r, "|")), "\n").alias("padded"))


@query("""SELECT p_partkey, upper(p_name) AS heading, CASE WHEN p_size % 4 = 0 THEN least(CAST(p_size AS DOUBLE), 17.0) WHEN p_size * 0.5 > 17.0 THEN 17.0 END AS width_cm,
 sha256(p_name) AS print, (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AS stale, 'part.' || p_brand AS path, trim(p_type || ' ' || p_size) AS title,
 CASE WHEN p_size <= 2 THEN 'SMALL' WHEN p_size <= 5 THEN 'MEDIUM' ELSE 'LARGE' END AS bucket FROM part""")
def scalars(spark, d):
    p = table(spark, d, "part")
    stored = F.when(F.col("p_partkey") % 2 == 0, None).when(F.col("p_partkey") % 3 == 0, F.sha2(F.concat("p_name", F.lit("x")), 256)).otherwise(F.concat(F.sha2("p_name", 256), F.lit(" ")))
    asked = F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("double"))
    return p.select(
        "p_partkey", S.heading(F.col("p_name"), True).alias("heading"),
        S.clamp_width(asked, F.col("p_size") * 0.5, F.lit(25.0), F.lit(15.0)).alias("width_cm"),
        S.fingerprint(F.col("p_name")).alias("print"), S.is_stale(stored, F.col("p_name")).alias("stale"),
        S.dotted(F.lit("part"), F.col("p_brand")).alias("path"), S.work_title(F.col("p_type"), F.col("p_size").cast("string")).alias("title"),
        S.size_bucket(F.col("p_size")).alias("bucket"),
    )


@query("""SELECT c_custkey, array_to_string(list_filter([c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, CAST(c_nationkey AS VARCHAR)], lambda x: x <> ''), chr(10)) AS lines,
 CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS promoted FROM customer""")
def title_lines(spark, d):
    segment = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")
    lines = S.filled_lines(F.col("c_name"), segment, F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(lines, "\n").alias("lines"), F.size(S.as_list(segment)).cast("bigint").alias("promoted"))


_MARKS = ["¯", "^", "~", "¨", "´", "`", "˘", "˙", "ˇ", "→", "x", "‾"]


@query("""SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN chr(772) WHEN 1 THEN chr(770) WHEN 2 THEN chr(771) WHEN 3 THEN chr(776) WHEN 4 THEN chr(769) WHEN 5 THEN chr(768) WHEN 6 THEN chr(774) WHEN 7 THEN chr(775) WHEN 8 THEN chr(780) WHEN 9 THEN chr(8407) WHEN 10 THEN 'x' ELSE chr(8254) END AS accent,
 CASE WHEN p_partkey % 4 = 0 THEN 'undOvr' WHEN p_partkey % 4 = 1 THEN 'subSup' END AS limits, p_partkey % 3 = 0 AS ends, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_partkey % 2 = 0 ELSE true END AS upright FROM part""")
def math_signs(spark, d):
    key = F.col("p_partkey")
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (key % 12 + 1).cast("int"))
    sign = F.when(key % 4 == 0, " ∏").when(key % 4 == 1, "∮").when(key % 4 == 2, "+")
    relation = F.when(key % 3 == 0, F.when(key % 2 == 0, "≥ ").otherwise("∝")).otherwise("∑")
    name = F.when(key % 3 == 0, " ").when(key % 3 == 1, "x").otherwise("sin")
    return table(spark, d, "part").select(
        "p_partkey", S.combining_accent(mark).alias("accent"), S.limit_place(sign).alias("limits"), S.ends_body(relation).alias("ends"),
        S.is_upright(name, F.when(key % 2 == 0, "normal")).alias("upright"),
    )


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'lines' END, CASE WHEN p_size % 7 >= 5 THEN 'params' END, CASE WHEN p_size % 13 >= 10 THEN 'methods' END, CASE WHEN p_size % 5 >= 3 THEN 'nesting' END], lambda x: x IS NOT NULL), ',') AS large FROM part""")
def large_code(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.array_join(S.large_code(size, size % 7, size % 13, size % 5), ",").alias("large"))


# --- JSON ---------------------------------------------------------------------------

_RAW = "CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN ' ' WHEN 2 THEN '[' || props || ']' WHEN 3 THEN substr(props, 2) WHEN 4 THEN NULL ELSE '7' END"


@query(f"""WITH r AS (SELECT event_id, {_RAW} AS raw FROM events), o AS (SELECT event_id, CASE WHEN raw IS NULL OR trim(raw) = '' THEN '{{}}' WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT' THEN raw END AS doc FROM r)
 SELECT event_id, doc, doc IS NULL AS rejected FROM o""")
def json_documents(spark, d):
    """What a scan of documents makes of good, blank, missing, malformed and other texts."""
    read = table(spark, d, "events").select("event_id", object_text(F.expr(_RAW)).alias("doc"))
    return read.withColumn("rejected", F.col("doc").isNull())


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'merged' WHEN 2 THEN 'rejected' ELSE CASE WHEN json_extract_string(props, '$.k') = '1' THEN 'current' ELSE 'merged' END END AS outcome,
 CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN 'v' WHEN 3 THEN '1' END AS k FROM events""")
def merge_outcomes(spark, d):
    """Whether a merge changes the document: nothing to add, another value, no object, and a value that may be there."""
    overlay = F.when(F.col("event_id") % 4 == 0, "{}").when(F.col("event_id") % 4 == 1, '{"k":"v"}').when(F.col("event_id") % 4 == 2, "[1]").otherwise('{"k":1}')
    m = table(spark, d, "events").select("event_id", merge.merge_outcome(F.col("props"), overlay).alias("m"))
    return m.select("event_id", "m.outcome", F.get_json_object("m.doc", "$.k").alias("k"))

@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'v' ELSE json_extract_string(props, '$.k') END AS k, event_type AS nested, CASE WHEN event_id % 2 = 0 THEN json_array('new', event_type) ELSE json_array(event_type, 'old') END::VARCHAR AS tags,
 CASE WHEN event_id % 2 = 0 THEN '[2]' ELSE '[1]' END AS plain FROM events""")
def json_merge(spark, d):
    """Objects merge at any depth, lists unite at ``o.tags`` and are replaced elsewhere."""
    tags = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), "event_type", F.lit('"]'))).otherwise(F.concat(F.lit('["'), "event_type", F.lit('","old"]')))
    base = F.concat(F.lit('{"o":{"p":"'), "event_type", F.lit('","q":1,"tags":'), tags, F.lit('},"plain":[1],'), F.expr("substring(props, 2)"))
    overlay = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"k":"v","plain":[2],"o":{"q":2,"tags":["new","'), "event_type", F.lit('"]}}'))).otherwise("")
    m = table(spark, d, "events").select("event_id", merge.deep_merge(base, overlay, [("o", "tags")]).alias("m"))
    lists = lambda path, kind: F.to_json(F.from_json(F.get_json_object("m", path), kind))
    return m.select("event_id", F.get_json_object("m", "$.k").alias("k"), F.get_json_object("m", "$.o.p").alias("nested"), lists("$.o.tags", "array<string>").alias("tags"), lists("$.plain", "array<int>").alias("plain"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"k":' || (props->'$.k') || ',"n":{"a":1}}' WHEN event_id % 3 = 1 THEN '{"k":' || (props->'$.k') || '}' END AS doc,
 CASE event_id % 3 WHEN 0 THEN 'merged' WHEN 1 THEN 'current' ELSE 'rejected' END AS outcome FROM events""")
def json_literal(spark, d):
    """Every document with an overlay that is given as a text: an object, a blank one, and a list, which is rejected."""
    given = {i: jsondocs.literal(spark, text).select(F.lit(i).alias("n"), F.coalesce("doc", F.lit("[]")).alias("doc")) for i, text in enumerate(('{"n": {"a": 1}}', " ", "[1]"))}
    overlays = reduce(DataFrame.unionByName, given.values())  # three rows
    n = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 1, 1).otherwise(2)
    both = table(spark, d, "events").select("event_id", "props", n.alias("n")).join(F.broadcast(overlays), "n")
    return jsontree.merge_texts(both, F.col("props"), F.col("doc"), ["event_id"])


@query("""WITH e AS (SELECT event_id, event_id % 4 AS n, '"a":{"x":' || user_id || ',"y":{"z":"' || event_type || '"}}' AS a, '"a":{"x":' || user_id || ',"y":3}' AS cut FROM events)
 SELECT event_id, CASE WHEN n = 3 THEN 'current' ELSE 'merged' END AS outcome, '{' || CASE n WHEN 0 THEN cut || ',"b":5,"dot.key":[1,{"q":2}],"e":{}' WHEN 1 THEN a || ',"b":{"c":{}},"dot.key":[1,{"q":2}],"e":{"n":null}'
 WHEN 2 THEN a || ',"b":5,"dot":{"key":2},"dot.key":[1,{"q":2}],"e":{}' ELSE a || ',"b":5,"dot.key":[1,{"q":2}],"e":{}' END || '}' AS doc FROM e""")
def json_merge_deep(spark, d):
    """Flattened, joined by path and written again: scalars over objects and objects over scalars, empty objects, null, dots in names."""
    e = table(spark, d, "events")
    base = F.concat(F.lit('{"e": {}, "b": 5, "a": {"y": {"z": "'), "event_type", F.lit('"}, "x": '), F.col("user_id").cast("string"), F.lit('}, "dot.key": [1,{"q":2}]}'))
    over = F.when(F.col("event_id") % 4 == 0, '{"a":{"y":3}}').when(F.col("event_id") % 4 == 1, '{"b":{"c":{}},"e":{"n":null}}').when(F.col("event_id") % 4 == 2, '{"dot":{"key":2},"a":{"y":{}}}')
    return jsontree.merge_documents(e.select("event_id", base.alias("doc")), e.select("event_id", over.alias("doc")), "event_id", "doc")


@query("""WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS v FROM events) SELECT event_id, 'k' AS path, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'over' ELSE v END AS value FROM e
 UNION ALL SELECT event_id, 'new', 'x' FROM e WHERE event_id % 7 = 0""")
def json_merge_flat(spark, d):
    e = table(spark, d, "events")
    base = e.select("event_id", F.lit("k").alias("path"), F.get_json_object("props", "$.k").alias("value"))
    over = e.where("event_id % 3 = 0 OR event_id % 5 = 0").select("event_id", F.lit("k").alias("path"), F.when(F.col("event_id") % 5 != 0, "over").alias("value"))
    new = e.where("event_id % 7 = 0").select("event_id", F.lit("new").alias("path"), F.lit("x").alias("value"))
    return merge.merge_flat(base, over.unionByName(new), "event_id", "path", "value")


@query("""WITH t AS (SELECT user_id, array_to_string(list_filter(list_sort(list_distinct(list(event_type))), lambda x: x NOT IN ('purchase', 'signup')), ',') AS others FROM events GROUP BY 1)
 SELECT user_id, 'purchase,signup' || CASE WHEN others = '' THEN '' ELSE ',' || others END AS types FROM t""")
def ordered_union(spark, d):
    """Per user: a fixed list, then the types seen that it lacks, in order. The types are a small domain, so the array is bounded."""
    seen = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("base"))
    fixed = F.array(F.lit("purchase"), F.lit("signup"))
    return seen.select("user_id", F.array_join(merge.ordered_union(fixed, F.col("base")), ",").alias("types"))


@query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events) SELECT event_id, '[{"k":1},true' || CASE WHEN k = '1' THEN '' ELSE ',{"k":' || k || '}' END || ']' AS host, '[{"k":1},true' || CASE WHEN k = '1' THEN '' ELSE ',{"k":' || k || '}' END || ',1]' AS text FROM e""")
def ordered_union_json(spark, d):
    """Objects that are written otherwise are one; 1 is true by the host language's equality, not by text."""
    overlay = F.array(F.lit('{"k": 1}'), F.lit('{ "k":1 }'), F.lit("true"))
    both = [F.concat(F.lit("["), F.array_join(merge.ordered_union_json(overlay, F.array(F.col("props"), F.lit("1")), e), ","), F.lit("]")).alias(e) for e in ("host", "text")]
    return table(spark, d, "events").select("event_id", *both)


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'old,view' ELSE 'view,old,' || event_type END AS hooks FROM events")
def hook_merge(spark, d):
    hooks = merge.prepend_unless(F.array(F.lit("old"), "event_type"), F.lit("view"), lambda x: x == "view")
    return table(spark, d, "events").select("event_id", F.array_join(hooks, ",").alias("hooks"))


# --- verdicts and tallies -----------------------------------------------------------

@query("""WITH c AS (SELECT conv_id % 10 AS agent, conv_id, bool_or(role = 'user') AND bool_or(role = 'assistant') AS whole FROM conversations GROUP BY 1, 2)
 SELECT agent, count(*) AS scenarios FROM c WHERE whole GROUP BY 1""")
def scenario_discovery(spark, d):
    parts = table(spark, d, "conversations").withColumn("agent", F.col("conv_id") % 10)
    return report.complete(parts, ["agent", "conv_id"], "role", ["user", "assistant"]).groupBy("agent").agg(F.count("*").alias("scenarios"))


@query("SELECT conv_id FROM conversations WHERE conv_id % 10 = 3 GROUP BY conv_id HAVING bool_or(role = 'user') AND bool_or(role = 'assistant')")
def scenario_listing(spark, d):
    parts = table(spark, d, "conversations").select((F.col("conv_id") % 10).cast("string").alias("agent"), F.col("conv_id").cast("string").alias("scenario"), "role", "conv_id")
    return report.complete(report.select_scenarios(parts, agent="3"), ["conv_id"], "role", ["user", "assistant"])


@query("""WITH c AS (SELECT DISTINCT conv_id % 10 AS agent, CAST(conv_id AS VARCHAR) AS scenario FROM conversations) SELECT agent, scenario, row_number() OVER (PARTITION BY agent ORDER BY scenario) AS place FROM c""")
def scenario_order(spark, d):
    """Scenarios by name, as strings: 10 comes before 9."""
    names = table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("agent"), F.col("conv_id").cast("string").alias("scenario")).distinct()
    return report.listed(names, "agent", "scenario").withColumn("place", F.col("place").cast("bigint"))


@query("""WITH c AS (SELECT DISTINCT CAST(conv_id % 10 AS VARCHAR) AS agent, CAST(conv_id AS VARCHAR) AS scenario FROM conversations), f(a, s) AS (VALUES ('', ''), ('3', ''), ('', '13'), ('none', ''), ('3', 'none'))
 SELECT a AS agent, s AS scenario, count(c.agent) AS total, 2 * count(c.agent) AS cost, CASE WHEN count(c.agent) > 0 THEN 'run' ELSE 'no match for the filter' END AS outcome FROM f LEFT JOIN c ON (a = '' OR a = c.agent) AND (s = '' OR s = c.scenario) GROUP BY 1, 2""")
def scenario_selection(spark, d):
    names = table(spark, d, "conversations").select((F.col("conv_id") % 10).cast("string").alias("agent"), F.col("conv_id").cast("string").alias("scenario")).distinct()
    filters = [("", ""), ("3", ""), ("", "13"), ("none", ""), ("3", "none")]
    out = [report.selection(names, a, s).select(F.lit(a).alias("agent"), F.lit(s).alias("scenario"), "*") for a, s in filters]
    return reduce(DataFrame.unionByName, out)


@query("""WITH r AS (SELECT source, quality = 1 AND toxic = 0 AS ok FROM documents JOIN labels USING (doc_id))
 SELECT source, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok) / count(*) AS rate, 2 * count(*) AS cost, bool_and(ok) AS all_passed FROM r GROUP BY source""")
def gate_tally(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return report.tally(rows.withColumn("ok", F.expr("quality = 1 AND toxic = 0")), ["source"], "ok")


@query("""WITH w AS (SELECT item_id, string_split(trim(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g')), ' ') AS w FROM benchmark),
 i AS (SELECT item_id, 'x' || w[1] AS a, 'x' || w[2] AS b, 'x' || w[3] AS c, 'x' || w[4] AS d FROM w)
 SELECT item_id, 1 AS item, 'required' AS kind, a || ' ' || b AS text FROM i UNION ALL SELECT item_id, 2, 'required', b FROM i UNION ALL SELECT item_id, 3, 'bonus', c FROM i UNION ALL SELECT item_id, 4, 'forbidden', d FROM i""")
def rubric_items(spark, d):
    """Rubrics made of each item's first words: two required points, the first over two lines, a bonus and a forbidden one."""
    w = F.split(F.trim(F.regexp_replace("text", "[^A-Za-z ]+", " ")), " ")
    word = lambda i: F.concat(F.lit("x"), F.get(w, F.lit(i)))
    text = F.concat(F.lit("It must say:\n1. "), word(0), F.lit("\n   "), word(1), F.lit("\n2. "), word(1), F.lit("\n\nBonus:\n- "), word(2), F.lit("\n\nIt must not say:\n- "), word(3), F.lit("\n"))
    return rubric.rubric_items(table(spark, d, "benchmark").select("item_id", text.alias("rubric")), "item_id", "rubric")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'no JSON' WHEN 2 THEN 'verdict,unknown name' WHEN 3 THEN 'matched' ELSE CASE WHEN quality = 1 THEN 'pass with missed items' ELSE '' END END AS faults FROM labels""")
def verdict_faults(spark, d):
    """Verdicts that are in order, no JSON, of another word and name, without a list of numbers, and passed although an item is missed."""
    word = F.when(F.col("quality") == 1, "pass").otherwise("fail")
    number = F.col("doc_id") % 5
    good = F.concat(F.lit('{"verdict":"'), word, F.lit('","matched":[1],"missed":'), F.when(number == 4, "[2]").otherwise("[]"), F.lit(',"notes":"n"}'))
    text = F.when(number == 1, F.concat(F.lit("It says "), good)).when(number == 2, F.regexp_replace(good, '"verdict":"(pass|fail)"', '"verdict":"maybe","more":1')).when(number == 3, F.replace(good, F.lit("[1]"), F.lit("[true]"))).otherwise(good)
    return table(spark, d, "labels").select("doc_id", F.array_join(rubric.verdict_faults(text), ",").alias("faults"))


_GATES = """g AS (SELECT doc_id, 'reviewer' AS gate, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN quality = 1 THEN 'PASS' ELSE 'NEEDS_WORK' END AS verdict FROM labels
 UNION ALL SELECT doc_id, 'security', CASE WHEN toxic = 0 THEN 'PASS' ELSE 'FAIL' END FROM labels WHERE doc_id % 11 <> 0)"""


@query(f"""WITH {_GATES} SELECT doc_id, coalesce(bool_and(coalesce(verdict = 'PASS', false)) FILTER (gate = 'reviewer'), false) AND coalesce(bool_and(coalesce(verdict = 'PASS', false)) FILTER (gate = 'security'), false) AS proceeds
 FROM g GROUP BY doc_id""")
def two_gates(spark, d):
    """Some items have a null gate, some lack one."""
    labels = table(spark, d, "labels")
    review = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("quality") == 1, "PASS").otherwise("NEEDS_WORK")
    reviewed = labels.select("doc_id", F.lit("reviewer").alias("gate"), review.alias("verdict"))
    secured = labels.where("doc_id % 11 <> 0").select("doc_id", F.lit("security").alias("gate"), F.when(F.col("toxic") == 0, "PASS").otherwise("FAIL").alias("verdict"))
    return report.all_gates(reviewed.unionByName(secured), ["doc_id"], "gate", "verdict")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber AS item, l_quantity > 10 AS met, CASE WHEN l_linenumber <= 4 THEN 'required' WHEN l_linenumber = 5 THEN 'forbidden' ELSE 'bonus' END AS kind FROM lineitem),
 r AS (SELECT l_orderkey, coalesce(string_agg(item, ',' ORDER BY item) FILTER (met AND kind <> 'forbidden'), '') AS matched, coalesce(string_agg(item, ',' ORDER BY item) FILTER (NOT met AND kind = 'required'), '') AS missed, coalesce(string_agg(item, ',' ORDER BY item) FILTER (met AND kind = 'forbidden'), '') AS forbidden FROM i GROUP BY 1)
 SELECT *, missed = '' AND forbidden = '' AS passed FROM r""")
def verdict_reduce(spark, d):
    kind = F.when(F.col("l_linenumber") <= 4, "required").when(F.col("l_linenumber") == 5, "forbidden").otherwise("bonus")
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("item"), (F.col("l_quantity") > 10).alias("met"), kind.alias("kind"))
    out = report.reduce_items(items, ["l_orderkey"], "item", "met", "kind")
    return out.select("l_orderkey", "passed", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("matched", "missed", "forbidden")))


@query("SELECT doc_id, (quality = 1) AS passed_text, (quality = 1) AS passed_parsed, (CASE WHEN toxic = 1 THEN 2 ELSE 3 END)::BIGINT AS matched FROM labels")
def verdict_parse(spark, d):
    text = F.concat(F.lit('{"verdict" : "'), F.when(F.col("quality") == 1, "pass").otherwise("fail"), F.lit('", "matched": [1, 2'), F.when(F.col("toxic") == 1, "").otherwise(", 13"), F.lit('], "missed": [3, 4], "notes": ""}'))
    v = table(spark, d, "labels").select("doc_id", text.alias("v"))
    return v.select("doc_id", report.passed_text(F.col("v")).alias("passed_text"), report.passed_parsed(F.col("v")).alias("passed_parsed"), report.matched_count(F.col("v")).cast("bigint").alias("matched"))


@query("SELECT user_id, count(*) FILTER (value > 50) * 2 > count(*) AS passed FROM events GROUP BY 1")
def consensus(spark, d):
    return report.consensus(table(spark, d, "events").withColumn("ok", F.col("value") > 50), ["user_id"], "ok")


_SEV = "CASE WHEN p_size > 40 THEN 'CRITICAL' WHEN p_size > 30 THEN 'HIGH' WHEN p_size > 20 THEN 'MEDIUM' WHEN p_size > 10 THEN 'LOW' ELSE 'INFO' END"


@query(f"SELECT severity, count(*) AS findings, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS rank FROM (SELECT {_SEV} AS severity FROM part) GROUP BY 1")
def severity_counts(spark, d):
    return report.severity_counts(table(spark, d, "part").withColumn("severity", F.expr(_SEV)), "severity")


@query(f"SELECT {_SEV.replace('p_size', 'max(p_size)')} AS risk FROM part")
def overall_risk(spark, d):
    return report.overall_risk(table(spark, d, "part").withColumn("severity", F.expr(_SEV)), "severity")


@query(f"""WITH p AS (SELECT p_brand, p_type, CASE WHEN p_size > 45 THEN 'BLOCKER' ELSE {_SEV} END AS severity FROM part),
 r AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END AS rank FROM p)
 SELECT p_brand, p_type, min(rank) AS rank, arg_min(severity, rank) AS severity FROM r GROUP BY 1, 2""")
def merged_findings(spark, d):
    """BLOCKER is no known severity: it is last, and stays what it is."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.when(F.col("p_size") > 45, "BLOCKER").otherwise(F.expr(_SEV)).alias("severity"))
    return report.merge_reports([p.where("p_partkey % 2 = 0").drop("p_partkey"), p.where("p_partkey % 2 = 1").drop("p_partkey")], ["p_brand", "p_type"], "severity")


@query("SELECT p_partkey, p_size * p_retailprice / 10 AS score FROM part ORDER BY score DESC, p_partkey LIMIT 5")
def findings_topk(spark, d):
    return report.top_findings(table(spark, d, "part"), F.col("p_size"), F.col("p_retailprice"), F.lit(10), "p_partkey", 5).select("p_partkey", "score")


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS rank FROM part")
def category_rank(spark, d):
    word = F.element_at(F.array(*map(F.lit, [*report.PRIORITIES, "Later"])), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.rank_in(word, report.PRIORITIES).alias("rank"))


@query("WITH c AS (SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY 1) SELECT coalesce(max(n) = 1, true) AS holds, count(*) FILTER (n > 1) AS violations FROM c")
def fd_profile(spark, d):
    return report.functional_dependency(table(spark, d, "part"), "p_brand", "p_type")


def _dependency_sql(name: str, columns: list[str], most: int) -> str:
    """Every set of up to ``most`` columns, by counting distinct rows."""
    sets = [x for n in range(most + 1) for x in combinations(sorted(columns), n)]
    listed = lambda x: f"CAST({list(x)} AS VARCHAR[])"
    count = lambda x: f"(SELECT count(DISTINCT ({', '.join(x)})) FROM t)" if x else "(SELECT least(count(*), 1) FROM t)"
    counts = " UNION ALL ".join(f"SELECT {listed(x)} AS x, {count(x)} AS n" for x in sets)
    pairs = " UNION ALL ".join(f"SELECT {listed(x)} AS x, '{c}' AS c, {count([*x, c])} AS n" for x in sets for c in columns if c not in x)
    return f"""WITH t AS (FROM {name}), s AS ({counts}), u AS (SELECT x FROM s WHERE n = (SELECT count(*) FROM t)),
 k AS (SELECT x FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE len(v.x) < len(u.x) AND list_has_all(u.x, v.x))), p AS ({pairs}), h AS (SELECT p.x, p.c FROM p JOIN s ON p.x = s.x AND p.n = s.n),
 m AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h v WHERE v.c = h.c AND len(v.x) < len(h.x) AND list_has_all(h.x, v.x)))
 SELECT array_to_string(x, ',') AS determinant, c AS dependent, CASE WHEN EXISTS (SELECT 1 FROM k WHERE list_contains(k.x, m.c)) OR EXISTS (SELECT 1 FROM k WHERE list_has_all(m.x, k.x)) THEN NULL
 WHEN EXISTS (SELECT 1 FROM k WHERE list_has_all(k.x, m.x)) THEN '2NF' ELSE '3NF' END AS breaks FROM m"""


_CUSTOMER = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(_dependency_sql("(SELECT *, c_nationkey % 5 AS region FROM customer)", [*_CUSTOMER, "region"], 2))
def normal_forms(spark, d):
    """The region hangs on the nation, which is no key."""
    return normalform.normal_forms(table(spark, d, "customer").withColumn("region", F.col("c_nationkey") % 5), [*_CUSTOMER, "region"], 2)


@query("SELECT round(avg(p_size) - stddev_pop(p_size), 6) AS low, round(avg(p_size), 6) AS mean, round(avg(p_size) + stddev_pop(p_size), 6) AS high, round(avg(p_size) + 2 * stddev_pop(p_size), 6) AS very_high FROM part")
def sigma_thresholds(spark, d):
    t = report.sigma_levels(table(spark, d, "part"), "p_size")
    return t.select(*(F.round(c, 6).alias(c) for c in t.columns))


@query("""WITH e AS (SELECT event_id, user_id, CAST(epoch(ts) AS BIGINT) AS s, CASE WHEN value > 1 THEN 0.0 ELSE 1.0 END AS bad FROM events)
 SELECT event_id, round(avg(bad) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) / 0.01, 6) AS burn FROM e""")
def burn_rate(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 + 0.5).alias("s"))
    return report.burn_rate(e, "user_id", "s", F.col("value") > 1, 86400, 0.99).select("event_id", F.round("burn", 6).alias("burn"))


def _burn_sql() -> str:
    windows = sorted({w for *_, a, b in report.BURN_POLICIES for w in (a, b)})
    sums = ", ".join(f"sum({c}) OVER (PARTITION BY user_id ORDER BY bucket RANGE BETWEEN {w // 60 - 1} PRECEDING AND CURRENT ROW) AS {c}_{w}" for w in windows for c in ("n", "bad"))
    burn = lambda w: f"bad_{w} / n_{w} / 0.5"
    rows = " UNION ALL ".join(f"SELECT user_id, bucket, '{s}' AS severity, CAST({f} AS DOUBLE) AS factor, round({burn(a)}, 6) AS burn_long, round({burn(b)}, 6) AS burn_short, {burn(a)} > {f} AND {burn(b)} > {f} AS fires FROM w" for s, f, a, b in report.BURN_POLICIES)
    return f"""WITH e AS (SELECT user_id, CAST(floor(floor(epoch(ts)) / 60) AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (NOT value > 1) AS bad FROM events GROUP BY 1, 2),
 w AS (SELECT user_id, bucket, {sums} FROM e) {rows}"""


@query(_burn_sql())
def burn_alerts(spark, d):
    e = table(spark, d, "events").select("user_id", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"))
    out = report.burn_alerts(e, "user_id", "s", F.col("value") > 1, 0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("burn_long", "burn_short")})


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'major' WHEN bool_or(event_type = 'click') THEN 'minor' WHEN bool_or(event_type = 'view') THEN 'patch' ELSE 'none' END AS bump FROM events GROUP BY 1")
def version_bump(spark, d):
    m = F.when(F.col("event_type") == "purchase", "x BREAKING").when(F.col("event_type") == "click", "feat: a").when(F.col("event_type") == "view", "fix: b").otherwise("chore")
    return report.version_bump(table(spark, d, "events").select("user_id", m.alias("m")), ["user_id"], "m")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_windowed_tally(spark, d):
    from sparkweft.streaming.tally import windowed_tally

    out = windowed_tally(table(spark, d, "events"), "ts", "event_type", "1 hour", "10 minutes")
    return out.withColumn("total", F.round("total", 4))
