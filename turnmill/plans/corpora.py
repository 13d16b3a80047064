"""Queries: sources, sinks, corpus builds.  Files are written to the shared folder from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnmill import catalog
from turnmill.functions.text import strip
from turnmill.functions.tokens import HashEncoder, bos_ids, joined
from turnmill.operators import order as od
from turnmill.operators.rl import trajectory_lines
from turnmill.plans import inputs, sql
from turnmill.plans.formats import _ALPACA, _alpaca
from turnmill.plans.presets import MIXES, PRESETS, build_mix, encode_corpus
from turnmill.plans.registry import query
from turnmill.session import fresh_path, stage
from turnmill.sources import readers as rd
from turnmill.sources import sinks as sk

_DOC_SCHEMA = "doc_id bigint, source string, lang string, text string"


def _documents(spark, d):
    return inputs.table(spark, d, "documents").select("doc_id", "source", "lang", "text")


@query("src_json", "SELECT doc_id, source, lang, text FROM documents")
def src_json(spark, d):
    """JSON arrays of up to 64 records, one per file."""
    path = fresh_path(spark, "json")
    arrays = _documents(spark, d).withColumn("grp", od.int_div("doc_id", 64)).groupBy("grp").agg(
        F.to_json(F.collect_list(F.struct("doc_id", "source", "lang", "text"))).alias("value"))
    arrays.repartition("grp").write.partitionBy("grp").text(path)
    return rd.read_json(spark, _DOC_SCHEMA, folder=path, suffix="")


@query("src_jsonl", "SELECT doc_id, source, lang, text FROM documents")
def src_jsonl(spark, d):
    path = fresh_path(spark, "jsonl")
    _documents(spark, d).write.json(path)
    return rd.read_jsonl(spark, _DOC_SCHEMA, folder=path, suffix=".json")


@query("src_multi", f"""
WITH f AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS no FROM (SELECT DISTINCT source FROM documents)),
a AS (SELECT doc_id, no, CASE no % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 ELSE 0.5 END AS ratio,
        row_number() OVER (PARTITION BY source ORDER BY {sql.key('doc_id')}, doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
      FROM documents JOIN f USING (source))
SELECT CAST(no AS INTEGER) AS "part", doc_id FROM a, unnest(range(2)) t(copy)
WHERE copy < floor(ratio) OR (copy = floor(ratio) AND pos < floor(n * ratio) - n * floor(ratio))""")
def src_multi(spark, d):
    """A folder per source, written in one job; each has a ratio of its own."""
    root = fresh_path(spark, "multi")
    _documents(spark, d).withColumn("folder", F.col("source")).write.partitionBy("folder").json(root)
    names = sorted(r["source"] for r in inputs.table(spark, d, "documents").select("source").distinct().collect())
    paths = [f"{root}/folder={name}" for name in names]
    rows = rd.read_many(spark, _DOC_SCHEMA, paths, id_col="doc_id", ratios=[(1.0, 1.5, 0.5)[i % 3] for i in range(len(paths))])
    return rows.select((F.array_position(F.lit(paths), F.col("path")) - 1).cast("int").alias("part"), "doc_id")


@query("src_message_lines", "SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def src_message_lines(spark, d):
    path = fresh_path(spark, "lines")
    lists = inputs.message_lists(spark, d)
    tagged = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"),
                                                        F.col("sample_id").cast("string").alias("name")))
    lists.select(F.to_json(tagged).alias("value")).write.text(path)
    rows = rd.read_message_lines(spark, path)
    return rows.select(F.get("messages", F.lit(0))["name"].cast("long").alias("conv_id"),
                       F.size("messages").cast("long").alias("n_messages"),
                       F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("line_offsets", """
WITH l AS (SELECT source, doc_id, CAST(doc_id AS VARCHAR) || ' ' || replace(replace(text, chr(10), ' '), chr(13), ' ') AS line FROM documents)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line_no,
       CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""")
def line_offsets(spark, d):
    """One text file per source, written in document order, then indexed by line."""
    path = fresh_path(spark, "offsets")
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")))
    docs = _documents(spark, d).select("source", "doc_id", line.alias("value"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    rows = rd.number_lines(rd.read_lines(spark, path))
    return rows.select(F.regexp_extract("file", r"source=([^/]+)/", 1).alias("source"),
                       F.regexp_extract("value", r"^(\d+)", 1).cast("long").alias("doc_id"), "line_no", "offset")


@query("corpus_by_file", f"""
SELECT CAST(doc_id % 5 AS INTEGER) AS file_idx, count(*) AS n_samples, CAST(sum(1 + {sql.n_words(sql.strip('text'))}) AS BIGINT) AS n_tokens
FROM documents GROUP BY 1""")
def corpus_by_file(spark, d):
    """Every input folder becomes its own data set, written under its number in the order of paths; tasks write what they read."""
    root, out = fresh_path(spark, "files"), fresh_path(spark, "by-file")
    docs = _documents(spark, d).withColumn("file", F.col("doc_id") % 5)
    docs.write.partitionBy("file").json(root)
    rows = spark.read.schema(_DOC_SCHEMA).option("recursiveFileLookup", True).json(root)
    rows = rows.select("doc_id", "text", F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("path"))
    # One row per input file.
    files = stage(rows.select("path").distinct(), "files").select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("int").alias("file_idx"))
    sk.write_corpus(_encode_plain(rows.join(files, "path")), out, partition_by=["file_idx"])
    return spark.read.parquet(out).groupBy("file_idx").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("num_tokens").cast("long").alias("n_tokens"))


def _encode_plain(docs, folder="file_idx"):
    enc = HashEncoder()
    ids = F.concat(F.array(*[F.lit(b) for b in enc.bos]), enc.ids(strip("text")))
    return docs.select("doc_id", folder, ids.alias("input_ids")).withColumn("num_tokens", F.size("input_ids"))


@query("file_manifest", """
SELECT 'lang=' || lang || '/source=' || source AS folder, count(*) > 0 AS has_files,
       dense_rank() OVER (ORDER BY 'lang=' || lang, 'source=' || source) - 1 AS folder_no FROM documents GROUP BY lang, source""")
def file_manifest(spark, d):
    path = fresh_path(spark, "tree")
    _documents(spark, d).select("lang", "source", F.col("doc_id").cast("string").alias("value")).write.partitionBy("lang", "source").text(path)
    files = rd.manifest(spark, path).select(
        F.regexp_extract("rel_path", "^(.*)/[^/]+$", 1).alias("folder"),
        F.regexp_extract("sort_key", "^(.*)\x01[^\x01]+$", 1).alias("key"))
    folders = files.groupBy("folder", "key").agg((F.count(F.lit(1)) > 0).alias("has_files"))
    # folders are bucketed by their first levels, which the sort key keeps in order
    top = folders.select(F.substring_index("key", "\x01", 1).alias("top")).distinct()
    top = top.withColumn("no", F.row_number().over(Window.orderBy("top")) - 1)
    placed = folders.withColumn("top", F.substring_index("key", "\x01", 1)).join(top, "top")
    ranked = od.running(placed, order=["key"], bucket=F.col("no").cast("long"), index="folder_no")
    return ranked.select("folder", "has_files", "folder_no")


@query("src_permissive", """
SELECT doc_id % 9 = 0 AS broken, count(*) AS n, min(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id END) AS first_id FROM documents GROUP BY 1""")
def src_permissive(spark, d):
    """Every ninth line is cut in half; readers keep it aside."""
    path = fresh_path(spark, "dump")
    line = F.to_json(F.struct("doc_id", "source", "lang"))
    cut = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit('{"doc_id": '), line)).otherwise(line)
    _documents(spark, d).select(cut.alias("value")).write.text(path)
    good, bad = rd.read_checked(spark, "doc_id bigint, source string, lang string", path)
    count = lambda df, flag: df.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).select(
        F.lit(flag).alias("broken"), "n", "first_id")
    return count(good, False).unionByName(count(bad, True))


@query("src_tsv", """
SELECT doc_id AS "index", lang AS "A", source AS "B", CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS answer, 'dev' AS split FROM documents""")
def src_tsv(spark, d):
    """A multiple-choice table as tab-separated text; it has answers, so it is a dev split."""
    path = fresh_path(spark, "tsv")
    _documents(spark, d).select(F.col("doc_id").alias("index"), F.col("lang").alias("A"), F.col("source").alias("B"), F.when(
        F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("answer")).write.option("sep", "\t").option("header", True).csv(path)
    rows = rd.read_tsv(spark, "index bigint, A string, B string, answer string", path)
    return rows.withColumn("split", F.lit(rd.mcq_split(rows)))


@query("split_select", """
SELECT 'test' AS asked, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT 'all', count(*), sum(n_chars)::BIGINT FROM documents""")
def split_select(spark, d):
    path = fresh_path(spark, "splits")
    docs = inputs.table(spark, d, "documents").select("doc_id", "n_chars", F.when(
        F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"))
    sk.write_corpus(docs, path, partition_by=["split"])
    corpus = spark.read.parquet(path)
    out = None
    for asked in ("test", None):
        part = rd.select_split(corpus, asked).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).select(
            F.lit(asked or "all").alias("asked"), "n", "chars")
        out = part if out is None else out.unionByName(part)
    return out


@query("sink_roundtrip", f"WITH {sql.samples(256)} SELECT sample_id, num_tokens, {sql.text('input_ids')} AS input_ids FROM samples")
def sink_roundtrip(spark, d):
    back = stage(inputs.samples(spark, d, 256), "corpus")
    return back.select("sample_id", F.col("num_tokens").cast("long").alias("num_tokens"), joined("input_ids").alias("input_ids"))


_LINES = """
l AS (SELECT event_type AS file, event_id, event_id || ' ' || event_type || ' ' || user_id AS line, CAST(3 AS BIGINT) AS num_tokens FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) AS i, count(*) OVER (PARTITION BY file) AS n FROM l),
parts AS (SELECT 'train' AS split, file, event_id, line, num_tokens FROM i
          UNION ALL SELECT 'valid', file, event_id, line, num_tokens FROM i WHERE i % 10 = 0 AND n // 10 > 200)
"""


def _event_lines(spark, d):
    e = inputs.table(spark, d, "events")
    return e.select(F.col("event_type").alias("file"), "event_id", F.concat_ws(
        " ", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")).alias("line"),
        F.lit(3).cast("long").alias("num_tokens"))


def _train_valid(spark, d):
    return sk.train_valid(_event_lines(spark, d), file="file", order=["event_id"], bucket=od.chunk_bucket("event_id"),
                          every=10, keep_above=200)


@query("train_valid_meta", f"""
WITH {_LINES}
SELECT split, file, event_id, num_tokens, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY split, file ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM parts""")
def train_valid_meta(spark, d):
    return _train_valid(spark, d).select("split", "file", "event_id", "num_tokens", "offset")


@query("train_valid_files", f"""
WITH {_LINES} SELECT split, file, event_id, num_tokens, line FROM parts""")
def train_valid_files(spark, d):
    """Every line, read from the files at the offset that the meta table names."""
    path = fresh_path(spark, "train-valid")
    meta = sk.write_lines(_train_valid(spark, d), path, file="file", part_bytes=1 << 16)
    return sk.read_at(meta).select("split", "file", "event_id", "num_tokens", "line")


@query("corpus_token_totals", f"""
WITH t AS (SELECT source AS dataset, 1 + {sql.n_words(sql.strip('text'))} AS n FROM documents WHERE doc_id % 4 <> 0)
SELECT dataset, count(*) AS n_samples, CAST(sum(n) AS BIGINT) AS n_tokens FROM t GROUP BY dataset""")
def corpus_token_totals(spark, d):
    """Files below ``processed`` are encoded in two runs; the second skips the folders whose output is there."""
    root, out = fresh_path(spark, "raw-corpus"), fresh_path(spark, "encoded-corpus")
    _documents(spark, d).withColumns({"step": F.when(F.col("doc_id") % 4 == 0, "raw").otherwise("processed"), "set": F.col("source")}).write.partitionBy(
        "step", "set").json(root)
    rows = spark.read.schema(_DOC_SCHEMA).option("recursiveFileLookup", True).json(root)
    folder = F.regexp_extract("_metadata.file_path", "/step=processed/set=([^/]+)/", 1)
    rows = rows.select("doc_id", "text", folder.alias("set")).where("set <> ''")

    def run(todo):
        sk.write_corpus(_encode_plain(todo, "set"), out, partition_by=["set"], mode="append")

    run(rows.where("set = 'src3'"))
    done = spark.read.schema("num_tokens int, set string").parquet(out).select("set").distinct()
    run(rd.not_done(rows, done, on="set"))
    return spark.read.schema("num_tokens int, set string").parquet(out).groupBy(F.col("set").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("num_tokens").cast("long").alias("n_tokens"))


@query("trajectory_dump", """
WITH s AS (SELECT user_id, event_id, event_type, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 256 AS episode FROM events)
SELECT user_id AS traj_id, CAST(episode AS BIGINT) AS episode, count(*) AS num_tokens, round(sum(value / 100) / count(*), 6) AS reward,
       string_agg(event_type, ' ' ORDER BY event_id) AS "sequence" FROM s GROUP BY user_id, episode""")
def trajectory_dump(spark, d):
    """Episodes of at most 256 steps, logged as JSON lines and read back."""
    e = inputs.steps(spark, d).withColumn("episode", od.int_div("step", 256))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "event_type"))), lambda s: s["event_type"]), " ")
    t = e.groupBy("traj_id", "episode").agg(
        F.count(F.lit(1)).alias("num_tokens"), F.round(F.sum("x") / F.count(F.lit(1)), 6).alias("ori_reward"), said.alias("sequence"))
    path = fresh_path(spark, "trajectories")
    head = F.concat_ws("|", F.col("traj_id").cast("string"), F.col("episode").cast("string"), "sequence")
    sk.write_report(trajectory_lines(t.withColumn("sequence", head)), path)
    back = spark.read.schema("num_tokens bigint, reward double, sequence string").json(path)
    part = lambda i: F.get(F.split("sequence", r"\|"), F.lit(i))
    return back.select(part(0).cast("long").alias("traj_id"), part(1).cast("long").alias("episode"), "num_tokens", "reward",
                       part(2).alias("sequence"))


@query("content_hash_index", """
SELECT source, sha256(sha256(string_agg(doc_id || chr(10), '' ORDER BY doc_id))) AS file_key, source <> 'src2' AS todo FROM documents GROUP BY source""")
def content_hash_index(spark, d):
    """One file per source, each shorter than a block; known keys need no work."""
    path = fresh_path(spark, "hashes")
    docs = _documents(spark, d).select("source", "doc_id").repartition("source").sortWithinPartitions("source", "doc_id")
    docs.select("source", F.col("doc_id").cast("string").alias("value")).write.partitionBy("source").text(path)
    keys = rd.content_keys(spark, path, HashEncoder().version, ".txt").withColumn(
        "source", F.regexp_extract("path", "source=([^/]+)/", 1))
    done = keys.where("source = 'src2'").select("cache_key")
    todo = rd.not_done(keys, done).select("path", F.lit(True).alias("todo"))
    return keys.join(todo, "path", "left").select("source", "file_key", F.coalesce("todo", F.lit(False)).alias("todo"))


def _default_turn(system: str | None, i: str, o: str) -> str:
    """Length of a turn in the default template (BOS, input, output, EOS, separator), and of what precedes its output."""
    s = f"'<|System|>:' || {system} || chr(10) || " if system else ""
    before = f"1 + {sql.n_words(s + chr(39) + '<|User|>:' + chr(39) + f' || {i} || chr(10) || ' + chr(39) + '<|Bot|>:' + chr(39))}"
    return f"{before} AS before, least(2048, {before} + {sql.n_words(o)} + 2) AS n"


_PRESET_SQL = {
    "law_crime": ("lawyer", "text", "source", "documents"),
    "law_reference": ("lawyer", "lang", "text", "documents"),
    "alpaca": (None, "instruction || chr(10) || input", "output", "alpaca WHERE output <> '<nooutput>'"),
    "arxiv": ("arxiv_gentile", "text", "source", "documents"),
    "code_alpaca": ("coder", "text", "source", "documents"),
    "colorist": ("colorist", sql.strip("substr(text, instr(text, ':') + 1)"), "lang", "(SELECT 'c:' || text AS text, lang FROM documents)"),
    "medical": ("medical", "lang || chr(10) || text", "source", "documents"),
    "sql": ("sql", "lang || chr(10) || text", "source", "documents"),
    "tiny_codes": ("coder", "text", "source", "documents"),
    "open_orca": ("source!", "lang", "text", "documents"),
}


def _preset_sql(name: str) -> str:
    s, i, o, table = _PRESET_SQL[name]
    system = None if s is None else (s[:-1] if s.endswith("!") else sql.lit(catalog.SYSTEMS[s]))
    return (f"SELECT '{name}' AS preset, count(*) AS n_samples, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n) // 2048 AS BIGINT) AS n_packs "
            f"FROM (SELECT {_default_turn(system, i, o)} FROM {table}) WHERE before < 2048")


@query("preset_corpora", f"WITH {_ALPACA}\n" + "\nUNION ALL\n".join(_preset_sql(n) for n in _PRESET_SQL if not n.startswith("law")))
def preset_corpora(spark, d):
    """Ready-made corpora: samples, tokens and full packs of each."""
    docs = inputs.texts(spark, d).select("doc_id", "source", "lang", "text")
    shapes = {
        "alpaca": _alpaca(spark, d),
        "arxiv": docs.select("doc_id", F.col("text").alias("abstract"), F.col("source").alias("title")),
        "code_alpaca": docs.select("doc_id", F.col("text").alias("prompt"), F.col("source").alias("completion")),
        "colorist": docs.select("doc_id", F.concat(F.lit("c:"), "text").alias("description"), F.col("lang").alias("color")),
        "medical": docs.select("doc_id", F.col("lang").alias("instruction"), F.col("text").alias("input"), F.col("source").alias("output")),
        "sql": docs.select("doc_id", F.col("lang").alias("context"), F.col("text").alias("question"), F.col("source").alias("answer")),
        "tiny_codes": docs.select("doc_id", F.col("text").alias("prompt"), F.col("source").alias("response")),
        "open_orca": docs.select("doc_id", F.col("source").alias("system_prompt"), F.col("lang").alias("question"), F.col("text").alias("response")),
    }
    out = None
    for name, records in shapes.items():
        p = PRESETS[name]
        coded = encode_corpus(records, p.fmt, p.template, id_col="doc_id", max_length=p.max_length)
        part = coded.agg(F.count(F.lit(1)).alias("n_samples"), F.sum("num_tokens").alias("n_tokens")).select(
            F.lit(name).alias("preset"), "n_samples", "n_tokens", od.int_div("n_tokens", p.max_length).alias("n_packs"))
        out = part if out is None else out.unionByName(part)
    return out



@query("mix_corpora", f"SELECT preset AS source, n_packs, CAST(n_packs * 2048 AS BIGINT) AS n_tokens FROM ({_preset_sql('law_crime')} UNION ALL {_preset_sql('law_reference')})")
def mix_corpora(spark, d):
    """A ready-made mix of two corpora: each keeps its name and its own packs."""
    docs = inputs.texts(spark, d).select("doc_id", "source", "lang", "text")
    shapes = {"law_crime": docs.select("doc_id", F.col("text").alias("input"), F.col("source").alias("output")),
              "law_reference": docs.select("doc_id", F.col("lang").alias("question"), F.col("text").alias("answer"))}
    packs = build_mix({name: shapes[name] for name in MIXES["lawyer"]}, id_col="doc_id")
    return packs.groupBy("source").agg(F.count(F.lit(1)).alias("n_packs"), F.sum(F.size("input_ids")).alias("n_tokens"))


_FAMILIES = {"qwen": (), "llama": (1,), "chatglm": (64790, 64792)}


@query("bos_policies", f"""
WITH {_ALPACA}, t AS (SELECT doc_id, instruction, {sql.n_words('output')} AS o, {_default_turn(None, "instruction || chr(10) || input", "output")} FROM alpaca WHERE output <> '<nooutput>'),
f AS (SELECT * FROM (VALUES {', '.join(f"('{name}', {len(ids)}, '{','.join(map(str, ids))}')" for name, ids in _FAMILIES.items())}) v(family, k, lead))
SELECT family, CAST(doc_id AS VARCHAR) AS doc_id, instruction AS language, CAST(least(2048, before - 1 + k + o + 2) AS BIGINT) AS num_tokens, lead
FROM t, f WHERE before - 1 + k < 2048""")
def bos_policies(spark, d):
    """One corpus for tokenizer families with no, one and two BOS ids; a column is renamed, unused ones go, ids become texts."""
    records = _alpaca(spark, d).withColumn("doc_id", F.col("doc_id").cast("string"))
    out = None
    for family, ids in _FAMILIES.items():
        coded = encode_corpus(records, "alpaca", "default", HashEncoder(bos=bos_ids(family, own=1)), id_col="doc_id", max_length=2048,
                              rename={"instruction": "language"}, keep=["language"])
        lead = joined(F.slice("input_ids", 1, len(ids))) if ids else F.lit("")
        part = coded.select(F.lit(family).alias("family"), "doc_id", "language", F.col("num_tokens").cast("long").alias("num_tokens"), lead.alias("lead"))
        out = part if out is None else out.unionByName(part)
    return out
