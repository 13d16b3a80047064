"""Queries: evaluation of prediction tables, image metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill import catalog
from turnmill.functions.tokens import HashEncoder
from turnmill.operators import metrics as mt
from turnmill.operators import regions as rg
from turnmill.operators.order import dedup_split, int_div
from turnmill.plans import inputs, sql
from turnmill.plans.inputs import six
from turnmill.plans.registry import query
from turnmill.session import fresh_path, spread, stage
from turnmill.sources.sinks import write_report

_SUBJECT_LIST = list(catalog.SUBJECTS)


def _predictions(spark, d):
    e = inputs.table(spark, d, "embeddings")
    names = F.array(*[F.lit(s) for s in _SUBJECT_LIST])
    # the highest of all values of a vector stands for one of four options
    return e.select("vec_id", F.get(names, (F.col("vec_id") % len(_SUBJECT_LIST)).cast("int")).alias("subject"),
                    (mt.first_argmax(F.col("embedding")) % 4).cast("int").alias("pred"), (F.col("label") % 4).cast("int").alias("gt"))


_PRED = f"""
pred AS (SELECT vec_id, [{', '.join(sql.lit(s) for s in _SUBJECT_LIST)}][vec_id % {len(_SUBJECT_LIST)} + 1] AS subject,
           CAST((list_position(embedding, list_max(embedding)) - 1) % 4 AS INTEGER) AS pred, CAST(label % 4 AS INTEGER) AS gt FROM embeddings)
"""


@query("mcq_argmax", f"WITH {_PRED} SELECT vec_id, subject, pred, gt FROM pred")
def mcq_argmax(spark, d):
    return _predictions(spark, d)


def _hierarchy_rows() -> str:
    group = {sub: cat for cat, subs in catalog.CATEGORIES.items() for sub in subs}
    return ", ".join(f"({sql.lit(s)}, {sql.lit(c)}, {sql.lit(group[c])})" for s, c in catalog.SUBJECTS.items())


@query("hierarchical_accuracy", f"""
WITH {_PRED}, h AS (SELECT * FROM (VALUES {_hierarchy_rows()}) v(subject, subcategory, category)),
j AS (SELECT *, CASE WHEN pred = gt THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM pred JOIN h USING (subject)),
g AS (SELECT 'subject' AS level, subject AS name, count(*) AS n, avg(hit) AS accuracy FROM j GROUP BY subject
      UNION ALL SELECT 'subcategory', subcategory, count(*), avg(hit) FROM j GROUP BY subcategory
      UNION ALL SELECT 'category', category, count(*), avg(hit) FROM j GROUP BY category)
SELECT level, name, n, round(accuracy, 6) AS accuracy FROM g
UNION ALL SELECT 'average', 'average', CAST(sum(n) AS BIGINT), round(avg(accuracy), 6) FROM g WHERE level = 'subject'""")
def hierarchical_accuracy(spark, d):
    return mt.hierarchical_accuracy(_predictions(spark, d)).withColumn("accuracy", six("accuracy"))


_BASE = 1_000_000_000


def _circular(spark, d):
    """Variants of a question are the lines of an order; duplicates of a line count as predictions of their own."""
    li = inputs.table(spark, d, "lineitem")
    index = F.col("l_orderkey") + (F.col("l_linenumber").cast("long") - 1) * _BASE
    letter = lambda n: F.substring(F.lit("ABCD"), n + 1, F.lit(1))
    said = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("The answer is "), letter(F.col("l_linenumber") % 4))).when(
        F.col("l_returnflag") == "R", letter(F.col("l_linenumber") % 4)).otherwise(F.concat(F.lit("Because "), letter(F.col("l_partkey").cast("int") % 4)))
    predictions = li.select(index.alias("index"), said.alias("prediction"))
    kinds = F.array(*[F.lit(a) for a in list(catalog.ABILITY_NAMES)[:6] + ["other"]])
    questions = li.select(index.alias("index"), letter(F.col("l_linenumber") % 4).alias("answer"), F.get(
        kinds, (F.col("l_orderkey") % 7).cast("int")).alias("l2-category")).distinct()
    return predictions, questions


_CIRC = f"""
q AS (SELECT l_orderkey + CAST({_BASE} AS BIGINT) * (l_linenumber - 1) AS idx, substr('ABCD', l_linenumber % 4 + 1, 1) AS answer, l_orderkey,
        CASE WHEN l_returnflag = 'A' THEN 'The answer is ' || substr('ABCD', l_linenumber % 4 + 1, 1)
             WHEN l_returnflag = 'R' THEN substr('ABCD', l_linenumber % 4 + 1, 1)
             ELSE 'Because ' || substr('ABCD', CAST(l_partkey % 4 AS INTEGER) + 1, 1) END AS prediction FROM lineitem),
h AS (SELECT idx % {_BASE} AS question, min(CASE WHEN regexp_extract(prediction, '([A-D]+)', 1) = answer THEN 1 ELSE 0 END) AS hit,
        bool_or(idx < {_BASE}) AS is_main FROM q GROUP BY 1),
m AS (SELECT question, hit, [{', '.join(sql.lit(a) for a in list(catalog.ABILITY_NAMES.values())[:6] + ['other'])}][question % 7 + 1] AS ability FROM h WHERE is_main)
"""


@query("circular_eval", f"""
WITH {_CIRC} SELECT ability, count(*) AS n, round(avg(hit), 6) AS accuracy FROM m GROUP BY ability
UNION ALL SELECT 'Average', count(*), round(avg(hit), 6) FROM m""")
def circular_eval(spark, d):
    predictions, questions = _circular(spark, d)
    return mt.circular_accuracy(predictions, questions, base=_BASE).withColumn("accuracy", six("accuracy"))


@query("report_files", f"""
WITH {_CIRC}, a AS (SELECT ability, count(*) AS n, round(avg(hit), 6) AS accuracy FROM m GROUP BY ability)
SELECT 'metric' AS kind, ability AS name, CAST(n AS BIGINT) AS n, CAST(accuracy AS DOUBLE) AS "value" FROM a
UNION ALL SELECT 'metric', 'Average', count(*), round(avg(hit), 6) FROM m
UNION ALL SELECT 'result', CAST(question AS VARCHAR), 1, CAST(hit AS DOUBLE) FROM m""")
def report_files(spark, d):
    """A result table and a metrics file, written as JSON lines and read back."""
    predictions, questions = _circular(spark, d)
    results, metrics = fresh_path(spark, "results"), fresh_path(spark, "metrics")
    write_report(mt.circular_hits(predictions, questions, _BASE), results)
    write_report(mt.circular_accuracy(predictions, questions, base=_BASE), metrics)
    back = spark.read.schema("question long, hit int").json(results).select(
        F.lit("result").alias("kind"), F.col("question").cast("string").alias("name"), F.lit(1).cast("long").alias("n"), F.col("hit").cast("double").alias("value"))
    return back.unionByName(spark.read.schema("ability string, n long, accuracy double").json(metrics).select(
        F.lit("metric").alias("kind"), F.col("ability").alias("name"), "n", six("accuracy").alias("value")))


@query("circular_hits", f"WITH {_CIRC} SELECT question, CAST(hit AS INTEGER) AS hit FROM m")
def circular_hits(spark, d):
    predictions, questions = _circular(spark, d)
    return mt.circular_hits(predictions, questions, _BASE)


def _line_box():
    """A box in a 400 x 300 image from a line's quantity, discount and tax."""
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return q * 3, disc * 1000, q + 20, tax * 1000 + 30


_BOX = ("l_quantity * 3 AS x, l_discount * 1000 AS y, l_quantity + 20 AS w, l_tax * 1000 + 30 AS h")
_NORM = ("CAST(trunc(x / 400 * 100) AS INTEGER) AS x1, CAST(trunc(y / 300 * 100) AS INTEGER) AS y1, "
         "CAST(trunc((x + w) / 400 * 100) AS INTEGER) AS x2, CAST(trunc((y + h) / 300 * 100) AS INTEGER) AS y2")


@query("bbox_normalize", f"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, {_BOX} FROM lineitem), n AS (SELECT *, {_NORM} FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, x1, y1, x2, y2, '{{<' || x1 || '><' || y1 || '><' || x2 || '><' || y2 || '>}}' AS "text" FROM n""")
def bbox_normalize(spark, d):
    box = rg.normalised_box(*_line_box(), F.lit(300.0), F.lit(400.0))
    li = inputs.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box.alias("b"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(
        ("x1", "y1", "x2", "y2"))], rg.box_text(F.col("b")).alias("text"))


@query("iou_accuracy", f"""
WITH b AS (SELECT l_returnflag, l_partkey, {_BOX} FROM lineitem), n AS (SELECT *, {_NORM} FROM b),
s AS (SELECT *, x1 + CAST(l_partkey % 9 AS INTEGER) AS a1, y1 + CAST(l_partkey % 4 AS INTEGER) AS b1,
        x2 + CAST(l_partkey % 5 AS INTEGER) AS a2, y2 + CAST(l_partkey % 4 AS INTEGER) AS b2, l_partkey % 11 = 0 AS bad FROM n),
i AS (SELECT *, greatest(least(x2, a2) - greatest(x1, a1) + 1, 0) * greatest(least(y2, b2) - greatest(y1, b1) + 1, 0) AS inter FROM s),
u AS (SELECT *, CAST(inter AS DOUBLE) / ((x2 - x1 + 1) * (y2 - y1 + 1) + (a2 - a1 + 1) * (b2 - b1 + 1) - inter) AS iou FROM i)
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE bad) AS n_malformed,
       round(count(*) FILTER (WHERE NOT bad AND iou > 0.5) / count(*), 6) AS accuracy FROM u GROUP BY l_returnflag""")
def iou_accuracy(spark, d):
    box = rg.normalised_box(*_line_box(), F.lit(300.0), F.lit(400.0))
    k = F.col("l_partkey").cast("int")
    li = inputs.table(spark, d, "lineitem").select("l_returnflag", "l_partkey", box.alias("box"))
    g = lambda i: F.get("box", F.lit(i))
    shifted = F.array(g(0) + k % 9, g(1) + k % 4, g(2) + k % 5, g(3) + k % 4)
    said = F.when(k % 11 == 0, F.lit("no box 12")).otherwise(rg.box_text(shifted))
    return mt.iou_accuracy(li.withColumn("ans", said), by=["l_returnflag"]).withColumn("accuracy", six("accuracy"))


# ---------------------------------------------------------------- regions

def region_tables(spark, d):
    """Images are orders, annotations and references are lines, sentences are the words of a part's name."""
    orders, li, part = inputs.table(spark, d, "orders"), inputs.table(spark, d, "lineitem"), inputs.table(spark, d, "part")
    images = orders.select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 300 + 200).cast("int").alias("height"),
                           (F.col("o_orderkey") % 400 + 300).cast("int").alias("width"))
    # a line is keyed by order and number; repeated lines collapse
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("q"), F.min("l_discount").alias("disc"),
        F.min("l_returnflag").alias("flag"))
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    annotations = lines.select(key.alias("ann_id"), F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 10).alias("category_id"),
                               F.array(F.col("q"), F.col("disc") * 100, F.col("q") + 10, F.lit(20.0)).alias("bbox"))
    split = F.when(F.col("flag") == "A", "train").when(F.col("flag") == "R", "testA").otherwise("testBC")
    refs = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        key.alias("ref_id"), key.alias("ann_id"), F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 10).alias("category_id"),
        split.alias("split"), F.split("p_name", " ").alias("sentences"))
    return refs, annotations, images


_REGION = """
li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS q, min(l_discount) AS disc, min(l_returnflag) AS flag
       FROM lineitem GROUP BY 1, 2),
refs AS (SELECT l_orderkey * 8 + l_linenumber AS ref_id, l_orderkey AS image_id, l_partkey % 10 AS category_id, q, disc,
           CASE flag WHEN 'A' THEN 'train' WHEN 'R' THEN 'testA' ELSE 'testBC' END AS split, string_split(p_name, ' ') AS sentences
         FROM li JOIN part ON p_partkey = l_partkey),
images AS (SELECT o_orderkey AS image_id, CAST(o_custkey % 300 + 200 AS INTEGER) AS height, CAST(o_orderkey % 400 + 300 AS INTEGER) AS width FROM orders),
rows AS (SELECT ref_id, lpad(CAST(image_id AS VARCHAR), 12, '0') AS image, height, width, q, disc, sent, CAST(k - 1 AS INTEGER) AS sent_no,
           'set-by-' || lpad(CAST(image_id AS VARCHAR), 12, '0') || '-' || sent AS id
         FROM (SELECT ref_id, image_id, q, disc, unnest(sentences) AS sent, generate_subscripts(sentences, 1) AS k FROM refs WHERE split = 'train')
         JOIN images USING (image_id)),
dedup AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ref_id * 64 + sent_no) - 1 AS dup FROM rows)
"""


def _regions(spark, d):
    # joined once, read by the bucket totals and by the ranking
    rows = stage(rg.region_rows(*region_tables(spark, d), dataset="set", split_by="by").withColumn(
        "_seq", F.col("ref_id") * 64 + F.col("sent_no")), "regions")
    return dedup_split(rows, "id", "_seq", int_div("_seq", 512))


@query("region_join", f"WITH {_REGION} SELECT id, ref_id, image, height, width, sent, dup FROM dedup")
def region_join(spark, d):
    return _regions(spark, d).select("id", "ref_id", "image", "height", "width", "sent", "dup")


_R_NORM = ("CAST(trunc(q / width * 100) AS INTEGER) || '><' || CAST(trunc(disc * 100 / height * 100) AS INTEGER) || '><' || "
           "CAST(trunc((q + (q + 10)) / width * 100) AS INTEGER) || '><' || CAST(trunc((disc * 100 + 20) / height * 100) AS INTEGER)")


def _fan_sql(kind: str, patterns, identify: bool) -> str:
    box = f"('{{<' || {_R_NORM} || '>}}')"
    asked, answer = (box, "sent") if identify else ("sent", box)
    return "\nUNION ALL\n".join(
        f"SELECT '{kind}' AS kind, id, {k} AS pattern, {sql.lit(p.split('{}')[0])} || {asked} || {sql.lit(p.split('{}')[1])} || chr(10) || '<image>' AS human, "
        f"{answer} AS answer FROM dedup WHERE dup = 0" for k, p in enumerate(patterns))


@query("instruction_fanout", f"WITH {_REGION} {_fan_sql('refer', catalog.REFER_PATTERNS, False)} UNION ALL "
       f"{_fan_sql('refer_eval', catalog.REFER_EVAL_PATTERNS, False)} UNION ALL {_fan_sql('identify', catalog.IDENTIFY_PATTERNS, True)}")
def instruction_fanout(spark, d):
    g = lambda i: F.get("bbox", F.lit(i))
    kept = _regions(spark, d).where("dup = 0").select("id", "sent", rg.normalised_box(
        g(0), g(1), g(2), g(3), F.col("height"), F.col("width")).alias("box"))
    out = None
    for kind, patterns, identify in (("refer", catalog.REFER_PATTERNS, False), ("refer_eval", catalog.REFER_EVAL_PATTERNS, False),
                                     ("identify", catalog.IDENTIFY_PATTERNS, True)):
        part = rg.instruction_fanout(kept, patterns, identify=identify).select(F.lit(kind).alias("kind"), "id", "pattern", "human", "answer")
        out = part if out is None else out.unionByName(part)
    return out


@query("region_eval_ids", f"""
WITH {_REGION} SELECT image || '-' || sent AS id, 'coco/train2017/' || image || '.jpg' AS image, sent FROM dedup WHERE dup = 0""")
def region_eval_ids(spark, d):
    """Evaluation rows: image and id from the last but one part of the image name."""
    rows = _regions(spark, d).where("dup = 0").withColumn("img_id", F.concat(F.lit("COCO_train_"), "image", F.lit("_0")))
    return rg.eval_ids(rows).select("id", "image", "sent")


@query("region_filter", f"""
WITH {_REGION}
SELECT 'testA' AS asked, count(*) AS n, CAST(sum(ref_id) AS BIGINT) AS ids FROM refs WHERE contains(split, 'A')
UNION ALL SELECT 'testB', count(*), CAST(sum(ref_id) AS BIGINT) FROM refs WHERE contains(split, 'B')
UNION ALL SELECT 'test', count(*), CAST(sum(ref_id) AS BIGINT) FROM refs WHERE contains(split, 'test')
UNION ALL SELECT 'train', count(*), CAST(sum(ref_id) AS BIGINT) FROM refs WHERE split = 'train' AND category_id IN (SELECT DISTINCT l_partkey % 10 FROM li WHERE l_partkey % 10 < 3)
UNION ALL SELECT 'annotations', count(*), CAST(sum(l_orderkey * 8 + l_linenumber) AS BIGINT) FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def region_filter(spark, d):
    refs, annotations, images = region_tables(spark, d)
    refs = stage(refs.select("ref_id", "category_id", "split"), "refs")  # read by four answers
    cats = refs.select("category_id").distinct().where("category_id < 3")
    finished = inputs.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image_id"))
    asked = {"testA": rg.select_refs(refs, split="testA"), "testB": rg.select_refs(refs, split="testB"), "test": rg.select_refs(refs, split="test"),
             "train": rg.select_refs(refs, categories=cats, split="train")}
    out = None
    for name, rows in asked.items():
        part = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("ref_id").alias("ids")).select(F.lit(name).alias("asked"), "n", "ids")
        out = part if out is None else out.unionByName(part)
    anns = rg.select_annotations(annotations, images=finished).agg(F.count(F.lit(1)).alias("n"), F.sum("ann_id").alias("ids"))
    return out.unionByName(anns.select(F.lit("annotations").alias("asked"), "n", "ids"))


_GRIDS = ", ".join(f"({i}, {j}, {k})" for k, (i, j) in enumerate(rg.ratio_candidates(1, 12)))


@query("vision_tokens", f"""
WITH im AS (SELECT o_orderkey, CAST(o_custkey % 1500 + 200 AS INTEGER) AS w, CAST(o_orderkey % 900 + 200 AS INTEGER) AS h FROM orders),
g AS (SELECT * FROM (VALUES {_GRIDS}) v(i, j, k)),
c AS (SELECT o_orderkey, w, h, i, j, k, abs(CAST(w AS DOUBLE) / h - CAST(i AS DOUBLE) / j) AS diff,
        CAST(w AS DOUBLE) * h > 0.5 * 448 * 448 * i * j AS large FROM im, g),
b AS (SELECT *, min(diff) OVER (PARTITION BY o_orderkey) AS best FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS rn FROM b WHERE diff = best),
p AS (SELECT o_orderkey, w, h, i, j FROM r WHERE large OR rn = 1
      QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN large AND rn > 1 THEN 1 ELSE 0 END DESC, k DESC) = 1)
SELECT o_orderkey, w, h, i, j, CAST(CASE WHEN i * j > 1 THEN i * j + 1 ELSE 1 END AS INTEGER) AS tiles, CAST(256 * (i * j + 1) AS INTEGER) AS n_tokens FROM p""")
def vision_tokens(spark, d):
    im = spread(inputs.table(spark, d, "orders")).select("o_orderkey", (F.col("o_custkey") % 1500 + 200).cast("int").alias("w"),
                                                 (F.col("o_orderkey") % 900 + 200).cast("int").alias("h"))
    im = im.withColumn("grid", rg.closest_grid("w", "h"))
    return im.select("o_orderkey", "w", "h", F.col("grid.i").alias("i"), F.col("grid.j").alias("j"),
                     rg.vision_tiles(F.col("grid")).alias("tiles"),
                     (rg.patch_tokens() * rg.vision_tiles(F.col("grid"), always=True)).alias("n_tokens"))


@query("modality_length", f"""
SELECT doc_id, n, abs(n) AS "length" FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -{sql.n_words('text')} ELSE {sql.n_words('text')} + 256 * 13 END AS n FROM documents)""")
def modality_length(spark, d):
    n = HashEncoder().length("text").cast("long")
    docs = inputs.table(spark, d, "documents").select("doc_id", rg.modality_length(
        n, F.col("doc_id") % 3 != 0, F.lit(rg.patch_tokens() * 13)).cast("long").alias("n"))
    return docs.withColumn("length", F.abs("n"))
