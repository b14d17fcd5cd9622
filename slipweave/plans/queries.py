"""Driver queries for the library's own operators, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..conf import DEFAULT, SUPPORTED_EXTENSIONS
from ..functions.text import file_name, or_default, path_parts, stem
from ..operators import geometry, images, quality, rows
from ..operators.ordinal import with_ordinal
from ..schemas import RAW
from ..sources import sinks
from ..sources.files import latest, supported, table
from . import dataset, pipeline
from .fixtures import DONE, INPUTS, MANIFEST, RECEIPTS, TEXTS, duck, receipts, view

_A, _B, _T, _C, _D = (f"({duck(x)})" for x in (RECEIPTS, INPUTS, TEXTS, MANIFEST, DONE))

# The code points stripped from texts, as DuckDB's trim takes them.
_WS = " || ".join(f"chr({n})" for n in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))

_CLEAN = f"""
a as {_A},
f as (select receipt_id, seq, trim(text, {_WS}) text, x1, y1, x2, y2, coalesce(confidence, 0.0) confidence
      from a where trim(text, {_WS}) <> '')"""
_WIDTH = "greatest(x2 - x1, 1e-6) / greatest(length(text), 1)"
_RATIO = "case when least({0}) - greatest({1}) > 0 and least({2}) > 0 then (least({0}) - greatest({1})) / least({2}) else 0.0 end"
_FOLD = f"""
s as (select *, (y1 + y2) / 2 yc, {_WIDTH} cw, row_number() over (partition by receipt_id order by (y1 + y2) / 2, seq) k from f),
g as (
  select receipt_id, k, 1 row_no, y1 lo, y2 hi from s where k = 1
  union all
  select s.receipt_id, s.k, case when r >= 0.4 then row_no else row_no + 1 end,
         case when r >= 0.4 then least(lo, y1) else y1 end, case when r >= 0.4 then greatest(hi, y2) else y2 end
  from (select s.receipt_id, s.k, s.y1, s.y2, g.row_no, g.lo, g.hi,
               {_RATIO.format("hi, y2", "lo, y1", "hi - lo, y2 - y1")} r
        from g join s on s.receipt_id = g.receipt_id and s.k = g.k + 1) s),
rowed as (select s.*, g.row_no from s join g using (receipt_id, k))"""
_JOINED = """
pairs as (select *, x1 - lag(x2) over w gap, (lag(cw) over w + cw) / 2 m from rowed
          window w as (partition by receipt_id, row_no order by x1, yc, seq)),
lines as (select receipt_id, row_no, string_agg(case when gap is null then '' when gap > 3.0 * m then '  ' else ' ' end || text, '' order by x1, yc, seq) row_text
          from pairs group by receipt_id, row_no)"""
_STATS = """
st as (select o_orderkey receipt_id, cast(count(f.receipt_id) as int) num_lines, coalesce(avg(f.confidence), 0.0) avg_confidence
       from orders left join f on f.receipt_id = o_orderkey group by o_orderkey),
q as (select *, case when num_lines = 0 then 'empty' when avg_confidence < 0.5 then 'low_confidence' else 'ok' end status from st)"""


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    return receipts(spark, d)


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return quality.clean(_fragments(spark, d))


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("receipt_id"))


def fragments_clean(spark, d):
    return _clean(spark, d)


def geometry_query(spark, d):
    return _clean(spark, d).select(
        "receipt_id", "seq", geometry.y_center(F.col("y1"), F.col("y2")).alias("yc"),
        geometry.height(F.col("y1"), F.col("y2")).alias("height"), "x1", "x2",
    )


def char_width(spark, d):
    return _clean(spark, d).select("receipt_id", "seq", geometry.char_width(F.col("text"), F.col("x1"), F.col("x2")).alias("char_width"))


def y_overlap(spark, d):
    w = Window.partitionBy("receipt_id").orderBy("seq")
    return (
        _clean(spark, d).withColumn("p1", F.lag("y1").over(w)).withColumn("p2", F.lag("y2").over(w)).where("p1 is not null")
        .select("receipt_id", "seq", geometry.overlap_ratio(F.col("p1"), F.col("p2"), F.col("y1"), F.col("y2")).alias("ratio"))
    )


def row_group(spark, d):
    return rows.group_rows(_clean(spark, d)).select("receipt_id", "seq", "row_no")


def row_join(spark, d):
    return rows.row_texts(_clean(spark, d))


def row_join_of_groups(spark, d):
    return rows.join_rows(rows.group_rows(_clean(spark, d)))


def _rebuilt(spark, d):
    """Text and statistics of every receipt from one gathering of its fragments."""
    found = rows.receipts(_clean(spark, d))
    return _receipts(spark, d).join(found, "receipt_id", "left").select(
        "receipt_id", F.coalesce("num_lines", F.lit(0)).alias("num_lines"), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def reconstruct_text(spark, d):
    return _rebuilt(spark, d).select("receipt_id", "text")


def receipt_stats(spark, d):
    return quality.stats(_receipts(spark, d), _clean(spark, d))


def status(spark, d):
    return quality.with_status(receipt_stats(spark, d)).select("receipt_id", "status")


def flagship(spark, d):
    """Receipts with text, statistics and status."""
    return quality.with_status(_rebuilt(spark, d))


def manifest(spark, d):
    good = quality.with_status(receipt_stats(spark, d)).select(
        F.concat(F.lit("in/r"), F.col("receipt_id"), F.lit(".jpg")).alias("file"),
        F.concat(F.lit("r"), F.col("receipt_id")).alias("output_id"), "status", "num_lines", "avg_confidence",
        F.lit(None).cast("string").alias("error"), ((F.col("receipt_id") % 64) / 64.0).alias("duration_s"),
    )
    bad = view(spark, d, MANIFEST).where("status = 'error'").select(
        F.concat(F.lit("in/"), F.col("output_id"), F.lit(".png")).alias("file"), "output_id", "status", F.lit(0).alias("num_lines"),
        F.lit(0.0).alias("avg_confidence"), F.lit("cannot decode").alias("error"), F.lit(0.0).alias("duration_s"),
    )
    return sinks.manifest_entry(good.unionByName(bad))


def raw_payload(spark, d):
    line = F.struct("seq", "text", F.array("x1", "y1", "x2", "y2").alias("bbox"), "confidence")
    lines = _clean(spark, d).groupBy("receipt_id").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    size = F.array(F.lit(1000), F.lit(2000))
    report = F.struct(
        size.alias("original_size"), size.alias("final_size"), F.lit(False).alias("exif_transposed"), F.lit(False).alias("resized"),
        F.lit(False).alias("upscaled"), F.lit(True).alias("contrast_enhanced"), F.lit(0).alias("rotation_applied_degrees"),
        F.expr("cast(array() as array<string>)").alias("notes"),
    )
    kept = F.transform("ls", lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"), x["confidence"].alias("confidence")))
    source = F.concat(F.lit("in/r"), F.col("receipt_id"), F.lit(".jpg"))
    back = F.from_json(sinks.raw_payload(source, report, kept), RAW)
    return lines.select("receipt_id", back.alias("r")).select(
        "receipt_id", "r.source_image", "r.preprocessing.contrast_enhanced", F.size("r.text_lines").alias("n"),
        F.element_at("r.text_lines", 1)["text"].alias("first_text"),
        F.aggregate("r.text_lines", F.lit(0.0), lambda a, x: a + F.element_at(x["bbox"], 3)).alias("sum_x2"),
        F.aggregate("r.text_lines", F.lit(0.0), lambda a, x: a + x["confidence"]).alias("sum_confidence"),
    )


def ext_filter(spark, d):
    return supported(view(spark, d, INPUTS)).select("doc_id", "path")


def path_sort(spark, d):
    ranked = with_ordinal(view(spark, d, INPUTS).select("doc_id", "path", path_parts(F.col("path")).alias("_k")), "_k", "doc_id", name="pos")
    return ranked.select("doc_id", "path", "pos")


def batch_chunks(spark, d):
    ranked = with_ordinal(supported(view(spark, d, INPUTS)).select("doc_id", path_parts(F.col("path")).alias("_k")), "_k", "doc_id", name="pos")
    return ranked.select("doc_id", F.floor(F.col("pos") / DEFAULT.max_images_per_call).alias("chunk"), (F.col("pos") % DEFAULT.max_images_per_call).alias("slot"))


def _inputs(spark, d):
    return supported(view(spark, d, INPUTS)).withColumn("output_id", stem(F.col("path")))


def incremental(spark, d):
    return dataset.todo(_inputs(spark, d), view(spark, d, DONE)).select("doc_id", "output_id")


def overwrite(spark, d):
    return dataset.todo(_inputs(spark, d), view(spark, d, DONE), overwrite=True).select("doc_id", "output_id")


def skipped_count(spark, d):
    inputs = _inputs(spark, d)
    return dataset.skipped(inputs, dataset.todo(inputs, view(spark, d, DONE)))


def latest_text(spark, d):
    """Every document is a text of one of 400 ids, in ten runs; the last one written counts."""
    written = table(spark, d, "documents").select(
        F.concat(F.lit("r"), F.col("doc_id") % 400).alias("output_id"), "text", F.lit(None).cast("string").alias("raw"),
        (F.col("doc_id") % 10).alias("run"), F.col("doc_id").alias("place"),
    )
    return latest(written).select("output_id", "text")


def manifest_order(spark, d):
    """Lines by run, then chunk by chunk, in each the failed images first."""
    c = _union(spark, d)
    size = DEFAULT.max_images_per_call
    lines = c.select((F.col("pos") % 3).alias("run"), pipeline.place(F.col("chunk"), F.col("phase"), F.col("pos"), size).alias("place"), "pos", "output_id")
    return with_ordinal(lines, "run", "place", name="line").select("line", "pos", "output_id")


def output_paths(spark, d):
    paths = sinks.output_paths("out", stem(F.col("path")))
    return view(spark, d, INPUTS).select("doc_id", paths["raw_json"].alias("raw_json"), paths["text"].alias("text_file"))


def exif_flag(spark, d):
    tag = F.when(F.col("doc_id") % 11 < 10, F.col("doc_id") % 11).cast("int")
    return view(spark, d, INPUTS).select("doc_id", images.exif_transposed(tag).alias("exif_transposed"))


def default_values(spark, d):
    """An empty text and a zero fall through to the default, as a missing one does."""
    name, most = F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 4)
    return table(spark, d, "documents").select(
        "doc_id", or_default(F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(name), F.lit("r"), F.lit("")).alias("output_id"),
        or_default(most, F.lit(16).cast("long"), F.lit(0).cast("long")).alias("max_batch"),
    )


def jsonl_dataset(spark, d):
    return dataset.build(view(spark, d, MANIFEST), view(spark, d, TEXTS))


def jsonl_fallback(spark, d):
    return dataset.build_from_listing(view(spark, d, TEXTS)).select("output_id", "input")


def _union(spark, d):
    c = view(spark, d, MANIFEST).withColumn("chunk", F.floor(F.col("pos") / DEFAULT.max_images_per_call))
    bad = F.col("status").eqNullSafe("error")
    return dataset.union_results(c.where(bad), c.where(~bad))


def error_union(spark, d):
    order = F.col("chunk") * 2 * DEFAULT.max_images_per_call + F.col("phase") * DEFAULT.max_images_per_call + F.col("pos") % DEFAULT.max_images_per_call
    return _union(spark, d).select("pos", "output_id", "chunk", "phase", order.alias("order_key"))


def run_summary(spark, d):
    return dataset.summary(_union(spark, d))


def orientation(spark, d):
    turned = _fragments(spark, d).withColumn("rotation", F.explode(F.array(*[F.lit(x) for x in images.ROTATIONS])))
    conf = F.col("confidence") * (128 - (F.col("receipt_id") + F.col("rotation") / 90) % 3) / 128.0
    return images.best_rotation(turned.withColumn("confidence", conf))


def resize_bounds(spark, d):
    return view(spark, d, INPUTS).select("doc_id", images.resize_bounds(F.col("w"), F.col("h")).alias("b")).select("doc_id", "b.*")


def oom_schedule(spark, d):
    tried = images.backoff(DEFAULT.recognition_batch, DEFAULT.detector_batch, DEFAULT.oom_divisor)
    return spark.createDataFrame([(i, *x) for i, x in enumerate(tried)], "attempt int, recognition int, detector int")


def file_stem(spark, d):
    return view(spark, d, INPUTS).select("doc_id", file_name(F.col("path")).alias("name"), stem(F.col("path")).alias("stem"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fragments_clean": fragments_clean, "geometry": geometry_query, "char_width": char_width, "y_overlap": y_overlap,
    "row_group": row_group, "row_join": row_join, "reconstruct_text": reconstruct_text, "receipt_stats": receipt_stats,
    "status": status, "flagship": flagship, "manifest": manifest, "raw_payload": raw_payload, "ext_filter": ext_filter,
    "path_sort": path_sort, "batch_chunks": batch_chunks, "incremental": incremental, "jsonl_dataset": jsonl_dataset,
    "jsonl_fallback": jsonl_fallback, "error_union": error_union, "run_summary": run_summary, "orientation": orientation,
    "resize_bounds": resize_bounds, "oom_schedule": oom_schedule, "file_stem": file_stem, "row_join_of_groups": row_join_of_groups,
    "overwrite": overwrite, "skipped_count": skipped_count, "latest_text": latest_text, "manifest_order": manifest_order,
    "output_paths": output_paths, "exif_flag": exif_flag, "default_values": default_values,
}

_EXT = ", ".join(f"'{x}'" for x in SUPPORTED_EXTENSIONS)
_OK = f"b as (select * from {_B} where regexp_extract(lower(path), '(\\.[^./]+)$', 1) in ({_EXT}))"
_SIDE = "case when {1} > 2560 then greatest(1, cast(round_even({0} * (2560.0 / {1}), 0) as int)) when {1} < 1000 then greatest(1, cast(round_even({0} * (1000.0 / {1}), 0) as int)) else {0} end"
_TEXT_OUT = "(select receipt_id, string_agg(row_text, chr(10) order by row_no) text from lines group by receipt_id)"

ORACLE: dict[str, str] = {
    "fragments_clean": f"with {_CLEAN} select * from f",
    "geometry": f"with {_CLEAN} select receipt_id, seq, (y1 + y2) / 2 yc, greatest(y2 - y1, 1e-6) height, x1, x2 from f",
    "char_width": f"with {_CLEAN} select receipt_id, seq, {_WIDTH} char_width from f",
    "y_overlap": f"with {_CLEAN}, p as (select *, lag(y1) over w p1, lag(y2) over w p2 from f window w as (partition by receipt_id order by seq)) select receipt_id, seq, {_RATIO.format('p2, y2', 'p1, y1', 'p2 - p1, y2 - y1')} ratio from p where p1 is not null",
    "row_group": f"with recursive {_CLEAN}, {_FOLD} select receipt_id, seq, row_no from rowed",
    "row_join": f"with recursive {_CLEAN}, {_FOLD}, {_JOINED} select receipt_id, row_no, row_text from lines",
    "row_join_of_groups": f"with recursive {_CLEAN}, {_FOLD}, {_JOINED} select receipt_id, row_no, row_text from lines",
    "reconstruct_text": f"with recursive {_CLEAN}, {_FOLD}, {_JOINED} select o_orderkey receipt_id, coalesce(text, '') text from orders left join {_TEXT_OUT} t on receipt_id = o_orderkey",
    "receipt_stats": f"with {_CLEAN}, {_STATS} select * from st",
    "status": f"with {_CLEAN}, {_STATS} select receipt_id, status from q",
    "flagship": f"with recursive {_CLEAN}, {_FOLD}, {_JOINED}, {_STATS} select q.*, coalesce(text, '') text from q left join {_TEXT_OUT} t using (receipt_id)",
    "manifest": f"""with {_CLEAN}, {_STATS}
select 'in/r' || receipt_id || '.jpg' file, 'r' || receipt_id output_id, status, num_lines, cast(format('{{:.4f}}', avg_confidence) as double) avg_confidence,
       cast(null as varchar) error, cast(format('{{:.3f}}', (receipt_id % 64) / 64.0) as double) duration_s from q
union all select 'in/' || output_id || '.png', output_id, status, 0, 0.0, 'cannot decode', 0.0 from {_C} where status = 'error'""",
    "raw_payload": f"""with {_CLEAN} select receipt_id, 'in/r' || receipt_id || '.jpg' source_image, true contrast_enhanced, cast(count(*) as int) n,
       arg_min(text, seq) first_text, sum(x2) sum_x2, sum(confidence) sum_confidence from f group by receipt_id""",
    "ext_filter": f"with {_OK} select doc_id, path from b",
    "path_sort": f"select doc_id, path, row_number() over (order by string_split(path, '/'), doc_id) - 1 pos from {_B}",
    "batch_chunks": f"with {_OK}, p as (select doc_id, row_number() over (order by string_split(path, '/'), doc_id) - 1 pos from b) select doc_id, pos // 16 chunk, pos % 16 slot from p",
    "incremental": f"with {_OK}, i as (select doc_id, regexp_extract(path, '([^/]+)\\.[^.]*$', 1) output_id from b) select * from i where output_id not in (select output_id from {_D})",
    "overwrite": f"with {_OK} select doc_id, regexp_extract(path, '([^/]+)\\.[^.]*$', 1) output_id from b",
    "skipped_count": f"""with {_OK}, i as (select regexp_extract(path, '([^/]+)\\.[^.]*$', 1) in (select output_id from {_D}) done from b)
select count(*) found, count(*) filter (not done) todo, count(*) filter (done) skipped from i""",
    "latest_text": "select 'r' || doc_id % 400 output_id, arg_max_null(text, doc_id % 10 * 1000000000 + doc_id) text from documents group by 1",
    "manifest_order": f"""select row_number() over (order by pos % 3, pos // 16, status is distinct from 'error', pos) - 1 line, pos, output_id from {_C}""",
    "output_paths": f"""with i as (select doc_id, regexp_extract(path, '([^/]+)\\.[^.]*$', 1) s from {_B})
select doc_id, 'out/' || s || '/raw.json' raw_json, 'out/' || s || '/text.txt' text_file from i""",
    "exif_flag": f"select doc_id, doc_id % 11 not in (1, 10) exif_transposed from {_B}",
    "default_values": """select doc_id, case when doc_id % 7 = 0 or doc_id % 3 = 0 or coalesce(source, '') = '' then 'r' else source end output_id,
       case when doc_id % 5 = 0 or doc_id % 4 = 0 then 16 else doc_id % 4 end max_batch from documents""",
    "jsonl_dataset": f"select pos, output_id, text \"input\" from {_C} join {_T} t using (output_id) where status is distinct from 'error'",
    "jsonl_fallback": f"select output_id, text \"input\" from {_T}",
    "error_union": f"select pos, output_id, pos // 16 chunk, cast(status is distinct from 'error' as int) phase, (pos // 16) * 32 + 16 * cast(status is distinct from 'error' as int) + pos % 16 order_key from {_C}",
    "run_summary": f"select count(*) total, count(*) filter (status is distinct from 'error') succeeded, count(*) filter (status = 'error') failed from {_C}",
    "orientation": f"""with a as {_A}, t as (select receipt_id, unnest([0, 90, 180, 270]) rotation, confidence from a),
s as (select receipt_id, rotation, avg(coalesce(confidence * (128 - (receipt_id + rotation // 90) % 3) / 128.0, 0.0)) score from t group by all)
select receipt_id, cast(first(rotation order by score desc, rotation) as int) rotation, max(score) score from s group by receipt_id""",
    "resize_bounds": f"with b as (select *, greatest(w, h) g from {_B}) select doc_id, {_SIDE.format('w', 'g')} width, {_SIDE.format('h', 'g')} height, g > 2560 resized, g < 1000 upscaled from b",
    "oom_schedule": "with recursive t as (select 0 attempt, 96 recognition, 8 detector union all select attempt + 1, greatest(1, recognition // 2), greatest(1, detector // 2) from t where attempt < 3 and not (recognition = 1 and detector = 1)) select * from t",
    "file_stem": f"select doc_id, regexp_extract(path, '([^/]+)$', 1) \"name\", regexp_extract(path, '([^/]+)\\.[^.]*$', 1) stem from {_B}",
}
