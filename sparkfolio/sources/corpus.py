"""Sources, sinks and packages: files of jobs, library stores, typed JSON columns, snapshots and rendered papers.

Files of jobs are listed, read and written by tasks, in any store that pyarrow knows; paths are <root>/<job_id>/<file>.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from sparkfolio.functions.text import strip, text
from sparkfolio.operators.jobs import FAILED, PARTIAL, RETRY, RUNNING, WAITING, DONE, failure_reason, given

# Suffixes of images, and the outside names of task states.
IMAGE_SUFFIX = r"(?i)\.(png|jpe?g|gif|webp|bmp|tiff?|svg)$"
OUTSIDE = {RUNNING: "PROCESSING", WAITING: "WAITING_REVIEW", PARTIAL: "PARTIAL_COMPLETED", DONE: "COMPLETED", FAILED: "FAILED", RETRY: "RETRYABLE"}

LAYOUT_ITEM = "struct<type:string,text:string,img_path:string,bbox:array<double>,page_idx:int>"


#: What tasks hand on at once while they list: names of entries, and bytes of contents.
_LISTED, _READ = 10_000, 16 << 20


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _below(store: fs.FileSystem, path: str) -> Iterator[fs.FileInfo]:
    """The files below a folder, without hidden ones and hidden folders; one folder's entries at a time."""
    for entry in store.get_file_info(fs.FileSelector(path)):
        if _hidden(entry.base_name):
            continue
        if entry.type == fs.FileType.Directory:
            yield from _below(store, entry.path)
        else:
            yield entry


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(job_id, relative, path, length) of the files below <root>/<job_id> whose names match. Tasks list the folders, so the driver gets none of their names."""

    def jobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for _ in batches:
            names = [x.base_name for x in store.get_file_info(fs.FileSelector(base)) if not _hidden(x.base_name)]
            for at in range(0, len(names), _LISTED):
                yield pd.DataFrame({"job_id": names[at : at + _LISTED]})

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        fits = re.compile(pattern)
        for part in batches:
            rows = []
            for job in part["job_id"]:
                start = f"{base.rstrip('/')}/{job}"
                here = store.get_file_info(start)  # a file beside the jobs is one of its own
                for x in _below(store, start) if here.type == fs.FileType.Directory else [here]:
                    if fits.fullmatch(x.base_name):
                        rows.append((job, x.path[len(start) + 1 :], x.path, x.size))
            yield pd.DataFrame(rows, columns=["job_id", "relative", "path", "length"])

    names = _dealt(spark.range(0, 1, 1, 1).mapInPandas(jobs, "job_id string"))  # into a given number of tasks, or few bytes of names would be one
    return names.mapInPandas(listed, "job_id string, relative string, path string, length long")


def _dealt(files: DataFrame) -> DataFrame:
    """Files dealt by job_id into a given number of tasks, which a window over job_id keeps."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job_id")


def _contents(files: DataFrame, root: str) -> DataFrame:
    """(job_id, relative, content) of files as ``_files`` lists them, dealt by job_id; some files at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(root)
        names = ["job_id", "relative", "content"]
        for part in batches:
            rows, size = [], 0
            for job, relative, path in zip(part["job_id"], part["relative"], part["path"], strict=True):
                with store.open_input_stream(path) as f:
                    rows.append((job, relative, f.read()))
                size += len(rows[-1][2])
                if size >= _READ:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return files.select("job_id", "relative", "path").mapInPandas(read, "job_id string, relative string, content binary")


def write_files(files: DataFrame, root: str) -> int:
    """Writes (job_id, relative, content binary) as files <root>/<job_id>/<relative> of any store that pyarrow knows; how many.

    Each is written under a name of its task attempt and then moved in place, so a lost or repeated task leaves whole files only.
    """
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        attempt = TaskContext.get().taskAttemptId()
        for part in batches:
            for job, relative, content in zip(part["job_id"], part["relative"], part["content"], strict=True):
                path = f"{base}/{job}/{relative}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{path}.{attempt}") as out:
                    out.write(content)
                store.move(f"{path}.{attempt}", path)
            yield pd.DataFrame({"n": [len(part)]})

    rows = files.select(F.col("job_id").cast("string").alias("job_id"), "relative", "content")
    return rows.mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_markdown_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, path, markdown): the largest Markdown file of each job; bytes that aren't UTF-8 are replaced. Sizes decide before contents are read."""
    best = Window.partitionBy("job_id").orderBy(F.desc("length"), "path")
    chosen = _dealt(_files(spark, root, r"(?s).*\.(md|markdown|MD)")).withColumn("k", F.row_number().over(best)).where("k = 1")
    files = _contents(chosen, root)
    clean = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))
    return files.select("job_id", F.col("relative").alias("path"), clean.alias("markdown"))


def read_layout_json(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, order, type, text, image_ref, page_index, x0, y0, x1, y1): blocks of each job's *_middle.json, else *_content_list.json; blocks without a valid box go."""
    return layout_items(_contents(_dealt(_files(spark, root, r"(?s).*\.json").where(F.col("relative").rlike("_(middle|content_list)\\.json$"))), root))


def layout_items(files: DataFrame) -> DataFrame:
    """The blocks of each job's preferred file among (job_id, relative, content)."""
    rank = F.when(F.col("relative").endswith("_middle.json"), 0).otherwise(1)
    best = Window.partitionBy("job_id").orderBy(rank, "relative")
    one = files.withColumn("k", F.row_number().over(best)).where("k = 1")
    items = F.from_json(F.col("content").cast("string"), f"array<{LAYOUT_ITEM}>")
    rows = one.select("job_id", F.posexplode(items).alias("n", "i"))
    box = F.col("i.bbox")
    fine = (F.size(box) == 4) & (F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1)))
    rows = rows.where(fine)
    order = F.row_number().over(Window.partitionBy("job_id").orderBy("n")) - 1
    return rows.select("job_id", order.alias("order"), F.col("i.type").alias("type"), text(F.col("i.text")).alias("text"), text(F.col("i.img_path")).alias("image_ref"), F.col("i.page_idx").alias("page_index"), *[F.get(box, F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


def asset_manifest(files: DataFrame) -> DataFrame:
    """(job_id, position, name, path, size, type) of image files (job_id, relative, length), in order of path."""
    images = files.where(F.col("relative").rlike(IMAGE_SUFFIX))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("relative")) - 1
    return images.select("job_id", place.alias("position"), F.regexp_extract("relative", "[^/]*$", 0).alias("name"), F.col("relative").alias("path"), F.col("length").alias("size"), F.lower(F.regexp_extract("relative", IMAGE_SUFFIX, 1)).alias("type"))


def job_files(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, relative, length) of all files below a folder; contents aren't read."""
    return _files(spark, root, "(?s).*").select("job_id", "relative", "length")


LIBRARY = (
    "tasks array<struct<id:string,title:string,status:string>>, knowledgePoints array<struct<id:string,name:string,parentId:string>>, "
    "bankQuestions array<struct<id:string,stemMarkdown:string,answer:string,score:double>>, papers array<struct<id:string,title:string,questionIds:array<string>>>"
)


def load_library_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of a JSON store; rows with a blank id, or blank name or title, are skipped."""
    store = spark.read.schema(LIBRARY).option("multiLine", "true").json(path)
    named = {"tasks": "title", "knowledgePoints": "name", "bankQuestions": "id", "papers": "title"}
    return {t: store.select(F.inline(t)).where(given(F.col("id")) & given(F.col(n))) for t, n in named.items()}


def insert_missing(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Target plus the incoming rows whose id it lacks, the first of each id."""
    new = incoming.join(target.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return target.unionByName(new.select(*target.columns))


def typed_json_columns(df: DataFrame, schemas: dict[str, str | DataType]) -> DataFrame:
    """JSON text columns as typed ones; null, empty and malformed text is an empty array or map (null for structs)."""
    for name, schema in schemas.items():
        parsed = F.from_json(F.col(name), schema)
        kind = str(schema).lower()
        empty = F.array().cast(schema) if kind.startswith("array") else F.create_map().cast(schema) if kind.startswith("map") else F.lit(None)
        df = df.withColumn(name, F.coalesce(parsed, empty))
    return df


def standardize_status(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in OUTSIDE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, status), F.lit("UNKNOWN"))


def first_given(entry: Column, keys: tuple[str, ...]) -> Column:
    """The first value that isn't blank under some keys of a map."""
    return F.coalesce(*[F.nullif(F.trim(text(F.try_element_at(entry, F.lit(k)))), F.lit("")) for k in keys], F.lit(""))


def normalize_options(options: Column) -> Column:
    """array<map<string, string>> of options in any spelling to array<struct<label, content>>."""
    return F.transform(options, lambda o: F.struct(first_given(o, ("label", "key", "name", "option")).alias("label"), first_given(o, ("contentMarkdown", "markdown", "text", "content", "value")).alias("content")))


def question_package(tasks: DataFrame, questions: DataFrame) -> DataFrame:
    """(task_id, status, questions array<struct<number, id, stem>>, warnings): a job's package; a manual stem counts before the stem."""
    stem = F.when(given(F.col("manual_stem")), F.col("manual_stem")).otherwise(F.col("stem"))
    q = questions.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("number", F.col("question_id").alias("id"), stem.alias("stem")))).alias("questions"))
    reason = failure_reason(F.col("paper_error"), F.col("answer_error"))
    j = tasks.join(q, "task_id", "left")
    warnings = F.array_compact(F.array(F.when(given(reason), "JOB_FAILURE_REASON"), F.when(F.coalesce(F.size("questions"), F.lit(0)) <= 0, "EMPTY_QUESTION_PACKAGE")))
    return j.select("task_id", standardize_status(F.col("status")).alias("status"), F.coalesce("questions", F.array().cast(j.schema["questions"].dataType)).alias("questions"), warnings.alias("warnings"))


def sync_snapshot(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Target (task_id, id, stem, answer, n_children) after a sync: rows of synced tasks are replaced by the incoming ones, new ones added, those missing dropped;
    other tasks' rows stay. Parents with children keep no answer. ``change``: inserted, updated, same or kept."""
    synced = incoming.select("task_id").distinct()
    new = incoming.withColumn("answer", F.when(F.coalesce("n_children", F.lit(0)) > 0, "").otherwise(F.col("answer")))
    columns = [c for c in target.columns if c not in ("task_id", "id")]
    mark = lambda df: df.select("task_id", "id", F.xxhash64(*[text(F.col(c)) for c in columns]).alias("_h"))
    old = mark(target).withColumnRenamed("_h", "_old")
    merged = new.join(mark(new), ["task_id", "id"]).join(old, ["task_id", "id"], "left")
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.col("_h"), "same").otherwise("updated")
    kept = target.join(synced, "task_id", "left_anti").withColumn("change", F.lit("kept"))
    return merged.select(*target.columns, change.alias("change")).unionByName(kept)


def render_paper_markdown(papers: DataFrame, items: DataFrame, with_answers: bool = False) -> DataFrame:
    """(paper_id, markdown): title, a line of total score and count, numbered questions with options, answers if asked for.

    papers (paper_id, title); items (paper_id, position, stem, score, options array<string>, answer).
    """
    total = F.sum(F.coalesce("score", F.lit(0.0)))
    rows = items.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("position", "stem", "options", "answer"))).alias("q"), total.alias("total"), F.count(F.lit(1)).alias("n"))
    letters = F.array(*[F.lit(chr(65 + k)) for k in range(26)])

    def one(q, i):
        options = F.transform(q["options"], lambda o, k: F.concat(F.element_at(letters, k + 1), F.lit(". "), o))
        parts = F.concat(F.array(F.concat((i + 1).cast("string"), F.lit(". "), strip(text(q["stem"])))), F.coalesce(options, F.array().cast("array<string>")))
        if with_answers:
            parts = F.concat(parts, F.when(given(q["answer"]), F.array(F.concat(F.lit("答案："), q["answer"]))).otherwise(F.array().cast("array<string>")))
        return F.array_join(parts, "\n")

    number = F.regexp_replace(F.round("total", 6).cast("string"), r"\.0$", "")
    head = F.array(F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.concat(F.lit("满分："), number, F.lit(" 题数："), F.col("n").cast("string")))
    return rows.join(papers, "paper_id").select("paper_id", F.array_join(F.concat(head, F.transform("q", one)), "\n\n").alias("markdown"))
